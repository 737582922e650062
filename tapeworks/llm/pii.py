"""Operator 7: personal data, by DataFrame functions alone.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for IBANs, mod 23 for Spanish national
numbers, weighted digits for bank routes, ranges and digit counts for the others), and context words in the characters
before a span raise its score.  Spans of the base kinds are all kept; those of the added kinds are kept from a score on,
which some reach by their checks alone and others (ssn, route, secret) only with a context word.

The patterns never backtrack over a run: quantifiers are possessive, and a match starts at the start of its run or
where the match before ended, which is where the leftmost match starts.  So a text costs time in proportion to its
length, and long runs cost no stack.  Starts and redactions are folded in blocks, so many spans cost no more each.

Positions are code points, end exclusive.  A null text has no spans; a repeated row has the same spans each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import free_name

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "dni", "mac", "ipv6", "route", "secret")
#: Score of a confirmed span without context, what a context word adds, and the words.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "dni": 0.5, "mac": 0.6, "ipv6": 0.6, "route": 0.2, "secret": 0.2}
CONTEXT_ADDS = 0.35
CONTEXT = {
    "email": r"\b(e-?mail|mail|contact|courriel|correo|write)\b",
    "ip": r"\b(ip|host|server|address|serveur|adresse)\b",
    "card": r"\b(card|visa|credit|payment|carte|tarjeta|karte)\b",
    "phone": r"\b(phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "iban": r"\b(iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"\b(ssn|social security|taxpayer)\b",
    "dni": r"\b(dni|nif|identidad)\b",
    "mac": r"\b(mac|ethernet|device|address)\b",
    "ipv6": r"\b(ip|ipv6|host|server|address)\b",
    "route": r"\b(routing|aba|bank|transit)\b",
    "secret": r"(token|secret|passwo?r?d|api[_ -]?key|access[_ -]?key|credential)",
}
CONTEXT_CHARS = 48
KEEP_FROM = 0.5
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "dni": r"(?<![A-Za-z0-9])[0-9]{8}-?[A-HJ-NP-TV-Z](?![A-Za-z0-9])",
    "mac": r"(?<![A-Za-z0-9:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![A-Za-z0-9:-])",
    "ipv6": r"(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:.])",
    "route": r"(?<![A-Za-z0-9.-])[0-9]{9}(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
}
#: Letters of Spanish national numbers by their remainder, and weights of a bank route's digits.
_DNI, _ROUTE = "TRWAGMYFPDXBNJZSQVHLCKE", "371371371"
#: Values that are folded at once, and characters of a chunk.
_BLOCK, _CHUNK = 256, 1024


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def step(total: Column, i: Column) -> Column:
        x = d.substr(i, F.lit(1)).cast("int")
        y = F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))
        return total + y

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def _octet(p: Column) -> Column:
    own = F.regexp_replace(p, "^0+", "")
    return (F.length(own) <= 3) & (F.coalesce(own.try_cast("int"), F.lit(0)) <= 255)


def _mod97(m: Column) -> Column:
    own = F.regexp_replace(m, " ", "")
    turned = F.concat(own.substr(F.lit(5), F.length(own)), own.substr(1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.length(own).between(15, 34) & (F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _octet)
    if kind == "card":
        return F.when(F.length(_digits(m)).between(16, 19), _luhn(m)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "ssn":
        return ~m.substr(1, 3).isin("000", "666") & ~m.startswith("9") & (m.substr(5, 2) != "00") & (m.substr(8, 4) != "0000")
    if kind == "dni":
        return m.substr(-1, 1) == F.lit(_DNI).substr((m.substr(1, 8).cast("int") % 23 + 1).cast("int"), F.lit(1))
    if kind == "route":
        total = sum(m.substr(i + 1, 1).cast("int") * int(w) for i, w in enumerate(_ROUTE))
        return (total % 10 == 0) & ~m.startswith("00")
    if kind == "mac":
        return ~F.upper(F.regexp_replace(m, "[:-]", "")).isin("000000000000", "FFFFFFFFFFFF")
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _check(kind: str):
    return lambda m: _valid(kind, m)


def _may_hold(kind: str, text: Column) -> Column:
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ipv6": F.contains(text, F.lit(":"))}.get(kind, F.lit(True))


def _before(values: Column, step) -> Column:
    """For each of the values (integers, not null), the fold of those before it from 0; step is associative.

    Folds within blocks come first, so that arrays that grow stay short.
    """
    empty = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("each"))

    def block(b: Column) -> Column:
        return F.aggregate(F.slice(values, b * _BLOCK + 1, _BLOCK), empty, lambda acc, x: F.struct(step(acc["all"], x).alias("all"), F.array_append(acc["each"], acc["all"]).alias("each")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), block)
    carried = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, step(F.try_element_at(acc, F.lit(-1)), b["all"])))
    moved = F.zip_with(blocks, carried, lambda b, c: F.transform(b["each"], lambda x: step(x, c)))
    return F.flatten(F.filter(moved, lambda x: x.isNotNull()))


def _starts(gaps: Column, found: Column) -> Column:
    """Start of each match: what lies before it, and its own gap."""
    sizes = F.filter(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), lambda x: x.isNotNull())  # the last gap has no match
    return F.zip_with(_before(sizes, lambda a, b: a + b), F.slice(gaps, F.lit(1), F.size(found)), lambda at, g: at + F.length(g))


def _span(kind: str, gaps: Column, found: Column, starts: Column):
    def span(m: Column, i: Column) -> Column:
        earlier = F.when(i > 0, F.concat(F.right(F.get(gaps, i - 1), F.lit(CONTEXT_CHARS)), F.get(found, i - 1))).otherwise("")
        before = F.right(F.concat(earlier, F.get(gaps, i)), F.lit(CONTEXT_CHARS))
        score = F.lit(SCORES[kind]) + F.when(F.lower(before).rlike(CONTEXT[kind]), CONTEXT_ADDS).otherwise(0.0)
        start = F.get(starts, i)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), F.least(score, F.lit(1.0)).alias("score"), _valid(kind, m).alias("ok"))

    return span


SPAN = "struct<kind:string,start:int,end:int,score:double>"


def find(docs: DataFrame, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """docs with ``pii``: an array of (kind, start, end, score), by kind as listed, then by start.

    A column of docs named pii is replaced; other columns stay as they are.
    """
    kinds = (*BASE_KINDS, *ADDED_KINDS)
    own = F.coalesce(F.col(text), F.lit(""))
    name = {k: free_name(docs, f"__found_{k}", f"__gaps_{k}", f"__starts_{k}", f"__spans_{k}") for k in kinds}
    out = docs
    for k in kinds:
        out = out.withColumn(name[k][0], F.when(_may_hold(k, own), F.regexp_extract_all(own, F.lit(PATTERNS[k]), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for k in kinds:
        out = out.withColumn(name[k][1], F.when(F.exists(F.col(name[k][0]), _check(k)), F.split(own, PATTERNS[k], -1)))
    for k in kinds:
        found, gaps = F.col(name[k][0]), F.col(name[k][1])
        out = out.withColumn(name[k][2], F.when(gaps.isNotNull(), _starts(gaps, found)))
    for k in kinds:
        found, gaps, starts = (F.col(name[k][i]) for i in range(3))

        keep = (lambda s: s["ok"]) if k in BASE_KINDS else (lambda s: s["ok"] & (s["score"] >= keep_from))
        spans = F.transform(F.filter(F.transform(found, _span(k, gaps, found, starts)), keep), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
        out = out.withColumn(name[k][3], F.when(starts.isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(spans.cast(f"array<{SPAN}>")))
    pii = F.concat(*(F.col(name[k][3]) for k in kinds))
    return out.withColumn("pii", pii).drop(*(n for k in kinds for n in name[k]))


def redact(found: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """found with each span (or run of overlapping spans) in its text replaced by ``[KIND]`` of the first of them.

    The text is cut into chunks once, and what stays is put together from whole chunks and parts of their first and last.
    """
    ordered_name, chunks_name, before_name = free_name(found, "__ordered", "__chunks", "__before")
    some = F.size(spans) > 0
    out = found.withColumn(ordered_name, F.when(some, F.sort_array(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))))
    ordered, own = F.col(ordered_name), F.col(text)
    out = out.withColumn(before_name, F.when(some, _before(F.transform(ordered, lambda s: s["end"]), F.greatest)))
    out = out.withColumn(chunks_name, F.when(some, F.regexp_extract_all(own, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))))
    chunks = F.col(chunks_name)

    def part(a: Column, b: Column) -> Column:
        """Characters a (included) to b of the text."""
        first, last = F.floor(a / _CHUNK).cast("int"), F.floor(b / _CHUNK).cast("int")
        at = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
        within = at(first).substr(a % _CHUNK + 1, b - a)
        across = F.concat(at(first).substr(a % _CHUNK + 1, F.lit(_CHUNK)), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), at(last).substr(F.lit(1), b % _CHUNK))
        return F.when(b <= a, "").when(first == last, within).otherwise(across)

    heads = F.filter(F.zip_with(ordered, F.col(before_name), lambda s, m: F.struct(m.alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda h: h["start"] >= h["from"])
    parts = F.transform(heads, lambda h: F.concat(part(h["from"], h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
    rest = part(F.array_max(F.transform(ordered, lambda s: s["end"])), F.length(own))
    return out.withColumn(text, F.when(some, F.concat(F.array_join(parts, ""), rest)).otherwise(own)).drop(ordered_name, chunks_name, before_name)


def op7_pii(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"))
    of = lambda kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(of(BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"),
    )


