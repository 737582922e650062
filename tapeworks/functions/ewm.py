"""Exponentially weighted means without recursion.

y(0) = x(0), y(t) = (1 - a) y(t-1) + a x(t).  Rows are taken in blocks so long that (1 - a)^block is still a normal
double; within a block the mean is a running sum of x / (1 - a)^k, and all that a block inherits is the last value of
the block before.  Everything is window functions over one partitioning by symbol, so a plan with many means has one
exchange.  Leading nulls are skipped; the result is null until ``least`` values have been seen.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.columns import KEYS, by_time, put


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)


#: A block's weights span so many e-folds at most, and what is older than so many leaves nothing.
SPAN, GONE = 600, 40


def shared_rows(alphas: list[float]) -> int | None:
    """Rows of a block that does for means of all these weights; None if none does."""
    decay = [-math.log1p(-a) for a in alphas if a < 1]
    rows = int(SPAN / max(decay)) if decay else None
    return rows if rows and rows * min(decay) >= GONE else None


def ewm_shared(df: DataFrame, specs: dict[str, tuple], rows: int) -> DataFrame:
    """As ewm by symbol, for df with ``__row`` (from 0, by time) and ``__b``, which is __row by blocks of shared_rows; nulls may only lead.

    Within time_order("__b", "ts") its windows need no sort but that of the blocks.
    """
    w = by_time()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*KEYS, "__b").orderBy("ts")
    k = F.col("__row") % rows
    df = df.withColumns({f"__n_{c}": F.count(c).over(w) - 1 for c in {spec[0] for spec in specs.values()}})
    slow = {name: (c, a, -math.log1p(-a)) for name, (c, a, *_) in specs.items() if a < 1}
    weight = lambda c, a: F.when(F.col(f"__n_{c}") == 0, 1.0).otherwise(a)
    df = df.withColumns({f"__p_{name}": F.sum(weight(c, a) * F.col(c) * F.exp(k * d)).over(inside) * F.exp(-k * d) for name, (c, a, d) in slow.items()})
    result = {}
    for name, (c, _, least, *_) in specs.items():
        value = F.col(c)
        if name in slow:
            p = F.col(f"__p_{name}")
            carried = F.last(F.when(k == rows - 1, p), ignorenulls=True).over(before)
            value = p + F.coalesce(carried, F.lit(0.0)) * F.exp(-(k + 1) * slow[name][2])
        result[name] = F.when((F.col(f"__n_{c}") + 1 >= least) & F.col(c).isNotNull(), value)
    return put(df, result, [*(f"__n_{spec[0]}" for spec in specs.values()), *(f"__p_{name}" for name in slow)])


def ewm(df: DataFrame, specs: dict[str, tuple], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df with a column for each spec: name -> (column, a, least[, counter]).

    counter: a column with nulls in the same rows, the column itself if left out.  Specs with one counter share their
    blocks, and so a window, where the shortest block still leaves nothing of what is two blocks back.
    """
    specs = {name: (*spec, spec[0])[:4] for name, spec in specs.items()}
    w = by_time(*keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    decay = {name: -math.log1p(-spec[1]) for name, spec in specs.items() if spec[1] < 1}
    size = {name: int(SPAN / q) for name, q in decay.items()}
    number = {name: f"__n_{spec[3]}" for name, spec in specs.items()}
    block = {name: f"__b_{name}" for name in decay}
    for counter in {spec[3] for spec in specs.values()}:
        own = [name for name in decay if specs[name][3] == counter]
        if own and min(size[x] for x in own) * min(decay[x] for x in own) >= GONE:
            shortest = min(size[x] for x in own)
            size |= {x: shortest for x in own}
            block |= {x: block[own[0]] for x in own}
    df = df.withColumns({f"__n_{spec[3]}": F.count(spec[3]).over(w) - 1 for spec in specs.values()})
    df = df.withColumns({block[name]: F.floor(F.col(number[name]) / size[name]) for name in decay})
    inside = {}
    for name, q in decay.items():
        c, a = specs[name][:2]
        n = F.col(number[name])
        k = n % size[name]
        total = F.sum(F.when(n == 0, 1.0).otherwise(a) * F.col(c) * F.exp(k * q)).over(Window.partitionBy(*keys, block[name]).orderBy("ts"))
        inside[f"__p_{name}"] = total * F.exp(-k * q)
    df = df.withColumns(inside)
    result = {}
    for name, (c, a, least, _) in specs.items():
        n, value = F.col(number[name]), F.col(c)
        if a < 1:
            k, p = n % size[name], F.col(f"__p_{name}")
            carried = F.last(F.when(k == size[name] - 1, p), ignorenulls=True).over(before)
            value = p + F.coalesce(carried, F.lit(0.0)) * F.exp(-(k + 1) * decay[name])
        result[name] = F.when((n + 1 >= least) & F.col(c).isNotNull(), value)
    return put(df, result, {*number.values(), *block.values(), *inside})
