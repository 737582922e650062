"""Column helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("symbol",)
_ORDER: ContextVar[tuple[str, ...]] = ContextVar("order", default=("ts",))


@contextmanager
def time_order(*columns: str) -> Iterator[None]:
    """Windows that by_time makes meanwhile go by these columns, which must order rows as ts does; so they share the sort of windows that need them."""
    token = _ORDER.set(columns)
    try:
        yield
    finally:
        _ORDER.reset(token)


def by_time(*keys: str):
    """Rows of a symbol in the order of time."""
    return Window.partitionBy(*(keys or KEYS)).orderBy(*_ORDER.get())


def put(df: DataFrame, new: dict[str, Column], drop: Iterable[str] = ()) -> DataFrame:
    """df with the new columns and without the dropped ones, in one step: Spark analyses a plan anew at each, which takes longer than small tables do."""
    gone = {*new, *drop}
    return df.select(*(c for c in df.columns if c not in gone), *(v.alias(k) for k, v in new.items()))


def above(a: Column, b: Column) -> Column:
    """a > b beyond the noise of floating point; false where either is null."""
    return F.coalesce(a - b > 1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)), F.lit(False))


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def side(bull: Column) -> Column:
    return F.when(yes(bull), "Bullish").otherwise("Bearish")


def agrees(opinion: Column, direction: Column) -> Column:
    """No opinion agrees."""
    return F.coalesce(opinion == direction, F.lit(True))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def pct_change(now: Column, before: Column) -> Column:
    return (now - before) / F.nullif(before, F.lit(0.0)) * 100


def epoch(ts: Column) -> Column:
    """Seconds of an exchange-local time, read as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def cents(x: Column) -> Column:
    """x to two places; half cents go up whatever noise is below a millionth."""
    return F.round(F.round(x, 6), 2)
