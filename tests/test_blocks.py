"""Indicators by blocks of a history against pandas and against those over whole histories."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.functions import blocks
from tapeworks.functions.indicators import indicator_series
from tapeworks.params import Params

BAR = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


@pytest.fixture(scope="module")
def bars(spark):
    """One long history with a gap of months and a long run of one price, one too short, one that ends within a block."""
    rng, parts = np.random.default_rng(1), []
    for symbol, n in (("LONG", 3000), ("SHORT", 30), ("ODD", 517)):
        close = 100 + np.cumsum(rng.normal(size=n))
        if symbol == "LONG":
            close[800:1700] = close[800]
        noise = np.where(np.diff(close, prepend=0) == 0, 0.0, 1.0)
        ts = pd.date_range("2022-01-01", periods=n, freq="60min")
        ts = ts.where(np.arange(n) < n // 2, ts + pd.Timedelta("100D"))
        parts.append(pd.DataFrame({"symbol": symbol, "timeframe": "60minute", "ts": ts, "open": close + noise * rng.normal(size=n), "high": close + noise * (2 + rng.random(n)), "low": close - noise * (2 + rng.random(n)), "close": close, "volume": rng.integers(0, 1000, n)}))
    return spark.createDataFrame(pd.concat(parts), BAR).repartition(3).cache()


@pytest.mark.parametrize("a", [1 / 9, 0.5, 1.0, 1 / 2000])
def test_means_of_blocks_equal_pandas(bars, a):
    got = blocks.mean_of_blocks(bars, {"y": ("close", a, 5)}, "60minute", rows=128).orderBy("symbol", "ts").toPandas()
    pdf = bars.orderBy("symbol", "ts").toPandas()
    want = pdf.groupby("symbol").close.transform(lambda x: x.ewm(alpha=a, adjust=False, min_periods=5).mean())
    assert got.y.isna().tolist() == want.isna().tolist() and np.nanmax(np.abs(got.y - want)) < 1e-9
    assert got.columns.tolist() == [*pdf.columns, "y"]


def test_leading_nulls_over_several_blocks(bars):
    own = bars.where("symbol = 'LONG'").withColumn("close", F.when(F.col("ts") >= F.lit("2022-01-20").cast("timestamp_ntz"), F.col("close")))
    got = blocks.mean_of_blocks(own, {"y": ("close", 0.2, 9), "z": ("close", 0.001, 1)}, "60minute", rows=64).orderBy("ts").toPandas()
    close = own.orderBy("ts").toPandas().close
    for name, a, least in (("y", 0.2, 9), ("z", 0.001, 1)):
        want = close.dropna().ewm(alpha=a, adjust=False, min_periods=least).mean().reindex(close.index)
        assert got[name].isna().tolist() == want.isna().tolist() and np.nanmax(np.abs(got[name] - want)) < 1e-9


@pytest.mark.parametrize("p", [Params(), Params(timeframe="15minute", rsi_length=30, adx_length=40, bb_length=33)])
def test_indicators_of_blocks_equal_those_of_whole_histories(bars, p):
    got = blocks.indicator_series_blocks(bars, p, rows=150).orderBy("symbol", "ts").toPandas()
    want = indicator_series(bars, p).orderBy("symbol", "ts").toPandas()
    assert set(got.columns) == set(want.columns)
    for c in want.columns:
        a, b = got[c], want[c]
        assert a.isna().tolist() == b.isna().tolist(), c
        if b.dtype.kind == "f" and c not in ("rsi", "rsi_smooth", "adx"):
            assert np.nanmax(np.abs(a - b)) < 1e-9, c
        elif b.dtype.kind == "f":  # ratios of means that a run of one price makes as small as rounding
            assert np.nanmax(np.abs(a - b)) < 1e-6, c
        else:
            assert a[~a.isna()].tolist() == b[~b.isna()].tolist(), c


def test_one_history_has_more_tasks_than_symbols(spark, bars):
    own = bars.where("symbol = 'LONG'")
    numbers = blocks.split(blocks.numbered(own, 5), 100, 30)
    assert numbers.where("own").agg(F.countDistinct("n"), F.min("n"), F.max("n")).first() == (3000, 0, 2999)
    assert numbers.groupBy("symbol").count().agg(F.max("count"), F.count("*")).first() == (130, 30)
    tasks = numbers.repartition(8, "symbol").select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 4
    with pytest.raises(ValueError):
        blocks.indicator_series_blocks(bars, Params(), rows=20)


def test_no_bars(bars):
    assert blocks.indicator_series_blocks(bars.where("false"), Params(), rows=100).count() == 0
    assert blocks.mean_of_blocks(bars.where("false"), {"y": ("close", 0.5, 1)}, "day").count() == 0
