"""The registered queries: each operator on tables derived from the test tables, with its DuckDB equivalent."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tapeworks.functions import indicators as ind
from tapeworks.functions.blocks import indicator_series_blocks, mean_of_blocks
from tapeworks.functions.columns import agrees, yes
from tapeworks.functions.ewm import ewm, span_alpha
from tapeworks.functions.tables import own_folder
from tapeworks.operators import bars as B
from tapeworks.operators import enrich, journal, lookups, news, oi, replay, scalp, signal
from tapeworks.params import Params
from tapeworks.plans.oracle import BUCKETS, INDICES, query, side, ts
from tapeworks.sources import market as M
from tapeworks.sources import results, store
from tapeworks.streaming import jobs

P60, P15 = Params(timeframe="60minute"), Params(timeframe="15minute")
CROSSES = ("rsi_cross", "macd_cross", "ema_bb_cross")
TODAY = "2024-02-01"
LAST_DAY = "2024-01-29"
_Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def out(df: DataFrame, columns: str) -> DataFrame:
    """The columns, times as epoch seconds and doubles rounded to six places."""
    cols = []
    for c in columns.split():
        kind = df.schema[c].dataType
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            cols.append(F.unix_timestamp(F.col(c).cast("timestamp")).alias(c))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(c), 6).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def sql(columns: str, source: str, doubles: str = "", where: str = "") -> str:
    """The same of a common table expression: times among the columns are named ts or end in _time, anchor or bucket."""
    r = set(doubles.split())
    parts = [ts(c) if c == "ts" or c.endswith("_time") or c in ("anchor", "bucket") else f"round({c}, 6) AS {c}" if c in r else c for c in columns.split()]
    return query(f"SELECT {', '.join(parts)} FROM {source}{' WHERE ' + where if where else ''}")


def register(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None) -> None:
    _Q[name] = (run, oracle)


def bars(s: SparkSession, d: str, tf: str) -> DataFrame:
    return B.ticks_to_bars(M.ticks(s, d), tf)


def long_bars(s: SparkSession, d: str) -> DataFrame:
    return B.ticks_to_bars(M.order_ticks(s, d, hours=True), "60minute")


def series(s: SparkSession, d: str, tf: str = "60minute") -> DataFrame:
    return ind.indicator_series(bars(s, d, tf), P60 if tf == "60minute" else P15)


def index3(s: SparkSession, d: str) -> DataFrame:
    return B.index_bars(M.ticks(s, d), "3minute", F.lit("IDX"))


BAR, BAR_D = "symbol timeframe ts open high low close volume", "open high low close"

# scans and resampling
register("ticks_to_bars", lambda s, d: out(bars(s, d, "60minute"), BAR), sql(BAR, "bars60", BAR_D))
register("resample_15m", lambda s, d: out(B.resample(index3(s, d), "15minute"), BAR), sql(BAR, "bars15m3", BAR_D))
register("resample_4h", lambda s, d: out(B.resample(bars(s, d, "60minute"), "4hour"), BAR), sql(BAR, "bars4h", BAR_D))
register("resample_day", lambda s, d: out(B.resample(long_bars(s, d), "day"), BAR), sql(BAR, "hday", BAR_D))
register("htf_bars", lambda s, d: out(B.resample(bars(s, d, "15minute"), B.HIGHER["15minute"]), BAR), sql(BAR, "bars4h15", BAR_D))
register(
    "resample_week",
    lambda s, d: out(B.resample(B.ticks_to_bars(M.order_ticks(s, d), "day"), "week"), BAR),
    query(f"SELECT symbol, 'week' AS timeframe, {ts('b')[:-5]} AS ts, open, high, low, close, volume FROM (SELECT symbol, {BUCKETS['week']} AS b, round(first(open ORDER BY ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY ts), 6) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM obars GROUP BY 1, 2)"),
)
register(
    "dedupe_candles",
    lambda s, d: out(B.dedupe_bars(bars(s, d, "60minute").withColumn("arrival", F.lit(0)).unionByName(bars(s, d, "60minute").where("volume % 3 = 0").withColumns({"close": F.col("close") + 1, "arrival": F.lit(1)}))), BAR),
    query(f"SELECT symbol, timeframe, {ts()}, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close + CASE WHEN volume % 3 = 0 THEN 1 ELSE 0 END, 6) AS close, volume FROM bars60"),
)


# the store of bars and ticks
def _folder(s: SparkSession) -> str:
    return own_folder(s, "stream")


def stored(s: SparkSession, d: str, tf: str) -> str:
    folder = f"{_folder(s)}/bars"
    store.write_bars(bars(s, d, tf), folder)
    return folder


ASOF = dt.datetime(2024, 1, 25, 12)
register("candle_scan", lambda s, d: out(store.scan_store(s, stored(s, d, "15minute"), M.watchlist(s, d), ASOF, "15minute"), BAR), sql(BAR, "bars15", BAR_D, "ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-25 12:00:00' AND symbol IN (SELECT symbol FROM watchlist)"))
register("chunked_union", lambda s, d: out(store.history(s, stored(s, d, "60minute"), "60minute", days=7), BAR), sql(BAR, "bars60", BAR_D))


def fed(s: SparkSession, df: DataFrame, part: Column, n: int, start: Callable[[DataFrame, str], list[StreamingQuery]], read: Callable[[str], DataFrame] | None = None) -> str:
    """Writes the rows of df part by part to a folder and runs the stream over what has come each time, from its checkpoint; returns its folder."""
    folder = _folder(s)
    rows = df.withColumn("__part", part)
    for i in range(n):
        rows.where(F.col("__part") == i).drop("__part").write.mode("append").parquet(f"{folder}/in")
        for q in start((read or s.readStream.schema(df.schema).parquet)(f"{folder}/in"), folder):
            q.awaitTermination()
    return folder


def late_bars(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars of a store that gets the ticks of every fiftieth event after all others, a month late."""
    t = M.ticks(s, d).drop("sgn")
    run = lambda ticks, f: [store.ingest(ticks, f"{f}/ticks", f"{f}/bars", ("60minute", "15minute"), f"{f}/state")]
    return store.read_bars(s, f"{fed(s, t, (F.col('event_id') % 50 == 7).cast('int'), 2, run)}/bars", "60minute")


register("late_data", lambda s, d: out(late_bars(s, d), BAR), sql(BAR, "bars60", BAR_D))
register("equity_instruments", lambda s, d: lookups.equity_instruments(M.instruments(s, d)), query("SELECT tradingsymbol AS symbol, instrument_token FROM instruments WHERE segment = 'NSE'"))
register("futures_universe", lambda s, d: lookups.futures_universe(M.instruments(s, d), lookups.index_names(M.instruments(s, d))), query(f"SELECT DISTINCT name FROM instruments WHERE instrument_type = 'FUT' AND upper(name) NOT IN ({INDICES})"))
register("near_month_contract", lambda s, d: lookups.near_month_contract(M.instruments(s, d), F.lit(TODAY).cast("date")).select("name", "tradingsymbol", "instrument_token"), query("SELECT name, tradingsymbol, instrument_token FROM near"))
register("index_future_contract", lambda s, d: lookups.index_future_contract(M.instruments(s, d), F.lit(TODAY).cast("date"), "NIFTY").select("name", "tradingsymbol", "instrument_token"), query("SELECT name, tradingsymbol, instrument_token FROM near_all WHERE upper(name) = 'NIFTY'"))
register(
    "index_lookup",
    lambda s, d: lookups.index_lookup(M.instruments(s, d), M.instruments(s, d).where("upper(trim(name)) = 'NIFTY'").select("exchange", "tradingsymbol").distinct()).select("exchange", "tradingsymbol", "instrument_token"),
    query("SELECT exchange, tradingsymbol, instrument_token FROM instruments WHERE upper(name) = 'NIFTY'"),
)
_QUOTES = (
    "SELECT q.symbol, q.oi, q.oi_day_high, q.oi_day_low FROM (SELECT symbol, last(oi ORDER BY ts) AS oi, max(oi) AS oi_day_high, min(oi) AS oi_day_low FROM "
    "(SELECT *, CAST(ts AS DATE) AS day, max(CAST(ts AS DATE)) OVER (PARTITION BY symbol) AS last_day FROM oi_samples WHERE oi IS NOT NULL) WHERE day = last_day GROUP BY symbol) q JOIN near ON q.symbol = near.name JOIN watchlist w ON w.symbol = q.symbol"
)


def snapshot(s: SparkSession, d: str) -> DataFrame:
    near = lookups.near_month_contract(M.instruments(s, d), F.lit(TODAY).cast("date"))
    return lookups.oi_snapshot(M.watchlist(s, d), near, lookups.oi_quotes(M.oi_samples(s, d), near))


register("oi_snapshot", snapshot, query(_QUOTES))
register("join_oi", lambda s, d: lookups.join_oi(M.watchlist(s, d), snapshot(s, d)).select("symbol", "pos", "oi", "oi_day_high", "oi_day_low"), query(f"SELECT w.symbol, w.pos, x.oi, x.oi_day_high, x.oi_day_low FROM watchlist w LEFT JOIN ({_QUOTES}) x ON w.symbol = x.symbol"))
register(
    "join_instruments",
    lambda s, d: lookups.join_instruments(M.watchlist(s, d), lookups.equity_instruments(M.instruments(s, d))).select("symbol", "instrument_token", "error"),
    query("SELECT w.symbol, i.instrument_token, CASE WHEN i.instrument_token IS NULL THEN 'symbol not found' END AS error FROM watchlist w LEFT JOIN instruments i ON i.tradingsymbol = w.symbol AND i.segment = 'NSE'"),
)

# indicators
for _name, _cols, _doubles in (
    ("rsi", "rsi", "rsi"), ("rsi_smooth", "rsi_smooth", "rsi_smooth"), ("macd", "macd macd_signal", "macd macd_signal"), ("ema", "ema", "ema"), ("bollinger", "bb_mid bb_upper bb_lower", "bb_mid bb_upper bb_lower"),
    ("volume_average", "vol_avg", "vol_avg"), ("relative_volume", "rel_volume", "rel_volume"), ("true_range", "tr", "tr"), ("atr", "atr", "atr"), ("adx", "adx", "adx"), ("cmf", "cmf", "cmf"),
    ("crossovers", "rsi_up rsi_dn macd_up macd_dn ema_up ema_dn", ""), ("session_vwap", "vwap", "vwap"), ("align_count", "align", ""), ("trend_anchor", "anchor", ""), ("anchored_vwap", "avwap", "avwap"),
    ("candle_pattern", "candle_pattern candle_direction", ""),
    ("indicator_series", "close rsi rsi_smooth macd macd_signal ema bb_mid atr adx cmf vwap avwap align candle_direction", "rsi rsi_smooth macd macd_signal ema bb_mid atr adx cmf vwap avwap"),
):
    register(_name, lambda s, d, c=_cols: out(series(s, d), f"symbol ts {c}"), sql(f"symbol ts {_cols}", "h_ind", _doubles))
register("ewm", lambda s, d: out(ewm(bars(s, d, "60minute"), {"y": ("close", span_alpha(9), 1)}), "symbol ts y"), query(f"SELECT symbol, {ts()}, round(ema, 6) AS y FROM h_ind"))
#: So short that each symbol has several blocks; users keep the default.
SHORT_BLOCKS = 200
register("ewm_blocks", lambda s, d: out(mean_of_blocks(bars(s, d, "60minute"), {"y": ("close", span_alpha(9), 1)}, "60minute", SHORT_BLOCKS), "symbol ts y"), query(f"SELECT symbol, {ts()}, round(ema, 6) AS y FROM h_ind"))
_SERIES = "close rsi rsi_smooth macd macd_signal ema bb_mid atr adx cmf vwap avwap"
register("indicator_series_blocks", lambda s, d: out(indicator_series_blocks(bars(s, d, "60minute"), P60, SHORT_BLOCKS), f"symbol ts {_SERIES} align candle_direction anchor"), sql(f"symbol ts {_SERIES} align candle_direction anchor", "h_ind", _SERIES))
register("macd_params", lambda s, d: out(series(s, d, "15minute"), "symbol ts macd macd_signal"), sql("symbol ts macd macd_signal", "q_ind", "macd macd_signal"))
register("regime", lambda s, d: series(s, d).groupBy("symbol", ind.regime(F.col("adx")).alias("regime")).agg(F.count("*").alias("n")), query("SELECT symbol, CASE WHEN adx >= 25 THEN 'Trending' WHEN adx <= 18 THEN 'Ranging' WHEN adx IS NOT NULL THEN 'Transitional' END AS regime, count(*) AS n FROM h_ind GROUP BY 1, 2"))
register("price_change", lambda s, d: out(ind.price_change(bars(s, d, "60minute")), "symbol ts price_change"), query(f"SELECT symbol, {ts()}, round((close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100, 2) AS price_change FROM bars60 WINDOW w AS (PARTITION BY symbol ORDER BY ts)"))

# the latest bar's signal
SIG = "symbol ts close direction aligned fresh_signal vol_confirmed signal_confirmed"
SIG_ALL = " ".join(c for c in signal.SIGNAL if c not in ("in_opening_window",))
SIG_D = "close rsi vwap avwap vol_multiple cmf adx vol_threshold atr stop target risk_reward position_risk"


def signals(s: SparkSession, d: str) -> DataFrame:
    return signal.screener(long_bars(s, d), M.watchlist(s, d), P60)


register("latest_bar", lambda s, d: out(signal.latest_bar(bars(s, d, "60minute")), BAR), sql(BAR, "(SELECT * FROM bars60 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)", BAR_D))
register("screener", lambda s, d: out(signals(s, d), f"error {SIG_ALL}"), query(f"SELECT CASE WHEN l.symbol IS NULL THEN 'symbol not found' WHEN l.short THEN 'not enough candles' END AS error, {', '.join(('epoch(x.' + c + ')::BIGINT AS ' + c) if c in ('ts', 'anchor') else ('round(x.' + c + ', 6) AS ' + c) if c in SIG_D.split() else ('w.symbol' if c == 'symbol' else 'x.' + c) for c in SIG_ALL.split())} FROM watchlist w LEFT JOIN l_last l ON w.symbol = l.symbol LEFT JOIN sig x ON w.symbol = x.symbol"))
for _name, _cols in (
    ("fresh_signal", "fresh_signal"), ("direction", "direction aligned"), ("vs_vwap", "vs_vwap vs_avwap anchor"), ("breakout_state", "breakout_state"), ("vol_confirmed", "vol_multiple vol_threshold vol_confirmed"), ("volume_flow", "flow_direction flow_agrees"),
    ("candle_agreement", "candle_direction candle_agrees"), ("htf_agreement", "htf_direction htf_agrees"), ("signal_confirmed", "signal_confirmed"), ("atr_stop_target", "atr stop target risk_reward"), ("position_size", "position_qty position_risk"),
):
    register(_name, lambda s, d, c=_cols: out(signals(s, d).where("error is null"), f"symbol {c}"), sql(f"symbol {_cols}", "sig", SIG_D))
register("htf_direction_live", lambda s, d: signal.higher_direction(long_bars(s, d), "60minute", P60), query("SELECT symbol, htf_direction FROM d_last"))
register("htf_direction_live_15m", lambda s, d: signal.higher_direction(bars(s, d, "15minute"), "15minute", P15), query("SELECT symbol, " + side("CAST(rs AS INTEGER) + CAST(ms AS INTEGER) + CAST(es AS INTEGER) >= 2") + " AS htf_direction FROM f_ind WHERE NOT short QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"))
register("opening_window", lambda s, d: bars(s, d, "15minute").groupBy("symbol", signal.opening_window(F.col("ts"), F.col("timeframe")).alias("on")).agg(F.count("*").alias("n")), query('SELECT symbol, hour(ts) = 9 AND minute(ts) BETWEEN 15 AND 29 AS "on", count(*) AS n FROM bars15 GROUP BY 1, 2'))
register(
    "four_hour_warmup",
    lambda s, d: bars(s, d, "15minute").groupBy("symbol", signal.four_hour_warmup(F.col("ts"), F.lit("4hour")).alias("on")).agg(F.count("*").alias("n")),
    query('SELECT symbol, (hour(ts) * 60 + minute(ts)) BETWEEN 555 AND 584 OR (hour(ts) * 60 + minute(ts)) BETWEEN 795 AND 824 AS "on", count(*) AS n FROM bars15 GROUP BY 1, 2'),
)

# replay
T_COLS = "symbol signal_time entry_time direction entry_price r5 r10 r20 mae vol_confirmed"


def long_trades(t: DataFrame) -> DataFrame:
    return out(t.withColumns({f"r{h}": F.try_element_at("returns", F.lit(h)) for h in (5, 10, 20)}), T_COLS)


def trades_sql(p: str, tail: str = "") -> str:
    return query(f"SELECT symbol, epoch(ts)::BIGINT AS signal_time, {ts('entry_time')}, direction, round(ep, 2) AS entry_price, r5, r10, r20, mae, vol_confirmed FROM {p}trades {tail}")


def cross_trades(s: SparkSession, d: str) -> DataFrame:
    return replay.backtest(bars(s, d, "60minute"), "60minute", CROSSES, 1, P60)


def gated(s: SparkSession, d: str) -> DataFrame:
    return replay.backtest(bars(s, d, "15minute"), "15minute", CROSSES, 1, P15, gates=("htf", "opening", "flow", "candle"))


register("trades", lambda s, d: long_trades(cross_trades(s, d)), trades_sql("t_"))
register("backtest", lambda s, d: long_trades(replay.backtest(bars(s, d, "60minute"), "60minute", replay.PARAMETERS, 3, P60)), trades_sql("a_"))
register("gates", lambda s, d: long_trades(gated(s, d)), trades_sql("g_"))
register("recent_trades", lambda s, d: long_trades(replay.recent_trades(cross_trades(s, d))), trades_sql("t_", "ORDER BY t_trades.entry_time DESC, symbol LIMIT 500"))
register("asof_htf", lambda s, d: out(replay.asof_htf(bars(s, d, "15minute"), "15minute", P15), "symbol ts htf_direction"), sql("symbol ts htf_direction", "q_htf"))


def voted(s: SparkSession, d: str) -> DataFrame:
    return replay.nofm_signal(series(s, d).where("error is null"), replay.PARAMETERS, 3, P60, "60minute")


register("param_votes", lambda s, d: out(voted(s, d), "symbol ts bull bear"), sql("symbol ts bull bear", "a_vote"))
register("nofm_signal", lambda s, d: out(voted(s, d), "symbol ts direction has_signal"), sql("symbol ts direction has_signal", "a_sig"))
register("entries", lambda s, d: out(replay.entries(voted(s, d)).where("entry"), "symbol ts direction"), sql("symbol ts direction", "a_edge", "", "entry"))
register("forward_returns", lambda s, d: out(replay.forward_returns(replay.entries(voted(s, d))).withColumns({f"r{h}": F.try_element_at("returns", F.lit(h)) for h in replay.HORIZONS}), "symbol ts r5 r10 r20"), sql("symbol ts r5 r10 r20", "a_ret"))
register("mae", lambda s, d: out(replay.forward_returns(replay.entries(voted(s, d))), "symbol ts mae"), sql("symbol ts mae", "a_ret"))
register("regime_volume_hot", lambda s, d: series(s, d).where("error is null").groupBy("symbol", replay.volume_hot(P60, True).alias("hot")).agg(F.count("*").alias("n")), query("SELECT symbol, coalesce(rel_volume > 1.2 * CASE WHEN adx <= 18 THEN 1.3 ELSE 1.0 END, false) AS hot, count(*) AS n FROM h_ind WHERE NOT short GROUP BY 1, 2"))
_STATS = "count(*) AS trades, round(avg(CAST(r > 0 AS INTEGER)) * 100, 1) AS win_rate, round(avg(r), 3) AS avg_return, max(r) AS best, min(r) AS worst"
_GRP = "coalesce(lower(direction), CASE WHEN vol_confirmed THEN 'vol_confirmed' WHEN NOT vol_confirmed THEN 'vol_not_confirmed' END, 'all') AS grp"
register("backtest_summary", lambda s, d: replay.horizon_stats(cross_trades(s, d)), query(f"SELECT {_GRP}, CAST(horizon AS INTEGER) AS horizon, trades, win_rate, avg_return, best, worst FROM (SELECT horizon, direction, vol_confirmed, {_STATS} FROM t_long GROUP BY GROUPING SETS ((horizon), (horizon, direction), (horizon, vol_confirmed)))"))
register("horizon_stats", lambda s, d: replay.horizon_stats(cross_trades(s, d)).where("grp = 'all'").drop("grp"), query(f"SELECT CAST(horizon AS INTEGER) AS horizon, {_STATS} FROM t_long GROUP BY horizon"))
register("drawdown_stats", lambda s, d: replay.drawdown_stats(cross_trades(s, d)), query(f"SELECT {_GRP}, total, avg_mae, worst_mae FROM (SELECT direction, vol_confirmed, count(*) AS total, round(avg(mae), 3) AS avg_mae, min(mae) AS worst_mae FROM t_trades GROUP BY GROUPING SETS ((), (direction), (vol_confirmed)))"))
register("backtest_coverage", lambda s, d: replay.coverage(M.watchlist(s, d), bars(s, d, "60minute"), cross_trades(s, d)), query("SELECT w.symbol, (SELECT count(*) FROM t_trades t WHERE t.symbol = w.symbol) AS n_trades, CASE WHEN n IS NULL THEN 'no data' WHEN n < 37 THEN 'not enough candles' END AS skipped FROM watchlist w LEFT JOIN (SELECT symbol, count(*) AS n FROM bars60 GROUP BY 1) b ON w.symbol = b.symbol"))


def rates(s: SparkSession, d: str) -> DataFrame:
    return replay.param_win_rates(bars(s, d, "60minute"), "60minute", P60)


def weights(s: SparkSession, d: str) -> DataFrame:
    return replay.param_weights(rates(s, d), s.createDataFrame([(n,) for n in enrich.WEIGHT_OF], "param string"))


register("param_win_rates", rates, query("SELECT * FROM rates"))
register("param_weights", weights, query("SELECT * FROM weights"))

# open interest
OI = M.oi_samples
register("oi_samples", lambda s, d: out(OI(s, d), "symbol ts oi close"), sql("symbol ts oi close", "oi_samples", "oi close"))
register("asof_oi_lookback", lambda s, d: out(oi.asof_lookback(OI(s, d)), "symbol ts oi_15 oi_30 oi_60 oi_120"), sql("symbol ts oi_15 oi_30 oi_60 oi_120", "oi_look", "oi_15 oi_30 oi_60 oi_120"))
register("oi_acceleration", lambda s, d: out(oi.acceleration(OI(s, d)), "symbol ts chg_15 chg_30 chg_60 prior_30 prior_60 accel"), sql("symbol ts chg_15 chg_30 chg_60 prior_30 prior_60 accel", "oi_accel", "chg_15 chg_30 chg_60 prior_30 prior_60 accel"))
register("oi_accel_label", lambda s, d: oi.acceleration(OI(s, d)).groupBy("symbol", "trend_label").agg(F.count("*").alias("n")), query("SELECT symbol, coalesce(accel_label, 'New') AS trend_label, count(*) AS n FROM oi_accel GROUP BY 1, 2"))
register("oi_day_baseline", lambda s, d: out(oi.day_baseline(OI(s, d)).withColumn("day", F.col("day").cast("string")), "symbol day base_oi base_close prev_oi"), query("SELECT symbol, CAST(day AS VARCHAR) AS day, base_oi, base_close, prev_oi FROM oi_base"))
register("pct_change", lambda s, d: out(oi.oi_state(OI(s, d)), "symbol ts price_chg_today oi_chg_today oi_day_chg"), sql("symbol ts price_chg_today oi_chg_today oi_day_chg", "oi_today", "price_chg_today oi_chg_today oi_day_chg"))
register("oi_structure", lambda s, d: out(oi.oi_state(OI(s, d)), "symbol ts structure"), sql("symbol ts structure", "oi_struct"))
register("oi_stage", lambda s, d: out(oi.oi_state(OI(s, d)), "symbol ts stage"), sql("symbol ts stage", "oi_state"))
register("oi_break_signal", lambda s, d: out(oi.oi_state(OI(s, d)).where("break_signal is not null"), "symbol ts break_signal"), sql("symbol ts break_signal", "oi_state", "", "break_signal IS NOT NULL"))
register("oi_accel_events", lambda s, d: out(oi.oi_state(OI(s, d)).where("accel_event"), "symbol ts accel_label"), sql("symbol ts accel_label", "oi_state", "", "accel_event"))


# the scan's context
def index_dir(s: SparkSession, d: str) -> DataFrame:
    return enrich.index_direction(B.index_bars(M.ticks(s, d), "60minute", F.lit("IDX")), P60)


def sector_dirs(s: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    m = M.regions(s, d)
    t = M.ticks(s, d).join(F.broadcast(m), "symbol")
    return enrich.sector_directions(B.index_bars(t, "60minute", F.col("sector")), rows, m, P60)


def rows_of(s: SparkSession, d: str) -> DataFrame:
    return signals(s, d).where("error is null")


def scan(s: SparkSession, d: str) -> DataFrame:
    rows = rows_of(s, d)
    setups = journal.setup_confidence(paper_resolved(s, d))
    return enrich.enrich(rows, P60, index_dir(s, d), M.regions(s, d), sector_dirs(s, d, rows), weights(s, d), setups, oi.oi_state(OI(s, d)))


def paper(s: SparkSession, d: str) -> DataFrame:
    """A paper trade for each replay trade, ten bars long."""
    v = replay.nofm_signal(replay.asof_htf(series(s, d).where("error is null"), "60minute", P60), CROSSES, 1, P60, "60minute")
    t = replay.forward_returns(replay.entries(v)).where("entry and entry_price is not null and size(returns) > 0")
    bull, none = F.col("direction") == "Bullish", F.lit(None).cast("boolean")
    t = t.withColumn("aligned", (F.when(bull, F.col("align")).otherwise(3 - F.col("align")) + replay.volume_hot(P60).cast("int")).cast("int"))
    t = t.withColumn("flow_agrees", agrees(F.when(F.col("cmf") > 0, "Bullish").when(F.col("cmf") < 0, "Bearish"), F.col("direction")))
    t = t.withColumns({"candle_agrees": agrees(F.col("candle_direction"), F.col("direction")), "htf_agrees": agrees(F.col("htf_direction"), F.col("direction"))})
    t = t.withColumns({"signal_confirmed": yes((F.col("aligned") >= 2) & F.col("htf_agrees")), "sector_agrees": none, "breadth_agrees": none})
    return journal.log_trades(t, "60minute", 10, 0.03, 0.01).withColumn("logged_at", F.col("signal_time") + F.make_dt_interval(hours=F.lit(1)))


def paper_resolved(s: SparkSession, d: str) -> DataFrame:
    return journal.forward_resolve(paper(s, d), bars(s, d, "60minute"))


_BULL = "CASE WHEN direction = 'Bullish' THEN bullish_pct ELSE bearish_pct END"
register("index_filter", lambda s, d: enrich.index_filter(rows_of(s, d), index_dir(s, d), P60).select("symbol", "index_direction", "index_agrees"), query("SELECT symbol, index_direction, coalesce(index_direction = direction, true) AS index_agrees FROM sig JOIN idx_dir ON true"))
register("join_index_direction", lambda s, d: index_dir(s, d), query("SELECT * FROM idx_dir"))
register("sector_filter", lambda s, d: enrich.sector_filter(rows_of(s, d), M.regions(s, d), sector_dirs(s, d, rows_of(s, d)), P60).select("symbol", "sector", "sector_direction", "sector_agrees"), query("SELECT g.symbol, m.sector, sector_direction, coalesce(sector_direction = direction, true) AS sector_agrees FROM sig g LEFT JOIN sector_map m ON m.symbol = g.symbol LEFT JOIN sec_dir x ON x.sector = m.sector"))
register("join_sector", lambda s, d: sector_dirs(s, d, rows_of(s, d)), query("SELECT * FROM sec_dir"))
register("breadth", lambda s, d: enrich.breadth(signals(s, d)), query("SELECT * FROM breadth"))
register("breadth_filter", lambda s, d: enrich.breadth_filter(rows_of(s, d), enrich.breadth(rows_of(s, d)), P60).select("symbol", "breadth_agrees"), query(f"SELECT symbol, coalesce({_BULL} >= 30, true) AS breadth_agrees FROM sig JOIN breadth ON true"))
register("param_tier", lambda s, d: enrich.param_tier(rows_of(s, d)).select("symbol", "param_tier"), query("SELECT symbol, aligned AS param_tier FROM sig"))
register("volume_flow_filter", lambda s, d: enrich.volume_flow_filter(rows_of(s, d), Params(require_flow=True)).select("symbol", "signal_confirmed"), query("SELECT symbol, signal_confirmed AND flow_agrees AS signal_confirmed FROM sig"))
register("candle_filter", lambda s, d: enrich.candle_filter(rows_of(s, d), Params(require_candle=True)).select("symbol", "signal_confirmed"), query("SELECT symbol, signal_confirmed AND candle_agrees AS signal_confirmed FROM sig"))
_SCORE = "round((CASE WHEN rsi_state = direction THEN w1 ELSE 0 END + CASE WHEN macd_state = direction THEN w2 ELSE 0 END + CASE WHEN ema_bb_state = direction THEN w3 ELSE 0 END + CASE WHEN vol_confirmed THEN w4 ELSE 0 END) * 100, 1)"
register("weighted_score", lambda s, d: enrich.weighted_score(rows_of(s, d), weights(s, d)).select("symbol", "weighted_score"), query(f"SELECT symbol, {_SCORE} AS weighted_score FROM sig JOIN wide ON true"))
register("market_hours", lambda s, d: bars(s, d, "15minute").groupBy("symbol", enrich.market_hours(F.col("ts")).alias("open_now")).agg(F.count("*").alias("n")), query("SELECT symbol, isodow(ts) <= 5 AND CAST(ts AS TIME) BETWEEN TIME '09:15:00' AND TIME '15:30:00' AS open_now, count(*) AS n FROM bars15 GROUP BY 1, 2"))
_POS = "aligned >= 2 AND coalesce(structure = CASE WHEN direction = 'Bullish' THEN 'Long Buildup' ELSE 'Short Buildup' END, false)"
_CONV = f"coalesce(({_POS}) AND aligned = 4 AND break_signal = CASE WHEN direction = 'Bullish' THEN 'Break Up' ELSE 'Break Down' END AND vol_multiple >= 1.5 AND vs_vwap = CASE WHEN direction = 'Bullish' THEN 'Above' ELSE 'Below' END, false)"
_SCAN = "FROM sig g LEFT JOIN oi_last o ON o.symbol = g.symbol JOIN idx_dir ON true"
register("positional_qualified", lambda s, d: scan(s, d).select("symbol", "positional_qualified"), query(f"SELECT g.symbol, {_POS} AS positional_qualified {_SCAN}"))
register("high_conviction", lambda s, d: scan(s, d).select("symbol", "high_conviction"), query(f"SELECT g.symbol, {_CONV} AS high_conviction {_SCAN}"))
register("oi_move_max", lambda s, d: out(enrich.oi_move_max(scan(s, d)), "symbol oi_move_max"), query(f"SELECT g.symbol, round(greatest(abs(chg_15), abs(chg_30), abs(chg_60), abs(oi_chg_today)), 6) AS oi_move_max {_SCAN}"))
register("oi_screener", lambda s, d: out(enrich.oi_screener(scan(s, d)), "symbol param_tier structure trend_label oi_chg_today"), query(f"SELECT g.symbol, aligned AS param_tier, structure, coalesce(accel_label, 'New') AS trend_label, round(oi_chg_today, 6) AS oi_chg_today {_SCAN}"))
register("oi_screener_filter", lambda s, d: enrich.oi_screener_filter(scan(s, d), "s", has_move=True, least_move=0.1).select("symbol", "structure"), query(f"SELECT g.symbol, structure {_SCAN} WHERE greatest(abs(chg_15), abs(chg_30), abs(chg_60), abs(oi_chg_today)) >= 0.1"))
register("screener_sort", lambda s, d: out(enrich.screener_sort(scan(s, d)), "symbol oi_day_chg"), query(f"SELECT g.symbol, round(oi_day_chg, 6) AS oi_day_chg {_SCAN} ORDER BY oi_day_chg DESC NULLS LAST, g.symbol"))
register("screener_tiles", lambda s, d: enrich.screener_tiles(scan(s, d)), query(f"SELECT count(*) FILTER (structure = 'Long Buildup') AS long_buildup, count(*) FILTER (structure = 'Short Buildup') AS short_buildup, count(*) FILTER (structure = 'Short Covering') AS short_covering, count(*) FILTER (structure = 'Long Unwinding') AS long_unwinding, count(*) FILTER ({_CONV}) AS high_conviction, count(*) AS symbols {_SCAN}"))
_HEAD = "CASE WHEN fresh_signal = 'Bullish' THEN '\U0001f53a' ELSE '\U0001f53b' END || ' ' || symbol || ' - ' || fresh_signal || ' confluence on 60minute (confirmed: ' || coalesce('Vol ' || vol_multiple || 'x', 'Vol confirmed') || CASE WHEN htf_direction IS NOT NULL THEN ', higher-timeframe trend agrees' ELSE '' END || ')'"
_VALUES = "'Close: ' || close || ' | RSI ' || coalesce(CAST(rsi AS VARCHAR), 'nan') || ' (' || rsi_state || ') | MACD ' || macd_params || ' (' || macd_state || ') | EMA/BB (' || ema_bb_state || ') | Aligned ' || aligned || '/4'"
register("alert_text", lambda s, d: enrich.alert_text(rows_of(s, d), "60minute").select("symbol", "alert"), query(f"SELECT symbol, {_HEAD} || chr(10) || {_VALUES} AS alert FROM sig"))


def oi_alerts(s: SparkSession, d: str) -> DataFrame:
    events = oi.oi_state(OI(s, d)).where("accel_event").join(rows_of(s, d).select("symbol", "direction"), "symbol", "left")
    return out(enrich.oi_alert_text(events, "60minute"), "symbol ts alert")


register("oi_alert_text", oi_alerts, query(
    f"SELECT o.symbol, {ts('o.ts')}, '\U0001f4c8 ' || o.symbol || ' OI just started ' || accel_label || coalesce(' - ' || break_signal, '') || coalesce(printf(', %+.1f%% today', round(round(oi_chg_today, 6), 1)), '') || coalesce(printf(' - accel %+.2fpp (30m)', round(round(accel, 6), 2)), '') || coalesce(' (' || direction || ' confluence)', '') || ' on 60minute' AS alert "
    "FROM oi_state o LEFT JOIN sig g ON g.symbol = o.symbol WHERE accel_event"))  # fmt: skip
_OI = f"LEFT JOIN ({_QUOTES}) q ON q.symbol = g.symbol"
_LINE = "'- ' || g.symbol || ': close=' || close || ', RSI=' || coalesce(CAST(rsi AS VARCHAR), 'nan') || ' (' || rsi_state || '), MACD ' || macd_params || ' (' || macd_state || '), EMA9-vs-BBmid (' || ema_bb_state || '), aligned=' || aligned || '/4, fresh_signal=' || coalesce(fresh_signal, 'none') || coalesce(', OI=' || CAST(q.oi AS BIGINT) || ' (day range ' || CAST(q.oi_day_low AS BIGINT) || '-' || CAST(q.oi_day_high AS BIGINT) || ')', '')"
register("scan_digest", lambda s, d: enrich.scan_digest(lookups.join_oi(signals(s, d), snapshot(s, d))), query(f"SELECT string_agg({_LINE}, chr(10) ORDER BY w.pos) AS digest FROM sig g JOIN watchlist w ON w.symbol = g.symbol {_OI}"))

# the journal
_JSTATS = "count(*) AS trades, round(avg(CAST(return_pct > 0 AS INTEGER)) * 100, 1) AS win_rate, round(avg(return_pct), 3) AS avg_return"
_FACTOR_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS factor, coalesce({c}, false) AS value, return_pct FROM res WHERE return_pct IS NOT NULL" for n, c in (("signal_confirmed", "aligned >= 2 AND coalesce(htf_direction = direction, true)"), ("candle_agrees", "candle_agrees"), ("flow_agrees", "flow_agrees"), ("htf_agrees", "coalesce(htf_direction = direction, true)")))
_SETUP = f"SELECT direction, aligned, {_JSTATS} FROM res WHERE return_pct IS NOT NULL AND aligned BETWEEN 2 AND 4 GROUP BY 1, 2"
register("forward_resolve", lambda s, d: out(paper_resolved(s, d), "id entry_price exit_price return_pct mae win status"), query("SELECT id, entry_price, exit_price, return_pct, mae, return_pct > 0 AS win, CASE WHEN return_pct IS NULL THEN 'open' ELSE 'resolved' END AS status FROM res"))
register("journal_scoreboard", lambda s, d: journal.scoreboard(paper_resolved(s, d)), query("SELECT coalesce(lower(direction), 'all') AS grp, count(*) FILTER (return_pct IS NULL) AS open, count(return_pct) AS trades, round(avg(CAST(return_pct > 0 AS INTEGER)) * 100, 1) AS win_rate, round(avg(return_pct), 3) AS avg_return FROM res GROUP BY GROUPING SETS ((), (direction))"))
register("confidence_by_setup", lambda s, d: journal.confidence_by_setup(paper_resolved(s, d)), query(f"SELECT *, trades < 5 AS low_sample FROM ({_SETUP})"))
register("setup_confidence", lambda s, d: journal.setup_confidence(paper_resolved(s, d)), query(f"SELECT *, trades < 5 AS low_sample FROM ({_SETUP}) WHERE trades >= 5"))
register("confidence_by_factor", lambda s, d: journal.confidence_by_factor(paper_resolved(s, d)), query(f"SELECT *, trades < 5 AS low_sample FROM (SELECT factor, value, {_JSTATS} FROM ({_FACTOR_ROWS}) GROUP BY 1, 2)"))
register("join_setup_confidence", lambda s, d: enrich.join_setup_confidence(rows_of(s, d), journal.setup_confidence(paper_resolved(s, d))).select("symbol", "journal_confidence"), query(f"SELECT g.symbol, x.win_rate AS journal_confidence FROM sig g LEFT JOIN (SELECT * FROM ({_SETUP}) WHERE trades >= 5) x ON x.direction = g.direction AND x.aligned = g.aligned"))
register("risk_budget", lambda s, d: journal.risk_budget(paper_resolved(s, d), M.regions(s, d), _lit_day(), P60), query(
    "SELECT trades_today, open_positions, round(trades_today * 1.0::DOUBLE, 2) AS committed_risk_pct, 3.0::DOUBLE AS max_daily_risk_pct, CAST(5 AS INTEGER) AS max_concurrent_positions, 1.0::DOUBLE AS risk_per_trade_pct, 100000.0::DOUBLE AS account_capital, trades_today * 1.0 > 3 AS risk_budget_exceeded, open_positions > 5 AS position_limit_exceeded, "
    f"(SELECT coalesce(list(sector ORDER BY sector), []) FROM (SELECT sector FROM res JOIN sector_map USING (symbol) WHERE CAST(logged_at AS DATE) = DATE '{LAST_DAY}' GROUP BY 1 HAVING count(*) >= 2)) AS concentrated_sectors "
    f"FROM (SELECT count(*) FILTER (CAST(logged_at AS DATE) = DATE '{LAST_DAY}') AS trades_today, count(*) FILTER (return_pct IS NULL) AS open_positions FROM res)"))  # fmt: skip
register("sector_concentration", lambda s, d: journal.sector_concentration(paper_resolved(s, d), M.regions(s, d), _lit_day()), query(f"SELECT sector, count(*) AS trades FROM res JOIN sector_map USING (symbol) WHERE CAST(logged_at AS DATE) = DATE '{LAST_DAY}' GROUP BY 1 HAVING count(*) >= 2"))
register("journal_delete", lambda s, d: journal.delete_trades(paper(s, d), paper(s, d).where("symbol = 'S1'")).select("id", "symbol"), query("SELECT id, symbol FROM paper WHERE symbol <> 'S1'"))
_KEPT = "rsi cmf adx candle_pattern candle_direction"
register("journal_log", lambda s, d: out(paper(s, d).select("id", "symbol", "direction", "aligned", "signal_time", "logged_close", *(f"snapshot.{c}" for c in _KEPT.split())), f"id symbol direction aligned signal_time logged_close {_KEPT}"), query(f"SELECT id, symbol, direction, aligned, {ts('signal_time')}, round(logged_close, 6) AS logged_close, round(rsi, 6) AS rsi, round(cmf, 6) AS cmf, round(adx, 6) AS adx, candle_pattern, candle_direction FROM paper"))

# news and alerts
def written_fetches(s: SparkSession, d: str) -> str:
    """A folder of JSON lines: the fetches, and a line that was cut off."""
    folder = f"{_folder(s)}/json"
    M.fetches(s, d).write.json(folder)
    s.createDataFrame([('{"data": [{"uuid": "cut',)], "value string").write.mode("append").text(folder)
    return folder


def fetched(s: SparkSession, d: str) -> DataFrame:
    return news.read_fetches(s, written_fetches(s, d))


def flat_news(s: SparkSession, d: str) -> DataFrame:
    return news.news_flatten(news.article_scan(fetched(s, d)), M.watchlist(s, d))


def cached_news(s: SparkSession, d: str, scope: DataFrame) -> DataFrame:
    return news.news_cache(news.lists_by_symbol(fetched(s, d))).join(scope.select("symbol"), "symbol", "left_semi")


ARTICLE = "uuid title url source published_at"
_CACHED = "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS rank FROM (SELECT *, max(nth) OVER (PARTITION BY symbol) AS newest FROM flat) WHERE nth = newest)"
register("article_scan", lambda s, d: out(news.article_scan(fetched(s, d)).withColumn("n_entities", F.size("entities")), f"{ARTICLE} n_entities"), query("SELECT DISTINCT uuid, title, url, source, published_at, CAST(4 AS INTEGER) AS n_entities FROM arts"))
register("bad_lines", lambda s, d: out(news.bad_lines(fetched(s, d)).join(news.article_scan(fetched(s, d)).agg(F.count("*").alias("articles"))), "fetched_at bad articles"), query("""SELECT CAST(NULL AS BIGINT) AS fetched_at, '{"data": [{"uuid": "cut' AS bad, count(*) AS articles FROM documents"""))
register("news_flatten", lambda s, d: out(flat_news(s, d), f"{ARTICLE} symbol sentiment"), query("SELECT uuid, title, url, source, published_at, symbol, sentiment FROM flat"))
register("news_dedupe", lambda s, d: news.news_dedupe(flat_news(s, d), M.watchlist(s, d)).select("uuid", "symbol"), query("SELECT uuid, min(symbol) AS symbol FROM flat GROUP BY 1"))
register("news_top3", lambda s, d: news.news_top(cached_news(s, d, M.watchlist(s, d))).select("symbol", "rank", "uuid", "url"), query(f"SELECT symbol, CAST(rank AS INTEGER) AS rank, uuid, url FROM {_CACHED} WHERE rank <= 3"))
register("confirmed_news_scope", lambda s, d: news.news_top(cached_news(s, d, news.confirmed_scope(signals(s, d)))).select("symbol", "rank", "uuid"), query(f"SELECT symbol, CAST(rank AS INTEGER) AS rank, uuid FROM {_CACHED} WHERE rank <= 3 AND symbol IN (SELECT symbol FROM sig WHERE signal_confirmed)"))
register("confirmed_semi", lambda s, d: news.news_flatten(news.article_scan(fetched(s, d)), news.confirmed_scope(signals(s, d))).select("uuid", "symbol"), query("SELECT uuid, symbol FROM flat WHERE symbol IN (SELECT symbol FROM sig WHERE signal_confirmed)"))
register("news_alert_text", lambda s, d: enrich.news_alert_text(news.news_dedupe(flat_news(s, d), M.watchlist(s, d))).select("uuid", "alert"), query("SELECT uuid, '\U0001f4f0 ' || symbol || ': ' || coalesce(title, 'None') || printf(' (sentiment %+.2f)', round(round(sentiment, 6), 2)) || chr(10) || coalesce(source, 'news') || ' \u2014 ' || url AS alert FROM flat QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY symbol) = 1"))
register(
    "alert_dedupe",
    lambda s, d: out(news.alert_dedupe(replay.entries(voted(s, d)).withColumn("fresh_signal", F.when(F.col("entry"), F.col("direction"))).withColumn("vol_confirmed", replay.volume_hot(P60)).withColumn("htf_agrees", F.lit(True))), "symbol ts direction"),
    sql("symbol ts direction", "a_ret", "", "entry AND vol_confirmed"),
)

register("news_scope_join", lambda s, d: news.join_news(M.watchlist(s, d), news.news_top(cached_news(s, d, M.watchlist(s, d)))).select("symbol", F.size("news").alias("n"), F.array_join("news", "|").alias("news")), query(f"SELECT w.symbol, CASE WHEN count(f.uuid) > 0 THEN CAST(count(f.uuid) AS INTEGER) END AS n, string_agg(f.title, '|' ORDER BY f.rank) AS news FROM watchlist w LEFT JOIN (SELECT * FROM {_CACHED} WHERE rank <= 3) f ON f.symbol = w.symbol GROUP BY 1"))
_ALERTS = "FROM a_ret WHERE entry AND vol_confirmed"


def alerts(s: SparkSession, d: str) -> DataFrame:
    own = replay.entries(voted(s, d)).withColumn("fresh_signal", F.when(F.col("entry"), F.col("direction"))).withColumn("vol_confirmed", replay.volume_hot(P60))
    return news.alert_dedupe(own.withColumn("htf_agrees", F.lit(True)))


register("newest_alerts", lambda s, d: out(news.newest(alerts(s, d)), "symbol ts direction"), query(f"SELECT symbol, {ts()}, direction {_ALERTS} ORDER BY a_ret.ts DESC, symbol LIMIT 20"))
register("journal_newest", lambda s, d: out(journal.newest_first(paper(s, d)).limit(100), "id symbol logged_at").withColumn("logged_at", F.col("logged_at").cast("long")), query("SELECT id, symbol, CAST(floor(epoch(logged_at)) AS BIGINT) AS logged_at FROM paper ORDER BY paper.logged_at DESC, id LIMIT 100"))


def exported(s: SparkSession, d: str) -> DataFrame:
    folder = f"{_folder(s)}/csv"
    journal.export_csv(paper_resolved(s, d), folder)
    return journal.read_csv(s, folder)


register(
    "journal_csv",
    lambda s, d: out(exported(s, d), "id symbol timeframe direction horizon_bars status signal_time entry_time entry_price exit_price return_pct mae_pct outcome cost_pct slippage_pct"),
    query(f"SELECT id, symbol, '60minute' AS timeframe, direction, h AS horizon_bars, CASE WHEN return_pct IS NULL THEN 'open' ELSE 'resolved' END AS status, {ts('signal_time')}, {ts('entry_time')}, entry_price, exit_price, return_pct, mae AS mae_pct, CASE WHEN return_pct > 0 THEN 'win' WHEN return_pct <= 0 THEN 'loss' END AS outcome, 0.03::DOUBLE AS cost_pct, 0.01::DOUBLE AS slippage_pct FROM res"),
)
register("backtest_universe", lambda s, d: replay.backtest_universe(M.watchlist(s, d)), query("SELECT symbol FROM watchlist"))
_START = "2024-01-15 00:00:00"
register("warmup_trim", lambda s, d: long_trades(replay.backtest(bars(s, d, "60minute"), "60minute", CROSSES, 1, P60, start=F.lit(_START).cast("timestamp_ntz"))), trades_sql("t_", f"WHERE t_trades.ts >= TIMESTAMP '{_START}'"))
register("gates_regime_volume", lambda s, d: long_trades(replay.backtest(bars(s, d, "60minute"), "60minute", replay.PARAMETERS, 3, P60, gates=("regime_volume",))), trades_sql("r_"))


def stored_weights(s: SparkSession, d: str) -> DataFrame:
    folder = f"{_folder(s)}/weights"
    replay.store_weights(weights(s, d), folder)
    return replay.load_weights(s, folder)


register("weights_table", stored_weights, query("SELECT * FROM weights"))

# charts
LINES, CANDLES = ("ema", "bb_mid", "rsi", "rsi_smooth", "macd", "macd_signal", "macd_hist", "vwap", "avwap"), ("open", "high", "low", "close")


def chart_lines(s: SparkSession, d: str) -> DataFrame:
    """The points of each line of each symbol, candles to two places and lines to three (halves up); a symbol with an error has candles alone."""
    up = lambda c, n: F.floor(F.col(c) * n + 0.5000001) / n
    own = series(s, d).select("symbol", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("time"), *(up(c, 100).alias(c) for c in CANDLES), *(F.when(F.col("error").isNull(), up(c, 1000)).alias(c) for c in LINES))
    return own.unpivot(["symbol", "time"], [*CANDLES, *LINES], "line", "value").where("value is not null")


_POINTS = ", ".join([f"floor({c} * 100 + 0.5000001) / 100 AS {c}" for c in CANDLES] + [f"CASE WHEN NOT short THEN floor({'macd - macd_signal' if c == 'macd_hist' else c} * 1000 + 0.5000001) / 1000 END AS {c}".replace("macd - macd_signal *", "(macd - macd_signal) *") for c in LINES])
register("chart_series", chart_lines, query(f"SELECT symbol, time, line, value FROM (UNPIVOT (SELECT symbol, CAST(floor(epoch(ts)) AS BIGINT) AS time, {_POINTS} FROM h_ind) ON {', '.join([*CANDLES, *LINES])} INTO NAME line VALUE value)"))

# the 3-minute engine
register("scalp_series", lambda s, d: out(scalp.scalp_series(index3(s, d)), "symbol ts ema_fast ema_slow rsi vwap atr"), query(f"SELECT symbol, {ts()}, round(f_line, 6) AS ema_fast, round(s_line, 6) AS ema_slow, round(rsi, 6) AS rsi, round(vwap, 6) AS vwap, round(atr, 6) AS atr FROM x_ind"))
register("scalp_htf", lambda s, d: scalp.scalp_htf(index3(s, d)), query("SELECT symbol, CASE WHEN n_bars >= 18 THEN CASE WHEN coalesce(f_line - s_line > 1e-9 * greatest(1.0, abs(f_line), abs(s_line)), false) THEN 'Bullish' ELSE 'Bearish' END END AS htf_direction FROM y_ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"))
SCALP = "symbol error close vwap rsi votes direction vol_multiple vol_confirmed confirmed_count in_opening_window htf_direction htf_agrees signal_confirmed action reason label atr"
_TREND = "SELECT symbol, CASE WHEN n_bars >= 18 THEN CASE WHEN coalesce(f_line - s_line > 1e-9 * greatest(1.0, abs(f_line), abs(s_line)), false) THEN 'Bullish' ELSE 'Bearish' END END AS htf_direction FROM y_ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"
_ENGINE = (
    "SELECT *, CASE WHEN ok THEN CASE WHEN direction = 'Bullish' THEN 'BUY' ELSE 'SELL' END ELSE 'WAIT' END AS action, CASE WHEN NOT ok THEN CASE WHEN in_opening_window THEN 'Opening-window warm-up (first 15 min of the session)' WHEN NOT htf_agrees THEN 'Against the 15-min trend (currently ' || htf_direction || ')' ELSE 'Only ' || confirmed_count || ' of 4 aligned (need 3)' END END AS reason FROM "
    "(SELECT *, confirmed_count >= 3 AND NOT in_opening_window AND htf_agrees AS ok FROM (SELECT *, greatest(votes, 3 - votes) + CAST(vol_confirmed AS INTEGER) AS confirmed_count, coalesce(htf_direction = direction, true) AS htf_agrees FROM "
    "(SELECT *, CASE WHEN votes >= 2 THEN 'Bullish' ELSE 'Bearish' END AS direction, coalesce(vol_multiple >= 1.5, false) AS vol_confirmed, hour(ts) = 9 AND minute(ts) BETWEEN 15 AND 29 AS in_opening_window FROM "
    f"(SELECT x.*, t.htf_direction, round(rel_volume, 2) AS vol_multiple, CAST(f_line > s_line AS INTEGER) + CAST(close > vwap AS INTEGER) + CAST(coalesce(rsi > 50, false) AS INTEGER) AS votes FROM x_ind x LEFT JOIN ({_TREND}) t USING (symbol) QUALIFY row_number() OVER (PARTITION BY x.symbol ORDER BY ts DESC) = 1))))"
)
_SCALP_SQL = query(
    "SELECT symbol, CASE WHEN n_bars < 19 THEN 'not enough candles' WHEN vwap IS NULL THEN 'VWAP not available yet' END AS error, round(close, 2) AS close, round(vwap, 2) AS vwap, round(rsi, 1) AS rsi, votes, direction, vol_multiple, vol_confirmed, confirmed_count, in_opening_window, htf_direction, htf_agrees, ok AS signal_confirmed, action, reason, "
    f"CASE WHEN ok THEN action || ' NIFTY FUT' ELSE 'NO TRADE - WAIT' END AS label, round(atr, 2) AS atr FROM ({_ENGINE})"
)
register("scalp_signal", lambda s, d: out(scalp.scalp_signal(index3(s, d)), SCALP), _SCALP_SQL)
register("scalp_levels", lambda s, d: scalp.scalp_signal(index3(s, d)).select("symbol", "stop", "target", "risk_reward"), query("SELECT symbol, CAST(round(CAST(close - sign * 0.75 * atr AS DECIMAL(18, 6)), 2) AS DOUBLE) AS stop, CAST(round(CAST(close + sign * 1.5 * atr AS DECIMAL(18, 6)), 2) AS DOUBLE) AS target, CAST(2 AS DOUBLE) AS risk_reward FROM (SELECT *, CASE WHEN CAST(f_line > s_line AS INTEGER) + CAST(close > vwap AS INTEGER) + CAST(coalesce(rsi > 50, false) AS INTEGER) >= 2 THEN 1.0 ELSE -1.0 END AS sign FROM x_ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"))


# streams, run until their input ends
def streamed_bars(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    jobs.write_batches(jobs.stream_bars(jobs.tick_stream(s, f"{d}/events.parquet"), 60), f"{folder}/out", f"{folder}/state").awaitTermination()
    return jobs.latest(s, f"{folder}/out", "symbol", "timeframe", "ts")


register("stream_bars", lambda s, d: out(streamed_bars(s, d), BAR), sql(BAR, "bars60", BAR_D))


def halves(df: DataFrame, order: str) -> Column:
    """0 for the rows up to the middle of a column (a number or time), 1 for the rest."""
    key = F.col(order).cast("timestamp").cast("double") if "timestamp" in dict(df.dtypes)[order] else F.col(order).cast("double")
    middle = df.select(F.percentile_approx(key, 0.5).alias("e")).first().e
    return (key > F.lit(middle or 0.0)).cast("int")


def triggered(s: SparkSession, d: str, start: Callable[[DataFrame, str], list[StreamingQuery]]) -> str:
    """Runs a stream that scans at each trigger, once."""
    return fed(s, M.watchlist(s, d), F.lit(0), 1, start)


SCANNED = "symbol direction aligned signal_confirmed param_tier index_agrees sector sector_agrees breadth_agrees weighted_score structure stage positional_qualified high_conviction"


def streamed_scan(s: SparkSession, d: str) -> DataFrame:
    work = lambda: (scan(s, d), "2024-01-29T1000")
    folder = triggered(s, d, lambda t, f: [jobs.stream_scan(t, work, f"{f}/out", f"{f}/state")])
    return results.published(s, f"{folder}/out")


def zoned(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def oi_parts(s: SparkSession, d: str, start: Callable[[DataFrame, str], list[StreamingQuery]]) -> str:
    own = OI(s, d)
    return fed(s, own, halves(own, "ts"), 2, start)


def streamed_oi(s: SparkSession, d: str) -> DataFrame:
    folder = oi_parts(s, d, lambda t, f: [jobs.stream_oi_state(t, f"{f}/out", f"{f}/state")])
    return s.read.parquet(f"{folder}/out")


def streamed_oi_events(s: SparkSession, d: str) -> DataFrame:
    folder = oi_parts(s, d, lambda t, f: [jobs.oi_event_log(t, f"{f}/out", f"{f}/state", "60minute")])
    return s.read.parquet(f"{folder}/out")


def streamed_resolve(s: SparkSession, d: str) -> DataFrame:
    own, path = paper(s, d), stored(s, d, "60minute")
    read = lambda since: store.read_bars(s, path, "60minute", since)
    folder = fed(s, own, halves(own, "signal_time"), 2, lambda t, f: [jobs.journal_resolve_stream(t, read, f"{f}/out", f"{f}/state")])
    return jobs.read_journal(s, f"{folder}/out")


def streamed_frames(s: SparkSession, d: str) -> DataFrame:
    """The panel of three timeframes, whose scans run beside each other."""
    read = lambda tf: B.resample(bars(s, d, "60minute"), tf) if tf == "4hour" else bars(s, d, tf)

    def index(tf: str) -> DataFrame:
        own = B.index_bars(M.ticks(s, d), "60minute" if tf == "4hour" else tf, F.lit("IDX"))
        return B.resample(own, tf) if tf == "4hour" else own

    frames = dict.fromkeys(("15minute", "60minute", "4hour"))
    folder = triggered(s, d, lambda t, f: jobs.stream_multi_timeframe(t, read, index, M.watchlist(s, d), f"{f}/out", f"{f}/state", frames))
    panels = [jobs.latest(s, f"{folder}/out/{tf}", "symbol").select(F.lit(tf).alias("timeframe"), "symbol", "direction", "param_tier", "index_agrees", "signal_confirmed", "close") for tf in frames]
    return panels[0].unionByName(panels[1]).unionByName(panels[2])


def streamed_scalp(s: SparkSession, d: str) -> DataFrame:
    folder = triggered(s, d, lambda t, f: [jobs.stream_scalp(t, lambda: index3(s, d), f"{f}/out", f"{f}/state")])
    return jobs.latest(s, f"{folder}/out", "symbol")


def streamed_alerts(s: SparkSession, d: str) -> DataFrame:
    """Alerts from rows that come twice: in the first part, and again in the second."""
    own = zoned(replay.entries(voted(s, d)).withColumn("fresh_signal", F.when(F.col("entry"), F.col("direction"))).withColumn("vol_confirmed", replay.volume_hot(P60)).withColumn("htf_agrees", F.lit(True)).withColumn("timeframe", F.lit("60minute")))
    own = own.select("symbol", "timeframe", "ts", "direction", "fresh_signal", "vol_confirmed", "htf_agrees")
    twice = own.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    folder = fed(s, twice, F.col("n"), 2, lambda t, f: [jobs.write_batches(jobs.alert_stream(t, "60 days"), f"{f}/out", f"{f}/state")])
    return s.read.parquet(f"{folder}/out")


def streamed_news(s: SparkSession, d: str, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """What a stream of fetches gives, from JSON files that come in two parts; and its folder."""
    folder, f = _folder(s), M.fetches(s, d)
    part = halves(f, "fetched_at")
    for i in range(2):
        f.where(part == i).write.mode("append").json(f"{folder}/in")
        jobs.write_batches(work(news.read_fetches(s, f"{folder}/in", stream=True)), f"{folder}/out", f"{folder}/state").awaitTermination()
    return s.read.parquet(f"{folder}/out"), folder


def streamed_articles(s: SparkSession, d: str) -> DataFrame:
    return streamed_news(s, d, lambda f: jobs.news_stream(f, M.watchlist(s, d), "90 days"))[0]


def streamed_cache(s: SparkSession, d: str) -> DataFrame:
    cache = jobs.latest(s, f"{streamed_news(s, d, jobs.news_cache_stream)[1]}/out", "symbol")
    return news.news_top(cache.join(M.watchlist(s, d).select("symbol"), "symbol", "left_semi"))


def published_scan(s: SparkSession, d: str) -> DataFrame:
    """The newest of two published scans; a third was written and its pointer not."""
    folder = f"{_folder(s)}/scans"
    rows = signals(s, d).select("symbol", "error", "direction")
    results.publish(rows.limit(1), folder, "2024-01-29T1000")
    results.publish(rows, folder, "2024-01-29T1003")
    results.write_rows(rows.limit(2), folder, "2024-01-29T1006")
    results.compact(s, folder, 1)
    return results.published(s, folder)


_PUBLISHED = query("SELECT '2024-01-29T1003' AS scan, w.symbol, CASE WHEN l.symbol IS NULL THEN 'symbol not found' WHEN l.short THEN 'not enough candles' END AS error, direction FROM watchlist w LEFT JOIN l_last l ON w.symbol = l.symbol LEFT JOIN sig x ON w.symbol = x.symbol")
register("result_sink", published_scan, _PUBLISHED)
register("stream_scan", lambda s, d: out(streamed_scan(s, d), SCANNED), query(
    f"SELECT g.symbol, direction, aligned, signal_confirmed, aligned AS param_tier, coalesce(index_direction = direction, true) AS index_agrees, m.sector, coalesce(sector_direction = direction, true) AS sector_agrees, coalesce({_BULL} >= 30, true) AS breadth_agrees, {_SCORE} AS weighted_score, structure, stage, {_POS} AS positional_qualified, {_CONV} AS high_conviction "
    f"{_SCAN} JOIN breadth ON true JOIN wide ON true LEFT JOIN sector_map m ON m.symbol = g.symbol LEFT JOIN sec_dir x ON x.sector = m.sector"))  # fmt: skip
OI_STATE = "symbol ts chg_15 chg_30 chg_60 accel accel_label structure stage break_signal accel_event price_chg_today oi_chg_today oi_day_chg"
OI_D = "chg_15 chg_30 chg_60 accel price_chg_today oi_chg_today oi_day_chg"
register("stream_oi_state", lambda s, d: out(streamed_oi(s, d), OI_STATE), sql(OI_STATE, "oi_state", OI_D))
register("journal_resolve_stream", lambda s, d: out(streamed_resolve(s, d), "id return_pct mae status"), query("SELECT id, return_pct, mae, CASE WHEN return_pct IS NULL THEN 'open' ELSE 'resolved' END AS status FROM res"))
register("oi_event_log", lambda s, d: out(streamed_oi_events(s, d), "symbol ts accel_label"), sql("symbol ts accel_label", "oi_state", "", "accel_event"))
_PANEL = "SELECT timeframe, symbol, direction, param_tier, index_agrees, signal_confirmed, close FROM"
register("stream_multi_timeframe", streamed_frames, query(f"{_PANEL} fq_panel UNION ALL {_PANEL} fh_panel UNION ALL {_PANEL} fk_panel"))
register("stream_scalp", lambda s, d: out(streamed_scalp(s, d), SCALP), _SCALP_SQL)
register("alert_stream", lambda s, d: out(streamed_alerts(s, d), "symbol ts direction"), sql("symbol ts direction", "a_ret", "", "entry AND vol_confirmed"))
register("news_stream", lambda s, d: streamed_articles(s, d).select("uuid", "title", "url"), query("SELECT DISTINCT uuid, title, url FROM flat"))
register("news_cache_stream", lambda s, d: streamed_cache(s, d).select("symbol", "rank", "uuid", "url"), query(f"SELECT symbol, CAST(rank AS INTEGER) AS rank, uuid, url FROM {_CACHED} WHERE rank <= 3"))


def _lit_day():
    return F.lit(LAST_DAY).cast("date")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in _Q.items()}


def oracles() -> dict[str, str]:
    return {k: v[1] for k, v in _Q.items() if v[1]}
