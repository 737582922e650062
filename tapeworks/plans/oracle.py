"""DuckDB SQL for the registered queries, put together from shared common table expressions."""

from __future__ import annotations

import re


def gt(a: str, b: str) -> str:
    return f"coalesce(({a}) - ({b}) > 1e-9 * greatest(1.0, abs({a}), abs({b})), false)"


def side(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'Bullish' ELSE 'Bearish' END"


BUCKETS = {
    "3minute": "time_bucket(INTERVAL '3 minutes', ts)", "15minute": "time_bucket(INTERVAL '15 minutes', ts)", "60minute": "time_bucket(INTERVAL '60 minutes', ts)",
    "4hour": "time_bucket(INTERVAL '4 hours', ts, INTERVAL '75 minutes')", "day": "CAST(CAST(ts AS DATE) AS TIMESTAMP)", "week": "CAST(date_trunc('week', ts) + INTERVAL '6 days' AS TIMESTAMP)",
}


def bars_of(source: str, tf: str, symbol: str = "symbol") -> str:
    return (
        f"SELECT {symbol} AS symbol, '{tf}' AS timeframe, {BUCKETS[tf]} AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, "
        f"last(price ORDER BY ts, event_id) AS close, CAST(sum(qty) AS BIGINT) AS volume FROM {source} WHERE {symbol} IS NOT NULL GROUP BY 1, 2, 3"
    )


def resampled(source: str, tf: str) -> str:
    return (
        f"SELECT symbol, '{tf}' AS timeframe, {BUCKETS[tf]} AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, "
        f"CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT * FROM {source}) GROUP BY symbol, {BUCKETS[tf]}"
    )


#: Names of futures whose underlying is an index.
INDICES = "'NIFTY', 'BANKNIFTY', 'FINNIFTY', 'MIDCPNIFTY', 'NIFTYNXT50', 'NIFTY NEXT 50', 'SENSEX', 'BANKEX', 'NIFTYIT', 'NIFTY IT'"
CTES: dict[str, str] = {
    "ticks": "SELECT 'S' || (user_id % 10) AS symbol, event_id, ts, value AS price, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS qty, CASE WHEN event_type IN ('signup', 'purchase') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS sgn FROM events",
    "oticks": "SELECT 'S' || (o_custkey % 10) AS symbol, o_orderkey AS event_id, CAST(o_orderdate AS TIMESTAMP) AS ts, o_totalprice AS price, 1 AS qty FROM orders",
    "hticks": "SELECT 'S' || (o_custkey % 10) AS symbol, o_orderkey AS event_id, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS ts, o_totalprice AS price, 1 AS qty FROM orders",
    "sector_map": "SELECT 'S' || n_nationkey AS symbol, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 9",
    "watchlist": "SELECT CAST(n_nationkey AS INTEGER) AS pos, CASE WHEN n_nationkey = 10 THEN 'SX' ELSE 'S' || n_nationkey END AS symbol FROM nation WHERE n_nationkey <= 10",
    "bars60": bars_of("ticks", "60minute"),
    "bars15": bars_of("ticks", "15minute"),
    "bars3": bars_of("ticks", "3minute"),
    "idx3": bars_of("(SELECT * REPLACE ('IDX' AS symbol) FROM ticks)", "3minute"),
    "idx60": bars_of("(SELECT * REPLACE ('IDX' AS symbol) FROM ticks)", "60minute"),
    "sec60": bars_of("(SELECT t.* REPLACE (m.sector AS symbol) FROM ticks t JOIN sector_map m USING (symbol))", "60minute"),
    "bars4h": resampled("bars60", "4hour"),
    "bars4h15": resampled("bars15", "4hour"),
    "bars15m3": resampled("idx3", "15minute"),
    "obars": bars_of("oticks", "day"),
    "hbars": bars_of("hticks", "60minute"),
    "hday": resampled("hbars", "day"),
    "instruments": (
        "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'NFO' ELSE 'NSE' END AS exchange, CASE WHEN p_partkey % 3 = 0 THEN 'NFO-FUT' ELSE 'NSE' END AS segment, CASE WHEN p_partkey % 3 = 0 THEN 'FUT' ELSE 'EQ' END AS instrument_type, "
        "nm AS name, CASE WHEN p_partkey % 3 = 0 THEN nm || '-' || p_partkey ELSE nm || CASE WHEN p_partkey >= 30 THEN '_' || p_partkey ELSE '' END END AS tradingsymbol, p_partkey AS instrument_token, -p_partkey AS row_id, "
        f"CAST(DATE '2024-01-25' + CAST(28 * (p_size % 3) AS INTEGER) AS DATE) AS expiry FROM (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN lower(([{INDICES}])[p_partkey // 11 % 10 + 1]) ELSE 'S' || (p_partkey % 10) END AS nm FROM part)"
    ),
    "near_all": "SELECT name, arg_min(tradingsymbol, (expiry, row_id)) AS tradingsymbol, arg_min(instrument_token, (expiry, row_id)) AS instrument_token, min(expiry) AS expiry FROM instruments WHERE instrument_type = 'FUT' AND expiry >= DATE '2024-02-01' GROUP BY name",
    "near": f"SELECT * FROM near_all WHERE upper(name) NOT IN ({INDICES})",
    "oi_ticks": "SELECT *, 2000.0 + sum(sgn * qty) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS oi FROM ticks",
    "oi_bins": f"SELECT symbol, last(ts ORDER BY ts, event_id) AS ts, last(CAST(oi AS DOUBLE) ORDER BY ts, event_id) AS oi, last(price ORDER BY ts, event_id) AS close FROM oi_ticks GROUP BY symbol, {BUCKETS['3minute']}",
    "oi_samples": "SELECT symbol, ts, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) % 50 <> 0 THEN oi END AS oi, close FROM oi_bins",
}
_look = ", ".join(f"last_value(oi IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 150 MINUTE PRECEDING AND INTERVAL {n} MINUTE PRECEDING) AS oi_{n}" for n in (15, 30, 60, 120))
CTES |= {
    "oi_look": f"SELECT *, {_look} FROM oi_samples",
    "oi_chg": "SELECT *, (oi - oi_15) / nullif(oi_15, 0) * 100 AS chg_15, (oi - oi_30) / nullif(oi_30, 0) * 100 AS chg_30, (oi - oi_60) / nullif(oi_60, 0) * 100 AS chg_60, (oi_30 - oi_60) / nullif(oi_60, 0) * 100 AS prior_30, (oi_60 - oi_120) / nullif(oi_120, 0) * 100 AS prior_60 FROM oi_look",
    "oi_accel": "SELECT *, CASE WHEN accel > 2 THEN 'Strong acceleration' WHEN accel >= 0.5 THEN 'Moderate acceleration' WHEN accel >= -0.3 THEN 'Stable' WHEN accel >= -2 THEN 'Weakening' WHEN accel IS NOT NULL THEN 'Possible exit/unwinding' END AS accel_label FROM (SELECT *, chg_30 - prior_30 AS accel FROM oi_chg)",
    "oi_base": "SELECT *, lag(last_oi) OVER (PARTITION BY symbol ORDER BY day) AS prev_oi FROM (SELECT symbol, CAST(ts AS DATE) AS day, first(oi ORDER BY ts) FILTER (oi IS NOT NULL AND close IS NOT NULL) AS base_oi, first(close ORDER BY ts) FILTER (oi IS NOT NULL AND close IS NOT NULL) AS base_close, last(oi ORDER BY ts) FILTER (oi IS NOT NULL) AS last_oi FROM oi_samples GROUP BY 1, 2 HAVING count(*) FILTER (oi IS NOT NULL AND close IS NOT NULL) > 0)",
    "oi_today": "SELECT a.*, b.base_oi, b.base_close, b.prev_oi, CASE WHEN oi IS NOT NULL THEN (close - base_close) / nullif(base_close, 0) * 100 END AS price_chg_today, CASE WHEN close IS NOT NULL THEN (oi - base_oi) / nullif(base_oi, 0) * 100 END AS oi_chg_today, CASE WHEN close IS NOT NULL THEN (oi - prev_oi) / nullif(prev_oi, 0) * 100 END AS oi_day_chg FROM oi_accel a LEFT JOIN oi_base b ON a.symbol = b.symbol AND CAST(a.ts AS DATE) = b.day",
    "oi_struct": "SELECT *, CASE WHEN price_chg_today IS NULL OR oi_chg_today IS NULL THEN NULL WHEN price_chg_today > 0.05 AND oi_chg_today > 0.05 THEN 'Long Buildup' WHEN price_chg_today < -0.05 AND oi_chg_today > 0.05 THEN 'Short Buildup' WHEN price_chg_today > 0.05 AND oi_chg_today < -0.05 THEN 'Short Covering' WHEN price_chg_today < -0.05 AND oi_chg_today < -0.05 THEN 'Long Unwinding' ELSE 'Neutral' END AS structure FROM oi_today",
    "oi_prev": "SELECT *, last_value(structure IGNORE NULLS) OVER w AS prev_s, last_value(accel_label IGNORE NULLS) OVER w AS prev_l, accel_label IN ('Strong acceleration', 'Moderate acceleration') AS fast FROM oi_struct WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "oi_state": "SELECT *, CASE WHEN prev_s IS NOT NULL AND prev_s <> structure THEN 'New' END AS stage, CASE WHEN structure = 'Long Buildup' AND fast THEN 'Break Up' WHEN structure = 'Short Buildup' AND fast THEN 'Break Down' END AS break_signal, coalesce(fast AND coalesce(prev_l NOT IN ('Strong acceleration', 'Moderate acceleration'), true), false) AS accel_event FROM oi_prev",
}


def indicators(p: str, source: str, fast: int, slow: int, n_rsi: int = 9) -> dict[str, str]:
    """CTEs <p>num, <p>rec, <p>ind and so on: indicators of a bars CTE, averages by recursion."""
    af, asl, ag = (f"(2.0 / ({x} + 1.0))" for x in (fast, slow, 9))
    ar, a14 = f"(1.0 / {n_rsi})", "(1.0 / 14)"
    mean = lambda a, old, new: f"((1 - {a}) * {old} + {a} * {new})"
    w = "PARTITION BY symbol ORDER BY ts"
    r20 = f"({w} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    out = {
        f"{p}num": f"SELECT *, row_number() OVER ({w}) AS rn, count(*) OVER (PARTITION BY symbol) AS n_bars, lag(close) OVER ({w}) AS c1, lag(open) OVER ({w}) AS o1, lag(close, 2) OVER ({w}) AS c2, lag(open, 2) OVER ({w}) AS o2, lag(close, 6) OVER ({w}) AS c6, lag(high) OVER ({w}) AS h1, lag(low) OVER ({w}) AS l1 FROM {source}",
        f"{p}inp": "SELECT *, CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0.0) END AS up, CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0.0) END AS dn, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr, "
        f"CASE WHEN high - h1 > l1 - low AND high - h1 > 0 THEN high - h1 ELSE 0.0 END AS pdm, CASE WHEN l1 - low > high - h1 AND l1 - low > 0 THEN l1 - low ELSE 0.0 END AS mdm FROM {p}num",
        f"{p}rec": f"SELECT symbol, rn, close AS f, close AS s, CAST(0 AS DOUBLE) AS sig, close AS ema, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l, tr AS a, pdm AS sp, mdm AS sm, CAST(NULL AS DOUBLE) AS dx, CAST(NULL AS DOUBLE) AS dxe, 0 AS ndx FROM {p}inp WHERE rn = 1 "
        f"UNION ALL SELECT symbol, rn, f, s, {mean(ag, 'sig0', '(f - s)')}, ema, g, l, a, sp, sm, dx, CASE WHEN dxe0 IS NULL THEN dx WHEN dx IS NULL THEN dxe0 ELSE {mean(a14, 'dxe0', 'dx')} END, ndx0 + CASE WHEN dx IS NULL THEN 0 ELSE 1 END "
        "FROM (SELECT *, CASE WHEN rn >= 14 AND a <> 0 AND sp + sm <> 0 THEN 100 * abs(100 * sp / a - 100 * sm / a) / (100 * sp / a + 100 * sm / a) END AS dx "
        f"FROM (SELECT e.symbol, e.rn, {mean(af, 'r.f', 'e.close')} AS f, {mean(asl, 'r.s', 'e.close')} AS s, r.sig AS sig0, {mean(ag, 'r.ema', 'e.close')} AS ema, CASE WHEN r.g IS NULL THEN e.up ELSE {mean(ar, 'r.g', 'e.up')} END AS g, "
        f"CASE WHEN r.l IS NULL THEN e.dn ELSE {mean(ar, 'r.l', 'e.dn')} END AS l, {mean(a14, 'r.a', 'e.tr')} AS a, {mean(a14, 'r.sp', 'e.pdm')} AS sp, {mean(a14, 'r.sm', 'e.mdm')} AS sm, r.dxe AS dxe0, r.ndx AS ndx0 FROM {p}rec r JOIN {p}inp e ON e.symbol = r.symbol AND e.rn = r.rn + 1))",
        f"{p}one": f"SELECT e.*, r.f AS f_line, r.s AS s_line, CASE WHEN e.rn - 1 >= {n_rsi} AND r.l <> 0 THEN 100 - 100 / (1 + r.g / r.l) END AS rsi, r.f - r.s AS macd, r.sig AS macd_signal, r.ema AS ema, CASE WHEN e.rn >= 14 THEN r.a END AS atr, CASE WHEN r.ndx >= 14 AND r.dx IS NOT NULL THEN r.dxe END AS adx, "
        "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS flow, (high + low + close) / 3 * volume AS tpv "
        f"FROM {p}inp e JOIN {p}rec r USING (symbol, rn)",
        f"{p}two": f"SELECT *, CASE WHEN count(rsi) OVER ({w} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) = 9 THEN avg(rsi) OVER ({w} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) END AS rsi_smooth, "
        f"CASE WHEN rn >= 20 THEN avg(close) OVER {r20} END AS bb_mid, CASE WHEN rn >= 20 THEN stddev_samp(close) OVER {r20} END AS bb_std, CASE WHEN rn >= 5 THEN avg(volume) OVER {r20} END AS vol_avg, "
        f"CASE WHEN rn >= 5 THEN sum(flow) OVER {r20} / nullif(CAST(sum(volume) OVER {r20} AS DOUBLE), 0) END AS cmf, "
        f"CASE WHEN timeframe IN ('3minute', '15minute', '60minute', '4hour') THEN sum(tpv) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) / nullif(CAST(sum(volume) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS DOUBLE), 0) END AS vwap FROM {p}one",
        f"{p}three": f"SELECT *, bb_mid + 2 * bb_std AS bb_upper, bb_mid - 2 * bb_std AS bb_lower, volume / nullif(vol_avg, 0) AS rel_volume, {gt('rsi', 'rsi_smooth')} AS rs, {gt('macd', 'macd_signal')} AS ms, {gt('ema', 'bb_mid')} AS es, {gt('rsi_smooth', 'rsi')} AS rs_, {gt('macd_signal', 'macd')} AS ms_, {gt('bb_mid', 'ema')} AS es_, "
        "CASE WHEN rsi IS NOT NULL AND rsi_smooth IS NOT NULL AND macd IS NOT NULL AND macd_signal IS NOT NULL AND ema IS NOT NULL AND bb_mid IS NOT NULL THEN "
        f"CAST({gt('rsi', 'rsi_smooth')} AS INTEGER) + CAST({gt('macd', 'macd_signal')} AS INTEGER) + CAST({gt('ema', 'bb_mid')} AS INTEGER) END AS align, abs(close - open) AS body, nullif(high - low, 0) AS rng, high - greatest(open, close) AS ush, least(open, close) - low AS lsh FROM {p}two",
    }
    cross = []
    for name, a, b, up, dn in (("rsi", "rsi", "rsi_smooth", "rs", "rs_"), ("macd", "macd", "macd_signal", "ms", "ms_"), ("ema", "ema", "bb_mid", "es", "es_")):
        was = f"coalesce(lag({a} IS NOT NULL AND {b} IS NOT NULL) OVER ({w}), false)"
        cross.append(f"{up} AND {was} AND NOT coalesce(lag({up}) OVER ({w}), false) AS {name}_up, {dn} AND {was} AND NOT coalesce(lag({dn}) OVER ({w}), false) AS {name}_dn")
    shape, inv = "body <= 0.35 * rng AND lsh >= 2 * body AND ush <= 0.25 * rng", "body <= 0.35 * rng AND ush >= 2 * body AND lsh <= 0.25 * rng"
    star = "abs(c1 - o1) <= 0.5 * nullif(abs(o2 - c2), 0)"
    bull = f"CASE WHEN c1 < o1 AND close > open AND open <= c1 AND close >= o1 THEN 'Bullish Engulfing' WHEN c2 < o2 AND {star} AND close > open AND close > (o2 + c2) / 2 THEN 'Morning Star' WHEN {inv} AND c1 < c6 THEN 'Inverted Hammer' WHEN {shape} AND c1 < c6 THEN 'Hammer' END"
    bear = f"CASE WHEN c1 > o1 AND close < open AND open >= c1 AND close <= o1 THEN 'Bearish Engulfing' WHEN c2 > o2 AND {star} AND close < open AND close < (o2 + c2) / 2 THEN 'Evening Star' WHEN {inv} AND c1 > c6 THEN 'Shooting Star' WHEN {shape} AND c1 > c6 THEN 'Hanging Man' END"
    out[f"{p}four"] = f"SELECT *, {', '.join(cross)}, {bull} AS cbull, {bear} AS cbear, min(CASE WHEN align IS NOT NULL THEN ts END) OVER (PARTITION BY symbol) AS first_ok, coalesce(align >= 2, false) <> lag(coalesce(align >= 2, false)) OVER ({w}) AS flip FROM {p}three"
    out[f"{p}five"] = f"SELECT *, CASE WHEN cbull IS NULL OR cbear IS NULL THEN coalesce(cbull, cbear) END AS candle_pattern, CASE WHEN cbull IS NOT NULL AND cbear IS NULL THEN 'Bullish' WHEN cbear IS NOT NULL AND cbull IS NULL THEN 'Bearish' END AS candle_direction, coalesce(max(CASE WHEN flip AND ts > first_ok THEN ts END) OVER (PARTITION BY symbol), first_ok) AS anchor FROM {p}four"
    out[f"{p}ind"] = f"SELECT *, CASE WHEN ts >= anchor THEN sum(CASE WHEN ts >= anchor THEN tpv END) OVER ({w}) / nullif(CAST(sum(CASE WHEN ts >= anchor THEN volume END) OVER ({w}) AS DOUBLE), 0) END AS avwap, n_bars < 37 AS short FROM {p}five"
    return out


CTES |= indicators("h_", "bars60", 12, 26)  # 60-minute bars
CTES |= indicators("q_", "bars15", 3, 8)  # 15-minute bars
CTES |= indicators("f_", "bars4h15", 12, 26)  # their 4-hour buckets, with the spans of 4 hours
CTES |= indicators("i_", "idx60", 12, 26) | indicators("z_", "sec60", 12, 26)  # the index and the sectors
CTES |= indicators("l_", "hbars", 12, 26)  # the long history
CTES |= indicators("d_", "hday", 12, 26)
_w = "PARTITION BY symbol ORDER BY ts"
_regime = "CASE WHEN adx >= 25 THEN 'Trending' WHEN adx <= 18 THEN 'Ranging' WHEN adx IS NOT NULL THEN 'Transitional' END"
CTES |= {
    "l_last": "SELECT * FROM l_ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
    "d_last": f"SELECT symbol, {side('CAST(rs AS INTEGER) + CAST(ms AS INTEGER) + CAST(es AS INTEGER) >= 2')} AS htf_direction FROM d_ind WHERE NOT short QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
    "s_one": f"SELECT l.* EXCLUDE (adx, cmf, atr, avwap), round(adx, 1) AS adx, round(cmf, 3) AS cmf, round(atr, 2) AS atr, round(avwap, 2) AS avwap, htf_direction, {side('rs')} AS rsi_state, {side('ms')} AS macd_state, {side('es')} AS ema_bb_state, CAST(rs AS INTEGER) + CAST(ms AS INTEGER) + CAST(es AS INTEGER) AS votes, "
    "CAST(rsi_up AS INTEGER) + CAST(macd_up AS INTEGER) + CAST(ema_up AS INTEGER) AS ups, CAST(rsi_dn AS INTEGER) + CAST(macd_dn AS INTEGER) + CAST(ema_dn AS INTEGER) AS dns, round(rel_volume, 2) AS vol_multiple FROM l_last l LEFT JOIN d_last d USING (symbol) WHERE NOT short",
    "s_two": f"SELECT *, {side('votes >= 2')} AS direction, {_regime} AS regime, CASE WHEN ups >= 2 THEN 'Bullish' WHEN dns >= 2 THEN 'Bearish' END AS fresh_signal, round(1.2 * CASE WHEN adx <= 18 THEN 1.3 ELSE 1.0 END, 3) AS vol_threshold, CASE WHEN cmf > 0 THEN 'Bullish' WHEN cmf < 0 THEN 'Bearish' END AS flow_direction FROM s_one",
    "s_three": "SELECT *, coalesce(vol_multiple >= vol_threshold, false) AS vol_confirmed, coalesce(flow_direction = direction, true) AS flow_agrees, coalesce(candle_direction = direction, true) AS candle_agrees, coalesce(htf_direction = direction, true) AS htf_agrees, CASE WHEN close > vwap THEN 'Above' WHEN vwap IS NOT NULL THEN 'Below' END AS vs_vwap, CASE WHEN close > avwap THEN 'Above' WHEN avwap IS NOT NULL THEN 'Below' END AS vs_avwap, "
    "CASE WHEN close > bb_upper THEN 'Breakout' WHEN close < bb_lower THEN 'Breakdown' END AS breakout_state, CASE WHEN direction = 'Bullish' THEN 1.0 ELSE -1.0 END AS sign FROM s_two",
    "s_four": "SELECT *, greatest(votes, 3 - votes) + CAST(vol_confirmed AS INTEGER) AS aligned, CASE WHEN atr > 0 THEN CAST(round(CAST(close - sign * 1.5 * atr AS DECIMAL(18, 6)), 2) AS DOUBLE) END AS stop, CASE WHEN atr > 0 THEN CAST(round(CAST(close + sign * 3.0 * atr AS DECIMAL(18, 6)), 2) AS DOUBLE) END AS target, CASE WHEN atr > 0 THEN round(CAST(2.0 AS DOUBLE), 2) END AS risk_reward FROM s_three",
    "sig": "SELECT * REPLACE (round(close, 2) AS close, round(rsi, 1) AS rsi, round(nullif(vwap, 0), 2) AS vwap), '12,26,9' AS macd_params, (aligned >= 2) AND htf_agrees AS signal_confirmed, nullif(CAST(floor(1000.0 / nullif(abs(close - stop), 0)) AS BIGINT), 0) AS position_qty, round(nullif(CAST(floor(1000.0 / nullif(abs(close - stop), 0)) AS BIGINT), 0) * nullif(abs(close - stop), 0), 2) AS position_risk FROM s_four",
}


def replayed(p: str, source: str, votes: list[tuple[str, str]], required: int, gates: str = "true", extra: str = "") -> dict[str, str]:
    """CTEs <p>sig and <p>trades: signals of an indicator CTE, and the trades from their rising edges."""
    bull, bear = (" + ".join(f"CAST({v[i]} AS INTEGER)" for v in votes) for i in (0, 1))
    ahead = f"OVER ({_w} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)"
    gain = lambda h: f"sign * (lead(close, {1 + h}) OVER ({_w}) - ep) / ep * 100"
    returns = ", ".join(f"CASE WHEN abs({gain(h)}) < 0.0005 THEN 0.0 ELSE round({gain(h)}, 3) END AS r{h}" for h in (5, 10, 20))
    return {
        f"{p}vote": f"SELECT *, {bull} AS bull, {bear} AS bear FROM {source} WHERE NOT short",
        f"{p}dir": f"SELECT *, CASE WHEN bull >= {required} AND bear < {required} THEN 'Bullish' ELSE 'Bearish' END AS direction, (bull >= {required}) <> (bear >= {required}) AS raw FROM {p}vote",
        f"{p}sig": f"SELECT *, raw AND {gates} AS has_signal, CASE WHEN direction = 'Bullish' THEN 1.0 ELSE -1.0 END AS sign FROM {p}dir {extra}",
        f"{p}edge": f"SELECT *, has_signal AND NOT coalesce(lag(has_signal) OVER ({_w}), false) AS entry, nullif(lead(open) OVER ({_w}), 0) AS ep, lead(ts) OVER ({_w}) AS entry_time FROM {p}sig",
        f"{p}ret": f"SELECT *, {returns}, CASE WHEN sign * (CASE WHEN direction = 'Bullish' THEN min(low) {ahead} ELSE max(high) {ahead} END - ep) < 0 THEN round(sign * (CASE WHEN direction = 'Bullish' THEN min(low) {ahead} ELSE max(high) {ahead} END - ep) / ep * 100, 3) WHEN ep IS NOT NULL THEN 0.0 END AS mae, coalesce(rel_volume > 1.2, false) AS vol_confirmed FROM {p}edge",
        f"{p}trades": f"SELECT * FROM {p}ret WHERE entry AND ep IS NOT NULL AND r5 IS NOT NULL",
    }


RSI, MACD, EMA = ("rsi_up", "rsi_dn"), ("macd_up", "macd_dn"), ("ema_up", "ema_dn")
FLOW = ("coalesce(cmf > 0, false)", "coalesce(cmf < 0, false)")
LEVEL = ("coalesce(rsi > 65, false)", "coalesce(rsi < 35, false)")
CANDLE = ("coalesce(candle_direction = 'Bullish', false)", "coalesce(candle_direction = 'Bearish', false)")
HOT = ("coalesce(rel_volume > 1.2, false)",) * 2
CTES |= replayed("t_", "h_ind", [RSI, MACD, EMA], 1)
CTES |= replayed("a_", "h_ind", [RSI, MACD, EMA, LEVEL, HOT, FLOW, CANDLE], 3)
CTES |= replayed("v1_", "h_ind", [RSI], 1) | replayed("v2_", "h_ind", [MACD], 1) | replayed("v3_", "h_ind", [EMA], 1) | replayed("v4_", "h_ind", [RSI, MACD, EMA], 2)
CTES |= replayed("r_", "h_ind", [RSI, MACD, EMA, LEVEL, ("coalesce(rel_volume > 1.2 * CASE WHEN adx <= 18 THEN 1.3 ELSE 1.0 END, false)",) * 2, FLOW, CANDLE], 3)
CTES["f_lean"] = f"SELECT symbol, ts AS bucket, lag(CASE WHEN align IS NOT NULL AND NOT short THEN {side('align >= 2')} END) OVER ({_w}) AS htf_direction FROM f_ind"
CTES["q_htf"] = f"SELECT q.*, b.htf_direction FROM (SELECT *, {BUCKETS['4hour']} AS bucket FROM q_ind) q LEFT JOIN f_lean b ON q.symbol = b.symbol AND q.bucket = b.bucket"
CTES |= replayed("g_", "q_htf", [RSI, MACD, EMA], 1, "coalesce(htf_direction = direction, true) AND NOT (hour(ts) = 9 AND minute(ts) BETWEEN 15 AND 29) AND coalesce(CASE WHEN cmf > 0 THEN 'Bullish' WHEN cmf < 0 THEN 'Bearish' END = direction, true) AND coalesce(candle_direction = direction, true)")
CTES["t_long"] = "SELECT direction, vol_confirmed, h AS horizon, r FROM (SELECT direction, vol_confirmed, unnest([5, 10, 20]) AS h, unnest([r5, r10, r20]) AS r FROM t_trades) WHERE r IS NOT NULL"
CTES["rates"] = "SELECT *, round(win_rate - without_volume, 1) AS lift FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS param, count(r10) FILTER ({c}) AS trades, round(avg(CAST(r10 > 0 AS INTEGER)) FILTER ({c}) * 100, 1) AS win_rate, round(avg(CAST(r10 > 0 AS INTEGER)) FILTER (NOT ({c})) * 100, 1) AS without_volume FROM {p}trades HAVING count(r10) FILTER ({c}) > 0"
    for n, p, c in (("rsi_cross", "v1_", "true"), ("macd_cross", "v2_", "true"), ("ema_bb_cross", "v3_", "true"), ("rel_volume", "v4_", "vol_confirmed"))
) + ")"
CTES["weights"] = "SELECT p.param, round(0.2 / count(*) OVER () + 0.8 * coalesce(coalesce(win_rate / 100, 0.25) / nullif(sum(coalesce(win_rate / 100, 0.25)) OVER (), 0), 0), 4) AS weight FROM (SELECT unnest(['rsi_cross', 'macd_cross', 'ema_bb_cross', 'rel_volume']) AS param) p LEFT JOIN rates r ON p.param = r.param"

CTES |= {
    "lean_idx": f"SELECT symbol, {side('CAST(rs AS INTEGER) + CAST(ms AS INTEGER) + CAST(es AS INTEGER) >= 2')} AS direction FROM i_ind WHERE NOT short QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
    "lean_sec": f"SELECT symbol, {side('CAST(rs AS INTEGER) + CAST(ms AS INTEGER) + CAST(es AS INTEGER) >= 2')} AS direction FROM z_ind WHERE NOT short QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
    "idx_dir": "SELECT max(direction) AS index_direction FROM lean_idx",
    "sec_dir": "SELECT m.sector, l.direction AS sector_direction FROM (SELECT DISTINCT sector FROM sector_map JOIN sig USING (symbol)) m LEFT JOIN lean_sec l ON l.symbol = m.sector",
    "breadth": "SELECT bullish, bearish, round(bullish / nullif(bullish + bearish, 0) * 100, 1) AS bullish_pct, round(bearish / nullif(bullish + bearish, 0) * 100, 1) AS bearish_pct FROM (SELECT count(*) FILTER (direction = 'Bullish') AS bullish, count(*) FILTER (direction = 'Bearish') AS bearish FROM sig)",
    "wide": "SELECT max(CASE WHEN param = 'rsi_cross' THEN weight END) AS w1, max(CASE WHEN param = 'macd_cross' THEN weight END) AS w2, max(CASE WHEN param = 'ema_bb_cross' THEN weight END) AS w3, max(CASE WHEN param = 'rel_volume' THEN weight END) AS w4 FROM weights",
    "oi_last": "SELECT * FROM oi_state QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
    "paper": "SELECT md5(symbol || '|60minute|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || direction) AS id, symbol, direction, ts AS signal_time, entry_time, ep, sign, 10 AS h, close AS logged_close, rsi, cmf, adx, candle_pattern, candle_direction, rel_volume, ts + INTERVAL '1 hour' AS logged_at, CAST(CASE WHEN direction = 'Bullish' THEN align ELSE 3 - align END + CAST(vol_confirmed AS INTEGER) AS INTEGER) AS aligned, coalesce(CASE WHEN cmf > 0 THEN 'Bullish' WHEN cmf < 0 THEN 'Bearish' END = direction, true) AS flow_agrees, coalesce(candle_direction = direction, true) AS candle_agrees, htf_direction FROM t_trades LEFT JOIN h_lean USING (symbol, ts)",
    "h_day": "SELECT symbol, bucket, lag(lean) OVER (PARTITION BY symbol ORDER BY bucket) AS htf_direction FROM (SELECT symbol, ts AS bucket, " + f"CASE WHEN align IS NOT NULL AND NOT short THEN {side('align >= 2')} END AS lean FROM e_ind)",
    "h_lean": "SELECT b.symbol, b.ts, d.htf_direction FROM bars60 b LEFT JOIN h_day d ON d.symbol = b.symbol AND d.bucket = CAST(CAST(b.ts AS DATE) AS TIMESTAMP)",
    "num": "SELECT symbol, ts, open, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars60",
    "res_e": "SELECT p.*, e.n AS en, e.open AS eopen FROM paper p JOIN num s ON s.symbol = p.symbol AND s.ts = p.signal_time LEFT JOIN num e ON e.symbol = p.symbol AND e.n = s.n + 1",
    "res": "SELECT r.*, round(eopen, 2) AS entry_price, round(x.close, 2) AS exit_price, round(sign * (x.close - round(eopen, 2)) / nullif(round(eopen, 2), 0) * 100 - (0.03 + 2 * 0.01), 3) AS return_pct, "
    "CASE WHEN x.close IS NOT NULL THEN round(least(sign * (CASE WHEN direction = 'Bullish' THEN (SELECT min(low) FROM num y WHERE y.symbol = r.symbol AND y.n BETWEEN r.en AND r.en + 10) ELSE (SELECT max(high) FROM num y WHERE y.symbol = r.symbol AND y.n BETWEEN r.en AND r.en + 10) END - round(eopen, 2)) / nullif(round(eopen, 2), 0) * 100, 0.0), 3) + 0.0 END AS mae "
    "FROM res_e r LEFT JOIN num x ON x.symbol = r.symbol AND x.n = r.en + 10",
    "arts": "SELECT md5(CAST(doc_id AS VARCHAR)) AS uuid, doc_id, left(text, 80) AS title, 'https://news.example/' || doc_id AS url, source, strftime(make_timestamp((1706500000 + 60 * doc_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS published_at, doc_id // 50 AS nth, -doc_id AS pos, unnest(['S' || (doc_id % 10), 'S' || ((doc_id + 3) % 10)]) AS symbol, coalesce(quality * 1.0::DOUBLE, 0.0) AS sentiment FROM documents LEFT JOIN labels USING (doc_id)",
    "flat": "SELECT a.* FROM arts a WHERE symbol IN (SELECT symbol FROM watchlist)",
}


def framed(p: str, ind: str, htf: str, index: str, tf: str) -> dict[str, str]:
    """CTEs of one timeframe's panel: <p>lean (its higher timeframe's lean), <p>idx and <p>sig."""
    lean = f"{side('CAST(rs AS INTEGER) + CAST(ms AS INTEGER) + CAST(es AS INTEGER) >= 2')} AS lean"
    last = "WHERE NOT short QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"
    window = "hour(ts) = 9 AND minute(ts) BETWEEN 15 AND 29" if tf == "15minute" else "false"
    vol = "coalesce(round(rel_volume, 2) >= round(1.2 * CASE WHEN round(adx, 1) <= 18 THEN 1.3 ELSE 1.0 END, 3), false)"
    return {
        f"{p}lean": f"SELECT symbol, {lean} FROM {htf} {last}",
        f"{p}idx": f"SELECT max(lean) AS index_direction FROM (SELECT symbol, {lean} FROM {index} {last})",
        f"{p}sig": f"SELECT symbol, direction, round(close, 2) AS close, aligned, {window} AS opening, aligned >= 2 AND coalesce(lean = direction, true) AND NOT ({window}) AS signal_confirmed FROM (SELECT *, greatest(votes, 3 - votes) + CAST({vol} AS INTEGER) AS aligned, {side('votes >= 2')} AS direction "
        f"FROM (SELECT h.*, x.lean, CAST(rs AS INTEGER) + CAST(ms AS INTEGER) + CAST(es AS INTEGER) AS votes FROM {ind} h LEFT JOIN {p}lean x USING (symbol) {last.replace('short', 'h.short')}))",
        f"{p}panel": f"SELECT '{tf}' AS timeframe, w.symbol, CASE WHEN h.symbol IS NULL THEN 'not enough candles' END AS err, h.direction, CASE WHEN h.aligned >= 2 AND NOT h.opening THEN h.aligned END AS param_tier, coalesce(index_direction = h.direction, true) AS index_agrees, h.signal_confirmed, h.close FROM watchlist w LEFT JOIN {p}sig h ON w.symbol = h.symbol JOIN {p}idx ON true",
    }


CTES["h60day"] = resampled("bars60", "day")
CTES |= indicators("e_", "h60day", 12, 26)  # daily buckets of 60-minute bars
CTES["idx15"] = bars_of("(SELECT * REPLACE ('IDX' AS symbol) FROM ticks)", "15minute")
CTES["idx4h"], CTES["b4day"] = resampled("idx60", "4hour"), resampled("bars4h", "day")
CTES |= indicators("k_", "bars4h", 12, 26) | indicators("kd_", "b4day", 12, 26) | indicators("ki_", "idx4h", 12, 26) | indicators("qi_", "idx15", 3, 8)
CTES |= framed("fh_", "h_ind", "e_ind", "i_ind", "60minute") | framed("fq_", "q_ind", "f_ind", "qi_ind", "15minute") | framed("fk_", "k_ind", "kd_ind", "ki_ind", "4hour")
CTES |= indicators("x_", "idx3", 5, 13, 7)
CTES |= indicators("y_", "bars15m3", 5, 13)


def query(body: str) -> str:
    """body with the common table expressions that it needs, in order."""
    need: dict[str, None] = {}

    def visit(sql: str, own: str = "") -> None:
        for name in re.findall(r"\b(?:FROM|JOIN) \(?([a-z_]\w*)", sql):
            if name in CTES and name != own and name not in need:
                visit(CTES[name], name)
                need[name] = None

    visit(body)
    parts = ", ".join(f"{n} AS ({CTES[n]})" for n in need)
    return f"WITH RECURSIVE {parts} {body}" if parts else body


def ts(c: str = "ts") -> str:
    return f"CAST(floor(epoch({c})) AS BIGINT) AS {c.split('.')[-1]}"
