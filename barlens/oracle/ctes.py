"""Named building blocks of the oracle SQL; ``with_ctes`` adds those a query mentions."""

from __future__ import annotations

import re

from ..vocab import (
    ADX, BAND, CONDITION, CONTEXT, CONTEXT_POINTS, EMA50, EMA50_POINTS, MACD, MACD_POINTS, MOMENTUM,
    NO_STRUCTURE, RSI_ZONES, STATES, STRENGTH, STRENGTH_POINTS, STRUCTURE_POINTS, TREND,
    TREND_POINTS, VOLUME_LEVELS, WIDTH,
)

H = (1, 2, 3, 5, 7, 20)
X = (3, 5, 7)
OUT = (
    [f"fwd_return_{h}d" for h in H]
    + [f"fwd_abnormal_{h}d" for h in H]
    + [f"mfe_{h}d" for h in X]
    + [f"mae_{h}d" for h in X]
)
RESEARCH = ["event_category", "event_description", "source", "verification_status", "notes"]
CTES: dict[str, str] = {}
W = "PARTITION BY ticker ORDER BY date"


def prev(n: int) -> str:
    return f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def last(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def nxt(n: int) -> str:
    return f"({W} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


def full(agg: str, x: str, frame: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {agg}({x}) OVER {frame} END"


def apart(x: str, y: str, size: str = "") -> str:
    """The difference, 0 where it is rounding noise: one part in 1e11 of the size."""
    size = size or f"greatest(abs({x}), abs({y}))"
    return f"CASE WHEN abs({x} - {y}) <= 1e-11 * abs({size}) THEN 0e0 ELSE {x} - {y} END"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_ctes(body: str) -> str:
    """The statement with every CTE it needs, in dependency order."""
    order: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name in order or name in open_names:
                continue
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                open_names.add(name)
                visit(CTES[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    parts = [f"{n} AS {'' if n.endswith('_rec') else 'MATERIALIZED '}({CTES[n]})" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


# ---- bars -------------------------------------------------------------------------
LINE_TICKER = "l_returnflag || l_linestatus || CASE WHEN l_suppkey > 10 THEN CAST((l_suppkey - 1) // 10 AS VARCHAR) ELSE '' END"
CTES["daily"] = f"""
SELECT {LINE_TICKER} AS ticker,
  CAST(l_shipdate AS DATE) + CASE isodow(l_shipdate) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS date,
  sum(CAST(round(l_discount * 100) AS BIGINT) - 5) AS step, sum(l_quantity) AS volume,
  max(l_quantity) AS qmax, min(l_quantity) AS qmin
FROM lineitem GROUP BY 1, 2"""
CTES["path"] = f"""
SELECT *, round(100 * exp((CASE WHEN ticker = 'MKT' THEN 0.0008e0 ELSE 0.002e0 END)
  * CAST(sum(step) OVER ({W}) AS DOUBLE)), 4) AS close
FROM (SELECT * FROM daily UNION ALL
  SELECT 'MKT', date, sum(step), sum(volume), max(qmax), min(qmin)
  FROM daily WHERE day(date) <> 13 GROUP BY date)"""
CTES["all_bars"] = f"""
SELECT ticker, date, open, round(greatest(open, close) * (1 + 0.00021347e0 * qmax), 4) AS high,
  round(least(open, close) * (1 - 0.00021347e0 * qmin), 4) AS low, close,
  round(close * power(0.99e0, 2001 - year(date)), 4) AS adj_close, volume
FROM (SELECT *, coalesce(lag(close) OVER ({W}), 100e0) AS open FROM path)"""
CTES["bars"] = "SELECT * FROM all_bars WHERE ticker <> 'MKT'"
CTES["bench"] = "SELECT date, adj_close AS benchmark_price FROM all_bars WHERE ticker = 'MKT'"
CTES["nobench"] = "SELECT date, CAST(NULL AS DOUBLE) AS benchmark_price FROM all_bars WHERE false"
CTES["old_bars"] = "SELECT * FROM bars WHERE date <= DATE '2000-12-31'"
CTES["old_bench"] = "SELECT * FROM bench WHERE date <= DATE '2000-12-31'"
CTES["dirty"] = """
SELECT ticker, date, open, CASE WHEN day(date) = 17 THEN low * 0.9e0 ELSE high END AS high, low,
  CASE WHEN day(date) <> 7 THEN close END + bump AS close,
  CASE WHEN NOT (ticker = 'RO' AND date = DATE '2000-06-01') THEN adj_close END AS adj_close,
  CASE WHEN day(date) = 9 THEN -volume WHEN day(date) = 11 THEN 0 WHEN day(date) <> 19 THEN volume END AS volume,
  seq AS ingest_seq
FROM bars, (VALUES (CAST(1 AS BIGINT), 0e0), (CAST(2 AS BIGINT), 0.01e0)) v(seq, bump)
WHERE NOT (month(date) = 3 AND year(date) = 2000) AND (seq = 1 OR day(date) = 5)"""
CTES["deduped"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY ingest_seq DESC) AS rn,
  count(*) OVER (PARTITION BY ticker, date) AS copies FROM dirty) WHERE rn = 1"""
CTES["cleaned"] = """
SELECT ticker, date, open, high, low, close, adj_close, CASE WHEN volume >= 0 THEN volume END AS volume
FROM deduped WHERE close > 0"""


# ---- statistics ---------------------------------------------------------------------
def _priced(src: str) -> str:
    return f"""
SELECT * EXCLUDE (okay), CASE WHEN okay THEN 'adj_close' ELSE 'close' END AS price_column,
  CASE WHEN okay THEN adj_close ELSE close END AS price
FROM (SELECT *, bool_and(coalesce(adj_close > 0, false)) OVER (PARTITION BY ticker) AS okay FROM {src})"""


CTES["priced"] = _priced("bars")


def _stats(name: str, src: str, bench: str) -> None:
    fwd = ", ".join(f"lead(price, {h}) OVER ({W}) / price - 1 AS fwd_return_{h}d" for h in H)
    fwb = ", ".join(
        f"lead(benchmark_price, {h}) OVER ({W}) / benchmark_price - 1 AS fwd_benchmark_{h}d" for h in H
    )
    ext = ", ".join(
        f"{full(f, c + ' * (price / close)', nxt(h), h)} / price - 1 AS {k}_{h}d"
        for h in X
        for k, f, c in (("mfe", "max", "high"), ("mae", "min", "low"))
    )
    CTES[f"{name}_a"] = f"""
SELECT p.*, benchmark_price, row_number() OVER ({W}) AS session,
  price / lag(price) OVER ({W}) - 1 AS daily_return, ln(price / lag(price) OVER ({W})) AS log_return,
  price / lag(price, 5) OVER ({W}) - 1 AS return_5d, price / lag(price, 20) OVER ({W}) - 1 AS return_20d,
  {full("avg", "close", last(20), 20)} AS ma_20, {full("avg", "close", last(50), 50)} AS ma_50,
  price / max(price) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown,
  benchmark_price / lag(benchmark_price) OVER ({W}) - 1 AS benchmark_return,
  {full("avg", "volume", prev(20), 20)} AS avg_volume, {full("stddev_samp", "volume", prev(20), 20)} AS volume_std,
  {fwd}, {fwb}, {ext}
FROM ({_priced(src)}) p LEFT JOIN {bench} USING (date)"""
    fab = ", ".join(f"fwd_return_{h}d - fwd_benchmark_{h}d AS fwd_abnormal_{h}d" for h in H)
    CTES[f"{name}_b"] = f"""
SELECT *, {full("avg", "daily_return", prev(60), 60)} AS rolling_mean_return,
  {full("stddev_samp", "daily_return", prev(60), 60)} AS rolling_std_return,
  {full("stddev_samp", "daily_return", last(20), 20)} * sqrt(252e0) AS rolling_volatility,
  volume / CASE WHEN avg_volume > 0 THEN avg_volume END AS volume_ratio,
  (volume - avg_volume) / CASE WHEN volume_std > 1e-9 * avg_volume THEN volume_std END AS volume_zscore,
  daily_return - benchmark_return AS abnormal_return, {fab},
  min(CASE WHEN price IS NOT NULL AND benchmark_price IS NOT NULL THEN date END) OVER (PARTITION BY ticker) AS start_day
FROM {name}_a"""
    CTES[name] = f"""
SELECT *, (daily_return - rolling_mean_return)
    / CASE WHEN rolling_std_return > 1e-12 THEN rolling_std_return END AS return_zscore,
  CASE WHEN date >= start_day THEN price / p0 - 1 END AS cum_return,
  CASE WHEN date >= start_day THEN benchmark_price / b0 - 1 END AS benchmark_cum_return,
  CASE WHEN date >= start_day THEN (price / p0) / (benchmark_price / b0) - 1 END AS relative_performance
FROM (SELECT *, max(CASE WHEN date = start_day THEN price END) OVER (PARTITION BY ticker) AS p0,
  max(CASE WHEN date = start_day THEN benchmark_price END) OVER (PARTITION BY ticker) AS b0 FROM {name}_b)"""


_stats("plain", "bars", "nobench")
_stats("stats", "bars", "bench")
_stats("old_stats", "old_bars", "old_bench")


# ---- events ---------------------------------------------------------------------------
def _events(name: str, src: str, z: float, v: float) -> None:
    CTES[name] = f"""
SELECT ticker, date AS event_date, session, close, daily_return, return_zscore, volume, avg_volume,
  volume_ratio, volume_zscore, CASE WHEN benchmark_return IS NOT NULL THEN 'MKT' END AS benchmark,
  benchmark_return, abnormal_return, {", ".join(OUT)},
  CASE WHEN daily_return > 0 THEN 'up' WHEN daily_return < 0 THEN 'down' ELSE 'flat' END AS direction,
  pe AS is_price_event, ve AS is_volume_event,
  CASE WHEN pe AND ve THEN 'return_zscore,volume_ratio' WHEN pe THEN 'return_zscore' ELSE 'volume_ratio' END AS trigger_rules,
  CASE WHEN pe AND ve THEN 'Abnormal price move with abnormal volume'
    WHEN pe THEN 'Abnormal price move (volume not flagged)'
    ELSE 'Abnormal volume (price move not flagged)' END AS anomaly_type,
  session - lag(session) OVER ({W}) AS trading_days_since_prev_event,
  'Unknown' AS event_category, CAST(NULL AS VARCHAR) AS event_description, CAST(NULL AS VARCHAR) AS source,
  'Unverified' AS verification_status, CAST(NULL AS VARCHAR) AS notes
FROM (SELECT *, coalesce(abs(return_zscore) >= {z}, false) AS pe, coalesce(volume_ratio >= {v}, false) AS ve FROM {src})
WHERE pe OR ve"""


_events("found", "stats", 2.5, 2.0)
_events("found_plain", "plain", 2.5, 2.0)
_events("found_low", "plain", 1.5, 1.5)
_events("found_old", "old_stats", 2.5, 2.0)
CTES["stored"] = """
SELECT * EXCLUDE (session) REPLACE (
  CASE WHEN day(event_date) % 10 = 3 THEN 'Product news' ELSE event_category END AS event_category,
  CASE WHEN day(event_date) % 10 = 3 THEN 'Researched manually' ELSE verification_status END AS verification_status,
  CASE WHEN day(event_date) % 10 = 3 THEN 'checked' ELSE notes END AS notes)
FROM found_old"""
CTES["owner"] = f"""
SELECT l_orderkey AS o_orderkey, min(struct_pack(price := l_extendedprice, ticker := {LINE_TICKER})).ticker AS ticker
FROM lineitem GROUP BY 1"""
CTES["releases"] = """
SELECT ticker, release_time, eps_estimate, reported_eps,
  round((reported_eps / CASE WHEN eps_estimate <> 0 THEN eps_estimate END - 1) * 100, 2) AS surprise_pct
FROM (SELECT *, round(eps_estimate * (0.8e0 + 0.04e0 * (o_orderkey % 11)), 2) AS reported_eps,
    row_number() OVER (PARTITION BY ticker, release_time ORDER BY o_orderkey) AS copy
  FROM (SELECT *, round(o_totalprice / 100000, 2) AS eps_estimate,
      o_orderdate + to_hours(CAST(o_orderkey % 21 + 3 AS INTEGER)) AS release_time
    FROM orders JOIN owner USING (o_orderkey)))
WHERE copy = 1"""
CTES["reaction"] = """
SELECT r.*, (SELECT min(b.date) FROM bars b WHERE b.ticker = r.ticker
   AND b.date >= CAST(r.release_time AS DATE) + CASE WHEN hour(r.release_time) >= 16 THEN 1 ELSE 0 END) AS reaction_date
FROM releases r"""
CTES["reaction_no"] = """
SELECT r.*, n.session AS reaction_session FROM reaction r
LEFT JOIN plain n ON n.ticker = r.ticker AND n.date = r.reaction_date"""


def _windows(name: str, days: int) -> None:
    CTES[name] = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT r.ticker, n.session, n.date, r.release_time, r.eps_estimate, r.reported_eps, r.surprise_pct,
    n.session - r.reaction_session AS "offset",
    row_number() OVER (PARTITION BY r.ticker, n.session ORDER BY r.release_time) AS rn
  FROM reaction_no r JOIN plain n ON n.ticker = r.ticker
    AND n.session BETWEEN r.reaction_session AND r.reaction_session + {days}) WHERE rn = 1"""


_windows("windows1", 1)
_windows("windows3", 3)


def _money(c: str, suffix: str = "") -> str:
    return f"CASE WHEN {c} IS NULL THEN 'not available' ELSE format('{{:.2f}}', {c}) || '{suffix}' END"


CTES["events_m"] = f"""
SELECT f.* REPLACE (
  CASE WHEN w.session IS NOT NULL THEN 'Earnings release (date match)' ELSE event_category END AS event_category,
  CASE WHEN w.session IS NOT NULL THEN 'provider earnings calendar' END AS source,
  CASE WHEN w.session IS NOT NULL THEN 'Unverified (automatic date match)' ELSE verification_status END AS verification_status,
  CASE WHEN w.session IS NOT NULL THEN 'Earnings release dated ' || strftime(release_time, '%Y-%m-%d %H:%M')
    || ' (New York time); this event occurred '
    || CASE WHEN "offset" = 0 THEN 'on the first trading session that could react to the release'
       ELSE "offset" || ' trading day(s) after the first trading session that could react to the release' END
    || '. Reported EPS ' || {_money('reported_eps')} || ', EPS estimate ' || {_money('eps_estimate')}
    || ', surprise ' || {_money('surprise_pct', '%')}
    || '. Date match only - the cause of the move has not been verified.' END AS event_description)
FROM found f LEFT JOIN windows1 w ON w.ticker = f.ticker AND w.session = f.session"""

# ---- indicators -------------------------------------------------------------------------
CTES["adj"] = f"""
SELECT ticker, date, row_number() OVER ({W}) AS pos, price_column, volume, benchmark_price,
  open * f AS open, coalesce(high * f, close * f) AS high, coalesce(low * f, close * f) AS low, close * f AS close
FROM (SELECT *, CASE WHEN price_column = 'adj_close' THEN adj_close / close ELSE 1e0 END AS f FROM priced)
LEFT JOIN bench USING (date)"""
CTES["moves"] = f"""
SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range,
  CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS trx,
  CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain,
  CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss,
  CASE WHEN ph IS NOT NULL THEN CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END END AS pdm,
  CASE WHEN pl IS NOT NULL THEN CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END END AS mdm
FROM (SELECT *, lag(close) OVER ({W}) AS pc, lag(high) OVER ({W}) AS ph, lag(low) OVER ({W}) AS pl FROM adj)"""
_WILDER = {  # name: (input, period, seed position)
    "g6": ("gain", 6, 7), "l6": ("loss", 6, 7), "g14": ("gain", 14, 15), "l14": ("loss", 14, 15),
    "atr": ("true_range", 14, 14), "strx": ("trx", 14, 15), "spdm": ("pdm", 14, 15), "smdm": ("mdm", 14, 15),
}
_SPANS = (9, 12, 21, 26, 50, 200, 250)
CTES["seeded"] = "SELECT *, " + ", ".join(
    f"avg({x}) OVER {last(p)} AS seed_{n}" for n, (x, p, _) in _WILDER.items()
) + " FROM moves"
_wilder_start = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in _WILDER)
_ema_step = ", ".join(f"{2 / (s + 1)!r}e0 * m.close + {1 - 2 / (s + 1)!r}e0 * r.e{s} AS e{s}" for s in _SPANS)
_wilder_step = ", ".join(
    f"CASE WHEN m.pos = {at} THEN m.seed_{n} WHEN m.pos > {at} THEN (r.{n} * {p - 1} + m.{x}) / {p} END AS {n}"
    for n, (x, p, at) in _WILDER.items()
)
CTES["avg_rec"] = f"""
SELECT ticker, pos, {", ".join(f"close AS e{s}" for s in _SPANS)}, {_wilder_start} FROM seeded WHERE pos = 1
UNION ALL
SELECT m.ticker, m.pos, {_ema_step}, {_wilder_step}
FROM avg_rec r JOIN seeded m ON m.ticker = r.ticker AND m.pos = r.pos + 1"""
_rsi = lambda p: (
    f"CASE WHEN g{p} IS NOT NULL THEN CASE WHEN l{p} > 0 THEN 100 - 100 / (1 + g{p} / l{p}) "
    f"WHEN g{p} > 0 THEN 100e0 ELSE 50e0 END END AS rsi{p}"
)
CTES["level1"] = f"""
SELECT *, CASE WHEN plus_di + minus_di > 0 THEN 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END AS dx
FROM (SELECT s.*, {", ".join(f"CASE WHEN pos >= {s} THEN e{s} END AS ema{s}" for s in (9, 21, 50, 200, 250))},
  {_rsi(6)}, {_rsi(14)}, CASE WHEN pos >= 26 THEN {apart("e12", "e26")} END AS macd, atr,
  CASE WHEN strx > 0 THEN 100 * spdm / strx END AS plus_di, CASE WHEN strx > 0 THEN 100 * smdm / strx END AS minus_di
  FROM seeded s JOIN avg_rec USING (ticker, pos))"""
CTES["dx_seed"] = f"""
SELECT *, min(CASE WHEN cnt = 14 THEN pos END) OVER (PARTITION BY ticker) AS dx_pos
FROM (SELECT ticker, pos, macd, dx, avg(dx) OVER {last(14)} AS seed_dx, count(dx) OVER {last(14)} AS cnt FROM level1)"""
CTES["second_rec"] = """
SELECT ticker, pos, CAST(NULL AS DOUBLE) AS macd_signal, CAST(NULL AS DOUBLE) AS adx FROM dx_seed WHERE pos = 1
UNION ALL
SELECT m.ticker, m.pos,
  CASE WHEN m.pos = 26 THEN m.macd WHEN m.pos > 26 THEN 0.2e0 * m.macd + 0.8e0 * r.macd_signal END,
  CASE WHEN m.pos = m.dx_pos THEN m.seed_dx
    WHEN m.pos > m.dx_pos THEN CASE WHEN m.dx IS NULL THEN r.adx ELSE (r.adx * 13 + m.dx) / 14 END END
FROM second_rec r JOIN dx_seed m ON m.ticker = r.ticker AND m.pos = r.pos + 1"""
_ret = ", ".join(f"close / lag(close, {n}) OVER ({W}) - 1 AS ta_return_{n}d" for n in (1, 2, 3, 5, 7, 10, 20))
_rel = ", ".join(
    f"close / lag(close, {n}) OVER ({W}) - 1 - (benchmark_price / lag(benchmark_price, {n}) OVER ({W}) - 1) AS rel_{n}d"
    for n in (1, 2, 5, 7, 20)
)
_ext = ", ".join(
    f"{full('max', 'high', last(n), n)} AS high{n}, {full('min', 'low', last(n), n)} AS low{n}" for n in (20, 60)
)
CTES["level2"] = f"""
SELECT t.* EXCLUDE (macd_signal), CASE WHEN pos >= 34 THEN macd_signal END AS macd_signal,
  CASE WHEN pos >= 34 THEN {apart("macd", "macd_signal", "close")} END AS macd_hist,
  {", ".join(f"ema{n} / lag(ema{n}, 3) OVER ({W}) - 1 AS ema{n}_slope" for n in (9, 21, 50))},
  {_ret}, {_rel}, {_ext}, {full("max", "high", prev(20), 20)} AS prior_high20, {full("min", "low", prev(20), 20)} AS prior_low20,
  atr / close * 100 AS atr_pct, (close - lag(close, 5) OVER ({W})) / CASE WHEN atr <> 0 THEN atr END AS move_5d_atr,
  {full("avg", "close", last(20), 20)} AS bb_mid, {full("stddev_pop", "close", last(20), 20)} AS bb_std,
  {full("avg", "volume", last(20), 20)} AS mavol20, {full("avg", "volume", last(10), 10)} AS mavol10,
  {full("avg", "volume", last(5), 5)} AS avg_volume_5d,
  sum(coalesce(sign(close - pc), 0) * coalesce(volume, 0)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv,
  CASE WHEN count(volume) OVER {last(20)} = 20 AND sum(volume) OVER {last(20)} > 0
    THEN sum((high + low + close) / 3 * volume) OVER {last(20)} / sum(volume) OVER {last(20)} END AS vwap20
FROM (SELECT * FROM level1 JOIN second_rec USING (ticker, pos)) t"""
CTES["level3"] = f"""
SELECT *, bb_mid + 1.8e0 * bb_std AS bb_upper, bb_mid - 1.8e0 * bb_std AS bb_lower,
  volume / CASE WHEN mavol20 > 0 THEN mavol20 END AS ta_volume_ratio,
  avg_volume_5d / CASE WHEN mavol20 > 0 THEN mavol20 END AS volume_5d_vs_mavol20,
  {full("stddev_samp", "ta_return_1d", last(20), 20)} * sqrt(252e0) AS rv20,
  {full("stddev_samp", "ta_return_1d", last(60), 60)} * sqrt(252e0) AS rv60,
  CASE WHEN count(rel_1d) OVER {prev(60)} >= 40 THEN stddev_samp(rel_1d) OVER {prev(60)} END AS rel_daily_sigma,
  CASE WHEN count(obv) OVER {last(10)} = 10 THEN regr_slope(obv, pos) OVER {last(10)} END
    / CASE WHEN mavol10 > 0 THEN mavol10 END AS obv_slope10,
  CASE WHEN count(obv) OVER {last(20)} = 20 THEN regr_slope(obv, pos) OVER {last(20)} END
    / CASE WHEN mavol20 > 0 THEN mavol20 END AS obv_slope20
FROM level2"""
CTES["level4"] = """
SELECT *, (close - bb_lower) / CASE WHEN bb_upper - bb_lower > 0 THEN bb_upper - bb_lower END AS bb_pct_b,
  (bb_upper - bb_lower) / CASE WHEN bb_mid > 0 THEN bb_mid END AS bb_width FROM level3"""


def percentile(x: str, window: int, least: int) -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER {prev(window)} >= {least} THEN 100e0 * "
        f"(len(list_filter(list({x}) OVER {prev(window)}, lambda v: v <= {x} + abs({x}) * 1e-12)) / "
        f"CAST(count({x}) OVER {prev(window)} AS DOUBLE)) END"
    )


CTES["ind"] = f"""
SELECT *, bb_width / lag(bb_width, 5) OVER ({W}) - 1 AS bb_width_change,
  {percentile("bb_width", 126, 60)} AS bb_width_percentile, {percentile("atr_pct", 252, 126)} AS atr_pct_percentile
FROM level4"""

# ---- labels --------------------------------------------------------------------------------
GAPS = {"ema": apart("ema9", "ema21"), "rsi": apart("rsi6", "rsi14"), "macd": "macd_hist"}


def _cross(name: str) -> str:
    return f"""CASE WHEN {name}_gap > 0 AND least({name}_g1, {name}_g2, {name}_g3) <= 0 THEN 1
  WHEN {name}_gap < 0 AND greatest({name}_g1, {name}_g2, {name}_g3) >= 0 THEN -1 ELSE 0 END"""


def _age(name: str) -> str:
    g = [f"sign({name}_gap)"] + [f"sign({name}_g{k})" for k in (1, 2, 3)]
    known = " AND ".join(f"{x} IS NOT NULL" for x in g)
    ages = " ".join(f"WHEN {g[k]} <> {g[k + 1]} THEN {k}" for k in range(3))
    return f"CASE WHEN {known} AND {g[0]} <> 0 THEN CASE {ages} END END"


def _ladder(x: str, rungs, lowest: str) -> str:
    steps = " ".join(f"WHEN {x} >= {b} THEN {q(t)}" for b, t in rungs)
    return f"CASE WHEN {x} IS NULL THEN 'n/a' {steps} ELSE {q(lowest)} END"


CTES["lab_in"] = "SELECT *, " + ", ".join(
    f"{gap} AS {n}_gap, " + ", ".join(f"lag({gap}, {k}) OVER ({W}) AS {n}_g{k}" for k in (1, 2, 3))
    for n, gap in GAPS.items()
) + f""",
  {apart("macd_hist", f"lag(macd_hist, 1) OVER ({W})", "close")} AS d1, {apart("macd_hist", f"lag(macd_hist, 3) OVER ({W})", "close")} AS d3,
  lag(macd_hist, 3) OVER ({W}) AS h3, min(rsi6) OVER {prev(5)} AS rsi_low5, max(rsi6) OVER {prev(5)} AS rsi_high5,
  min(bb_width_percentile) OVER {last(10)} AS squeeze10,
  CASE WHEN pos >= 5 THEN sum(CASE WHEN bb_pct_b >= 0.9 THEN 1 ELSE 0 END) OVER {last(5)} END AS top_days,
  CASE WHEN pos >= 5 THEN sum(CASE WHEN bb_pct_b <= 0.1 THEN 1 ELSE 0 END) OVER {last(5)} END AS low_days,
  (CASE WHEN ta_return_2d > 0 THEN 1 ELSE 0 END) + (CASE WHEN ta_return_3d > 0 THEN 1 ELSE 0 END)
   + (CASE WHEN ta_return_5d > 0 THEN 1 ELSE 0 END) + (CASE WHEN ta_return_7d > 0 THEN 1 ELSE 0 END) AS rises,
  (close - vwap20) / CASE WHEN atr <> 0 THEN atr END AS vwap_gap,
  (rel_5d / (CASE WHEN rel_daily_sigma > 0 THEN rel_daily_sigma END * sqrt(5e0))
   + rel_7d / (CASE WHEN rel_daily_sigma > 0 THEN rel_daily_sigma END * sqrt(7e0))) / 2 AS relative_strength_score,
  lag(close) OVER ({W}) AS was, lag(ema9) OVER ({W}) AS was9, lag(ema21) OVER ({W}) AS was21,
  {apart("rsi6", f"lag(rsi6, 3) OVER ({W})")} AS rsi6_change_3d
FROM ind"""
CTES["lab"] = f"""
SELECT *, CASE WHEN close IS NULL OR ema9 IS NULL OR ema21 IS NULL OR ema9_slope IS NULL OR ema21_slope IS NULL THEN 'n/a'
  WHEN close > ema9 AND ema9 > ema21 AND ema9_slope > 0 AND ema21_slope > 0 THEN {q(TREND.strong_up)}
  WHEN close < ema9 AND ema9 < ema21 AND ema9_slope < 0 AND ema21_slope < 0 THEN {q(TREND.strong_down)}
  WHEN ema9 > ema21 AND close > ema21 AND ema21_slope > 0 THEN {q(TREND.up)}
  WHEN ema9 < ema21 AND close < ema21 AND ema21_slope < 0 THEN {q(TREND.down)}
  WHEN close > ema9 AND ema9_slope > 0 THEN {q(TREND.improving)}
  WHEN close < ema9 AND ema9_slope < 0 THEN {q(TREND.deteriorating)} ELSE {q(TREND.mixed)} END AS trend,
  CASE WHEN close IS NULL OR ema50 IS NULL OR ema50_slope IS NULL THEN 'n/a'
  WHEN close > ema50 AND ema50_slope > 0 THEN {q(EMA50.up)}
  WHEN close < ema50 AND ema50_slope < 0 THEN {q(EMA50.down)} ELSE {q(EMA50.mixed)} END AS ema50_state,
  {_ladder("rsi6", RSI_ZONES, "Oversold")} AS rsi_zone, {_cross("rsi")} AS rsi_cross,
  coalesce(rsi_low5 < 30 AND rsi6 >= rsi_low5 + 10, false) AS rsi_recovering_oversold,
  coalesce(rsi_high5 >= 80 AND rsi6 <= rsi_high5 - 10, false) AS rsi_losing_extended,
  CASE WHEN macd_hist IS NULL OR d3 IS NULL THEN 'n/a' WHEN d1 > 0 AND d3 > 0 THEN {q(MACD.improving)}
  WHEN d1 < 0 AND d3 < 0 THEN {q(MACD.weakening)} WHEN macd_hist >= 0 THEN {q(MACD.positive)} ELSE {q(MACD.negative)} END AS macd_state,
  {_cross("macd")} AS macd_cross,
  CASE WHEN sign(macd_hist) = sign(h3) AND d3 <> 0 AND abs(macd_hist) > abs(h3) THEN 'expanding'
  WHEN sign(macd_hist) = sign(h3) AND d3 <> 0 AND abs(macd_hist) < abs(h3) THEN 'contracting' ELSE '' END AS macd_hist_trend,
  CASE WHEN macd < 0 AND d3 > 0 THEN 'below zero but improving'
  WHEN macd > 0 AND d3 < 0 THEN 'above zero but deteriorating' ELSE '' END AS macd_zero_context,
  CASE WHEN ta_return_2d IS NULL OR ta_return_3d IS NULL OR ta_return_5d IS NULL OR ta_return_7d IS NULL OR move_5d_atr IS NULL THEN 'n/a'
  WHEN rises = 4 AND move_5d_atr >= 1.5 THEN {q(MOMENTUM.strong_positive)}
  WHEN rises = 0 AND move_5d_atr <= -1.5 THEN {q(MOMENTUM.strong_negative)}
  WHEN rises >= 3 AND move_5d_atr > 0 THEN {q(MOMENTUM.positive)}
  WHEN rises <= 1 AND move_5d_atr < 0 THEN {q(MOMENTUM.negative)} ELSE {q(MOMENTUM.mixed)} END AS momentum,
  {_ladder("ta_volume_ratio", VOLUME_LEVELS, "Weak participation")} AS volume_level,
  CASE WHEN ta_return_1d IS NULL THEN 'n/a' WHEN ta_return_1d > 0 THEN 'up' WHEN ta_return_1d < 0 THEN 'down' ELSE 'flat' END AS day_direction,
  CASE WHEN vwap_gap IS NULL THEN 'n/a' WHEN vwap_gap > 0.5 THEN 'Above' WHEN vwap_gap < -0.5 THEN 'Below' ELSE 'Near' END AS vwap_position,
  CASE WHEN bb_pct_b IS NULL THEN 'n/a' WHEN bb_pct_b > 1 THEN {q(BAND.above)} WHEN bb_pct_b >= 0.9 THEN {q(BAND.near_upper)}
  WHEN bb_pct_b > 0.6 THEN {q(BAND.upper_half)} WHEN bb_pct_b >= 0.4 THEN {q(BAND.middle)}
  WHEN bb_pct_b > 0.1 THEN {q(BAND.lower_half)} WHEN bb_pct_b >= 0 THEN {q(BAND.near_lower)} ELSE {q(BAND.below)} END AS bb_position,
  CASE WHEN bb_width_change IS NULL OR bb_width_percentile IS NULL THEN 'n/a'
  WHEN bb_width_change >= 0.2 AND squeeze10 <= 20 THEN {q(WIDTH.after_squeeze)}
  WHEN bb_width_change >= 0.2 THEN {q(WIDTH.expansion)} WHEN bb_width_percentile <= 20 THEN {q(WIDTH.squeeze)}
  WHEN bb_width_change <= -0.15 THEN {q(WIDTH.contraction)} ELSE {q(WIDTH.stable)} END AS band_state,
  CASE WHEN bb_pct_b IS NULL THEN 'n/a'
  WHEN bb_pct_b >= 0.9 AND top_days >= 3 AND close > ema9 AND ema9 > ema21 AND ema21_slope > 0 THEN {q(CONTEXT.upper_walk)}
  WHEN bb_pct_b <= 0.1 AND low_days >= 3 AND close < ema9 AND ema9 < ema21 AND ema21_slope < 0 THEN {q(CONTEXT.lower_walk)}
  WHEN bb_pct_b > 1 AND ema9 > ema21 AND ema21_slope > 0 AND ta_volume_ratio >= 1 THEN {q(CONTEXT.upper_push)}
  WHEN bb_pct_b > 1 THEN {q(CONTEXT.upper_extension)}
  WHEN bb_pct_b < 0 AND ema9 < ema21 AND ema21_slope < 0 AND ta_volume_ratio >= 1 THEN {q(CONTEXT.lower_push)}
  WHEN bb_pct_b < 0 THEN {q(CONTEXT.lower_extension)} ELSE {q(CONTEXT.none)} END AS band_context,
  {_ladder("atr_pct_percentile", ((95, "Extreme"), (80, "High"), (60, "Elevated"), (20, "Normal")), "Low")} AS volatility,
  CASE WHEN relative_strength_score IS NULL THEN 'n/a' WHEN relative_strength_score >= 1.25 THEN {q(STRENGTH.strong_out)}
  WHEN relative_strength_score >= 0.5 THEN {q(STRENGTH.out)} WHEN relative_strength_score > -0.5 THEN {q(STRENGTH.neutral)}
  WHEN relative_strength_score > -1.25 THEN {q(STRENGTH.under)} ELSE {q(STRENGTH.strong_under)} END AS relative_strength,
  CASE WHEN adx IS NULL THEN 'n/a' WHEN adx >= 25 THEN {q(ADX.trending)} WHEN adx < 20 THEN {q(ADX.weak)} ELSE {q(ADX.borderline)} END AS adx_state,
  {_age("ema")} AS ema_cross_age, {_age("rsi")} AS rsi_cross_age, {_age("macd")} AS macd_cross_age,
  {_cross("ema")} AS ema_cross,
  coalesce(close > prior_high20, false) AS broke_up, coalesce(close < prior_low20, false) AS broke_down,
  coalesce(ema9 > ema21 AND ema21_slope > 0 AND ta_return_3d < 0 AND close > ema21, false) AS pulled,
  coalesce(abs(close - ema9) / CASE WHEN atr <> 0 THEN atr END <= 0.5, false) AS at9,
  coalesce(abs(close - ema21) / CASE WHEN atr <> 0 THEN atr END <= 0.5, false) AS at21,
  coalesce(abs(close - ema21) < abs(close - ema9), false) AS nearer21
FROM lab_in"""
_STATE_SQL = {
    "breakout_volume": "broke_up AND ta_volume_ratio >= 1.5",
    "breakout_normal": "broke_up AND ta_volume_ratio >= 0.8 AND ta_volume_ratio < 1.5",
    "breakout_weak": "broke_up AND ta_volume_ratio < 0.8",
    "breakdown_volume": "broke_down AND ta_volume_ratio >= 1.5",
    "breakdown": "broke_down AND NOT coalesce(ta_volume_ratio >= 1.5, false)",
    "losing_ema21": "close < ema21 AND was >= was21",
    "reclaiming_ema21": "close > ema21 AND was <= was21",
    "ema_cross_down": "ema_cross = -1",
    "ema_cross_up": "ema_cross = 1",
    "pullback_ema9": "pulled AND at9 AND NOT (at21 AND nearer21)",
    "pullback_ema21": "pulled AND at21 AND NOT (pulled AND at9 AND NOT (at21 AND nearer21))",
    "pullback": "pulled AND NOT at9 AND NOT at21 AND close < ema9",
    "losing_ema9": "close < ema9 AND was >= was9",
    "reclaiming_ema9": "close > ema9 AND was <= was9",
    "near_breakout": "NOT broke_up AND prior_high20 - close >= 0 AND prior_high20 - close <= atr",
    "momentum_deterioration": "ema9 > ema21 AND rsi6_change_3d <= -20 AND d3 < 0",
    "ema_compression": "abs(ema9 - ema21) <= 0.3 * atr",
    "volatility_squeeze": "bb_width_percentile <= 20",
    "range": "high20 - low20 <= 4 * atr AND adx < 20",
    "bull_stack": "close > ema9 AND ema9 > ema21",
    "bear_stack": "close < ema9 AND ema9 < ema21",
}
CTES["states_b"] = "SELECT *, " + ", ".join(
    f"coalesce({_STATE_SQL[k]}, false) AS is_{k}" for k in STATES
) + " FROM lab"
CTES["states_s"] = (
    "SELECT *, CASE "
    + " ".join(f"WHEN is_{k} THEN {q(t)}" for k, t in STATES.items())
    + f" ELSE {q(NO_STRUCTURE)} END AS structure, concat_ws('|', "
    + ", ".join(f"CASE WHEN is_{k} THEN {q(t)} END" for k, t in STATES.items())
    + ") AS states FROM states_b"
)


def _map(x: str, table: dict, absent: str = "") -> str:
    steps = " ".join(f"WHEN {q(k)} THEN {v}e0" for k, v in table.items())
    return f"CASE {x} {steps} {absent} END"


CTES["swing_p"] = f"""
SELECT *, CASE WHEN known THEN {_map("structure", STRUCTURE_POINTS, "ELSE 0e0")} END AS points_structure,
  CASE WHEN known THEN {_map("trend", TREND_POINTS)} END AS points_trend,
  CASE WHEN known THEN (CASE WHEN ta_volume_ratio >= 2 THEN 2e0 WHEN ta_volume_ratio >= 1.5 THEN 1e0 ELSE 0e0 END)
    * coalesce(sign(ta_return_1d), 0) END AS points_volume,
  CASE WHEN known THEN CASE WHEN rsi6 >= 60 AND rsi6 >= rsi14 THEN 1e0 WHEN rsi6 < 40 AND rsi6 <= rsi14 THEN -1e0 ELSE 0e0 END END AS points_rsi,
  CASE WHEN known THEN {_map("macd_state", MACD_POINTS)} END AS points_macd,
  CASE WHEN known THEN {_map("band_context", CONTEXT_POINTS, "ELSE 0e0")} END AS points_boll,
  CASE WHEN known THEN {_map("relative_strength", STRENGTH_POINTS, "ELSE 0e0")} END AS points_relative_strength,
  CASE WHEN known THEN {_map("ema50_state", EMA50_POINTS, "ELSE 0e0")} END AS points_ema50
FROM (SELECT *, trend <> 'n/a' AND macd_state <> 'n/a' AND rsi6 IS NOT NULL AS known FROM states_s)"""
CTES["tech"] = f"""
SELECT *, CASE WHEN NOT known THEN 'n/a'
  WHEN swing_score >= 6 AND trend IN ({q(TREND.strong_up)}, {q(TREND.up)}) THEN {q(CONDITION.strong)}
  WHEN swing_score <= -6 AND trend IN ({q(TREND.strong_down)}, {q(TREND.down)}) THEN {q(CONDITION.weak)}
  WHEN swing_score >= 2 THEN {q(CONDITION.improving)} WHEN swing_score <= -2 THEN {q(CONDITION.weakening)}
  ELSE {q(CONDITION.mixed)} END AS swing_condition
FROM (SELECT *, points_structure + points_trend + points_volume + points_rsi + points_macd + points_boll
  + points_relative_strength + points_ema50 AS swing_score FROM swing_p)"""
CTES["tech_last"] = "SELECT * FROM tech QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1"

# ---- levels -------------------------------------------------------------------------------------
_centre = f"({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
CTES["pivots"] = f"""
SELECT *, coalesce(count(high) OVER {_centre} = 7 AND high = max(high) OVER {_centre}, false) AS is_swing_high,
  coalesce(count(low) OVER {_centre} = 7 AND low = min(low) OVER {_centre}, false) AS is_swing_low,
  row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS from_end FROM adj"""
_extremes = " UNION ALL ".join(
    f"SELECT ticker, {c}, {q(n)}, {120 + k} FROM tech_last WHERE {c} IS NOT NULL"
    for k, (c, n) in enumerate((("high20", "20D high"), ("low20", "20D low"), ("high60", "60D high"), ("low60", "60D low")))
)
CTES["cands"] = f"""
SELECT ticker, high AS price, 'swing high ' || strftime(date, '%Y-%m-%d') AS origin, (60 - from_end) * 2 AS ordinal
FROM pivots WHERE is_swing_high AND from_end <= 60
UNION ALL SELECT ticker, low, 'swing low ' || strftime(date, '%Y-%m-%d'), (60 - from_end) * 2 + 1
FROM pivots WHERE is_swing_low AND from_end <= 60
UNION ALL {_extremes}"""
CTES["pool"] = """
SELECT *, row_number() OVER (PARTITION BY ticker, side ORDER BY CASE WHEN side = 'resistance' THEN price ELSE -price END, ordinal) AS k
FROM (SELECT c.*, l.close, l.atr, CASE WHEN l.atr > 0 THEN l.atr ELSE l.close * 0.01 END AS unit,
    CASE WHEN price > close + 0.1e0 * (CASE WHEN l.atr > 0 THEN l.atr ELSE l.close * 0.01e0 END) THEN 'resistance'
    WHEN price < close - 0.1e0 * (CASE WHEN l.atr > 0 THEN l.atr ELSE l.close * 0.01e0 END) THEN 'support' END AS side
  FROM cands c JOIN tech_last l ON l.ticker = c.ticker) WHERE side IS NOT NULL"""
CTES["greedy_rec"] = """
SELECT ticker, side, k, 1 AS level_no, price AS level_price FROM pool WHERE k = 1
UNION ALL
SELECT p.ticker, p.side, p.k,
  CASE WHEN abs(g.level_price - p.price) <= 0.5 * p.unit THEN g.level_no ELSE g.level_no + 1 END,
  CASE WHEN abs(g.level_price - p.price) <= 0.5 * p.unit THEN g.level_price ELSE p.price END
FROM greedy_rec g JOIN pool p ON p.ticker = g.ticker AND p.side = g.side AND p.k = g.k + 1"""
CTES["levels"] = """
SELECT ticker, side, level_no, any_value(level_price) AS price, min_by(origin, k) AS origin,
  any_value(level_price) / any_value(close) - 1 AS distance_pct,
  CASE WHEN any_value(atr) > 0 THEN (any_value(level_price) - any_value(close)) / any_value(atr) END AS distance_atr,
  count(*) - 1 AS merged, coalesce(string_agg(CASE WHEN k > k0 THEN origin END, '|' ORDER BY k), '') AS also
FROM (SELECT p.*, g.level_no, g.level_price, min(p.k) OVER (PARTITION BY p.ticker, p.side, g.level_no) AS k0
  FROM pool p JOIN greedy_rec g USING (ticker, side, k)) WHERE level_no <= 2 GROUP BY 1, 2, 3"""

# ---- fundamentals -------------------------------------------------------------------------------
CTES["yearly"] = f"""
SELECT {LINE_TICKER} AS ticker, year(l_shipdate) AS y, round(sum(l_extendedprice), 2) AS a,
  round(sum(l_extendedprice * l_discount * 4), 2) AS b, round(sum(l_extendedprice * l_discount * 2), 2) AS c,
  round(sum(l_extendedprice * l_discount), 2) AS d, round(sum(l_tax * l_extendedprice), 2) AS e,
  round(sum(l_quantity), 2) AS f
FROM lineitem GROUP BY 1, 2"""
_ITEMS = (
    ("a", "income", "TotalRevenue", "revenue", "Revenue"),
    ("b", "income", "GrossProfit", "gross_profit", "Gross profit"),
    ("c", "income", "TotalOperatingIncomeAsReported", "operating_income", "Operating income"),
    ("d", "income", "NetIncome", "net_income", "Net income"),
    ("e", "balance", "TotalDebt", "total_debt", "Total debt"),
    ("f", "balance", "ShareIssued", "shares_outstanding", "Shares outstanding"),
)
CTES["statements"] = " UNION ALL ".join(
    f"""SELECT t.ticker, '{st}' AS statement, '{item}' AS item, make_date(yy.y, 12, 31) AS period_end, v.{c} AS value,
  '{metric}' AS metric, '{label}' AS label
FROM (SELECT DISTINCT ticker FROM yearly) t CROSS JOIN (SELECT DISTINCT y FROM yearly) yy
LEFT JOIN yearly v ON v.ticker = t.ticker AND v.y = yy.y AND NOT (v.ticker = 'RF' AND v.y = 1999)"""
    for c, st, item, metric, label in _ITEMS
)
CTES["info"] = f"""
SELECT {LINE_TICKER} AS ticker, CAST(round(sum(l_extendedprice), 2) AS DECIMAL(24, 2)) AS revenue,
  CAST(sum(l_quantity) AS BIGINT) AS shares, count(*) AS lines FROM lineitem GROUP BY 1"""
CTES["who"] = """
SELECT ticker, CASE WHEN ticker <> 'AO' THEN 'The ' || ticker ELSE 'Company ' || ticker END AS name,
  'XTST' AS exchange, CASE WHEN ticker LIKE 'A%' THEN 'Industrials' ELSE 'Energy' END AS sector,
  CAST(NULL AS VARCHAR) AS industry, CASE WHEN ticker <> 'NO' THEN 'USD' END AS currency,
  CASE WHEN ticker = 'RF' THEN 'EUR' END AS financial_currency, CAST(NULL AS VARCHAR) AS country,
  CAST(NULL AS VARCHAR) AS quote_type FROM info"""
CTES["units"] = """
SELECT *, coalesce(currency, 'currency unknown') AS trading,
  coalesce(financial_currency, currency, 'currency unknown') AS financial FROM who"""
CTES["snaps"] = """
SELECT ticker, 'snapshot' AS period_type, '2002-01-31' AS period_end, metric, label, value, unit,
  'provider, info[''' || key || ''']' AS source, '2002-01-31' AS retrieved_at
FROM (SELECT ticker, 'revenue_ttm' AS metric, 'totalRevenue' AS key, 'Revenue (trailing 12 months)' AS label,
    CAST(revenue AS DOUBLE) AS value, financial AS unit FROM info JOIN units USING (ticker)
  UNION ALL SELECT ticker, 'eps_ttm', 'trailingEps', 'EPS (trailing 12 months)', lines, financial || '/share'
  FROM info JOIN units USING (ticker)
  UNION ALL SELECT ticker, 'shares_outstanding', 'sharesOutstanding', 'Shares outstanding', shares, 'shares' FROM info)"""
CTES["annual"] = """
SELECT ticker, 'annual' AS period_type, strftime(period_end, '%Y-%m-%d') AS period_end, metric, label, value,
  CASE WHEN metric = 'shares_outstanding' THEN 'shares' ELSE financial END AS unit,
  'provider, annual ' || statement || ' statement (' || item || ')' AS source, '2002-01-31' AS retrieved_at
FROM statements JOIN units USING (ticker) WHERE value IS NOT NULL"""
CTES["ratios"] = """
SELECT ticker, 'annual' AS period_type, period_end, metric, label, value, 'ratio' AS unit,
  'Calculated from provider annual statements' AS source, '2002-01-31' AS retrieved_at
FROM (WITH y AS (SELECT ticker, period_end, max(CASE WHEN metric = 'revenue' THEN value END) AS r,
    max(CASE WHEN metric = 'gross_profit' THEN value END) AS g, max(CASE WHEN metric = 'operating_income' THEN value END) AS o,
    max(CASE WHEN metric = 'net_income' THEN value END) AS n FROM annual GROUP BY 1, 2),
  z AS (SELECT *, lag(r) OVER w AS r0, lag(period_end) OVER w AS e0 FROM y WINDOW w AS (PARTITION BY ticker ORDER BY period_end))
  SELECT ticker, period_end, 'revenue_growth' AS metric, 'Revenue growth vs. previous fiscal year (calculated)' AS label,
    r / r0 - 1 AS value FROM z WHERE r > 0 AND r0 > 0 AND CAST(period_end AS DATE) - CAST(e0 AS DATE) BETWEEN 300 AND 430
  UNION ALL SELECT ticker, period_end, 'gross_margin', 'Gross margin = gross profit / revenue (calculated)', g / r FROM z WHERE r > 0
  UNION ALL SELECT ticker, period_end, 'operating_margin', 'Operating margin = operating income / revenue (calculated)', o / r FROM z WHERE r > 0
  UNION ALL SELECT ticker, period_end, 'net_margin', 'Net margin = net income / revenue (calculated)', n / r FROM z WHERE r > 0)
WHERE value IS NOT NULL"""
CTES["funda"] = "SELECT * FROM snaps UNION ALL SELECT * FROM annual UNION ALL SELECT * FROM ratios"
CTES["funda_old"] = """
SELECT ticker, period_type, period_end, metric, value, unit, source, retrieved_at
FROM funda WHERE period_type = 'annual' AND period_end <= '2000-12-31'
UNION ALL SELECT ticker, period_type, d, metric, round(value * f, 2), unit, source, d
FROM snaps, (VALUES ('2000-06-30', 0.8e0), ('2000-12-31', 0.9e0)) v(d, f)"""
CTES["stocks_old"] = """
SELECT ticker, 'Old ' || name AS name, exchange, CAST(NULL AS VARCHAR) AS sector, industry, currency,
  'Ruritania' AS country, quote_type, '2000-12-31T00:00:00' AS first_analyzed, '2000-12-31T00:00:00' AS last_analyzed
FROM who WHERE ticker <> 'AF'"""
CTES["edited"] = """
SELECT ticker, event_date, CASE WHEN day(event_date) % 4 = 0 THEN 'Contract award' END AS n_category,
  CASE WHEN day(event_date) % 4 = 0 THEN 'Signed on the day' END AS n_description,
  CASE WHEN day(event_date) % 8 = 0 THEN 'press release' END AS n_source,
  CASE WHEN day(event_date) % 3 = 0 THEN 'Unverified' END AS n_status,
  CASE WHEN day(event_date) % 5 = 0 THEN 'see file' END AS n_notes FROM stored"""
CTES["decided"] = """
SELECT *, (s_category IS NOT NULL OR s_description IS NOT NULL OR s_source IS NOT NULL)
  AND coalesce(s_status, verification_status) IN ('Unverified', 'Unverified (automatic date match)') AS manual
FROM (SELECT s.*, CASE WHEN n_category IS DISTINCT FROM event_category THEN n_category END AS s_category,
  CASE WHEN n_description IS DISTINCT FROM event_description THEN n_description END AS s_description,
  CASE WHEN n_source IS DISTINCT FROM source THEN n_source END AS s_source,
  CASE WHEN n_status IS DISTINCT FROM verification_status
    AND verification_status IN ('Unverified', 'Unverified (automatic date match)') THEN n_status END AS s_status,
  CASE WHEN n_notes IS DISTINCT FROM notes THEN n_notes END AS s_notes
  FROM stored s JOIN edited USING (ticker, event_date))"""
