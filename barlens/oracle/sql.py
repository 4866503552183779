"""Oracle SQL per query key: the same results by another engine and other formulas."""

from __future__ import annotations

from ..plans.queries import REGISTRY
from ..vocab import SNAPSHOT_METRICS, STATEMENT_METRICS, CALCULATED_METRICS, STATES
from .ctes import OUT, RESEARCH, H, X, W, full, last, percentile, prev, q, with_ctes

SQL: dict[str, str] = {}
D = "strftime(date, '%Y-%m-%d') AS date"
E = "strftime(event_date, '%Y-%m-%d') AS event_date"


def R(columns, digits: int = 8, prefix: str = "") -> str:
    """Rounded columns; ``a=expr`` gives an expression a name."""
    out = []
    for c in columns.split() if isinstance(columns, str) else columns:
        name, _, expression = c.partition("=")
        out.append(f"round({prefix}{expression or name}, {digits}) + 0e0 AS {name}")
    return ", ".join(out)


def day(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {name or c}"


def per_session(frame: str, digits: int, plain: str = "", **queries: str) -> None:
    for key, columns in queries.items():
        SQL[key] = f"SELECT ticker, {D}, {R(columns, digits)} FROM {frame}"


def raw(key: str, text: str) -> None:
    SQL[key] = text


BAR = "open high low close adj_close volume"

# ---- sources -------------------------------------------------------------------------------
raw("read_prices_csv", f"SELECT ticker, {D}, {R('open high low close')}, CAST(NULL AS DOUBLE) AS adj_close, volume FROM bars")
raw("standardize_prices", SQL["read_prices_csv"])
raw("parse_number", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN round(o_totalprice, 2) + 0e0 END AS parsed FROM orders""")
raw("scan_prices", f"SELECT ticker, {D}, {R(BAR)} FROM bars WHERE ticker IN ('AF', 'RO')")
raw("scan_events", f"SELECT ticker, {E}, trigger_rules, event_category FROM stored WHERE ticker IN ('AF', 'NO')")
raw("scan_fundamentals", f"SELECT ticker, period_type, period_end, metric, {R('value', 8)}, unit, source, retrieved_at FROM funda_old WHERE ticker = 'NF'")
raw("scan_stock_profile", "SELECT * FROM stocks_old WHERE ticker = 'RF'")
raw("latest_price_update", "SELECT ticker, strftime(max(date), '%Y-%m-%d') || 'T18:00:00' AS latest_update FROM bars GROUP BY 1")
raw("prefer_source", f"""SELECT ticker, {D}, {R('close')}, CASE WHEN ticker LIKE 'A%' THEN 'csv' WHEN ticker LIKE 'N%' THEN 'live' ELSE 'cache' END AS price_source
FROM bars WHERE ticker LIKE 'R%' OR (ticker LIKE 'A%' AND year(date) >= 1998) OR (ticker LIKE 'N%' AND year(date) >= 1997)""")
raw("info_map_scan", """SELECT ticker, CAST(revenue AS DOUBLE) AS totalRevenue, CAST(shares AS DOUBLE) AS sharesOutstanding,
  CAST(NULL AS DOUBLE) AS forwardPE, CAST(NULL AS DOUBLE) AS trailingPE, CAST(NULL AS DOUBLE) AS ebitda FROM info""")
raw("statements_unpivot", f"SELECT ticker, statement, item, {day('period_end')}, {R('value', 2)} FROM statements")
raw("earnings_scan", f"""SELECT DISTINCT ticker, strftime(release_time, '%Y-%m-%d %H:%M:%S') AS release_time,
  {R('eps_estimate reported_eps surprise_pct')} FROM releases""")
raw("events_sink_csv", f"SELECT ticker, {E}, {R('close return_zscore volume_ratio fwd_return_20d', 6)}, trigger_rules, event_category, verification_status FROM events_m")
raw("fundamentals_sink_csv", f"SELECT ticker, period_type, period_end, metric, label, {R('value', 4)}, unit, source, retrieved_at FROM funda")
raw("analysis_json_sink", """SELECT t.ticker, 6 AS windows, e.n AS events, f.n AS fundamentals, t.trough_date FROM
 (SELECT ticker, strftime(min_by(date, (drawdown, date)), '%Y-%m-%d') AS trough_date FROM stats GROUP BY 1) t
 LEFT JOIN (SELECT ticker, count(*) AS n FROM events_m GROUP BY 1) e USING (ticker)
 LEFT JOIN (SELECT ticker, count(*) AS n FROM funda GROUP BY 1) f USING (ticker)""")

# ---- cleaning ------------------------------------------------------------------------------
raw("normalize_ticker", """SELECT p_partkey, CASE WHEN regexp_full_match(s, '[A-Z0-9^][A-Z0-9.\\-=^]{0,14}') THEN s END AS ticker
FROM (SELECT p_partkey, upper(trim(CASE p_partkey % 3 WHEN 0 THEN '  brk-' || p_partkey || ' ' WHEN 1 THEN '^x' || p_partkey ELSE p_name END)) AS s FROM part)""")
raw("dedupe_keep_last", f"SELECT ticker, {D}, {R(BAR)}, copies FROM deduped")
raw("drop_bad_close", f"SELECT ticker, {D}, {R('close')}, ingest_seq FROM dirty WHERE close > 0")
raw("min_rows_guard", f"""SELECT ticker || year(date) AS ticker, {D}, {R('close')} FROM bars
QUALIFY count(*) OVER (PARTITION BY ticker, year(date)) >= 110""")
raw("null_negative_volume", f"SELECT ticker, {D}, ingest_seq, {R('volume=CASE_V').replace('CASE_V', 'CASE WHEN volume >= 0 THEN volume END')} FROM dirty")
raw("clean_prices", f"SELECT ticker, {D}, {R(BAR)} FROM cleaned")
raw("quality_report", """SELECT ticker, CAST(sum(copies - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (close IS NULL OR close <= 0) AS bad_close_rows,
  count(*) FILTER (close > 0) AS usable_rows, count(*) FILTER (close > 0 AND volume < 0) AS negative_volume_days,
  count(*) FILTER (close > 0 AND (volume IS NULL OR volume < 0)) AS missing_volume_days,
  count(*) FILTER (close > 0 AND volume = 0) AS zero_volume_days,
  count(*) FILTER (close > 0 AND (high < low OR close > high * 1.001e0 OR close < low * 0.999e0)) AS inconsistent_ohlc_days
FROM deduped GROUP BY 1""")
raw("long_gaps", f"""SELECT ticker, count(*) AS long_gaps, array_to_string(list_slice(list(strftime(date, '%Y-%m-%d') ORDER BY date), 1, 3), '|') AS examples
FROM (SELECT *, date - lag(date) OVER ({W}) AS gap FROM cleaned) WHERE gap > 6 GROUP BY 1""")
raw("choose_price_column", f"""SELECT ticker, {D}, CASE WHEN bad = 0 THEN 'adj_close' ELSE 'close' END AS price_column,
  CASE WHEN bad > 0 THEN CASE WHEN n > bad THEN 'Adjusted close was missing on some days, so returns use the unadjusted close; dividends are not included in returns.'
    ELSE 'No adjusted close available; returns use the close price (dividends not included).' END END AS price_note,
  round(CASE WHEN bad = 0 THEN adj_close ELSE close END, 8) + 0e0 AS price
FROM (SELECT *, count(*) FILTER (adj_close IS NULL OR adj_close <= 0) OVER (PARTITION BY ticker) AS bad, count(*) OVER (PARTITION BY ticker) AS n FROM cleaned)""")
raw("trim_to_period", """SELECT ticker, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first_date, period
FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS final FROM bars),
  (VALUES ('1y', 366), ('2y', 731), ('5y', 1827), ('10y', 3653), ('ytd', -1), ('max', 1000000)) p(period, days)
WHERE CASE WHEN days < 0 THEN year(date) = year(final) ELSE final - date <= days END GROUP BY ticker, period""")
raw("stale_tickers", """SELECT ticker, strftime(max(date), '%Y-%m-%d') AS last_date, DATE '2001-11-10' - max(date) AS age_days
FROM bars WHERE NOT (ticker = 'NO' AND year(date) = 2001) GROUP BY 1 HAVING DATE '2001-11-10' - max(date) > 7""")
raw("short_history_flags", """SELECT ticker, n AS trading_days, concat_ws('|', CASE WHEN n <= 60 THEN 'no_zscore' END,
  CASE WHEN n < 250 THEN 'ema_context_incomplete' END, CASE WHEN n BETWEEN 250 AND 499 THEN 'ema_context_young' END) AS flags
FROM (SELECT ticker, count(*) AS n FROM bars WHERE year(date) >= CASE ticker WHEN 'AF' THEN 2001 WHEN 'AO' THEN 2000 WHEN 'NF' THEN 1999 ELSE 1995 END GROUP BY 1)""")
raw("event_filters", f"""SELECT ticker, {E}, {R('return_zscore volume_ratio')} FROM found
WHERE ticker IN ('AF', 'NO', 'RO') AND abs(return_zscore) >= 2 AND volume_ratio >= 1.2""")
raw("adjust_ohlcv", f"""SELECT ticker, {D}, {R('open=open*f high=coalesce(CASE/**/WHEN/**/day(date)<>21/**/THEN/**/high*f/**/END,close*f) low=low*f close=close*f', 6)},
  day(date) = 21 AS filled_high_low FROM (SELECT *, adj_close / close AS f FROM priced)""".replace("/**/", " "))

# ---- joins ----------------------------------------------------------------------------------
raw("align_benchmark", f"SELECT ticker, {D}, {R('benchmark_price')} FROM bars LEFT JOIN bench USING (date)")
raw("align_benchmark_indicators", f"SELECT ticker, {D}, {R('benchmark_price rel_5d', 7)} FROM level2")
raw("attach_outcomes", f"SELECT l.ticker, strftime(l.date, '%Y-%m-%d') AS date, {R('ema9 fwd_return_7d fwd_abnormal_7d mfe_7d', 7)} FROM level1 l JOIN stats USING (ticker, date)")
raw("reaction_day", f"""SELECT ticker, strftime(release_time, '%Y-%m-%d %H:%M:%S') AS release_time, {day('reaction_date')}, reaction_session FROM reaction_no""")
raw("earnings_windows", f"""SELECT ticker, session, {D}, strftime(release_time, '%Y-%m-%d %H:%M:%S') AS release_time, "offset" FROM windows3""")
raw("match_evidence", f"SELECT ticker, {E}, {', '.join(RESEARCH)} FROM events_m")
raw("evidence_coverage", """SELECT ticker, strftime(f, '%Y-%m-%d') AS first_session, strftime(c, '%Y-%m-%d %H:%M:%S') AS covered_from
FROM (SELECT ticker, min(date) AS f FROM bars GROUP BY 1) JOIN (SELECT ticker, min(release_time) AS c FROM releases GROUP BY 1) USING (ticker) WHERE c > f""")
raw("overlay_research", f"""SELECT e.ticker, strftime(e.event_date, '%Y-%m-%d') AS event_date,
  {', '.join(f"CASE WHEN s.ticker IS NOT NULL THEN s.{c} ELSE e.{c} END AS {c}" for c in RESEARCH)}
FROM events_m e LEFT JOIN stored s USING (ticker, event_date)""")
raw("match_import_rows", f"SELECT ticker, {E}, event_category FROM stored")
raw("unmatched_keys", "SELECT DISTINCT ticker, '1990-01-01' AS event_date FROM stored")
_fresh = ", ".join(
    R([f"{c}=CASE WHEN s.benchmark = 'MKT' THEN coalesce(n.{c}, s.{c}) ELSE s.{c} END" if "abnormal" in c else f"{c}=coalesce(n.{c}, s.{c})"])
    for c in OUT
)
raw("refresh_outcomes", f"""SELECT s.ticker, strftime(s.event_date, '%Y-%m-%d') AS event_date, {_fresh}, n.ticker IS NOT NULL AS refreshed
FROM stored s LEFT JOIN stats n ON n.ticker = s.ticker AND n.date = s.event_date""")
_labels = "CASE metric " + " ".join(
    f"WHEN {q(m)} THEN {q(label)}"
    for m, label in ({m[0]: m[3] for m in SNAPSHOT_METRICS} | {m[0]: m[4] for m in STATEMENT_METRICS} | {m[0]: m[2] for m in CALCULATED_METRICS}).items()
) + " ELSE metric END"
_live = "NOT (ticker = 'AF' AND period_type = 'snapshot') AND NOT (ticker = 'NO' AND period_type = 'annual')"
raw("fundamentals_fallback", f"""SELECT ticker, period_type, period_end, metric, label, {R('value', 4)}, unit, source, retrieved_at, from_store FROM (
SELECT *, false AS from_store FROM funda WHERE {_live}
UNION ALL SELECT ticker, period_type, period_end, metric, {_labels}, value, unit, source, retrieved_at, true FROM funda_old
WHERE (ticker = 'AF' AND period_type = 'snapshot' AND period_end = '2000-12-31') OR (ticker = 'NO' AND period_type = 'annual'))""")
_stock = ["name", "exchange", "sector", "industry", "currency", "country", "quote_type"]
raw("profile_fallback", f"""SELECT w.ticker, {', '.join(f"CASE WHEN w.ticker LIKE 'R%' THEN s.{c} ELSE w.{c} END AS {c}" for c in _stock)}
FROM who w LEFT JOIN stocks_old s USING (ticker)""")
raw("split_insert_update", """SELECT ticker, count(*) FILTER (s.event_date IS NULL) AS inserted, count(*) FILTER (s.event_date IS NOT NULL) AS updated
FROM found f LEFT JOIN (SELECT ticker, event_date FROM stored) s USING (ticker, event_date) GROUP BY 1""".replace("s.event_date", "s.event_day").replace("(SELECT ticker, event_date FROM stored) s USING (ticker, event_date)", "(SELECT ticker AS t, event_date AS event_day FROM stored) s ON s.t = f.ticker AND s.event_day = f.event_date"))

# ---- per-session statistics -------------------------------------------------------------------
per_session(
    "plain", 8,
    daily_returns="daily_return log_return",
    trailing_returns="return_5d return_20d",
    rolling_baseline="rolling_mean_return rolling_std_return",
    rolling_volatility="rolling_volatility",
    moving_averages="ma_20 ma_50",
    drawdown="drawdown",
    forward_returns=" ".join(f"fwd_return_{h}d" for h in H),
    excursions=" ".join(f"{k}_{h}d" for h in X for k in ("mfe", "mae")),
)
raw("session_number", f"SELECT ticker, {D}, session FROM plain")
per_session(
    "plain", 7,
    return_zscore="return_zscore",
    volume_baseline="avg_volume volume_std",
    volume_ratio="volume_ratio",
    volume_zscore="volume_zscore",
)
per_session(
    "stats", 8,
    benchmark_returns="benchmark_return abnormal_return",
    forward_abnormal=" ".join(f"fwd_abnormal_{h}d" for h in H),
    relative_performance="cum_return benchmark_cum_return relative_performance",
)

# ---- events ---------------------------------------------------------------------------------------
_flags = """coalesce(abs(return_zscore) >= 2, false) AS return_zscore, coalesce(abs(daily_return) >= 0.03, false) AS abs_return,
  coalesce(volume_ratio >= 1.8, false) AS volume_ratio, coalesce(volume_zscore >= 2.5, false) AS volume_zscore"""
raw("rule_flags", f"SELECT ticker, {D}, {_flags} FROM plain")
_figures = "close daily_return return_zscore volume avg_volume volume_ratio volume_zscore benchmark_return abnormal_return"
_facts = "benchmark, direction, is_price_event, is_volume_event, trigger_rules, anomaly_type, trading_days_since_prev_event"
raw("detect_events", f"SELECT ticker, {E}, {R(_figures + ' ' + ' '.join(OUT), 7)}, {_facts}, {', '.join(RESEARCH)} FROM found")
raw("anomaly_type", f"""SELECT ticker, CASE WHEN p AND v THEN 'Abnormal price move with abnormal volume'
  WHEN p THEN 'Abnormal price move (volume not flagged)' ELSE 'Abnormal volume (price move not flagged)' END AS anomaly_type,
  concat_ws(',', CASE WHEN a THEN 'return_zscore' END, CASE WHEN b THEN 'abs_return' END, CASE WHEN c THEN 'volume_ratio' END, CASE WHEN d THEN 'volume_zscore' END) AS trigger_rules, count(*) AS n
FROM (SELECT *, a OR b AS p, c OR d AS v FROM (SELECT ticker, coalesce(abs(return_zscore) >= 2, false) AS a, coalesce(abs(daily_return) >= 0.03, false) AS b,
  coalesce(volume_ratio >= 1.8, false) AS c, coalesce(volume_zscore >= 2.5, false) AS d FROM plain)) WHERE p OR v GROUP BY 1, 2, 3""")
raw("event_spacing", f"SELECT ticker, {E}, session, trading_days_since_prev_event FROM found")
raw("direction_counts", """SELECT ticker, count(*) AS total, count(*) FILTER (direction = 'up') AS up, count(*) FILTER (direction = 'down') AS down,
  count(*) FILTER (direction = 'flat') AS flat, count(*) FILTER (is_price_event AND is_volume_event) AS price_and_volume,
  count(*) FILTER (is_price_event AND NOT is_volume_event) AS price_only, count(*) FILTER (is_volume_event AND NOT is_price_event) AS volume_only,
  count(*) FILTER (event_category <> 'Unknown') AS linked, count(*) FILTER (event_category = 'Unknown') AS unknown FROM events_m GROUP BY 1""")
raw("recent_events", f"""SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY e.event_date DESC) AS rank, strftime(e.event_date, '%Y-%m-%d') AS event_date,
  {R('return_zscore', 7)}, trigger_rules, event_category FROM events_m e QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY e.event_date DESC) <= 30""")
raw("top_n_recent", f"""SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY e.event_date DESC) AS rank, strftime(e.event_date, '%Y-%m-%d') AS event_date,
  {R('daily_return', 7)} FROM found e QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY e.event_date DESC) <= 5""")
raw("largest_moves", f"""SELECT ticker, k AS rank, {E}, {R('return_zscore', 7)} FROM (SELECT *, row_number() OVER (PARTITION BY ticker
  ORDER BY round(abs(return_zscore), 12) DESC, event_date) AS k FROM found WHERE return_zscore IS NOT NULL) WHERE k <= 3""")
raw("detection_provenance", f"""SELECT ticker, {E}, '{{"events":{{"return_zscore_threshold":2.5,"volume_ratio_threshold":2.0,"volume_zscore_threshold":null,"abs_return_threshold":null,"earnings_match_window_days":1}},"statistics":{{"zscore_window":60,"volume_window":20,"volatility_window":20,"trading_days_per_year":252}}}}' AS detection_settings FROM found""")

# ---- summaries ----------------------------------------------------------------------------------------
PERF = (("1 day", 1), ("5 days", 5), ("1 month (21 trading days)", 21), ("3 months (63 trading days)", 63),
        ("6 months (126 trading days)", 126), ("1 year (252 trading days)", 252))
_perf = ", ".join(f"({q(label)}, {n})" for label, n in PERF)
_lastp = "SELECT ticker, max(session) AS n, max_by(price, date) AS p, max_by(date, date) AS d FROM plain GROUP BY 1"
raw("performance_windows", f"""SELECT l.ticker, w.label AS "window", CAST(w.n AS BIGINT) AS sessions, round(l.p / b.price - 1, 8) + 0e0 AS window_return
FROM ({_lastp}) l CROSS JOIN (VALUES {_perf}) w(label, n) LEFT JOIN plain b ON b.ticker = l.ticker AND b.session = l.n - w.n""")
raw("ytd_return", f"""SELECT l.ticker, round(l.p, 8) + 0e0 AS last_price, round(b.bp, 8) + 0e0 AS base_price, round(l.p / b.bp - 1, 8) + 0e0 AS ytd_return
FROM ({_lastp}) l LEFT JOIN (SELECT ticker, max_by(price, date) AS bp FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS f FROM plain)
  WHERE year(date) < year(f) GROUP BY 1) b USING (ticker)""")
_fullp = "SELECT ticker, min(date) AS s, max(date) AS e, count(*) AS n, max_by(price, date) / min_by(price, date) AS g FROM plain GROUP BY 1"
raw("full_period_return", f"SELECT ticker, strftime(s, '%Y-%m-%d') AS start_date, strftime(e, '%Y-%m-%d') AS end_date, n AS trading_days, round(g - 1, 8) + 0e0 AS full_period_return FROM ({_fullp})")
raw("annualised_return", f"SELECT ticker, CASE WHEN (n - 1) / 252e0 >= 1 THEN round(power(g, 252e0 / (n - 1)) - 1, 8) + 0e0 END AS annualised_return FROM ({_fullp})")
raw("range_52w", f"""SELECT ticker, {R('last_close=max_by(close,date) high_52w_close=max(close)')}, strftime(min_by(date, (-close, date)), '%Y-%m-%d') AS high_52w_date,
  {R('low_52w_close=min(close)')}, strftime(min_by(date, (close, date)), '%Y-%m-%d') AS low_52w_date, round(max_by(close, date) / max(close) - 1, 8) + 0e0 AS close_vs_52w_high
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM plain) WHERE k <= 252 GROUP BY 1""")
_lastrow = "(SELECT * FROM {f} QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)"
raw("ma_distance", f"SELECT ticker, {R('ma_20 ma_50 close_vs_ma_20=close/ma_20-1 close_vs_ma_50=close/ma_50-1')} FROM {_lastrow.format(f='plain')}")
raw("return_distribution", f"""SELECT ticker, count(*) AS observations, {R('mean=avg(daily_return) median=median(daily_return) std=stddev_samp(daily_return) skewness=skewness(daily_return) excess_kurtosis=kurtosis(daily_return) min=min(daily_return)')},
  strftime(min_by(date, (daily_return, date)), '%Y-%m-%d') AS min_date, {R('max=max(daily_return)')}, strftime(min_by(date, (-daily_return, date)), '%Y-%m-%d') AS max_date,
  round(count(*) FILTER (daily_return > 0) / CAST(count(*) AS DOUBLE), 8) + 0e0 AS share_positive_days FROM plain WHERE daily_return IS NOT NULL GROUP BY 1""")
_normal = "0.012419330651552318e0"
raw("tail_frequency", f"""SELECT ticker, n AS days_scored, k AS days_beyond_threshold, round(k / CAST(n AS DOUBLE), 8) + 0e0 AS observed_share,
  2.5e0 AS threshold, round({_normal}, 8) + 0e0 AS normal_expected_share, round(k / CAST(n AS DOUBLE) / {_normal}, 8) + 0e0 AS ratio_to_normal
FROM (SELECT ticker, count(return_zscore) AS n, count(*) FILTER (abs(return_zscore) >= 2.5) AS k FROM plain GROUP BY 1) WHERE n > 0""")
raw("volatility_summary", f"""SELECT ticker, {R('current_rolling_annualised=max_by(rolling_volatility,date) full_period_annualised=stddev_samp(daily_return)*sqrt(252e0)')},
  round(stddev_samp(daily_return) FILTER (k <= 252) * sqrt(252e0), 8) + 0e0 AS last_year_annualised, {R('daily_std=stddev_samp(daily_return)')}
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM plain) GROUP BY 1""")
raw("max_drawdown", f"""SELECT t.ticker, {R(['max_drawdown=t.dd'])}, strftime(p.pd, '%Y-%m-%d') AS drawdown_peak_date, {R(['drawdown_peak_price=p.pp'])},
  strftime(t.td, '%Y-%m-%d') AS trough_date, {R(['trough_price=t.tp'])}, strftime(r.rd, '%Y-%m-%d') AS recovery_date, {R(['current_drawdown=c.cd'])}
FROM (SELECT ticker, min(drawdown) AS dd, min_by(date, (drawdown, date)) AS td, min_by(price, (drawdown, date)) AS tp FROM plain GROUP BY 1) t
JOIN (SELECT b.ticker, max(b.price) AS pp, min_by(b.date, (-b.price, b.date)) AS pd FROM plain b
  JOIN (SELECT ticker, min_by(date, (drawdown, date)) AS td FROM plain GROUP BY 1) x ON x.ticker = b.ticker AND b.date <= x.td GROUP BY 1) p USING (ticker)
JOIN (SELECT ticker, max_by(drawdown, date) AS cd FROM plain GROUP BY 1) c USING (ticker)
LEFT JOIN (SELECT a.ticker, min(a.date) AS rd FROM plain a JOIN
   (SELECT b.ticker, any_value(x.td) AS td, max(b.price) AS pp FROM plain b
    JOIN (SELECT ticker, min_by(date, (drawdown, date)) AS td FROM plain GROUP BY 1) x ON x.ticker = b.ticker AND b.date <= x.td GROUP BY 1) y
   ON y.ticker = a.ticker AND a.date >= y.td AND a.price >= y.pp GROUP BY 1) r USING (ticker)""")
raw("volume_summary", f"SELECT ticker, {R('last_volume=volume avg_volume_previous_window=avg_volume last_volume_ratio=volume_ratio')} FROM {_lastrow.format(f='plain')}")
_pair = "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k, row_number() OVER (PARTITION BY ticker ORDER BY date) AS j FROM stats WHERE benchmark_price IS NOT NULL"
_bw = f"""SELECT l.ticker, w.label AS "window", l.price / b.price - 1 AS sr, l.benchmark_price / b.benchmark_price - 1 AS br
FROM (SELECT * FROM ({_pair}) WHERE k = 1) l CROSS JOIN (VALUES {_perf}, ('Full period', -1)) w(label, n)
LEFT JOIN ({_pair}) b ON b.ticker = l.ticker AND CASE WHEN w.n > 0 THEN b.k = w.n + 1 ELSE b.j = 1 END"""
raw("benchmark_windows", f"""SELECT ticker, "window", {R('stock_return=sr benchmark_return=br difference=sr-br')} FROM ({_bw})""")
_beta = """SELECT ticker, count(*) AS pairs, CASE WHEN count(*) > 20 THEN covar_samp(daily_return, benchmark_return) / var_samp(benchmark_return) END AS beta,
  CASE WHEN count(*) > 20 THEN corr(daily_return, benchmark_return) END AS correlation
FROM stats WHERE daily_return IS NOT NULL AND benchmark_return IS NOT NULL GROUP BY 1"""
raw("beta_correlation", f"SELECT ticker, pairs, {R('beta correlation')} FROM ({_beta})")
_abn = """SELECT ticker, count(benchmark_price) >= 2 AS available, min(date) FILTER (benchmark_price IS NOT NULL) AS os, max(date) FILTER (benchmark_price IS NOT NULL) AS oe,
  count(benchmark_price) AS overlap_days, stddev_samp(abnormal_return) AS sd, max_by(relative_performance, date) FILTER (relative_performance IS NOT NULL) AS rp FROM stats GROUP BY 1"""
_abn_cols = f"""available, strftime(os, '%Y-%m-%d') AS overlap_start, strftime(oe, '%Y-%m-%d') AS overlap_end, overlap_days,
  {R('abnormal_return_daily_std=sd abnormal_return_annualised_std=sd*sqrt(252e0) final_relative_performance=rp')}"""
raw("abnormal_volatility", f"SELECT ticker, {_abn_cols} FROM ({_abn})")
raw("summarize_benchmark", f"""SELECT ticker, {_abn_cols}, pairs, {R('beta correlation stock_return=sr benchmark_return=br difference=sr-br')}
FROM ({_abn}) JOIN ({_beta}) USING (ticker) JOIN (SELECT * FROM ({_bw}) WHERE "window" = 'Full period') USING (ticker)""")
_perf_wide = "SELECT ticker, " + ", ".join(f"max(window_return) FILTER (sessions = {n}) AS return_{n}_sessions" for _, n in PERF) + f" FROM ({SQL['performance_windows']}) GROUP BY 1"
_parts = [SQL["full_period_return"], SQL["annualised_return"], _perf_wide, f"SELECT ticker, ytd_return FROM ({SQL['ytd_return']})"] + [
    SQL[k] for k in ("range_52w", "ma_distance", "return_distribution", "tail_frequency", "volatility_summary", "max_drawdown", "volume_summary")]
raw("summarize_statistics", "SELECT * FROM " + " LEFT JOIN ".join(f"({p}) t{i}" + (" USING (ticker)" if i else "") for i, p in enumerate(_parts)))
raw("returns_histogram", f"""SELECT s.ticker, CAST(b AS BIGINT) AS bin, {R(['low=lo + b * width', 'high=lo + b * width + width'], 6)}, coalesce(c.days, 0) AS days,
  round(n * width * exp(-0.5e0 * power((lo + b * width + width / 2 - mean) / std, 2)) / (std * sqrt(2 * pi())), 6) + 0e0 AS normal_days
FROM (SELECT *, (hi - lo) / bins AS width, unnest(range(0, bins)) AS b FROM (SELECT ticker, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS lo, max(x) AS hi,
    CAST(least(100, greatest(20, floor(sqrt(count(*)) * 2))) AS BIGINT) AS bins FROM (SELECT ticker, daily_return * 100 AS x FROM plain WHERE daily_return IS NOT NULL) GROUP BY 1)) s
LEFT JOIN (SELECT ticker, CAST(least(bins - 1, floor((x - lo) / ((hi - lo) / bins))) AS BIGINT) AS bin, count(*) AS days
  FROM (SELECT ticker, daily_return * 100 AS x FROM plain WHERE daily_return IS NOT NULL) JOIN (SELECT ticker, min(daily_return * 100) AS lo, max(daily_return * 100) AS hi,
    CAST(least(100, greatest(20, floor(sqrt(count(daily_return)) * 2))) AS BIGINT) AS bins FROM plain GROUP BY 1) USING (ticker) GROUP BY 1, 2) c
ON c.ticker = s.ticker AND c.bin = s.b""")

# ---- outcomes -------------------------------------------------------------------------------------------
GROUPS = {
    "All events": "true",
    "Up moves (price rule fired)": "is_price_event AND direction = 'up'",
    "Down moves (price rule fired)": "is_price_event AND direction = 'down'",
    "Up moves with abnormal volume": "is_price_event AND direction = 'up' AND is_volume_event",
    "Up moves without abnormal volume": "is_price_event AND direction = 'up' AND NOT is_volume_event",
    "Down moves with abnormal volume": "is_price_event AND direction = 'down' AND is_volume_event",
    "Down moves without abnormal volume": "is_price_event AND direction = 'down' AND NOT is_volume_event",
    "Volume-only events": "is_volume_event AND NOT is_price_event",
}


def grouped(frame: str, where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT *, {q(g)} AS \"group\" FROM {frame} WHERE {where} AND {m}" for g, m in GROUPS.items())


def described(digits: int = 8) -> str:
    out = []
    for h in H:
        x = f"fwd_return_{h}d"
        out.append(f"count({x}) AS n_{h}d")
        out.append(R([f"mean_{h}d=avg({x})", f"median_{h}d=median({x})", f"mean_abnormal_{h}d=avg(fwd_abnormal_{h}d)",
                      f"pct_positive_{h}d=avg(CASE WHEN {x} > 0 THEN 1e0 WHEN {x} <= 0 THEN 0e0 END)"], digits))
    for h in X:
        for k in ("mfe", "mae"):
            out.append(R([f"mean_{k}_{h}d=avg({k}_{h}d)", f"median_{k}_{h}d=median({k}_{h}d)"], digits))
    return ", ".join(out)


BASE = "'All trading days (baseline)'"
raw("event_groups", f"SELECT ticker, {E}, \"group\" FROM ({grouped('found')})")
raw("describe_outcomes", f"SELECT ticker, direction, count(*) AS n_events, {described()} FROM found_plain GROUP BY 1, 2")
raw("event_outcomes", f"""SELECT ticker, "group", count(*) AS n_events, {described()} FROM ({grouped('found')}) GROUP BY 1, 2
UNION ALL SELECT ticker, {BASE}, count(daily_return), {described()} FROM stats GROUP BY 1""")


def pooled(where: str, digits: int = 8) -> str:
    return f"""SELECT "group", count(*) AS n_events, {described(digits)} FROM ({grouped('found', where)}) GROUP BY 1
UNION ALL SELECT {BASE}, count(daily_return), {described(digits)} FROM plain WHERE ticker IN (SELECT ticker FROM found WHERE {where})"""


raw("pooled_event_outcomes", pooled("abs(return_zscore) >= 1 AND volume_ratio >= 1"))
raw("outcomes_sink_csv", f"SELECT \"group\", n_events, mean_5d, median_5d, median_mfe_7d FROM ({pooled('true', 6)})")
raw("union_baseline", f"SELECT ticker, \"group\", n_events, n_20d FROM ({SQL['event_outcomes']})")
raw("pooled_header", f"SELECT count(*) AS events, count(DISTINCT ticker) AS tickers, {day('min(event_date)', 'first_date')}, {day('max(event_date)', 'last_date')} FROM found WHERE abs(return_zscore) >= 2")
raw("avg_forward_by_ticker", f"SELECT ticker, count(*) AS n, {R('avg_fwd_20d=avg(fwd_return_20d)')} FROM found WHERE return_zscore >= 2.5 AND fwd_return_20d IS NOT NULL GROUP BY 1")
raw("reversal_share", f"SELECT {R(['share_reversed=avg(CASE WHEN fwd_return_5d > 0 THEN 1e0 ELSE 0e0 END)'])}, count(*) AS n FROM found_low WHERE direction = 'down' AND is_price_event AND is_volume_event AND fwd_return_5d IS NOT NULL")
raw("big_up_moves", f"SELECT ticker, {E}, {R('daily_return return_zscore volume_ratio fwd_return_5d fwd_return_20d', 7)}, event_category FROM found WHERE return_zscore >= 1 AND volume_ratio >= 1.5")


def context(rows: str) -> str:
    """Long outcome rows of a frame with ticker, group_no, label, use, fresh."""
    parts = []
    for h in (2, 3, 5, 7):
        x = f"fwd_return_{h}d"
        cols = [f"avg=avg({x}) FILTER (use)", f"median=median({x}) FILTER (use)",
                f"pct_positive=avg(CASE WHEN {x} > 0 THEN 1e0 WHEN {x} <= 0 THEN 0e0 END) FILTER (use)",
                f"avg_vs_benchmark=avg(fwd_abnormal_{h}d) FILTER (use)"]
        extra = [f"{k}_{n}={f}({k}_{h}d) FILTER (use)" if h != 2 else f"{k}_{n}=CAST(NULL AS DOUBLE)"
                 for k in ("mfe", "mae") for n, f in (("avg", "avg"), ("median", "median"))]
        parts.append(f"""SELECT ticker, group_no, label, count(*) FILTER (use) AS n, count(*) FILTER (fresh) AS episodes,
  count(*) FILTER (use) < 20 AS small_sample, count(*) FILTER (use) < 5 AS insufficient, {h} AS horizon, {R(cols + extra)} FROM marked GROUP BY 1, 2, 3""")
    body = " UNION ALL ".join(parts)
    return f"""SELECT * FROM (WITH marked AS (SELECT *, use AND NOT coalesce(lag(use) OVER (PARTITION BY ticker, group_no ORDER BY date), false) AS fresh
FROM (SELECT * REPLACE (coalesce(use, false) AND fwd_return_7d IS NOT NULL AS use) FROM ({rows}))) {body})"""


raw("condition_outcomes", context("""SELECT *, 1 AS group_no, 'Z beyond 1' AS label, abs(return_zscore) >= 1 AS use FROM stats
UNION ALL SELECT *, 2, 'Z beyond 3.5', abs(return_zscore) >= 3.5 FROM stats"""))
_today = f"""SELECT t.*, {', '.join('s.' + c for c in OUT)}, l.structure AS ls, l.trend AS lt, l.rsi_zone AS lz
FROM (SELECT ticker, date, structure, '|' || states || '|' AS st, trend, rsi_zone FROM tech) t
JOIN (SELECT ticker AS tk, structure, trend, rsi_zone FROM tech_last) l ON l.tk = t.ticker
JOIN stats s ON s.ticker = t.ticker AND s.date = t.date"""
raw("historical_context", context(f"""SELECT *, 1 AS group_no, 'Same structure: ' || ls AS label, contains(st, '|' || ls || '|') AS use FROM ({_today}) WHERE ls <> 'No distinct structure'
UNION ALL SELECT *, 2, 'Same swing trend and RSI6 zone: ' || lt || ', RSI6 ' || lz, trend = lt AND rsi_zone = lz FROM ({_today}) WHERE lt <> 'n/a' AND lz <> 'n/a'
UNION ALL SELECT *, 3, {BASE}, true FROM ({_today})"""))
raw("count_episodes", f"""SELECT ticker, count(*) FILTER (m AND NOT coalesce(pm, false)) AS episodes
FROM (SELECT ticker, coalesce(drawdown <= -0.05, false) AS m, lag(drawdown <= -0.05) OVER ({W}) AS pm FROM plain) GROUP BY 1""")

# ---- indicators -------------------------------------------------------------------------------------------
per_session("level1", 6, ema="ema9 ema21 ema50 ema200 ema250", true_range="true_range", rsi="rsi6 rsi14")
raw("wilder_average", f"""WITH RECURSIVE holes AS MATERIALIZED (SELECT *, avg(v) OVER {last(14)} AS seed, count(v) OVER {last(14)} AS cnt
  FROM (SELECT ticker, date, pos, CASE WHEN day(date) <> 15 THEN volume END AS v FROM adj)),
 start AS MATERIALIZED (SELECT *, min(CASE WHEN cnt = 14 THEN pos END) OVER (PARTITION BY ticker) AS s FROM holes),
 w AS (SELECT ticker, date, pos, CAST(NULL AS DOUBLE) AS y FROM start WHERE pos = 1 UNION ALL
  SELECT m.ticker, m.date, m.pos, CASE WHEN m.pos = m.s THEN m.seed WHEN m.pos > m.s THEN CASE WHEN m.v IS NULL THEN w.y ELSE (w.y * 13 + m.v) / 14 END END
  FROM w JOIN start m ON m.ticker = w.ticker AND m.pos = w.pos + 1)
SELECT ticker, {D}, {R('wilder=y', 6)} FROM w""")
raw("sma", f"SELECT ticker, {D}, round({full('avg', 'close', last(20), 20)}, 6) + 0e0 AS sma20, round({full('avg', 'volume', last(5), 5)}, 6) + 0e0 AS sma5v FROM adj")
raw("rolling_slope", f"""SELECT ticker, {D}, CASE WHEN count(close) OVER {last(10)} = 10 THEN
  round((sum(close * pos) OVER {last(10)} - sum(close) OVER {last(10)} * (pos - 4.5e0)) / 82.5e0, 6) + 0e0 END AS slope10 FROM adj""")
raw("percentile_of_previous", f"SELECT ticker, {D}, round({percentile('volume', 252, 126)}, 8) + 0e0 AS percentile FROM adj")
per_session("ind", 6,
    ema_slope="ema9_slope ema21_slope ema50_slope",
    macd="macd macd_signal macd_hist",
    bollinger="bb_mid bb_upper bb_lower bb_pct_b bb_width",
    band_width_metrics="bb_width_change bb_width_percentile",
    atr="atr atr_pct atr_pct_percentile",
    realised_vol="rv20 rv60",
    short_returns="ta_return_1d ta_return_2d ta_return_3d ta_return_5d ta_return_7d ta_return_10d ta_return_20d move_5d_atr",
    mavol="mavol20 ta_volume_ratio avg_volume_5d volume_5d_vs_mavol20",
    obv="obv",
    obv_slope="obv_slope10 obv_slope20",
    rolling_vwap="vwap20",
    adx="plus_di minus_di adx",
    rolling_extremes="high20 low20 high60 low60 prior_high20 prior_low20",
    relative_returns="rel_2d rel_5d rel_7d rel_20d rel_daily_sigma",
    compute_indicators="ema9 ema200 rsi6 macd_hist atr bb_pct_b vwap20 adx obv_slope20 rel_7d high60 prior_low20",
)

# ---- labels -----------------------------------------------------------------------------------------------
for _key, _columns in {
    "label_trend": "trend", "label_ema50": "ema50_state", "label_rsi_zone": "rsi_zone",
    "rsi_relationships": "rsi_cross, rsi_recovering_oversold, rsi_losing_extended", "label_macd": "macd_state",
    "macd_details": "macd_cross, macd_hist_trend, macd_zero_context", "label_momentum": "momentum",
    "label_volume": "volume_level", "day_direction": "day_direction", "label_vwap": "vwap_position",
    "label_bb_position": "bb_position", "label_band_state": "band_state", "label_band_context": "band_context",
    "label_volatility": "volatility", "relative_strength_score": R("relative_strength_score", 6),
    "label_relative_strength": "relative_strength", "label_adx": "adx_state",
    "classify_all": "trend, rsi_zone, macd_state, momentum, volume_level, bb_position, band_state, band_context, volatility, relative_strength, adx_state",
    "recent_cross": "ema_cross", "cross_age": "ema_cross_age", "crossed": "ema_cross = 1 AS crossed_up, ema_cross = -1 AS crossed_down",
}.items():
    raw(_key, f"SELECT ticker, {D}, {_columns} FROM lab")
_points = "points_structure points_trend points_volume points_rsi points_macd points_boll points_relative_strength points_ema50"
raw("swing_condition", f"SELECT ticker, {D}, {R(_points + ' swing_score', 6)}, swing_condition FROM tech")
raw("structure_states", f"SELECT ticker, {D}, {', '.join(f'is_{k}' for k in STATES)}, structure FROM states_s")
raw("active_states", f"SELECT ticker, {D}, states FROM states_s")

# ---- structure and last session ----------------------------------------------------------------------------
raw("swing_points", f"SELECT ticker, {D}, is_swing_high, is_swing_low FROM pivots")
raw("level_candidates", f"SELECT ticker, {R('price', 6)}, origin FROM cands")
raw("support_resistance", f"SELECT ticker, side, level_no, {R('price', 6)}, origin, {R('distance_pct distance_atr', 6)}, merged, also FROM levels")
raw("nearest_levels", f"SELECT ticker, side, {R('price', 6)}, origin FROM levels WHERE level_no = 1")
_near = [("ema9", "EMA9"), ("ema21", "EMA21"), ("ema50", "EMA50"), ("vwap20", "VWAP20")]
_notes = [
    ("0", "20D high", "beyond", "prior_high20", "prior_high20 - close", "broke_up"),
    ("1", "20D high", "near", "high20", "high20 - close", "NOT broke_up AND high20 - close <= atr"),
    ("2", "20D low", "beyond", "prior_low20", "prior_low20 - close", "broke_down"),
    ("3", "20D low", "near", "low20", "low20 - close", "NOT broke_down AND close - low20 <= atr"),
] + [(str(4 + k), n, "near", c, f"close - {c}", f"abs(close - {c}) <= 0.5e0 * atr") for k, (c, n) in enumerate(_near)]
raw("proximity_notes", " UNION ALL ".join(
    f"SELECT ticker, {no} AS note_no, {q(ref)} AS reference, {q(kind)} AS kind, round({c}, 6) + 0e0 AS value, round(({gap}) / atr, 6) + 0e0 AS gap_atr FROM tech_last WHERE atr > 0 AND {when}"
    for no, ref, kind, c, gap, when in _notes))
raw("next_earnings", f"""SELECT b.ticker, strftime(b.last_date, '%Y-%m-%d') AS last_date, CASE WHEN r.ticker IS NULL THEN 'unknown' WHEN r.nx IS NULL THEN 'none' ELSE 'scheduled' END AS status,
  strftime(r.nx.t, '%Y-%m-%d %H:%M:%S') AS release_time, strftime(r.nx.d, '%Y-%m-%d') AS reaction_date,
  CASE WHEN r.nx IS NOT NULL THEN len(list_filter(range(b.last_date + 1, r.nx.d + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) END AS sessions_until,
  coalesce(len(list_filter(range(b.last_date + 1, r.nx.d + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) <= 7 AND r.nx IS NOT NULL, false) AS within_window
FROM (SELECT ticker, max(date) AS last_date FROM old_bars GROUP BY 1) b LEFT JOIN
 (SELECT ticker, min({{'d': d, 't': release_time}}) FILTER (d > last_date) AS nx FROM
   (SELECT ticker, release_time, last_date, CAST(s + CASE isodow(s) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS DATE) AS d FROM
     (SELECT r.ticker, release_time, last_date, CAST(release_time AS DATE) + CASE WHEN hour(release_time) >= 16 THEN 1 ELSE 0 END AS s FROM releases r
      JOIN (SELECT ticker AS tk, max(date) AS last_date FROM old_bars GROUP BY 1) z ON z.tk = r.ticker WHERE r.ticker <> 'RO')) GROUP BY 1) r USING (ticker)""")
_risk = """SELECT b.ticker, CASE WHEN count(r.ticker) = 0 THEN 'unknown' WHEN count(*) FILTER (r.d > b.last_date) = 0 THEN 'none' ELSE 'scheduled' END AS status,
  CASE WHEN count(*) FILTER (r.d > b.last_date) > 0 THEN len(list_filter(range(any_value(b.last_date) + 1, min(r.d) FILTER (r.d > b.last_date) + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) END AS sessions_until
FROM (SELECT ticker, max(date) AS last_date FROM bars GROUP BY 1) b LEFT JOIN (SELECT ticker, CAST(s + CASE isodow(s) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS DATE) AS d FROM
  (SELECT ticker, CAST(release_time AS DATE) + CASE WHEN hour(release_time) >= 16 THEN 1 ELSE 0 END AS s FROM releases)) r ON r.ticker = b.ticker GROUP BY 1"""
raw("technical_analysis", f"""SELECT ticker, {D}, swing_condition, {R('swing_score', 6)}, structure, states, {R('resistance support', 6)}, status, sessions_until
FROM tech_last LEFT JOIN (SELECT ticker, max(price) FILTER (side = 'resistance') AS resistance, max(price) FILTER (side = 'support') AS support FROM levels WHERE level_no = 1 GROUP BY 1) USING (ticker)
LEFT JOIN ({_risk}) USING (ticker)""")
_values = """close ema9 ema21 ema50 ema200 ema250 ema9_slope ema21_slope ema50_slope rsi6 rsi14 macd macd_signal macd_hist ta_return_1d ta_return_2d ta_return_3d
ta_return_5d ta_return_7d ta_return_10d ta_return_20d volume mavol20 ta_volume_ratio avg_volume_5d volume_5d_vs_mavol20 obv_slope10 obv_slope20 bb_upper bb_mid bb_lower
bb_pct_b bb_width bb_width_change bb_width_percentile atr atr_pct atr_pct_percentile rv20 rv60 vwap20 adx high20 low20 high60 low60 rel_2d rel_5d rel_7d rel_20d
relative_strength_score swing_score """ + _points
_texts = "trend ema50_state rsi_zone macd_state macd_hist_trend macd_zero_context momentum volume_level day_direction vwap_position bb_position band_state band_context volatility relative_strength adx_state swing_condition".split()
raw("technical_snapshot", f"SELECT ticker, {day('date', 'as_of')}, {R(_values, 6)}, {', '.join(f'nullif({c}, {q(str())}) AS {c}' for c in _texts)}, structure, states FROM tech_last")
_rows = [("Price", "close", "trend")] + [(f"EMA{n}", f"ema{n}", "NULL") for n in (9, 21, 50, 200, 250)] + [
    ("RSI6", "rsi6", "rsi_zone"), ("RSI14", "rsi14", "NULL"), ("MACD 12/26/9", "macd_hist", "macd_state"), ("Volume", "ta_volume_ratio", "volume_level"),
    ("BOLL (20, 1.8)", "bb_pct_b", "bb_position"), ("ATR(14)", "atr", "volatility"), ("Relative Strength 5D", "rel_5d", "relative_strength"),
    ("Structure", "CAST(NULL AS DOUBLE)", "structure"), ("Swing Condition", "swing_score", "swing_condition")]
raw("snapshot_rows", " UNION ALL ".join(
    f"SELECT ticker, {k} AS row_no, {q(m)} AS metric, round({v}, 6) + 0e0 AS value, CAST({t} AS VARCHAR) AS reading, "
    + (f"round(close / {v} - 1, 6) + 0e0 AS price_vs, round((close - {v}) / atr, 6) + 0e0 AS gap_atr" if m.startswith("EMA") else "CAST(NULL AS DOUBLE) AS price_vs, CAST(NULL AS DOUBLE) AS gap_atr")
    + " FROM tech_last" for k, (m, v, t) in enumerate(_rows)))
_ago = lambda a: f"CASE {a} WHEN 0 THEN 'today' WHEN 1 THEN '1 session ago' ELSE {a} || ' sessions ago' END"
raw("ema_events", f"""SELECT ticker, {D}, concat_ws('|', CASE WHEN ema_cross_age IS NOT NULL THEN 'EMA9 crossed ' || CASE WHEN ema9 > ema21 THEN 'above' ELSE 'below' END || ' EMA21 ' || {_ago('ema_cross_age')} END,
  CASE WHEN is_reclaiming_ema21 THEN 'price reclaimed EMA21 today' END, CASE WHEN is_losing_ema21 THEN 'price lost EMA21 today' END,
  CASE WHEN is_reclaiming_ema9 THEN 'price reclaimed EMA9 today' END, CASE WHEN is_losing_ema9 THEN 'price lost EMA9 today' END,
  CASE WHEN is_ema_compression THEN format('EMA9 and EMA21 are compressed ({{:.2f}} ATR apart, threshold 0.3)', abs(ema9 - ema21) / atr) END) AS ema_events FROM states_s""")
raw("rsi_details", f"""SELECT ticker, {D}, concat_ws('|', CASE WHEN rsi_cross_age IS NOT NULL THEN 'RSI6 crossed ' || CASE WHEN rsi6 > rsi14 THEN 'above' ELSE 'below' END || ' RSI14 ' || {_ago('rsi_cross_age')}
  WHEN rsi6 IS NOT NULL AND rsi14 IS NOT NULL THEN 'RSI6 ' || CASE WHEN rsi6 > rsi14 THEN 'above' WHEN rsi6 < rsi14 THEN 'below' ELSE 'at' END || ' RSI14' END,
  CASE WHEN rsi_recovering_oversold THEN 'RSI6 recovering from oversold' END, CASE WHEN rsi_losing_extended THEN 'RSI6 losing momentum from an extended level' END) AS rsi_details FROM lab""")
raw("macd_event_details", f"""SELECT ticker, {D}, concat_ws('|', CASE WHEN macd_cross_age IS NOT NULL THEN CASE WHEN macd_hist > 0 THEN 'bullish' ELSE 'bearish' END || ' crossover ' || {_ago('macd_cross_age')} END,
  CASE WHEN macd_hist_trend <> '' THEN 'histogram ' || macd_hist_trend END, CASE WHEN macd_zero_context <> '' THEN 'MACD ' || macd_zero_context END) AS macd_details FROM lab""")
raw("obv_divergence", f"SELECT ticker, {D}, coalesce(ta_return_5d <> 0 AND sign(obv_slope10) = -sign(ta_return_5d) AND abs(obv_slope10) >= 0.1 AND abs(move_5d_atr) >= 1, false) AS obv_divergence FROM ind")
raw("rs_shift", f"SELECT ticker, {D}, CASE WHEN abs(relative_strength_score) >= 0.5 AND sign(relative_strength_score) <> sign(rel_20d) THEN CASE WHEN relative_strength_score > 0 THEN 'out' ELSE 'under' END END AS rs_shift FROM lab")
raw("momentum_pace", f"SELECT ticker, {D}, CASE WHEN macd_state = 'Improving' AND rsi6_change_3d >= 0 THEN 'building' WHEN macd_state = 'Weakening' AND rsi6_change_3d <= 0 THEN 'fading' ELSE 'mixed' END AS momentum_pace FROM lab")
_side = "CASE WHEN day_direction IN ('up', 'down') THEN day_direction ELSE 'flat' END"
raw("volume_verdict", f"""SELECT ticker, {D}, CASE WHEN volume_level IN ('Very high participation', 'Strong participation') THEN 'heavy_' || {_side}
  WHEN volume_level = 'Weak participation' THEN 'light_' || {_side} WHEN volume_level = 'Normal' THEN 'usual' ELSE 'unknown' END AS volume_verdict FROM lab""")
raw("atr_ranges", f"SELECT ticker, m AS multiple, {R(['low=close - m * atr', 'high=close + m * atr'], 6)} FROM tech_last, (VALUES (1e0), (1.5e0), (2e0)) v(m) WHERE atr IS NOT NULL")
_refs = [("high20", "20D high", "CASE WHEN broke_up THEN 'beyond' WHEN atr > 0 AND high20 - close <= atr THEN 'near' ELSE '' END"),
         ("low20", "20D low", "CASE WHEN broke_down THEN 'beyond' WHEN atr > 0 AND close - low20 <= atr THEN 'near' ELSE '' END"),
         ("high60", "60D high", "''"), ("low60", "60D low", "''")] + [
    (c, n, f"CASE WHEN atr > 0 AND abs(close - {c}) <= 0.5e0 * atr THEN 'near' ELSE '' END") for c, n in _near]
raw("reference_levels", " UNION ALL ".join(
    f"SELECT ticker, {k} AS ref_no, {q(n)} AS reference, {R([f'value={c}', f'distance_pct={c} / close - 1', f'distance_atr=({c} - close) / CASE WHEN atr > 0 THEN atr END'], 6)}, {mark} AS mark FROM tech_last WHERE {c} IS NOT NULL"
    for k, (c, n, mark) in enumerate(_refs)))
_series = "open high low close volume bb_upper bb_mid bb_lower ema9 ema21 ema50 ema200 ema250 rsi6 rsi14 macd macd_signal macd_hist mavol20"
_window = "(SELECT * FROM ind QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 126)"
raw("chart_window", f"SELECT ticker, {D}, {R(_series, 6)}, close >= open AS up_candle FROM {_window}")
raw("chart_limits", f"""SELECT ticker, {R(['axis_low=lo2 - 0.04e0 * (hi2 - lo2)', 'axis_high=hi2 + 0.04e0 * (hi2 - lo2)'], 6)} FROM (
 SELECT *, CASE WHEN greatest(hi1, b1) - least(lo1, b0) <= 1.35e0 * span THEN least(lo1, b0) ELSE lo1 END AS lo2,
   CASE WHEN greatest(hi1, b1) - least(lo1, b0) <= 1.35e0 * span THEN greatest(hi1, b1) ELSE hi1 END AS hi2 FROM (
 SELECT *, CASE WHEN greatest(hi, a1) - least(lo, a0) <= 1.35e0 * span THEN least(lo, a0) ELSE lo END AS lo1,
   CASE WHEN greatest(hi, a1) - least(lo, a0) <= 1.35e0 * span THEN greatest(hi, a1) ELSE hi END AS hi1 FROM (
 SELECT *, greatest(hi - lo, abs(hi) * 0.01e0, 1e-9) AS span FROM (
 SELECT w.ticker, least(w.lo, v.lo) AS lo, greatest(w.hi, v.hi) AS hi, a0, a1, b0, b1 FROM
  (SELECT ticker, min(least(low, high, close, bb_upper, bb_lower, ema9, ema21, ema50)) AS lo, max(greatest(low, high, close, bb_upper, bb_lower, ema9, ema21, ema50)) AS hi,
    min(ema200) AS a0, max(ema200) AS a1, min(ema250) AS b0, max(ema250) AS b1 FROM {_window} GROUP BY 1) w
  LEFT JOIN (SELECT ticker, min(price) AS lo, max(price) AS hi FROM levels GROUP BY 1) v USING (ticker)))))""")
raw("technical_notes", """SELECT ticker, count(*) AS sessions, 0 AS filled_sessions, max_by(swing_condition, date) AS condition, count(*) < 250 AS short_history,
  count(*) BETWEEN 250 AND 499 AS young_averages, max_by(swing_condition, date) = 'n/a' AS unclassified FROM tech GROUP BY 1""")

# ---- fundamentals ------------------------------------------------------------------------------------------
raw("finite_float", """SELECT ticker, k AS key, CASE k WHEN 'totalRevenue' THEN CAST(revenue AS DOUBLE) WHEN 'sharesOutstanding' THEN shares WHEN 'trailingEps' THEN lines END AS value
FROM info, (SELECT unnest(['shortName', 'longName', 'exchange', 'sector', 'currency', 'financialCurrency', 'totalRevenue', 'sharesOutstanding', 'trailingEps', 'forwardPE', 'trailingPE', 'enterpriseToEbitda']) AS k)""")
raw("profile", "SELECT * FROM who")
raw("unit_resolve", """SELECT ticker, k AS unit_type, CASE k WHEN 'money_trading' THEN trading WHEN 'money_financial' THEN financial WHEN 'per_share' THEN financial || '/share' ELSE k END AS unit
FROM units, (SELECT unnest(['money_trading', 'money_financial', 'per_share', 'ratio', 'shares']) AS k)""")
_f = "ticker, period_type, period_end, metric, label, {}, unit, source, retrieved_at"
raw("snapshot_fundamentals", f"SELECT {_f.format(R('value', 2))} FROM snaps")
raw("annual_fundamentals", f"SELECT {_f.format(R('value', 2))} FROM annual")
raw("calculated_ratios", f"SELECT {_f.format(R('value', 8))} FROM ratios")
_order = [m[0] for m in STATEMENT_METRICS] + [m[0] for m in CALCULATED_METRICS]
_no = "CASE metric " + " ".join(f"WHEN {q(m)} THEN {k}" for k, m in enumerate(_order)) + " END"
_long = f"""SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS period_no FROM funda WHERE period_type = 'annual'"""
raw("annual_table", f"SELECT ticker, metric, {_no} AS metric_no, period_end, period_no, {R('value', 4)} FROM ({_long})")
raw("annual_table_complete", f"""SELECT t.ticker, t.metric, {_no} AS metric_no, {_labels} AS label, t.period_end, t.period_no, {R('value', 4)}
FROM (SELECT p.ticker, p.period_end, p.period_no, m.metric, f.value FROM (SELECT DISTINCT ticker, period_end, period_no FROM ({_long})) p
  CROSS JOIN (SELECT unnest([{', '.join(map(q, _order))}]) AS metric) m
  LEFT JOIN ({_long}) f ON f.ticker = p.ticker AND f.period_end = p.period_end AND f.metric = m.metric) t""")
raw("fundamentals_gaps", f"""SELECT i.ticker, count(*) FILTER (period_type = 'snapshot') AS snapshot_rows, count(*) FILTER (period_type = 'annual') AS annual_rows,
  count(*) FILTER (period_type = 'snapshot') = 0 AS no_snapshot, count(*) FILTER (period_type = 'annual') = 0 AS no_annual
FROM info i LEFT JOIN (SELECT ticker, period_type FROM funda WHERE {_live}) f USING (ticker) GROUP BY 1""")
raw("metric_labels", f"SELECT ticker, period_type, period_end, metric, {_labels} AS label, {R('value', 4)} FROM funda_old")

# ---- merges -------------------------------------------------------------------------------------------------
raw("merge_stocks", f"""SELECT coalesce(n.ticker, s.ticker) AS ticker, {', '.join(f'coalesce(n.{c}, s.{c}) AS {c}' for c in _stock)},
  coalesce(s.first_analyzed, '2002-01-31T00:00:00') AS first_analyzed, CASE WHEN n.ticker IS NOT NULL THEN '2002-01-31T00:00:00' ELSE s.last_analyzed END AS last_analyzed
FROM stocks_old s FULL JOIN (SELECT * FROM who WHERE ticker <> 'RO') n ON n.ticker = s.ticker""")
raw("merge_prices", f"""SELECT ticker, {D}, {R('open high low')}, round(CASE WHEN year(bars.date) >= 1999 THEN close + 1 ELSE close END, 8) + 0e0 AS close, {R('adj_close volume')},
  CASE WHEN year(bars.date) >= 1999 THEN 'corrected' ELSE 'provider' END AS source, strftime(bars.date, '%Y-%m-%d') || 'T18:00:00' AS updated_at FROM bars""")
_auto = """s.verification_status IN ('Unverified', 'Unverified (automatic date match)') AND s.event_category IN ('Unknown', 'Earnings release (date match)')
  AND (s.source IS NULL OR s.source = 'provider earnings calendar') AND n.event_category <> 'Unknown'"""


def merged(new: str) -> str:
    def one(c: str, both: str) -> str:
        return f"CASE WHEN s.ticker IS NULL THEN n.{c} WHEN n.ticker IS NULL THEN s.{c} ELSE {both} END AS {c}"

    cols = []
    for c in _figures.split() + list(OUT) + [x.strip() for x in _facts.split(",")]:
        if c in ("benchmark", "benchmark_return", "abnormal_return") or "fwd_abnormal" in c:
            cols.append(one(c, f"CASE WHEN n.benchmark IS NULL THEN s.{c} ELSE n.{c} END"))
        elif c in OUT:
            cols.append(one(c, f"coalesce(n.{c}, s.{c})"))
        else:
            cols.append(one(c, f"n.{c}"))
    for c in RESEARCH[:4]:
        cols.append(one(c, f"CASE WHEN {_auto} THEN n.{c} ELSE s.{c} END"))
    cols.append(one("notes", "coalesce(s.notes, n.notes)"))
    return f"""SELECT coalesce(n.ticker, s.ticker) AS ticker, coalesce(n.event_date, s.event_date) AS event_date, {', '.join(cols)}
FROM stored s FULL JOIN {new} n ON n.ticker = s.ticker AND n.event_date = s.event_date"""


raw("merge_events", f"SELECT ticker, {E}, {R(_figures + ' ' + ' '.join(OUT), 7)}, {_facts}, {', '.join(RESEARCH)} FROM ({merged('events_m')})")
raw("merge_events_without_benchmark", f"SELECT ticker, {E}, benchmark, {R('benchmark_return fwd_abnormal_5d fwd_return_5d', 7)} FROM ({merged('found_plain')})")
raw("merge_fundamentals", f"""SELECT coalesce(n.ticker, s.ticker) AS ticker, coalesce(n.period_type, s.period_type) AS period_type, coalesce(n.period_end, s.period_end) AS period_end,
  coalesce(n.metric, s.metric) AS metric, round(CASE WHEN n.ticker IS NOT NULL THEN n.value ELSE s.value END, 4) + 0e0 AS value, {', '.join(f'CASE WHEN n.ticker IS NOT NULL THEN n.{c} ELSE s.{c} END AS {c}' for c in ('unit', 'source', 'retrieved_at'))}
FROM funda_old s FULL JOIN funda n ON n.ticker = s.ticker AND n.period_type = s.period_type AND n.period_end = s.period_end AND n.metric = s.metric""")
raw("import_research", f"""SELECT ticker, {E}, coalesce(s_category, event_category) AS event_category, coalesce(s_description, event_description) AS event_description, coalesce(s_source, source) AS source,
  CASE WHEN manual THEN 'Researched manually' ELSE coalesce(s_status, verification_status) END AS verification_status, coalesce(s_notes, notes) AS notes FROM decided""")
raw("import_changes", " UNION ALL ".join(
    f"SELECT ticker, {E}, {q(c)} AS \"column\", {c} AS old, {s} AS new FROM decided WHERE {s} IS NOT NULL"
    for c, s in (("event_category", "s_category"), ("event_description", "s_description"), ("source", "s_source"), ("verification_status", "s_status"), ("notes", "s_notes"))))
raw("import_counts", """SELECT count(*) FILTER (coalesce(s_category, s_description, s_source, s_status, s_notes) IS NOT NULL) AS updated_events, count(*) FILTER (manual) AS status_set_manual,
  (SELECT count(DISTINCT ticker) FROM stored) AS unmatched FROM decided""")
_kept = [c for c in OUT if not (c.startswith(("mfe", "mae")) or c[-2:] in ("2d", "3d", "7d"))]
raw("evolve_events_schema", f"SELECT ticker, {E}, notes, {R(_kept)}, {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in OUT if c not in _kept)} FROM stored")
raw("db_values", f"SELECT ticker, {D}, round(CASE WHEN session % 10 > 1 THEN daily_return END, 7) + 0e0 AS daily_return, CAST(log_return > 0 AS BIGINT) AS rising FROM plain")

# ---- order, limits, unions ------------------------------------------------------------------------------------
raw("sort_by_date", f"SELECT ticker, {D}, ingest_seq, {R('close')} FROM dirty")
raw("last_row_per_ticker", f"SELECT ticker, {D}, {R(BAR)} FROM {_lastrow.format(f='bars')}")
raw("tail_n", f"SELECT ticker, {D}, {R('close')} FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 60)")
raw("union_frames", "SELECT ticker, count(daily_return) AS days, count(fwd_return_1d) AS n_1d, count(fwd_return_20d) AS n_20d FROM plain GROUP BY 1")


def all_sql() -> dict[str, str]:
    """Statements of the registered queries, each with the CTEs it needs."""
    return {key: _complete(text) for key, text in SQL.items() if key in REGISTRY}


def _complete(text: str) -> str:
    own = "WITH RECURSIVE "
    if text.startswith(own):  # a statement with recursive parts of its own
        shared = with_ctes(text[len(own):])
        return shared.replace("\n" + text[len(own):], ",\n" + text[len(own):]) if shared.startswith(own) else text
    return with_ctes(text)
