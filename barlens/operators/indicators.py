"""Swing indicators of every session, on dividend-adjusted bars.

The whole layer needs one exchange on ticker and one sort on (ticker, date): three passes over the sorted sessions
take the series (``functions.series``), column expressions between them the formulas.
Names that would clash with the statistics layer carry the prefix ``ta_``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series
from ..functions.frames import era, era_sessions, full, upto
from ..functions.nulls import every, growth, per
from ..functions.recurrence import apart
from ..functions.search import count_up_to

# The chart settings.
EMA_SPANS = (9, 21, 50, 200, 250)
SLOPED_SPANS = (9, 21, 50)
SLOPE_SESSIONS = 3
RSI_PERIODS = (6, 14)
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BOLL_WINDOW, BOLL_WIDTH = 20, 1.8
ATR_PERIOD = 14
VOLUME_WINDOW = 20
RETURN_HORIZONS = (1, 2, 3, 5, 7, 10, 20)
RELATIVE_HORIZONS = (2, 5, 7, 20)
YEAR_SESSIONS = 252


def adjust_ohlcv(priced: DataFrame) -> DataFrame:
    """Bars on the basis of the chosen price; a missing high or low becomes the close.

    ``filled_high_low`` marks the sessions that were filled.
    """
    return _all_of(priced, adjusting())


def adjusting() -> list[series.Step]:
    factor = F.when(
        F.col("price_column") == "adj_close", F.try_divide("adj_close", "close")
    ).otherwise(1.0)
    return [
        {c: F.col(c) * factor for c in ("open", "high", "low", "close")},
        {
            "filled_high_low": F.col("high").isNull() | F.col("low").isNull(),
            "high": F.coalesce("high", "close"),
            "low": F.coalesce("low", "close"),
        },
    ]


def _all_of(df: DataFrame, formulas: list[series.Step]) -> DataFrame:
    for step in formulas:
        df = df.withColumns(step)
    return df


def sma(column: str, window: int) -> Column:
    return full(F.avg, F.col(column), upto(era_sessions(), window), window)


def rolling_slope(column: str, window: int, position: str = "_pos") -> Column:
    """Least-squares slope per session of the last ``window`` values."""
    frame = upto(era_sessions(), window)
    return F.when(
        F.count(column).over(frame) == window, F.regr_slope(column, position).over(frame)
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def percentiles_of_previous(df: DataFrame, ranks: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Add ``{name: (column, window, least)}``: 100 x share of the previous ``window`` known values that are <= today's.

    NULL below ``least`` previous values.  Values equal up to rounding noise (one part in 1e12) count as equal, so
    that the result does not depend on the order in which a spread was summed.

    A window is cut into blocks of about the square root of its sessions, the same for all: ``size`` divides every
    window.  The blocks that lie wholly in it are gathered and sorted as one run, once a block, and searched by
    halving; only the two blocks at its ends are scanned.  A block's first session ranks the whole block, so the
    gathered values go no further than that row.
    """
    kept = df.columns
    windows = [n for _, n, _ in ranks.values()]
    common, widest = math.gcd(*windows), math.isqrt(max(windows))
    size = max(d for d in range(1, widest + 1) if common % d == 0)
    df = df.withColumn("_at", F.row_number().over(era_sessions()) - 1)
    df = df.withColumn("_block", F.expr(f"_at div {size}"))
    blocks = Window.partitionBy("ticker").orderBy("_block")
    own = blocks.rangeBetween(0, 0)

    def placed(x: Column) -> Column:
        """A block's values in order; NaN, which is above every limit, for a missing one."""
        return F.collect_list(F.struct(F.col("_at").alias("at"), F.coalesce(x, F.lit(math.nan)).alias("x")))

    gathered = {}
    for name, (column, window, _) in ranks.items():
        back, x = window // size, F.col(column)
        # frames of blocks: they move, and are gathered, once a block
        gathered[f"_run_{name}"] = F.collect_list(x).over(blocks.rangeBetween(1 - back, -1))
        gathered[f"_old_{name}"] = placed(x).over(blocks.rangeBetween(-back, -back))
        gathered[f"_own_{name}"] = placed(x).over(own)
    df = df.withColumns(gathered)

    def ranked(name: str) -> Column:
        """The ranks of a block's sessions in order."""
        _, window, least = ranks[name]
        run = F.sort_array(f"_run_{name}")
        old, mine = (F.transform(F.sort_array(f"_{k}_{name}"), lambda v: v["x"]) for k in ("old", "own"))

        def rank(block: Column, x: Column, nth: Column) -> Column:
            ends = F.concat(F.slice(block["old"], nth + 1, F.lit(size)), F.slice(block["own"], F.lit(1), nth))

            def of(v: Column) -> Column:
                known = F.size(block["run"]) + F.size(F.array_remove(v["ends"], math.nan))
                up_to = F.size(F.filter(v["ends"], lambda e: e <= v["limit"])) + count_up_to(block["run"], v["limit"], window)
                return F.when(~F.isnan(x) & (known >= least), F.lit(100.0) * (up_to / known))

            return _let(F.struct(ends.alias("ends"), (x + F.abs(x) * 1e-12).alias("limit")), of)

        whole = F.struct(run.alias("run"), old.alias("old"), mine.alias("own"))
        return F.when(F.col("_at") % size == 0, _let(whole, lambda b: F.transform(b["own"], lambda x, nth: rank(b, x, nth))))

    df = df.select(*kept, "_at", "_block", *[ranked(n).alias(f"_ranks_{n}") for n in ranks])
    df = df.withColumns({f"_ranks_{n}": F.first(f"_ranks_{n}", ignorenulls=True).over(own) for n in ranks})
    return df.select(*kept, *[F.get(f"_ranks_{n}", (F.col("_at") % size).cast("int")).alias(n) for n in ranks])


def true_range(previous_close: Column) -> Column:
    high, low = F.col("high"), F.col("low")
    spread = F.greatest(high - low, F.abs(high - previous_close), F.abs(low - previous_close))
    return F.when((high - low).isNotNull(), spread)


def rsi_from(gain: Column, loss: Column) -> Column:
    """100 where there were only gains, 50 where nothing moved."""
    ratio = F.try_divide(gain, F.when(loss > 0, loss))
    still = F.when(gain > 0, 100.0).otherwise(50.0)
    return F.when(gain.isNotNull(), F.when(loss > 0, 100 - 100 / (1 + ratio)).otherwise(still))


#: Series of the bars that the recursive indicators start from.
_FROM_BARS = {
    **{f"_previous_{c}": series.lag(c) for c in ("close", "high", "low")},
    **{f"ema{n}": series.ema("close", n) for n in EMA_SPANS},
    "_fast": series.ema("close", MACD_FAST),
    "_slow": series.ema("close", MACD_SLOW),
}
#: Series of the day-to-day moves.
_FROM_MOVES = {
    "atr": series.wilder("true_range", ATR_PERIOD),
    **{f"_{c}{p}": series.wilder(f"_{c}", p) for p in RSI_PERIODS for c in ("gain", "loss")},
    **{f"_s{c}": series.wilder(c, ATR_PERIOD) for c in ("_tr", "_plus", "_minus")},
    "macd_signal": series.ema("macd", MACD_SIGNAL),
}
_FROM_DIRECTIONS = {"adx": series.wilder("_dx", ATR_PERIOD)}


def moves() -> list[series.Step]:
    """Day-to-day inputs of the recursive averages."""
    previous = F.col("_previous_close")
    change, up, down = F.col("_change"), F.col("_up"), F.col("_down")
    moved = change.isNotNull()
    return [
        {"_change": F.col("close") - previous, "_up": F.col("high") - F.col("_previous_high"), "_down": F.col("_previous_low") - F.col("low")},
        {
            "_gain": F.when(moved, F.greatest(change, F.lit(0.0))),
            "_loss": F.when(moved, F.greatest(-change, F.lit(0.0))),
            "true_range": true_range(previous),
            "_tr": F.when(previous.isNotNull(), true_range(previous)),
            "_plus": F.when(up.isNotNull(), F.when(every(up > down, up > 0), up).otherwise(0.0)),
            "_minus": F.when(
                down.isNotNull(), F.when(every(down > up, down > 0), down).otherwise(0.0)
            ),
            "macd": apart(F.col("_fast"), F.col("_slow")),
        },
    ]


def oscillators() -> list[series.Step]:
    """RSI, MACD histogram and directional indexes from their averages."""
    spread, total = F.col("plus_di") - F.col("minus_di"), F.col("plus_di") + F.col("minus_di")
    return [
        {f"rsi{p}": rsi_from(F.col(f"_gain{p}"), F.col(f"_loss{p}")) for p in RSI_PERIODS}
        | {
            "macd_hist": apart(F.col("macd"), F.col("macd_signal"), F.col("close")),
            "plus_di": per(100 * F.col("_s_plus"), F.col("_s_tr")),
            "minus_di": per(100 * F.col("_s_minus"), F.col("_s_tr")),
        },
        {"_dx": per(100 * F.abs(spread), total)},
    ]


def _shown(columns: Iterable[str], steps: list[series.Step]) -> list[str]:
    """The columns and what the steps add to them, without helpers."""
    return [c for c in dict.fromkeys([*columns, *[c for step in steps for c in step]]) if not c.startswith("_")]


def add_recursive(df: DataFrame) -> DataFrame:
    """EMAs, RSI, MACD, ATR and ADX."""
    made = [_FROM_BARS, *moves(), _FROM_MOVES, *oscillators(), _FROM_DIRECTIONS]
    return series.derived(series.in_order(df), made, _shown(df.columns, made))


def direct_series() -> dict[str, series.Series]:
    """Series that read the bars themselves."""
    columns = {
        "bb_mid": series.upto(series.mean, "close", BOLL_WINDOW),
        "_bb_std": series.upto(series.std_pop, "close", BOLL_WINDOW),
        "mavol20": series.upto(series.mean, "volume", VOLUME_WINDOW),
        "_mavol10": series.upto(series.mean, "volume", 10),
        "avg_volume_5d": series.upto(series.mean, "volume", 5),
        "_weighted20": series.upto(series.total, "_weighted", 20),
        "_volume20": series.upto(series.total, "volume", 20),
        "prior_high20": series.before(series.highest, "high", 20),
        "prior_low20": series.before(series.lowest, "low", 20),
    }
    columns |= {f"_close_{n}": series.lag("close", n) for n in RETURN_HORIZONS}
    for n in (20, 60):
        columns[f"high{n}"] = series.upto(series.highest, "high", n)
        columns[f"low{n}"] = series.upto(series.lowest, "low", n)
    return columns


def direct() -> list[series.Step]:
    """Indicators of a bar and the bars before it."""
    close, mid, std = F.col("close"), F.col("bb_mid"), F.col("_bb_std")
    move = F.signum(close - F.col("_previous_close"))
    width = F.col("bb_upper") - F.col("bb_lower")
    return [
        {f"ta_return_{n}d": growth(close, F.col(f"_close_{n}")) for n in RETURN_HORIZONS}
        | {
            "_signed_volume": F.coalesce(move, F.lit(0.0)) * F.coalesce("volume", F.lit(0.0)),
            "vwap20": per(F.col("_weighted20"), F.col("_volume20")),
            "ta_volume_ratio": per(F.col("volume"), F.col("mavol20")),
            "volume_5d_vs_mavol20": per(F.col("avg_volume_5d"), F.col("mavol20")),
            "bb_upper": mid + BOLL_WIDTH * std,
            "bb_lower": mid - BOLL_WIDTH * std,
        },
        {"bb_pct_b": per(close - F.col("bb_lower"), width), "bb_width": per(width, mid)},
    ]


def relative(compared: bool) -> series.Step:
    """Returns minus the benchmark's; NULL without a benchmark column."""
    if not compared:
        absent = F.lit(None).cast("double")
        return {c: absent for c in (*[f"rel_{n}d" for n in RELATIVE_HORIZONS], "_rel_1d")}
    bench = F.col("benchmark_price")
    later = {n: growth(bench, F.col(f"_benchmark_{n}")) for n in (1, *RELATIVE_HORIZONS)}
    return {f"rel_{n}d": F.col(f"ta_return_{n}d") - later[n] for n in RELATIVE_HORIZONS} | {
        "_rel_1d": F.col("ta_return_1d") - later[1]
    }


def second_order_series() -> dict[str, series.Series | series.Recursion]:
    """Series that read other indicators."""
    return {
        "obv": series.running_sum("_signed_volume"),
        "_rv20": series.upto(series.std_samp, "ta_return_1d", 20),
        "_rv60": series.upto(series.std_samp, "ta_return_1d", 60),
        "rel_daily_sigma": series.std_of_known("_rel_1d", 60, 40),
        "_width_before": series.lag("bb_width", 5),
        "bb_width_percentile": series.rank_of_previous("bb_width", 126, 60),
        **{f"_ema{n}_before": series.lag(f"ema{n}", SLOPE_SESSIONS) for n in SLOPED_SPANS},
    }


def second_order() -> series.Step:
    close = F.col("close")
    return {
        "atr_pct": F.try_divide(F.col("atr"), close) * 100,
        "move_5d_atr": F.try_divide(close - F.col("_close_5"), "atr"),
        "rv20": F.col("_rv20") * math.sqrt(YEAR_SESSIONS),
        "rv60": F.col("_rv60") * math.sqrt(YEAR_SESSIONS),
        "bb_width_change": growth(F.col("bb_width"), F.col("_width_before")),
    } | {f"ema{n}_slope": growth(F.col(f"ema{n}"), F.col(f"_ema{n}_before")) for n in SLOPED_SPANS}


def indicating(
    compared: bool,
    further: dict[str, series.Series] | None = None,
    inputs: list[series.Step] | None = None,
    beside: list[series.Step] | None = None,
) -> list[series.Step]:
    """Steps from adjusted bars to all indicators; ``compared`` says that there is a ``benchmark_price``.

    ``further`` series of the indicators and of ``inputs`` are taken in the last pass.  Those ``beside`` are taken in the
    first, and the formulas over them follow it.
    """
    beside, *formulas = beside or [{}]
    first = beside | _FROM_BARS | direct_series()
    if compared:
        first |= {f"_benchmark_{n}": series.lag("benchmark_price", n) for n in (1, *RELATIVE_HORIZONS)}
    last = {
        "_obv_slope10": series.slope("obv", 10),
        "_obv_slope20": series.slope("obv", 20),
        "atr_pct_percentile": series.rank_of_previous("atr_pct", 252, 126),
    }
    return [
        {"era": era(), "_weighted": (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")},
        first,
        *formulas,
        *moves(),
        *direct(),
        relative(compared),
        _FROM_MOVES | second_order_series(),
        *oscillators(),
        second_order(),
        *(inputs or []),
        _FROM_DIRECTIONS | last | (further or {}),
        {
            "obv_slope10": per(F.col("_obv_slope10"), F.col("_mavol10")),
            "obv_slope20": per(F.col("_obv_slope20"), F.col("mavol20")),
        },
    ]


def made(compared: bool) -> list[str]:
    """The names of all indicators."""
    return _shown([], indicating(compared))


def compute_indicators(
    adjusted: DataFrame, further: dict[str, series.Series] | None = None, inputs: dict[str, Column] | None = None
) -> DataFrame:
    """All indicators on adjusted bars (with ``benchmark_price`` where there is one).

    ``further`` series of the indicators and of ``inputs`` are taken in the last pass.  Bars that were ``numbered`` are in order.
    """
    steps = indicating("benchmark_price" in adjusted.columns, further, [inputs or {}])
    bars = adjusted if series.PLACE in adjusted.columns else series.in_order(adjusted)
    return series.derived(bars, steps, [*_shown(adjusted.columns, steps), *(further or {})])
