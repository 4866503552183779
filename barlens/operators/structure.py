"""Price structure: pivots, levels, structure states, notes on the last session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series
from ..functions.frames import era_sessions
from ..functions.nulls import every, first_match, growth, items, yes
from ..functions.recurrence import apart
from ..vocab import NO_STRUCTURE, STATES
from . import earlier
from .labels import crossed

# Distances in ATRs, volume ratios, points.
MERGE_ATR = 0.5
LEAST_GAP_ATR = 0.1
NEAR_ATR = 0.5
NEAR_EXTREME_ATR = 1.0
HEAVY_VOLUME = 1.5
WEAK_VOLUME = 0.8
COMPRESSION_ATR = 0.3
RSI_DROP = 20
EXTREMES = (("high20", "20D high"), ("low20", "20D low"), ("high60", "60D high"), ("low60", "60D low"))
REFERENCES = (("ema9", "EMA9"), ("ema21", "EMA21"), ("ema50", "EMA50"), ("vwap20", "VWAP20"))
REFERENCE_COLUMNS = ("close", "atr", "prior_high20", "prior_low20", *[c for c, _ in (*EXTREMES, *REFERENCES)])


def swing_points(df: DataFrame, bars: int = 3) -> DataFrame:
    """Add is_swing_high and is_swing_low; needs ``bars`` sessions on both sides."""
    frame = era_sessions().rowsBetween(-bars, bars)
    size = 2 * bars + 1

    def pivot(column: str, extreme) -> Column:
        complete = F.count(column).over(frame) == size
        return yes(complete & (F.col(column) == extreme(column).over(frame)))

    return df.withColumns(
        {"is_swing_high": pivot("high", F.max), "is_swing_low": pivot("low", F.min)}
    )


def level_series(bars: int = 3) -> dict[str, series.Series]:
    """What levels read of other sessions: extremes of the ``bars`` sessions on both sides, and the last session."""
    return earlier.LEFT | {
        f"_highest_{bars}_around": series.rolled(series.highest, "high", -bars, bars),
        f"_lowest_{bars}_around": series.rolled(series.lowest, "low", -bars, bars),
        "_last_close": series.at_end("close"),
        "_last_atr": series.at_end("atr"),
    }


def level_columns(bars: int = 3) -> list[str]:
    """The columns that levels are made of."""
    return ["high", "low", *[c for c, _ in EXTREMES], *level_series(bars)]


def level_candidates(technical: DataFrame, lookback: int = 60, bars: int = 3) -> DataFrame:
    """(ticker, price, origin, ordinal, close, atr): pivots of the recent window and extremes.

    Pivots are tested on the full history, so the window's left edge is exact.  ``close`` and ``atr`` are those of the
    last session.  All three are series (``level_series``), so that only the recent window leaves its task.
    """
    df = earlier.prepared(technical, level_series(bars)).where(F.col("_sessions_left") < lookback)
    day = F.date_format("date", "yyyy-MM-dd")
    last = F.col("_sessions_left") == 0
    position = (F.lit(lookback - 1) - F.col("_sessions_left").cast("long")) * 2
    found = items(
        F.when(
            F.col("high") == F.col(f"_highest_{bars}_around"),
            F.struct(
                F.col("high").alias("price"),
                F.concat(F.lit("swing high "), day).alias("origin"),
                position.alias("ordinal"),
            ),
        ),
        F.when(
            F.col("low") == F.col(f"_lowest_{bars}_around"),
            F.struct(
                F.col("low").alias("price"),
                F.concat(F.lit("swing low "), day).alias("origin"),
                (position + 1).alias("ordinal"),
            ),
        ),
        *[
            F.when(
                last & F.col(c).isNotNull(),
                F.struct(
                    F.col(c).alias("price"),
                    F.lit(name).alias("origin"),
                    F.lit(2 * lookback + k).cast("long").alias("ordinal"),
                ),
            )
            for k, (c, name) in enumerate(EXTREMES)
        ],
    )
    return df.select("ticker", "_last_close", "_last_atr", F.explode(found).alias("c")).select(
        "ticker", "c.*", F.col("_last_close").alias("close"), F.col("_last_atr").alias("atr")
    )


_LEVEL = "struct<price:double,origin:string,also:array<string>,also_prices:array<double>>"


def _merged(pool: Column, unit: Column, count: int) -> Column:
    """Greedy merge of candidates sorted by distance.

    Sorted, a candidate can only belong to the level chosen last, and once ``count``
    levels exist everything further away is left out.
    """
    start = F.array().cast(f"array<{_LEVEL}>")

    def step(levels: Column, c: Column) -> Column:
        n = F.size(levels)
        current = F.try_element_at(levels, F.lit(-1))
        twin = yes(F.abs(current["price"] - c["price"]) <= MERGE_ATR * unit)
        known = F.array_contains(current["also"], c["origin"]) | (current["origin"] == c["origin"])
        widened = F.struct(
            current["price"].alias("price"),
            current["origin"].alias("origin"),
            F.array_append(current["also"], c["origin"]).alias("also"),
            F.array_append(current["also_prices"], c["price"]).alias("also_prices"),
        )
        fresh = F.struct(
            c["price"].alias("price"),
            c["origin"].alias("origin"),
            F.array().cast("array<string>").alias("also"),
            F.array().cast("array<double>").alias("also_prices"),
        )
        head = F.slice(levels, 1, F.greatest(n - 1, F.lit(0)))
        return (
            F.when(twin & yes(known), levels)
            .when(twin, F.array_append(head, widened).cast(f"array<{_LEVEL}>"))
            .when(n == count, levels)
            .otherwise(F.array_append(levels, fresh).cast(f"array<{_LEVEL}>"))
        )

    return F.aggregate(pool, start, step)


def support_resistance(
    technical: DataFrame, lookback: int = 60, bars: int = 3, count: int = 2
) -> DataFrame:
    """(ticker, side, level_no, price, origin, label, distances, merged arrays).

    At most ``2 * lookback + 4`` candidates exist per ticker, so collecting them is bounded.
    """
    unit = F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.col("close") * 0.01)
    pools = level_candidates(technical, lookback, bars).withColumn("unit", unit)
    away = F.col("price") - F.col("close")
    side = F.when(F.col("price") > F.col("close") + LEAST_GAP_ATR * F.col("unit"), "resistance").when(
        F.col("price") < F.col("close") - LEAST_GAP_ATR * F.col("unit"), "support"
    )
    sort_price = F.when(F.col("side") == "resistance", F.col("price")).otherwise(-F.col("price"))
    chosen = (
        pools.withColumn("side", side)
        .where(F.col("side").isNotNull())
        .groupBy("ticker", "side", "close", "atr", "unit")
        .agg(
            F.sort_array(
                F.collect_list(F.struct(sort_price.alias("far"), "ordinal", "price", "origin"))
            ).alias("pool")
        )
        .withColumn("levels", _merged(F.col("pool"), F.col("unit"), count))
        .select("ticker", "side", "close", "atr", F.posexplode("levels").alias("no", "level"))
        .select("ticker", "side", "close", "atr", (F.col("no") + 1).cast("long").alias("level_no"), "level.*")
    )
    return chosen.select(
        "ticker",
        "side",
        "level_no",
        "price",
        "origin",
        _level_label().alias("label"),
        growth(F.col("price"), F.col("close")).alias("distance_pct"),
        F.when(F.col("atr") > 0, F.try_divide(away, F.when(F.col("atr") > 0, F.col("atr")))).alias(
            "distance_atr"
        ),
        "also",
        "also_prices",
    )


def _level_label() -> Column:
    """Origin and the first two merged origins, with their price where it differs."""
    pairs = F.slice(F.arrays_zip("also", "also_prices"), 1, 2)
    same = lambda p: F.round(p["also_prices"], 2) == F.round(F.col("price"), 2)
    texts = F.transform(
        pairs,
        lambda p: F.when(same(p), p["also"]).otherwise(
            F.concat(p["also"], F.lit(" "), F.format_string("%,.2f", p["also_prices"]))
        ),
    )
    return F.concat_ws(" / ", F.concat(F.array("origin"), texts))


def structure_states(df: DataFrame) -> DataFrame:
    """Add ``is_<state>`` booleans, ``states`` (active, by priority) and ``structure``."""
    made = earlier.prepared(df, earlier.STRUCTURE).withColumn("_gap_ema", earlier.inputs()["_gap_ema"])
    steps = stating()
    for step in steps:
        made = made.withColumns(step)
    helpers = [c for step in steps for c in step if c.startswith("_")]
    return earlier.without(made, df.columns).drop(*helpers)


def stating() -> list[series.Step]:
    """The same as steps over the indicators and the earlier sessions' series.

    What several states read is a step before them, and they are not written out in full: Java compiles no method over 8,000
    bytes, and interprets it for every row.
    """
    c, a, ratio = F.col("close"), F.col("atr"), F.col("ta_volume_ratio")
    e9, e21 = F.col("ema9"), F.col("ema21")
    was, was9, was21 = (F.col(earlier.lagged(x, 1)) for x in ("close", "ema9", "ema21"))
    up, down = crossed(F.col("_gap_ema"), earlier.ends("_gap_ema"))
    breakout, breakdown, pullback, gap9, gap21, at9, at21 = (
        F.col(f"_{k}") for k in ("breakout", "breakdown", "pullback", "gap9", "gap21", "at9", "at21")
    )
    shared = {
        "_breakout": yes(c > F.col("prior_high20")),
        "_breakdown": yes(c < F.col("prior_low20")),
        "_pullback": every(e9 > e21, F.col("ema21_slope") > 0, F.col("ta_return_3d") < 0, c > e21),
        "_gap9": F.try_divide(F.abs(c - e9), a),
        "_gap21": F.try_divide(F.abs(c - e21), a),
    }
    nearer21 = every(gap21 <= NEAR_ATR, gap21 < gap9)
    near = [{"_at9": pullback & yes(gap9 <= NEAR_ATR) & ~nearer21}, {"_at21": pullback & yes(gap21 <= NEAR_ATR) & ~at9}]
    room = F.col("prior_high20") - c
    rsi_change = apart(F.col("rsi6"), F.col(earlier.lagged("rsi6", 3)))
    hist_change = apart(F.col("macd_hist"), F.col(earlier.lagged("macd_hist", 3)), c)
    tests = {
        "breakout_volume": every(breakout, ratio >= HEAVY_VOLUME),
        "breakout_normal": every(breakout, ratio >= WEAK_VOLUME, ratio < HEAVY_VOLUME),
        "breakout_weak": every(breakout, ratio < WEAK_VOLUME),
        "breakdown_volume": every(breakdown, ratio >= HEAVY_VOLUME),
        "breakdown": breakdown & ~yes(ratio >= HEAVY_VOLUME),
        "losing_ema21": every(c < e21, was >= was21),
        "reclaiming_ema21": every(c > e21, was <= was21),
        "ema_cross_down": down,
        "ema_cross_up": up,
        "pullback_ema9": at9,
        "pullback_ema21": at21,
        "pullback": pullback & ~at9 & ~at21 & yes(c < e9),
        "losing_ema9": every(c < e9, was >= was9),
        "reclaiming_ema9": every(c > e9, was <= was9),
        "near_breakout": ~breakout & every(room >= 0, room <= NEAR_EXTREME_ATR * a),
        "momentum_deterioration": every(e9 > e21, rsi_change <= -RSI_DROP, hist_change < 0),
        "ema_compression": yes(F.abs(e9 - e21) <= COMPRESSION_ATR * a),
        "volatility_squeeze": yes(F.col("bb_width_percentile") <= 20),
        "range": every(F.col("high20") - F.col("low20") <= 4 * a, F.col("adx") < 20),
        "bull_stack": every(c > e9, e9 > e21),
        "bear_stack": every(c < e9, e9 < e21),
    }
    return [shared, *near, {f"is_{k}": tests[k] for k in STATES}, {"structure": primary_state(), "states": active_states()}]


def primary_state() -> Column:
    return first_match([(F.col(f"is_{k}"), text) for k, text in STATES.items()], NO_STRUCTURE)


def active_states() -> Column:
    return items(*[F.when(F.col(f"is_{k}"), text) for k, text in STATES.items()])


def reference_levels(last: DataFrame) -> DataFrame:
    """Extremes and averages around each last session: distances and a mark.

    Marks: "beyond" (close outside the previous 20 sessions), "near", or empty.
    """
    c, a = F.col("close"), F.col("atr")
    sized = yes(a > 0)

    def entry(no: int, name: str, column: str, mark: Column) -> Column:
        x = F.col(column)
        return F.when(
            x.isNotNull(),
            F.struct(
                F.lit(no).cast("long").alias("ref_no"),
                F.lit(name).alias("reference"),
                x.alias("value"),
                growth(x, c).alias("distance_pct"),
                F.when(sized, F.try_divide(x - c, F.when(sized, a))).alias("distance_atr"),
                mark.alias("mark"),
            ),
        )

    def extreme_mark(beyond: Column, gap: Column) -> Column:
        near = sized & yes(gap <= NEAR_EXTREME_ATR * a)
        return F.when(yes(beyond), "beyond").when(near, "near").otherwise("")

    marks = {
        "high20": extreme_mark(c > F.col("prior_high20"), F.col("high20") - c),
        "low20": extreme_mark(c < F.col("prior_low20"), c - F.col("low20")),
    }
    rows = [
        entry(k, name, column, marks.get(column, F.lit("")))
        for k, (column, name) in enumerate(EXTREMES)
    ]
    for k, (column, name) in enumerate(REFERENCES):
        near = sized & yes(F.abs(c - F.col(column)) <= NEAR_ATR * a)
        rows.append(entry(len(EXTREMES) + k, name, column, F.when(near, "near").otherwise("")))
    return last.select("ticker", F.explode(items(*rows)).alias("r")).select("ticker", "r.*")


def proximity_notes(last: DataFrame) -> DataFrame:
    """Rows (ticker, note_no, reference, kind, value, gap_atr, note), in reading order.

    The gap is reference minus close for the extremes, close minus reference for averages.
    """
    c, a = F.col("close"), F.col("atr")
    usable = yes(a > 0)

    def entry(no: int, when: Column, reference: str, kind: str, column: str, gap: Column, text: str,
              numbers: int) -> Column:
        x = F.col(column)
        gap_atr = F.try_divide(gap, F.when(usable, a))
        values = [x, gap_atr][:numbers]
        return F.when(
            usable & when,
            F.struct(
                F.lit(no).cast("long").alias("note_no"),
                F.lit(reference).alias("reference"),
                F.lit(kind).alias("kind"),
                x.alias("value"),
                gap_atr.alias("gap_atr"),
                F.format_string(text, *values).alias("note"),
            ),
        )

    # The wording of the notes.
    high_near = "Within 1 ATR of the 20D high (%,.2f, %+.2f ATR)."
    low_near = "Within 1 ATR of the 20D low (%,.2f, %+.2f ATR)."
    above = "Closed above the previous 20-session high (%,.2f)."
    below = "Closed below the previous 20-session low (%,.2f)."
    broke_up, broke_down = yes(c > F.col("prior_high20")), yes(c < F.col("prior_low20"))
    near_high = yes(F.col("high20") - c <= NEAR_EXTREME_ATR * a)
    near_low = yes(c - F.col("low20") <= NEAR_EXTREME_ATR * a)
    rows = [
        entry(0, broke_up, "20D high", "beyond", "prior_high20", F.col("prior_high20") - c, above, 1),
        entry(1, ~broke_up & near_high, "20D high", "near", "high20", F.col("high20") - c, high_near, 2),
        entry(2, broke_down, "20D low", "beyond", "prior_low20", F.col("prior_low20") - c, below, 1),
        entry(3, ~broke_down & near_low, "20D low", "near", "low20", F.col("low20") - c, low_near, 2),
    ]
    for k, (column, name) in enumerate(REFERENCES):
        near = yes(F.abs(c - F.col(column)) <= NEAR_ATR * a)
        text = f"Near {name} (%,.2f, %+.2f ATR from it)."
        rows.append(entry(4 + k, near, name, "near", column, c - F.col(column), text, 2))
    return last.select("ticker", F.explode(items(*rows)).alias("r")).select("ticker", "r.*")
