"""Keyed merges: a new snapshot of a table from the stored one and incoming rows.

Parquet has no MERGE; a merge is one full outer join on the key with a rule per
column.  The result is written to a new version and swapped in by the caller.  All
merges are idempotent, so a repeated or retried merge changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import finite, some, yes
from ..vocab import (
    ABNORMAL_OUTCOMES,
    DATE_MATCHED,
    EARNINGS_CATEGORY,
    EVENT_COLUMNS,
    OUTCOMES,
    PRICE_OUTCOMES,
    RESEARCH_FIELDS,
    RESEARCHED,
    STOCK_FIELDS,
    UNKNOWN_CATEGORY,
    UNVERIFIED,
)

Rule = Callable[[Column, Column], Column]

AUTOMATIC_STATUSES = (UNVERIFIED, DATE_MATCHED)
AUTOMATIC_CATEGORIES = (UNKNOWN_CATEGORY, EARNINGS_CATEGORY)


def replace(new: Column, old: Column) -> Column:
    return new


def keep(new: Column, old: Column) -> Column:
    return old


def known(new: Column, old: Column) -> Column:
    """The new value unless it is missing."""
    return F.coalesce(new, old)


def first_known(new: Column, old: Column) -> Column:
    return F.coalesce(old, new)


def keyed_merge(
    stored: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, Rule | Column]
) -> DataFrame:
    """Full outer join on ``keys``; a rule applies to rows present on both sides.

    A rule is a function of (new, old), or a Column over ``new_<c>`` and ``old_<c>``.
    Rows on one side only keep their values.
    """
    columns = list(rules)

    def side(df: DataFrame, prefix: str) -> DataFrame:
        have = set(df.columns)
        absent = F.lit(None)
        return df.select(
            *keys,
            F.lit(True).alias(f"{prefix}row"),
            *[(F.col(c) if c in have else absent).alias(f"{prefix}{c}") for c in columns],
        )

    joined = side(stored, "old_").join(side(incoming, "new_"), keys, "full_outer")

    def value(c: str) -> Column:
        new, old, rule = F.col(f"new_{c}"), F.col(f"old_{c}"), rules[c]
        both = rule if isinstance(rule, Column) else rule(new, old)
        return F.when(F.col("old_row").isNull(), new).when(F.col("new_row").isNull(), old).otherwise(both)

    return joined.select(*keys, *[value(c).alias(c) for c in columns])


def merge_stocks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known profile values replace stored ones; the first analysis date stays."""
    rules: dict[str, Rule | Column] = {c: known for c in STOCK_FIELDS}
    rules |= {"first_analyzed": keep, "last_analyzed": replace}
    return keyed_merge(stored, incoming, ["ticker"], rules)


def merge_prices(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """An incoming bar replaces the stored bar of its date."""
    values = [c for c in stored.columns if c not in ("ticker", "date")]
    return keyed_merge(stored, incoming, ["ticker", "date"], dict.fromkeys(values, replace))


def merge_fundamentals(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    keys = ["ticker", "period_type", "period_end", "metric"]
    values = ["value", "unit", "source", "retrieved_at"]
    return keyed_merge(stored, incoming, keys, dict.fromkeys(values, replace))


def merge_events(stored: DataFrame, incoming: DataFrame, automatic_sources: tuple[str, ...]) -> DataFrame:
    """Refresh figures, protect research.

    Benchmark figures survive a run without a benchmark, known outcomes survive unknown
    ones, and research fields are replaced only while every stored one is machine-written
    and the new row brings evidence.  Notes are never overwritten.
    """
    refresh = (
        yes(F.col("old_verification_status").isin(*AUTOMATIC_STATUSES))
        & yes(F.col("old_event_category").isin(*AUTOMATIC_CATEGORIES))
        & (F.col("old_source").isNull() | yes(F.col("old_source").isin(*automatic_sources)))
        & yes(F.col("new_event_category") != UNKNOWN_CATEGORY)
    )
    compared = ("benchmark", "benchmark_return", "abnormal_return", *ABNORMAL_OUTCOMES)
    rules: dict[str, Rule | Column] = {}
    extra = [c for c in stored.columns if c not in EVENT_COLUMNS]
    for c in (*EVENT_COLUMNS, *extra):
        if c in ("ticker", "event_date"):
            continue
        if c in compared:
            rules[c] = F.when(F.col("new_benchmark").isNull(), F.col(f"old_{c}")).otherwise(
                F.col(f"new_{c}")
            )
        elif c in PRICE_OUTCOMES:
            rules[c] = known
        elif c == "notes":
            rules[c] = first_known
        elif c in RESEARCH_FIELDS:
            rules[c] = F.when(refresh, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))
        elif c in ("first_run_id", "created_at"):
            rules[c] = keep
        else:
            rules[c] = replace
    return keyed_merge(stored, incoming, ["ticker", "event_date"], rules)


def split_insert_update(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per ticker: how many incoming keys are new and how many are stored already."""
    keys = ["ticker", "event_date"]
    marks = stored.select(*keys, F.lit(True).alias("_stored"))
    return (
        incoming.select(*keys)
        .distinct()
        .join(marks, keys, "left")
        .groupBy("ticker")
        .agg(
            F.count_if(F.col("_stored").isNull()).alias("inserted"),
            F.count_if(F.col("_stored")).alias("updated"),
        )
    )


def refresh_outcomes(stored: DataFrame, stats: DataFrame, benchmark: str | None = None) -> DataFrame:
    """Fill in outcomes of stored events from fresh statistics.

    Abnormal outcomes only where the event used the same benchmark.  ``refreshed`` marks
    the events whose date is in the statistics.
    """
    columns = [c for c in OUTCOMES if c in stats.columns]
    fresh = stats.select(
        "ticker",
        F.col("date").alias("event_date"),
        F.lit(True).alias("_found"),
        *[F.col(c).alias(f"new_{c}") for c in columns],
    )
    joined = stored.join(fresh, ["ticker", "event_date"], "left")
    same = yes(F.col("benchmark") == F.lit(benchmark))

    def value(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        better = F.coalesce(F.col(f"new_{c}"), F.col(c))
        if c in ABNORMAL_OUTCOMES:
            better = F.when(same, better).otherwise(F.col(c))
        return better.alias(c)

    return joined.select(*[value(c) for c in stored.columns], yes(F.col("_found")).alias("refreshed"))


def evolve_events_schema(stored: DataFrame) -> DataFrame:
    """Older event tables get the outcome columns they lack, empty."""
    absent = {c: F.lit(None).cast("double") for c in OUTCOMES if c not in stored.columns}
    return stored.withColumns(absent) if absent else stored


def db_values(df: DataFrame) -> DataFrame:
    """Storable values: non-finite to NULL, booleans to 0/1, dates to ISO text."""

    def value(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return finite(c)
        if isinstance(field.dataType, T.BooleanType):
            return c.cast("int")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd")
        return c

    return df.select(*[value(f).alias(f.name) for f in df.schema])


# ---- manual research ---------------------------------------------------------------


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """Edited rows from CSV files with a header, with their place in ``_order``.

    The place is the file, where the row's block starts in it, and the row's number within the block, all from what
    the scan knows: no sort, and any number of tasks reads the files.
    """
    rows = spark.read.option("header", True).csv(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    return rows.withColumn("_order", place)


def _edits(edited: DataFrame) -> DataFrame:
    """Trimmed, non-blank cells of an edited table, one row per edited row, with its place in ``_order``.

    A frame without such a column is taken in the order in which Spark reads it.
    """
    have = [c for c in RESEARCH_FIELDS if c in edited.columns]
    key = {
        "ticker": F.upper(F.trim("ticker")),
        "event_date": F.coalesce(
            F.try_to_date(F.col("event_date").cast("string"), "yyyy-MM-dd"),
            F.try_to_date(F.col("event_date").cast("string"), "MM/dd/yyyy"),
        ),
    }
    place = F.col("_order") if "_order" in edited.columns else F.monotonically_increasing_id()
    none = F.lit(None).cast("string")
    return edited.select(
        *[k.alias(n) for n, k in key.items()],
        place.alias("_order"),
        *[(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in have else none).alias(f"new_{c}") for c in RESEARCH_FIELDS],
    )


def unmatched_keys(edited: DataFrame, stored: DataFrame) -> DataFrame:
    """Edited keys that no stored event has."""
    return (
        _edits(edited)
        .select("ticker", "event_date")
        .distinct()
        .join(stored.select("ticker", "event_date"), ["ticker", "event_date"], "left_anti")
    )


def _decided(edited: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored events that the file matches, with ``set_<field>`` where a field changes.

    Rows of one event apply in file order: of each field the last cell that is not blank stays.  A
    status written by hand is never replaced by an automatic one, so the last manual status wins; where neither the
    event nor any row has one, a row that changes research makes the status manual.  All of it is one
    aggregate, so an event with very many rows is never gathered.
    """
    keys = ["ticker", "event_date"]
    before = stored.select(*keys, *[F.col(c).alias(f"old_{c}") for c in RESEARCH_FIELDS])
    rows = _edits(edited).join(before, keys)
    status = F.col("new_verification_status")

    def last(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("_order")))

    def differs(c: str) -> Column:
        return F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}"))

    plain = [c for c in RESEARCH_FIELDS if c != "verification_status"]
    decided = rows.groupBy(*keys).agg(
        *[last(F.col(f"new_{c}")).alias(f"new_{c}") for c in plain],
        last(F.when(~status.isin(*AUTOMATIC_STATUSES), status)).alias("_by_hand"),
        last(F.when(status.isin(*AUTOMATIC_STATUSES), status)).alias("_automatic"),
        F.bool_or(some(*[differs(c) for c in ("event_category", "event_description", "source")])).alias("_research"),
    )
    joined = stored.join(decided, keys)
    was_automatic = yes(F.col("verification_status").isin(*AUTOMATIC_STATUSES))
    offered = {c: F.col(f"new_{c}") for c in plain}
    offered["verification_status"] = F.coalesce("_by_hand", F.when(was_automatic, F.col("_automatic")))
    changed = {c: F.when(v.isNotNull() & ~v.eqNullSafe(F.col(c)), v).alias(f"set_{c}") for c, v in offered.items()}
    manual = was_automatic & F.col("_by_hand").isNull() & F.col("_research")
    return joined.select(*stored.columns, *changed.values(), manual.alias("_manual"))


def import_changes(edited: DataFrame, stored: DataFrame) -> DataFrame:
    """Change log (ticker, event_date, column, old, new); computing it changes nothing."""
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"set_{c}").isNotNull(),
                    F.struct(
                        F.lit(c).alias("column"), F.col(c).alias("old"), F.col(f"set_{c}").alias("new")
                    ),
                )
                for c in RESEARCH_FIELDS
            ]
        )
    )
    return (
        _decided(edited, stored)
        .select("ticker", "event_date", F.explode(entries).alias("e"))
        .select("ticker", "event_date", "e.*")
    )


def import_counts(edited: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: updated events, events set to manual, unmatched keys."""
    touched = F.coalesce(*[F.col(f"set_{c}") for c in RESEARCH_FIELDS]).isNotNull()
    counts = _decided(edited, stored).agg(
        F.count_if(touched).alias("updated_events"), F.count_if("_manual").alias("status_set_manual")
    )
    lost = unmatched_keys(edited, stored).agg(F.count("*").alias("unmatched"))
    # both sides are one-row totals, joined on a constant key
    return counts.withColumn("_k", F.lit(1)).join(lost.withColumn("_k", F.lit(1)), "_k").drop("_k")


def import_research(edited: DataFrame, stored: DataFrame) -> DataFrame:
    """New event snapshot with the edited research fields.

    Blanks change nothing, an automatic status never replaces a manual one, and research
    under a status that would still be automatic becomes "Researched manually".
    """
    decided = _decided(edited, stored).select(
        "ticker", "event_date", "_manual", *[f"set_{c}" for c in RESEARCH_FIELDS]
    )
    joined = stored.join(decided, ["ticker", "event_date"], "left")

    def value(c: str) -> Column:
        if c not in RESEARCH_FIELDS:
            return F.col(c)
        new = F.coalesce(F.col(f"set_{c}"), F.col(c))
        if c == "verification_status":
            new = F.when(yes(F.col("_manual")), F.lit(RESEARCHED)).otherwise(new)
        return new.alias(c)

    return joined.select(*[value(c) for c in stored.columns])
