"""Exact medians of groups of any size, from a mergeable sketch.

``median()`` keeps a group's distinct values in one task.  That is fine per ticker
(bounded by the calendar) but not for groups pooled over all tickers.  Here one wide aggregate
sketches every column of every group, which brackets the median between two values of
known rank error.  A second pass counts what lies below the bracket and keeps what lies
inside, about 4 in ``ACCURACY`` values.  What was kept is cut again, at approximate quantiles of its own, until no
column of a group has more than ``RANKED`` values left; these are ranked.  So the rows are read twice, at any
size and whatever the outliers.

The keys must be a FIXED set of groups (here nine labels): the table of brackets has one
row per key, a proven bound, and is broadcast, so that a group holding most of
the rows is never shuffled to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed
from .search import count_up_to

#: The sketch errs by at most one in ``ACCURACY`` ranks; the bracket is two such errors wide on either side.
ACCURACY = 2000
#: Cells of a further cut, and distinct values of a column and group that one task ranks.
CELLS, RANKED = 128, 1_000_000
_LOWEST = float("-inf")
_LOW, _HIGH = "(_n + 1) div 2", "_n div 2 + 1"


def _entry(metric: int | Column, value: Column) -> Column:
    metric = F.lit(metric) if isinstance(metric, int) else metric
    return F.struct(metric.cast("int").alias("m"), value.cast("double").alias("v"))


def _counted(rows: DataFrame, keys: list[str], entries: Column, copies: Column) -> DataFrame:
    """``(keys, _m, _v, _copies)``: how often an entry occurs."""
    rows = rows.select(*keys, F.explode(entries).alias("_e"), copies.alias("_copies"))
    return rows.groupBy(*keys, F.col("_e.m").alias("_m"), F.col("_e.v").alias("_v")).agg(F.sum("_copies").alias("_copies"))


def _narrowed(kept: DataFrame, metric: list[str], ranks: DataFrame) -> DataFrame:
    """What was kept, cut down to the cell of the middle ranks; all below it is one row at the lowest value."""
    inside = F.when(F.col("_v") > _LOWEST, F.col("_v"))
    cuts = kept.groupBy(*metric).agg(F.percentile_approx(inside, [k / CELLS for k in range(1, CELLS)], 100 * CELLS).alias("_cuts"))
    celled = kept.join(F.broadcast(cuts), metric).withColumn("_cell", F.coalesce(count_up_to(F.col("_cuts"), F.col("_v"), CELLS), F.lit(0))).drop("_cuts")
    order = Window.partitionBy(*metric).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = celled.groupBy(*metric, "_cell").agg(F.sum("_copies").alias("_held")).withColumn("_upto", F.sum("_held").over(order))
    cells = cells.join(ranks, metric).where(f"_upto >= {_LOW} and _upto - _held < {_HIGH}")
    middle = cells.groupBy(*metric).agg(F.min("_cell").alias("_from"), F.max("_cell").alias("_to"))
    seen = celled.join(F.broadcast(middle), metric).where("_cell <= _to")
    value = F.when(F.col("_cell") < F.col("_from"), _LOWEST).otherwise(F.col("_v"))
    return seen.groupBy(*metric, value.alias("_w")).agg(F.sum("_copies").alias("_copies")).withColumnRenamed("_w", "_v")


def exact_medians(df: DataFrame, keys: list[str], columns: list[str], further: list[Column] = ()) -> DataFrame:
    """One row per key with ``further`` aggregates and the median of each column, named like the column."""
    spark, bits = df.sparkSession, range(len(columns))
    both = [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY]
    grouped = df.groupBy(*keys).agg(
        *further,
        *[F.count(c).alias(f"_n_{c}") for c in columns],
        *[F.percentile_approx(c, both, ACCURACY).alias(f"_in_{c}") for c in columns],
    )
    # one row a group
    known = spark.createDataFrame(grouped.collect(), grouped.schema)
    bounds = {i: [F.get(f"_in_{c}", F.lit(side)).cast("double") for side in (0, 1)] for i, c in enumerate(columns)}
    rows = df.select(*keys, *columns).join(F.broadcast(known.select(*keys, *[f"_in_{c}" for c in columns])), keys)
    inside = [F.when(F.col(c).between(*bounds[i]), _entry(i, F.col(c))) for i, c in enumerate(columns)]
    # what lies below is one entry a row, a bit per column: it combines map-side to a few counts
    below = sum((F.when(F.col(c) < bounds[i][0], 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0))
    kept = checkpointed(_counted(rows, keys, F.array_compact(F.array(_entry(-1, below), *inside)), F.lit(1)))
    spread = [F.when(F.col("_v").cast("long").bitwiseAND(1 << i) != 0, _entry(i, F.lit(_LOWEST))) for i in bits]
    spread = F.when(F.col("_m") < 0, F.array_compact(F.array(*spread))).otherwise(F.array(_entry(F.col("_m"), F.col("_v"))))
    kept = checkpointed(_counted(kept, keys, spread, F.col("_copies")))

    metric = [*keys, "_m"]
    sizes = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(f"_n_{c}").alias("n")) for i, c in enumerate(columns)]))
    ranks = F.broadcast(known.select(*keys, sizes.alias("_s")).select(*keys, F.col("_s.m").alias("_m"), F.col("_s.n").alias("_n")))
    while (kept.groupBy(*metric).count().agg(F.max("count")).head()[0] or 0) > RANKED:
        kept = checkpointed(_narrowed(kept, metric, ranks))

    upto = F.sum("_copies").over(Window.partitionBy(*metric).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = kept.withColumn("_upto", upto).join(ranks, metric)

    def of_rank(rank: str) -> Column:
        return F.max(F.when(F.expr(f"_upto >= {rank} and _upto - _copies < {rank}"), F.col("_v")))

    found = ranked.groupBy(*metric).agg(((of_rank(_LOW) + of_rank(_HIGH)) / 2).alias("_median"))
    medians = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == i, F.col("_median"))).alias(c) for i, c in enumerate(columns)])
    named = [f for f in grouped.columns if f not in keys and not f.startswith(("_n_", "_in_"))]
    return known.select(*keys, *named).join(medians, keys, "left")
