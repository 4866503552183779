"""File outputs, and where scratch output may go."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import shared_folder
from ..functions.nulls import finite
from ..vocab import FUNDAMENTAL_COLUMNS


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def events_sink_csv(events: DataFrame, path: str) -> None:
    """Events without the settings column, dates as ISO text."""
    (
        events.drop("detection_settings")
        .withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )


def fundamentals_frame(records: DataFrame) -> DataFrame:
    return records.select(*FUNDAMENTAL_COLUMNS)


def fundamentals_sink_csv(records: DataFrame, path: str) -> None:
    fundamentals_frame(records).write.mode("overwrite").option("header", True).csv(path)


def outcomes_sink_csv(outcomes: DataFrame, path: str) -> None:
    outcomes.write.mode("overwrite").option("header", True).csv(path)


def jsonable(column: Column, kind: T.DataType) -> Column:
    """Non-finite numbers become NULL, dates ISO text; arrays and structs recursively."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(column)
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: jsonable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(
            column.isNotNull(),
            F.struct(*[jsonable(column[f.name], f.dataType).alias(f.name) for f in kind]),
        )
    return column


def analysis_documents(sections: dict[str, DataFrame]) -> DataFrame:
    """One row per ticker with one column per section.

    A section is an array of structs, NULL where a ticker has none.  All sections are stacked, each row in the column of
    its section, and grouped once, so a ticker that only one section knows has its document.  All
    sections are summaries: bounded rows per ticker.
    """
    stacked = None
    for name, df in sections.items():
        row = F.struct(
            *[jsonable(F.col(f.name), f.dataType).alias(f.name) for f in df.schema if f.name != "ticker"]
        )
        part = df.select("ticker", row.alias(name))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    gathered = stacked.groupBy("ticker").agg(*[F.sort_array(F.collect_list(name)).alias(name) for name in sections])
    return gathered.select("ticker", *[F.when(F.size(name) > 0, F.col(name)).alias(name) for name in sections])


def analysis_json_sink(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").option("ignoreNullFields", False).json(path)
