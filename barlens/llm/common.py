"""What the corpus operators share: words, stored steps, checked broadcasts, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty.  ``bytes.split()`` cuts at exactly the bytes of WORD."""
    values = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in values.cast(pa.large_binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], name: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` text bytes, so that memory follows the slice."""
    for batch in batches:
        sizes = [len(x) for x in utf8(batch, name)]
        start = held = 0
        for i, n in enumerate(sizes):
            held += n
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _scrambled(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Masks of the first 0 to 8 bytes of a little-endian number.
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def hashed_words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text's bytes begin, and a 64-bit hash of each.

    A word's hash starts from its length and takes in eight bytes at a time, scrambled after each.
    Words are hashed some at a time, to bound memory.
    """
    outside = np.ones(len(buffer) + 2, bool)
    outside[1:-1] = _SPACE[buffer]
    edges = np.flatnonzero(outside[1:] != outside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buffer) + 1, "<u8", padded, strides=(1,))
    hashes = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), 100_000):
        at, left = starts[a : a + 100_000], sizes[a : a + 100_000]
        more, part = np.arange(len(at)), left.astype(np.uint64)
        while len(more):
            part[more] = _scrambled(part[more] * np.uint64(0x9E3779B97F4A7C15) + (eight[at] & _BYTES[np.minimum(left, 8)]))
            longer = left > 8
            more, at, left = more[longer], at[longer] + 8, left[longer] - 8
        hashes[a : a + 100_000] = part
    return starts, hashes


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read from there.

    A lost executor loses none of them.  A local folder is made only for a local master that
    names none, as in tests; a cluster without a shared folder is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def small(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast, given only if the frame was counted and has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(names: list[str], stem: str) -> str:
    """A column name that is none of ``names``, whatever their case."""
    taken = {x.lower() for x in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``, longs: ``(node, root)``, root the smallest node.

    Every node is tied to the smallest neighbour it knows, in turns over larger and over smaller
    neighbours, until nothing changes; a round is two aggregates whose keys are combined before the
    shuffle, and chains halve each round.  A node with very many links is never held as a group:
    only the minimum of its neighbours is.
    """
    tied = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    before = None
    while True:
        # every node above its smallest neighbour points to that neighbour, and so do its larger neighbours
        both = tied.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(tied.select("lo", "hi"))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("least").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("floor"))
        small_star = (
            large.join(floor, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("floor").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("floor").alias("lo")))).alias("x"))
            .select("x.hi", "x.lo")
            .where("hi <> lo")
            .distinct()
        )
        tied = stored(small_star)
        now = tied.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    nodes = tied.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.union(nodes.select("root", "root")).distinct()
