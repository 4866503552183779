"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked through sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.common import components, pieces, small, stored, unused, utf8

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Bits of the three blocks by which fingerprints are dealt to shards.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a shard that becomes one BK-tree; a larger shard is linked by neighbour codes.
TREE = 2048
SMALL_KEYS = 200_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all shingles of lower-cased words; no words: 0."""
    words = text.lower().split()  # bytes: A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cut = map(slice, starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, cut), repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(doc_id, code)``, one row per input row; ``code`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            codes = [_signed(fingerprint(x, shingle, seed)) for x in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], ["doc_id", "code"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, code long")


class BKTree:
    """Codes in a tree whose children hang on the edge of their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, code: int) -> None:
        if self.root is None:
            self.root = (code, {})
            return
        node = self.root
        while True:
            d = (code ^ node[0]).bit_count()
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (code, {})
                return
            node = node[1][d]

    def within(self, code: int, radius: int) -> Iterator[int]:
        """Codes at most ``radius`` away: only edges within the radius of the distance can lead there."""
        open_ = [self.root] if self.root else []
        while open_:
            held, children = open_.pop()
            d = (code ^ held).bit_count()
            if d <= radius:
                yield held
            for edge in range(max(1, d - radius), d + radius + 1):
                if edge in children:
                    open_.append(children[edge])


def _trees(radius: int):
    """Links of each shard that join its codes; a pair already joined by others is not named again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for codes in batch.column(0).to_pylist():
                tree, above = BKTree(), {}

                def top(x: int, above: dict = above) -> int:
                    while above[x] != x:
                        above[x] = x = above[above[x]]
                    return x

                for code in codes:
                    code &= (1 << 64) - 1
                    above[code] = code
                    for near in tree.within(code, radius):
                        p, q = top(code), top(near)
                        if p != q:
                            above[p] = q
                            a.append(_signed(code))
                            b.append(_signed(near))
                    tree.add(code)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def links(codes: DataFrame, limit: int = TREE) -> DataFrame:
    """``(a, b)``: links that join all of the distinct ``codes(code)`` at 2 or fewer differing bits.

    Two codes that differ in at most 2 of 64 bits agree on one of three blocks, so each code goes to
    three shards, and a shard's BK-tree holds every code its members can link to; trees are built in
    the task that gets the shard, as broadcasting all of them would grow with the data.  A shard of
    more than ``limit`` codes is not one tree.  There each code sends itself and its one-bit
    neighbours; codes that meet there are at most 2 apart and all such codes meet, at most 65 a place.
    """
    keys = F.array(*[
        F.struct(F.lit(i).alias("no"), F.shiftrightunsigned("code", at).bitwiseAND(F.lit((1 << n) - 1)).alias("value")) for i, (at, n) in enumerate(BLOCKS)
    ])
    shards = codes.select("code", F.explode(keys).alias("k")).select("code", (F.col("k.value") * 4 + F.col("k.no")).alias("key"))
    hot = small(stored(shards.groupBy("key").count().where(F.col("count") > limit).select("key")), SMALL_KEYS)
    groups = shards.join(hot, "key", "left_anti").groupBy("key").agg(F.collect_list("code").alias("codes")).where(F.size("codes") > 1)
    near = groups.select("codes").mapInArrow(_trees(RADIUS), "a long, b long")
    crowded = shards.join(hot, "key", "left_semi").select("code").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.array(*[F.lit(_signed(1 << b)) for b in range(64)]))
    places = crowded.select("code", F.explode(flips).alias("flip")).select("code", F.col("code").bitwiseXOR(F.col("flip")).alias("place"))
    met = places.groupBy("place").agg(F.collect_set("code").alias("codes")).where(F.size("codes") > 1)
    star = met.select(F.array_min("codes").alias("a"), F.explode("codes").alias("b")).where("a <> b").distinct()
    return near.union(star)


def groups(docs: DataFrame, limit: int = TREE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Fingerprints link at 2 or fewer differing bits; ``component_id`` is the smallest doc_id that links
    reach, its own included.  Null and empty texts have fingerprint zero and link like any other; rows
    with a null doc_id are members that name no component (null if a component has no other).  Equal
    texts are one fingerprint and are never paired.  An empty table gives no row; other columns are
    ignored.
    """
    marked, named = _named(docs, limit)
    return marked.join(named, "code").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def _named(docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, code)`` of every row, and ``(code, component_id)``."""
    marked = stored(fingerprints(docs))
    codes = stored(marked.groupBy("code").agg(F.min("doc_id").alias("least")))
    roots = components(links(codes.select("code"), limit))
    placed = codes.join(roots, codes["code"] == roots["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked, placed.join(least, "root").select("code", "root", "component_id")


def representatives(docs: DataFrame, limit: int = TREE) -> DataFrame:
    """The rows of ``docs`` that stand for their group: of each component the row with the smallest doc_id.

    Null ids come last, and of rows that share the id one stays.  Columns are those of ``docs``.
    """
    marked, named = _named(docs, limit)
    first = marked.join(named, "code").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "code")).alias("first"))
    names = docs.columns
    id_, none, code, nth = (unused(names, x) for x in ("_id", "_none", "_code", "_nth"))
    kept = first.select(F.coalesce("first.doc_id", F.lit(0).cast("long")).alias(id_), F.col("first.none").alias(none), F.col("first.code").alias(code))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            codes = [_signed(fingerprint(x)) for x in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], [*names, code])

    coded = docs.mapInArrow(run, docs.withColumn(code, F.lit(0).cast("long")).schema)
    coded = coded.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))).withColumn(none, F.col("doc_id").isNull())
    number = F.row_number().over(Window.partitionBy(id_, none, code).orderBy(F.xxhash64("text")))
    rows = coded.join(kept, [id_, none, code], "left_semi")
    return rows.withColumn(nth, number).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in names])
