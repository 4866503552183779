"""Source divergence audit: how far the term shares of each source lie from those of its peers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.common import pieces, stored

#: Documents that hold a kept term, shares in a whole, ranks of the term report (all fixed by the audit).
LEAST, WHOLE, RANKS = 3, 1_000_000_000, 200
#: Entries that a counting task holds before it sends them, postings in a shard of the index, pairs that one
#: call accumulates, and numbers worked on at once.
HELD, SHARD, PAIRS, AT_ONCE = 400_000, 500_000, 1_000_000, 2_000_000
#: Bytes of a text that are counted at once.
SLICE = 4_000_000
#: A term is a run of ASCII letters and characters from U+0080 on; A to Z are lower-cased, other bytes end it.
_TERM = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    start = 0
    text = text.translate(_TERM)
    while start < len(text):
        end = text.find(b" ", start + SLICE) if start + SLICE < len(text) else len(text)
        end = end if end >= 0 else len(text)
        yield text[start:end].split()
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents that hold the term, summed up by the reading task.

    A key may come several times; ``term`` is UTF-8.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (seen, held) in groups.items():
                k = len(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k), pa.array([source] * k), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array([held[t] for t in seen], pa.int64())],
                    schema=_COUNTS,
                )
            groups.clear()

        size = 0
        for batch in batches:
            for piece in pieces([batch], "text"):
                texts = piece.column(2).cast(pa.large_binary()).to_pylist()
                for lang, source, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), texts):
                    seen, held = groups.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(seen)
                    own: set[bytes] = set()
                    for terms in _terms(text):
                        seen.update(terms)
                        own.update(terms)
                    held.update(own)
                    size += len(seen)
                    if size >= HELD:
                        yield from flush()
                        size = 0
        yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term binary, n long, docs long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """The share of a count with one added to every kept term, in parts of ``WHOLE``; null if no term is kept."""
    over = total.cast("decimal(20,0)") + kept
    exact = F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), F.nullif(over, F.lit(0).cast("decimal(20,0)")))
    return exact.cast("long") + 1


def _shares(n: np.ndarray, over: np.ndarray) -> np.ndarray:
    """The same on arrays: long division by three digits at a time, as the product may pass 64 bits."""
    left, out = n + 1, np.zeros(np.broadcast(n, over).shape, np.int64)
    whole, left = left // over, left % over
    for _ in range(3):
        out, left = out * 1000 + left * 1000 // over, left * 1000 % over
    return 1 + whole * WHOLE + out


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Index:
    """A shard of the term-major index: for each term the peers that hold it and their shares."""

    def __init__(self, starts: np.ndarray, peers: np.ndarray, counts: np.ndarray, over: np.ndarray) -> None:
        self.starts, self.peers, self.terms = starts, peers, len(starts) - 1
        self.base = _shares(np.zeros(len(over), np.int64), over)
        self.p = _shares(counts, over[peers])
        self.term = np.repeat(np.arange(self.terms), np.diff(starts))
        rows = np.argsort(peers, kind="stable")
        self.rows = np.split(rows, np.searchsorted(peers[rows], np.arange(1, len(over))))
        self.distinct = [np.unique(self.p[r], return_counts=True) for r in self.rows]

    def row(self, g: int) -> np.ndarray:
        """Sums over the shard's terms for one group against every peer.

        Absent counts have a share too (the base), so the sum starts as if both held no term, is
        corrected for the terms of the group, for those of the peer, and for those that both hold:
        for these the group's terms are scattered through the index into one dense accumulator.
        """
        base, own = self.base, self.base[g]
        none = _gaps(own, base)
        total = none * self.terms
        values, times = self.distinct[g]
        step = max(1, AT_ONCE // len(base))
        for a in range(0, len(values), step):
            some = slice(a, a + step)
            total += (times[some, None] * (_gaps(values[some, None], base[None, :]) - none)).sum(axis=0)
        for h, (values, times) in enumerate(self.distinct):
            total[h] += (times * (_gaps(own, values) - none[h])).sum()
        mine = self.rows[g]
        every = np.diff(self.starts)[self.term[mine]]
        cuts = np.flatnonzero(np.diff(np.cumsum(every) // AT_ONCE)) + 1
        for some, sizes in zip(np.split(mine, cuts), np.split(every, cuts)):
            first = self.starts[self.term[some]]
            at = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
            p, q, h = np.repeat(self.p[some], sizes), self.p[at], self.peers[at]
            np.add.at(total, h, _gaps(p, q) - _gaps(p, base[h]) - _gaps(own, q) + none[h])
        return total


_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _accumulated(index: pa.Table, groups: pa.Table) -> pa.Table:
    """A shard's part of the values of the pairs of one language; the first of a pair lies in one block of its groups."""
    groups = groups.sort_by("nth")
    names, k = groups.column("source").combine_chunks(), groups.num_rows
    lang, block, size = (groups.column(c)[0].as_py() for c in ("lang", "block", "size"))
    found = None
    if index.num_rows:
        lists = index.column("postings").combine_chunks()
        held, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        peers = pc.index_in(held.field("source"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        over = groups.column("total").to_numpy() + groups.column("kept").to_numpy()
        found = Index(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), peers, held.field("n").to_numpy(zero_copy_only=False), over)
    out = []
    for g in range(block * size, min(k, (block + 1) * size)):
        values, others = found.row(g) if found else np.zeros(k, np.int64), np.arange(k) != g
        same = [pa.array([x] * (k - 1), pa.string()) for x in (lang, names[g].as_py())]
        out.append(pa.Table.from_arrays([*same, names.filter(pa.array(others)), pa.array(values[others])], schema=_PAIRS))
    return pa.concat_tables(out)


def audit(docs: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: the pair and term reports of every group of lang and source.

    Within a lang the terms of at least ``LEAST`` documents are kept.  A group's or the lang's share of a
    kept term is ``1 + floor(WHOLE * (count + 1) / (N + V))``, ``N`` the sum of its counts and ``V`` the
    number of kept terms.  ``pair`` ranks the other sources of the lang by the sum over all kept terms of
    ``floor((p - q)^2 / q)``; ``term`` ranks the terms that a group holds more of than the lang, to ``RANKS``.

    A null text, lang or source is read as ''.  Rows that repeat, or have no doc_id, count as documents of their own.  A group
    without terms takes part with shares of absent counts; a lang without kept terms has pairs of value
    0.  A text of any length is counted whole, in slices.  Ties rank by item, in order of UTF-8.  An
    empty table gives no row; other columns are ignored, whatever their names.

    A hot source adds at most one posting to a term, so the index of a term is at most as long as its
    lang has sources, and the shards deal the terms of a hot lang to many tasks.
    """
    slim = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    postings = (
        term_counts(slim)
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    index = stored(
        postings.groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "n")).alias("postings"), F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"))
        .where(F.col("docs") >= LEAST)
        .drop("docs")
    )
    held = index.select("lang", "term", "n_lang", F.inline("postings"))
    by_group = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = index.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("lang_total"), F.sum(F.size("postings")).alias("entries"))
    groups = slim.groupBy("lang", "source").agg(F.first(F.lit(1)).alias("one")).drop("one")
    zero = {"total": 0, "kept": 0, "lang_total": 0, "entries": 0}
    groups = stored(groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(zero))

    # every shard of a lang's terms meets every block of its groups
    by_lang = groups.groupBy("lang").agg(F.first("entries").alias("entries"), F.count("*").alias("sources"))
    by_lang = by_lang.withColumn("shards", F.expr(f"entries div {SHARD} + 1")).withColumn("size", F.expr(f"greatest(1L, {PAIRS}L div sources)"))
    plan = by_lang.select("lang", "shards", "size", F.expr("explode(sequence(0L, (sources - 1) div size))").alias("block"))
    numbered = groups.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    everywhere = numbered.select("lang", "source", "total", "kept", "nth").join(plan, "lang").withColumn("shard", F.expr("explode(sequence(0L, shards - 1))"))
    dealt = index.join(plan, "lang").withColumn("shard", F.expr("pmod(xxhash64(term), shards)"))
    key = ["lang", "shard", "block"]
    sums = (
        dealt.select(*key, "postings")
        .groupBy(*key)
        .cogroup(everywhere.select(*[F.col(c).alias(c) for c in (*key, "source", "total", "kept", "nth", "size")]).groupBy(*key))
        .applyInArrow(_accumulated, "lang string, source string, item string, value long")
    )
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    within = Window.partitionBy("lang", "source").orderBy(*order)
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(within))

    told = held.join(groups.where("kept > 0").drop("entries"), ["lang", "source"]).select(
        "lang",
        "source",
        F.col("term").cast("string").alias("item"),
        share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("n_lang"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    terms = told.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= RANKS)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*out).union(terms.select(*out))
