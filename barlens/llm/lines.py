"""Line dedup: an exact set-similarity join of lines by rarity-ordered prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import hashed_words, parts, pieces, stored, utf8

#: Lines match at a Jaccard similarity of 4/5 of their sets of words.
TOP, BOTTOM = 4, 5
#: Text bytes in a chunk, prefix entries in a bucket: what a task holds at a time.
CHUNK, BUCKET = 6_000_000, 1 << 19
#: Cells of the table of word counts: its size is fixed, whatever the corpus.
CELLS = 1 << 20
#: Entries of one word that are compared at all distances; candidates after which an entry rests.
GROUP, RESTS = 4096, 4
LAST = np.iinfo(np.int64).max
#: Line numbers that are broadcast to the chunks at most (8 MB); more are joined by a shuffle.
SENT = 1_000_000
#: Cells by which a second search is kept to the words of the lines that ask: its size is fixed.
ASKED = 1 << 22


def _split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts' lines: a 64-bit hash of each, and the number of its line among all."""
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, hashes = hashed_words(buffer)
    return hashes, np.searchsorted(np.flatnonzero(buffer == 10), starts)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpacked(body: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body))))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows packed into chunks; at the end, how often the task met words of each cell."""
    seen, n, entries = np.zeros(CELLS, np.int64), 0, 0

    def row(body, counts, size):
        return pa.RecordBatch.from_arrays(
            [pa.array([(TaskContext.get().partitionId() << 32) + n], pa.int64()), pa.array([body], pa.binary()), pa.array([counts], pa.binary()), pa.array([size], pa.int64())],
            ["chunk", "body", "seen", "words"],
        )

    for n, batch in enumerate(pieces(batches, "text", CHUNK)):
        words = _split(utf8(batch, "text"))[0]
        seen += np.bincount((words >> np.uint64(44)).astype(np.int64), minlength=CELLS)
        yield row(_packed(batch), None, len(words))
        entries += len(words)
    if entries:
        n += 1
        yield row(None, zstandard.ZstdCompressor(level=1).compress(seen.tobytes()), 0)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(CELLS, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            seen += np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(seen.tobytes())], pa.binary())], ["seen"])


def _rarity(chunks: DataFrame) -> np.ndarray:
    """Word counts of the whole corpus, by cell: tasks' tables are summed in two levels."""
    told = chunks.where("seen is not null").select("seen")
    some = max(1, int(chunks.rdd.getNumPartitions() ** 0.5))
    total = told.coalesce(some).mapInArrow(_summed, "seen binary").repartition(1).mapInArrow(_summed, "seen binary").collect()
    seen = np.frombuffer(zstandard.ZstdDecompressor().decompress(total[0][0]), np.int64)
    return np.minimum(seen, np.iinfo(np.uint32).max).astype(np.uint32)


def _ordered(where: np.ndarray, common: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places by line, count and hash: one sort of packed keys, unless keys of different words are equal."""
    if len(where) and where[-1] < 1 << 17:
        key = (where.astype(np.uint64) << np.uint64(47)) | (np.minimum(common, (1 << 20) - 1).astype(np.uint64) << np.uint64(27)) | (hashes >> np.uint64(37))
        order = np.argsort(key)
        key, found = key[order], hashes[order]
        if not ((key[1:] == key[:-1]) & (found[1:] != found[:-1])).any():
            return order
    return np.lexsort((hashes, np.minimum(common, (1 << 20) - 1), where))


class _Lines:
    """The lines of a chunk: their documents, sets of words in order of rarity, and which repeat.

    ``line[i]`` is the number in its document, ``doc`` and ``at`` its document; ``word`` holds the
    distinct words line after line, rarest first, ``first`` and ``size`` say where.  ``rep[i]`` is the earliest line
    of the chunk with the same set, -1 for a line without words.
    """

    def __init__(self, rows: pa.RecordBatch, seen: np.ndarray) -> None:
        ids = rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
        texts = utf8(rows, "text")
        per = np.array([x.count(b"\n") + 1 for x in texts], np.int64)
        counts = np.zeros(per.sum())
        self.at = np.repeat(np.arange(len(texts)), per)
        self.line = np.arange(len(counts)) - np.repeat(np.cumsum(per) - per, per)
        self.doc = np.array([LAST if x is None else x for x in ids], np.int64)[self.at]
        hashes, where = _split(texts)
        common = seen[hashes >> np.uint64(44)]
        order = _ordered(where, common, hashes)
        where, hashes = where[order], hashes[order]
        new = np.ones(len(where), bool)
        new[1:] = (where[1:] != where[:-1]) | (hashes[1:] != hashes[:-1])
        self.where, self.word = where[new], hashes[new]
        self.size = np.bincount(self.where, minlength=len(counts))
        self.first = np.cumsum(self.size) - self.size
        self.pos = np.arange(len(self.word)) - self.first[self.where]
        full = np.flatnonzero(self.size)
        self.bits = np.zeros((2, len(counts)), np.uint64)
        self.name = np.zeros((2, len(counts)), np.uint64)
        if len(full):
            cell = (self.word >> np.uint64(8)) % np.uint64(96)
            one = np.uint64(1) << (cell & np.uint64(63))
            high = cell > 63
            for k, part in enumerate((np.where(high, np.uint64(0), one), np.where(high, one, np.uint64(0)))):
                self.bits[k, full] = np.bitwise_xor.reduceat(part, self.first[full])
            for k, by in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                mixed = (self.word ^ (self.word >> np.uint64(29 + k))) * np.uint64(by)
                self.name[k, full] = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), self.first[full])
        self.rep = np.full(len(counts), -1)
        held: dict[tuple, int] = {}
        for i in np.argsort(self.doc, kind="stable").tolist():
            if self.size[i]:
                self.rep[i] = held.setdefault((self.name[0, i], self.name[1, i], self.size[i]), i)


#: A prefix entry: part of the word's hash, the line, 96 parity bits and part of its name.
_ENTRY = (("word", np.uint32), ("doc", np.int64), ("low", np.uint64), ("high", np.uint32), ("name", np.uint32), ("ref", np.uint32), ("line", np.uint32), ("size", np.uint32), ("pos", np.uint32), ("asks", np.uint8))


def _cell(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(20)) & np.uint64(ASKED - 1)


def _entries(seen: np.ndarray, buckets: int, wanted: np.ndarray | None = None):
    """Prefix entries of every distinct line of a chunk, one row a bucket; one has the lines that repeat in the chunk."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                x = _Lines(_unpacked(row["body"]), seen)
                asks = np.ones(len(x.size), np.uint8)
                if "asked" in row:
                    asks[:] = 0
                    asks[row["asked"] or []] = 1
                size = x.size[x.where]
                keep = (x.pos < size - -(-TOP * size // BOTTOM) + 1) & (x.rep[x.where] == x.where)
                if wanted is not None:
                    keep &= wanted[_cell(x.word)]
                at, word = x.where[keep], x.word[keep]
                values = (word & np.uint64(0xFFFFFFFF), x.doc[at], x.bits[0, at], x.bits[1, at], x.name[0, at] >> np.uint64(32), at, x.line[at], size[keep], x.pos[keep], asks[at])
                bucket = ((word >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                columns = [v.astype(t)[order] for v, (_, t) in zip(values, _ENTRY, strict=True)]
                full = np.flatnonzero(np.diff(edges))
                again = np.flatnonzero((x.rep >= 0) & (x.rep != np.arange(len(x.rep))))
                repeats = np.stack([again, x.doc[again], x.line[again], x.doc[x.rep[again]]]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()), pa.array(np.full(len(full), row["chunk"]), pa.int64()), pa.array(np.diff(edges)[full], pa.int64()),
                        pa.array([press.compress(b"".join(c[edges[b] : edges[b + 1]].tobytes() for c in columns)) for b in full], pa.binary()),
                        pa.array([repeats if len(again) and k == row["chunk"] % len(full) else None for k in range(len(full))], pa.binary()),
                    ],
                    ["bucket", "chunk", "n", "body", "repeats"],
                )

    return deal


def _passes(e: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of entries of one word may match, by length, position and parity bits.

    Matching sets share at least 4/9 of both sizes' sum.  At their first common word nothing before
    it is shared, so what follows must suffice; and sets differ in at least as many words as the
    parities of their words over 96 cells differ in bits.
    """
    m, n = e["size"][a], e["size"][b]
    need = -(-TOP * (m + n) // (TOP + BOTTOM))
    ok = (BOTTOM * np.minimum(m, n) >= TOP * np.maximum(m, n)) & (np.minimum(m - e["pos"][a], n - e["pos"][b]) >= need)
    at = np.flatnonzero(ok)
    a, b = a[at], b[at]
    apart = np.bitwise_count(e["low"][a] ^ e["low"][b]).astype(np.int64) + np.bitwise_count(e["high"][a] ^ e["high"][b])
    ok[at] = apart <= (m + n)[at] - 2 * need[at]
    return ok


def _candidates(every: bool, group: int = GROUP):
    """Pairs (later, earlier) of lines that share a prefix word and pass the filters.

    Of entries alike in size, parities and name, which are one set of words, the earliest stands for
    all; the others name it once (``same``), as do lines that repeat in their chunk.  Sets of fewer
    than four words match no other.  In a group of at most ``group`` entries each is compared with
    those before it, nearest first, in a larger one by sweeps of those that have found few.  An entry that has ``RESTS``
    candidates rests, so that a crowd of near copies gives a few pairs each; ``more`` says that it
    may have others.  With ``every``, entries that ask are compared with all earlier ones and give all pairs.
    """

    def find(table: pa.Table) -> pa.Table:
        back = zstandard.ZstdDecompressor()
        columns: dict[str, list] = {k: [] for k, _ in _ENTRY} | {"chunk": []}
        for row in table.to_pylist():
            body, at = back.decompress(row["body"]), 0
            for k, t in _ENTRY:
                columns[k].append(np.frombuffer(body, t, row["n"], at))
                at += np.dtype(t).itemsize * row["n"]
            columns["chunk"].append(np.full(row["n"], row["chunk"]))
        e = {k: np.concatenate(v) for k, v in columns.items()}
        order = np.lexsort((e["ref"], e["chunk"], e["doc"], e["word"]))
        e = {k: v[order] for k, v in e.items()}
        e |= {k: e[k].astype(np.int64) for k in ("size", "pos", "ref", "line")}
        same = np.zeros((2, 0), np.int64)
        if not every:
            alike = np.lexsort((np.arange(len(order)), e["name"], e["high"], e["low"], e["size"], e["word"]))
            new = np.ones(len(alike), bool)
            for k in ("word", "size", "low", "high", "name"):
                v = e[k][alike]
                if k == "word":
                    new[1:] = v[1:] != v[:-1]
                else:
                    new[1:] |= v[1:] != v[:-1]
            head = np.empty(len(alike), np.int64)
            head[alike] = alike[np.maximum.accumulate(np.where(new, np.arange(len(alike)), 0))]
            rest = np.flatnonzero((head != np.arange(len(alike))) & (e["pos"] == 0))
            same = np.stack([rest, head[rest]])
            heads = np.flatnonzero((head == np.arange(len(alike))) & (e["size"] >= TOP))
        else:
            heads = np.arange(len(order))
        whole, e = e, {k: v[heads] for k, v in e.items()}
        n = len(heads)
        starts = np.flatnonzero(np.concatenate([[True], e["word"][1:] != e["word"][:-1]])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, n))
        rank = np.arange(n) - np.repeat(starts, sizes)
        later, earlier = [], []

        def give(a: np.ndarray, b: np.ndarray) -> None:
            later.append(a)
            earlier.append(b)

        have = np.zeros(n, np.int64)
        a = np.flatnonzero(np.repeat(sizes <= group, sizes) & (e["asks"] > 0))
        for lag in range(1, group):
            a = a[(rank[a] >= lag) & ((have[a] < RESTS) | every)]
            if not len(a):
                break
            near = a[_passes(e, a, a - lag)]
            have[near] += 1
            give(near, near - lag)
        for start, size in zip(starts[sizes > group].tolist(), sizes[sizes > group].tolist(), strict=True):
            every_one = np.arange(start, start + size)
            for me in every_one:
                if e["asks"][me] and (every or have[me] < RESTS):
                    near = every_one[: me - start]
                    near = near[_passes(e, np.full(len(near), me), near)][: None if every else RESTS]
                    give(np.full(len(near), me), near)
                    have[me] = max(have[me], len(near))
                    if every:
                        continue
                    after = every_one[me - start + 1 :]
                    after = after[have[after] < RESTS]
                    near = after[_passes(e, after, np.full(len(after), me))]
                    have[near] += 1
                    give(near, np.full(len(near), me))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (later, earlier))
        out = {
            "chunk": whole["chunk"][heads[a]], "ref": whole["ref"][heads[a]], "chunk_b": whole["chunk"][heads[b]], "ref_b": whole["ref"][heads[b]],
            "doc_id": whole["doc"][heads[a]], "line": whole["line"][heads[a]], "like": whole["doc"][heads[b]], "more": have[a] >= RESTS, "same": np.zeros(len(a), bool),
        }
        told = [out]
        if not every:
            a, b = same
            told.append({
                "chunk": whole["chunk"][a], "ref": whole["ref"][a], "chunk_b": whole["chunk"][b], "ref_b": whole["ref"][b],
                "doc_id": whole["doc"][a], "line": whole["line"][a], "like": whole["doc"][b], "more": np.zeros(len(a), bool), "same": np.ones(len(a), bool),
            })
            for row in table.select(["chunk", "repeats"]).to_pylist():
                if row["repeats"]:
                    ref, doc, line, like = np.frombuffer(row["repeats"], np.int64).reshape(4, -1)
                    chunk = np.full(len(ref), row["chunk"])
                    told.append({
                        "chunk": chunk, "ref": ref, "chunk_b": chunk, "ref_b": ref, "doc_id": doc, "line": line, "like": like,
                        "more": np.zeros(len(ref), bool), "same": np.ones(len(ref), bool),
                    })
        joined = {k: np.concatenate([t[k] for t in told]) for k in out}
        return pa.table({
            k: pa.array(v, pa.bool_() if v.dtype == bool else pa.int64(), mask=v == LAST if k in ("doc_id", "like") else None) for k, v in joined.items()
        })

    return find


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the lines that are asked of each chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            lines = b"\n".join(utf8(_unpacked(row["body"]), "text")).split(b"\n")
            asked = sorted(row["asked"])
            words, line = _split([lines[i] for i in asked])
            at = np.searchsorted(line, np.arange(len(asked) + 1))
            sets = [np.unique(words[at[i] : at[i + 1]]).view(np.int64) for i in range(len(asked))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(asked), row["chunk"]), pa.int64()), pa.array(asked, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["chunk", "ref", "words"]
            )


def _wanted(seen: np.ndarray):
    """Cells of the prefix words of the lines that ask."""

    def want(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = b"\n".join(utf8(_unpacked(row["body"]), "text")).split(b"\n")
                asked = [lines[i] for i in row["asked"]]
                x = _Lines(pa.RecordBatch.from_pydict({"doc_id": pa.array([0] * len(asked), pa.int64()), "text": pa.array(asked, pa.binary())}), seen)
                size = x.size[x.where]
                prefix = x.pos < size - -(-TOP * size // BOTTOM) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_cell(x.word[prefix])).astype(np.int64), pa.int64())], ["cell"])

    return want


def _with(chunks: DataFrame, per: DataFrame, column: str, how: str) -> DataFrame:
    """The chunks with their line numbers: broadcast if these were counted and are few, else by a shuffle join."""
    count = per.agg(F.sum(F.size(column))).head()[0] or 0
    return chunks.join(F.broadcast(per) if count <= SENT else per, "chunk", how)


def _pairs(chunks: DataFrame, seen: np.ndarray, buckets: int, every: bool, group: int, wanted: np.ndarray | None = None) -> DataFrame:
    """Candidate pairs of lines; those found by several words come several times."""
    dealt = chunks.mapInArrow(_entries(seen, buckets, wanted), "bucket int, chunk long, n long, body binary, repeats binary")
    return dealt.groupBy("bucket").applyInArrow(
        _candidates(every, group), "chunk long, ref long, chunk_b long, ref_b long, doc_id long, line long, like long, more boolean, same boolean"
    )


def _verified(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each later line of the pairs: the document of a match, if one holds, and whether there may be more."""
    near = pairs.where("not same").groupBy("chunk", "ref", "chunk_b", "ref_b").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "line", "like")], F.max("more").alias("more")
    )
    near = stored(near)
    need = near.select("chunk", "ref").union(near.select("chunk_b", "ref_b")).groupBy("chunk").agg(F.collect_set("ref").alias("asked"))
    words = stored(_with(chunks.select("chunk", "body"), need, "asked", "inner").mapInArrow(_told, "chunk long, ref long, words array<long>"))
    other = words.select(F.col("chunk").alias("chunk_b"), F.col("ref").alias("ref_b"), F.col("words").alias("like_words"))
    joined = near.join(words, ["chunk", "ref"]).join(other, ["chunk_b", "ref_b"])
    shared = F.size(F.array_intersect("words", "like_words"))
    match = (TOP + BOTTOM) * shared >= TOP * (F.size("words") + F.size("like_words"))
    checked = joined.select("chunk", "ref", "doc_id", "line", F.when(match, F.coalesce("like", F.lit(int(LAST)))).alias("like"), "more")
    return checked.groupBy("chunk", "ref", "doc_id", "line").agg(F.min("like").alias("like"), F.max("more").alias("more"))


def _removed(docs: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """``(chunks, removed)``; ``removed(chunk, ref, doc_id, line, like_doc_id)``, a row a line."""
    text = [F.col("doc_id").cast("long").alias("doc_id") if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns]
    chunks = stored(docs.select(*text).mapInArrow(_chunks, "chunk long, body binary, seen binary, words long"))
    words = chunks.agg(F.sum("words")).head()[0] or 0
    seen = _rarity(chunks) if words else np.zeros(CELLS, np.uint32)
    chunks = chunks.where("body is not null").select("chunk", "body")
    buckets = max(1, -(-words // (4 * BUCKET)), min(4 * parts(docs.sparkSession), words >> 14))
    pairs = stored(_pairs(chunks, seen, buckets, False, group))
    same = pairs.where("same").select("chunk", "ref", "doc_id", "line", F.col("like").alias("like_doc_id"))
    lines = stored(_verified(pairs, chunks))
    named = F.when(F.col("like") != int(LAST), F.col("like")).alias("like_doc_id")
    found = lines.where("like is not null").select("chunk", "ref", "doc_id", "line", named)
    left = lines.where("like is null and more").select("chunk", "ref")
    if left.head():
        # lines whose given candidates all failed, and that may have others: compared with every earlier one
        asked = left.groupBy("chunk").agg(F.collect_set("ref").alias("asked"))
        cells = _with(chunks, asked, "asked", "inner").mapInArrow(_wanted(seen), "cell long").distinct().toArrow()
        wanted = np.zeros(ASKED, bool)
        wanted[cells.column("cell").to_numpy()] = True
        again = stored(_pairs(_with(chunks, asked, "asked", "left"), seen, buckets, True, group, wanted))
        rest = _verified(again, chunks).where("like is not null")
        found = found.union(rest.select("chunk", "ref", "doc_id", "line", named))
    return chunks, found.union(same)


def removed_lines(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``(doc_id, line, like_doc_id)``: lines that match an earlier line, and the document of one such.

    Lines are what line feeds part; a line is the set of its words, and two match at a Jaccard
    similarity of 0.8 or more.  Earlier is the smaller (doc_id, line), null ids last; of rows that
    share a doc_id one is the earlier.  A line goes if any earlier line matches it, whether or not that
    one stays.  Lines without words match nothing.

    Words are ordered by how often the corpus has them, rarest first (counts of a fixed number of
    hashed cells, ties by hash: any one order gives the same result).  Each line sends its prefix, with
    size, position and 96 parity bits; lines that share a prefix word and pass the filters are compared word by word.
    Equal lines of a chunk are one entry.  Null and empty texts have no lines with words; lines of
    any length are read whole; an empty table gives no row.
    """
    return _removed(docs, group)[1].select("doc_id", "line", "like_doc_id")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines of ``removed_lines`` taken out of ``text``; other columns as they are.

    Every row stays, if with an empty text; a null text stays null.  A column ``n_chars`` is set to the
    new length.
    """
    chunks, gone = _removed(docs)
    per = gone.groupBy("chunk").agg(F.collect_set("ref").alias("gone"))
    schema = docs.withColumn("doc_id", F.col("doc_id").cast("long")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = _unpacked(row["body"])
                at, lost, ref = rows.schema.get_field_index("text"), set(row["gone"] or ()), 0
                texts = []
                for text in rows.column(at).to_pylist():
                    have = (text or "").split("\n")
                    texts.append(text if text is None else "\n".join(x for i, x in enumerate(have, ref) if i not in lost))
                    ref += len(have)
                rows = rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))
                if "n_chars" in rows.schema.names:
                    k = rows.schema.get_field_index("n_chars")
                    rows = rows.set_column(k, rows.schema.field(k), pa.array([None if t is None else len(t) for t in texts], rows.schema.field(k).type))
                yield rows

    return _with(chunks, per, "gone", "left").mapInArrow(cut, schema)
