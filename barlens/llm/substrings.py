"""Substring dedup: Rabin-Karp hashes of every word window, counted in Spark, merged to removal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import parts, pieces, stored, utf8

WINDOW = 35
#: Text bytes in a chunk, windows in a bucket: what a task holds at a time.
CHUNK, BUCKET = 6_000_000, 1 << 20
#: Base of the rolling hash (odd), and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C17
INVERSE = pow(BASE, -1, 1 << 64)


class _WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def window_hashes(words: list[bytes], lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``window`` words inside one document, and their hashes.

    ``words`` holds documents of ``lengths`` words one after another.  A window's hash is the
    polynomial of its words in BASE modulo 2**64, rolled on by prefix sums, then mixed.
    """
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    ids = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    power = np.full(n, BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(n + 1, np.uint64)
    np.add.accumulate(ids * power, out=sums[1:])
    power[1:] = INVERSE
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    ends = np.repeat(np.cumsum(lengths), lengths)  # for each word, where its document ends
    starts = np.flatnonzero(ends[: n - window + 1] - np.arange(n - window + 1) >= window)
    rolled = ((sums[window:] - sums[:-window]) * power[: n - window + 1])[starts]
    rolled ^= rolled >> np.uint64(32)
    rolled *= np.uint64(0xD6E8FEB86659FD93)
    rolled ^= rolled >> np.uint64(32)
    return starts, rolled


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents packed into chunks: ids, word counts, and the words compressed."""
    pack = zstandard.ZstdCompressor(level=3)
    for n, batch in enumerate(pieces(batches, "text", CHUNK)):
        split = [x.split() for x in utf8(batch, "text")]
        body = pack.compress(b" ".join(w for words in split for w in words))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([(TaskContext.get().partitionId() << 32) + n], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([[len(x) for x in split]], pa.list_(pa.int64())), pa.array([body], pa.binary()),
            ],
            ["chunk", "ids", "lengths", "body"],
        )


def _opened(row: dict, window: int):
    words = zstandard.ZstdDecompressor().decompress(row["body"]).split()
    lengths = np.array(row["lengths"], np.int64)
    starts, hashes = window_hashes(words, lengths, window)
    return words, lengths, starts, *np.unique(hashes, return_inverse=True, return_counts=True)


def _bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted hashes; a bucket is a range of the upper 32 bits."""
    edges = np.array([-(-(b << 32) // buckets) << 32 for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def _dealt(window: int, buckets: int):
    """Each chunk's distinct hashes, one row a bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes = _opened(row, window)[3]
                at = _bounds(hashes, buckets)
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array(np.full(len(full), row["chunk"]), pa.int64()), pa.array([hashes[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())],
                    ["bucket", "chunk", "hashes"],
                )

    return deal


def _marks(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket, a bit for each of its hashes: set if another chunk has it too."""
    blobs = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    _, at, counts = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    shared = np.split(counts[at] > 1, np.cumsum([len(x) for x in blobs])[:-1])
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "marks": pa.array([np.packbits(x).tobytes() for x in shared], pa.binary())})


def _removed(window: int, buckets: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, lengths, starts, hashes, which, counts = _opened(row, window)
                shared = counts > 1
                at = _bounds(hashes, buckets)
                for m in row["marks"] or ():
                    b = m["bucket"]
                    shared[at[b] : at[b + 1]] |= np.unpackbits(np.frombuffer(m["marks"], np.uint8), count=at[b + 1] - at[b]).astype(bool)
                first = starts[shared[which]]
                cover = np.zeros(len(words) + 1, np.int64)
                cover[first] += 1
                cover[first + window] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                ids, sizes, lost, spans, kept, base = [], [], [], [], [], 0
                for doc, n in zip(row["ids"], lengths.tolist(), strict=True):
                    end, cuts, have, done = base + n, [], [], base
                    # an interval may run on over a document's end; each document takes its part
                    for i in range(np.searchsorted(closes, base, "right"), np.searchsorted(opens, end, "left")):
                        start, stop = max(int(opens[i]), base), min(int(closes[i]), end)
                        cuts.append({"start": start - base, "stop": stop - base})
                        have += words[done:start]
                        done = stop
                    have += words[done:end]
                    ids.append(doc)
                    sizes.append(n)
                    lost.append(sum(c["stop"] - c["start"] for c in cuts))
                    spans.append(cuts)
                    kept.append(b" ".join(have))
                    base = end
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "spans", "kept"],
                )

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document without the words of windows that occur more than once anywhere.

    ``(doc_id, n_words, n_removed, spans, kept)``: word positions ``start`` to before ``stop`` of each
    maximal removed interval, and the remaining words joined by one space.  A window is ``window``
    consecutive words of one document; it repeats if the same words start at any other place, in this or
    another document, judged on the input.

    Documents are packed into chunks, stored once.  A chunk sends each of its distinct window hashes
    (64 bits) once, packed by bucket, so a window that occurs in a third of all documents counts once a
    chunk; a bucket answers with one bit a hash.  One row per input row: null and empty texts have no
    words and an empty ``kept``; rows that repeat remove each other; a document shorter than the window
    stays whole.  Other columns are ignored.
    """
    chunks = stored(
        docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_chunks, "chunk long, ids array<long>, lengths array<long>, body binary")
    )
    words = chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).head()[0] or 0
    buckets = max(1, -(-words // BUCKET), min(4 * parts(docs.sparkSession), words >> 14))
    dealt = chunks.mapInArrow(_dealt(window, buckets), "bucket int, chunk long, hashes binary")
    marks = dealt.groupBy("bucket").applyInArrow(_marks, "bucket int, chunk long, marks binary")
    marks = marks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "marks")).alias("marks"))
    return chunks.join(marks, "chunk", "left").mapInArrow(
        _removed(window, buckets), "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept string"
    )
