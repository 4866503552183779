"""Packing: token ids of all documents end to end, cut into sequences of one size."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import pieces, stored

#: A vocabulary of the ``tokenizers`` library; the path is a parameter of ``pack``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Ids in a sequence, and the id after every document.
SIZE, END = 2048, 1
#: How byte-level vocabularies cut a text before merging (a fixed pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are encoded at once, cut where a word meets white space, which no token reaches over.
SLICE = 2_000_000
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Characters beside Latin and Greek letters, general marks, kana and common Han: not left to the quicker library.
_RARE = re.compile(r"[^\x00-\u0377\u2000-\u2063\u3000-\u309f\u4e00-\u9fa5]")


def _ranks(path: str) -> tuple[dict[bytes, int], list[str]] | None:
    """Ids by the bytes of a token, and the special names, of a byte-level vocabulary that merges in the order of its ids."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    model, special = parts["model"], [x["content"] for x in parts.get("added_tokens") or ()]
    cut = parts.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not parts.get("normalizer")
    # bytes that print stand for themselves, the others for the characters from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocab = {x: i for x, i in model.get("vocab", {}).items() if x not in special} if model.get("type") == "BPE" else {}
    merged = [vocab.get("".join(x.split(" ") if isinstance(x, str) else x), -1) for x in model.get("merges", ())]
    single = {x: i for x, i in vocab.items() if len(x) == 1}
    if not plain or single.keys() != byte.keys() or len(single) + len(merged) != len(vocab) or merged != sorted(merged) or -1 in merged:
        return None
    return {bytes(byte[c] for c in x): i for x, i in vocab.items()}, special


class Encoder:
    """Ids of texts under a vocabulary of the ``tokenizers`` library.

    Its own tokenizer needs some 600 CPU seconds a GB.  Where both are known to agree (a byte-level
    vocabulary, no special token's name, no rare character, whose class may differ between versions of
    Unicode) ``tiktoken`` gives the same ids from the same vocabulary in a third of the time.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        known = _ranks(path)
        self.special = known[1] if known else []
        self.quick = known and tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=known[0], special_tokens={})

    def _ids(self, text: str) -> np.ndarray:
        if self.quick and not _RARE.search(text) and not any(x in text for x in self.special):
            return self.quick.encode_to_numpy(text)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def __call__(self, text: str) -> bytes:
        out, start = [], 0
        while start < len(text):
            cut = _CUT.search(text, start + SLICE) if start + SLICE < len(text) else None
            end = cut.start() if cut else len(text)
            out.append(self._ids(text[start:end]).astype(self.kind).tobytes())
            start = end
        return b"".join(out)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _kind(ids: bytes, n: int) -> str:
    return f"<u{len(ids) // n}"


def encoded(docs: DataFrame, path: str = VOCABULARY, end: int = END) -> DataFrame:
    """``(doc_id, part, start, n, ids)``: ids of every document with ``end`` last, in two or four bytes each.

    ``part`` is the partition that read the document and ``start`` counts the ids before it there.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(path), TaskContext.get().partitionId(), 0
        closing = np.array([end], encoder.kind).tobytes()
        for batch in pieces(batches, "text", 2_000_000):
            ids = [encoder(text or "") + closing for text in batch.column(1).to_pylist()]
            sizes = [len(x) // encoder.kind.itemsize for x in ids]
            starts = list(accumulate(sizes, initial=at))
            at = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "part", "start", "n", "ids"],
            )

    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return slim.mapInArrow(encode, "doc_id long, part long, start long, n long, ids binary")


class Cuts:
    """Where sequences begin: at every ``size`` ids, and in what is left over at falling powers of two."""

    def __init__(self, total: int, size: int) -> None:
        self.size, self.whole, self.total = size, total // size, total
        left = total % size
        powers = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        self.tail = [self.whole * size + x for x in accumulate(powers, initial=0)]

    def sequence(self, at: int) -> tuple[int, int, int]:
        """The sequence of a place, where it begins and where it ends."""
        if at < self.whole * self.size:
            n = at // self.size
            return n, n * self.size, (n + 1) * self.size
        k = int(np.searchsorted(self.tail, at, "right")) - 1
        return self.whole + k, self.tail[k], self.tail[k + 1]

    def pieces(self, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """``(from, to, sequence, offset)`` of the pieces of ``n`` ids from place ``start`` on."""
        at = start
        while at < start + n:
            number, first, last = self.sequence(at)
            to = min(last, start + n)
            yield at - start, to - start, number, at - first
            at = to


def placed(docs: DataFrame, path: str, size: int, end: int) -> tuple[DataFrame, dict[int, int], Cuts]:
    """The stored ids, the place of each partition's first id, and the cuts.

    The first pass stores the ids; the totals of its partitions, one number a task, are summed up in order
    on the driver.  A place is then the partition's plus the document's within it.
    """
    ids = stored(encoded(docs, path, end))
    totals = sorted((r.part, r.n) for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect())
    places = list(accumulate((n for _, n in totals), initial=0))
    return ids, dict(zip((p for p, _ in totals), places)), Cuts(places[-1], size)


def pack(docs: DataFrame, path: str = VOCABULARY, size: int = SIZE, end: int = END) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: the pieces of every document.

    All documents' ids stand end to end, ``end`` after each, and are cut at every ``size`` ids; what is left
    at the very end is cut at falling powers of two, so nothing is padded.  ``ids`` are little-endian
    32-bit numbers.  A null or empty text has the one id ``end``; equal rows and rows without a doc_id are
    documents like any other; an empty table has no piece.  A text of any length is read whole, in slices;
    one document's ids are held by a task.  Other columns are ignored, whatever their names.
    """
    ids, places, cuts = placed(docs, path, size, end)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids", 8_000_000):
            rows = []
            for doc, part, start, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(raw, _kind(raw, n))
                for a, b, number, offset in cuts.pieces(places[part] + start, n):
                    rows.append((doc, a, b - a, own[a:b].astype("<u4").tobytes(), n, number, offset))
            columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE.types)], schema=_PIECE)

    return ids.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
_RUN = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("whole", pa.bool_()), ("ids", pa.binary())])


def sequences(docs: DataFrame, path: str = VOCABULARY, size: int = SIZE, end: int = END) -> DataFrame:
    """``(sequence_id, ids)``: the sequences themselves, ``ids`` as little-endian 32-bit numbers.

    A task writes every sequence that lies in its partition; only the first and last of a partition, which
    may reach into others, go as boundary records through a shuffle and are put together.
    """
    ids, places, cuts = placed(docs, path, size, end)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        current = at = None  # the open sequence and its first offset here

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                raw = b"".join(held)
                _, first, last = cuts.sequence(at)
                whole = at == first and len(raw) == 4 * (last - first)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((current, at - first, whole, raw), _RUN.types)], schema=_RUN)

        for batch in pieces(batches, "ids", 8_000_000):
            for _, part, start, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(raw, _kind(raw, n)).astype("<u4")
                for a, b, number, _ in cuts.pieces(places[part] + start, n):
                    if number != current:
                        yield from close()
                        held, current, at = [], number, places[part] + start + a
                    held.append(own[a:b].tobytes())
        yield from close()

    runs = stored(ids.mapInArrow(join, "sequence_id long, offset long, whole boolean, ids binary"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    boundary = runs.where("not whole").groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b""), lambda s, x: F.concat(s, x)).alias("ids"))
    return runs.where("whole").select("sequence_id", "ids").union(boundary)
