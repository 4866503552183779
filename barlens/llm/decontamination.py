"""Benchmark decontamination by latent semantic retrieval, longest common subsequences and answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import hashed_words, pieces, stored, utf8

#: Words of a passage, and from one passage's start to the next.
PASSAGE, STRIDE = 64, 32
#: Dimensions of the latent space, and the extra ones of the random start.
RANK, SPARE = 256, 16
#: Weight of the benchmark's passages against the corpus in the decomposition.
OWN = 10.0
#: Cosine of a candidate; shares of an item's words in common order, alone and with its answer.
COSINE, VERBATIM, PARAPHRASE = 0.45, 0.75, 0.5
#: Words of an answer where the item marks none, and the share of them that must be found.
ANSWER, ANSWERED = 8, 0.5
#: Benchmark passages per model: what is collected and broadcast is bounded by it.
ITEMS = 2000
#: Words up to which a task adds up the Gram matrix itself: half of it is held, 100 MB in doubles.
GRAM = 5000
#: Passages, and about how many of their words, that a task works on at once.
ROWS, ENTRIES = 2048, 16_384
#: Passages whose directions are gathered at a time.
LIKE = 32

#: ASCII letters to lower case, other ASCII characters but digits to spaces; further bytes stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_MARK = re.compile(r"(?:^|\n)\s*(?:answer|antwort|respuesta|réponse|a)\s*[:.)]", re.I)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, in lower case, digits and non-ASCII characters."""
    return (text or b"").translate(_FOLD).split()


@dataclass
class Item:
    """A passage of a benchmark item, with the words of the answer that it ends in."""

    item_id: int
    words: list[bytes]
    answer: list[bytes]


def items_of(item_id: int, text: str | None) -> list[Item]:
    """An item as passages of at most ``PASSAGE`` words; each is looked for by itself."""
    words = words_of((text or "").encode())
    marks = list(_MARK.finditer(text or ""))
    marked = words_of((text or "")[marks[-1].end() :].encode()) if marks else []
    out = []
    count = -(-len(words) // PASSAGE)
    for i in range(count):
        part = words[len(words) * i // count : len(words) * (i + 1) // count]
        out.append(Item(item_id, part, marked[:PASSAGE] if marked and i == count - 1 else part[-ANSWER:]))
    return out


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, with one bit for each word of ``a``."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _tree(df: DataFrame, add: Callable, rows: int, last: Callable | None = None) -> DataFrame:
    """One row from a frame of single binary values, added up in two levels of tasks; ``last`` adds up what is left."""
    some = max(1, int(rows**0.5))
    return df.repartition(some).mapInArrow(add, "value binary").repartition(1).mapInArrow(last or add, "value binary")


def _sum(batches: Iterator[pa.RecordBatch], kind: type) -> np.ndarray | None:
    """The sum of the batches' values, none of them copied."""
    total = None
    for batch in batches:
        for x in batch.column(0):
            value = np.frombuffer(x.as_buffer(), kind)
            if total is None:
                total = value.copy()
            else:
                total += value
    return total


def _adding(kind: type) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _sum(batches, kind)
        if total is not None:
            yield _value(total)

    return add


def _value(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["value"])


@dataclass
class Vocabulary:
    """Words by number; their hashes in order, the numbers that go with these, and a mark a cell."""

    words: list[bytes]
    hashes: np.ndarray
    numbers: np.ndarray
    marked: np.ndarray

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        hashes = hashed_words(np.frombuffer(b" ".join(words), np.uint8))[1]
        self.numbers = np.argsort(hashes)
        self.hashes = hashes[self.numbers]
        self.marked = np.unique(hashes >> np.uint64(42))

    def __len__(self) -> int:
        return len(self.words)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts' words that it has: text, place in the text, number; and how many words each text has."""
        folded = [x.translate(_FOLD) for x in texts]
        ends = np.cumsum([len(x) + 1 for x in folded])
        starts, hashes = hashed_words(np.frombuffer(b" ".join(folded), np.uint8))
        sizes = np.diff(np.searchsorted(starts, ends), prepend=0)
        text = np.repeat(np.arange(len(texts)), sizes)
        cells = np.zeros(1 << 22, bool)
        cells[self.marked] = True
        at = np.flatnonzero(cells[hashes >> np.uint64(42)])
        to = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[to] == hashes[at]
        at, to = at[same], to[same]
        return text[at], at - (np.cumsum(sizes) - sizes)[text[at]], self.numbers[to], sizes


def _passages(doc: np.ndarray, place: np.ndarray, word: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows of overlapping passages: (document, passage) of each row; row, word, value of each entry.

    Passage ``p`` of a document holds its words from ``p * STRIDE`` on; a word lies in the passages
    that begin at its own stride and, half a passage on, at the one before.
    """
    block = place // STRIDE
    d, p, w = (np.concatenate(x) for x in ((doc, doc[block > 0]), (block, block[block > 0] - 1), (word, word[block > 0])))
    if not len(d):
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64), w, np.zeros(0)
    key, times = np.unique(((d << 24) + p) * len(idf) + w, return_counts=True)
    top, w = key // len(idf), key % len(idf)
    rows, row = np.unique(top, return_inverse=True)
    value = (1 + np.log(times)) * idf[w]
    value /= np.sqrt(np.bincount(row, value * value))[row]
    return np.stack([rows >> 24, rows & ((1 << 24) - 1)], axis=1), row, w, value


def _frequencies(vocab: Vocabulary) -> Callable:
    """How many stretches of ``STRIDE`` words hold each word; last, how many stretches there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(vocab) + 1, np.int64)
        for batch in pieces(batches, "text"):
            doc, place, word, sizes = vocab.find(utf8(batch, "text"))
            held = np.sort(((doc << 24) + place // STRIDE) * len(vocab) + word)
            seen[:-1] += np.bincount(held[np.diff(held, prepend=-1) > 0] % len(vocab), minlength=len(vocab))
            seen[-1] += (-(-sizes // STRIDE)).sum()
        yield _value(seen)

    return count


def _sparse(vocab: Vocabulary, idf: np.ndarray) -> Callable:
    """The passages of the corpus as sparse rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            doc, place, word, _ = vocab.find(utf8(batch, "text"))
            rows, row, word, value = _passages(doc, place, word, idf)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(rows)], pa.int64())] + [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((row, np.int32), (word, np.int32), (value, np.float32))],
                ["n", "row", "word", "value"],
            )

    return run


def _gram_times(shape: tuple[int, int], start: Callable[[], np.ndarray]) -> Callable:
    """``A' A S`` of a task's rows A for a thin matrix S."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thin, total, used = start(), np.zeros(shape, np.float32), False
        for batch in batches:
            for r in batch.to_pylist():
                row, word, value = (np.frombuffer(r[k], t) for k, t in (("row", np.int32), ("word", np.int32), ("value", np.float32)))
                # a row of one word has the value 1 and adds that word's row of S
                many = np.bincount(row, minlength=r["n"])[row] > 1
                if not many.all():
                    used = True
                    alone = np.bincount(word[~many], minlength=shape[0])
                    total += alone[:, None].astype(np.float32) * thin
                    row, word, value = row[many], word[many], value[many]
                for a, b in _slices(row):
                    used = True
                    local, w, v = row[a:b] - row[a], word[a:b], value[a:b, None]
                    first = np.flatnonzero(np.diff(local, prepend=-1))
                    dense = np.add.reduceat(thin[w] * v, first, axis=0)
                    back = np.argsort(w, kind="stable")
                    spots = np.flatnonzero(np.diff(w[back], prepend=-1))
                    which = np.cumsum(np.diff(local, prepend=-1) > 0) - 1
                    total[w[back][spots]] += np.add.reduceat((dense[which] * v)[back], spots, axis=0)
        if used:
            yield _value(total)

    return run


def _gram(vocab: Vocabulary, idf: np.ndarray) -> Callable:
    """``A' A`` of a task's passages A: its upper triangle by rows, and last the number of passages."""
    n = len(vocab)
    first = np.arange(n) * n - np.arange(n) * (np.arange(n) + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros(n * (n + 1) // 2 + 1), False
        for batch in pieces(batches, "text"):
            doc, place, word, _ = vocab.find(utf8(batch, "text"))
            rows, row, word, value = _passages(doc, place, word, idf)
            total[-1] += len(rows)
            used |= len(rows) > 0
            ends, begins = np.searchsorted(row, row, "right"), first[word]
            for a in range(0, len(row), ENTRIES):
                # each entry meets itself and those after it in its row, whose words are larger
                mine = np.arange(a, min(a + ENTRIES, len(row)))
                many = ends[mine] - mine
                other = np.arange(many.sum()) + np.repeat(mine - np.cumsum(many) + many, many)
                np.add.at(total, np.repeat(begins[mine], many) + word[other], np.repeat(value[mine], many) * value[other])
        if used:
            yield _value(total.astype(np.float32))

    return run


def _full(half: np.ndarray, n: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle by rows."""
    out = np.zeros((n, n), half.dtype)
    at = 0
    for i in range(n):
        out[i, i:] = out[i:, i] = half[at : at + n - i]
        at += n - i
    return out


def _slices(row: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of whole rows, at most ``ROWS`` of them and about ``ENTRIES`` entries, of entries in order of row.

    They bound both dense parts: entries by directions, and rows by items.
    """
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    full = np.searchsorted(starts, np.arange(0, len(row), ENTRIES))
    cuts = np.unique(np.concatenate([starts[::ROWS], starts[full[full < len(starts)]], [len(row)]]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


@dataclass
class Model:
    """What the search needs: vocabulary, weights, latent directions, and the items in that space."""

    vocab: Vocabulary
    idf: np.ndarray
    axes: np.ndarray
    items: list[Item]
    weights: list[dict[int, float]]
    latent: np.ndarray
    rest: np.ndarray
    most: np.ndarray


def _weighed(items: list[Item], vocab: dict[bytes, int], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit TF-IDF rows of the items: their words' numbers and values."""
    out = []
    for x in items:
        word, times = np.unique(np.array([vocab[w] for w in x.words if w in vocab], np.int64), return_counts=True)
        value = (1 + np.log(times)) * idf[word]
        out.append((word, value / max(np.linalg.norm(value), 1e-12)))
    return out


def _by_items(asked: list[tuple[np.ndarray, np.ndarray]], thin: np.ndarray) -> np.ndarray:
    return np.stack([value @ thin[word] for word, value in asked])


def _by_words(asked: list[tuple[np.ndarray, np.ndarray]], image: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, image.shape[1]))
    for (word, value), row in zip(asked, image, strict=True):
        out[word] += value[:, None] * row
    return out


def _axes(asked: list[tuple[np.ndarray, np.ndarray]], passages: float, times: Callable, n: int) -> np.ndarray:
    """The latent directions, where ``times`` multiplies a thin matrix by the passages' Gram matrix."""
    thin = np.linalg.qr(np.random.default_rng(5).normal(size=(n, min(n, RANK + SPARE))))[0]
    heavy = OWN * passages / len(asked) + 1
    for _ in range(2):
        image = heavy * _by_words(asked, _by_items(asked, thin), n) + times(thin)
        inner = thin.T @ image
        thin_before, thin = thin, np.linalg.qr(image)[0]
    _, turn = np.linalg.eigh((inner + inner.T) / 2)
    return (thin_before @ turn[:, ::-1])[:, :RANK]


def _axes_of_gram(text: DataFrame, vocab: Vocabulary, idf: np.ndarray, tasks: int, asked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The axes where the Gram matrix is added up in one pass: the last task finds them, and only they go to the driver."""
    n, some = len(vocab), max(8, tasks // 4)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = _sum(batches, np.float32)
        half = np.zeros(n * (n + 1) // 2 + 1, np.float32) if half is None else half
        gram, passages = _full(half[:-1], n), float(half[-1])
        del half
        yield _value(_axes(asked, passages, lambda thin: gram @ thin.astype(np.float32), n))

    found = _tree(text.coalesce(some).mapInArrow(_gram(vocab, idf), "value binary"), _adding(np.float32), some, last).collect()
    return np.frombuffer(found[0][0]).reshape(n, -1)


def _axes_of_passes(text: DataFrame, vocab: Vocabulary, idf: np.ndarray, tasks: int, asked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The axes where the Gram matrix is too large to hold: the passages are stored and read once a product."""
    rows = stored(text.mapInArrow(_sparse(vocab, idf), "n long, row binary, word binary, value binary"))
    some = max(8, tasks // 16)

    def times(thin: np.ndarray) -> np.ndarray:
        shared = text.sparkSession.sparkContext.broadcast(thin.astype(np.float32))
        found = rows.coalesce(some).mapInArrow(_gram_times(thin.shape, lambda: shared.value), "value binary")
        total = _tree(found, _adding(np.float32), some).collect()
        return np.frombuffer(total[0][0], np.float32).reshape(thin.shape) if total else np.zeros_like(thin)

    return _axes(asked, rows.agg(F.sum("n")).head()[0] or 0, times, len(vocab))


def fit(docs: DataFrame, items: list[Item]) -> Model | None:
    """Latent space of the corpus's passages over the words of ``items``; None if the corpus holds none of them.

    Word frequencies are counted over all passages.  The randomised SVD starts from random directions,
    multiplies them twice by the Gram matrix of all passages, and finds the axes within that
    span.  Up to ``GRAM`` words each task adds up its passages' Gram matrix, once for both products, and
    the last task of the sum finds the axes, so that the driver holds no Gram matrix;
    beyond, each product is a pass in which a task adds up a thin matrix (words of the items by
    directions) and the driver finds the axes.  Either is summed over two levels of tasks.  The items' own passages weigh ``OWN``
    times the corpus, so that the axes cover them.
    """
    vocab = {w: i for i, w in enumerate(sorted({w for x in items for w in x.words}))}
    if not vocab:
        return None
    text = docs.select("text")
    tasks = docs.rdd.getNumPartitions()
    told = _tree(text.mapInArrow(_frequencies(Vocabulary(list(vocab))), "value binary"), _adding(np.int64), tasks).collect()
    seen = np.frombuffer(told[0][0], np.int64) if told else np.zeros(len(vocab) + 1, np.int64)
    # no passage can match a word that the corpus never holds; every other one counts by its weight
    kept = {w for w, i in vocab.items() if seen[i]}
    if not kept:
        return None
    idf = np.array([np.log((seen[-1] + 2) / (seen[vocab[w]] + 1)) for w in sorted(kept)])
    vocab = {w: i for i, w in enumerate(sorted(kept))}

    asked = _weighed(items, vocab, idf)
    words = Vocabulary(list(vocab))
    axes = (_axes_of_gram if len(vocab) <= GRAM else _axes_of_passes)(text, words, idf, tasks, asked)
    latent = _by_items(asked, axes)
    rest = np.sqrt(np.maximum(0, 1 - (latent**2).sum(axis=1)))
    most = np.zeros(len(vocab))
    for word, value in asked:
        most[word] = np.maximum(most[word], value)
    weights = [dict(zip(word.tolist(), value.tolist(), strict=True)) for word, value in asked]
    return Model(words, idf, axes.astype(np.float32), items, weights, latent.astype(np.float32), rest.astype(np.float32), most)


def _latent(axes: np.ndarray, begins: np.ndarray, counts: np.ndarray, word: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Passages in the latent space.  Some of like length are taken at a time, filled up with zeros, to stay in the cache."""
    out = np.empty((len(begins), axes.shape[1]), np.float32)
    order = np.argsort(counts, kind="stable")
    for a in range(0, len(order), LIKE):
        some = order[a : a + LIKE]
        place = np.arange(counts[some[-1]])
        held = place < counts[some][:, None]
        at = np.where(held, begins[some][:, None] + place, 0)
        out[some] = np.matmul(np.where(held, value[at], 0).astype(np.float32)[:, None], axes[word[at]])[:, 0]
    return out


def found_in(texts: list[bytes], model: Model) -> list[dict]:
    """Matches of items in texts: ``at`` (text), item_id, start, stop, cosine, common.

    A passage is a candidate for an item if its cosine is ``COSINE`` at least.  Pairs are first searched
    in the latent space, by the latent part plus the most that the parts outside it can add, so none
    is lost to the truncation; of those the cosine is computed in full.  The candidate, widened by half a passage on either side, must hold the item's words in order, a share
    ``VERBATIM`` of them, or a share ``PARAPHRASE`` and the answer.
    """
    doc, place, word, _ = model.vocab.find(texts)
    rows, row, word, value = _passages(doc, place, word, model.idf)
    # no item can bring a passage more than the largest weight of each of its words
    able = np.bincount(row, value * model.most[word], len(rows)) >= COSINE
    number = np.cumsum(able) - 1
    keep = able[row]
    rows, row, word, value = rows[able], number[row[keep]], word[keep], value[keep]
    words: dict[int, list[bytes]] = {}
    best: dict[tuple, dict] = {}
    counts = np.bincount(row, minlength=len(rows))
    begins = np.cumsum(counts) - counts
    for a in range(0, len(rows), ROWS):
        latent = _latent(model.axes, begins[a : a + ROWS], counts[a : a + ROWS], word, value)
        rest = np.sqrt(np.maximum(0, 1 - (latent**2).sum(axis=1)))
        for r, i in np.argwhere(latent @ model.latent.T + rest[:, None] * model.rest >= COSINE - 1e-4).tolist():
            own = model.weights[i]
            mine = slice(begins[a + r], begins[a + r] + counts[a + r])
            cosine = sum(own.get(w, 0.0) * v for w, v in zip(word[mine].tolist(), value[mine].tolist(), strict=True))
            if cosine < COSINE:
                continue
            d, p = rows[a + r].tolist()
            if d not in words:
                words[d] = words_of(texts[d])
            item = model.items[i]
            start = max(0, (p - 1) * STRIDE)
            near = words[d][start : (p + 1) * STRIDE + PASSAGE]
            share = common_words(item.words, near) / len(item.words)
            if share < PARAPHRASE:
                continue
            held = set(near)
            if share < VERBATIM and sum(w in held for w in item.answer) < ANSWERED * len(item.answer):
                continue
            one = {"at": int(d), "item_id": item.item_id, "start": int(start), "stop": int(start + len(near)), "cosine": cosine, "common": share}
            have = best.get((d, item.item_id))
            if have is None or (share, one["cosine"], -start) > (have["common"], have["cosine"], -have["start"]):
                best[d, item.item_id] = one
    return sorted(best.values(), key=lambda x: (x["at"], x["item_id"]))


def _blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The benchmark's passages, at most about ``ITEMS`` at a time."""
    block: list[Item] = []
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        block += items_of(r["item_id"], r["text"])
        if len(block) >= ITEMS:
            yield block
            block = []
    if block:
        yield block


_MATCH = "doc_id long, item_id long, start long, stop long, cosine double, common double"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start, stop, cosine, common)``: items found in documents, one row a row of ``docs`` and item.

    ``start, stop`` bound the words (runs of letters and digits, ASCII letters in any case) where it was found, ``common`` is the
    share of the item's words found in order.  Null and empty texts hold nothing, null and empty items
    are found nowhere; repeated rows each give their rows; whole texts are searched.  The benchmark is
    taken in blocks of bounded size, each with a model of its own.
    """
    out = docs.sparkSession.createDataFrame([], _MATCH)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for items in _blocks(benchmark):
        model = fit(docs, items)
        if model is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                ids = batch.column(0).to_pylist()
                got = found_in(utf8(batch, "text"), shared.value)
                kinds = {"doc_id": pa.int64(), "item_id": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "cosine": pa.float64(), "common": pa.float64()}
                yield pa.RecordBatch.from_pydict({k: pa.array([ids[x["at"]] if k == "doc_id" else x[k] for x in got], t) for k, t in kinds.items()})

        out = out.union(rows.mapInArrow(run, _MATCH))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item of the benchmark is found; see ``matches``."""
    for items in _blocks(benchmark):
        model = fit(docs, items)
        if model is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                got = {x["at"] for x in found_in(utf8(batch, "text"), shared.value)}
                yield batch.filter(pa.array([i not in got for i in range(batch.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
