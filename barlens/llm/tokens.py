"""Token counts of a unigram vocabulary without building tokens: Aho-Corasick matches and Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from barlens.llm.common import pieces

#: A vocabulary of pieces and scores; the path is a parameter of ``token_counts``.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What an unknown character scores below the worst piece (fixed by the tokenizer).
UNKNOWN = 10.0
#: Words whose count a worker remembers.
REMEMBERED = 400_000


def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores of a vocabulary file, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()))


class Counter:
    """Pieces of the best path through a word.

    Paths run over every occurrence of a piece and, where no piece spans exactly one character, over
    that character as unknown.  A position keeps the best score; among equal scores the path whose
    last step began first (the longest last piece) stays.  Unknown characters side by side are one
    token, or one a byte if the vocabulary has a piece for every byte.
    """

    def __init__(self, vocab: tuple[tuple[str, float], ...], unknown: int = 0) -> None:
        self.unknown = vocab[unknown][0]
        self.bytes = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in vocab}
        self.penalty = min(s for _, s in vocab) - UNKNOWN
        self.matches = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()

    def __call__(self, word: str) -> int:
        n = len(word)
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        single = bytearray(n + 1)  # 1: a piece of one character ends here
        unknown = bytearray(n + 1)  # 1: the best path's last step here is an unknown character
        at = 1
        for last, (length, score) in self.matches.iter(word):
            end = last + 1
            while at < end:
                if not single[at] and best[at - 1] + self.penalty > best[at]:
                    best[at], back[at], unknown[at] = best[at - 1] + self.penalty, at - 1, 1
                at += 1
            # matches of one end come longest first, that is by start
            total = score + best[end - length]
            if total > best[end]:
                best[end], back[end] = total, end - length
            single[end] |= length == 1
        while at <= n:
            if not single[at] and best[at - 1] + self.penalty > best[at]:
                best[at], back[at], unknown[at] = best[at - 1] + self.penalty, at - 1, 1
            at += 1
        count, end = 0, n
        while end:
            start = back[end]
            if not unknown[end] and word[start:end] != self.unknown:
                count, end = count + 1, start
                continue
            while start and (unknown[start] or word[back[start] : start] == self.unknown):
                start = back[start]
            fused, end = word[start:end], start
            count += len(fused.encode()) if self.bytes and fused != self.unknown else 1
        return count


@lru_cache(maxsize=2)
def _counter(vocab: tuple[tuple[str, float], ...]) -> tuple[Counter, dict[str, int]]:
    return Counter(vocab), {}


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_words, n_tokens)``, one row per input row.

    A text is put as words that each begin with the space mark, one for every space, and one before
    the text unless it begins with such.  The count is that of a unigram tokenizer over the vocabulary's pieces and scores on each of
    these words.  Words whose count is known are looked up; the memory of a worker is bounded.  Null
    and empty texts have no tokens.  Texts of any length are read whole; other columns are ignored.
    """
    vocab = vocabulary(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = _counter(vocab)
        for batch in pieces(batches, "text"):
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                total = 0
                marked = (text or "").replace(" ", SPACE)
                split = marked.removeprefix(SPACE).split(SPACE) if marked else ()
                for word in split:
                    n = known.get(word)
                    if n is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        n = counter(SPACE + word)
                        if len(word) <= 64:
                            known[word] = n
                    total += n
                words.append(len(split))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long")
