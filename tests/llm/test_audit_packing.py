"""Divergence audit and packing on small tables with odd rows, against brute force written apart from them."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from barlens.llm import divergence, packing

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns have names that the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, term string, part long, ids string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCS)


def _corpus(n=80, seed=5):
    rnd = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Été", "Ö", "naïve", "漢字", "x-y", "A1b"]
    rows = [(i, " ".join(rnd.choice(vocab[: 1 + 6 * (i % 20)] + vocab[-6:]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "fr"]), rnd.choice("abcd")) for i in range(n)]
    rows += [(n, None, "en", "a"), (n + 1, "", None, None), (n + 2, "wab", "", "q"), (None, "wab wab Ö", "en", None), (n + 3, "tail " * 4000, "en", "zz")]
    rows += [(n + 4, "lone words only", "de", s) for s in ("a", "b")] + [(3, rows[3][1], "en", "a")] * 3 + [(n + 5, "1 2 3", "xx", "only")]
    return rows


def _audit(rows):
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOW))
        groups[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = set()
    for lang in held.keys() | {k for k, _ in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= 3)
        own = {s: c for (k, s), c in groups.items() if k == lang}

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        of = {s: shares(c) for s, c in own.items()}
        q = shares(sum(own.values(), Counter()))
        for s, p in of.items():
            pair = [(sum((p[t] - r[t]) ** 2 // r[t] for t in kept), x) for x, r in of.items() if x != s]
            term = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if own[s][t] and p[t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, x, v, k) for k, (v, x) in enumerate(ranked, 1) if part == "pair" or k <= 200}
    return out


@pytest.mark.parametrize("tight", [False, True])
def test_audit(spark, monkeypatch, tight):
    if tight:  # many shards, blocks, slices and flushes
        for name, value in {"HELD": 20, "SHARD": 25, "PAIRS": 8, "AT_ONCE": 10, "SLICE": 64}.items():
            monkeypatch.setattr(divergence, name, value)
    rows = _corpus()
    got = [tuple(r) for r in divergence.audit(_docs(spark, rows).repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == _audit(rows)


def test_audit_empty(spark):
    assert divergence.audit(_docs(spark, [])).count() == 0
    assert {tuple(r) for r in divergence.audit(_docs(spark, [(None, None, None, None), (1, "a b", None, "s")])).collect()} == {("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)}


def test_shares_pass_64_bits():
    n, over = np.array([10**13 - 1, 0, 7, 12345678901234]), np.array([10**15, 10**15 + 7, 9, 12345678901235])
    assert divergence._shares(n, over).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, over)]


def _texts():
    rnd = random.Random(1)
    words = ["Alpha", "beta's", "Ünïcode", "漢字", "<|endoftext|>", "\n\n", " ", "42", "!?", "x y", "🙂", "ᲊ"]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 300]))) for _ in range(40)]
    return [(i, t, "en", "s") for i, t in enumerate(out)] + [(50, None, None, None), (51, "", "", ""), (None, "no id", None, None), (3, "again", "x", "y"), (3, "again", "x", "y"), (52, "long " * 9000, None, None)]


@pytest.fixture(scope="module")
def right():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.VOCABULARY)


@pytest.mark.parametrize("size", [2048, 16])
def test_packing(spark, right, size):
    rows = _texts()
    want = Counter((i, tuple(right.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t, _, _ in rows)
    pieces = packing.pack(_docs(spark, rows).repartition(6), size=size).collect()
    by_sequence, found = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        by_sequence[r.sequence_id].append((r.offset, ids))
        found[r.doc_id, r.doc_tokens].append((r.start, ids))
    whole = {}
    for number, parts in by_sequence.items():
        at = 0
        whole[number] = []
        for offset, ids in sorted(parts):
            assert offset == at
            at += len(ids)
            whole[number] += ids
        assert at == size or at < size and at & (at - 1) == 0
    assert sorted(whole) == list(range(len(whole))) and sum(len(x) < size for x in whole.values()) <= size.bit_length()
    # the pieces of rows with one doc_id and length are told apart by their texts only
    for (i, n), parts in found.items():
        same = [ids for (j, ids), k in want.items() if j == i and len(ids) == n for _ in range(k)]
        assert Counter((a, tuple(p)) for a, p in parts).keys() <= {(a, x[a : a + len(p)]) for a, p in parts for x in same}
        assert sum(len(p) for _, p in parts) == n * len(same)
    stored = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(_docs(spark, rows).repartition(6), size=size).collect()}
    assert sorted(map(len, stored.values())) == sorted(map(len, whole.values()))
    assert Counter(x for ids in stored.values() for x in ids) == Counter(x for ids in want.elements() for x in ids[1])


def test_sequences_are_the_pieces(spark):
    docs = _docs(spark, _texts()).coalesce(1)
    pieces = packing.pack(docs, size=64).orderBy("sequence_id", "offset").collect()
    want = defaultdict(bytes)
    for r in pieces:
        want[r.sequence_id] += r.ids
    assert {r.sequence_id: r.ids for r in packing.sequences(docs, size=64).collect()} == {k: bytes(v) for k, v in want.items()}


def test_packing_empty(spark):
    assert packing.pack(_docs(spark, [])).count() == 0 and packing.sequences(_docs(spark, [])).count() == 0


def test_packing_query(spark, right):
    sf = "/root/testdata/sf0.001"
    ids = {r.doc_id: right.encode(r.text or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.queries()["op12_packing"](spark, sf).collect()
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))


def test_ids_are_the_tokenizers(right):
    encoder = packing.Encoder(packing.VOCABULARY)
    assert encoder.quick
    rnd = random.Random(9)
    parts = [" ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "　", "a", "bc", "'s", "'ll", "é", "1", "漢", "!", ".", "<|endoftext|>", "🙂", "\x00", "Ϳ", "ᲊ"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(encoder(text), "<u2").tolist() == right.encode(text, add_special_tokens=False).ids


def test_slices_of_long_texts(right, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 50)
    encoder = packing.Encoder(packing.VOCABULARY)
    text = "The  quick\n\nbrown fox, 漢字 <|endoftext|> it's so. " * 40
    assert np.frombuffer(encoder(text), "<u2").tolist() == right.encode(text, add_special_tokens=False).ids
