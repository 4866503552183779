"""The registered corpus queries and the pipeline on the smallest tables, against brute force."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
import corpus_pipeline
from barlens.llm import decontamination, tokens, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _code(text):
    w = WORD.findall((text or "").translate(LOW))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def _groups(codes):
    """Smallest id of each id's component, over all pairs."""
    top = {i: i for i in codes}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(codes)
    for a in ids:
        for b in ids:
            if a < b and (codes[a] ^ codes[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in ids}


def _leaks(texts, items):
    words = lambda t: " " + b" ".join(decontamination.words_of((t or "").encode())).decode() + " "
    asked = {i: words(t) for i, t in items}
    return {(d, i) for d, t in texts.items() for i, x in asked.items() if x in words(t)}


def test_all_are_registered_with_whole_tables(spark):
    names = entry.queries()
    assert [n for n in names if re.match(r"op\d+_", n)] and {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert "pipeline" in names


def test_decontamination(spark, docs):
    got = entry.queries()["op1_decontamination"](spark, SF).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in got}
    want = _leaks({i: r.text for i, r in docs.items()}, items)
    assert want and want <= found
    text = dict(items)
    for d, i in found - want:  # what is not verbatim shares most words in order
        own = decontamination.words_of(text[i].encode())
        assert decontamination.common_words(own, decontamination.words_of(docs[d].text.encode())) >= 0.5 * len(own)


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    right = Tokenizer(models.Unigram(list(tokens.vocabulary(tokens.VOCABULARY)), 0, True))
    right.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    got = {r.doc_id: r.n_tokens for r in entry.queries()["op4_token_counts"](spark, SF).collect()}
    assert got == {i: len(right.encode(r.text).ids) for i, r in docs.items()}


def test_mixing(spark, docs):
    got = entry.queries()["op7_mixing"](spark, SF).collect()
    assert len(got) == len(docs) and all(0 <= r.taken <= 2 * r.size for r in got)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(WORD.findall(docs[r.doc_id].text))
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(r.source_size == size[r.source] for r in got)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    least = {s: min(r.size for r in got if r.source == s) for s in size}
    assert np.mean([abs(taken[s] - target[s]) <= max(least[s], 0.05 * target[s]) for s in size]) > 0.9


def test_simhash(spark, docs):
    codes = {i: _code(r.text) for i, r in docs.items()}
    near = _groups(codes)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entry.queries()["op8_simhash"](spark, SF).collect()}
    assert got == {i: (f"{codes[i]:016x}", near[i]) for i in docs}


def test_html(spark):
    got = {r.page_id: r for r in entry.queries()["op9_html"](spark, SF).collect()}
    from html import unescape

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>|<[^<>]*$", "", x))).strip() for x in re.split(r"</?p>|</?h1>|<br>", article)]
        want = "\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_toxicity(spark, docs):
    import zlib

    got = {r.doc_id: r for r in entry.queries()["op10_toxicity"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert [got[i].score for i in docs] == pytest.approx(list(model([r.text for r in docs.values()])))
    told = {r.doc_id: r.toxic for r in labels.collect()}
    bad, good = ([got[i].score for i in told if told[i] == x] for x in (1, 0))
    assert np.mean([a > b for a in bad for b in good]) > 0.8


def test_pipeline(spark, docs):
    """Each stage against brute force on the rows that the stage before it kept."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    names = frame.columns
    rows = dict(docs)
    stages = dict(corpus_pipeline.STAGES)

    frame = stages["toxicity"](spark, frame, SF).cache()
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {i: r for i, r in rows.items() if model([r.text])[0] < 0.7}
    assert frame.columns == names and sorted(frame.collect()) == sorted(rows.values())

    frame = stages["line dedup"](spark, frame, SF).cache()
    seen, want = [], {}
    for i in sorted(rows):
        left = []
        for line in rows[i].text.split("\n"):
            have = set(line.encode().split())
            if not have or not any(9 * len(have & x) >= 4 * (len(have) + len(x)) for x in seen):
                left.append(line)
            if have:
                seen.append(have)
        want[i] = "\n".join(left)
    got = {r.doc_id: r for r in frame.collect()}
    assert frame.columns == names and {i: (r.text, r.n_chars) for i, r in got.items()} == {i: (t, len(t)) for i, t in want.items()}

    frame = stages["simhash near-dedup"](spark, frame, SF).cache()
    near = _groups({i: _code(t) for i, t in want.items()})
    kept = {r.doc_id for r in frame.collect()}
    assert frame.columns == names and kept == set(near.values())

    frame = stages["benchmark decontamination"](spark, frame, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in frame.collect()}
    leaks = {d for d, _ in _leaks({i: want[i] for i in kept}, items)}
    assert frame.columns == names and not left & leaks and len(kept - left - leaks) <= 2

    frame = stages["mixing sources to target weights"](spark, frame, SF)
    mixed = frame.collect()
    copies = {r.doc_id: r.copies for r in mixed}
    assert set(copies) <= left and Counter(r.doc_id for r in mixed) == copies and max(copies.values()) <= 2
    assert all(r.text == want[r.doc_id] and r.taken == r.copies * r.size for r in mixed)
    size = {i: len(WORD.findall(want[i])) for i in left}
    assert sum(r.size for r in mixed) == pytest.approx(1.5 * sum(size.values()), rel=0.1)
