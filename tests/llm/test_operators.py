"""Corpus operators on small tables with odd rows, against brute force written apart from them."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from barlens.llm import chat, decontamination, html, lines, mixing, neighbours, simhash, substrings, tokens, toxicity
from barlens.llm.common import hashed_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def _docs(spark, rows):
    """Documents with an extra column whose name operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def _corpus(n=60, seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        text = "\n".join(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 5)))
        out.append((i, text, rnd.choice(["a", "b", None])))
    base = out[0][1]
    for k in range(12):  # near copies
        words = base.split(" ")
        words[rnd.randrange(len(words))] = f"n{k}"
        out.append((100 + k, " ".join(words), "a"))
    out += [(200, base, "b"), (200, base, "b"), (None, base, None), (201, None, "a"), (202, "", "a"), (203, " \t\n ", "b"), (204, "wörd " * 3000, "é")]
    return out


def _none_last(x):
    return (x is None, x or 0)


@pytest.mark.parametrize("group", [1, 64])
def test_lines(spark, group):
    rows = _corpus()
    got = lines.removed_lines(_docs(spark, rows).select("doc_id", "text"), group).collect()
    kept, want = [], Counter()
    for i, text, _ in sorted(rows, key=lambda r: _none_last(r[0])):
        for k, line in enumerate((text or "").split("\n")):
            have = set(line.encode().split())
            if have and any(9 * len(have & x) >= 4 * (len(have) + len(x)) for x in kept):
                want[i, k] += 1
            if have:
                kept.append(have)
    assert Counter((r.doc_id, r.line) for r in got) == want
    cut = lines.without_repeats(_docs(spark, rows))
    assert cut.columns == _docs(spark, rows).columns and cut.count() == len(rows)
    left = {r.doc_id: (r.text, r.n_chars) for r in cut.collect() if r.doc_id not in (200, None)}
    for i, text, _ in rows:
        if i in left:
            expect = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if not want[i, k])
            assert left[i] == (expect, None if expect is None else len(expect))


def test_substrings(spark):
    rows = _corpus()
    rows += [(300, "a b c " * 40, None), (301, " ".join(f"z{i}" for i in range(50)), None), (302, "q " + " ".join(f"z{i}" for i in range(40)), None)]
    got = substrings.remove_repeats(_docs(spark, rows)).collect()
    seen = Counter()
    for _, t, _ in rows:
        w = WORD.findall(t or "")
        seen.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = []
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


@pytest.mark.parametrize("limit", [1, 2048])
def test_simhash(spark, limit):
    rows = _corpus()
    got = simhash.groups(_docs(spark, rows), limit).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def code(text):
        w = WORD.findall((text or "").translate(low))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    codes = [(i, code(t)) for i, t, _ in rows]
    group = {c: c for _, c in codes}

    def top(c):
        while group[c] != c:
            c = group[c]
        return c

    every = sorted(group)
    for a in every:
        for b in every:
            if a < b and (a ^ b).bit_count() <= 2:
                group[top(b)] = top(a)
    least = defaultdict(list)
    for i, c in codes:
        least[top(c)].append(i)
    want = [(i, f"{c:016x}", min((x for x in least[top(c)] if x is not None), default=None)) for i, c in codes]
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))
    kept = simhash.representatives(_docs(spark, rows), limit).collect()
    assert sorted((r.doc_id for r in kept), key=_none_last) == sorted((min(x, key=_none_last) for x in least.values()), key=_none_last)


def test_mixing(spark):
    rows = _corpus() + [(1000 + i, "x " * (1 + i % 7), "hot") for i in range(1500)] + [(5000 + i, "y", None) for i in range(3)]
    docs = _docs(spark, rows)
    got = mixing.mix(docs, fan=64).collect()
    again = mixing.mix(docs.repartition(5), fan=64).collect()
    key = lambda r: str((r.doc_id, r.size, r.source, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    total = Counter()
    for _, t, s in rows:
        total[s] += len(WORD.findall(t or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    left, rest, target = set(total), 1.5 * sum(total.values()), {}
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            rest -= target[s]
        left -= over
    taken = Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max(3, 0.02 * target[s]) or s not in ("hot",)
    applied = mixing.apply_mix(docs, fan=64)
    assert applied.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "copies", "taken"]
    assert sum(r.taken for r in applied.collect()) == sum(taken.values()) and applied.count() == len(rows)


def test_decontamination(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("bcdfgh") + rnd.choice("aeiou") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([15, 30, 59, 200, 22])] + [(9, None), (10, ""), (None, "x y z")]
    fill = [" ".join(word() for _ in range(rnd.randint(20, 120))) for _ in range(80)]
    rows = [(i, t, "a") for i, t in enumerate(fill)]
    leak = {}
    for k, t in items[:5]:
        i = 100 + k
        rows.append((i, f"{fill[k]} {t.upper() if k == 1 else t}. {fill[k + 5]}", "a"))
        leak[i] = k
    w = items[4][1].split()
    rows.append((150, fill[9] + " " + " ".join(x for j, x in enumerate(w) if j % 6 != 2) + " " + fill[8], "a"))  # a paraphrase
    leak[150] = 4
    rows += [(151, None, "a"), (152, "", "a"), (None, items[0][1], "a"), (153, fill[0] * 50 + " " + items[0][1], "a")]
    leak |= {None: 0, 153: 0}
    docs, bench = _docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.matches(docs, bench)
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == sorted(leak.items(), key=str)
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - set(leak)
    assert decontamination.matches(docs.limit(0), bench).count() == 0 and decontamination.matches(docs, bench.limit(0)).count() == 0


def test_decontamination_without_rare_words(spark):
    """Items are found by words that many passages hold, with the words that the corpus never holds replaced."""
    rnd = random.Random(6)
    usual = [f"u{i}" for i in range(300)]
    fill = [" ".join(rnd.choices(usual, k=64)) for _ in range(200)]
    items, rows = [], [(i, t, "a") for i, t in enumerate(fill)]
    for k in range(4):
        words = rnd.sample(usual, 30)
        for j in range(9):
            words[3 * j] = f"rare{k}x{j}"
        items.append((k, " ".join(words)))
        told = [f"other{k}" if w.startswith("rare") else w for w in words]
        rows.append((1000 + k, f"{fill[k]} {' '.join(told)} {fill[k + 9]}", "a"))
    got = decontamination.matches(_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1000 + k, k) for k in range(4)}
    none = spark.createDataFrame([(0, "alpha beta gamma delta")], "item_id long, text string")
    assert decontamination.matches(_docs(spark, rows), none).count() == 0


def test_passages_gram_and_latent_parts():
    """A task's half Gram matrix and the latent parts are those of the dense matrix of passages."""
    rnd = random.Random(8)
    words = [f"w{i}".encode() for i in range(40)]
    texts = [b" ".join(rnd.choices(words + [b"none"], k=n)) for n in (0, 1, 5, 31, 32, 33, 64, 65, 200, 900, 3000)]
    vocab, idf = decontamination.Vocabulary(words), np.linspace(0.5, 2, 40)
    doc, place, word, _ = vocab.find(texts)
    rows, row, word, value = decontamination._passages(doc, place, word, idf)
    dense = np.zeros((len(rows), 40))
    dense[row, word] = value
    batches = [pa.RecordBatch.from_pydict({"text": pa.array([t.decode() for t in part])}) for part in (texts[:8], texts[8:])]
    half = np.frombuffer(next(decontamination._gram(vocab, idf)(iter(batches))).column(0)[0].as_py(), np.float32)
    assert half[-1] == len(rows)
    assert np.allclose(decontamination._full(half[:-1], 40), dense.T @ dense, rtol=1e-5)
    axes = np.random.default_rng(1).normal(size=(40, 7)).astype(np.float32)
    counts = np.bincount(row, minlength=len(rows))
    got = decontamination._latent(axes, np.cumsum(counts) - counts, counts, word, value)
    assert np.allclose(got, dense @ axes, atol=1e-4)


def test_descent_holds_nothing_of_its_input_s_length(monkeypatch):
    """The driver's regression takes some documents at a time; its steps are those of the dense matrix."""
    monkeypatch.setattr(toxicity, "ROUNDS", 3)
    rng = np.random.default_rng(4)
    sizes = np.append(rng.integers(0, 40, 60), [500, 0])
    feature = np.concatenate([rng.permutation(600)[:k] for k in sizes]).astype(np.int32)
    ratio, label = rng.normal(size=600), (rng.random(62) < 0.4).astype(float)
    dense = np.zeros((62, 600))
    dense[np.repeat(np.arange(62), sizes), feature] = ratio[feature]
    got = {}
    for part in (7, 1 << 17):
        monkeypatch.setattr(toxicity, "_PART", part)
        got[part] = toxicity._descend(sizes, feature, ratio, label)
    assert np.allclose(got[7][0], got[1 << 17][0], atol=1e-12) and abs(got[7][1] - got[1 << 17][1]) < 1e-12
    v = np.random.default_rng(1).normal(size=600)
    for _ in range(12):
        v = dense.T @ (dense @ (v / np.linalg.norm(v)))
    step = 1 / (0.25 * np.linalg.norm(v) / 62 * 1.1 + toxicity.RIDGE + 0.25)
    w, past, b = np.zeros(600), np.zeros(600), np.log(label.mean() / (1 - label.mean()))
    pb = b
    for k in range(3):
        y, yb = w + k / (k + 3) * (w - past), b + k / (k + 3) * (b - pb)
        miss = 1 / (1 + np.exp(-(dense @ y + yb))) - label
        past, w, pb, b = w, y - step * (dense.T @ miss / 62 + toxicity.RIDGE * y), b, yb - step * miss.mean()
    assert np.allclose(got[7][0], w * ratio, atol=1e-12) and abs(got[7][1] - b) < 1e-12

    many = np.full(20_000, 200)
    feature = rng.integers(0, 600, many.sum()).astype(np.int32)
    tracemalloc.start()
    try:
        toxicity._descend(many, feature, ratio, (rng.random(20_000) < 0.4).astype(float))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < feature.nbytes


def test_gram_matrix_stays_out_of_the_driver(spark):
    """Only the axes are sent to the driver, whatever the number of words."""
    words = [f"w{i}" for i in range(3000)]
    items = decontamination.items_of(1, " ".join(words))
    docs = _docs(spark, [(i, " ".join(words[i : i + 900]), "a") for i in range(0, 2400, 300)])
    tracemalloc.start()
    try:
        model = decontamination.fit(docs, items)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.axes.shape == (3000, decontamination.RANK)
    assert most < 4 * 3000**2


def test_decontamination_with_more_words_than_a_gram_matrix(spark, monkeypatch):
    """Passes over stored passages find what one Gram matrix finds."""
    rnd = random.Random(12)
    usual = [f"u{i}" for i in range(300)]
    items = [(k, " ".join(rnd.sample(usual, 30))) for k in range(6)]
    texts = [" ".join(rnd.choices(usual, k=90)) for _ in range(60)]
    rows = [(i, f"{t} {items[i % 6][1]} {t}" if i % 5 == 0 else t, "a") for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(decontamination.matches(_docs(spark, rows), bench).collect())
    monkeypatch.setattr(decontamination, "GRAM", 0)
    assert sorted(decontamination.matches(_docs(spark, rows), bench).collect()) == one
    assert {(r.doc_id, r.item_id) for r in one} >= {(i, i % 6) for i in range(0, 60, 5)}


def test_hashed_words():
    """A word has one hash wherever it stands, and different words have different ones, whatever bytes fill them up."""
    words = [b"a" * n for n in range(1, 40)] + [b"a" * n + b"\0" * m for n in (1, 7, 8, 9) for m in range(1, 12)]
    words += [b"%d" % i for i in range(5000)] + [b"long-common-beginning-%d-and-end" % i for i in range(500)]
    starts, hashes = hashed_words(np.frombuffer(b" ".join(words), np.uint8))
    assert len(set(hashes.tolist())) == len(words) == len(starts)
    again = hashed_words(np.frombuffer(b"\n\t" + b"\x0b ".join(words[::-1]) + b" ", np.uint8))
    assert again[1].tolist() == hashes.tolist()[::-1] and again[0][0] == 2
    assert all(len(x) == 0 for text in (b"", b"  ") for x in hashed_words(np.frombuffer(text, np.uint8)))


def test_common_words():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_words(a, b) == table[-1][-1]


def test_tokens(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = list(tokens.vocabulary(tokens.VOCABULARY))
    right = Tokenizer(models.Unigram(vocab, 0, True))
    right.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdeth <>unk/s\n日ñé🙂 ▁0x1A") for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    texts += [t for _, t, _ in _corpus() if t] + ["a" * 5000, "日" * 300]
    got = tokens.token_counts(_docs(spark, [(i, t, None) for i, t in enumerate(texts)] + [(-1, None, None)])).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(x.ids) for i, x in enumerate(right.encode_batch(texts))} | {-1: 0}
    # ties of scores, and a vocabulary without bytes
    tied = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0), ("aba", -3.0)]
    small, count = Tokenizer(models.Unigram(tied, 0, False)), tokens.Counter(tuple(tied))
    for _ in range(500):
        w = "▁" + "".join(rnd.choice("abx") for _ in range(rnd.randint(0, 9)))
        assert count(w) == len(small.encode(w).ids)


def test_neighbours(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in (rnd.normal(size=8) * 10).round()]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, None), (2001, []), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0] * 7 + [None])]
    rows += [(None, rows[3][1]), (2080, [1.0, 2.0]), (2081, [3.0, 2.0]), (2100, [float("inf")] * 8)]
    got = neighbours.nearest(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")).collect()
    fine = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = []
    for q, a in fine:
        if q % 20 == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(a) == len(b))[:20]
            want += [(q, k + 1, i, pytest.approx(-s)) for k, (s, i) in enumerate(near)]
    assert sorted(tuple(r) for r in got) == sorted(want, key=lambda x: x[:3])


def test_chat(spark):
    talks = {1: "abc", 2: "ab", 3: "abd", 4: "abc", 5: "a", 6: "x", 7: None, None: "xy"}
    rows = [(c, t, "user", x, "extra") for c, s in talks.items() for t, x in enumerate(s or [None])]
    rows += [(8, None, None, "last", "e"), (8, 0, "user", "first", "e"), (8, 0, "user", "first", "e"), (9, 5000, "user", "far", "e"), (9, 1, "user", "near", "e")]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")).collect()
    assert sorted(((r.conv_id, r.n_turns, r.copies) for r in got), key=str) == sorted(
        [(1, 3, 2), (3, 3, 1), (7, 1, 1), (None, 2, 1), (8, 2, 1), (8, 2, 1), (9, 2, 1), (9, 2, 1)], key=str
    )
    one = next(r for r in got if r.conv_id == 1)
    assert one.rendered == "".join(f"<|im_start|>user\n{x}<|im_end|>\n" for x in "abc")
    assert {r.rendered for r in got if r.conv_id == 8} == {"<|im_start|>user\nfirst<|im_end|>\n", "<|im_start|>unknown\nlast<|im_end|>\n"}


def test_chat_of_many_turns_in_one_block(spark, monkeypatch):
    """Turns without a number and conversations without an id are cut by place: no window holds them all."""
    monkeypatch.setattr(chat, "PIECE", 256, raising=False)
    rows = [(None, k % 7, "user", f"n{k:04}") for k in range(3000)] + [(5, None, None if k % 9 == 0 else "user", f"t{k:04}") for k in range(2000)]
    rows += [(6, None, "user", f"t{k:04}") for k in range(40)] + [(7, 0, "user", "x"), (7, 1, "user", None)] + rows[:50]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    placed = chat.prefixes(frame)
    held = placed.groupBy(*[c for c in ("conv_id", "block", "piece") if c in placed.columns]).count().agg({"count": "max"}).head()[0]
    assert held <= 3 * 256
    places = Counter((r.conv_id, r.pos) for r in placed.collect())
    sizes = {None: 3000, 5: 2000, 6: 40, 7: 2}
    assert places == Counter((c, k + 1) for c, n in sizes.items() for k in range(n))
    got = chat.render(frame).collect()
    for c, n in sizes.items():
        mine = sorted({r for r in rows if r[0] == c}, key=lambda r: tuple(_none_last(x) for x in r[1:]))
        want = "".join(f"<|im_start|>{r[2] or 'unknown'}\n{r[3] or ''}<|im_end|>\n" for r in mine)
        assert [(r.n_turns, r.copies, r.rendered) for r in got if r.conv_id == c] == [(n, 1, want)]


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; line</h1><p>One\n two<b>three</b>.<br><p>Four</article>"
     "<footer>&copy; foot</footer>", "Head & line\nOne twothree.\nFour"),
    ("<body><div class='site-header'>Logo</div><div id=content><p>First long paragraph of the text.</p><div class=\"ad\">Buy</div><p>Second &#233; paragraph.</p></div>"
     "<div class='comments'><p>I disagree with all of this text.</p></div><script>var t='</p>';</script></body>", "First long paragraph of the text.\nSecond é paragraph."),
    ("<main><p>Text<aside>side</aside><form><input>Name</form><!-- no --><ul><li>a</li><li>b</li></ul></main><div>after</div>", "Text\na\nb"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p>whole</p><p>cut <a hre", "whole\ncut"),
    ("just words", "just words"),
    ("<p></p>", ""),
    ("", ""),
    (None, ""),
]


def test_html(spark):
    rows = [(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)] + [(None, None, "<article>" + "<p>long" * 20000, "x")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), f"u{i}")
    assert got[None].text.count("\n") == 19999


def test_html_blocks():
    """Surge and dive choose the block: with and without a named article."""
    long, more, close = "Long text. " * 55, "More text. " * 55, "Closing words. " * 7
    page = f"<body><div id=content><p>{long}</p><div class=ad>Buy</div><p>{more}</p><div class=ad>Buy</div><p>{close}</p></div><div>Imprint</div></body>"
    assert html.main_text(page) == "\n".join(x.strip() for x in (long, more, close))
    # an article that holds little of the text does not decide
    page = f"<body><article><p>Teaser of another page.</p></article><div class=ad>Buy</div><div><p>{long}</p><p>{more}</p><div class=ad>Buy</div><p>{close}</p></div></body>"
    assert html.main_text(page) == "\n".join(x.strip() for x in (long, more, close))
    # one that holds most of it does, and is kept with its short stretches
    page = f"<body><div>Top story</div><article><h1>Head</h1><div class=ad>Buy</div><section><p>{long}</p></section><div class=ad>Buy</div><section><p>End.</p></section></article><div>Small print</div></body>"
    assert html.main_text(page) == "\n".join(["Head", long.strip(), "End."])


def test_toxicity(spark):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 80))]
        if bad:
            for stem in rnd.sample(["zgrumpf", "Vuxxo", "kwirrz"], 2):
                w.insert(rnd.randrange(len(w)), stem + rnd.choice(["", "a", "en", "ou"]))
        rows.append((i, " ".join(w), None))
        labels.append((i, int(bad)))
    rows += [(5000, None, None), (5001, "", None), (None, "words", None), (5002, "abc " * 20000 + "zgrumpfa", None)]
    labels += [(5001, None), (None, 1), (9999, 1), (3, 0), (7, 5)]
    docs, told = _docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, told, columns=["doc_id"])
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(rows)
    import zlib

    score = {r.doc_id: (r.score, r.predicted) for r in got.collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([score[i][1] == (i % 5 == 0) for i in held]) > 0.97
    assert score[5000] == score[5001] and all(0 <= s <= 1 for s, _ in score.values())
    assert {i for i in range(1500) if score[i][1] == 0} == {r.doc_id for r in toxicity.clean(docs, told).collect()} & set(range(1500))
    flipped = spark.createDataFrame([(i, 1 - t if i in set(held) and t in (0, 1) else t) for i, t in labels], "doc_id long, toxic int")
    other = {r.doc_id: r.score for r in toxicity.score(docs, flipped, columns=["doc_id"]).collect()}
    assert all(other[i] == pytest.approx(score[i][0]) for i in other)
    assert {r.score for r in toxicity.score(docs.limit(5), told.limit(0)).collect()} == {toxicity.Model(np.zeros(8, np.int32), np.zeros(1), -500.0)(["x"])[0]}


def test_empty_tables(spark):
    docs = _docs(spark, [(1, "x", "a")]).limit(0)
    assert lines.removed_lines(docs).count() == lines.without_repeats(docs).count() == 0
    assert substrings.remove_repeats(docs).count() == simhash.groups(docs).count() == simhash.representatives(docs).count() == 0
    assert mixing.mix(docs).count() == mixing.apply_mix(docs).count() == tokens.token_counts(docs).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, none).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_digest(spark):
    kept = substrings.remove_repeats(_docs(spark, [(1, "a  b\tc", None)])).selectExpr("sha2(kept, 256) h").head().h
    assert kept == hashlib.sha256(b"a b c").hexdigest()


def test_columns_with_the_operators_own_names(spark):
    """Names that operators use inside stay as they are in the input."""
    names = ["_code", "_id", "_none", "_nth", "_text", "_mixed", "_own", "mixed"]
    rows = [(i, f"some words of document {i % 3} " * 9, "en", "s", *[7] * len(names)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    for out in (simhash.representatives(docs), mixing.apply_mix(docs), toxicity.score(docs, labels), toxicity.clean(docs, labels)):
        kept = out.collect()
        assert kept and all(r[n] == 7 for r in kept for n in names)
    empty = docs.limit(0)
    assert toxicity.clean(empty, labels).count() == simhash.representatives(empty).count() == 0
    assert decontamination.decontaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 12
