"""Conversation prefix trie on small tables with odd rows, against brute force written apart from it."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from barlens.llm import prefixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns have names that the operator uses itself.
TURNS = "conv_id long, turn long, role string, text string, depth string, block string, gain long, shard long"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3, 4) for r in rows], TURNS)


def _table(seed=2):
    rnd = random.Random(seed)
    rows = []
    for c in list(range(0, 70)) + [101, 119, 140, 141, 1003, -7, -40]:
        for t in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "c", "", None, "d  e\tf"])))
    rows += [(200, t, "user", f"long {t % 3}") for t in range(60)] + [(201, t, "user", f"long {t % 3}") for t in range(45)]
    rows += [(c, t, "user", "the same copy") for c in range(300, 340) for t in range(3)]
    rows += [(400, None, "user", "before"), (400, 5, "user", "x"), (400, 5, "user", "x"), (400, -1, "user", "y")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None), (500, 0, "user", "word " * 3000)]
    return rows


def _branches(rows, heads):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    if not heads:
        return own
    rest = lambda c: c - (abs(c) // 20 * 20 if c >= 0 else -(-c // 20 * 20))
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = own.get(c - rest(c), [])[:h] + v[h:]
    return out


def _trie(convs):
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("heads", [4, 0])
@pytest.mark.parametrize("tight", [False, True])
def test_trie(spark, monkeypatch, heads, tight):
    if tight:  # shards of a few rows, totals carried over many stretches
        monkeypatch.setattr(prefixes, "ROWS", 9)
        monkeypatch.setattr(prefixes, "STRETCH", 2)
    rows = _table()
    got = prefixes.trie(_frame(spark, rows).repartition(4), heads=heads)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = got.collect()
    assert Counter(tuple(r[n] for n in names) for r in out) == _trie(_branches(rows, heads))
    assert len({r.node for r in out}) == len(out)


def test_branch_without_turns(spark):
    """A conversation that is shorter than what it gives up, and whose base is absent, ends at the root."""
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone too")]
    got = prefixes.trie(_frame(spark, rows), heads=4).drop("node").collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty(spark):
    assert prefixes.trie(_frame(spark, []), heads=4).count() == 0
    assert prefixes.trie(_frame(spark, [(None, 1, "user", "x")])).count() == 0
