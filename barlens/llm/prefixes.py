"""Conversation prefix trie: which beginnings conversations share, and what sharing them saves."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.common import parts, stored, word_count

#: Turns in a row of a matrix, rows in a shard, places that one running total takes in one partition.
BLOCK, ROWS, STRETCH = 8, 200_000, 4096
#: Conversations that branch off one base, and the modulus of the number of turns they take from it (fixed by the query).
FAMILY, HEADS = 20, 4
#: What names a node: its depth and two 64-bit hashes of the turns down to it.
_KEY = ["depth", "ka", "kb"]


def _before(frame: DataFrame, by: str, at: str, columns: list[str], total: Callable[[str], Column], plus: Callable[[Column, Column], Column]) -> DataFrame:
    """The frame with ``<column>_before``: a total over the rows of the same ``by`` with a smaller ``at``.

    Totals run in stretches of ``STRETCH`` places, whose own totals are carried over.
    """
    names, key = frame.columns, [by, "stretch"]
    frame = frame.withColumn("stretch", F.expr(f"{at} div {STRETCH}"))
    past = Window.partitionBy(by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = frame.groupBy(*key).agg(*[total(c).alias(c) for c in columns])
    carried = carried.select(*key, *[F.coalesce(total(c).over(past), F.lit(0)).alias(f"{c}_past") for c in columns])
    within = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return frame.join(carried, key).select(
        *names, *[plus(F.coalesce(total(c).over(within), F.lit(0)), F.col(f"{c}_past")).alias(f"{c}_before") for c in columns]
    )


def numbered(conversations: DataFrame, heads: int = 0, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv_id, pos, skip, shift, one, two, words)`` and conversations ``(conv_id, n, base, skip, taken)``.

    ``pos`` is a turn's place in its conversation, ``one, two`` hash its role and text, ``words`` counts the words of
    its text.  With ``heads``, conversation c is to give up its first ``skip = crc32(c) % heads`` turns for
    as many of conversation ``base = c - c % family``; ``taken`` is how many that one has, ``shift`` what this
    moves the later turns by.

    All turns are sorted over ranges of (conv_id, turn) and numbered there, so a conversation of any
    length lies in as many tasks as its rows need.
    """
    hashed = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        *[F.xxhash64(F.lit(salt), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias(c) for c, salt in (("one", 1), ("two", 2))],
        word_count(F.col("text")).alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("one"), F.col("two"), F.col("row")]
    rows = hashed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "one", "two", "words", F.monotonically_increasing_id().alias("at"))
    rows = stored(rows).withColumn("part", F.shiftright("at", 33))
    spans = stored(rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    convs = spans.groupBy("conv_id").agg(F.sum("n").alias("n"))
    skip = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads if heads else F.lit(0).cast("long")
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), skip.alias("skip"))
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = stored(convs.join(bases, "base", "left").select("conv_id", "n", "base", "skip", F.least("skip", F.coalesce("base_n", F.lit(0))).alias("taken")))
    past = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(past), F.lit(0))).drop("n")
    spans = spans.join(convs.select("conv_id", "skip", (F.col("taken") - F.col("skip")).alias("shift")), "conv_id")
    turns = rows.join(spans, ["conv_id", "part"]).select("conv_id", (F.expr("at - first + before") + 1).alias("pos"), "skip", "shift", "one", "two", "words")
    return turns, convs


def rebuilt(conversations: DataFrame, heads: int = HEADS, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv_id, depth, one, two, words)`` and conversations of the families' branches: see ``numbered``."""
    turns, convs = numbered(conversations, heads, family)
    turns = stored(turns)
    own = turns.where("pos > skip").select("conv_id", (F.col("pos") + F.col("shift")).alias("depth"), "one", "two", "words")
    first = turns.where((F.col("pos") < heads) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "one", "two", "words")
    taken = convs.where("taken > 0").select("conv_id", "base", "taken").join(first, "base").where("depth <= taken")
    return own.union(taken.select(*own.columns)), convs.select("conv_id")


class Matrix:
    """The rows of a shard as padded matrices in lexical order, and where nodes start at every depth."""

    def __init__(self, batches: pa.Table) -> None:
        lists = batches.column("turns").combine_chunks()
        flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        rows, width = len(sizes), int(sizes.max(initial=0))
        at = np.repeat(np.arange(rows), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.a, self.b, self.words = (np.zeros((rows, width), np.int64) for _ in range(3))
        for into, name in ((self.a, "a"), (self.b, "b"), (self.words, "words")):
            into[at] = flat.field(name).to_numpy(zero_copy_only=False)
        self.block, self.pa, self.pb, self.conv = (batches.column(c).to_numpy() for c in ("block", "pa", "pb", "conv_id"))
        self.there = np.arange(width) < sizes[:, None]
        keys = [self.conv]
        for j in reversed(range(width)):
            keys += [self.b[:, j], self.a[:, j], self.there[:, j]]
        order = np.lexsort([*keys, self.pb, self.pa, self.block])
        for name in ("a", "b", "words", "block", "pa", "pb", "conv", "there"):
            setattr(self, name, getattr(self, name)[order])
        # hashes of the turns down to each place; the place before the first has that of the blocks before
        self.ka = np.bitwise_xor.accumulate(np.column_stack([self.pa, self.a]), axis=1)
        self.kb = np.bitwise_xor.accumulate(np.column_stack([self.pb, self.b]), axis=1)

    def nodes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For every column: the column, the rows that reach it, where its nodes start among them, each node's first row, and whether it touches an end of the shard."""

        def new(x: np.ndarray) -> np.ndarray:
            return np.concatenate([[True], x[1:] != x[:-1]])

        rows = len(self.conv)
        if not rows:
            return
        changed = new(self.block) | new(self.pa) | new(self.pb)
        for j in range(self.a.shape[1]):
            changed = changed | new(self.there[:, j]) | new(self.a[:, j]) | new(self.b[:, j])
            reach = np.flatnonzero(self.there[:, j])
            if len(reach):
                starts = np.flatnonzero(changed[reach])
                last = reach[np.append(starts[1:], len(reach)) - 1]
                yield j, reach, starts, reach[starts], (reach[starts] == 0) | (last == rows - 1)

    def key(self, j: int, first: np.ndarray) -> list[np.ndarray]:
        return [self.block[first] * BLOCK + j + 1, self.ka[first, j + 1], self.kb[first, j + 1]]


def _table(columns: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    kinds = [pa.bool_() if n == "edge" else pa.int64() for n in names]
    return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)).cast(t) for c, t in zip(columns, kinds)], names)


_NODES = ["depth", "ka", "kb", "edge", "qa", "qb", "conv_id", "n_convs", "words"]
_SUMS = ["depth", "ka", "kb", "edge", "gain", "leaves"]


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {'boolean' if n == 'edge' else 'long'}" for n in names)


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    matrix = Matrix(pa.Table.from_batches(held))
    out: list[list[np.ndarray]] = [[] for _ in _NODES]
    for j, reach, starts, first, edge in matrix.nodes():
        columns = [
            *matrix.key(j, first),
            edge,
            matrix.ka[first, j],
            matrix.kb[first, j],
            np.minimum.reduceat(matrix.conv[reach], starts),
            np.diff(np.append(starts, len(reach))),
            matrix.words[first, j],
        ]
        for into, column in zip(out, columns):
            into.append(column)
    yield from _table(out, _NODES).to_batches()


def _shard_sums(rows: pa.Table, owners: pa.Table) -> pa.Table:
    """What the owners among a node's conversations come to, for every node of a shard."""
    out: list[list[np.ndarray]] = [[] for _ in _SUMS]
    if rows.num_rows:
        matrix = Matrix(rows)
        owners = owners.sort_by("conv_id")
        ids = owners.column("conv_id").to_numpy()
        at = np.searchsorted(ids, matrix.conv)
        known = np.append(ids, matrix.conv.max() + 1)[at] == matrix.conv
        gain, leaves = (np.where(known, np.append(owners.column(c).to_numpy(), 0)[at], 0) for c in ("gain", "leaves"))
        for j, reach, starts, first, edge in matrix.nodes():
            columns = [*matrix.key(j, first), edge, np.add.reduceat(gain[reach], starts), np.add.reduceat(leaves[reach], starts)]
            for into, column in zip(out, columns):
                into.append(column)
    return _table(out, _SUMS)


def _recombined(found: DataFrame, rules: dict[str, Callable[[str], Column]]) -> DataFrame:
    """One row a node: those that touch no end of a shard are whole, the few others come from several shards."""
    columns = [*_KEY, *rules]
    edges = found.where("edge").groupBy(*_KEY).agg(*[f(c).alias(c) for c, f in rules.items()])
    return found.where("not edge").select(*columns).union(edges.select(*columns))


def _digests(ends: DataFrame) -> DataFrame:
    """``(depth, ka, kb, ends_sha256)``: the digest of the conversations that end at a node, ids ascending.

    A task hashes the sorted ids as they stream by and holds none of them.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            key, ids = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1), batch.column(3).to_numpy()
            if not len(ids):
                continue
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            done = []
            for first, some in zip(np.append(0, cuts), np.split(ids, cuts)):
                text = ",".join(map(str, some.tolist())).encode()
                own = tuple(key[first].tolist())
                if own == now:
                    state.update(b"," + text)
                    continue
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = own, hashlib.sha256(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*_KEY, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], [*_KEY, "ends_sha256"])

    sorted_ends = ends.select(*_KEY, "conv_id").repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id")
    return sorted_ends.mapInArrow(digest, "depth long, ka long, kb long, ends_sha256 string")


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie over ``turns(conv_id, depth, one, two, words)`` of ``convs(conv_id)``.

    Columns as in ``trie``.  Conversations are cut into blocks of ``BLOCK`` turns, each with the hashes of the
    turns before it; the blocks are sorted into ranges of (block, hashes before, turns), and a task holds
    one range as padded matrices.  There nodes start where a column or one before it changes, and
    reductions over these starts give each node's figures.  Nodes that touch an end of a range are put together from their parts.

    For sums over a subtree, a node belongs to its smallest conversation, which then owns the nodes of its path
    from some depth on.  The sum below a node is what its conversations own in all, less what
    its owner owns above it; so a second pass over the ranges sums one figure a conversation.
    """
    ids = [F.xxhash64(F.lit(salt), "depth", "one", "two").alias(c) for c, salt in (("a", 1), ("b", 2))]
    blocks = turns.select("conv_id", "depth", "words", *ids, F.expr(f"(depth - 1) div {BLOCK}").alias("block"))
    blocks = stored(
        blocks.groupBy("conv_id", "block").agg(
            F.sort_array(F.collect_list(F.struct("depth", "a", "b", "words"))).alias("turns"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb")
        )
    )
    slim = blocks.select("conv_id", "block", "xa", "xb", F.size("turns").alias("size"))
    behind = _before(slim, "conv_id", "block", ["xa", "xb"], F.bit_xor, lambda x, y: x.bitwiseXOR(y))
    behind = behind.select("conv_id", "block", F.col("xa_before").alias("pa"), F.col("xb_before").alias("pb"))
    order = F.flatten(F.transform("turns", lambda x: F.array(x["a"], x["b"])))
    shards = max(parts(turns.sparkSession), -(-blocks.count() // ROWS))
    ranged = blocks.select("conv_id", "block", "turns").join(behind, ["conv_id", "block"]).withColumn("order", order)
    ranged = ranged.repartitionByRange(shards, "block", "pa", "pb", "order", "conv_id").drop("order")
    ranged = stored(ranged.withColumn("shard", F.spark_partition_id()))

    whole = {"qa": F.first, "qb": F.first, "conv_id": F.min, "n_convs": F.sum, "words": F.first}
    found = _recombined(ranged.mapInArrow(_shard_nodes, _schema(_NODES)), whole)
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), none.alias("qa"), none.alias("qb"), "conv_id", "n_convs", zero.alias("words"))
    found = stored(found.union(root))
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("qa").alias("ka"), F.col("qb").alias("kb")).agg(F.count("*").alias("n_children"))
    found = found.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    found = stored(found.withColumn("gain", (F.col("n_convs") - 1) * F.col("words")))

    owners = found.groupBy("conv_id").agg(F.sum("gain").alias("gain"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    owners = stored(owners.where("gain <> 0 or leaves <> 0"))
    dealt = ranged.select("shard", "conv_id").distinct().join(owners, "conv_id").select(*[F.col(c).alias(c) for c in ("shard", "conv_id", "gain", "leaves")])
    sums = ranged.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(_shard_sums, _schema(_SUMS))
    sums = _recombined(sums, {"gain": F.sum, "leaves": F.sum})
    top = owners.agg(F.coalesce(F.sum("gain"), zero).alias("gain"), F.coalesce(F.sum("leaves"), zero).alias("leaves"))
    sums = sums.union(top.select(zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), "gain", "leaves"))
    sums = sums.select(*_KEY, F.col("gain").alias("owned"), F.col("leaves").alias("n_leaves"))

    ends = slim.groupBy("conv_id").agg(F.bit_xor("xa").alias("ka"), F.bit_xor("xb").alias("kb"), F.max(F.col("block") * BLOCK + F.col("size")).alias("depth"))
    ends = convs.join(ends, "conv_id", "left").fillna(0, _KEY)
    above = _before(found, "conv_id", "depth", ["gain"], F.sum, lambda x, y: x + y)
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("qa"), F.col("kb").alias("qb"), F.col("conv_id").alias("parent_conv_id"))
    out = above.join(sums, _KEY).join(_digests(ends), _KEY, "left").join(parents, ["depth", "qa", "qb"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("owned") - F.col("gain_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        F.concat(F.lpad(F.hex("ka"), 16, "0"), F.lpad(F.hex("kb"), 16, "0")).alias("node"),
    )


def trie(conversations: DataFrame, heads: int = 0, family: int = FAMILY) -> DataFrame:
    """One row for every distinct beginning of a conversation, the empty one included.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node)``: the smallest
    conversation that begins so, the number of turns, the parent's ``conv_id`` (root: null), conversations
    that begin so, one-turn continuations, nodes below without one (itself included), what storing shared turns once
    saves below (each node's words of its last text, times conversations but one), and the digest of
    the ids that end here; ``node`` is a 128-bit hash.  With ``heads`` conversations are first rebuilt from their family's base: see ``numbered``.

    Turns are ordered by turn, null first; turns of one number by a hash of role and text, repeats included.  Null
    role or text is empty; an empty conversation counts at the root.  Rows without conv_id belong to
    no conversation.  An empty table has no node.  Texts of any length are hashed whole, and a long
    conversation spreads over many blocks.  Other columns are ignored, whatever their names.
    """
    slim = conversations.select("conv_id", "turn", "role", "text")
    turns, convs = rebuilt(slim, heads, family) if heads else numbered(slim)
    if not heads:
        turns, convs = turns.select("conv_id", F.col("pos").alias("depth"), "one", "two", "words"), convs.select("conv_id")
    return nodes(turns, convs)
