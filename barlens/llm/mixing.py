"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.common import small, stored, unused, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
FAN = 512
SMALL_SOURCES = 10_000

#: One step of the fold over a block: ``s`` carries the open document, ``x`` comes next.  Mass moves
#: between the two until one of them holds all or none of its words; the other stays open.  The
#: direction is drawn so that each keeps its expected mass, and the words of the two stay the same.
_STEP = """
aggregate(items,
  named_struct('pos', -1, 'h', 0L, 'size', 0D, 'mass', 0D, 'done', cast(array() as array<struct<pos:int,mass:double>>)),
  (s, x) -> CASE
    WHEN x.mass <= 0 OR x.mass >= x.size THEN
      named_struct('pos', s.pos, 'h', s.h, 'size', s.size, 'mass', s.mass,
                   'done', concat(s.done, array(named_struct('pos', x.pos, 'mass', x.mass))))
    WHEN s.pos < 0 THEN
      named_struct('pos', x.pos, 'h', x.h, 'size', x.size, 'mass', x.mass, 'done', s.done)
    WHEN {draw} * (least(s.size - s.mass, x.mass) + least(s.mass, x.size - x.mass)) < least(s.mass, x.size - x.mass) THEN
      CASE WHEN x.mass <= s.size - s.mass THEN
        named_struct('pos', s.pos, 'h', s.h, 'size', s.size, 'mass', s.mass + x.mass,
                     'done', concat(s.done, array(named_struct('pos', x.pos, 'mass', 0D))))
      ELSE
        named_struct('pos', x.pos, 'h', x.h, 'size', x.size, 'mass', x.mass - (s.size - s.mass),
                     'done', concat(s.done, array(named_struct('pos', s.pos, 'mass', s.size))))
      END
    WHEN s.mass <= x.size - x.mass THEN
      named_struct('pos', x.pos, 'h', x.h, 'size', x.size, 'mass', x.mass + s.mass,
                   'done', concat(s.done, array(named_struct('pos', s.pos, 'mass', 0D))))
    ELSE
      named_struct('pos', s.pos, 'h', s.h, 'size', s.size, 'mass', s.mass - (x.size - x.mass),
                   'done', concat(s.done, array(named_struct('pos', x.pos, 'mass', x.size))))
    END)
"""

#: The open document that is left at the top is rounded; the words by which that misses are made good
#: by documents of the same block, largest first, each flipped only if the miss shrinks.
_SETTLE = """
aggregate(sort_array(transform(outcome, o -> named_struct('less', -items[o.pos].size, 'pos', o.pos, 'mass', o.mass))),
  named_struct('miss', missed, 'done', cast(array() as array<struct<pos:int,mass:double>>)),
  (s, x) -> CASE
    WHEN x.less < 0 AND x.mass > 0 AND -x.less < 2 * s.miss THEN
      named_struct('miss', s.miss + x.less, 'done', concat(s.done, array(named_struct('pos', x.pos, 'mass', 0D))))
    WHEN x.less < 0 AND x.mass <= 0 AND -x.less < -2 * s.miss THEN
      named_struct('miss', s.miss - x.less, 'done', concat(s.done, array(named_struct('pos', x.pos, 'mass', -x.less))))
    ELSE named_struct('miss', s.miss, 'done', concat(s.done, array(named_struct('pos', x.pos, 'mass', x.mass))))
    END,
  s -> s.done)
"""


def _draw(*of: str) -> str:
    """A number in [0, 1) that depends on the keys alone, so that reruns agree."""
    return f"(shiftrightunsigned(xxhash64({', '.join(of)}), 11) / 9007199254740992D)"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, source_size, documents, weight, target)`` of ``sizes(source, size, n)``.

    Sources by code point, null last, take the weights in turn.  Together they get ``share`` times all
    words, each at most ``cap`` times its own: with sources in order of cap by weight, those below
    the common level are full, and the level follows from running sums.  One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    )
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("full_at", F.col("most") / F.col("weight"))
    everything, before = Window.partitionBy(), Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    heft = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", rest / heft)
    common = F.max(F.when(F.col("full_at") > F.col("level"), F.col("level"))).over(everything)
    return per.withColumn(
        "target", F.when(F.col("full_at") <= F.col("level"), F.col("most")).otherwise(F.least("most", common * F.col("weight")))
    ).select("source", "source_size", "documents", "weight", "target")


def mix(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, fan: int = FAN, seed: int = 11
) -> DataFrame:
    """How many words the mix takes of each row of ``docs(doc_id, text, source)``.

    Returns one row per input row: ``doc_id, source, size, source_size, target, copies, taken``.
    A document is due ``target / source_size`` copies: the whole part is given, the fraction goes to
    pivotal rounding.  Documents of a source are dealt into blocks of about ``fan`` by hash, each block
    is folded pair by pair, and the one open document of each block goes up to the next level of the
    tree, until a source has one, which is drawn; what that misses is made good within the top block.
    So a source's words come within about its smallest document of the target, no document passes
    ``cap`` times its size, and a hot source is many blocks.

    A null or empty text has size 0 and is taken 0 times its words; a null source is a source; rows that
    repeat (doc_id, source, size) are numbered and rounded each on its own; an empty table gives no row.
    Other columns are ignored.
    """
    sizes = stored(
        docs.select("source", "doc_id", word_count(F.col("text")).alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    )
    plan = stored(targets(sizes, weights, share, cap))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    plan = plan.withColumn("rate", rate).withColumn("source_no", F.xxhash64("source", F.col("source").isNull()))
    row = (
        sizes.join(small(plan, SMALL_SOURCES), sizes["source"].eqNullSafe(plan["source"]))
        .select(sizes["source"], "source_no", "doc_id", "size", "source_size", "target", "rate", "documents", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))
        .withColumn("h", F.xxhash64("doc_id", "size", "nth", F.lit(seed)))
    )
    most = plan.agg(F.max("documents")).head()[0]
    if not most:
        return row.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken"), "nth")

    blocks_of = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(fan))).cast("long")
    key = ("source", "source_no", "documents", "block")
    leaf = row.withColumn("block", F.pmod(F.xxhash64("h", F.lit("block")), blocks_of(F.col("documents"))))
    item = F.struct(
        F.xxhash64("h", F.lit("order")).alias("place"), "h", F.col("size").cast("double").alias("size"),
        (F.col("size") * (F.col("rate") - F.floor("rate"))).alias("mass"), "doc_id", "nth", "source_size", "target", "rate",
    )
    numbered = F.transform(F.col("items"), lambda x, i: x.withField("pos", i.cast("int")))
    folded = F.expr(_STEP.format(draw=_draw("s.h", "x.h", str(seed))))

    def fold(rows, it):
        packed = rows.groupBy(*key).agg(F.sort_array(F.collect_list(it)).alias("items")).withColumn("items", numbered)
        return stored(packed.withColumn("end", folded))

    levels = [fold(leaf, item)]
    blocks = -(-most // fan)
    while blocks > 1:
        blocks = -(-blocks // fan)
        open_ = levels[-1].where("end.pos >= 0")
        child = F.struct(
            F.xxhash64("end.h", F.lit(len(levels)), F.lit("order")).alias("place"), F.col("end.h").alias("h"),
            F.col("end.size").alias("size"), F.col("end.mass").alias("mass"), F.col("block").alias("child"),
        ).alias("it")
        up = open_.select("source", "source_no", blocks_of(F.col("documents")).alias("documents"), F.col("block").alias("child"), child)
        up = up.withColumn("block", F.pmod(F.xxhash64("child", F.lit(len(levels))), blocks_of(F.col("documents"))))
        levels.append(fold(up, F.col("it")))

    last = F.when(F.expr(_draw("end.h", "'last'", str(seed))) * F.col("end.size") < F.col("end.mass"), F.col("end.size")).when(F.col("end.pos") >= 0, 0.0)
    decided = None
    for tree in reversed(levels):
        if decided is None:
            settled = tree.withColumn("left", last)
        else:
            settled = tree.join(decided, ["source_no", "block"], "left")
        outcome = F.concat(
            F.col("end.done"),
            F.when(F.col("end.pos") >= 0, F.array(F.struct(F.col("end.pos").alias("pos"), F.coalesce("left", F.lit(0.0)).alias("mass")))).otherwise(
                F.expr("cast(array() as array<struct<pos:int,mass:double>>)")
            ),
        )
        settled = settled.withColumn("outcome", outcome)
        if decided is None:
            settled = settled.withColumn("missed", F.coalesce(F.col("left") - F.col("end.mass"), F.lit(0.0))).withColumn("outcome", F.expr(_SETTLE))
        out = settled.select("source", "source_no", "items", F.explode("outcome").alias("o")).select("source", "source_no", F.col("o.mass").alias("left"), F.expr("items[o.pos]").alias("it"))
        if tree is not levels[0]:
            decided = out.select("source_no", F.col("it.child").alias("block"), "left")
    whole = F.floor("it.rate")
    copies = (whole + F.when(F.col("it.size") > 0, F.round(F.col("left") / F.col("it.size"))).otherwise(0)).cast("long")
    return out.select(
        F.col("it.doc_id").alias("doc_id"), "source", F.col("it.size").cast("long").alias("size"), F.col("it.source_size").alias("source_size"),
        F.col("it.target").alias("target"), copies.alias("copies"), (copies * F.col("it.size")).cast("long").alias("taken"), F.col("it.nth").alias("nth"),
    )


def apply_mix(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``: each row with the copies the mix takes of it.

    Columns of these names are replaced.  Null texts have no words and no copies to count; rows that repeat
    share their copies among them; an empty table gives no row.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    decided = mix(docs, **settings)
    per = decided.groupBy("source", "doc_id", "size").agg(
        F.map_from_entries(F.collect_list(F.struct("nth", F.struct("source_size", "target", "copies", "taken")))).alias("mixed")
    )
    same = Window.partitionBy("source", "doc_id", "size").orderBy(F.xxhash64("text"))
    nth, mixed, own = (unused(docs.columns, x) for x in ("_nth", "_mixed", "_own"))
    numbered = docs.withColumn("size", word_count(F.col("text"))).withColumn(nth, F.row_number().over(same))
    on = [numbered[c].eqNullSafe(per[c]) for c in ("source", "doc_id", "size")]
    joined = numbered.join(per.withColumnRenamed("mixed", mixed), on).withColumn(own, F.element_at(mixed, F.col(nth)))
    return joined.select(*[numbered[c] for c in kept], numbered["size"], *[F.col(f"{own}.{c}").alias(c) for c in ("source_size", "target", "copies", "taken")])
