"""Chat formatting: logged snapshots of a conversation collapse into the longest one before rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.common import stored

#: Turn numbers in a block, which is also a rendered part.
BLOCK = 1024
#: A block of more rows (turns without a number or with the same one) is cut into pieces of about so many.
PIECE = 16384
#: What a window holds.
_WITHIN = ["conv_id", "block", "piece"]


def _hash(salt: int):
    return F.xxhash64(
        F.lit(salt), "pos", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))
    )


def _joined(rows: DataFrame, pieces: DataFrame, how: str) -> DataFrame:
    """The rows with the further columns of their pieces."""
    pieces = pieces.withColumnsRenamed({c: f"_{c}" for c in _WITHIN})
    on = rows["conv_id"].eqNullSafe(pieces["_conv_id"]) & (rows["block"] == pieces["_block"]) & (rows["piece"] == pieces["_piece"])
    return rows.join(pieces, on, how).drop(*[f"_{c}" for c in _WITHIN])


def _in_pieces(rows: DataFrame, many: DataFrame) -> DataFrame:
    """The rows with the ``piece`` of their block: 0, but in the blocks of ``many`` the range of places that they lie in.

    There is at most one such block in ``PIECE`` rows of the table, so they are broadcast.
    """
    total = many.agg(F.sum("n")).head()[0]
    if not total:
        return rows.withColumn("piece", F.lit(0))
    many = F.broadcast(many.select(F.col("conv_id").alias("_conv_id"), F.col("block").alias("_block")))
    on = rows["conv_id"].eqNullSafe(many["_conv_id"]) & (rows["block"] == many["_block"])
    ranged = rows.join(many, on, "left_semi").repartitionByRange(
        -(-total // PIECE), "conv_id", "block", *[F.col(c).asc_nulls_last() for c in ("turn", "role", "text")]
    )
    # stored, as ranges are drawn anew when they are computed again
    return rows.join(many, on, "left_anti").withColumn("piece", F.lit(0)).union(stored(ranged.withColumn("piece", F.spark_partition_id())))


def prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with its place and the rolling hash of the turns up to it.

    Columns ``conv_id, block, piece, pos, role, text, one, two, here_one, here_two``: ``one, two`` hash the
    turns up to and with this one (two 64-bit hashes of place, role and text, folded by exclusive or),
    ``here_*`` this turn alone.  Turns are ordered by turn, role, text; a row that repeats wholly is one
    turn.  A conversation is cut into blocks of turn numbers and these, if they hold many rows, into pieces
    by place; their counts and hashes are carried over.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)).cast("long"))
    many = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).where(F.col("n") > PIECE)
    rows = _in_pieces(rows.distinct(), stored(many))
    order = [F.col(c).asc_nulls_last() for c in ("turn", "role", "text")]
    within = Window.partitionBy(*_WITHIN).orderBy(*order)
    rows = rows.withColumn("nth", F.row_number().over(within))
    earlier = Window.partitionBy("conv_id").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, -1)

    def carried(frame: DataFrame, of: dict) -> DataFrame:
        """The frame with what the earlier pieces of a conversation come to."""
        blocks = frame.groupBy(*_WITHIN).agg(*[v(F).alias(k) for k, v in of.items()])
        blocks = blocks.select(*_WITHIN, *[F.coalesce(v(F, k).over(earlier), F.lit(0)).alias(k) for k, v in of.items()])
        return _joined(frame, blocks, "left")

    rows = carried(rows, {"before": lambda f, k=None: f.sum(k) if k else f.count("*")})
    rows = rows.withColumn("pos", F.col("before") + F.col("nth")).drop("before")
    rows = stored(rows.withColumn("here_one", _hash(1)).withColumn("here_two", _hash(2)))
    rows = carried(rows, {f"past_{x}": (lambda f, k=None, x=x: f.bit_xor(k or f"here_{x}")) for x in ("one", "two")})
    run = within.rowsBetween(Window.unboundedPreceding, 0)
    for x in ("one", "two"):
        rows = rows.withColumn(x, F.col(f"past_{x}").bitwiseXOR(F.bit_xor(f"here_{x}").over(run)))
    return rows.drop("past_one", "past_two", "nth", "turn")


def maximal(prefixed: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, copies)`` of the conversations that no other one continues.

    Equal conversations are one, under the smallest conv_id (``copies`` counts them).  The beginnings
    that some turn continues are made distinct before the anti-join, so a first turn shared by a
    third of all conversations is one row of it.
    """
    ends = prefixed.groupBy("conv_id").agg(F.max(F.struct("pos", "one", "two")).alias("end"))
    classes = ends.groupBy(F.col("end.pos").alias("pos"), F.col("end.one").alias("one"), F.col("end.two").alias("two")).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")
    )
    continued = (
        prefixed.where("pos > 1")
        .select((F.col("pos") - 1).alias("pos"), F.col("one").bitwiseXOR(F.col("here_one")).alias("one"), F.col("two").bitwiseXOR(F.col("here_two")).alias("two"))
        .distinct()
    )
    return classes.join(continued, ["pos", "one", "two"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "copies")


def render(turns: DataFrame) -> DataFrame:
    """``(conv_id, part, n_turns, copies, rendered)``: maximal conversations as chat markup.

    A part holds the turns numbered from ``part * 1024`` on; an ordinary conversation has one.  A null
    role is written ``unknown``, a null text as nothing; a null conv_id is one conversation; turns
    without a number come last, in a part of their own.  A part of many rows is written piece by piece and
    then joined; its text is one value, so it must stay below 2 GB.  An empty table gives no row; other columns are ignored.
    """
    prefixed = stored(prefixes(turns))
    kept = maximal(prefixed)
    kept = kept.select(F.col("conv_id").alias("_kept"), "n_turns", "copies")
    marked = F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "role", "text"))),
        lambda x: F.concat(F.lit("<|im_start|>"), F.coalesce(x["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit("<|im_end|>\n")),
    )
    pieces = prefixed.select(*_WITHIN).distinct()
    pieces = pieces.join(kept, pieces["conv_id"].eqNullSafe(kept["_kept"])).drop("_kept")
    of = ["conv_id", F.col("block").alias("part"), "n_turns", "copies"]
    rows = _joined(prefixed, pieces, "inner")
    if prefixed.where("piece > 0").isEmpty():
        return rows.groupBy(*of).agg(F.array_join(marked, "").alias("rendered"))
    rows = rows.groupBy("piece", *of).agg(F.array_join(marked, "").alias("rendered"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("piece", "rendered"))), lambda x: x["rendered"])
    return rows.groupBy("conv_id", "part", "n_turns", "copies").agg(F.array_join(whole, "").alias("rendered"))
