"""Looking values up in sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_up_to(ordered: Column, limit: Column, room: int) -> Column:
    """How many values of a sorted array of at most ``room`` are <= limit: a binary search by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(room.bit_length()))])

    def step(found: Column, s: Column) -> Column:
        return F.when(F.get(ordered, found + s - 1) <= limit, found + s).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)
