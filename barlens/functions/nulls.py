"""Missing values are NULL, never NaN, and a missing comparison is false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and for the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def number(text: Column) -> Column:
    """Double from text that may hold ``$``, commas or blanks; anything else is NULL."""
    return finite(F.regexp_replace(text, r"[$,\s]", "").try_cast("double"))


def per(x: Column, base: Column) -> Column:
    """x / base where the base is positive, else NULL."""
    return F.try_divide(x, F.when(base > 0, base))


def growth(x: Column, base: Column) -> Column:
    """x / base - 1, NULL where either is missing or the base is zero."""
    return F.try_divide(x, base) - 1


def yes(condition: Column) -> Column:
    """The condition, with an unknown outcome read as false."""
    return F.coalesce(condition, F.lit(False))


def every(*conditions: Column) -> Column:
    """True where all are true.  One unknown makes the conjunction unknown or false."""
    return yes(reduce(lambda a, b: a & b, conditions))


def all_of(*conditions: Column) -> Column:
    """Plain conjunction, for rules where an unknown outcome does not match anyway."""
    return reduce(lambda a, b: a & b, conditions)


def some(*conditions: Column) -> Column:
    """True where any is true, whatever the unknown ones would be."""
    return yes(reduce(lambda a, b: a | b, conditions))


def missing(*names: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(n).isNull() for n in names))


#: Part of a bound by which a computed value may miss it from rounding alone.
TIE = 1e-12


def reached(x: Column, bound: float, slack: float = TIE) -> Column:
    """x >= bound (a positive number), where a value that misses it by rounding alone (``slack``) has reached it."""
    return x >= F.lit(float(bound) * (1 - slack))


def first_match(rules, default, unknown: Column | None = None) -> Column:
    """Label of the first true rule; ``unknown`` rows become "n/a".

    An unknown condition does not match, so rules need no null handling of their own.
    """
    chain = F.when(unknown, "n/a") if unknown is not None else None
    for condition, label in rules:
        chain = F.when(condition, label) if chain is None else chain.when(condition, label)
    return chain.otherwise(default)


def at_least(x: Column, ladder, lowest: str, unknown: Column) -> Column:
    """Label of the highest rung (descending bounds, inclusive) that x reaches."""
    return first_match([(x >= F.lit(float(b)), label) for b, label in ladder], lowest, unknown)


def points(label: Column, table: dict, absent=None) -> Column:
    """Double looked up by label."""
    chain = None
    for key, value in table.items():
        value = F.lit(float(value))
        chain = F.when(label == key, value) if chain is None else chain.when(label == key, value)
    return chain if absent is None else chain.otherwise(F.lit(float(absent)))


def items(*entries: Column) -> Column:
    """Array of the entries that are not NULL."""
    return F.array_compact(F.array(*entries))
