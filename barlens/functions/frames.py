"""Window frames over one ticker's sessions.

(ticker, date) is a key of every cleaned bar table (``cleaning.dedupe_keep_last``
enforces it), so one ticker holds at most one row per calendar day: a hundred
years are 36,525 rows.  Grouping by ticker is therefore bounded whatever the
number of tickers or raw copies, and all layers share ONE exchange and ONE sort
by using the same specification.

``era`` is a function of the date (four calendar years).  It is part of the sort
order so that the block-wise recurrences can use the same sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ERA_YEARS = 4


def era(date: str = "date") -> Column:
    return F.floor(F.year(date) / ERA_YEARS).cast("int")


def sessions():
    """A ticker's rows in date order."""
    return Window.partitionBy("ticker").orderBy("date")


def era_sessions():
    """The same order, written so that it also serves windows inside an era."""
    return Window.partitionBy("ticker").orderBy("era", "date")


def in_era():
    return Window.partitionBy("ticker", "era").orderBy("date")


def before(w, n: int):
    return w.rowsBetween(-n, -1)


def upto(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


def after(w, n: int):
    return w.rowsBetween(1, n)


def running(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def whole(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def full(agg: Callable[[Column], Column], x: Column, frame, n: int) -> Column:
    """agg(x) over the frame, only where the frame holds n known values."""
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def earlier(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)
