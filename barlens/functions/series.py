"""Series over one ticker's sessions: Spark deals and sorts the rows, numpy takes whole tickers inside a task.

``in_order`` deals the tickers out and sorts each one's sessions by date, once.  ``over_sessions`` then adds columns and
keeps rows where they are, so that passes and plain column expressions follow each other without a further exchange or
sort.  A task holds the tickers of one Arrow batch, and one ticker has at most one row a calendar day.

A sliding frame costs numpy about a nanosecond a value; Spark's own sliding frames update an aggregate for every row
of every frame, and each window step copies the whole row.  A missing value is NaN in here and NULL outside.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import sessions

# executors need not have this package: its functions travel with the query
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CARRIED, _BLOCK = "_carried", 512
PLACE = "_place"


def in_order(df: DataFrame) -> DataFrame:
    """A ticker's rows in one task, by date."""
    return df.repartition("ticker").sortWithinPartitions("ticker", "date")


def numbered(df: DataFrame) -> DataFrame:
    """The same of rows that may lie so already, as stored bars do: they are then neither dealt nor sorted again.

    A window asks for this order; its number of the session is spent in the next pass.
    """
    return df.withColumn(PLACE, F.row_number().over(sessions()))


class Sessions:
    """Whole tickers, one after the other: their rows' places and their columns."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.n = batch, batch.num_rows
        self.starts = _starts(batch)
        self.lengths = np.diff(np.append(self.starts, self.n))
        self.at = np.arange(self.n) - np.repeat(self.starts, self.lengths)
        self.left = np.repeat(self.lengths, self.lengths) - self.at - 1
        self._known: dict[str, np.ndarray] = {}

    def x(self, column: str) -> np.ndarray:
        if column not in self._known:
            values = self.batch.column(column).cast(pa.float64())
            self._known[column] = values.to_numpy(zero_copy_only=False)
        return self._known[column]

    def know(self, column: str, values: np.ndarray) -> None:
        self._known[column] = values

    def seen(self, mask: np.ndarray) -> np.ndarray:
        """How many rows of the ticker so far are marked."""
        counted = np.cumsum(mask)
        return counted - np.repeat(counted[self.starts] - mask[self.starts], self.lengths)


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    codes = batch.column("ticker").dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def _whole_tickers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, cut only between tickers."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        cut = int(_starts(held)[-1])
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None:
        yield held


@dataclass(frozen=True)
class Series:
    """A column that is read, and what is made of it: one value a row."""

    column: str
    of: Callable[[Sessions], np.ndarray]
    others: tuple[str, ...] = ()  # further columns that it reads


@dataclass(frozen=True)
class Recursion:
    """y = kept * y + added, from 0 at the ticker's first session; ``of`` gives (kept, added, shown) of every row."""

    column: str
    of: Callable[[Sessions], tuple[np.ndarray, np.ndarray, np.ndarray]]


#: Columns made at one go: by a pass over the sessions, or by formulas of the row.
Step = dict[str, Series | Recursion | Column]


def _is_pass(step: Step) -> bool:
    return any(not isinstance(x, Column) for x in step.values())


def _reads(x: Series | Recursion | Column) -> set[str]:
    """What a series reads, or every name in a formula's text: one too many costs a column, one too few is Spark's error."""
    if isinstance(x, Column):
        return set(re.findall(r"\w+", str(x)))
    return {x.column, *getattr(x, "others", ())}


def derived(df: DataFrame, steps: list[Step], wanted: Iterable[str], last: bool = False) -> DataFrame:
    """Ticker, date and the wanted columns of rows that lie in order; ``steps`` make them, one after the other.

    A column that nothing wanted rests on is neither made nor carried along.  With ``last`` only the last session of each
    ticker is kept, by the last pass.
    """
    live, plan = {"ticker", "date", PLACE, *wanted}, []
    for step in reversed(steps):
        after, own, read = set(live), set(), set()
        for name, x in reversed(step.items()):
            # a series may be there only for one after it
            if name in live or (_is_pass(step) and name in read):
                own.add(name)
                read |= _reads(x)
        live = (live - own) | (read - own if _is_pass(step) else read)
        if own:
            plan.insert(0, ({c: x for c, x in step.items() if c in own}, after))
    df = df.select(*[c for c in df.columns if c in live])
    passes = [k for k, (step, _) in enumerate(plan) if _is_pass(step)]
    for k, (step, after) in enumerate(plan):
        df = over_sessions(df, step, last and k == passes[-1]) if k in passes else df.withColumns(step)
        df = df.select(*[c for c in df.columns if c in after])
    return df.drop(PLACE)


def over_sessions(df: DataFrame, columns: dict[str, Series | Recursion], last: bool = False) -> DataFrame:
    """Add columns of doubles to rows that lie ``in_order``; a series may read those before it.

    Doubles that no series reads travel as one array: what Spark does for each Arrow column of each row is then done once.
    With ``last`` only each ticker's last row is given back.
    """
    kept, reads = df.columns, {"ticker", *[r for s in columns.values() for r in _reads(s)]}
    carried = [f.name for f in df.schema.fields if f.name not in reads and isinstance(f.dataType, T.DoubleType)]
    if carried:
        df = df.select(*[c for c in kept if c not in carried], F.array(*carried).alias(_CARRIED))
    fields = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_tickers(batches):
            t = Sessions(batch)
            with np.errstate(all="ignore"):
                folded = _folded(t, {c: s.of(t) for c, s in columns.items() if isinstance(s, Recursion)})
                for c, s in columns.items():
                    t.know(c, folded[c] if c in folded else s.of(t))
            ends = t.starts + t.lengths - 1
            batch = batch.take(pa.array(ends)) if last else batch
            added = [pa.array(t.x(c)[ends] if last else t.x(c), pa.float64(), from_pandas=True) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=fields.names)

    place = {c: i for i, c in enumerate(carried)}
    columns_of = [F.get(_CARRIED, F.lit(place[c])).alias(c) if c in place else F.col(c) for c in kept if c != PLACE]
    return df.mapInArrow(run, fields).select(*columns_of, *columns)


def _folded(t: Sessions, maps: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """All recursions of all tickers of a batch, one session after the other."""
    if not maps:
        return {}
    kept, added = (np.stack([m[k] for m in maps.values()], axis=1) for k in (0, 1))
    longest = np.argsort(-t.lengths, kind="stable")
    starts, lengths = t.starts[longest], t.lengths[longest]
    y, out = np.zeros((len(starts), len(maps))), np.empty((t.n, len(maps)))
    going = np.searchsorted(-lengths, -np.arange(lengths[0]))
    for step, tickers in enumerate(going):
        rows = starts[:tickers] + step
        y = y[:tickers] * kept[rows] + added[rows]
        out[rows] = y
    return {c: np.where(m[2], out[:, k], np.nan) for k, (c, m) in enumerate(maps.items())}


def _by_blocks(how: Callable[..., np.ndarray], *rows: np.ndarray) -> np.ndarray:
    """``how`` of the rows, a block at a time: what it needs in between stays in the processor's cache."""
    return np.concatenate([how(*[r[i : i + _BLOCK] for r in rows]) for i in range(0, len(rows[0]), _BLOCK)])


def lag(column: str, n: int = 1) -> Series:
    """The value ``n`` sessions before; after, where n is negative."""

    def of(t: Sessions) -> np.ndarray:
        out, x = np.full(t.n, np.nan), t.x(column)
        if n >= 0:
            out[n:] = x[: max(t.n - n, 0)]
            out[t.at < n] = np.nan
        else:
            out[:n] = x[-n:]
            out[t.left < -n] = np.nan
        return out

    return Series(column, of)


def growth(column: str, n: int = 1) -> Series:
    """x / x of ``n`` sessions before - 1; where n is negative, what x grows by in that many sessions.  NULL on a zero base."""

    def of(t: Sessions) -> np.ndarray:
        now, other = t.x(column), lag(column, n).of(t)
        x, base = (now, other) if n > 0 else (other, now)
        return np.where(base == 0, np.nan, x / base - 1)

    return Series(column, of)


def _peaks(t: Sessions, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The row of the highest value so far, the first of equal ones (without any known, the ticker's first), and that value."""
    x = t.x(column)
    filled = np.where(np.isnan(x), -np.inf, x)
    top = np.concatenate([np.maximum.accumulate(filled[a : a + n]) for a, n in zip(t.starts, t.lengths, strict=True)])
    new = (t.at == 0) | (filled > np.append(-np.inf, top[:-1]))
    row = np.maximum.accumulate(np.where(new, np.arange(t.n), 0))
    return row, x[row]


def peak(column: str) -> Series:
    """The highest value so far."""
    return Series(column, lambda t: _peaks(t, column)[1])


def at_peak(column: str, of: str) -> Series:
    """The value of ``column`` where ``of`` was first as high as so far."""
    return Series(column, lambda t: t.x(column)[_peaks(t, of)[0]], (of,))


def at_first(column: str, other: str) -> Series:
    """The value of ``column`` where it and ``other`` were first both known; NULL before."""

    def of(t: Sessions) -> np.ndarray:
        x = t.x(column)
        both = ~np.isnan(x) & ~np.isnan(t.x(other))
        seen = t.seen(both)
        first = np.maximum.accumulate(np.where(both & (seen == 1), np.arange(t.n), 0))
        return np.where(seen > 0, x[first], np.nan)

    return Series(column, of, (other,))


def sessions_left(column: str) -> Series:
    """How many sessions of the ticker follow, whatever the column holds."""
    return Series(column, lambda t: t.left.astype(float))


def at_end(column: str) -> Series:
    """The value at the ticker's last session."""
    return Series(column, lambda t: np.repeat(t.x(column)[t.starts + t.lengths - 1], t.lengths))


def as_at_end(*columns: str) -> Series:
    """1 where all columns are as at the ticker's last session, else 0."""

    def of(t: Sessions) -> np.ndarray:
        return np.all([t.x(c) == at_end(c).of(t) for c in columns], axis=0).astype(float)

    return Series(columns[0], of, columns[1:])


def first_bit_of_end(column: str) -> Series:
    """1 where a bit set is on that is the lowest one on at the ticker's last session, else 0."""

    def of(t: Sessions) -> np.ndarray:
        end = at_end(column).of(t).astype(np.int64)
        return ((t.x(column).astype(np.int64) & end & -end) != 0).astype(float)

    return Series(column, of)


def both(column: str, known: str) -> Series:
    """1 where the column is 1 and the other one known, else 0."""
    return Series(column, lambda t: ((t.x(column) == 1) & ~np.isnan(t.x(known))).astype(float), (known,))


def runs(mark: str) -> Series:
    """How many runs of marked sessions the ticker has so far."""
    return Series(mark, lambda t: t.seen((t.x(mark) == 1) & ~(lag(mark).of(t) == 1)).astype(float))


def marked(how: Callable[[np.ndarray], float], column: str, mark: str) -> Series:
    """``how`` of the known values of the ticker's marked sessions, shown at its last one; NULL if there is none."""

    def of(t: Sessions) -> np.ndarray:
        out, x = np.full(t.n, np.nan), t.x(column)
        used = (t.x(mark) == 1) & ~np.isnan(x)
        for a, n in zip(t.starts, t.lengths, strict=True):
            values = x[a : a + n][used[a : a + n]]
            if len(values):
                out[a + n - 1] = how(values)
        return out

    return Series(column, of, (mark,))


def share_positive(values: np.ndarray) -> float:
    return np.mean(values > 0)


def rolled(how: Callable[..., np.ndarray], column: str, first: int, last: int, placed: bool = False) -> Series:
    """``how`` of the sessions from ``first`` to ``last``, counted from the row's; NULL unless all are there and known.

    With ``placed`` it is also given the number of each frame's first session.
    """
    size = last - first + 1

    def of(t: Sessions) -> np.ndarray:
        out = np.full(t.n, np.nan)
        if t.n >= size:
            frames = sliding_window_view(t.x(column), size)
            found = _by_blocks(how, frames, *([t.at[: len(frames)] + 1.0] if placed else []))
            rows = np.arange(len(found)) - first
            inside = (rows >= 0) & (rows < t.n)
            out[rows[inside]] = found[inside]
            out[(t.at + first < 0) | (t.left < last)] = np.nan
        return out

    return Series(column, of)


def known(how: Callable[[np.ndarray, np.ndarray], np.ndarray], column: str, first: int, last: int) -> Series:
    """``how``, two by two, of the known values of the sessions from ``first`` to ``last``; NULL if there is none."""

    def of(t: Sessions) -> np.ndarray:
        out = np.full(t.n, np.nan)
        for k in range(first, last + 1):
            out = how(out, lag(column, -k).of(t))
        return out

    return Series(column, of)


def _spread(freedom: int, w: np.ndarray) -> np.ndarray:
    # measured from a value of the frame, so that equal values have a spread of exactly 0
    return (w - w[:, :1]).std(axis=1, ddof=freedom)


def _fitted(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Slope per session: covariance over variance, each summed up value by value from running means as SQL engines do it.

    The division by the number of values comes first, as there: a slope of 0.1 is then rounded to the same side.
    """
    n = w.shape[1]
    mean_x = mean_y = together = spread = np.zeros(len(w))
    for k in range(n):
        x, y = first + k, w[:, k]
        dx, dy = x - mean_x, y - mean_y
        mean_x, mean_y = mean_x + dx / (k + 1), mean_y + dy / (k + 1)
        together, spread = together + dx * (y - mean_y), spread + dx * (dx - dx / (k + 1))
    return (together / n) / (spread / n)


mean, total = partial(np.mean, axis=1), partial(np.sum, axis=1)
highest, lowest = partial(np.max, axis=1), partial(np.min, axis=1)
least, most = np.fmin, np.fmax
std_samp, std_pop = partial(_spread, 1), partial(_spread, 0)


def upto(how: Callable[[np.ndarray], np.ndarray], column: str, n: int) -> Series:
    """Over the last ``n`` sessions, today's included."""
    return rolled(how, column, 1 - n, 0)


def slope(column: str, n: int) -> Series:
    """Least-squares slope per session of the last ``n`` values."""
    return rolled(_fitted, column, 1 - n, 0, placed=True)


def before(how: Callable[[np.ndarray], np.ndarray], column: str, n: int) -> Series:
    return rolled(how, column, -n, -1)


def after(how: Callable[[np.ndarray], np.ndarray], column: str, n: int) -> Series:
    return rolled(how, column, 1, n)


def _of_previous(how: Callable[..., np.ndarray], t: Sessions, column: str, n: int) -> np.ndarray:
    """``how`` of the ``n`` values before each row (NaN where the ticker has none) and the row's own."""
    x = t.x(column)
    frames = sliding_window_view(np.append(np.full(n, np.nan), x), n)[:-1]

    def block(frames: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        if (at < n).any():
            frames = np.where(np.arange(n) < (n - at)[:, None], np.nan, frames)
        return how(frames, x)

    return _by_blocks(block, frames, t.at, x)


def std_of_known(column: str, n: int, least: int) -> Series:
    """Sample deviation of the known values among the ``n`` before, NULL below ``least``."""

    def deviation(frames: np.ndarray, _: np.ndarray) -> np.ndarray:
        known = ~np.isnan(frames)
        count = known.sum(axis=1)
        base = np.take_along_axis(frames, known.argmax(axis=1)[:, None], axis=1)
        moved = np.where(known, frames - base, 0.0)
        off = np.where(known, moved - (moved.sum(axis=1) / count)[:, None], 0.0)
        return np.where(count >= least, np.sqrt((off * off).sum(axis=1) / (count - 1)), np.nan)

    return Series(column, lambda t: _of_previous(deviation, t, column, n))


def rank_of_previous(column: str, n: int, least: int) -> Series:
    """100 x share of the known values among the ``n`` before that are <= today's, equal up to one part in 1e12."""

    def rank(frames: np.ndarray, x: np.ndarray) -> np.ndarray:
        known = n - np.isnan(frames).sum(axis=1)
        up_to = (frames <= (x + np.abs(x) * 1e-12)[:, None]).sum(axis=1)
        return np.where(~np.isnan(x) & (known >= least), 100.0 * (up_to / known), np.nan)

    return Series(column, lambda t: _of_previous(rank, t, column, n))


def running_sum(column: str) -> Recursion:
    def of(t: Sessions):
        x = t.x(column)
        return np.ones(t.n), np.nan_to_num(x), t.seen(~np.isnan(x)) > 0

    return Recursion(column, of)


def ema(column: str, span: int) -> Recursion:
    """Exponential average, seeded by the first known value, shown from ``span`` known values on.

    A missing value ages what came before:  y = (d^g * y + a * x) / (d^g + a),  g sessions after the last known one.
    """
    a = 2.0 / (span + 1)

    def of(t: Sessions):
        x = t.x(column)
        known, rows = ~np.isnan(x), np.arange(t.n)
        last = np.append(-1, np.maximum.accumulate(np.where(known, rows, -1))[:-1])
        gap, seed = rows - last, last < rows - t.at
        aged = np.power(1.0 - a, gap)
        size = np.where(gap == 1, 1.0, aged + a)
        kept = np.where(known, np.where(seed, 0.0, aged / size), 1.0)
        added = np.where(known, np.where(seed, x, a * x / size), 0.0)
        return kept, added, t.seen(known) >= span

    return Recursion(column, of)


def wilder(column: str, period: int) -> Recursion:
    """Wilder average, seeded by the mean of the first ``period`` consecutive known values; a missing value later pauses it."""

    def of(t: Sessions):
        x, seeds = t.x(column), upto(mean, column, period).of(t)
        seen = t.seen(~np.isnan(seeds))
        seed, known = (seen == 1) & ~np.isnan(seeds), ~np.isnan(x) & (seen > 0)
        kept = np.where(seed, 0.0, np.where(known, (period - 1.0) / period, 1.0))
        added = np.where(seed, seeds, np.where(known, x / period, 0.0))
        return kept, added, seen > 0

    return Recursion(column, of)
