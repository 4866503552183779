"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors in double."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import parts, stored

NEIGHBOURS = 20
EVERY = 20
#: Vectors in a packed tile; vectors of one side that a task holds.
TILE, GROUP = 2048, 65_536

_TILES = "tile long, dim int, ids binary, codes binary, scales binary, errors binary, norms binary, raw binary"
_PARTS = (("ids", np.int64), ("codes", np.int8), ("scales", np.float64), ("errors", np.float64), ("norms", np.float64), ("raw", np.float64))


def _packed(tile: int, dim: int, ids: np.ndarray, raw: np.ndarray) -> dict:
    """A tile's vectors with codes ``round(v / scale)`` and the length of what the codes miss."""
    scales = np.abs(raw).max(axis=1) / 127
    codes = np.rint(raw / scales[:, None]).astype(np.int8)
    errors = np.linalg.norm(raw - codes * scales[:, None], axis=1)
    norms = np.linalg.norm(raw, axis=1)
    values = (ids, codes, scales, errors, norms, raw)
    return {"tile": tile, "dim": dim} | {k: v.astype(t).tobytes() for (k, t), v in zip(_PARTS, values, strict=True)}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"tile": pa.int64(), "dim": pa.int32()}
    names = ["tile", "dim", *(k for k, _ in _PARTS)]
    return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], kinds.get(k, pa.binary())) for k in names})


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, waiting = 0, {}

    def flush(dim: int):
        nonlocal seen
        ids, raw = zip(*waiting.pop(dim), strict=True)
        seen += 1
        return _batch([_packed((TaskContext.get().partitionId() << 32) + seen, dim, np.array(ids, np.int64), np.array(raw, np.float64))])

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            waiting.setdefault(len(v), []).append((i, v))
            if len(waiting[len(v)]) == TILE:
                yield flush(len(v))
    for dim in list(waiting):
        yield flush(dim)


def _opened(table: pa.Table) -> dict:
    """The tiles of a table as one set of arrays; ``rows`` names each vector by tile and place."""
    out = {k: [] for k, _ in _PARTS} | {"rows": []}
    for r in table.to_pylist():
        for k, t in _PARTS:
            a = np.frombuffer(r[k], t)
            out[k].append(a.reshape(-1, r["dim"]) if k in ("codes", "raw") else a)
        out["rows"].append((r["tile"] << 12) + np.arange(len(out["ids"][-1])))
    return {k: np.concatenate(v) for k, v in out.items()}


def _queries(every: int):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    rows.append({"tile": r["tile"], "dim": r["dim"], "rows": ((r["tile"] << 12) + at).astype(np.int64).tobytes()} | {
                        k: (a.reshape(-1, r["dim"]) if k in ("codes", "raw") else a)[at].tobytes() for k, t in _PARTS for a in [np.frombuffer(r[k], t)]
                    })
            if rows:
                out = _batch(rows)
                yield out.append_column("rows", pa.array([r["rows"] for r in rows], pa.binary()))

    return pick


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows, exact: 1024 terms of at most 127 * 127 fit in a float's 24 bits."""
    total = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], 1024):
        total += a[:, d : d + 1024].astype(np.float32) @ b[:, d : d + 1024].astype(np.float32).T
    return total


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double, summed in order of components, alike for equal rows."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _search(k: int):
    def search(key: tuple, tiles: pa.Table, asked: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if tiles.num_rows and asked.num_rows:
            c, q = _opened(tiles), _opened(asked.drop_columns(["rows"]))
            q["rows"] = np.concatenate([np.frombuffer(x, np.int64) for x in asked.column("rows").to_pylist()])
            for start in range(0, len(q["ids"]), 256):
                part = slice(start, start + 256)
                heaps: list[list] = [[] for _ in q["ids"][part]]
                least = np.full(len(heaps), -np.inf)
                for first in range(0, len(c["ids"]), TILE):
                    tile = slice(first, first + TILE)
                    near = _product(q["codes"][part], c["codes"][tile]) * q["scales"][part, None] * c["scales"][tile]
                    # |<q,c> - <q',c'>| <= |q||c - c'| + |q - q'||c'|, with |c'| <= |c| + |c - c'|
                    off = q["norms"][part, None] * c["errors"][tile] + q["errors"][part, None] * (c["norms"][tile] + c["errors"][tile])
                    off = off * (1 + 1e-9) + 1e-12 * q["norms"][part, None] * c["norms"][tile]
                    near[q["rows"][part, None] == c["rows"][tile]] = -np.inf
                    if near.shape[1] > k:
                        least = np.maximum(least, np.partition(near - off, near.shape[1] - k, axis=1)[:, near.shape[1] - k])
                    at, to = np.nonzero((near + off >= least[:, None]) & (near > -np.inf))
                    scores = _inner(q["raw"][part][at], c["raw"][tile][to])
                    for i, s, v in zip(at.tolist(), scores.tolist(), c["ids"][tile][to].tolist(), strict=True):
                        if len(heaps[i]) < k:
                            heapq.heappush(heaps[i], (s, -v))
                        elif heaps[i][0] < (s, -v):
                            heapq.heapreplace(heaps[i], (s, -v))
                    least = np.maximum(least, [h[0][0] if len(h) == k else -np.inf for h in heaps])
                for i, h in enumerate(heaps):
                    found["query_row"] += [int(q["rows"][start + i])] * len(h)
                    found["query_id"] += [int(q["ids"][start + i])] * len(h)
                    found["vec_id"] += [-v for _, v in h]
                    found["score"] += [s for s, _ in h]
        return pa.table({n: pa.array(v, pa.float64() if n == "score" else pa.int64()) for n, v in found.items()})

    return search


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each ``vec_id`` divisible by ``every``, its ``k`` largest inner products.

    Both sides are packed into tiles of int8 codes.  A task multiplies the tiles of one group of
    candidates (at most 65,536 vectors) with those of one group of queries; the products bound the true
    value from both sides, only pairs that may still be among the ``k`` are computed in double, and a
    heap per query keeps them.  A last ranking merges the heaps of all groups.  Nothing is left out:
    the result is exact, ties go to the smaller vec_id.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows
    without an id; vectors are compared with those of their own length.  Rows that repeat a vec_id are
    candidates and queries each for themselves.  Other columns are ignored.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    values = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding")).where(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0)
    )
    tiles = stored(rows.mapInArrow(_tiles, _TILES))
    count = tiles.agg(F.sum(F.length("ids") / 8).cast("long")).head()[0] or 0
    spark = vectors.sparkSession
    wide = max(parts(spark), -(-count // GROUP))
    tall = -(-count // (GROUP * every)) or 1
    asked = tiles.mapInArrow(_queries(every), _TILES + ", rows binary")
    left = tiles.withColumn("g", F.pmod(F.xxhash64("tile"), F.lit(wide))).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tall - 1).cast("long"))))
    right = asked.withColumn("h", F.pmod(F.xxhash64("tile"), F.lit(tall))).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long"))))
    found = left.groupBy("g", "h", "dim").cogroup(right.groupBy("g", "h", "dim")).applyInArrow(
        _search(k), "query_row long, query_id long, vec_id long, score double"
    )
    ranked = found.selectExpr(
        "query_id", "row_number() over (partition by query_row order by score desc, vec_id) as rank", "vec_id", "score"
    )
    return ranked.where(F.col("rank") <= k)
