"""Run registered queries on Spark and their oracle SQL on DuckDB and compare all values.

    python tests/compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value) + 0.0
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(spark, con, build, sql: str, sf_dir: str) -> tuple[str | None, int, float, float]:
    t0 = time.time()
    df = build(spark, sf_dir)
    left = canonical(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cursor = con.execute(sql)
    right = canonical([d[0] for d in cursor.description], cursor.fetchall())
    t2 = time.time()
    verdict = None
    if left[0] != right[0]:
        verdict = f"columns {sorted(set(left[0]) ^ set(right[0]))}"
    elif len(left[1]) != len(right[1]):
        verdict = f"rows {len(left[1])} against {len(right[1])}"
    elif left[1] != right[1]:
        bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
        a, b = bad[0]
        cells = [(c, x, y) for c, x, y in zip(left[0], a, b) if x != y][:6]
        verdict = f"{len(bad)} rows differ, first {a[:3]} {cells}"
    return verdict, len(left[1]), t1 - t0, t2 - t1


def main(argv: list[str]) -> int:
    from conftest import session
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    sqls, failed = entry.oracle_sql(), []
    builds = entry.queries()
    for key in argv[1:] or builds:
        if key not in sqls:
            n = len(builds[key](spark, sf_dir).collect())
            print(f"rows {key} {n}", flush=True)
            continue
        try:
            verdict, n, spark_s, sql_s = difference(spark, con, builds[key], sqls[key], sf_dir)
        except Exception as error:  # noqa: BLE001 - keep comparing the others
            verdict, n, spark_s, sql_s = f"error {str(error)[:600]}", 0, 0, 0
        if verdict or n == 0:
            failed.append(key)
        print(f"{'BAD ' if verdict else 'EMPTY ' if n == 0 else 'ok  '} {key} rows={n} {spark_s:.1f}s {sql_s:.1f}s {verdict or ''}", flush=True)
    print(f"{len(failed)} failed: {' '.join(failed)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
