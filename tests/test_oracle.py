"""A few registered queries against their SQL; ``compare.py`` runs all of them."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from barlens.oracle import sql
from barlens.plans import queries as registry
from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
KEYS = (
    "detect_events", "earnings_windows", "quality_report", "max_drawdown", "ema", "calculated_ratios",
    "import_research", "event_outcomes",
)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, key):
    verdict, rows, _, _ = difference(spark, connect(SF_DIR), entry.queries()[key], entry.oracle_sql()[key], SF_DIR)
    assert verdict is None and rows > 0


def test_every_query_has_sql():
    assert set(sql.all_sql()) == set(registry.all_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
