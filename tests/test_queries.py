"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from verdigris.plans import registry


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) else str(x)

    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name in registry.ORACLES:
        rel = duck.sql(registry.ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())


def test_no_window_over_all_rows(spark, sf_dir):
    for name in ("w1_gaps", "w4_reactions_gated", "f1_prefilter", "k4_best_of_group"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name
