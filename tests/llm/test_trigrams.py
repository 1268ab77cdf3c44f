"""The query with two words of context against its SQL and the plain version."""

from __future__ import annotations

import duckdb
import pytest
from brute import backoff

import __spark_entry__


def test_trigram_query(spark, sf_dir):
    name = "op2_lm_scoring_trigrams"
    got = {r["doc_id"]: tuple(r) for r in __spark_entry__.queries()[name](spark, sf_dir).select("doc_id", "n_words", "log10_sum", "log10_mean", "n_backoff").collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {r[0]: r for r in c.sql(__spark_entry__.oracle_sql()[name]).fetchall()}
    plain = backoff(c.sql("SELECT doc_id, text FROM documents").fetchall(), order=3)
    assert got.keys() == want.keys() == plain.keys()
    for i, (_, n, total, mean, fewer) in got.items():
        assert (n, fewer) == (want[i][1], want[i][4])
        assert total == pytest.approx(want[i][2], abs=2e-4) == pytest.approx(plain[i][1], abs=2e-4)
        assert (mean is None) == (want[i][3] is None) and (mean is None or mean == pytest.approx(want[i][3], abs=2e-6))
