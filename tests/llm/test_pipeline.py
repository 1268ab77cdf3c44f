"""The pipeline against its plain version on the smallest tables."""

from __future__ import annotations

import re

import corpus_pipeline
from brute import contamination, personal
from test_stage_rules import kept

from verdigris.llm import packing
from verdigris.llm.common import materialize

SECRET = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?[A-Za-z0-9+/_-]{16}")


def test_stages_and_run(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in table.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = {i: t for i, t in rows.items() if t is not None and any(map(str.isalpha, t))}
    # near copies have five-word shingles in common, 0.8 of them or more
    want = {i: want[i] for i in kept(sorted(want.items()))}
    bad = contamination(list(want.items()), items)
    want = {i: t for i, t in want.items() if not bad[i][4]}
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == table.columns, name
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == want.keys()
    for i, t in want.items():
        assert personal(got[i]) == []
        if personal(t):
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", got[i])
        elif SECRET.search(t):
            assert "[SECRET]" in got[i]
        else:
            assert got[i] == t
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == want.keys()


def test_odd_rows_go_through(spark, sf_dir):
    """Null and repeated ids, null, empty and very long texts, repeated rows, and columns named like those of the operators."""
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    long = " ".join(words * 40)
    rows = [(1, "alpha beta gamma delta epsilon"), (1, "quite another text of the same id"), (1, "alpha beta gamma delta epsilon"), (None, "a text that has no id at all"), (2, None), (3, ""), (4, "12 34"), (5, long), (6, "alpha beta gamma delta epsilon")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", 7, 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, longest int, `row` int").repartition(3)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns, name
        assert docs.filter("score <> 'own' or longest <> 7 or `row` <> 8").count() == 0
    got = sorted((str(r["doc_id"]), r["text"]) for r in docs.collect())
    assert got == sorted([("1", rows[0][1]), ("1", rows[1][1]), ("None", rows[3][1]), ("5", long)])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert all(r["length"] <= packing.CAPACITY for r in pieces) and {r["doc_id"] for r in pieces} == {1, None, 5}


def test_an_empty_table_goes_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0
