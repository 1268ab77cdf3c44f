"""What languages are learned from, and the stage where nothing is labelled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verdigris.llm import langid


def test_without_labels_documents_stay(spark):
    rows = [(1, "some words"), (2, None), (3, "12 !"), (4, "漢字")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    with pytest.warns(UserWarning):
        kept = langid.accepted(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_whole_texts_are_learned_from_and_read(spark):
    """Only the end of each text says its language; the sample is bounded for all languages together."""
    head, ends = "9 8 7 . " * 3000, {"xx": "kaka toka boka ", "yy": "lili miri niri "}
    rows = [(k, head + ends[lang] * 60, lang) for k, lang in enumerate(["xx", "yy"] * 40)] + [(500, None, "xx"), (501, "", "yy"), (502, "lili", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, most=20)
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identified(docs, model).collect()}
    assert all(out[k] == lang for k, _, lang in rows[:80]) and out[500] == out[501] == "und" and out[502] == "yy"
