"""Disclosing terms of any length, with digits, and in scripts with combining marks."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from verdigris.llm import pii


def test_short_terms_and_digits(spark, sf_dir):
    rows = [(k, f"call Li or 李明 room B12 badge 4711 हिन्दी x7y{k} zorb{k} mail help@corp.example or {k}") for k in range(6)]
    rows += [(100 + k, f"call or room badge mail text{k} 12 47 B हिन्द or 李 711 x7 7y zor") for k in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, docs, sf_dir).collect()}
    # all that occurs with the address alone goes; the letters of a word with digits are terms too, as zorb; x and y are elsewhere
    assert [out[k] for k in range(6)] == [f"call  or  room  badge   x7y{k} {k} mail [EMAIL] or {k}" for k in range(6)]
    assert all(out[i] == t for i, t in rows if i >= 100)
    spans = pii.detected(docs.select("doc_id", "text"), term_chars=1).filter("doc_id = 1").select(pii._joined(F.col("terms")).alias("s")).first()["s"].split(",")
    text = rows[1][1]
    assert [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in spans)] == ["Li", "李明", "B12", "4711", "हिन्दी", "zorb"]
