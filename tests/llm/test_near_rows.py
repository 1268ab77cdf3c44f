"""Near-duplicate rows whose ids repeat or are missing, signatures that collide, and very long texts."""

from __future__ import annotations

import random

import numpy as np
from conftest import sentence

from verdigris.llm import jaccard


def test_different_texts_of_one_id_stay(spark):
    rng = random.Random(3)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (1, a), (None, c), (None, c + " x"), (None, sentence(rng, 20)), (4, None), (4, ""), (5, " "), (3, b)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sig string").repartition(3)
    kept = jaccard.deduplicated(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == 7 and {(1, a), (1, b), (4, None), (4, ""), (5, " ")} <= set(got)
    assert sum(i is None for i, _ in got) == 2 and len({t for i, t in got if i is None} & {c, c + " x"}) == 1
    names = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.joined(df).collect()}
    assert names[2, 59] == 1 and names[3, 58] == 1 and names[4, 0] == 4


def test_signatures_that_collide(spark):
    """Two sets that are met with one signature get others."""
    s, t = np.array([5, 9], np.uint64), np.array([6], np.uint64)
    met = frozenset({jaccard.signature(s)})
    assert jaccard.signature(s, met) != jaccard.signature(s) and 0 <= jaccard.signature(s, met) < 1 << 63 and jaccard.signature(t, met) == jaccard.signature(t)
    rng = random.Random(9)
    texts = [sentence(rng, 30) for _ in range(3)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts + texts[:1])], "doc_id long, text string")
    first = {r["sig"] for r in jaccard.signatures(df).collect()}
    again = {r["sig"] for r in jaccard.signatures(df, met=frozenset(first)).collect()}
    assert len(first) == len(again) == 3 and not first & again


def test_very_long_near_copies(spark):
    rng = random.Random(5)
    w = sentence(rng, 120_000).split()
    edited = [f"e{k}" if k % 200 == 0 else x for k, x in enumerate(w)]
    rows = [(7, " ".join(w)), (8, " ".join(edited)), (9, " ".join(w[:60_000]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {7: 7, 8: 7, 9: 9}
