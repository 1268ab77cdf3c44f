"""Rows of language-model scores: missing and repeated ids, texts whose n-grams are never seen twice, very long texts."""

from __future__ import annotations

import random

import pytest
from brute import backoff
from conftest import sentence

from verdigris.llm import lmscore


def scores(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(2)
    return sorted(((r["doc_id"] is None, r["doc_id"], r["n_words"], r["log10_sum"], r["n_backoff"]) for r in lmscore.scored(df, **how).collect()), key=str)


def test_missing_and_repeated_ids(spark):
    texts = [(None, "a b c"), (None, "a b d"), (1, "a b c"), (1, "a b c"), (1, "e"), (2, None), (3, " !")]
    want = backoff(list(enumerate(t for _, t in texts)), order=3)
    got = scores(spark, [(i, t, "clash") for i, t in texts])
    assert [(i, n) for _, i, n, _, _ in got] == [(i, n) for _, i, n in sorted(((i is None, i, want[k][0]) for k, (i, _) in enumerate(texts)), key=str)]
    assert sorted(round(v, 9) for *_, v, _ in got) == sorted(round(v, 9) for _, v in want.values())


@pytest.mark.parametrize("seen", [1, 2, 3])
def test_orders_that_nothing_reaches(spark, seen):
    rng = random.Random(2)
    words = sentence(rng, 40).split()
    rows = [(k, " ".join(rng.sample(words, 25)), None) for k in range(6)] + [(10, sentence(rng, 30), None), (11, sentence(rng, 60_000), None)]
    for order in (3, 4):
        want = backoff([r[:2] for r in rows], seen=seen, order=order)
        for _, i, n, v, _ in scores(spark, rows, seen=seen, order=order):
            assert n == want[i][0] and v == pytest.approx(want[i][1], rel=1e-9)
    assert all(n == 2 for *_, n in scores(spark, [(1, "p q r", None)], seen=2))  # a second and a third word without a history
