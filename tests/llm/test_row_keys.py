"""Byte repeats where ids repeat or are missing, and at the edges of blocks."""

from __future__ import annotations

import random
from collections import Counter

from brute import repeats
from conftest import sentence

from verdigris.llm import repeats as rep


def test_rows_are_told_apart_by_their_texts(spark):
    rng = random.Random(4)
    passage, other = sentence(rng, 90), sentence(rng, 80)
    texts = [f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}" for _ in range(4)] + ["x", f"{other} {sentence(rng, 9)}", f"{sentence(rng, 9)} {other}", "x"]
    rows = list(zip((1, 2, 1, None, 1, None, 7, 1), texts)) + [(9, texts[0])]
    want = Counter(repeats(list(enumerate(t for _, t in rows)))[k] + (i,) for k, (i, _) in enumerate(rows))
    out = rep.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["doc_id"]) for r in out) == want


def test_very_long_texts(spark):
    """A shared passage across the edge of a block, and one at the end."""
    rng, edge = random.Random(6), 1 << 19
    passage = "".join(rng.choice("abcdef") for _ in range(3000))
    filler = lambda n: "".join(rng.choice("ghijkl") for _ in range(n))
    docs = [(1, filler(edge - 1000) + passage + filler(500)), (2, filler(50) + passage), (3, filler(2 * edge))]
    out = {r["doc_id"]: r for r in rep.removed(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [out[i]["n_removed"] for i in (1, 2, 3)] == [3000, 3000, 0] and out[2]["n_spans"] == 1


def test_passages_of_more_than_fifty_words(spark):
    rng = random.Random(7)
    short = [sentence(rng, 51) for _ in range(20)]
    rows = [(2 * k + j, f"{sentence(rng, rng.randint(0, 60))} {p} {sentence(rng, rng.randint(0, 60))}") for k, p in enumerate(short) for j in (0, 1)]
    rows += [(100 + k, sentence(rng, 120)) for k in range(20)] + [(200, None), (201, ""), (None, short[0])]
    source = rep.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"] for r in rep.passages(source.select("doc_id", "row", "text")).collect()}
    assert got == {*range(40), rep.NO_ID}
