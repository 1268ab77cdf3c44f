"""Repetitive texts, long runs, splits that change, languages without ids: what must not fall over or lose rows."""

from __future__ import annotations

import random
import time
import warnings

import numpy as np
import pytest
from brute import contamination
from pyspark.sql import functions as F

from verdigris.llm import decontaminate as D
from verdigris.llm import jaccard, langid, packing


def longest_of(text: str, items, window=13):
    """(words, item, word of the item, word of the text) of the longest match, word by word; items as they come."""
    words = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    d, best = words(text), None
    begin = 0
    for name, t in items:
        w = words(t)
        size = min(len(w), window)
        for a in range(len(w) - size + 1 if w else 0):
            for p in range(len(d) - size + 1):
                n = 0
                while a + n < len(w) and p + n < len(d) and w[a + n] == d[p + n]:
                    n += 1
                if n >= size:
                    key = (-n, p, begin + a)
                    if best is None or key < best[0]:
                        best = (key, (n, str(name), a, p))
        begin += len(w) + 1
    return best[1] if best else (0, None, None, None)


def test_contamination_of_repetitive_texts(spark):
    rng = random.Random(8)
    items = [(1, "na " * 30), (2, "ab ba " * 20), (3, " ".join(rng.choice("abc") for _ in range(60))), (4, "na na"), (5, "na " * 25 + "end"), (6, "na " * 30)]
    texts = ["na " * 50, "x " + "na " * 25 + "end y", "ba ab " * 30, " ".join(rng.choice("abc") for _ in range(300)), items[2][1] + " " + items[2][1], "na", None, "ab " * 40, "na " * 12 + "x " + "na " * 13]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in D.contamination(docs, bench).collect()}
    want = contamination(list(enumerate(texts)), items)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[i]
        assert (r.longest, r.longest_item, r.item_word, r.doc_word) == longest_of(t, items), t


def test_a_repeated_word_is_searched_in_linear_time():
    tests, s = D.Tests([("1", "na " * 2000)], 13), D.shard([b"na " * 40_000])
    tests.order, D.wd._power("up", 50_000), D.wd._power("down", 50_000)
    began = time.process_time()
    test, place = tests.search(s)
    assert len(test) == 40_000 - 12
    assert D._covered(test, place, s, tests).sum() == 40_000 and tests.found(s, test, place) == [{"1"}]
    assert tests.report(s, test, place) == {0: (2000, "1", 0, 0)}
    assert time.process_time() - began < 5


@pytest.mark.parametrize("run", [" ", "a", "7", "!", "\n", "é"])
def test_ids_of_long_runs(run):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoding(packing.vocabulary(), packing.added_tokens())
    for text in ("x" + run * (2_000_000 if run in " a" else 300_000) + "y", run * 1_000_001 if run == " " else run * 5):
        assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids


def test_links_do_not_depend_on_splits(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pick = lambda df: sorted(tuple(r) for r in df.select("doc_id", "component_id").collect())
    want = pick(jaccard.joined(docs, 5, 80))
    real, passes = jaccard.keyed, []

    def other_cores(*a, **b):  # between the passes the number of cores that plans see is another
        passes.append(spark.conf.get("spark.sql.files.minPartitionNum"))
        return real(*a, **b)

    monkeypatch.setattr(jaccard, "keyed", other_cores)
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    assert pick(jaccard.joined(docs.repartition(5), 5, 80)) == want  # written to a table first
    assert pick(jaccard.joined(docs.filter("doc_id >= 0"), 5, 80)) == want
    assert len(set(passes)) == 1 and len(passes) == 4 and passes[0]
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) == before
    with jaccard.same_splits(docs.select("doc_id", "text").filter("text is not null")) as steady:
        assert "given-" not in str(steady.inputFiles())
    with jaccard.same_splits(docs.orderBy("text")) as steady:
        assert "given-" in str(steady.inputFiles())


def test_no_language_is_lost(spark):
    rng = np.random.default_rng(2)
    words = {"en": "the of and to in that is was".split(), "fr": "le de et les des une dans".split(), "de": "der die und nicht mit ein ist".split(), "es": "el los que una por con para".split()}
    rows = [(None, " ".join(rng.choice(w, 30)), k) for k, w in words.items() for _ in range(120 if k == "de" else 60)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    with warnings.catch_warnings():
        model = langid.fit(labelled, sample=50)
    assert sorted(model.languages) == sorted(words)
    assert labelled.filter(F.col("doc_id").isNotNull()).isEmpty() and langid.fit(labelled.filter("lang is null")) is None
