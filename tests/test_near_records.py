"""Near duplicates of large groups against all pairs, and ranks against plain sorting."""

from __future__ import annotations

import difflib
import random
from collections import Counter

from pyspark.sql import functions as F

from verdigris.operators import curate as C
from verdigris.operators import sampling as K
from verdigris.plans import registry
from verdigris.sources import fixtures as X


def plain(rows, threshold=0.90):
    """rows: id, key, query, score. Equal texts and texts compared in the order of their first ids, all pairs of a group."""
    rows = [(i, k, q[:100], j or 0.0) for i, k, q, j in rows if i is not None and q]
    first = {}
    for i, k, q, _ in rows:
        first[k, q] = min(first.get((k, q), i), i)
    out, known = {}, {}

    def near(k, x, y):
        if x == y:
            return True
        x, y = sorted((x, y), key=lambda t: (first[k, t], t))
        if (x, y) not in known:
            m = difflib.SequenceMatcher(None, x, y)
            known[x, y] = m.real_quick_ratio() > threshold and m.quick_ratio() > threshold and m.ratio() > threshold
        return known[x, y]

    for i, k, q, j in rows:
        better = [(-j2, i2) for i2, k2, q2, j2 in rows if k2 == k and (-j2, i2) < (-j, i) and i2 != i and near(k, q, q2)]
        if better:
            out[i] = min(better)[1]
    return out


def records(spark, rows):
    data = [(i, k[0], k[1], (k[2], q), j) for i, k, q, j in rows]
    return spark.createDataFrame(data, "id long, cid string, dislike_turn_id int, source_query struct<turn_index:int,message:string>, judge_average double")


def test_groups_against_all_pairs(spark):
    r = random.Random(5)
    bases = ["".join(r.choice("abcdefg hij") for _ in range(n)) for n in (1, 4, 10, 11, 12, 20, 21, 40, 77, 99, 100, 130) for _ in range(3)] + ["aaaaaaaaaaaaaaaaaaaaaaaa", "please " * 12, "😀" * 15]
    rows = []
    for i in range(500):
        q = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 2, 4, 9))):
            at = r.randrange(len(q) + 1)
            q[at : at + r.choice((0, 1))] = r.choice(("", "x", "a"))
        rows.append((i, r.choice((("c", 1, 2), (None, None, None), ("c", None, 2))), "".join(q), r.choice((None, 1.0, 3.5, 4.0))))
    rows += [(None, ("c", 1, 2), bases[-1], 5.0), (600, ("c", 1, 2), None, 5.0), (601, ("c", 1, 2), "", 5.0)]
    want = plain(rows)
    assert len(want) > 100
    assert dict(map(tuple, C.near_duplicates(records(spark, rows).repartition(5), "id").collect())) == want
    assert C.near_duplicates(records(spark, []), "id").count() == 0


def test_lower_thresholds(spark):
    r = random.Random(8)
    rows = [(i, ("c", 1, 1), "".join(r.choice("abc") for _ in range(r.randrange(1, 14))), 1.0 * (i % 3)) for i in range(120)]
    for threshold in (0.6, 0.8, 0.95):
        assert dict(map(tuple, C.near_duplicates(records(spark, rows), "id", threshold).collect())) == plain(rows, threshold), threshold


def test_registered_groups(spark, sf_dir):
    saved = X.saved(spark, sf_dir).select("doc_id", "failure_dimension", "source_query.message", "judge_average").collect()
    got = dict(map(tuple, registry.QUERIES["j11_near_duplicate_groups"](spark, sf_dir).collect()))
    assert got == plain([tuple(x) for x in saved]) and got


def test_ranks(spark):
    r = random.Random(2)
    rows = [(i, r.choice(("a", "a", "a", "b", None)), r.choice((None, 1.0, 2.0))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, kind string, score double").repartition(7)
    got = {x["id"]: x["rank"] for x in K.ranked(df, "kind", [F.coalesce("score", F.lit(0.0)).desc(), F.col("id")], "rank").collect()}
    seen, want = Counter(), {}
    for i, kind, _ in sorted(rows, key=lambda x: (-(x[2] or 0), x[0])):
        seen[kind] += 1
        want[i] = seen[kind]
    assert got == want


def test_large_groups_by_tiles(spark, monkeypatch):
    """Texts with a long start in common, whose grams bring all pairs together: none becomes a row, whatever tiles they lie in."""
    r = random.Random(9)
    start = "".join(r.choice("abcdefgh ") for _ in range(76))
    rows = [(i, ("c", 1, 1), start[: r.choice((40, 76))] + "".join(r.choice("abcdefgh ") for _ in range(24)), float(r.randrange(4))) for i in range(300)]
    rows += [(300 + i, k, q[:50] + "x" + q[50:99], j and j + r.choice((-0.5, 0.5))) for i, (_, k, q, j) in enumerate(rows[:80])]
    texts = records(spark, rows).select("cid", F.col("source_query.message").alias("q"), "id", "judge_average")
    k = texts.groupBy(F.col("cid").alias("g"), "q").agg(F.min("id").alias("first"), F.min(F.struct((-F.col("judge_average")).alias("j"), F.col("id").alias("of"))).alias("w"))
    want = {q: rows[o][2] for i, o in plain(rows).items() if (q := rows[i][2]) != rows[o][2]}
    for tile in (7, 90, 1000):
        got = {x["q"]: rows[x["best"]["of"]][2] for x in C.nearest_better(k, 0.90, tile).collect()}
        assert got == want and len(got) > 70, tile


def test_small_groups_leave_nothing_to_tiles(spark, monkeypatch):
    seen = []
    real = C.nearest_better
    monkeypatch.setattr(C, "nearest_better", lambda texts, t: seen.append(texts.count()) or real(texts, t))
    rows = [(10 * g + i, (f"c{g}", 1, 1), "a question that was asked before"[: 20 + i], float(i)) for g in range(12) for i in range(1 + g % 6)]
    assert dict(map(tuple, C.near_duplicates(records(spark, rows), "id").collect())) == plain(rows)
    assert seen == [12]  # the two groups of six


def test_enhanced_joins_texts_once(spark, sf_dir):
    """What follows the join of texts and histories reads a narrow table, not the texts again."""
    files = registry.QUERIES["o8_enhanced"](spark, sf_dir).inputFiles()
    assert files and not any("documents.parquet" in f or "conversations.parquet" in f for f in files)
