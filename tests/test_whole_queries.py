"""Near duplicates by whole queries, against all pairs of a group."""

from __future__ import annotations

import difflib
import random

from pyspark.sql import functions as F

from verdigris.operators import curate as C
from verdigris.plans import curation, registry
from verdigris.sources import fixtures as X

START = "".join(random.Random(4).choice("abcdefgh ") for _ in range(120))


def whole(rows, threshold=0.90):
    """rows: id, key, query, score."""
    first, known, out = {}, {}, {}
    for i, k, q, _ in rows:
        first[k, q] = min(first.get((k, q), i), i)

    def near(k, x, y):
        x, y = sorted((x, y), key=lambda t: (first[k, t], t))
        if (x, y) not in known:
            m = difflib.SequenceMatcher(None, x, y)
            known[x, y] = m.real_quick_ratio() > threshold and m.ratio() > threshold
        return x == y or known[x, y]

    for i, k, q, j in rows:
        better = [(-j2, i2) for i2, k2, q2, j2 in rows if k2 == k and (-j2, i2) < (-j, i) and near(k, q, q2)]
        if better:
            out[i] = min(better)[1]
    return out


def copies(r, n, least, most):
    """Texts of so many characters, and copies with changes at their end, at their beginning and anywhere."""
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 9))) for _ in range(60)] + ["quiz", "Jazz", "größe", "😀", "vex", "kazoo"]
    bases = [" ".join(r.choice(words) for _ in range(400))[: r.randrange(least, most)] for _ in range(n // 4)]
    for _ in range(n):
        q = list(r.choice(bases))
        for _ in range(r.choice((0, 1, 1, 3, len(q) // 40, len(q) // 12))):
            at = r.choice((r.randrange(len(q)), max(0, len(q) - 1 - r.randrange(20)), r.randrange(min(20, len(q)))))
            q[at : at + r.choice((0, 1, 5))] = r.choice(("", "x", "zq", "and more"))
        yield "".join(q + list(r.choice(("", "", "?", " " + r.choice(words) * 12))))


def records(spark, rows):
    return spark.createDataFrame([(i, k, 1, (1, q), j) for i, k, q, j in rows], "id long, cid string, dislike_turn_id int, source_query struct<turn_index:int,message:string>, judge_average double")


def test_whole_texts_against_all_pairs(spark):
    r = random.Random(11)
    rows = [(i, r.choice("abc"), q, r.choice((1.0, 3.5, 4.0))) for i, q in enumerate([*copies(r, 160, 90, 260), *copies(r, 120, 150, 1500)])]
    rows += [(1000 + i, f"few{i % 9}", q, 1.0 * (i % 2)) for i, q in enumerate([*copies(r, 30, 20, 900)])]
    want = whole(rows)
    assert len(want) > 40 and want != whole([(i, k, q[:100], j) for i, k, q, j in rows])
    assert dict(map(tuple, C.near_duplicates(records(spark, rows).repartition(3), "id", compared=None).collect())) == want


def test_tiles_of_lengths(spark):
    """Whatever tiles texts of different or the same lengths lie in."""
    r = random.Random(12)
    rows = [(i, "a", q, r.choice((1.0, 2.0, 3.0))) for i, q in enumerate(dict.fromkeys([*copies(r, 150, 60, 700), *(q.ljust(150, ".")[:150] for q in copies(r, 100, 140, 160))]))]
    k = records(spark, rows).select(F.col("cid").alias("g"), F.col("source_query.message").alias("q"), F.col("id").alias("first"), F.struct((-F.col("judge_average")).alias("j"), F.col("id").alias("of")).alias("w"))
    for threshold, tile in ((0.90, 12), (0.90, 60), (0.90, 10_000), (0.7, 25)):
        want = {rows[i][2]: o for i, o in whole(rows, threshold).items()}
        assert {x["q"]: x["best"]["of"] for x in C.nearest_better(k, threshold, tile).collect()} == want and len(want) > 30, (threshold, tile)


def tails(n):
    """Texts that start alike, and go on differently but for each fourth, which is the one before it with a character more."""
    r = random.Random(3)
    out = [START + "".join(r.choice("ijklmnop ") for _ in range(150)) for _ in range(n)]
    return [out[i - 1] + "!" if i % 4 == 3 else q for i, q in enumerate(out)]


def test_groups_by_whole_texts(spark, tmp_path):
    """F2"""
    texts = tails(24)
    spark.createDataFrame([(17 * i + 1, q, "en", "s", len(q)) for i, q in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(18, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    saved = X.saved(spark, str(tmp_path)).select("doc_id", F.lit("s"), "source_query.message", "judge_average").collect()
    got = dict(map(tuple, registry.QUERIES["j11_near_duplicate_groups"](spark, str(tmp_path)).collect()))
    assert got == whole([tuple(x) for x in saved]) and len(got) == 6


def test_retried_records_by_whole_texts(spark, sf_dir, monkeypatch):
    """what the query compares, here records of one dialogue that start alike."""
    rows = [(i, "a", q, float(i % 3)) for i, q in enumerate(tails(16))]
    monkeypatch.setattr(curation, "_retried", lambda spark, d: records(spark, rows).withColumnRenamed("id", "doc_id"))
    assert dict(map(tuple, registry.QUERIES["j11_near_duplicates"](spark, sf_dir).collect())) == whole(rows)
    monkeypatch.undo()
    got = dict(map(tuple, registry.QUERIES["j11_near_duplicates"](spark, sf_dir).collect()))
    seen = curation._retried(spark, sf_dir).select("doc_id", "cid", "source_query.message", "judge_average").filter("message <> ''").collect()
    assert got == whole([tuple(x) for x in seen])


def test_enhanced_by_whole_texts(spark, sf_dir, monkeypatch):
    """saved records as those of one dialogue, whose queries start alike and go on differently."""
    real = X.saved

    def of_one(spark, d, **histories):
        query = F.struct(F.lit(1).alias("turn_index"), F.concat(F.lit(START), "source_query.message").alias("message"))
        return real(spark, d, **histories).filter("doc_id < 40").withColumns({"cid": F.lit("a"), "dislike_turn_id": F.lit(1), "source_query": query})

    monkeypatch.setattr(X, "saved", of_one)
    seen = of_one(spark, sf_dir).select("doc_id", "cid", "source_query.message", "judge_average").collect()
    got = registry.QUERIES["o8_enhanced"](spark, sf_dir).collect()
    assert sum(x["n"] for x in got) == len(seen) > 30
    assert sum(x["n"] for x in got if x["duplicate"]) == len(whole([tuple(x) for x in seen])) < len(seen) - 1


def test_blocks_are_those_of_difflib():
    r = random.Random(13)
    texts = [*copies(r, 40, 20, 220), *copies(r, 40, 190, 900), "a" * 250, "ab" * 120, "x" + "ab" * 120]
    for _ in range(600):
        x, y = r.choice(texts), r.choice(texts)
        m, b, ends = difflib.SequenceMatcher(None, x, y), C._Blocks(x, y), (r.randrange(len(x) + 1), r.randrange(len(x) + 1), r.randrange(len(y) + 1), r.randrange(len(y) + 1))
        for part in ((0, len(x), 0, len(y)), (*sorted(ends[:2]), *sorted(ends[2:]))):
            assert b.longest(*part) == tuple(m.find_longest_match(*part))
        for threshold in (0.5, 0.9):
            assert C._is_near(x, y, threshold) == (m.ratio() > threshold), (x, y)
