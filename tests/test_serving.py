"""Pages, substring search, counters, medians and the scoring ledger: the same rows as plain forms, and what they read."""

from __future__ import annotations

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from verdigris.operators import curate as C
from verdigris.operators import evaluate as E
from verdigris.operators import serving as V


def read_files(df) -> set[str]:
    """The folders that the plan reads after its partition filters."""
    return set(re.findall(r"(?:block|part)=(\d+)", " ".join(df.inputFiles())))


def test_pages(spark, tmp_path):
    rows = [(i * 7 % 1000, f"r{i}") for i in range(1000)]
    V.write_pages(spark.createDataFrame(rows, "k int, name string").repartition(5), [F.col("k").desc(), "name"], f"{tmp_path}/p", block_rows=50)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    for offset, limit in ((0, 10), (120, 10), (495, 10), (990, 50), (5000, 3)):
        got = V.page(spark, f"{tmp_path}/p", offset, limit).orderBy("place")
        assert [(r.k, r.name, r.place, r.total) for r in got.collect()] == [(*r, offset + i, 1000) for i, r in enumerate(want[offset : offset + limit])]
    plan = V.page(spark, f"{tmp_path}/p", 120, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block", plan) and "Exchange rangepartitioning" not in plan
    first = V.page(spark, f"{tmp_path}/p", 0, 10).agg(F.max("place")).first()[0]
    assert [r.place for r in V.page_after(spark, f"{tmp_path}/p", first, 3).orderBy("place").collect()] == [10, 11, 12]
    V.write_pages(spark.createDataFrame([], "k int"), ["k"], f"{tmp_path}/none")
    assert V.page(spark, f"{tmp_path}/none", 0, 5).count() == 0


def test_search_reads_the_blocks_of_a_needle(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé日😀") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + (" Needle" if i == 77 else ""), rng.choice("xy"), None if i % 5 else "Note") for i in range(800)]
    df = spark.createDataFrame(rows, "id long, text string, kind string, note string")
    V.write_search(df, "id", ["text", "note"], f"{tmp_path}/s", blocks=32)
    hay = {r[0]: " ".join(x for x in (r[1], r[3]) if x is not None).lower() for r in rows}
    for needle in ("needle", "NEEDLE", words[0], words[1] + " " + words[2], "note", "b", "", "not there", "😀"):
        assert {r.id for r in V.search(spark, f"{tmp_path}/s", needle).collect()} == {i for i, t in hay.items() if needle.lower() in t}, needle
    assert {r.id for r in V.search(spark, f"{tmp_path}/s", words[0], kind="x").collect()} == {r[0] for r in rows if words[0] in hay[r[0]] and r[2] == "x"}
    found = V.search(spark, f"{tmp_path}/s", "needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block#\d+ (?:IN|=|INSET)", plan)
    got = found.select(F.input_file_name().alias("f")).distinct().count()
    assert got == 1 and V.search(spark, f"{tmp_path}/s", "not there")._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation <empty>")


def facets():
    return {"kind": F.col("kind"), "flag": F.when(F.col("flag"), "true")}


def plain_counts(rows):
    out = {}
    for _, kind, flag, x in rows:
        for key in [("kind", kind)] + [("flag", "true" if flag else None)] + [("sum", None)]:
            n, t = out.get(key, (0, 0.0))
            out[key] = (n + 1, t + (x or 0.0 if key[0] == "sum" else 0.0))
    return out


def test_counters_are_kept_up_to_date(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None, "only" if i == 3 else "a"]), rng.random() < 0.3, rng.choice([None, 1.5, 2.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, kind string, flag boolean, x double")
    path, counts = f"{tmp_path}/c", lambda d, sign=1: V.facet_counts(d, facets(), {"sum": F.col("x")}, sign)
    current = lambda p: {(r.facet, r.value): (r.n, r.total) for r in V.current_counts(spark, p).collect()}
    V.add_counts(counts(df.filter("id < 100")), path, "save0")
    V.add_counts(counts(df.filter("id >= 100")), path, "save1")
    V.add_counts(counts(df.filter("id >= 100")), path, "save1")  # tried again
    assert current(path) == plain_counts(rows)
    V.add_counts(counts(df.filter("id % 3 = 0"), -1), path, "exclude")
    left = [r for r in rows if r[0] % 3]
    assert current(path) == plain_counts(left)
    V.fold_counts(spark, path, f"{tmp_path}/folded")
    assert current(f"{tmp_path}/folded") == plain_counts(left)


def test_upper_medians(spark):
    rng = random.Random(4)
    groups = {"even": [rng.random() for _ in range(1000)], "odd": [rng.gauss(0, 1) for _ in range(777)], "one": [3.5], "two": [2.0, 1.0], "same": [0.25] * 500, "ties": [rng.choice([0.0, 1.0]) for _ in range(301)], None: [5.0, -1.0, 2.0], "odd ends": [float("-inf"), 1.0, float("inf")], "large": [rng.expovariate(1) for _ in range(60_000)], "none": []}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "m string, score double").repartition(7)
    got = {r.m: r.p50 for r in E.upper_medians(df, "score", "m").collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in groups.items() if v}
    assert E.upper_medians(df.filter("false"), "score", "m").count() == 0
    plan = E.upper_medians(df, "score", "m")._jdf.queryExecution().executedPlan().toString()
    assert "percentile_disc" not in plan and "collect_list" not in plan
    assert statistics.median_high(groups["even"]) == got["even"]


def prompts(spark, n=60):
    return spark.createDataFrame([(i, f"p{i}") for i in range(n)], "cid long, prompt string").repartition(3)


def answered(df):
    return {r.cid: r.output for r in df.collect()}


@pytest.mark.parametrize("how", ["texts", "pairs", "dicts", "shuffled", "short", "twice", "out of range"])
def test_answers_go_where_they_belong(spark, how):
    def scorer(batch):
        pairs = [(i, f"a {p}") for i, p in enumerate(batch)]
        if how == "texts":
            return [x for _, x in pairs]
        if how == "dicts":
            return [{"index": i, "output": x} for i, x in pairs]
        if how == "shuffled":
            return pairs[::-1]
        if how == "short":
            return pairs[: max(1, len(pairs) // 2)]
        if how == "twice":
            return pairs + [(i, "again") for i, _ in pairs]
        if how == "out of range":
            return [(-1, "x"), (len(pairs), "x"), ("0", "x"), (0, None), *pairs]
        return pairs

    got = E.scored_in_batches(prompts(spark), "cid", scorer, batch=7)
    assert answered(got) == {i: f"a p{i}" for i in range(60)}


def test_a_failing_prompt_costs_no_neighbour(spark):
    def scorer(batch):
        if any(p in ("p13", "p31") for p in batch):
            raise ValueError("can't score this")
        return [f"a {p}" for p in batch]

    rows = {r.cid: r for r in E.scored_in_batches(prompts(spark), "cid", scorer, batch=10).collect()}
    assert {i for i, r in rows.items() if r.output is None} == {13, 31}
    assert all(r.output == f"a p{i}" and r.error == "" for i, r in rows.items() if i not in (13, 31))
    assert rows[13].error == "ValueError: can't score this" and rows[13].tries == 3 and {r.tries for i, r in rows.items()} <= {1, 3}


def test_ledger(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def scorer(batch, broken=()):
        asked.add(len(batch))
        return [(i, f"a {p}") for i, p in enumerate(batch) if p not in broken]

    half = prompts(spark).filter("cid < 30")
    E.scored_with_ledger(half, "cid", lambda b: scorer(b, ("p7",)), f"{tmp_path}/l", slices=3)
    before = asked.value
    assert before == 30 + 2  # one was asked three times
    got = E.scored_with_ledger(prompts(spark), "cid", scorer, f"{tmp_path}/l", slices=3)
    assert answered(got) == {i: f"a p{i}" for i in range(60)} and asked.value == before + 31

    def lost(batch):
        raise SystemExit("the worker goes")

    with pytest.raises(Exception):
        E.scored_with_ledger(prompts(spark, 70), "cid", lost, f"{tmp_path}/l", slices=3)
    now = asked.value
    assert answered(E.scored_with_ledger(prompts(spark, 70), "cid", scorer, f"{tmp_path}/l", slices=3)) == {i: f"a p{i}" for i in range(70)}
    assert asked.value == now + 10


def test_hot_group_of_near_texts_is_compared_in_linear_time(spark, monkeypatch):
    counts = []
    real = C._near
    monkeypatch.setattr(C, "_near", lambda pairs, t: counts.append(pairs.count()) or real(pairs, t))
    rng = random.Random(6)
    base = "please explain in detail how the quarterly report of the northern branch was put together this spring ok"[:100]

    def record(i):
        q = list(base)
        for _ in range(3):
            q[rng.randrange(100)] = rng.choice("xyz")
        return (i, "c", 1, (2, "".join(q)), float(rng.randint(1, 5)))

    for n in (1000, 3000):
        counts.clear()
        rows = [record(i) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, cid string, dislike_turn_id int, source_query struct<turn_index:int,message:string>, judge_average double")
        got = dict(map(tuple, C.near_duplicates(df, "id").collect()))
        best = max(rows, key=lambda r: (r[4], -r[0]))
        assert len(got) >= n * 0.99 and got[next(r[0] for r in rows if r[0] != best[0])] is not None
        assert sum(counts) <= 6 * n


def test_grams_leave_a_task_once(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    texts = [(0, "banana 😀bandana"), (1, "anana"), (0, "banana"), (1, ""), (0, None), (2, "ab"), (3, "\U0010ffffzz\x00z")] * 3
    want = {(b, t[i : i + 3]) for b, t in texts if t for i in range(len(t) - 2)}
    batches = [pa.table({"block": pa.array([b], pa.int32()), "_hay": pa.array([t], pa.string())}).to_batches()[0] for b, t in texts]
    for held in (2, 5, V.HELD):
        monkeypatch.setattr(V, "HELD", held)
        got = [x for batch in V._grams(iter(batches)) for x in zip(batch.column("block").to_pylist(), batch.column("gram").to_pylist())]
        assert len(got) == len(set(got)) and set(got) == want
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "id long, text string")
    V.write_search(df, "id", ["text"], f"{tmp_path}/s", blocks=4)
    for needle in ("nan", "😀ban", "\U0010ffffzz", "ab", "zzz"):
        assert {r["id"] for r in V.search(spark, f"{tmp_path}/s", needle).collect()} == {i for i, (_, t) in enumerate(texts) if t and needle in t}
