"""Streams: keyed state instead of the sinks, restarts in the middle of a batch, late and repeated records, state that is evicted."""

from __future__ import annotations

import json
import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verdigris.operators import turns as O
from verdigris.streaming import jobs as S

T0 = datetime(2024, 1, 1)


def dialogue(cid: str, n: int = 3, unliked: bool = True) -> str:
    history = [{"turn_index": i, "role": ["user", "assistant"][i % 2], "message": f"message {i} of {cid}", "create_time": "2024-01-01 00:00:00", "length": 20, "is_unliked": int(unliked and i == 1)} for i in range(n)]
    return json.dumps({"cid": cid, "history": history if len(cid) % 2 else json.dumps(history)})


def arrive(folder, name: str, cids: list[str]) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write("\n".join(dialogue(c, unliked=not c.endswith("x")) for c in cids))


def curate(spark, base, seen=None):
    q = S.curate(S.dialogue_stream(spark, f"{base}/in", 1), f"{base}/out", f"{base}/check", seen=seen)
    q.awaitTermination()
    return q


def result(spark, base):
    return sorted((r.cid, r.reason, r.route) for r in S.curated(spark, f"{base}/out").collect())


def want(cids):
    return sorted((c, "no_unliked_turns" if c.endswith("x") else "pass", "deleted" if c.endswith("x") else "kept") for c in cids)


def test_a_batch_reads_its_own_files_and_no_result(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    arrive(f"{tmp_path}/in", "1", [f"c{i}" for i in range(300)] + ["c1", "c2", "ax"])
    curate(spark, tmp_path)
    first = result(spark, tmp_path)
    assert first == want([f"c{i}" for i in range(300)] + ["ax"])
    shutil.move(f"{tmp_path}/out", f"{tmp_path}/elsewhere")  # what was written can't be read any more
    arrive(f"{tmp_path}/in", "2", ["c7", "new", "c8", "new", "ax", "bx"])
    q = curate(spark, tmp_path)
    assert result(spark, tmp_path) == want(["new", "bx"])
    done = [p for p in q.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in done] == [6]
    assert done[0]["stateOperators"][0]["numRowsUpdated"] == 2 and done[0]["stateOperators"][0]["numRowsTotal"] == 303
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_a_batch_that_fails_runs_again(spark, tmp_path, monkeypatch):
    cids = [f"c{i}" for i in range(40)]
    arrive(f"{tmp_path}/in", "1", cids[:20])
    arrive(f"{tmp_path}/in", "2", cids[15:])
    real, calls = O.prefilter, []

    def fails(*a, **b):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost in the second batch")
        return real(*a, **b)

    monkeypatch.setattr(O, "prefilter", fails)
    with pytest.raises(Exception, match="lost in the second batch"):
        curate(spark, tmp_path)
    curate(spark, tmp_path)
    assert result(spark, tmp_path) == want(cids)


def test_a_batch_that_was_written_but_not_committed_replaces_itself(spark, tmp_path):
    cids = [f"c{i}" for i in range(30)]
    arrive(f"{tmp_path}/in", "1", cids[:20])
    curate(spark, tmp_path)
    arrive(f"{tmp_path}/in", "2", cids[10:])
    curate(spark, tmp_path)
    last = max(int(f) for f in os.listdir(f"{tmp_path}/check/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{tmp_path}/check/commits/{f}"):
            os.remove(f"{tmp_path}/check/commits/{f}")
    curate(spark, tmp_path)
    assert result(spark, tmp_path) == want(cids)


def test_dialogues_that_were_processed_elsewhere(spark, tmp_path):
    spark.createDataFrame([("c1",), ("c2",), ("gone",)], "cid string").write.parquet(f"{tmp_path}/seen")
    arrive(f"{tmp_path}/in", "1", ["c1", "c3", "c3"])
    curate(spark, tmp_path, f"{tmp_path}/seen")
    shutil.move(f"{tmp_path}/seen/_SUCCESS", f"{tmp_path}/mark")
    arrive(f"{tmp_path}/in", "2", ["c2", "c3", "c4", "gone"])
    curate(spark, tmp_path, f"{tmp_path}/seen")
    assert result(spark, tmp_path) == want(["c3", "c4"])


def stream_of(spark, base, schema: str, batches: list[list[tuple]]):
    """A stream with a batch for each list."""
    for k, rows in enumerate(batches):
        if not os.path.exists(f"{base}/source/{k}"):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/source/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/source")


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def test_running_counters(spark, tmp_path):
    # rows are late by the watermark of the batch before, and by the end of their window
    batches = [
        [(at(m), "abc"[m % 3]) for m in range(60)],
        [(at(60), "a")],
        [(at(55), "b"), (at(49.5), "b"), (at(44), "late"), (at(90), "c")],
        [(at(m), "a") for m in range(90, 300)],
        [(at(301), "a"), (at(81), "b")],
        [(at(70), "late"), (at(310), "a"), (at(20), "late")],
    ]
    kept = [r for b in batches for r in b if r[1] != "late"]
    schema = "ts timestamp, route string"

    def run(n):
        q = S.count_on(stream_of(spark, tmp_path, schema, batches[:n]), f"{tmp_path}/out", f"{tmp_path}/check", "ts", "route")
        q.awaitTermination()
        return q

    run(3)
    q = run(6)  # goes on where it stopped
    got = {(r.start, r.route): r.n for r in S.counted(spark, f"{tmp_path}/out", "route").collect()}
    twin = {(r.start, r.route): r.n for r in S.counters(spark.createDataFrame(kept, schema), "ts", "route").collect()}
    assert got == twin
    state = [p["stateOperators"][0] for p in q.recentProgress]
    assert sum(p["numRowsDroppedByWatermark"] for p in state) == 2
    assert state[-1]["numRowsTotal"] <= 4 < len(twin)  # closed windows have left


def turn(cid, pos, minutes, role=None, message=None, unliked=False):
    text = message if message is not None else f"text {pos} of dialogue {cid}"
    return (cid, pos, pos, role or ["user", "assistant"][pos % 2], text, at(minutes), unliked, len(text))


TURN = "cid string, pos int, turn_index int, role string, message string, create_time timestamp, is_unliked boolean, length int"


def plain(rows):
    return sorted((json.dumps(r.asDict(True), default=str, sort_keys=True) for r in rows))


def test_closed_dialogues_are_enriched_as_in_a_batch(spark, tmp_path):
    a = [turn("a", 0, 0, message="how do I cook rice well"), turn("a", 1, 1, unliked=True), turn("a", 2, 2, message="how do I cook rice well?"), turn("a", 3, 3), turn("a", 4, 4, message="算了"), turn("a", 5, 5)]
    b = [turn("b", 0, 2), turn("b", 1, 3, message="..."), turn("b", 2, 4, message="不对，你说错了"), turn("b", 3, 6)]
    c = [turn("c", 0, 50), turn("c", 1, 51), turn("c", 2, 52)]
    again = [turn("a", 6, 120), turn("a", 7, 121)]  # opened again after the pause
    still = [turn("d", 0, 300), turn("d", 1, 301)]
    batches = [
        [a[0], a[1], b[0], a[3], b[1]],
        [a[2], b[2], a[4], a[5], b[3]],  # in any order within the watermark
        [*c[:2], turn("e", 0, 60)],
        [turn("e", 1, 61)],
        [c[2], turn("b", 4, 7, message="far too late"), *again],
        still,
    ]
    q = S.enrich_closed(stream_of(spark, tmp_path, TURN, batches), f"{tmp_path}/out", f"{tmp_path}/check", similarity="exact")
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").drop("batch", "end")
    sessions = {"a": a, "b": b, "c": c, "e": [batches[2][2], batches[3][0]], "a2": again}
    for name, rows in sessions.items():
        twin = O.enriched(spark.createDataFrame(rows, TURN), similarity="exact")
        got = out.filter((F.col("cid") == name[0]) & (F.col("start") == F.lit(min(r[5] for r in rows)))).drop("start")
        assert plain(got.select(*sorted(got.columns)).collect()) == plain(twin.select(*sorted(got.columns)).collect()), name
    assert out.count() == len(sessions)  # d is open
    state = [p["stateOperators"][0] for p in q.recentProgress]
    assert sum(p["numRowsDroppedByWatermark"] for p in state) == 1
    assert state[-1]["numRowsTotal"] == 1  # d alone


def test_once_within_the_watermark(spark, tmp_path):
    schema = "cid string, ts timestamp, part int"
    batches = [
        [(f"c{i}", at(i), 1) for i in range(100)] + [("c99", at(99), 1)],
        [(f"c{i}", at(i), 2) for i in range(100)] + [(f"d{i}", at(150 + i), 2) for i in range(50)],  # all again: dropped as repeated or as late
        [("c99", at(145), 3), ("d49", at(190), 3), ("d0", at(100), 3), ("e", at(400), 3)],  # all but e are known
        [("f", at(401), 4)],
        [("e", at(390), 5), ("late", at(300), 5), ("c99", at(410), 5)],  # c99 has left the state: it counts anew
    ]
    stream = stream_of(spark, tmp_path, schema, batches)
    q = S.write_once(stream, f"{tmp_path}/out", f"{tmp_path}/check", "ts", "1 hour")
    q.awaitTermination()
    got = sorted(r.cid for r in spark.read.schema("cid string").parquet(f"{tmp_path}/out").collect())
    assert got == sorted([f"c{i}" for i in range(100)] + [f"d{i}" for i in range(50)] + ["c99", "e", "f"])
    state = [p["stateOperators"][0] for p in q.recentProgress]
    assert state[-1]["numRowsTotal"] == 3 and max(p["numRowsTotal"] for p in state) <= 150
    # a new run keeps what is known
    spark.createDataFrame([("f", at(402), 6), ("g", at(403), 6)], schema).coalesce(1).write.parquet(f"{tmp_path}/source/5")
    S.write_once(stream_of(spark, tmp_path, schema, batches), f"{tmp_path}/out", f"{tmp_path}/check", "ts", "1 hour").awaitTermination()
    assert sorted(r.cid for r in spark.read.schema("cid string").parquet(f"{tmp_path}/out").collect()) == sorted([*got, "g"])


def test_enrichment_reads_signals_and_reactions_once(spark, sf_dir, monkeypatch):
    from verdigris.sources import fixtures as X

    kept = []
    real = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, what: kept.append(what) or real(df, what))
    t = X.turns(spark, sf_dir).filter("create_time is not null")
    closed = t.groupBy("cid").agg(F.min("create_time").alias("start"), F.max("create_time").alias("end"), F.array_sort(F.collect_list(F.struct("pos", "turn_index", "role", "message", "create_time", "length", "is_unliked"))).alias("history"))
    got = S.enriched_sessions(closed, similarity="jaccard")
    assert kept == ["signals", "reactions"]
    assert sorted(r["cid"] for r in got.collect()) == sorted(r["cid"] for r in closed.select("cid").collect())
