"""Queries on files and streams. Inputs are written from the given tables first, to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.plans.registry import query
from verdigris.plans.turn_queries import A1_SQL, F1_SQL, LEXICON, W7_SQL, rollup
from verdigris.sources import dialogues as D
from verdigris.sources import fixtures as X
from verdigris.sources.shared import fresh, materialize
from verdigris.streaming import jobs as S


def dialogue_lines(spark, d, broken: bool = False) -> DataFrame:
    """Dialogues as JSON lines: histories of even ids are strings, others lists; with broken, some lines are cut, some blank."""
    t = X.turns(spark, d).withColumns({"create_time": F.date_format("create_time", "yyyy-MM-dd HH:mm:ss"), "is_unliked": F.col("is_unliked").cast("int")})
    g = X.dialogues(t).withColumn("n", F.substring("cid", 2, 20).cast("long"))
    as_list, as_text = F.to_json(F.struct("cid", "history")), F.to_json(F.struct("cid", F.to_json("history").alias("history")))
    line = F.when(F.col("n") % 2 == 0, as_text).otherwise(as_list)
    if broken:
        line = F.when(F.col("n") % 10 == 3, F.substring(line, 1, 25)).when(F.col("n") % 10 == 4, "  ").otherwise(line)
    return g.select(line.alias("value"))


def _written(spark, d, broken: bool = False) -> str:
    path = fresh(spark, "dialogues")
    dialogue_lines(spark, d, broken).write.text(path)
    return path


@query("s1_scan_dialogues", "SELECT cid, count(*) AS n_turns, sum(length) AS n_chars FROM turns GROUP BY cid")
def s1(spark, d):
    t = S.turns_of(D.dialogues(spark, _written(spark, d)))
    return t.groupBy("cid").agg(F.count("*").alias("n_turns"), F.sum("length").alias("n_chars"))


@query("s2_tolerant_scan", "SELECT DISTINCT cid FROM turns WHERE conv_id % 10 NOT IN (3, 4)")
def s2(spark, d):
    return D.tolerant(spark, _written(spark, d, broken=True)).select("cid").filter("cid is not null")


@query("s3_parse_errors", "SELECT count(*) FILTER (conv_id % 10 <> 3) AS n_loaded, count(*) FILTER (conv_id % 10 = 3) AS n_errors FROM (SELECT DISTINCT conv_id FROM turns WHERE conv_id % 10 <> 4)")
def s3(spark, d):
    return D.accounted(spark, _written(spark, d, broken=True))


@query("s4_line_count", "SELECT count(DISTINCT conv_id) AS n FROM turns WHERE conv_id % 10 <> 4")
def s4(spark, d):
    return D.count_lines(spark, _written(spark, d, broken=True))


@query("s6_polymorphic_histories", "SELECT conv_id % 3 AS kind, count(*) AS n, sum(CASE WHEN conv_id % 3 = 2 THEN 0 ELSE k END)::BIGINT AS n_turns FROM (SELECT conv_id, count(*) AS k FROM turns GROUP BY 1) GROUP BY 1")
def s6(spark, d):
    n = F.substring("cid", 2, 20).cast("long")
    entry = lambda m: F.concat(F.lit("{'role': '"), m["role"], F.lit("', 'content': None, 'ok': True, 'message': '"), m["turn_index"], F.lit("'}"))
    literal = F.concat(F.lit("["), F.array_join(F.transform("history", entry), ", "), F.lit("]"))
    plain = F.to_json(F.transform("history", lambda m: F.struct(m["role"].alias("role"), m["message"].alias("message"))))
    rows = X.dialogues(X.turns(spark, d)).select((n % 3).alias("kind"), F.when(n % 3 == 0, plain).when(n % 3 == 1, literal).otherwise("not a history").alias("history"))
    return D.parsed_histories(rows, "history").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("history")).alias("n_turns"))


@query("s8_response_discovery", "SELECT model, count(*) AS n FROM responses WHERE model <> 'r1' GROUP BY model")
def s8(spark, d):
    folder = fresh(spark, "responses")
    r = X.responses(spark, d)
    for k in range(3):  # a folder for each model, as models deliver them
        r.filter(F.col("model") == f"r{k}").drop("model").write.json(f"{folder}/r{k}.jsonl")
    return D.responses_by_model(spark, folder, ["r1"]).groupBy("model").agg(F.count("*").alias("n"))


@query("s10_append_sink", "SELECT DISTINCT cid, conv_id % 2 AS part FROM turns")
def s10(spark, d):
    path = fresh(spark, "appended")
    rows = X.turns(spark, d).select("cid", (F.substring("cid", 2, 20).cast("long") % 2).alias("part")).distinct()
    for part in (0, 1):
        D.append(rows.filter(F.col("part") == part), path)
    return spark.read.schema("cid string, part long").json(path)


@query("s11_versioned_rewrite", "SELECT doc_id, (doc_id % 2 = 0)::INT AS marked FROM saved")
def s11(spark, d):
    base = fresh(spark, "versions")
    rows = X.saved(spark, d).select("doc_id", F.lit(False).alias("marked"))
    D.rewrite(rows, base, "1")
    D.rewrite(D.latest(spark, base).select("doc_id", (F.col("doc_id") % 2 == 0).alias("marked")), base, "2")
    return D.latest(spark, base).select("doc_id", F.col("marked").cast("int").alias("marked"))


@query("r1_incremental_curation", f"WITH f AS ({F1_SQL}) SELECT cid, reason, CASE WHEN reason = 'pass' THEN 'kept' ELSE 'deleted' END AS route FROM f")
def r1(spark, d):
    folder, sink, checkpoint = (fresh(spark, x) for x in ("arrivals", "curated", "stream"))
    lines = dialogue_lines(spark, d)
    lines.repartition(4).write.text(folder)
    S.curate(S.dialogue_stream(spark, folder), sink, checkpoint, X.UNSAFE).awaitTermination()
    lines.write.mode("append").text(folder)  # all come again: none is processed twice
    S.curate(S.dialogue_stream(spark, folder), sink, checkpoint, X.UNSAFE).awaitTermination()
    return S.curated(spark, sink).select("cid", "reason", "route")


def arrivals(spark, rows: DataFrame, time: str, slices: int = 4, again: bool = False, files: int = 2) -> DataFrame:
    """rows as a stream that brings them in slices of time, a batch for each; with again, every slice brings the one before it once more."""
    folder = fresh(spark, "slices")
    rows = materialize(rows, "arriving")  # each slice reads them
    t = F.unix_micros(F.col(time))
    low, high = rows.agg(F.min(t), F.max(t)).first()
    width = ((high or 0) - (low or 0)) // slices + 1
    for k in range(slices):
        at = F.floor((t - F.lit(low or 0)) / width)
        part = rows.filter((at == k) | (at == k - 1) if again else at == k)
        part.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("r2_route_counters", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, judged_model, count(*) AS n FROM judged GROUP BY ALL")
def r2(spark, d):
    sink, checkpoint = fresh(spark, "counters"), fresh(spark, "stream")
    events = X.judged(spark, d).select("ts", "judged_model")
    S.count_on(arrivals(spark, events, "ts"), sink, checkpoint, "ts", "judged_model", late="8 days").awaitTermination()
    return S.counted(spark, sink, "judged_model").select(F.col("start").cast("timestamp_ntz").alias("start"), "judged_model", "n")


#: A dialogue is closed when the watermark, a day behind the last turn, is past its last turn and twelve hours.
CLOSED = "WITH z AS (SELECT cid, max(create_time) + INTERVAL 12 HOUR AS e FROM turns GROUP BY cid), w AS (SELECT max(create_time) - INTERVAL 1 DAY AS at FROM turns)"


@query("r3_closed_dialogues", f"{CLOSED}, a AS ({A1_SQL}), o AS ({W7_SQL}) SELECT a.*, (SELECT count(*) FROM o WHERE o.cid = a.cid) AS n_chains, coalesce((SELECT string_agg(failure_turn_id || '=' || recovery_outcome, ',' ORDER BY failure_turn_id) FROM o WHERE o.cid = a.cid), '') AS outcomes FROM a JOIN z USING (cid), w WHERE z.e <= w.at")
def r3(spark, d):
    sink, checkpoint = fresh(spark, "enriched"), fresh(spark, "stream")
    t = X.turns(spark, d).filter("create_time is not null")
    S.enrich_closed(arrivals(spark, t, "create_time"), sink, checkpoint, "12 hours", "1 day", similarity="jaccard", **LEXICON).awaitTermination()
    chains = "array<struct<failure_turn_id:int,recovery_outcome:string>>"
    schema = f"cid string, turn_count long, unliked_turns array<int>, has_interrupted boolean, reaction_summary map<string,long>, dissatisfied_turns array<int>, total_dissatisfied int, recovery_chains {chains}"
    e = spark.read.schema(schema).parquet(sink)
    outcomes = F.transform(F.array_sort("recovery_chains"), lambda c: F.concat(c["failure_turn_id"], F.lit("="), c["recovery_outcome"]))
    return rollup(e, F.coalesce(F.size("recovery_chains"), F.lit(0)).cast("long").alias("n_chains"), F.coalesce(F.array_join(outcomes, ","), F.lit("")).alias("outcomes"))


@query("r4_once_per_dialogue", "SELECT DISTINCT cid FROM turns WHERE create_time IS NOT NULL")
def r4(spark, d):
    sink, checkpoint = fresh(spark, "once"), fresh(spark, "stream")
    t = X.turns(spark, d).filter("create_time is not null").select("cid", "create_time")
    S.write_once(arrivals(spark, t, "create_time", again=True), sink, checkpoint, "create_time", "2 days").awaitTermination()
    return spark.read.schema("cid string").parquet(sink)
