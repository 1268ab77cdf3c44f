"""Conversation-feedback tables derived from the given ones, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text as T

TURN = "struct<turn_index:int,role:string,message:string,create_time:timestamp,length:int,is_unliked:boolean>"
#: Patterns that match in the given texts; word ends are spelled out, as engines differ in what \b means.
COMPLAINT = r"(^|[^a-zA-ZÀ-ÿ])(non|nicht|not|no)([^a-zA-ZÀ-ÿ]|$)"
UNSAFE, IMAGE = "zuu", "eau"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """One row per message: cid, pos, turn_index, role, message, create_time, is_unliked, length."""
    c = table(spark, d, "conversations").withColumn("event_id", F.col("conv_id") * 10 + F.col("turn"))
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("create_time"), "event_type")
    return c.join(e, "event_id", "left").select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("cid"),
        F.col("turn").cast("int").alias("pos"),
        F.col("turn").cast("int").alias("turn_index"),
        "role",
        F.coalesce("text", F.lit("")).alias("message"),
        "create_time",
        F.coalesce((F.col("role") == "assistant") & (F.col("event_type") == "error"), F.lit(False)).alias("is_unliked"),
        F.length(F.coalesce("text", F.lit(""))).alias("length"),
    )


def dialogues(turn_rows: DataFrame) -> DataFrame:
    """cid, history: the messages in order."""
    m = F.struct("pos", F.struct("turn_index", "role", "message", "create_time", "length", "is_unliked").alias("m"))
    return turn_rows.groupBy("cid").agg(F.array_sort(F.collect_list(m)).alias("h")).select("cid", F.transform("h", lambda x: x["m"]).alias("history"))


AXES = ("query_completeness", "signal_credibility", "representativeness", "severity", "annotation_clarity")
_SIGNALS = ("dislike", "explicit_complaint", "repeat", "rephrase", "abandon", "short_dismiss")
_CONFIDENCE = ("high", "medium", "low")


def _of(i, *names: str):
    return F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))


def saved(spark: SparkSession, d: str, histories: bool = False) -> DataFrame:
    """Labelled bad cases, one per document; with histories, those of the dialogue its id points to."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    scores = [(1 + (i * p) % 5).cast("double") for p in (1, 3, 7, 11, 13)]
    average = sum(scores[1:], scores[0]) / 5
    out = docs.select(
        "doc_id",
        F.concat(F.lit("d"), i).alias("cid"),
        F.struct((i % 6).cast("int").alias("turn_index"), text.alias("message")).alias("source_query"),
        F.when(i % 17 == 0, "其他").otherwise(F.col("source")).alias("failure_dimension"),
        F.col("lang").alias("scenario"),
        F.create_map(*(x for a, s in zip(AXES, scores) for x in (F.lit(a), s))).alias("judge_scores"),
        average.alias("judge_average"),
        T.quality_tier(average, F.least(*scores)).alias("overall_quality"),
        _of(i % 6, *_SIGNALS).alias("signal_type"),
        _of(i % 3, *_CONFIDENCE).alias("signal_confidence"),
        _of(i % 2, "explicit", "implicit").alias("sentiment"),
        _of(i % 3, "high", "medium", "low").alias("representativeness"),
        ((i % 11) / 10).alias("confidence"),
        (F.col("toxic") == 1).alias("needs_context"),
        (i % 13 == 0).alias("needs_image"),
        (i % 19 == 0).alias("is_duplicate"),
        F.when(i % 3 == 0, F.concat(F.lit("record "), i)).otherwise(text).alias("explanation"),
        F.when(i % 23 != 0, F.col("source")).alias("failure_dimension_raw"),
        F.when(i % 4 != 0, F.concat(F.lit("audit of "), "source")).alias("judge_audit"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + i * 60), "yyyy-MM-dd HH:mm:ss").alias("save_time"),
        F.when(i % 5 != 0, _of(i % 4, "easy", "medium", "hard", "extreme")).alias("difficulty"),
        F.when(i % 7 != 0, F.struct(_of(i % 3, "keep", "downgrade", "reject").alias("verdict"), F.when(i % 2 == 0, F.array(F.lit("vague"), F.lit("off_topic"))).otherwise(F.array().cast("array<string>")).alias("issues"), F.concat(F.lit("note "), i % 4).alias("notes"))).alias("qa_verdict"),
        F.when(i % 17 == 0, F.lit(True)).alias("failure_dimension_reclassified"),
        F.when(i % 17 == 0, F.when(i % 2 == 0, 0.8).otherwise(0.5)).alias("reclassify_confidence"),
        F.when(i % 29 != 0, T.severity_tier(scores[3])).alias("severity_tier"),
        (i % 6 + 1).cast("int").alias("dislike_turn_id"),
        "quality",
    )
    if not histories:
        return out
    conversations = table(spark, d, "conversations").select(F.countDistinct("conv_id").alias("n"))  # one row
    linked = out.crossJoin(F.broadcast(conversations)).withColumn("h", F.concat(F.lit("c"), F.col("doc_id") % F.col("n"))).drop("n")
    return linked.join(dialogues(turns(spark, d)).select(F.col("cid").alias("h"), F.col("history").alias("full_history")), "h", "left").drop("h").withColumn(
        "selected_history", F.filter("full_history", lambda m: m["turn_index"] < F.col("source_query.turn_index"))
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Disliked assistant turns as mined candidates: cid, idx and label fields."""
    from pyspark.sql import Window as W

    n = F.substring("cid", 2, 20).cast("long") + F.col("pos")
    return turns(spark, d).filter("is_unliked").select(
        "cid",
        (F.row_number().over(W.partitionBy("cid").orderBy("pos")) - 1).alias("idx"),
        F.col("turn_index").alias("dislike_turn_id"),
        (F.col("turn_index") - 1).alias("source_query_turn_id"),
        F.concat(F.lit("dim"), n % 4).alias("failure_dimension"),
        ((n % 10) / 10).alias("confidence"),
        n.alias("n"),
    )


def mined(spark: SparkSession, d: str) -> DataFrame:
    """candidates with all that a miner says of them."""
    n = F.col("n")
    return candidates(spark, d).withColumns(
        {
            "scenario": _of(n % 3, "writing", "coding", "chat"),
            "signal_type": F.when(n % 4 != 0, _of(n % 2, "repeat", "rephrase")),
            "signal_confidence": F.when(n % 5 != 0, "medium"),
            "sentiment": _of(n % 2, "explicit", "implicit"),
            "complaint_snippet": F.when(n % 3 == 0, "not right"),
            "explanation": F.concat(F.lit("turn "), n),
            "user_reaction_after_failure": F.when(n % 4 != 0, "repeat"),
            "recovery_attempted": n % 2 == 0,
            "recovery_successful": n % 6 == 0,
            "representativeness": F.when(n % 5 == 0, "low").otherwise("high"),
            "miner_model": F.lit("miner"),
            "miner_latency_s": (n % 7) / 10,
            "miner_tokens": n % 100,
        }
    )


def judge_out(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).filter("n % 5 <> 0")
    return c.select(
        "cid",
        F.col("idx").alias("candidate_index"),
        (F.col("n") % 3 != 0).alias("should_keep"),
        F.when(F.col("n") % 3 == 1, "high").when(F.col("n") % 3 == 2, "medium").otherwise("low").alias("overall_quality"),
        F.when(F.col("n") % 7 == 0, F.lit("corrected")).alias("corrected_dimension"),
        F.create_map(F.lit("severity"), (1 + F.col("n") % 5).cast("double"), F.lit("representativeness"), (1 + F.col("n") % 3).cast("double")).alias("judge_scores"),
        ((2 + F.col("n") % 5 + F.col("n") % 3) / 2).alias("judge_average"),
        F.concat(F.lit("audit "), F.col("n")).alias("judge_audit"),
        F.lit("judge").alias("judge_model"),
        ((F.col("n") % 9) / 10).alias("judge_latency_s"),
        (F.col("n") % 50).alias("judge_tokens"),
    )


def qa_out(spark: SparkSession, d: str) -> DataFrame:
    """Two verdicts per document, with issue codes; some rows have none."""
    i = F.col("doc_id")
    issues = F.when(i % 5 == 0, F.array(F.lit("needs_context"), F.lit("vague"))).when(i % 5 == 1, F.array(F.lit("vague"))).when(i % 5 == 2, F.array().cast("array<string>"))
    issues2 = F.when(i % 4 == 1, F.array(F.lit("off_topic"), F.lit("vague"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").filter("doc_id % 7 <> 0").select(
        "doc_id",
        _of(i % 3, "keep", "downgrade", "reject").alias("v1"),
        F.when(i % 8 != 3, _of(i % 4, "keep", "reject", "downgrade", "reject")).alias("v2"),
        issues.alias("issues1"),
        issues2.alias("issues2"),
        F.when(i % 9 == 0, "dim_fixed").alias("corrected_dimension"),
    )


def judged(spark: SparkSession, d: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    good, bad = F.when(e % 10 != 0, -v / 10), F.when(e % 7 != 0, -1 / (1 + v))
    t = F.col("event_type")
    return table(spark, d, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("m"), F.col("user_id") % 8).alias("judged_model"),
        F.concat(F.lit("e"), e).alias("cid"),
        F.when(t.isin("purchase", "signup"), 1).when(t == "error", -1).when(t == "click", 0).when(v > 10, 1).otherwise(-1).alias("verdict"),
        good.alias("good_logprob"),
        bad.alias("bad_logprob"),
        T.preference_score(good, bad).alias("score"),
        (F.get_json_object("props", "$.k").cast("double") / 10.0).alias("latency_s"),
        F.when(e % 11 != 0, F.concat(F.lit("dim"), e % 5)).alias("failure_dimension"),
    )


def task1(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    raw = _of(i % 6, "好", "差。", "不好", '{"verdict": 1}', "回答一般\n总体令用户满意", "")
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        "doc_id",
        F.concat(F.lit("d"), i).alias("cid"),
        F.when(F.col("quality") == 1, 1).otherwise(-1).alias("ground_truth"),
        raw.alias("raw_output"),
        F.concat(F.lit("m"), i % 4).alias("model"),
        F.coalesce("text", F.lit("")).alias("agent_response_full"),
        F.col("lang").alias("difficulty"),
    )


def task2(spark: SparkSession, d: str) -> DataFrame:
    """cid, history before the last user turn, query: that turn."""
    t = turns(spark, d)
    last = t.filter("role = 'user'").groupBy("cid").agg(F.max_by("message", "pos").alias("query"), F.max("pos").alias("at"))
    return dialogues(t).join(last, "cid").select("cid", F.filter("history", lambda m: m["turn_index"] < F.col("at")).alias("history"), "query", F.filter("history", lambda m: (m["turn_index"] > F.col("at")) & (m["role"] == "assistant")).alias("after"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """cid, model, generated_response of three models; some blank, some failed, some of unknown cids."""
    n = F.substring("cid", 2, 20).cast("long")
    base = task2(spark, d).select("cid", n.alias("n"), F.coalesce(F.get("after", F.lit(0))["message"], F.lit("")).alias("text"))
    out = None
    for k in range(3):
        r = base.select(
            F.when((F.col("n") + k) % 11 == 0, F.concat(F.lit("x"), "cid")).otherwise(F.col("cid")).alias("cid"),
            F.lit(f"r{k}").alias("model"),
            F.when((F.col("n") + k) % 5 == 0, "  ").when((F.col("n") + k) % 7 == 0, "__ERROR__ timeout").otherwise(F.col("text")).alias("generated_response"),
        )
        out = r if out is None else out.unionByName(r)
    return out


#: The same tables for DuckDB; a query's SQL is put after those that it names.
SQL = {
    "turns": """SELECT 'c' || conv_id AS cid, turn::INT AS pos, turn::INT AS turn_index, role, coalesce(text, '') AS message, e.ts AS create_time,
        coalesce(role = 'assistant' AND event_type = 'error', false) AS is_unliked, length(coalesce(text, '')) AS length, conv_id
        FROM conversations c LEFT JOIN events e ON e.event_id = c.conv_id * 10 + c.turn""",
    "saved": """SELECT doc_id, 'd' || doc_id AS cid, (doc_id % 6)::INT AS sq_turn, coalesce(text, '') AS sq_message,
        CASE WHEN doc_id % 17 = 0 THEN '其他' ELSE source END AS failure_dimension, lang AS scenario,
        (1 + doc_id % 5)::DOUBLE AS s1, (1 + (doc_id * 3) % 5)::DOUBLE AS s2, (1 + (doc_id * 7) % 5)::DOUBLE AS s3, (1 + (doc_id * 11) % 5)::DOUBLE AS s4, (1 + (doc_id * 13) % 5)::DOUBLE AS s5,
        (s1 + s2 + s3 + s4 + s5) / 5 AS judge_average,
        CASE WHEN judge_average >= 4 AND least(s1, s2, s3, s4, s5) >= 3 THEN 'high' WHEN judge_average >= 3 AND least(s1, s2, s3, s4, s5) >= 2 THEN 'medium' ELSE 'low' END AS overall_quality,
        ['dislike', 'explicit_complaint', 'repeat', 'rephrase', 'abandon', 'short_dismiss'][(doc_id % 6 + 1)::INT] AS signal_type,
        ['high', 'medium', 'low'][(doc_id % 3 + 1)::INT] AS signal_confidence, ['explicit', 'implicit'][(doc_id % 2 + 1)::INT] AS sentiment,
        ['high', 'medium', 'low'][(doc_id % 3 + 1)::INT] AS representativeness, (doc_id % 11) / 10.0::DOUBLE AS confidence, toxic = 1 AS needs_context,
        doc_id % 13 = 0 AS needs_image, doc_id % 19 = 0 AS is_duplicate, CASE WHEN doc_id % 3 = 0 THEN 'record ' || doc_id ELSE coalesce(text, '') END AS explanation, (doc_id % 6 + 1)::INT AS dislike_turn_id, quality,
        CASE WHEN doc_id % 23 <> 0 THEN source END AS failure_dimension_raw, CASE WHEN doc_id % 4 <> 0 THEN 'audit of ' || source END AS judge_audit, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S') AS save_time,
        CASE WHEN doc_id % 5 <> 0 THEN ['easy', 'medium', 'hard', 'extreme'][(doc_id % 4 + 1)::INT] END AS difficulty, CASE WHEN doc_id % 7 <> 0 THEN ['keep', 'downgrade', 'reject'][(doc_id % 3 + 1)::INT] END AS qa_verdict,
        CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 THEN 'vague,off_topic' ELSE '' END AS qa_issues, CASE WHEN doc_id % 7 <> 0 THEN 'note ' || (doc_id % 4) ELSE '' END AS qa_notes, doc_id % 17 = 0 AS reclassified,
        CASE WHEN doc_id % 17 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 0.8 ELSE 0.5 END::DOUBLE END AS reclassify_confidence, CASE WHEN doc_id % 29 <> 0 THEN CASE WHEN s4 >= 4 THEN 'critical' WHEN s4 >= 3 THEN 'moderate' ELSE 'mild' END END AS severity_tier,
        'c' || (doc_id % (SELECT count(DISTINCT conv_id) FROM conversations)) AS h
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "candidates": """SELECT cid, row_number() OVER (PARTITION BY cid ORDER BY pos) - 1 AS idx, turn_index AS dislike_turn_id, turn_index - 1 AS source_query_turn_id,
        'dim' || ((conv_id + pos) % 4) AS failure_dimension, ((conv_id + pos) % 10) / 10.0::DOUBLE AS confidence, conv_id + pos AS n FROM turns WHERE is_unliked""",
    "judge_out": """SELECT cid, idx AS candidate_index, n % 3 <> 0 AS should_keep, CASE n % 3 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS overall_quality,
        CASE WHEN n % 7 = 0 THEN 'corrected' END AS corrected_dimension FROM candidates WHERE n % 5 <> 0""",
    "qa_out": """SELECT doc_id, ['keep', 'downgrade', 'reject'][(doc_id % 3 + 1)::INT] AS v1, CASE WHEN doc_id % 8 <> 3 THEN ['keep', 'reject', 'downgrade', 'reject'][(doc_id % 4 + 1)::INT] END AS v2,
        CASE doc_id % 5 WHEN 0 THEN ['needs_context', 'vague'] WHEN 1 THEN ['vague'] WHEN 2 THEN []::VARCHAR[] END AS issues1,
        CASE WHEN doc_id % 4 = 1 THEN ['off_topic', 'vague'] ELSE []::VARCHAR[] END AS issues2, CASE WHEN doc_id % 9 = 0 THEN 'dim_fixed' END AS corrected_dimension FROM documents WHERE doc_id % 7 <> 0""",
    "judged": """SELECT event_id, ts, 'm' || (user_id % 8) AS judged_model, 'e' || event_id AS cid,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 WHEN event_type = 'click' THEN 0 WHEN value > 10 THEN 1 ELSE -1 END AS verdict,
        CASE WHEN event_id % 10 <> 0 THEN -value / 10 END AS good_logprob, CASE WHEN event_id % 7 <> 0 THEN -1 / (1 + value) END AS bad_logprob,
        CASE WHEN good_logprob IS NOT NULL AND bad_logprob IS NOT NULL THEN exp(good_logprob) / (exp(good_logprob) + exp(bad_logprob)) WHEN good_logprob IS NOT NULL THEN exp(good_logprob)
          WHEN bad_logprob IS NOT NULL THEN 1 - exp(bad_logprob) END AS score,
        json_extract_string(props, '$.k')::DOUBLE / 10.0 AS latency_s, CASE WHEN event_id % 11 <> 0 THEN 'dim' || (event_id % 5) END AS failure_dimension FROM events""",
    "task1": """SELECT doc_id, 'd' || doc_id AS cid, CASE quality WHEN 1 THEN 1 ELSE -1 END AS ground_truth,
        ['好', '差。', '不好', '{"verdict": 1}', '回答一般' || chr(10) || '总体令用户满意', ''][(doc_id % 6 + 1)::INT] AS raw_output, 'm' || (doc_id % 4) AS model,
        coalesce(text, '') AS agent_response_full, lang AS difficulty FROM documents JOIN labels USING (doc_id)""",
    "task2": """SELECT cid, max(pos) AS at, arg_max(message, pos) AS query, (SELECT t.message FROM turns t WHERE t.cid = u.cid AND t.role = 'assistant' AND t.pos > max(u.pos) ORDER BY t.pos LIMIT 1) AS next_text,
        substring(cid, 2)::BIGINT AS n FROM turns u WHERE role = 'user' GROUP BY cid""",
    "responses": """SELECT CASE WHEN (n + k) % 11 = 0 THEN 'x' || cid ELSE cid END AS cid, 'r' || k AS model,
        CASE WHEN (n + k) % 5 = 0 THEN '  ' WHEN (n + k) % 7 = 0 THEN '__ERROR__ timeout' ELSE coalesce(next_text, '') END AS generated_response FROM task2, (SELECT unnest([0, 1, 2]) AS k)""",
}
_NEEDS = {"candidates": ["turns"], "judge_out": ["turns", "candidates"], "task2": ["turns"], "responses": ["turns", "task2"]}


def with_views(sql: str) -> str:
    """sql behind the definitions of the views that it names."""
    import re

    names: list[str] = []
    for name in SQL:
        if re.search(rf"\b{name}\b", sql):
            names += [n for n in [*_NEEDS.get(name, []), name] if n not in names]
    ordered = [n for n in SQL if n in names]
    if not ordered:
        return sql
    body = sql.strip()
    head = "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered)
    return f"{head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"{head}\n{body}"
