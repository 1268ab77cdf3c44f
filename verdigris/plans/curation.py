"""Queries on saved bad cases: labels, filters, routes, records, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import lexicons as L
from verdigris.functions import text as T
from verdigris.operators import curate as C
from verdigris.operators import sampling as K
from verdigris.operators import serving as V
from verdigris.operators import turns as O
from verdigris.plans.registry import query
from verdigris.plans.turn_queries import LEXICON, REACTED, SIGNALS
from verdigris.sources import fixtures as X
from verdigris.sources.shared import fresh, materialize

#: The reactions, behind the signals.
REACTED_ONLY = REACTED.removeprefix(SIGNALS).lstrip(", \n")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def sql_case(rules, column: str, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(column)} THEN {quoted(name)}" for test, name in rules) + f" ELSE {last} END"


#: A message of the linked dialogue.
AT = "(SELECT t.message FROM turns t WHERE t.cid = s.h AND t.turn_index = s.dislike_turn_id)"


@query("p10_image_dependency", f"SELECT cid, (regexp_matches(sq_message, '{X.IMAGE}') OR (SELECT coalesce(bool_or(contains(t.message, 'zzq')), false) FROM turns t WHERE t.cid = s.h AND t.pos - (SELECT min(pos) FROM turns m WHERE m.cid = s.h) < 5))::INT AS needs_image FROM saved s")
def p10(spark, d):
    s = X.saved(spark, d, histories=True)
    return s.select("cid", T.needs_image(F.col("source_query.message"), F.col("full_history"), X.IMAGE, ("zzq",)).cast("int").alias("needs_image"))


@query("p11_needs_context", "SELECT cid, (s1 <= 2)::INT AS needs_context FROM saved")
def p11(spark, d):
    return X.saved(spark, d).select("cid", T.needs_context(F.col("judge_scores")["query_completeness"]).cast("int").alias("needs_context"))


@query("p12_severity", "SELECT cid, CASE WHEN s4 >= 4 THEN 'critical' WHEN s4 >= 3 THEN 'moderate' ELSE 'mild' END AS tier FROM saved")
def p12(spark, d):
    return X.saved(spark, d).select("cid", T.severity_tier(F.col("judge_scores")["severity"]).alias("tier"))


#: Raw labels for the label rules: one of a list, by id.
RAW = ["冗余/啰嗦", "?", "事实性错误与幻觉", "答非所问", "格式错误", "系统提示泄露", "verbosity", "过度拒答", "缺少共情", "unknown thing", "", "信息过时", "上下文丢失", "推荐不当", "任务未完成度"]


def _raw_labels(spark, d) -> DataFrame:
    return X.saved(spark, d).select("doc_id", F.element_at(F.array(*map(F.lit, RAW)), (F.col("doc_id") % len(RAW) + 1).cast("int")).alias("raw"))


_DIMENSION = f"CASE WHEN raw IS NULL OR raw IN ('', '?') THEN {quoted(L.OTHER)} WHEN raw IN {sql_list(L.DIMENSIONS)} THEN raw " + " ".join(f"WHEN regexp_matches(raw, {quoted(p)}, 'i') THEN {quoted(n)}" for p, n in L.DIMENSION_RULES) + f" ELSE {quoted(L.OTHER)} END"


@query("p13_dimensions", f"WITH q AS (SELECT [{', '.join(map(quoted, RAW))}][(doc_id % {len(RAW)} + 1)::INT] AS raw FROM saved) SELECT raw, {_DIMENSION} AS dimension, count(*) AS n FROM q GROUP BY ALL")
def p13(spark, d):
    return C.normalised(_raw_labels(spark, d), "raw").groupBy("raw", "dimension").agg(F.count("*").alias("n"))


_SCENES = ["娱乐消散", "信息与知识查询", "生活决策辅助", "未知场景", ""]


def _map_case(mapping, column) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {quoted(a)} THEN {quoted(b)}" for a, b in mapping.items()) + " END"


@query(
    "p14_label_maps",
    f"""WITH q AS (SELECT [{', '.join(map(quoted, _SCENES))}][(doc_id % 5 + 1)::INT] AS scenario FROM saved), m AS (SELECT *, scenario <> '' AND scenario NOT IN {sql_list(L.SCENARIOS)} AS f, {_map_case(L.SCENARIO_MAP, 'scenario')} AS t FROM q)
    SELECT scenario, CASE WHEN f THEN coalesce(t, scenario) ELSE scenario END AS mapped, (f AND t IS NULL)::INT AS unmapped, count(*) AS n FROM m GROUP BY ALL""",
)
def p14(spark, d):
    s = X.saved(spark, d).select(F.element_at(F.array(*map(F.lit, _SCENES)), (F.col("doc_id") % 5 + 1).cast("int")).alias("scenario"))
    m = C.mapped(s, "scenario", L.SCENARIOS, L.SCENARIO_MAP)
    return m.groupBy("scenario", F.col("scenario_mapped").alias("mapped"), F.col("scenario_unmapped").cast("int").alias("unmapped")).agg(F.count("*").alias("n"))


@query("p15_context_writeback", "SELECT coalesce(list_has_any(issues1, ['incomplete_context_dependency', 'needs_context', 'needs_context_dependency']), false)::INT AS needs_context, CASE WHEN v1 = 'downgrade' AND overall_quality = 'high' THEN 'medium' ELSE overall_quality END AS quality, count(*) AS n FROM saved LEFT JOIN qa_out USING (doc_id) GROUP BY ALL")
def p15(spark, d):
    j = X.saved(spark, d).join(X.qa_out(spark, d).select("doc_id", "v1", "issues1"), "doc_id", "left")
    needs = F.coalesce(F.arrays_overlap(F.coalesce("issues1", F.array().cast("array<string>")), F.array(*map(F.lit, L.CONTEXT_ISSUES))), F.lit(False))
    quality = F.when((F.col("v1") == "downgrade") & (F.col("overall_quality") == "high"), "medium").otherwise(F.col("overall_quality"))
    return j.groupBy(needs.cast("int").alias("needs_context"), quality.alias("quality")).agg(F.count("*").alias("n"))


KEY = r"substring(lower(regexp_replace(trim({}, E' \n\t\r'), '\s+', ' ', 'g')), 1, 60)"


@query("p16_query_keys", f"SELECT md5({KEY.format('sq_message')}) AS query_key, count(*) AS n FROM saved GROUP BY 1")
def p16(spark, d):
    return X.saved(spark, d).groupBy(F.md5(T.query_key(F.col("source_query.message"))).alias("query_key")).agg(F.count("*").alias("n"))


SAID = "coalesce((SELECT t.message FROM turns t WHERE t.cid = s.h AND t.turn_index = {} AND t.role = 'assistant'), '')"


@query("p30_review_summaries", f"SELECT cid, substring(sq_message, 1, 150) AS source_query, substring({SAID.format('s.dislike_turn_id')}, 1, 250) AS agent_response_preview, coalesce(failure_dimension, '') AS failure_dimension, substring(explanation, 1, 150) AS explanation, signal_type, round(judge_average, 6) AS judge_average, overall_quality FROM saved s")
def p30(spark, d):
    s = X.saved(spark, d, histories=True)
    return s.select("cid", C.review_summary(s).alias("s")).select("cid", "s.*").withColumn("judge_average", F.round("judge_average", 6))


@query("p30_strong_review_summaries", f"SELECT cid, substring(sq_message, 1, 300) AS source_query, substring({SAID.format('s.sq_turn - 1')}, 1, 300) AS prior_turn, substring({SAID.format('s.dislike_turn_id')}, 1, 500) AS agent_response_preview, coalesce(failure_dimension, '') AS failure_dimension, substring(explanation, 1, 300) AS explanation, signal_type, signal_confidence, round(judge_average, 6) AS judge_average, (sq_turn // 2)::INT AS context_rounds FROM saved s")
def p30_strong(spark, d):
    s = X.saved(spark, d, histories=True)
    return s.select("cid", C.review_summary(s, strong=True).alias("s")).select("cid", "s.*").withColumn("judge_average", F.round("judge_average", 6))


@query(
    "p29_candidate_summaries",
    """SELECT c.cid, c.idx, md5(concat('{"candidate_index":', c.idx, ',"dislike_turn_id":', c.dislike_turn_id, ',"source_query_turn_id":', c.source_query_turn_id, ',"source_query_text":', coalesce(to_json(q.message)::VARCHAR, 'null'),
        ',"agent_response_preview":', to_json(substring(coalesce(a.message, ''), 1, 200))::VARCHAR, ',"failure_dimension":"', c.failure_dimension, '","scenario":"', ['writing', 'coding', 'chat'][(c.n % 3 + 1)::INT],
        '","signal_type":"dislike","signal_confidence":"', CASE WHEN c.n % 2 = 0 THEN 'high' ELSE 'low' END, '","sentiment":"explicit","complaint_snippet":null,"explanation":"turn ', c.n, '","user_reaction_after_failure":', CASE WHEN c.n % 4 = 0 THEN 'null' ELSE '"repeat"' END,
        ',"recovery_attempted":', (c.n % 2 = 0)::VARCHAR, ',"recovery_successful":', (c.n % 6 = 0)::VARCHAR, ',"representativeness":"', CASE WHEN c.n % 5 = 0 THEN 'low' ELSE 'high' END, '","confidence":', c.confidence, '}')) AS summary
    FROM candidates c LEFT JOIN turns a ON a.cid = c.cid AND a.turn_index = c.dislike_turn_id LEFT JOIN turns q ON q.cid = c.cid AND q.turn_index = c.source_query_turn_id""",
)
def p29(spark, d):
    said = X.turns(spark, d).select("cid", "turn_index", "message")
    answer = said.select("cid", F.col("turn_index").alias("dislike_turn_id"), F.col("message").alias("agent_response_preview"))
    asked = said.select("cid", F.col("turn_index").alias("source_query_turn_id"), F.col("message").alias("source_query_text"))
    c = X.candidates(spark, d).join(answer, ["cid", "dislike_turn_id"], "left").join(asked, ["cid", "source_query_turn_id"], "left")
    n = F.col("n")
    mined = c.withColumns(
        {
            "scenario": F.element_at(F.array(*map(F.lit, ("writing", "coding", "chat"))), (n % 3 + 1).cast("int")),
            "signal_type": F.lit("dislike"),
            "signal_confidence": F.when(n % 2 == 0, "high").otherwise("low"),
            "sentiment": F.lit("explicit"),
            "explanation": F.concat(F.lit("turn "), n),
            "user_reaction_after_failure": F.when(n % 4 != 0, "repeat"),
            "recovery_attempted": n % 2 == 0,
            "recovery_successful": n % 6 == 0,
            "representativeness": F.when(n % 5 == 0, "low").otherwise("high"),
        }
    )
    return mined.select("cid", "idx", F.md5(C.candidate_summary(mined)).alias("summary"))


@query("p31_tags", "SELECT cid, CASE WHEN sentiment = 'explicit' THEN 'failure_testcase' ELSE 'query_testcase' END AS tag FROM saved")
def p31(spark, d):
    return X.saved(spark, d).select("cid", F.when(F.col("sentiment") == "explicit", "failure_testcase").otherwise("query_testcase").alias("tag"))


@query("p33_quality_tiers", "SELECT cid, overall_quality AS tier, round(judge_average, 6) AS average FROM saved")
def p33(spark, d):
    scores = F.map_values("judge_scores")
    average = F.aggregate(scores, F.lit(0.0), lambda a, v: a + v) / F.size(scores)
    return X.saved(spark, d).select("cid", T.quality_tier(average, F.array_min(scores)).alias("tier"), F.round(average, 6).alias("average"))


GATE = "(overall_quality = 'high' AND judge_average >= 4 AND least(s1, s2, s3, s4, s5) >= 3 AND signal_confidence IN ('high', 'medium', ''))"
SOLVABLE = f"(failure_dimension NOT IN {sql_list(L.UNSOLVABLE_TYPES)} AND length(trim(sq_message, E' \\n\\t\\r')) >= 15 AND NOT regexp_matches(sq_message, {quoted(L.UNSOLVABLE_QUERY)}, 'i') AND length(trim(explanation, E' \\n\\t\\r')) >= 40)"
DIFFICULT = "(representativeness <> 'low' AND s1 >= 3)"


@query("f2_quality_gate", f"SELECT cid FROM saved WHERE {GATE}")
def f2(spark, d):
    s = X.saved(spark, d)
    return s.filter(C.quality_gate(s)).select("cid")


def _solvable():
    return C.solvable(F.col("failure_dimension"), F.col("source_query.message"), F.col("explanation"))


@query("f3_solvable", f"SELECT cid FROM saved WHERE {SOLVABLE}")
def f3(spark, d):
    return X.saved(spark, d).filter(_solvable()).select("cid")


@query("f4_difficult", f"SELECT cid FROM saved WHERE {DIFFICULT}")
def f4(spark, d):
    s = X.saved(spark, d)
    return s.filter(C.difficult(s)).select("cid")


FUNNEL = f"""f0 AS (SELECT *, {AT} AS response, (SELECT max(turn_index) FROM turns t WHERE t.cid = s.h AND t.turn_index < s.sq_turn) AS last_turn FROM saved s), f AS (SELECT *, CASE WHEN overall_quality NOT IN ('high', 'medium') THEN 'quality' WHEN needs_context IS DISTINCT FROM false THEN 'needs_context'
  WHEN failure_dimension IS NULL OR failure_dimension = {quoted(L.OTHER)} THEN 'dimension' WHEN is_duplicate THEN 'duplicate' WHEN needs_image THEN 'needs_image' WHEN length(sq_message) < 5 THEN 'query_len' WHEN judge_average < 3.5 THEN 'judge_avg'
  WHEN coalesce(response, '') = '' THEN 'no_response' WHEN last_turn >= sq_turn THEN 'wrong_cutoff' END AS fail_reason FROM f0)"""


@query("f5_benchmark_funnel", f"WITH {FUNNEL} SELECT cid, fail_reason FROM f")
def f5(spark, d):
    return C.benchmark_funnel(X.saved(spark, d, histories=True)).select("cid", "fail_reason")


@query("a5_funnel_counts", f"WITH {FUNNEL} SELECT coalesce(fail_reason, 'passed') AS rule, count(*) AS n FROM f GROUP BY 1")
def a5(spark, d):
    return C.benchmark_funnel(X.saved(spark, d, histories=True)).groupBy(F.coalesce("fail_reason", F.lit("passed")).alias("rule")).agg(F.count("*").alias("n"))


@query(
    "o14_benchmark_entries",
    f"""WITH {FUNNEL} SELECT cid, save_time, sq_turn, md5(sq_message) AS query, coalesce((SELECT string_agg(t.turn_index, ',' ORDER BY pos) FROM turns t WHERE t.cid = f.h AND t.turn_index < f.sq_turn), '') AS selected_turn_indices,
    md5(coalesce((SELECT string_agg(t.role || t.message, '' ORDER BY pos) FROM turns t WHERE t.cid = f.h AND t.turn_index < f.sq_turn), '')) AS selected_history, response AS agent_response_full, failure_dimension, failure_dimension_raw, scenario, severity_tier, overall_quality,
    round(judge_average, 6) AS judge_average, concat_ws(',', s1::INT, s2::INT, s3::INT, s4::INT, s5::INT) AS judge_scores, judge_audit, needs_context::INT AS needs_context, needs_image::INT AS needs_image, is_duplicate::INT AS is_duplicate, md5(explanation) AS explanation,
    substring(response, 1, 200) AS agent_response_preview, signal_type, signal_confidence, dislike_turn_id, representativeness, round(confidence, 6) AS confidence, qa_verdict, qa_issues, qa_notes, reclassified::INT AS failure_dimension_reclassified, reclassify_confidence FROM f WHERE fail_reason IS NULL""",
)
def o14(spark, d):
    e = C.benchmark_entries(C.benchmark_funnel(X.saved(spark, d, histories=True)))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    scores = F.concat_ws(",", *(F.col("judge_scores")[a].cast("int").cast("string") for a in X.AXES))
    flat = {
        "sq_turn": F.col("source_query.turn_index"), "query": F.md5("source_query.message"), "selected_turn_indices": joined("selected_turn_indices"), "selected_history": F.md5(F.array_join(F.transform("selected_history", lambda m: F.concat(m["role"], m["message"])), "")),
        "judge_scores": scores, "judge_average": F.round("judge_average", 6), "confidence": F.round("confidence", 6), "explanation": F.md5("explanation"), "qa_issues": joined("qa_issues"),
    } | {c: F.col(c).cast("int") for c in ("needs_context", "needs_image", "is_duplicate", "failure_dimension_reclassified")}
    assert len(e.columns) == 29
    return e.withColumns(flat).drop("source_query")


TRACK = "CASE WHEN signal_type IN ('explicit_complaint', 'repeat_query', 'rephrase_query', 'repeat', 'rephrase') OR (signal_type = 'dislike' AND sentiment = 'explicit') OR (signal_type = 'dislike' AND judge_average >= 4.5 AND confidence >= 0.9) THEN 'A' ELSE 'B' END"


@query("f8_tracks", f"SELECT cid, {TRACK} AS track FROM saved")
def f8(spark, d):
    s = X.saved(spark, d)
    return s.select("cid", C.track(s).alias("track"))


@query("a9_track_summary", f"WITH k AS (SELECT *, {TRACK} AS track FROM saved), u AS (SELECT track, 'dimension' AS facet, failure_dimension AS value FROM k UNION ALL SELECT track, 'signal', signal_type FROM k UNION ALL SELECT track, 'quality', overall_quality FROM k UNION ALL SELECT track, 'all', 'all' FROM k) SELECT track, facet, value, count(*) AS n, round(count(*) * 100.0 / nullif((SELECT count(*) FROM k), 0), 1) AS pct FROM u GROUP BY ALL")
def a9(spark, d):
    s = X.saved(spark, d)
    facets = F.explode(F.array(*(F.struct(F.lit(n).alias("facet"), v.alias("value")) for n, v in (("dimension", F.col("failure_dimension")), ("signal", F.col("signal_type")), ("quality", F.col("overall_quality")), ("all", F.lit("all"))))))
    total = s.agg(F.count("*").alias("total"))
    g = s.select(C.track(s).alias("track"), facets.alias("f")).groupBy("track", "f.facet", "f.value").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(total)).select("track", "facet", "value", "n", F.round(F.try_divide(F.col("n") * 100.0, "total"), 1).alias("pct"))


@query("o9_track_a_records", f"SELECT cid, (SELECT string_agg(turn_index || CASE WHEN t.turn_index = s.dislike_turn_id AND role = 'assistant' THEN ':{L.BLANK}' ELSE ':' || length(substring(message, 1, 2000)) END, '|' ORDER BY pos) FROM turns t WHERE t.cid = s.h AND t.turn_index <= s.dislike_turn_id) AS context, (SELECT least(6, count(*)) FROM turns t WHERE t.cid = s.h AND t.turn_index > s.dislike_turn_id AND EXISTS (SELECT 1 FROM turns x WHERE x.cid = s.h AND x.turn_index = s.dislike_turn_id))::BIGINT AS n_recovery FROM saved s WHERE {TRACK} = 'A'")
def o9(spark, d):
    s = X.saved(spark, d, histories=True)
    a = C.track_a(s.filter(C.track(s) == "A"))
    turn = F.transform("dialogue_context", lambda m: F.concat_ws(":", m["turn_index"].cast("string"), F.when(m["content"] == L.BLANK, m["content"]).otherwise(F.length(m["content"]).cast("string"))))
    return a.select("cid", F.nullif(F.array_join(turn, "|"), F.lit("")).alias("context"), F.size("recovery_turns").cast("long").alias("n_recovery"))


def _reactions_of(spark, d) -> DataFrame:
    r = O.reactions(X.turns(spark, d), similarity="jaccard", **LEXICON)
    return r.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("asst_turn_id", "reaction", "dissatisfied"))).alias("user_reactions"))


@query("o10_track_b_records", f"WITH {REACTED} SELECT v.cid, t.turn_index, t.role, t.is_unliked::INT AS is_unliked, r.reaction AS user_reaction, (t.turn_index = v.dislike_turn_id)::INT AS is_failure_turn FROM (SELECT * FROM saved WHERE {TRACK} = 'B') v JOIN turns t ON t.cid = v.h LEFT JOIN r ON r.cid = t.cid AND r.turn_index = t.turn_index")
def o10(spark, d):
    s = X.saved(spark, d, histories=True)
    n = X.table(spark, d, "conversations").select(F.countDistinct("conv_id").alias("n"))
    linked = s.filter(C.track(s) == "B").crossJoin(F.broadcast(n)).withColumn("own", F.col("cid")).withColumn("cid", F.concat(F.lit("c"), F.col("doc_id") % F.col("n")))
    b = C.track_b(linked, _reactions_of(spark, d))
    return b.select(F.col("own").alias("cid"), F.explode("labeled_turns").alias("t")).select("cid", "t.turn_index", "t.role", F.col("t.is_unliked").cast("int").alias("is_unliked"), "t.user_reaction", F.col("t.is_failure_turn").cast("int").alias("is_failure_turn"))


@query("o11_test_cases", f"SELECT cid, sq_turn, substring({AT}, 1, 3000) AS reference_response, (SELECT count(*) FROM turns t WHERE t.cid = s.h AND t.turn_index < s.sq_turn) AS n_context FROM saved s WHERE sq_message <> '' AND coalesce({AT}, '') <> ''")
def o11(spark, d):
    s = X.saved(spark, d, histories=True).withColumn("reference_response", F.substring(F.coalesce(C.message_at(F.col("full_history"), F.col("dislike_turn_id"))["message"], F.lit("")), 1, 3000))
    kept = s.filter((F.coalesce("source_query.message", F.lit("")) != "") & (F.col("reference_response") != ""))
    context = F.filter("full_history", lambda m: m["turn_index"] < F.col("source_query.turn_index"))
    return kept.select("cid", F.col("source_query.turn_index").alias("sq_turn"), "reference_response", F.size(context).cast("long").alias("n_context"))


@query("j5_failing_messages", f"SELECT cid, dislike_turn_id, coalesce({AT}, '') AS message FROM saved s")
def j5(spark, d):
    return X.saved(spark, d, histories=True).select("cid", "dislike_turn_id", F.coalesce(C.message_at(F.col("full_history"), F.col("dislike_turn_id"))["message"], F.lit("")).alias("message"))


@query("w11_order_repair", "WITH q AS (SELECT s.*, CASE WHEN doc_id % 4 = 0 THEN dislike_turn_id + 2 ELSE sq_turn END AS st FROM saved s), f AS (SELECT *, (SELECT max(turn_index) FROM turns t WHERE t.cid = q.h AND t.turn_index < q.dislike_turn_id AND t.role = 'user') AS u FROM q) SELECT cid, CASE WHEN st > dislike_turn_id AND u IS NOT NULL THEN u ELSE st END AS source_turn, (st > dislike_turn_id AND u IS NOT NULL)::INT AS fixed FROM f")
def w11(spark, d):
    s = X.saved(spark, d, histories=True).withColumn("source_query", F.struct(F.when(F.col("doc_id") % 4 == 0, F.col("dislike_turn_id") + 2).otherwise(F.col("source_query.turn_index")).alias("turn_index"), F.col("source_query.message").alias("message")))
    return C.repaired_order(s).select("cid", F.col("source_query.turn_index").alias("source_turn"), F.col("ordering_fixed").cast("int").alias("fixed"))


def _retried(spark, d) -> DataFrame:
    """Saved records, every fifth of them again with a mark behind its query and another score."""
    s = X.saved(spark, d)
    again = s.filter("doc_id % 5 = 0").withColumns(
        {"source_query": F.struct(F.col("source_query.turn_index").alias("turn_index"), F.concat("source_query.message", F.lit("?")).alias("message")), "judge_average": F.col("judge_average") + (F.col("doc_id") % 3 - 1) * 0.5, "doc_id": F.col("doc_id") + 1_000_000_000}
    )
    return s.unionByName(again)


# two texts of which one has a character more are near for 5 characters on
@query("j11_near_duplicates", "WITH p AS (SELECT doc_id AS a, doc_id + 1000000000 AS b, judge_average AS ja, judge_average + (doc_id % 3 - 1) * 0.5 AS jb FROM saved WHERE doc_id % 5 = 0 AND length(sq_message) >= 5) SELECT CASE WHEN ja >= jb THEN b ELSE a END AS id, CASE WHEN ja >= jb THEN a ELSE b END AS duplicate_of FROM p")
def j11(spark, d):
    return C.near_duplicates(_retried(spark, d), "doc_id", compared=None)


@query("j11_near_duplicate_groups")
def j11_groups(spark, d):
    """Records of one source as those of one dialogue, so that groups are large and their queries are near, equal and different."""
    one = F.struct(F.lit(0).alias("turn_index"), F.col("source_query.message").alias("message"))
    return C.near_duplicates(X.saved(spark, d).withColumns({"cid": F.col("failure_dimension"), "dislike_turn_id": F.lit(1), "source_query": one}), "doc_id", compared=None)


@query("w9_sequential_ids", "SELECT cid, 'tc_' || lpad(row_number() OVER (ORDER BY doc_id)::VARCHAR, 5, '0') AS id FROM saved")
def w9(spark, d):
    return C.numbered(X.saved(spark, d).select("doc_id", "cid"), ["doc_id"], "tc").select("cid", "id")


@query("w10_bucket_ranks", "SELECT cid, failure_dimension, row_number() OVER (PARTITION BY failure_dimension ORDER BY judge_average DESC, doc_id) AS bucket_rank FROM saved")
def w10(spark, d):
    return K.ranked(X.saved(spark, d), "failure_dimension", [F.col("judge_average").desc(), F.col("doc_id")], "bucket_rank").select("cid", "failure_dimension", "bucket_rank")


BEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trim(failure_dimension), {KEY.format('sq_message')} ORDER BY judge_average DESC, doc_id) AS rn FROM {{}}) WHERE rn = 1)"


@query("k4_best_of_group", f"SELECT cid FROM {BEST.format('saved')}")
def k4(spark, d):
    return K.best_of_group(X.saved(spark, d), "failure_dimension", "source_query.message", "doc_id").select("cid")


@query("k5_quotas", "WITH z AS (SELECT failure_dimension, count(*) AS n FROM saved GROUP BY 1), t AS (SELECT sum(n) AS total, sum(least(5, n)) AS floors FROM z) SELECT failure_dimension, n, least(least(5, n) + floor(greatest(200 - floors, 0) * n / total), 80, n)::BIGINT AS quota FROM z, t")
def k5_quotas(spark, d):
    return K.quotas(X.saved(spark, d), "failure_dimension", 200)


#: A stratified sample of 200 records from a table {0} like saved; {1} are the columns wanted.
STRATIFIED = """z AS (SELECT failure_dimension, count(*) AS n FROM {0} GROUP BY 1), t AS (SELECT sum(n) AS total, sum(least(5, n)) AS floors FROM z),
    q AS (SELECT failure_dimension, least(least(5, n) + floor(greatest(200 - floors, 0) * n / total), 80, n)::BIGINT AS quota FROM z, t),
    l AS (SELECT *, scenario IN ('en', 'fr', 'de', 'es') AND row_number() OVER (PARTITION BY failure_dimension, scenario ORDER BY coalesce(judge_average, 0) DESC, doc_id) = 1 AS lead FROM {0}),
    k AS (SELECT *, row_number() OVER (PARTITION BY failure_dimension ORDER BY CASE WHEN lead THEN 0 ELSE 1 END, coalesce(judge_average, 0) DESC, doc_id) AS rk FROM l),
    w AS (SELECT k.*, CASE WHEN rk <= quota THEN 'quota' ELSE 'gap' END AS stage FROM k JOIN q USING (failure_dimension))
    SELECT {1} FROM w ORDER BY CASE WHEN stage = 'quota' THEN 0 ELSE 1 END, coalesce(judge_average, 0) DESC, doc_id LIMIT 200"""


# a dialogue is one record here, so that none has several types
@query("k5_stratified_sample", "WITH " + STRATIFIED.format("saved", "cid, failure_dimension, stage"))
def k5(spark, d):
    return K.stratified(X.saved(spark, d), "failure_dimension", "doc_id", 200, ["en", "fr", "de", "es"]).select("cid", "failure_dimension", "stage")


@query(
    "k6_balanced_sample",
    """WITH r AS (SELECT cid, ground_truth, row_number() OVER (PARTITION BY ground_truth ORDER BY CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END, md5('7:' || cid), cid) AS n FROM task1)
    SELECT cid, ground_truth FROM r WHERE n <= 25""",
)
def k6(spark, d):
    s = X.task1(spark, d)
    return K.balanced(s, "ground_truth", "cid", 25, s.filter("doc_id % 2 = 0").select("cid"), seed=7).select("cid", "ground_truth")


@query("o15_golden_set", f"WITH good AS (SELECT * FROM saved WHERE {GATE} AND {SOLVABLE} AND {DIFFICULT}), best AS {BEST.format('good')}, " + STRATIFIED.format("best", "cid, failure_dimension, scenario, round(judge_average, 6) AS judge_average, stage"))
def o15(spark, d):
    s = X.saved(spark, d)
    good = s.filter(C.quality_gate(s)).filter(_solvable()).filter(C.difficult(s))
    chosen = K.stratified(K.best_of_group(good, "failure_dimension", "source_query.message", "doc_id"), "failure_dimension", "doc_id", 200, ["en", "fr", "de", "es"])
    return chosen.select("cid", "failure_dimension", "scenario", F.round("judge_average", 6).alias("judge_average"), "stage")


@query(
    "a6_golden_stages",
    f"""WITH b AS (SELECT *, {GATE} AS g, {GATE} AND {SOLVABLE} AS so, {GATE} AND {SOLVABLE} AND {DIFFICULT} AS di FROM saved)
    SELECT failure_dimension, scenario, count(*) AS n, count(*) FILTER (g) AS n_quality, count(*) FILTER (so) AS n_solvable, count(*) FILTER (di) AS n_difficult, round(avg(judge_average), 4) AS average FROM b GROUP BY ALL""",
)
def a6(spark, d):
    s = X.saved(spark, d)
    gate, solvable, hard = C.quality_gate(s), _solvable(), C.difficult(s)
    return s.groupBy("failure_dimension", "scenario").agg(F.count("*").alias("n"), F.count_if(gate).alias("n_quality"), F.count_if(gate & solvable).alias("n_solvable"), F.count_if(gate & solvable & hard).alias("n_difficult"), F.round(F.avg("judge_average"), 4).alias("average"))


FACETS = ("failure_dimension", "scenario", "signal_type", "signal_confidence", "representativeness", "overall_quality", "difficulty", "severity_tier")
HISTORY = "CASE WHEN k = 0 THEN '0' WHEN k <= 2 THEN '1-2' WHEN k <= 5 THEN '3-5' WHEN k <= 10 THEN '6-10' WHEN k <= 15 THEN '11-15' ELSE '16+' END"


@query(
    "a7_facet_report",
    "WITH n AS (SELECT *, (SELECT count(*) FROM turns t WHERE t.cid = s.h AND t.turn_index < s.sq_turn) AS k FROM saved s), u AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS facet, coalesce({f}, '{'None' if f == 'severity_tier' else 'Unknown'}') AS value FROM n" for f in FACETS)
    + f""" UNION ALL SELECT 'depth', CASE WHEN sq_turn = 0 THEN '0' WHEN sq_turn <= 2 THEN '1-2' WHEN sq_turn <= 5 THEN '3-5' ELSE '6-10' END FROM n UNION ALL SELECT 'history', {HISTORY} FROM n
    UNION ALL SELECT 'needs_context', 'true' FROM n WHERE needs_context UNION ALL SELECT 'needs_image', 'true' FROM n WHERE needs_image)
    SELECT facet, value, CASE facet WHEN 'depth' THEN list_position(['0', '1-2', '3-5', '6-10'], value) - 1 WHEN 'history' THEN list_position(['0', '1-2', '3-5', '6-10', '11-15', '16+'], value) - 1 END AS position, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM saved), 1) AS pct FROM u GROUP BY ALL""",
)
def a7(spark, d):
    """All counters of the report in one pass; the two bucketed ones have their places, and each value its share."""
    s = X.saved(spark, d, histories=True)
    named = {f: F.coalesce(f, F.lit("None" if f == "severity_tier" else "Unknown")) for f in FACETS}
    named |= {"depth": T.depth_bucket(F.col("source_query.turn_index")), "history": T.history_bucket(F.size("selected_history"))}
    named |= {f: F.when(F.col(f), "true") for f in ("needs_context", "needs_image")}
    counts = V.facet_counts(s, named, {}).filter("value is not null").select("facet", "value", "n")
    place = F.when(F.col("facet") == "depth", T.position(L.DEPTH_ORDER, F.col("value"))).when(F.col("facet") == "history", T.position(L.HISTORY_ORDER, F.col("value")))
    total = s.agg(F.count("*").alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("facet", "value", place.alias("position"), "n", F.round(F.try_divide(F.col("n") * 100.0, "_total"), 1).alias("pct"))


@query("a7_axis_averages", " UNION ALL ".join(f"SELECT '{a}' AS axis, round(avg(s{i + 1}), 2) AS average FROM saved" for i, a in enumerate(X.AXES)))
def a7_axes(spark, d):
    return X.saved(spark, d).select(F.explode("judge_scores").alias("axis", "score")).groupBy("axis").agg(F.round(F.avg("score"), 2).alias("average"))


@query("p17_history_buckets", "WITH n AS (SELECT sq_turn, (SELECT count(*) FROM turns t WHERE t.cid = s.h AND t.turn_index < s.sq_turn) AS k FROM saved s), b AS (SELECT CASE WHEN k = 0 THEN '0' WHEN k <= 2 THEN '1-2' WHEN k <= 5 THEN '3-5' WHEN k <= 10 THEN '6-10' WHEN k <= 15 THEN '11-15' ELSE '16+' END AS bucket FROM n) SELECT bucket, list_position(['0', '1-2', '3-5', '6-10', '11-15', '16+'], bucket) - 1 AS position, count(*) AS n FROM b GROUP BY ALL")
def p17(spark, d):
    b = X.saved(spark, d, histories=True).select(T.history_bucket(F.size("selected_history")).alias("bucket"))
    return b.groupBy("bucket", T.position(L.HISTORY_ORDER, F.col("bucket")).alias("position")).agg(F.count("*").alias("n"))


#: The counters of the cached statistics and the columns that they count.
STATS_FACETS = ("dims:failure_dimension", "signals:signal_type", "qualities:overall_quality", "sentiments:sentiment", "severities:severity_tier")


def stats(df: DataFrame, sign: int = 1) -> DataFrame:
    """facet, value, n, total of active records: five counters, the flags, how many there are, and two sums."""
    flag = lambda c: F.when(c, "true")
    facets = {k: F.coalesce(v, F.lit("?")) for k, v in (x.split(":") for x in STATS_FACETS)}
    facets |= {"count": F.lit("true"), "n_img": flag(F.col("needs_image")), "n_ctx": flag(F.col("needs_context")), "n_qa": flag(F.col("qa_verdict").isNotNull()), "n_qa_keep": flag(F.col("qa_verdict.verdict") == "keep"), "n_has_raw": flag(F.coalesce("failure_dimension_raw", F.lit("")) != "")}
    active = df.filter(~F.coalesce("is_duplicate", F.lit(False)))
    return V.facet_counts(active, facets, {"judge_sum": F.col("judge_average"), "conf_sum": F.col("confidence")}, sign).filter("value is not null or facet in ('judge_sum', 'conf_sum')")


STATS_SQL = (
    "u AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS facet, coalesce({v}, '?') AS value, 0.0::DOUBLE AS x FROM k" for k, v in (x.split(":") for x in STATS_FACETS))
    + "".join(f" UNION ALL SELECT '{k}', 'true', 0 FROM k WHERE {v}" for k, v in (("count", "true"), ("n_img", "needs_image"), ("n_ctx", "needs_context"), ("n_qa", "qa_verdict IS NOT NULL"), ("n_qa_keep", "qa_verdict = 'keep'"), ("n_has_raw", "failure_dimension_raw <> ''")))
    + " UNION ALL SELECT 'judge_sum', NULL, judge_average FROM k UNION ALL SELECT 'conf_sum', NULL, confidence FROM k) SELECT facet, value, count(*) AS n, round(sum(x), 4) AS total FROM u GROUP BY ALL"
)


@query("a8_active_stats", f"WITH k AS (SELECT * FROM saved WHERE NOT is_duplicate), {STATS_SQL}")
def a8(spark, d):
    return stats(X.saved(spark, d)).withColumn("total", F.round("total", 4))


@query("a8_kept_stats", f"WITH k AS (SELECT * FROM saved WHERE NOT is_duplicate AND doc_id % 7 <> 0), {STATS_SQL}")
def a8_kept(spark, d):
    """The same without excluded records, from counters that saves add to and exclusions take from; no record is counted twice."""
    s, path = X.saved(spark, d), fresh(spark, "stats")
    for k in range(2):
        V.add_counts(stats(s.filter(F.col("doc_id") % 2 == k)), path, f"save{k}")
    for _ in range(2):  # a change that is tried again replaces itself
        V.add_counts(stats(s.filter("doc_id % 7 = 0"), sign=-1), path, "exclude")
    return V.current_counts(spark, path).withColumn("total", F.round(F.col("total") + 0.0, 4))


@query("s12_summary_counters", "SELECT 'quality' AS metric, overall_quality AS key, count(*)::DOUBLE AS value FROM saved GROUP BY ALL UNION ALL SELECT 'signal', signal_type, count(*)::DOUBLE FROM saved GROUP BY ALL UNION ALL SELECT 'judge_sum', 'all', round(sum(judge_average), 4) FROM saved")
def s12(spark, d):
    s = X.saved(spark, d)
    rows = F.explode(F.array(F.struct(F.lit("quality").alias("metric"), F.col("overall_quality").alias("key"), F.lit(1.0).alias("v")), F.struct(F.lit("signal").alias("metric"), F.col("signal_type").alias("key"), F.lit(1.0).alias("v")), F.struct(F.lit("judge_sum").alias("metric"), F.lit("all").alias("key"), F.col("judge_average").alias("v"))))
    return s.select(rows.alias("r")).groupBy("r.metric", "r.key").agg(F.round(F.sum("r.v"), 4).alias("value"))


@query("j4_candidates_with_judgements", "SELECT c.cid, c.idx, j.should_keep::INT AS should_keep, j.overall_quality FROM candidates c LEFT JOIN judge_out j ON j.cid = c.cid AND j.candidate_index = c.idx")
def j4(spark, d):
    # the judge's results as it gives them: a list per dialogue
    lists = X.judge_out(spark, d).groupBy("cid").agg(F.collect_list(F.struct("candidate_index", "should_keep", "overall_quality")).alias("results"))
    j = lists.select("cid", F.explode("results").alias("r")).select("cid", F.col("r.candidate_index").alias("idx"), F.col("r.should_keep").cast("int").alias("should_keep"), "r.overall_quality")
    return X.candidates(spark, d).select("cid", "idx").join(j, ["cid", "idx"], "left")


@query("o2_corrections", "SELECT c.cid, c.idx, coalesce(j.corrected_dimension, c.failure_dimension) AS failure_dimension FROM candidates c LEFT JOIN judge_out j ON j.cid = c.cid AND j.candidate_index = c.idx")
def o2(spark, d):
    return C.routed(X.candidates(spark, d), X.judge_out(spark, d)).select("cid", "idx", "failure_dimension")


ROUTES = f"""{SIGNALS}, pf AS (SELECT cid, arg_min(regexp_extract(message, '{X.UNSAFE}', 0, 'i'), pos) FILTER (regexp_matches(message, '{X.UNSAFE}', 'i')) AS x, bool_and(interrupted) FILTER (role = 'assistant') AS alli, count(*) AS n FROM s GROUP BY cid),
  rt AS (SELECT c.cid, c.idx, CASE WHEN pf.n < 2 THEN 'prefilter:too_short' WHEN pf.alli THEN 'prefilter:all_interrupted' WHEN pf.x IS NOT NULL THEN 'prefilter:unsafe_match:' || pf.x END AS pre, j.should_keep, j.overall_quality, c.confidence,
    CASE WHEN pre IS NOT NULL THEN 'deleted' WHEN should_keep IS NULL THEN CASE WHEN confidence >= 0.6 THEN 'saved' ELSE 'rejected' END WHEN should_keep THEN 'saved' ELSE 'rejected' END AS route,
    CASE WHEN pre IS NOT NULL THEN NULL WHEN should_keep IS NULL THEN CASE WHEN confidence >= 0.6 THEN 'medium' END ELSE overall_quality END AS quality,
    CASE WHEN pre IS NOT NULL THEN pre WHEN should_keep IS NULL THEN CASE WHEN confidence < 0.6 THEN 'judge_batch_missed_low_conf' END WHEN NOT should_keep THEN 'judge_rejected:' || coalesce(overall_quality, 'low') END AS reason
    FROM candidates c LEFT JOIN judge_out j ON j.cid = c.cid AND j.candidate_index = c.idx LEFT JOIN pf ON pf.cid = c.cid)"""


def _routed(spark, d) -> DataFrame:
    return C.routed(X.candidates(spark, d), X.judge_out(spark, d), O.prefilter(O.signals(X.turns(spark, d)), X.UNSAFE))


@query("o3_routes", f"WITH {ROUTES} SELECT cid, idx, route, quality, reason FROM rt")
def o3(spark, d):
    return _routed(spark, d).select("cid", "idx", "route", "quality", "reason")


@query("a10_run_stats", f"WITH {ROUTES} SELECT route, quality, count(*) AS n FROM rt GROUP BY ALL")
def a10(spark, d):
    return _routed(spark, d).groupBy("route", "quality").agg(F.count("*").alias("n"))


@query("s9_routed_rows", f"WITH {ROUTES} SELECT route, cid, idx FROM rt")
def s9(spark, d):
    path = fresh(spark, "routes")
    _routed(spark, d).select("route", "cid", "idx").write.partitionBy("route").parquet(path)
    return spark.read.schema("cid string, idx int, route string").parquet(path)


@query(
    "o4_saved_records",
    f"""WITH {ROUTES}, {REACTED_ONLY} SELECT rt.cid, rt.idx, '2024-02-01 00:00:00' AS save_time, CASE WHEN c.n % 2 = 0 THEN 'failure_testcase' ELSE 'query_testcase' END AS tag, c.source_query_turn_id AS source_turn, (SELECT coalesce(max(t.message), '') FROM turns t WHERE t.cid = rt.cid AND t.turn_index = c.source_query_turn_id) AS query,
    coalesce((SELECT string_agg(t.turn_index, ',' ORDER BY pos) FROM turns t WHERE t.cid = rt.cid AND t.turn_index < c.source_query_turn_id), '') AS selected, (SELECT count(*) FROM turns t WHERE t.cid = rt.cid) AS n_history, coalesce((SELECT count(*) FROM r WHERE r.cid = rt.cid AND r.dissatisfied), 0) AS total_dissatisfied,
    c.dislike_turn_id, {quoted(L.OTHER)} AS failure_dimension, coalesce(CASE WHEN c.n % 7 = 0 AND j.cid IS NOT NULL THEN 'corrected' END, c.failure_dimension) AS failure_dimension_raw, ['writing', 'coding', 'chat'][(c.n % 3 + 1)::INT] AS scenario, CASE WHEN c.n % 2 = 0 THEN 'explicit' ELSE 'implicit' END AS sentiment,
    CASE WHEN c.n % 3 = 0 THEN 'not right' END AS complaint_snippet, 'turn ' || c.n AS explanation, CASE WHEN c.n % 4 <> 0 THEN CASE WHEN c.n % 2 = 0 THEN 'repeat' ELSE 'rephrase' END ELSE 'dislike' END AS signal_type, CASE WHEN c.n % 5 <> 0 THEN 'medium' ELSE 'high' END AS signal_confidence,
    (SELECT substring(coalesce(max(t.message), ''), 1, 200) FROM turns t WHERE t.cid = rt.cid AND t.turn_index = c.dislike_turn_id) AS agent_response_preview, CASE WHEN c.n % 4 <> 0 THEN 'repeat' ELSE '' END AS user_reaction_after_failure, (c.n % 2 = 0)::INT AS recovery_attempted, (c.n % 6 = 0)::INT AS recovery_successful,
    CASE WHEN c.n % 5 = 0 THEN 'low' ELSE 'high' END AS representativeness, round(c.confidence, 6) AS confidence, CASE WHEN j.cid IS NOT NULL THEN (1 + c.n % 5) || ',' || (1 + c.n % 3) END AS judge_scores, CASE WHEN j.cid IS NOT NULL THEN round((2 + c.n % 5 + c.n % 3) / 2.0::DOUBLE, 6) END AS judge_average, rt.quality AS overall_quality,
    CASE WHEN j.cid IS NOT NULL THEN 'audit ' || c.n END AS judge_audit, 'miner' AS miner_model, CASE WHEN j.cid IS NOT NULL THEN 'judge' END AS judge_model, round((c.n % 7) / 10.0::DOUBLE, 6) AS miner_latency_s, CASE WHEN j.cid IS NOT NULL THEN round((c.n % 9) / 10.0::DOUBLE, 6) END AS judge_latency_s,
    c.n % 100 + CASE WHEN j.cid IS NOT NULL THEN c.n % 50 ELSE 0 END AS total_tokens
    FROM rt JOIN candidates c ON c.cid = rt.cid AND c.idx = rt.idx LEFT JOIN judge_out j ON j.cid = rt.cid AND j.candidate_index = rt.idx WHERE route = 'saved'""",
)
def o4(spark, d):
    t = X.turns(spark, d)
    preview = t.select("cid", F.col("turn_index").alias("dislike_turn_id"), F.substring("message", 1, 200).alias("agent_response_preview"))
    mined = X.mined(spark, d).join(preview, ["cid", "dislike_turn_id"], "left")
    routed = C.routed(mined, X.judge_out(spark, d), O.prefilter(O.signals(t), X.UNSAFE))
    enriched = O.enriched(t, similarity="jaccard", **LEXICON)
    e = C.saved_entries(routed, X.dialogues(t), enriched, F.timestamp_seconds(F.lit(1706745600)))
    assert len(e.schema["auto_label"].dataType.fields) == 24
    label = e.select("*", "auto_label.*")
    flat = {
        "tag": F.get("tags", F.lit(0)), "source_turn": F.col("source_query.turn_index"), "query": F.col("source_query.message"), "selected": F.array_join(F.transform("selected_turn_indices", lambda x: x.cast("string")), ","), "n_history": F.size("full_history").cast("long"),
        "total_dissatisfied": F.coalesce(F.col("enrichment.total_dissatisfied").cast("long"), F.lit(0)), "recovery_attempted": F.col("recovery_attempted").cast("int"), "recovery_successful": F.col("recovery_successful").cast("int"),
        "judge_scores": F.when(F.col("judge_scores").isNotNull(), F.concat_ws(",", F.col("judge_scores")["severity"].cast("int").cast("string"), F.col("judge_scores")["representativeness"].cast("int").cast("string"))),
    } | {c: F.round(c, 6) for c in ("confidence", "judge_average", "miner_latency_s", "judge_latency_s")}
    return label.withColumns(flat).drop("auto_label", "enrichment", "tags", "source_query", "selected_turn_indices", "selected_history", "full_history")


@query("j6_review_verdicts", "SELECT doc_id, coalesce(v1, 'keep') AS verdict, CASE WHEN v1 IS NULL THEN 'qa_parse_miss' ELSE '' END AS notes FROM documents LEFT JOIN qa_out USING (doc_id)")
def j6(spark, d):
    q = X.qa_out(spark, d).select("doc_id", F.struct(F.col("v1").alias("verdict"), F.lit("").alias("notes")).alias("v"))
    default = F.struct(F.lit("keep").alias("verdict"), F.lit("qa_parse_miss").alias("notes"))
    return X.table(spark, d, "documents").select("doc_id").join(q, "doc_id", "left").select("doc_id", F.coalesce("v", default).alias("v")).select("doc_id", "v.verdict", "v.notes")


MERGED = "CASE WHEN v1 IS NULL AND c2 IS NULL THEN 'keep' WHEN v1 IS NULL THEN c2 WHEN c2 IS NULL THEN v1 WHEN v1 = 'reject' AND c2 = 'reject' THEN 'reject' WHEN v1 = 'reject' OR c2 = 'reject' OR v1 = 'downgrade' OR c2 = 'downgrade' THEN 'downgrade' ELSE 'keep' END"
CONFIRMED = "q AS (SELECT d.doc_id, v1, CASE WHEN v1 = 'reject' THEN v2 END AS c2, issues1, issues2, corrected_dimension FROM documents d LEFT JOIN qa_out USING (doc_id))"


def _confirmed(spark, d) -> DataFrame:
    """First verdicts, with second ones for rejects only."""
    q = X.qa_out(spark, d)
    second = q.filter("v1 = 'reject'").select("doc_id", F.col("v2").alias("c2"))
    return X.table(spark, d, "documents").select("doc_id", "source").join(q, "doc_id", "left").join(second, "doc_id", "left")


@query("o5_merged_verdicts", f"WITH {CONFIRMED} SELECT doc_id, {MERGED} AS verdict FROM q")
def o5(spark, d):
    c = _confirmed(spark, d)
    return c.select("doc_id", C.merged_verdicts(c, "v1", "c2").alias("verdict"))


@query("a13_review_outcomes", f"WITH {CONFIRMED}, m AS (SELECT {MERGED} AS verdict FROM q) SELECT verdict, count(*) AS n FROM m GROUP BY 1")
def a13(spark, d):
    c = _confirmed(spark, d)
    return c.groupBy(C.merged_verdicts(c, "v1", "c2").alias("verdict")).agg(F.count("*").alias("n"))


@query("o6_review_applied", f"WITH {CONFIRMED}, m AS (SELECT doc_id, {MERGED} AS verdict, corrected_dimension FROM q) SELECT m.doc_id, CASE WHEN verdict = 'reject' THEN 'rejected' ELSE 'kept' END AS route, CASE WHEN verdict = 'downgrade' THEN 'medium' ELSE s.overall_quality END AS quality, coalesce(corrected_dimension, s.failure_dimension) AS failure_dimension FROM m JOIN saved s ON s.doc_id = m.doc_id")
def o6(spark, d):
    c = _confirmed(spark, d)
    m = c.select("doc_id", C.merged_verdicts(c, "v1", "c2").alias("verdict"), "corrected_dimension").join(X.saved(spark, d).select("doc_id", "overall_quality", "failure_dimension"), "doc_id")
    return m.select("doc_id", F.when(F.col("verdict") == "reject", "rejected").otherwise("kept").alias("route"), F.when(F.col("verdict") == "downgrade", "medium").otherwise(F.col("overall_quality")).alias("quality"), F.coalesce("corrected_dimension", "failure_dimension").alias("failure_dimension"))


@query("u2_kept_and_rejected", f"WITH {CONFIRMED}, m AS (SELECT {MERGED} AS verdict, doc_id FROM q) SELECT doc_id, CASE WHEN verdict = 'reject' THEN 'rejected' ELSE 'kept' END AS part FROM m")
def u2(spark, d):
    c = _confirmed(spark, d)
    m = c.select("doc_id", C.merged_verdicts(c, "v1", "c2").alias("verdict"))
    parts = m.filter("verdict = 'reject'").withColumn("part", F.lit("rejected")).unionByName(m.filter("verdict <> 'reject'").withColumn("part", F.lit("kept")))
    return parts.select("doc_id", "part")


@query("u4_issue_union", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(issues1, []), coalesce(issues2, [])))), ',') AS issues FROM qa_out")
def u4(spark, d):
    none = F.array().cast("array<string>")
    return X.qa_out(spark, d).select("doc_id", F.array_join(F.sort_array(F.array_union(F.coalesce("issues1", none), F.coalesce("issues2", none))), ",").alias("issues"))


@query("u3_exclusion", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'excluded' ELSE 'main' END AS part FROM documents")
def u3(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id")
    out = docs.filter("doc_id % 7 = 0")
    return docs.join(out, "doc_id", "left_anti").withColumn("part", F.lit("main")).unionByName(docs.join(out, "doc_id", "left_semi").withColumn("part", F.lit("excluded")))


@query("u5_distinct_dialogues", "WITH h AS (SELECT cid, md5(string_agg(role || ':' || message, '|' ORDER BY pos)) AS k FROM turns GROUP BY cid) SELECT min(cid) AS cid, count(*) AS n FROM h GROUP BY k")
def u5(spark, d):
    h = X.dialogues(X.turns(spark, d)).select("cid", F.sha2(F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["message"])), "|"), 256).alias("k"))
    return h.groupBy("k").agg(F.min("cid").alias("cid"), F.count("*").alias("n")).drop("k")


_NEW = ["事实性错误", "bad label", None, "指令遵循失败"]


@query("o7_reclassified", f"WITH o AS (SELECT doc_id, doc_id // 17 AS k FROM saved WHERE failure_dimension = '其他'), r AS (SELECT doc_id, ['事实性错误', 'bad label', NULL, '指令遵循失败'][(k % 4 + 1)::INT] AS nd, k FROM o WHERE k % 5 <> 0) SELECT o.doc_id, CASE WHEN nd IN {sql_list(L.REVIEW_DIMENSIONS)} THEN nd ELSE '其他' END AS failure_dimension, CASE WHEN r.doc_id IS NULL THEN 0.0 WHEN r.k % 3 = 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM o LEFT JOIN r USING (doc_id)")
def o7(spark, d):
    other = X.saved(spark, d).filter(F.col("failure_dimension") == L.OTHER).select("doc_id", F.expr("doc_id div 17").alias("k"))
    answers = other.filter("k % 5 <> 0").select("doc_id", F.get(F.array(*map(F.lit, _NEW)), (F.col("k") % 4).cast("int")).alias("nd"), F.when(F.col("k") % 3 != 0, 0.5).alias("conf"), F.lit(True).alias("there"))
    j = other.join(answers, "doc_id", "left")
    valid = F.when(F.col("nd").isin(L.REVIEW_DIMENSIONS), F.col("nd")).otherwise(L.OTHER)
    return j.select("doc_id", valid.alias("failure_dimension"), F.when(F.col("there").isNull(), 0.0).otherwise(F.coalesce("conf", F.lit(0.8))).alias("confidence"))


@query(
    "o8_enhanced",
    f"""WITH q AS (SELECT *, {_DIMENSION.replace('raw', 'failure_dimension')} AS dimension, CASE WHEN s4 >= 4 THEN 'critical' WHEN s4 >= 3 THEN 'moderate' ELSE 'mild' END AS tier,
      (regexp_matches(sq_message, '{X.IMAGE}') OR (SELECT coalesce(bool_or(contains(t.message, '[图片]') OR contains(t.message, '用户上传了图片')), false) FROM turns t WHERE t.cid = s.h AND t.pos - (SELECT min(pos) FROM turns m WHERE m.cid = s.h) < 5))::INT AS image, (s1 <= 2)::INT AS context,
      (sq_turn > dislike_turn_id AND EXISTS (SELECT 1 FROM turns t WHERE t.cid = s.h AND t.role = 'user' AND t.turn_index < s.dislike_turn_id)) AS fixed FROM saved s)
    SELECT dimension, tier, image, context, (SELECT count(*) > 1 FROM saved z WHERE z.cid = q.cid)::INT AS duplicate, count(*) AS n, count(*) FILTER (fixed) AS n_fixed FROM q GROUP BY ALL""",
)
def o8(spark, d):
    s = C.repaired_order(X.saved(spark, d, histories=True))
    e = C.normalised(s, "failure_dimension").withColumns({"image": T.needs_image(F.col("source_query.message"), F.col("full_history"), X.IMAGE).cast("int"), "context": T.needs_context(F.col("judge_scores")["query_completeness"]).cast("int"), "tier": T.severity_tier(F.col("judge_scores")["severity"])})
    # texts and histories meet once
    e = materialize(e.select("doc_id", "cid", "dislike_turn_id", "source_query", "judge_average", "dimension", "tier", "image", "context", "ordering_fixed"), "enhanced")
    e = e.join(C.near_duplicates(e, "doc_id", compared=None).select(F.col("id").alias("doc_id"), "duplicate_of"), "doc_id", "left")
    return e.groupBy("dimension", "tier", "image", "context", F.col("duplicate_of").isNotNull().cast("int").alias("duplicate")).agg(F.count("*").alias("n"), F.count_if("ordering_fixed").alias("n_fixed"))


HAY = "lower(concat_ws(' ', sq_message, coalesce(failure_dimension, ''), coalesce(explanation, ''), coalesce(judge_audit, '')))"


def _haystack():
    return [F.coalesce(c, F.lit("")) for c in ("source_query.message", "failure_dimension", "explanation", "judge_audit")]


@query("f6_faceted_search", f"SELECT cid FROM saved WHERE scenario = 'en' AND contains({HAY}, 'the th')")
def f6(spark, d):
    hay = F.lower(F.concat_ws(" ", *_haystack()))
    return X.saved(spark, d).filter((F.col("scenario") == "en") & F.contains(hay, F.lit("the th"))).select("cid")


@query("f6_indexed_search", f"SELECT cid, 'zuu' AS needle FROM saved WHERE contains({HAY}, 'zuu') UNION ALL SELECT cid, 'Audit of src1 ' FROM saved WHERE difficulty = 'hard' AND contains({HAY} || ' ', 'audit of src1 ')")
def f6_indexed(spark, d):
    """Substrings looked for in an index of grams by block."""
    path = fresh(spark, "search")
    V.write_search(X.saved(spark, d).select("cid", "difficulty", "source_query", "failure_dimension", "explanation", "judge_audit"), "cid", [*_haystack(), F.lit("")], path)
    one = V.search(spark, path, "zuu").select("cid", F.lit("zuu").alias("needle"))
    return one.unionByName(V.search(spark, path, "Audit of src1 ", difficulty="hard").select("cid", F.lit("Audit of src1 ").alias("needle")))
