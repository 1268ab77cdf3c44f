"""Queries on evaluation: prompts, verdicts, metrics, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import lexicons as L
from verdigris.functions import text as T
from verdigris.operators import evaluate as E
from verdigris.operators import sampling as K
from verdigris.operators import serving as V
from verdigris.plans.registry import query
from verdigris.sources import fixtures as X
from verdigris.sources.shared import fresh

TEMPLATE = "[{context}]<{prompt}>({response})"


@query("s7_labelled_union", "SELECT cid, coalesce(CASE WHEN doc_id % 3 = 0 THEN ground_truth END, -1) AS ground_truth FROM task1 WHERE ground_truth = -1 UNION ALL SELECT cid, coalesce(CASE WHEN doc_id % 3 = 0 THEN ground_truth END, 1) FROM task1 WHERE ground_truth = 1")
def s7(spark, d):
    t = X.task1(spark, d)
    part = lambda v: t.filter(F.col("ground_truth") == v).withColumn("ground_truth", F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.col("ground_truth")), F.lit(v)))
    return part(-1).unionByName(part(1), allowMissingColumns=True).select("cid", "ground_truth")


VERDICT = "CASE raw_output WHEN '好' THEN 1 WHEN '差。' THEN -1 WHEN '不好' THEN 1 ELSE CASE WHEN contains(raw_output, '令用户满意') THEN 1 END END"
NOTE = "CASE WHEN raw_output = '好' THEN 'exact_content' WHEN raw_output = '差。' THEN 'starts_content' WHEN raw_output = '不好' THEN 'ends_content' WHEN contains(raw_output, '令用户满意') THEN 'kw_good_content' ELSE 'cannot_parse' END"


@query("p19_verdicts", f"SELECT model, {VERDICT} AS verdict, {NOTE} AS note, count(*) AS n FROM task1 GROUP BY ALL")
def p19(spark, d):
    t = X.task1(spark, d).withColumn("v", T.verdict(F.col("raw_output")))
    return t.groupBy("model", "v.verdict", "v.note").agg(F.count("*").alias("n"))


@query("p20_binary_verdicts", "SELECT model, CASE WHEN contains(raw_output, 'verdict') THEN 1 END AS verdict, CASE WHEN raw_output = '' THEN 'empty' WHEN contains(raw_output, 'verdict') THEN 'json_full' ELSE 'no_verdict_found' END AS note, count(*) AS n FROM task1 GROUP BY ALL")
def p20(spark, d):
    t = X.task1(spark, d).withColumn("v", T.binary_verdict(F.col("raw_output")))
    return t.groupBy("model", "v.verdict", "v.note").agg(F.count("*").alias("n"))


@query(
    "p21_json_extraction",
    """SELECT model, CASE WHEN contains(raw_output, 'verdict') THEN '' WHEN raw_output = '' AND doc_id % 3 = 2 THEN 'empty_output' ELSE 'no_json_found' END AS error, contains(raw_output, 'verdict')::INT AS found, count(*) AS n
    FROM task1 GROUP BY ALL""",
)
def p21(spark, d):
    wrapped = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Answer: "), "raw_output", F.lit(" done"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```json\n"), "raw_output", F.lit("\n```"))).otherwise(F.col("raw_output"))
    out = E.extracted_json(X.task1(spark, d).select("doc_id", "model", wrapped.alias("raw")), "raw")
    return out.groupBy("model", "error", F.col("parsed").isNotNull().cast("int").alias("found")).agg(F.count("*").alias("n"))


@query("p22_preference_scores", "SELECT judged_model, count(score) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS most FROM judged GROUP BY 1")
def p22(spark, d):
    top = lambda word, p: F.when(p.isNotNull(), F.struct(F.lit(word).alias("token"), p.alias("logprob")))
    tokens = F.array(F.struct(F.lit(" ").alias("token"), F.array(F.struct(F.lit("x").alias("token"), F.lit(0.0).alias("logprob"))).alias("top_logprobs")), F.struct(F.lit("好").alias("token"), F.array_compact(F.array(top(L.GOOD, F.col("good_logprob")), top(L.BAD, F.col("bad_logprob")))).alias("top_logprobs")))
    j = X.judged(spark, d).withColumn("p", E.token_logprobs(tokens)).withColumn("s", T.preference_score(F.col("p.good"), F.col("p.bad")))
    return j.groupBy("judged_model").agg(F.count("s").alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.min("s"), 6).alias("least"), F.round(F.max("s"), 6).alias("most"))


@query("p23_first_character_verdicts", "SELECT cid, CASE substring(raw_output, 1, 1) WHEN '好' THEN 1 WHEN '差' THEN -1 ELSE 0 END AS verdict FROM task1")
def p23(spark, d):
    return X.task1(spark, d).select("cid", T.first_character_verdict(F.col("raw_output")).alias("verdict"))


LINES = "(SELECT string_agg({}, {} ORDER BY pos) FROM turns t WHERE t.cid = k.cid AND t.pos < k.at)"
BOLD = "'**' || CASE WHEN role = 'user' THEN '用户' ELSE 'AI' END || '：** ' || message"


@query("p24_judge_prompts", f"SELECT cid, md5('[' || coalesce({LINES.format(BOLD, 'chr(10)')}, '（无历史对话）') || ']<' || query || '>(' || 'ok' || ')') AS prompt FROM task2 k")
def p24(spark, d):
    return X.task2(spark, d).select("cid", F.md5(E.judge_prompt(F.col("history"), F.col("query"), F.lit("ok"), TEMPLATE)).alias("prompt"))


@query("p25_two_section_prompts", f"SELECT cid, md5('## 对话历史' || coalesce(chr(10) || chr(10) || {LINES.format(BOLD, 'chr(10) || chr(10)')}, '') || chr(10) || chr(10) || chr(10) || '## 当前轮' || chr(10) || chr(10) || '**用户提问：**' || chr(10) || query || chr(10) || chr(10) || chr(10) || '**AI 回复：**' || chr(10) || 'ok') AS prompt FROM task2 k")
def p25(spark, d):
    return X.task2(spark, d).select("cid", F.md5(E.two_section_prompt(F.col("history"), F.col("query"), F.lit("ok"))).alias("prompt"))


def _cut(n: str, size: str) -> str:
    lines = f"(SELECT string_agg(CASE WHEN role = 'user' THEN '用户' ELSE 'AI' END || '：' || message, chr(10) ORDER BY pos) FROM (SELECT *, row_number() OVER (ORDER BY pos DESC) AS b FROM turns t WHERE t.cid = k.cid AND t.pos < k.at) WHERE b <= {n})"
    answer = f"CASE WHEN length(query) > {size} THEN substring(query, 1, {size}) || '...[截断]' ELSE query END" if size else "query"
    return f"'[' || coalesce({lines}, '无') || ']<' || query || '>(' || {answer} || ')'"


@query("p26_truncation_ladder", f"WITH l AS (SELECT cid, {_cut('1000000', '')} AS p0, {_cut('6', '4000')} AS p1, {_cut('3', '2000')} AS p2 FROM task2 k) SELECT cid, CASE WHEN length(p0) <= 2500 THEN 0 WHEN length(p1) <= 2500 THEN 1 ELSE 2 END AS level, md5(CASE level WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) AS prompt FROM l")
def p26(spark, d):
    p = E.laddered(F.col("history"), F.col("query"), F.col("query"), 2500, TEMPLATE)
    return X.task2(spark, d).select("cid", p.alias("p")).select("cid", "p.level", F.md5("p.prompt").alias("prompt"))


@query("p26_recovery_ladder", "WITH l AS (SELECT cid, query, coalesce(next_text, '') AS f FROM task2), p AS (SELECT cid, unnest([0, 4000, 2000]) AS a, unnest([0, 1000, 500]) AS b, unnest([0, 1, 2]) AS level, query, f FROM l), q AS (SELECT cid, level, '[' || CASE WHEN trim(f) <> '' THEN 'AI：' || CASE WHEN a > 0 AND length(f) > a THEN substring(f, 1, a) || '...[截断]' ELSE f END ELSE '无' END || ']<' || CASE WHEN b > 0 AND length(query) > b THEN substring(query, 1, b) || '...[截断]' ELSE query END || '>(' || CASE WHEN a > 0 AND length(f) > a THEN substring(f, 1, a) || '...[截断]' ELSE f END || ')' AS prompt FROM p) SELECT cid, min(level) FILTER (length(prompt) <= 1500 OR level = 2) AS level FROM q GROUP BY cid")
def p26_recovery(spark, d):
    after = F.coalesce(F.get("after", F.lit(0))["message"], F.lit(""))
    p = E.recovery_laddered(after, F.col("query"), after, 1500, TEMPLATE)
    return X.task2(spark, d).select("cid", p["level"].alias("level"))


@query("p32_recovery_messages", "SELECT cid, (SELECT count(*) FROM turns t WHERE t.cid = k.cid AND t.pos < k.at) + CASE WHEN coalesce(next_text, '') <> '' THEN 2 ELSE 1 END AS n, md5(coalesce((SELECT string_agg(role || message, '' ORDER BY pos) FROM turns t WHERE t.cid = k.cid AND t.pos < k.at), '') || CASE WHEN coalesce(next_text, '') <> '' THEN 'assistant' || next_text ELSE '' END || 'user' || query) AS digest FROM task2 k")
def p32(spark, d):
    m = X.task2(spark, d).select("cid", E.recovery_messages(F.col("history"), F.get("after", F.lit(0))["message"], F.col("query")).alias("m"))
    return m.select("cid", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], x["content"])), "")).alias("digest"))


def _judged1(spark, d) -> DataFrame:
    return X.task1(spark, d).withColumn("predicted", T.verdict(F.col("raw_output"))["verdict"])


P1 = f"p AS (SELECT *, {VERDICT} AS predicted FROM task1)"
ACC = "count(*) FILTER (ground_truth = {0} AND predicted = {0}) * 100.0::DOUBLE / greatest(count(*) FILTER (ground_truth = {0}), 1)"


@query("a2_accuracy", f"WITH {P1} SELECT model, count(*) FILTER (ground_truth = 1) AS n_good, count(*) FILTER (ground_truth = -1) AS n_bad, round({ACC.format(1)}, 2) AS good_acc, round({ACC.format(-1)}, 2) AS bad_acc, round(({ACC.format(1)} + {ACC.format(-1)}) / 2, 2) AS avg_acc FROM p GROUP BY model")
def a2(spark, d):
    return E.accuracy(_judged1(spark, d), "model")


@query("k2_accuracy_leaderboard", f"WITH {P1}, m AS (SELECT model, round(({ACC.format(1)} + {ACC.format(-1)}) / 2, 2) AS avg_acc FROM p GROUP BY model) SELECT model, avg_acc, row_number() OVER (ORDER BY avg_acc DESC, model) AS rank FROM m WHERE contains(model, 'm')")
def k2(spark, d):
    m = E.accuracy(_judged1(spark, d), "model").filter(F.contains("model", F.lit("m"))).select("model", "avg_acc")
    return E.leaderboard(m, "avg_acc")


@query("o16_judging", f"WITH {P1} SELECT cid, predicted, (predicted = ground_truth)::INT AS right, md5('[（无历史对话）]<q>(' || agent_response_full || ')') AS prompt FROM p")
def o16(spark, d):
    t = X.task1(spark, d)
    none = F.array().cast("array<struct<role:string,message:string>>")
    prompts = t.select("cid", E.judge_prompt(none, F.lit("q"), F.col("agent_response_full"), TEMPLATE).alias("prompt"), "ground_truth")
    outputs = t.select("cid", "raw_output")
    j = prompts.join(outputs, "cid").withColumn("predicted", T.verdict(F.col("raw_output"))["verdict"])
    return j.select("cid", "predicted", (F.col("predicted") == F.col("ground_truth")).cast("int").alias("right"), F.md5("prompt").alias("prompt"))


METRICS = """count(*) AS n_total, count(*) FILTER (verdict <> 0) AS n_valid, count(*) FILTER (verdict = 0) AS n_fail, count(*) FILTER (verdict = 1) AS n_good, count(*) FILTER (verdict = -1) AS n_bad,
  round(count(*) FILTER (verdict = 1) / nullif(count(*) FILTER (verdict <> 0), 0)::DOUBLE, 4) AS good_pct, round(count(*) FILTER (verdict = -1) / nullif(count(*) FILTER (verdict <> 0), 0)::DOUBLE, 4) AS bad_pct,
  round(avg(score), 4) AS score_mean, round(list_sort(list(score) FILTER (score IS NOT NULL))[(count(score) // 2 + 1)::INT], 4) AS score_p50, round(avg(score) FILTER (verdict = 1), 4) AS good_score_mean, round(avg(score) FILTER (verdict = -1), 4) AS bad_score_mean,
  round(coalesce(avg(latency_s) FILTER (latency_s > 0), 0), 3) AS avg_latency_s, CASE WHEN count(*) FILTER (verdict <> 0) = 0 THEN 'no_valid' END AS error"""


@query("a3_model_metrics", f"SELECT judged_model, {METRICS} FROM judged GROUP BY judged_model")
def a3(spark, d):
    return E.metrics(X.judged(spark, d), "judged_model")


@query("a4_metrics_by_dimension", "SELECT judged_model, coalesce(failure_dimension, 'unknown') AS dimension, count(*) FILTER (verdict = 1) AS n_good, count(*) FILTER (verdict = -1) AS n_bad FROM judged WHERE verdict IN (1, -1) GROUP BY ALL")
def a4(spark, d):
    j = X.judged(spark, d).filter(F.col("verdict").isin(1, -1))
    return j.groupBy("judged_model", F.coalesce(F.nullif("failure_dimension", F.lit("")), F.lit("unknown")).alias("dimension")).agg(F.count_if(F.col("verdict") == 1).alias("n_good"), F.count_if(F.col("verdict") == -1).alias("n_bad"))


@query("k1_leaderboards", f"WITH m AS (SELECT judged_model AS model, {METRICS} FROM judged GROUP BY ALL) SELECT model, good_pct, score_mean, row_number() OVER (ORDER BY coalesce(good_pct, -1) DESC, model) AS rank_binary, row_number() OVER (ORDER BY coalesce(score_mean, -1) DESC, model) AS rank_score FROM m")
def k1(spark, d):
    m = E.metrics(X.judged(spark, d).withColumnRenamed("judged_model", "model"), "model", median=False).select("model", "good_pct", "score_mean")
    return E.leaderboard(E.leaderboard(m, "good_pct", rank="rank_binary"), "score_mean", rank="rank_score")


#: What the recorded scorer gave for a response of n characters: its text, the log-probabilities of the two verdicts and its time.
SCORED = """v AS (SELECT r.model, r.cid, length(r.generated_response) AS z, CASE z % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 1 END AS verdict, CASE WHEN z % 5 <> 0 THEN -(z % 7) / 4.0::DOUBLE END AS g, CASE WHEN z % 4 <> 0 THEN -(z % 11) / 4.0::DOUBLE END AS b, (z % 13) / 10.0::DOUBLE AS latency_s, 'dim' || (k.n % 3) AS failure_dimension,
  CASE WHEN g IS NOT NULL AND b IS NOT NULL THEN exp(g) / (exp(g) + exp(b)) WHEN g IS NOT NULL THEN exp(g) WHEN b IS NOT NULL THEN 1 - exp(b) END AS score FROM responses r JOIN task2 k ON k.cid = r.cid WHERE trim(r.generated_response) <> '' AND NOT contains(r.generated_response, '__ERROR__'))"""


def _scored(spark, d) -> DataFrame:
    """model, cid, verdict, score, latency_s, failure_dimension of all valid responses, by the scorer's recorded outputs."""
    valid = X.responses(spark, d).filter(E.valid_response(F.col("generated_response"))).join(X.task2(spark, d), "cid")
    prompts = valid.select("cid", "model", E.laddered(F.col("history"), F.col("query"), F.col("generated_response"), 8000, TEMPLATE)["prompt"].alias("prompt"), F.concat(F.lit("dim"), F.substring("cid", 2, 20).cast("long") % 3).alias("failure_dimension"))
    n = F.length("generated_response")
    token = lambda t, every, of: F.when(n % every != 0, F.struct(F.lit(t).alias("token"), (-(n % of) / 4.0).alias("logprob")))
    top = F.array_compact(F.array(token("好", 5, 7), token("差", 4, 11), F.struct(F.lit("的").alias("token"), F.lit(-9.0).alias("logprob"))))
    blank = F.struct(F.lit(" ").alias("token"), F.array(F.struct(F.lit("\n").alias("token"), F.lit(-0.1).alias("logprob"))).alias("top_logprobs"))
    outputs = valid.select("cid", "model", F.element_at(F.array(F.lit("差"), F.lit("?"), F.lit("好")), n % 3 + 1).alias("content"), F.array(blank, F.struct(F.element_at(F.array(F.lit("差"), F.lit("?"), F.lit("好")), n % 3 + 1).alias("token"), top.alias("top_logprobs"))).alias("logprobs"), ((n % 13) / 10).alias("latency_s"))
    j = prompts.join(outputs, ["cid", "model"]).withColumn("lp", E.token_logprobs(F.col("logprobs")))
    return j.select("model", "cid", T.first_character_verdict(F.col("content")).alias("verdict"), T.preference_score(F.col("lp")["good"], F.col("lp")["bad"]).alias("score"), "latency_s", "failure_dimension")


@query("o17_scoring", f"WITH {SCORED}, m AS (SELECT model, {METRICS} FROM v GROUP BY model) SELECT *, row_number() OVER (ORDER BY coalesce(good_pct, -1) DESC, model) AS rank_binary, row_number() OVER (ORDER BY coalesce(score_mean, -1) DESC, model) AS rank_score FROM m")
def o17(spark, d):
    m = E.metrics(_scored(spark, d), "model")
    return E.leaderboard(E.leaderboard(m, "good_pct", rank="rank_binary"), "score_mean", rank="rank_score")


@query("o17_scoring_by_dimension", f"WITH {SCORED} SELECT model, failure_dimension, count(*) AS n, count(*) FILTER (verdict = 1) AS n_good, count(*) FILTER (verdict = -1) AS n_bad, round(avg(score), 4) AS score_mean FROM v GROUP BY ALL")
def o17_dimensions(spark, d):
    v = F.col("verdict")
    return _scored(spark, d).groupBy("model", "failure_dimension").agg(F.count("*").alias("n"), F.count_if(v == 1).alias("n_good"), F.count_if(v == -1).alias("n_bad"), F.round(F.avg("score"), 4).alias("score_mean"))


@query("o18_scoring_ledger", f"SELECT cid, CASE WHEN length(query) % 2 = 1 THEN '好' ELSE '差' END AS output, '' AS error FROM task2")
def o18_ledger(spark, d):
    """Half of the prompts are in the ledger already; the scorer answers in reverse order, leaves some out at first, and can't take long batches."""
    prompts, ledger = X.task2(spark, d).select("cid", F.col("query").alias("prompt")), fresh(spark, "ledger")

    def scorer(batch: list[str]) -> list[dict]:
        if len(batch) > 2 and any(len(p) % 10 == 0 for p in batch):
            raise ValueError("a batch that can't be scored")
        return [{"index": i, "output": "好" if len(p) % 2 else "差"} for i, p in enumerate(batch) if len(batch) == 1 or len(p) % 7][::-1]

    E.scored_with_ledger(prompts.filter(F.crc32("cid") % 2 == 0), "cid", scorer, ledger, slices=4)
    return E.scored_with_ledger(prompts, "cid", scorer, ledger, slices=4).select("cid", "output", "error")


@query(
    "o18_batched_scorer",
    f"SELECT cid, CASE WHEN length('[' || coalesce({LINES.format(BOLD, 'chr(10)')}, '（无历史对话）') || ']<' || query || '>(ok)') % 2 = 1 THEN 1 ELSE -1 END AS verdict FROM task2 k",
)
def o18(spark, d):
    prompts = X.task2(spark, d).select("cid", E.judge_prompt(F.col("history"), F.col("query"), F.lit("ok"), TEMPLATE).alias("prompt"))
    outputs = E.scored_in_batches(prompts, "cid", lambda batch: ["好" if len(p) % 2 else "差" for p in batch])
    return outputs.select("cid", T.first_character_verdict(F.col("output")).alias("verdict"))


@query("j1_resume", "WITH done AS (SELECT DISTINCT cid FROM (SELECT cid FROM turns WHERE conv_id % 3 = 0 UNION ALL SELECT cid FROM turns WHERE is_unliked)), a AS (SELECT DISTINCT cid FROM turns) SELECT cid, CASE WHEN cid IN (SELECT cid FROM done) THEN 'processed' ELSE 'remaining' END AS part, (SELECT count(*) FROM a) AS n_raw, (SELECT count(*) FROM a WHERE cid NOT IN (SELECT cid FROM done)) AS n_remaining FROM a")
def j1(spark, d):
    t = X.turns(spark, d)
    a = t.select("cid").distinct()
    done = t.filter(F.substring("cid", 2, 20).cast("long") % 3 == 0).select("cid").union(t.filter("is_unliked").select("cid")).distinct().withColumn("done", F.lit(True))
    marked = a.join(done, "cid", "left")
    totals = marked.agg(F.count("*").alias("n_raw"), F.count_if(F.col("done").isNull()).alias("n_remaining"))  # one row
    return marked.select("cid", F.when(F.col("done"), "processed").otherwise("remaining").alias("part")).crossJoin(F.broadcast(totals))


@query("u1_known_dialogues", "SELECT DISTINCT cid FROM (SELECT cid FROM turns WHERE conv_id % 3 = 0 UNION ALL SELECT cid FROM turns WHERE is_unliked)")
def u1(spark, d):
    t = X.turns(spark, d)
    return t.filter(F.substring("cid", 2, 20).cast("long") % 3 == 0).select("cid").union(t.filter("is_unliked").select("cid")).distinct()


@query("j2_completed", "WITH r AS (SELECT 'u' || (event_id % 1000) AS cid, event_id AS line, CASE WHEN verdict <> 0 THEN verdict END AS verdict FROM judged) SELECT cid, min(line) FILTER (verdict IS NOT NULL) AS first_line, max(line) FILTER (verdict IS NOT NULL) AS last_line FROM r GROUP BY cid HAVING count(verdict) > 0")
def j2(spark, d):
    r = X.judged(spark, d).select(F.concat(F.lit("u"), F.col("event_id") % 1000).alias("cid"), F.col("event_id").alias("line"), F.when(F.col("verdict") != 0, F.col("verdict")).alias("verdict"))
    first = E.completed(r, "line", "first").select("cid", F.col("line").alias("first_line"))
    return first.join(E.completed(r, "line", "last").select("cid", F.col("line").alias("last_line")), "cid")


J3 = "CASE WHEN k.cid IS NULL THEN 'no_query' WHEN trim(r.generated_response) = '' THEN 'no_response' WHEN contains(r.generated_response, '__ERROR__') THEN 'error' ELSE 'ok' END"


def _matched(spark, d) -> DataFrame:
    k = X.task2(spark, d).select("cid", F.lit(True).alias("known"))
    r = X.responses(spark, d).join(k, "cid", "left")
    text = F.col("generated_response")
    return r.withColumn("status", F.when(F.col("known").isNull(), "no_query").when(T.strip(text) == "", "no_response").when(F.contains(text, F.lit("__ERROR__")), "error").otherwise("ok"))


@query("j3_responses_with_queries", f"SELECT model, {J3} AS status, count(*) AS n FROM responses r LEFT JOIN task2 k ON k.cid = r.cid GROUP BY ALL")
def j3(spark, d):
    return _matched(spark, d).groupBy("model", "status").agg(F.count("*").alias("n"))


@query("f7_valid_responses", f"SELECT r.cid, r.model FROM responses r LEFT JOIN task2 k ON k.cid = r.cid WHERE {J3} = 'ok'")
def f7(spark, d):
    return _matched(spark, d).filter(E.valid_response(F.col("generated_response")) & F.col("known").isNotNull()).select("cid", "model")


@query("a16_generation_counts", "SELECT model, count(*) FILTER (trim(generated_response) <> '' AND NOT contains(generated_response, '__ERROR__')) AS n_ok, count(*) FILTER (trim(generated_response) = '' OR contains(generated_response, '__ERROR__')) AS n_failed FROM responses GROUP BY model")
def a16(spark, d):
    ok = E.valid_response(F.col("generated_response"))
    return X.responses(spark, d).groupBy("model").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"))


@query("a11_blind_evaluation", f"WITH {P1} SELECT count(predicted) AS done, count(*) FILTER (predicted = ground_truth) AS correct, round(count(*) FILTER (predicted = ground_truth) / nullif(count(predicted), 0)::DOUBLE, 4) AS accuracy, round(count(*) FILTER (predicted = 1 AND ground_truth = 1) / nullif(count(predicted) FILTER (ground_truth = 1), 0)::DOUBLE, 4) AS good_accuracy, round(count(*) FILTER (predicted = -1 AND ground_truth = -1) / nullif(count(predicted) FILTER (ground_truth = -1), 0)::DOUBLE, 4) AS bad_accuracy FROM p")
def a11(spark, d):
    p, t = F.col("predicted"), F.col("ground_truth")
    of = lambda v: F.round(F.try_divide(F.count_if((p == v) & (t == v)), F.count_if(p.isNotNull() & (t == v))), 4)
    return _judged1(spark, d).agg(F.count("predicted").alias("done"), F.count_if(p == t).alias("correct"), F.round(F.try_divide(F.count_if(p == t), F.count("predicted")), 4).alias("accuracy"), of(1).alias("good_accuracy"), of(-1).alias("bad_accuracy"))


_C = "count(*) FILTER ({})"
_TP, _FP, _FN, _TN = (_C.format(x) for x in ("predicted = -1 AND ground_truth = -1", "predicted = -1 AND ground_truth = 1", "ground_truth = -1 AND predicted IS DISTINCT FROM -1", "predicted = 1 AND ground_truth = 1"))
_GN, _GM = _C.format("predicted = 1 AND ground_truth = -1"), _C.format("ground_truth = 1 AND predicted IS DISTINCT FROM 1")
_F1, _F1G = f"2.0 * {_TP} / nullif(2 * {_TP} + {_FP} + {_FN}, 0)::DOUBLE", f"2.0 * {_TN} / nullif(2 * {_TN} + {_GN} + {_GM}, 0)::DOUBLE"


@query("a14_classifier_metrics", f"WITH {P1} SELECT difficulty, count(*) AS n, round(({_TP} + {_TN}) / count(*)::DOUBLE, 4) AS accuracy, round({_TP} / nullif({_TP} + {_FP}, 0)::DOUBLE, 4) AS precision, round({_TP} / nullif({_TP} + {_FN}, 0)::DOUBLE, 4) AS recall, round({_F1}, 4) AS f1, round((coalesce({_F1}, 0) + coalesce({_F1G}, 0)) / 2, 4) AS macro_f1 FROM p GROUP BY difficulty")
def a14(spark, d):
    return E.classifier_metrics(_judged1(spark, d), "difficulty")


@query("a15_three_class_verdicts", f"WITH {P1}, v AS (SELECT ground_truth, coalesce(predicted, 0) AS verdict FROM p) SELECT ground_truth, count(*) FILTER (verdict = ground_truth) AS correct, count(*) FILTER (verdict = 0) AS neutral, count(*) FILTER (verdict = -ground_truth) AS miss FROM v GROUP BY 1")
def a15(spark, d):
    v = _judged1(spark, d).withColumn("verdict", F.coalesce("predicted", F.lit(0)))
    c = lambda x: F.count_if(F.col("verdict") == x)
    return v.groupBy("ground_truth").agg(c(F.col("ground_truth")).alias("correct"), c(F.lit(0)).alias("neutral"), c(-F.col("ground_truth")).alias("miss"))


@query("k3_pages", "SELECT cid, (SELECT count(*) FROM task1) AS total FROM task1 ORDER BY doc_id LIMIT 10 OFFSET 20")
def k3(spark, d):
    path = fresh(spark, "pages")
    V.write_pages(X.task1(spark, d).select("doc_id", "cid"), ["doc_id"], path)
    return V.page(spark, path, 20, 10).select("cid", "total")


@query("k7_case_view", "SELECT cid, trim(agent_response_full, E' \\n\\t\\r') AS response FROM task1")
def k7(spark, d):
    return X.task1(spark, d).drop("ground_truth").select("cid", E.rich_text(F.col("agent_response_full")).alias("response"))


@query("p18_rich_responses", "SELECT CASE WHEN doc_id % 4 = 0 THEN 'part one' || chr(10) || 'two' WHEN doc_id % 4 = 1 THEN '[AI 回复了图片：a cat]' WHEN doc_id % 4 = 2 THEN 'from marks' ELSE '{broken' END AS response, count(*) AS n FROM documents GROUP BY 1")
def p18(spark, d):
    bodies = ['{"content":[{"type":"text","msg":"part one[](@mark_underline=1)"},{"type":"image","prompt":"x"},{"type":"deepSearch","contents":[{"msg":"two"}]}]}', '{"content":[{"type":"image","prompt":"a cat"}]}', '{"content":[],"marks":[{"content":"{no"},{"content":"from marks"}]}', "{broken"]
    raw = F.get(F.array(*map(F.lit, bodies)), (F.col("doc_id") % 4).cast("int"))
    return X.table(spark, d, "documents").groupBy(E.rich_text(raw).alias("response")).agg(F.count("*").alias("n"))


@query("j8_tag_statistics", "WITH sel AS (SELECT DISTINCT 'c' || (doc_id % (SELECT count(DISTINCT conv_id) FROM conversations)) AS cid FROM labels WHERE quality = 0), l AS (SELECT t.cid, arg_max(message, pos) AS m FROM turns t WHERE role = 'assistant' AND t.cid IN (SELECT cid FROM sel) GROUP BY t.cid), w AS (SELECT unnest(string_split(m, ',')) AS tag FROM l) SELECT trim(tag, E' \\n\\t\\r') AS tag, count(*) AS n FROM w WHERE trim(tag, E' \\n\\t\\r') <> '' GROUP BY 1")
def j8(spark, d):
    n = X.table(spark, d, "conversations").select(F.countDistinct("conv_id").alias("n"))
    chosen = X.table(spark, d, "labels").filter("quality = 0").crossJoin(F.broadcast(n)).select(F.concat(F.lit("c"), F.col("doc_id") % F.col("n")).alias("cid")).distinct()
    last = X.turns(spark, d).filter("role = 'assistant'").join(chosen, "cid", "left_semi").groupBy("cid").agg(F.max_by("message", "pos").alias("m"))
    tags = last.select(F.explode(F.split("m", ",")).alias("t")).select(T.strip(F.col("t")).alias("tag"))
    return tags.filter("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


#: Cases of each side in the sampled benchmark.
SAMPLED = 100


@query("j9_sampled_benchmark", f"WITH {P1}, r AS (SELECT cid, ground_truth, row_number() OVER (PARTITION BY ground_truth ORDER BY md5('7:' || cid), cid) AS k FROM task1), cases AS (SELECT cid, ground_truth FROM r WHERE k <= {SAMPLED}) SELECT p.model, count(*) AS n, round(count(*) FILTER (p.predicted = c.ground_truth) / count(*)::DOUBLE, 4) AS accuracy FROM p JOIN cases c ON c.cid = p.cid GROUP BY p.model")
def j9(spark, d):
    cases = K.balanced(X.task1(spark, d), "ground_truth", "cid", SAMPLED, seed=7).select("cid", F.col("ground_truth").alias("gt"))
    return _judged1(spark, d).join(cases, "cid").groupBy("model").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("predicted") == F.col("gt")) / F.count("*"), 4).alias("accuracy"))


@query("j10_wrong_judgements", f"WITH {P1} SELECT p.cid, p.predicted, t.ground_truth FROM p JOIN task1 t ON t.cid = p.cid WHERE p.predicted <> t.ground_truth")
def j10(spark, d):
    cases = X.task1(spark, d).select("cid", F.col("ground_truth").alias("gt"))
    return _judged1(spark, d).select("cid", "predicted").join(cases, "cid").filter("predicted <> gt").withColumnRenamed("gt", "ground_truth")
