"""Prompts, recorded model outputs, verdicts, metrics and leaderboards."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verdigris.functions import lexicons as L
from verdigris.functions import text as T
from verdigris.sources.shared import has_files

# Labels that scorers expect in their prompts.
USER, MODEL, NO_HISTORY, NONE = "用户", "AI", "（无历史对话）", "无"


def dialogue_lines(history: Column, form: str = "**{}：** {}", content: str = "message") -> Column:
    """Lines 'role: text' of a history."""
    before, between, after = form.split("{}")

    def line(m: Column) -> Column:
        return F.concat(F.lit(before), F.when(m["role"] == "user", USER).otherwise(MODEL), F.lit(between), F.coalesce(m[content], F.lit("")), F.lit(after))

    return F.transform(history, line)


def judge_prompt(history: Column, query: Column, response: Column, template: str = "{context}\n\n{prompt}\n\n{response}") -> Column:
    """The template with context, prompt and response put in."""
    context = F.when(F.size(history) > 0, F.array_join(dialogue_lines(history), "\n")).otherwise(NO_HISTORY)
    return filled(template, {"context": context, "prompt": query, "response": response})


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with its {name} places filled; texts that hold such places themselves stay as they are."""
    import re

    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def two_section_prompt(history: Column, query: Column, response: Column) -> Column:
    blocks = F.concat(F.array(F.lit("## 对话历史")), dialogue_lines(history), F.array(F.lit("\n## 当前轮"), F.concat(F.lit(f"**{USER}提问：**\n"), query), F.concat(F.lit(f"\n**{MODEL} 回复：**\n"), response)))
    return F.array_join(blocks, "\n\n")


LADDER = ((0, 0), (6, 4000), (3, 2000))
RECOVERY_LADDER = ((0, 0, 0), (4000, 1000, 4000), (2000, 500, 2000))


def laddered(history: Column, query: Column, response: Column, budget: int, template: str, ladder=LADDER) -> Column:
    """(level, prompt): the first of ever shorter prompts that fits the budget, or the shortest."""
    out = None
    for level, (turns, chars) in reversed(list(enumerate(ladder))):
        cut = F.when(F.size(history) > turns, F.slice(history, F.greatest(F.size(history) - turns + 1, F.lit(1)), F.lit(turns))).otherwise(history) if turns else history
        context = F.when(F.size(cut) > 0, F.array_join(dialogue_lines(cut, "{}：{}"), "\n")).otherwise(NONE)
        step = F.struct(F.lit(level).alias("level"), filled(template, {"context": context, "prompt": query, "response": T.truncated(response, chars)}).alias("prompt"))
        out = step if out is None else F.when(F.length(step["prompt"]) <= budget, step).otherwise(out)
    return out


def recovery_laddered(failed: Column, complaint: Column, response: Column, budget: int, template: str, ladder=RECOVERY_LADDER) -> Column:
    out = None
    for level, (a, b, c) in reversed(list(enumerate(ladder))):
        context = F.when(T.strip(failed) != "", F.concat(F.lit(f"{MODEL}："), T.truncated(failed, a))).otherwise(NONE)
        step = F.struct(F.lit(level).alias("level"), filled(template, {"context": context, "prompt": T.truncated(complaint, b), "response": T.truncated(response, c)}).alias("prompt"))
        out = step if out is None else F.when(F.length(step["prompt"]) <= budget, step).otherwise(out)
    return out


def recovery_messages(history: Column, failed: Column, complaint: Column) -> Column:
    """History, the failed reply if there is one, and the complaint, as (role, content)."""
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    past = F.transform(history, lambda m: turn(F.coalesce(m["role"], F.lit("user")), F.coalesce(m["message"], F.lit(""))))
    reply = F.when(F.coalesce(failed, F.lit("")) != "", F.array(turn(F.lit("assistant"), failed))).otherwise(F.slice(past, 1, 0))
    return F.concat(past, reply, F.array(turn(F.lit("user"), complaint)))


def token_logprobs(tokens: Column) -> Column:
    """(good, bad) log-probabilities at the first non-blank token position where either verdict is among the candidates.

    tokens: array of (token, top_logprobs: array of (token, logprob)).
    """
    of = lambda top, word: F.get(F.filter(top, lambda t: T.strip(t["token"]) == word), F.lit(0))["logprob"]
    found = F.filter(
        F.transform(F.filter(tokens, lambda t: T.strip(t["token"]) != ""), lambda t: F.struct(of(t["top_logprobs"], L.GOOD).alias("good"), of(t["top_logprobs"], L.BAD).alias("bad"))),
        lambda p: p["good"].isNotNull() | p["bad"].isNotNull(),
    )
    return F.get(found, F.lit(0))


def _embedded(text: str) -> tuple[str, str]:
    """The JSON value that starts at an answer's first brace, or else at its first bracket, as text, and an error code ('' if there is one)."""
    starts = [at for at in (text.find("{"), text.find("[")) if at >= 0]
    if not starts:
        return "", "no_json_found"
    try:
        value, _ = json.JSONDecoder().raw_decode(text, starts[0])
    except json.JSONDecodeError as e:
        # an answer that was cut off ends inside its value; anything else is a value that isn't JSON
        rest, pair = text[starts[0] :].rstrip(), "{}" if text[starts[0]] == "{" else "[]"
        cut = e.pos >= starts[0] + len(rest) or e.msg.startswith("Unterminated") or rest.count(pair[1]) < rest.count(pair[0])
        return "", "no_json_found" if cut else "json_decode_fail"
    return json.dumps(value, ensure_ascii=False), ""


@F.pandas_udf(StringType())
def _scan(text: pd.Series) -> pd.Series:
    return text.map(lambda t: "\x1f".join(_embedded(t)))


def extracted_json(outputs: DataFrame, column: str) -> DataFrame:
    """Adds parsed (JSON text or null) and error. Whole answers are parsed natively; only the residue is searched for a value among other text."""
    c = F.col("_clean")
    df = outputs.withColumn("_clean", T.unfenced(F.col(column)))
    whole = F.try_parse_json(c)
    bare = F.regexp_replace(F.regexp_replace(c, r"""^"+|"+$""", ""), r"""^'+|'+$""", "")
    lone = r'\{\s*"verdict"\s*:\s*(-?[01])\s*\}'
    df = df.withColumn("_step", F.when(F.coalesce(F.col(column), F.lit("")) == "", "empty").when(whole.isNotNull(), "whole").when(bare.isin("1", "-1", "0"), "bare").otherwise("scan"))
    easy = df.filter("_step <> 'scan'").select(
        *outputs.columns,
        F.when(F.col("_step") == "whole", F.to_json(whole)).when(F.col("_step") == "bare", F.concat(F.lit('{"verdict":'), bare, F.lit("}"))).alias("parsed"),
        F.when(F.col("_step") == "empty", "empty_output").when(F.col("_step") == "bare", "bare_int").otherwise("").alias("error"),
    )
    scanned = df.filter("_step = 'scan'").withColumn("_s", F.split(_scan(c), "\x1f"))
    hit = F.col("_s")[0]
    rest = scanned.select(*outputs.columns, F.when(hit != "", hit).when(c.rlike(lone), F.concat(F.lit('{"verdict":'), F.regexp_extract(c, lone, 1), F.lit("}"))).alias("parsed"), F.when(hit != "", "").when((F.col("_s")[1] == "no_json_found") & c.rlike(lone), "regex_verdict").otherwise(F.col("_s")[1]).alias("error"))
    return easy.unionByName(rest)


def _asked(scorer: Callable[[list[str]], object], prompts: list[str]) -> tuple[dict[int, str], str]:
    """Answers by index, and the error if there was one. A scorer answers with texts in order, or in any order with (index, text) or {index, output}."""
    try:
        given = list(scorer(prompts))
    except Exception as e:  # a scorer may fail in any way; its batch is asked again
        return {}, f"{type(e).__name__}: {e}"[:200]
    out: dict[int, str] = {}
    for place, x in enumerate(given):
        index, text = (x.get("index"), x.get("output")) if isinstance(x, dict) else x if isinstance(x, tuple) else (place, x)
        if isinstance(index, int) and 0 <= index < len(prompts) and text is not None:
            out.setdefault(index, str(text))
    return out, "" if len(out) == len(prompts) else "unanswered"


def scored_in_batches(prompts: DataFrame, key: str, scorer: Callable[[list[str]], object], batch: int = 20, attempts: int = 2) -> DataFrame:
    """key, output, tries, error of a scorer that takes prompts in batches. Recorded outputs need no scorer: join them on the key.

    Answers with an index are put there, whatever their order; indices out of range and second answers are ignored. What a batch
    leaves open, because the scorer raised or answered too little, is asked again together, up to attempts times, then one by one:
    a prompt that can't be scored costs none of its neighbours. Its output is null and error says why.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                texts = part["prompt"].tolist()
                found: dict[int, str] = {}
                tries, errors = [0] * len(texts), [""] * len(texts)
                rounds = [len(texts)] * attempts + [1]
                for size in rounds:
                    left = [k for k in range(len(texts)) if k not in found]
                    for j in range(0, len(left), size):
                        some = left[j : j + size]
                        answers, error = _asked(scorer, [texts[k] for k in some])
                        found |= {some[k]: v for k, v in answers.items()}
                        for k in some:
                            tries[k] += 1
                            errors[k] = "" if k in found else error
                yield pd.DataFrame({key: part[key], "output": [found.get(k) for k in range(len(texts))], "tries": tries, "error": errors})

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {prompts.schema[key].dataType.simpleString()}, output string, tries int, error string")


def scored_with_ledger(prompts: DataFrame, key: str, scorer: Callable[[list[str]], object], ledger: str, slices: int = 8, **how) -> DataFrame:
    """The answers of all prompts, asking only for those that the ledger lacks.

    The ledger is a table by slices of the key's hash. Each slice is scored and committed on its own, so a run that breaks off loses one
    slice at most, and the next run begins there; prompts that failed are asked again. A slice is compared with its own part of the ledger only.
    """
    spark = prompts.sparkSession
    kind = f"{key} {prompts.schema[key].dataType.simpleString()}, output string, tries int, error string"
    of_slice = prompts.select(key, "prompt").withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)))
    for n in range(slices):
        path = f"{ledger}/slice={n}"
        todo = of_slice.filter(F.col("_slice") == n).drop("_slice")
        if has_files(spark, path):
            todo = todo.join(spark.read.schema(kind).parquet(path).filter("output is not null").select(key), key, "left_anti")
        scored_in_batches(todo, key, scorer, **how).write.mode("append").parquet(path)
    answers = spark.read.schema(kind).parquet(*(f"{ledger}/slice={n}" for n in range(slices)))
    # the answer, or where there is none the last error
    return answers.groupBy(key).agg(F.max("output").alias("output"), F.sum("tries").alias("tries"), F.when(F.max("output").isNull(), F.max("error")).otherwise("").alias("error"))


def accuracy(results: DataFrame, *by: str, predicted: str = "predicted", truth: str = "ground_truth") -> DataFrame:
    """n_good, n_bad and the accuracies in per cent; a missing prediction is wrong."""
    p, t = F.col(predicted), F.col(truth)
    share = lambda v: F.count_if((t == v) & (p == v)) * 100.0 / F.greatest(F.count_if(t == v), F.lit(1))
    return results.groupBy(*by).agg(F.count_if(t == 1).alias("n_good"), F.count_if(t == -1).alias("n_bad"), F.round(share(1), 2).alias("good_acc"), F.round(share(-1), 2).alias("bad_acc"), F.round((share(1) + share(-1)) / 2, 2).alias("avg_acc"))


#: Ranks by which the sketched bracket of a median may be off, as a share of the rows.
SKETCH = 10_000


def upper_medians(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by, p50: the exact upper median (of n values the one at place n // 2) of each group.

    A mergeable sketch brackets the median between two values with about 4 / SKETCH of the rows between them; a second pass counts
    what lies below and, for each different value, within. No task holds the values of a group, and hot groups are pre-aggregated.
    """
    v = F.col(value)
    share = 2.0 / SKETCH
    ends = df.filter(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx(v, [0.5 - share, 0.5 + share], SKETCH).alias("_ends"))
    named = ends.select(*(F.col(c).alias(f"_{c}") for c in by), "_n", "_ends")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    low, high = F.col("_ends")[0], F.col("_ends")[1]
    # what lies below the bracket is one value; below a bracket that begins there is nothing
    slot = F.when(v < low, F.lit(float("-inf"))).when(v <= high, v)
    counts = df.filter(v.isNotNull()).join(named, same).withColumn("_v", slot).filter("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_k"), F.first("_n").alias("_n"))
    upto = F.sum("_k").over(W.partitionBy(*by).orderBy("_v"))
    return counts.withColumn("_upto", upto).filter(F.col("_upto") > F.floor(F.col("_n") / 2)).groupBy(*by).agg(F.min("_v").alias("p50"))


def metrics(judged: DataFrame, *by: str, median: bool = True) -> DataFrame:
    """Counts, shares, scores and latency of judged answers, with error 'no_valid' where nothing was judged; the median is a pass of its own."""
    v, s = F.coalesce("verdict", F.lit(0)), F.col("score")
    good, bad = F.count_if(v == 1), F.count_if(v == -1)
    g = judged.groupBy(*by).agg(
        F.count("*").alias("n_total"),
        (good + bad).alias("n_valid"),
        F.count_if(v == 0).alias("n_fail"),
        good.alias("n_good"),
        bad.alias("n_bad"),
        F.round(F.try_divide(good, good + bad), 4).alias("good_pct"),
        F.round(F.try_divide(bad, good + bad), 4).alias("bad_pct"),
        F.round(F.avg(s), 4).alias("score_mean"),
        F.round(F.avg(F.when(v == 1, s)), 4).alias("good_score_mean"),
        F.round(F.avg(F.when(v == -1, s)), 4).alias("bad_score_mean"),
        F.round(F.coalesce(F.avg(F.when(F.col("latency_s") > 0, F.col("latency_s"))), F.lit(0.0)), 3).alias("avg_latency_s"),
    )
    if median:
        m = upper_medians(judged, "score", *by).select(*(F.col(c).alias(f"_{c}") for c in by), F.round("p50", 4).alias("score_p50"))
        g = g.join(m, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*(f"_{c}" for c in by))
    return g.withColumn("error", F.when(F.col("n_valid") == 0, "no_valid"))


def leaderboard(table: DataFrame, column: str, name: str = "model", rank: str = "rank") -> DataFrame:
    """Adds the rank by a column of a table with one row a model; missing values come last."""
    return table.withColumn(rank, F.row_number().over(W.orderBy(F.coalesce(column, F.lit(-1.0)).desc(), name)))


def classifier_metrics(df: DataFrame, *by: str, predicted: str = "predicted", truth: str = "ground_truth") -> DataFrame:
    """Accuracy, and precision, recall and F1 of the bad class, macro-F1."""
    p, t = F.col(predicted), F.col(truth)
    n = lambda a, b: F.count_if((p == a) & (t == b))
    tp, fp, fn, tn = n(-1, -1), n(-1, 1), F.count_if((t == -1) & (p.isNull() | (p != -1))), n(1, 1)
    f1 = lambda a, b, c: F.try_divide(2 * a, 2 * a + b + c)
    of_good = f1(tn, n(1, -1), F.count_if((t == 1) & (p.isNull() | (p != 1))))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.try_divide(tp + tn, F.count("*")), 4).alias("accuracy"), F.round(F.try_divide(tp, tp + fp), 4).alias("precision"), F.round(F.try_divide(tp, tp + fn), 4).alias("recall"),
        F.round(f1(tp, fp, fn), 4).alias("f1"), F.round((F.coalesce(f1(tp, fp, fn), F.lit(0.0)) + F.coalesce(of_good, F.lit(0.0))) / 2, 4).alias("macro_f1"),
    )


def completed(results: DataFrame, line: str, keep: str = "first") -> DataFrame:
    """One finished record of each cid: the first or last line with a verdict, a prediction or, for 'first', a valid answer."""
    fields = [c for c in ("predicted", "verdict") if c in results.columns]
    done = F.lit(False)
    for c in fields:
        done = done | F.col(c).isNotNull()
    if keep == "first" and "generated_response" in results.columns:
        done = done | valid_response(F.col("generated_response"))
    order = F.col(line).asc() if keep == "first" else F.col(line).desc()
    return results.filter(done & (F.coalesce("cid", F.lit("")) != "")).withColumn("_n", F.row_number().over(W.partitionBy("cid").orderBy(order))).filter("_n = 1").drop("_n")


def valid_response(response: Column) -> Column:
    r = F.coalesce(response, F.lit(""))
    return (T.strip(r) != "") & ~F.contains(r, F.lit("__ERROR__"))


def rich_text(raw: Column) -> Column:
    """Readable text of an answer that may be a JSON document of typed parts; what can't be parsed stays as it is."""
    part = "struct<type:string,msg:string,content:string,prompt:string,promptHint:string,botPrompt:string,contents:array<struct<msg:string>>>"
    s = T.strip(raw)
    doc = F.from_json(s, f"struct<content:array<{part}>,marks:array<struct<content:string>>,text:string,msg:string>")
    full = lambda c: F.coalesce(c, F.lit(""))
    is_picture = lambda p: full(p["type"]).isin("image", "searchGuid", "imageGuid")
    said = F.flatten(
        F.transform(
            F.filter(doc["content"], lambda p: ~is_picture(p)),
            lambda p: F.when(full(p["type"]) == "deepSearch", F.transform(F.coalesce(p["contents"], F.array().cast("array<struct<msg:string>>")), lambda x: full(x["msg"]))).otherwise(F.array(F.when(full(p["msg"]) != "", p["msg"]).when(T.strip(p["content"]) != "", p["content"]).otherwise(""))),
        )
    )
    said = F.filter(said, lambda t: t != "")
    hints = F.filter(F.transform(F.filter(doc["content"], is_picture), lambda p: F.when(full(p["prompt"]) != "", p["prompt"]).when(p["type"] == "image", full(p["promptHint"])).otherwise(full(p["botPrompt"]))), lambda t: t != "")
    marks = F.filter(F.transform(doc["marks"], lambda m: full(m["content"])), lambda t: (t != "") & ~F.startswith(T.strip(t), F.lit("{")))
    cleaned = lambda t: T.strip(F.regexp_replace(F.regexp_replace(t, r"\[\]\(@[^)]+\)", ""), "\n{3,}", "\n\n"))
    top = F.when(full(doc["text"]) != "", doc["text"]).otherwise(full(doc["msg"]))
    return (
        F.when(full(raw) == "", "")
        .when(~F.startswith(s, F.lit("{")), s)
        .when(F.size(said) > 0, cleaned(F.array_join(said, "\n")))
        .when(F.size(hints) > 0, F.concat(F.lit("[AI 回复了图片："), F.get(hints, F.lit(0)), F.lit("]")))
        .when(F.size(marks) > 0, cleaned(F.get(marks, F.lit(0))))
        .when(top != "", cleaned(top))
        .otherwise(s)
    )
