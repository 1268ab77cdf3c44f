"""Hand-written dialogues and labels, one for each branch; expected values follow from the rules."""

from __future__ import annotations

import difflib

import pytest
from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators import curate as C
from verdigris.operators import evaluate as E
from verdigris.operators import sampling as K
from verdigris.operators import turns as O

SCHEMA = "cid string, pos int, turn_index int, role string, message string, create_time timestamp, is_unliked boolean, length int"


def dialogue(spark, *messages, cid="c"):
    """messages: (role, text[, seconds or None[, disliked]])."""
    from datetime import datetime, timedelta

    rows = []
    for i, m in enumerate(messages):
        role, text, at, bad = (*m, *(60 * i, False)[len(m) - 2 :])
        rows.append((cid, i, i, role, text, None if at is None else datetime(2026, 1, 1) + timedelta(seconds=at), bad, len(text)))
    return spark.createDataFrame(rows, SCHEMA)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, found", [("你说的不对", "不对"), ("谢谢", None), ("不对" + "好" * 299, None), ("", None), ("答非所问啊", "答非所问")])
def test_complaints(spark, text, found):
    assert value(spark, T.complaint_snippet(F.lit(text))) == found


def test_gaps_use_the_last_time_and_the_previous_message(spark):
    t = dialogue(spark, ("user", "q" * 60, 0), ("assistant", "a" * 200, 10), ("user", "next question", 15), ("assistant", "b" * 100, None), ("user", "and then", 20))
    r = {x["pos"]: x for x in O.signals(t).collect()}
    assert (r[2]["gap_s"], r[2]["gap_ratio"], r[2]["skip_read"]) == (5.0, 0.025, True)
    assert (r[4]["gap_s"], r[4]["gap_ratio"]) == (5.0, 0.05)
    assert r[3]["gap_s"] is None


@pytest.mark.parametrize(
    "reply, reaction",
    [("你说的不对", "complain"), ("算了", "short_dismiss"), ("请介绍一下北京的历史", "repeat"), ("介绍北京的历史和文化", "rephrase"), ("abcdefg hijk", "abandon"), ("好的北京", "satisfied")],
)
@pytest.mark.parametrize("kind", ["exact", "gated"])
def test_reactions(spark, reply, reaction, kind):
    t = dialogue(spark, ("user", "请介绍一下北京的历史"), ("assistant", "北京是中国的首都。"), ("user", reply))
    assert [r["reaction"] for r in O.reactions(t, similarity=kind).collect()] == [reaction]


def test_no_reply_and_two_replies_in_a_row(spark):
    t = dialogue(spark, ("user", "第一个问题是什么"), ("assistant", "回答一回答一"), ("assistant", "回答二回答二"), ("user", "算了"), ("assistant", "再见再见"))
    assert [r["reaction"] for r in O.reactions(t).orderBy("pos").collect()] == ["short_dismiss", "short_dismiss", "no_followup"]


def test_gated_labels_are_the_exact_ones(spark, sf_dir):
    from verdigris.sources import fixtures as X

    t = X.turns(spark, sf_dir)
    key = lambda kind: sorted((r["cid"], r["pos"], r["reaction"]) for r in O.reactions(t, similarity=kind).collect())
    assert key("exact") == key("gated")


def test_similarity_is_that_of_difflib_in_this_order(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", "x"), ("same", "same"), ("ab" * 120, "ba" * 120)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r["a"], r["b"]): r["s"] for r in O.sequence_similarity(df, "a", "b", "s").collect()}
    for a, b in pairs:
        assert got[a, b] == (0.0 if not a else 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio())


def test_chains(spark):
    ask, bad = ("user", "请介绍一下北京的历史"), ("assistant", "北京是中国的首都。")
    gave_up = dialogue(spark, ask, bad, ("user", "你说的不对"), bad, ("user", "算了"), bad, cid="gave_up")
    ends = dialogue(spark, ask, bad, ("user", "你说的不对"), bad, cid="ends")
    first = dialogue(spark, bad, ("user", "你说的不对"), cid="first")
    long = dialogue(spark, ask, bad, ("user", "不对" + "好" * 400), *[bad, ("user", "那么请继续说下去")] * 4, cid="long")
    t = gave_up.union(ends).union(first).union(long)
    got = {(r["cid"], r["failure_turn_id"]): r for r in O.chains(t, O.reactions(t)).collect()}
    assert got["gave_up", 1]["recovery_outcome"] == "user_gave_up" and got["gave_up", 1]["chain_length"] == 3
    assert got["ends", 1]["recovery_outcome"] == "recovered"  # an unanswered reply isn't a failure
    assert got["first", 0]["recovery_outcome"] == "no_recovery"
    assert max(r["chain_length"] for k, r in got.items() if k[0] == "long") <= 6
    # the text is cut before the test, so a long complaint counts inside a chain
    inside = [s["action"] for k, r in got.items() if k[0] == "long" for s in r["recovery_chain"] if s["turn_id"] == 2]
    assert all(a == "complain" for a in inside)


@pytest.mark.parametrize(
    "messages, reason",
    [
        ([("user", "问题"), ("assistant", "一个正常的回答")], "no_unliked_turns"),
        ([("assistant", "一个正常的回答", 0, True)], "too_short"),
        ([("user", "问题"), ("assistant", "回答中断", 1, True)], "all_interrupted"),
        ([("user", "自杀方法"), ("assistant", "一个正常的回答", 1, True)], "unsafe_match:自杀方法"),
        ([("user", "问题"), ("assistant", "一个正常的回答", 1, True)], "pass"),
    ],
)
def test_prefilter(spark, messages, reason):
    assert O.prefilter(O.signals(dialogue(spark, *messages))).first()["reason"] == reason


@pytest.mark.parametrize("raw, name", [("冗余/啰嗦", "冗余/啰嗦"), ("?", "其他"), ("", "其他"), (None, "其他"), ("回答含幻觉", "事实性错误"), ("VERBOSITY", "冗余/啰嗦"), ("完全未知", "其他"), ("答非所问", "意图识别偏差")])
def test_dimensions(spark, raw, name):
    assert value(spark, T.dimension(F.lit(raw).cast("string"))) == name


@pytest.mark.parametrize(
    "content, reasoning, verdict, note",
    [
        ("好", "", 1, "exact_content"), ("差。", "", -1, "starts_content"), ("不好", "", 1, "ends_content"), ("分析如下\n结论是好的", "", 1, "last_line_content"),
        ("", "最后判断：差", -1, "ends_reasoning"), ("好与差都有一点", "", 1, "starts_content"), ("说好也说差吧", "", -1, "rfind_content"), ("说不好啊", "", None, "cannot_parse"), ("令人不满意", "", -1, "kw_bad_content"), ("nothing", "", None, "cannot_parse"),
    ],
)
def test_verdicts(spark, content, reasoning, verdict, note):
    assert tuple(value(spark, T.verdict(F.lit(content), F.lit(reasoning)))) == (verdict, note)


@pytest.mark.parametrize("text, verdict, note", [('{"verdict": 1}', 1, "json_full"), ('```json\n{"verdict": -1}\n```', -1, "json_full"), ('so "verdict": -1, yes', -1, "regex"), ("-1", -1, "bare_int"), ("", None, "empty"), ("garbage", None, "no_verdict_found")])
def test_binary_verdicts(spark, text, verdict, note):
    assert tuple(value(spark, T.binary_verdict(F.lit(text)))) == (verdict, note)


def test_json_extraction(spark):
    df = spark.createDataFrame([("1", '{"a": 1}'), ("2", 'see {"a": {"b": "}"}} done'), ("3", "-1"), ("4", "none"), ("5", ""), ("6", '{"a": 1,}')], "k string, raw string")
    got = {r["k"]: (r["parsed"], r["error"]) for r in E.extracted_json(df, "raw").collect()}
    assert got["1"] == ('{"a":1}', "") and got["2"] == ('{"a": {"b": "}"}}', "") and got["4"] == (None, "no_json_found") and got["5"] == (None, "empty_output") and got["6"] == (None, "json_decode_fail")
    assert got["3"][0] in ("-1", '{"verdict":-1}')


def test_rich_text(spark):
    assert value(spark, E.rich_text(F.lit('{"content":[{"type":"text","msg":"a[](@mark=1)"},{"type":"deepSearch","contents":[{"msg":"b"}]}]}'))) == "a\nb"
    assert value(spark, E.rich_text(F.lit("{broken"))) == "{broken"


@pytest.mark.parametrize("a, b, out", [(a, b, o) for a, row in ((None, ("keep", "keep", "downgrade", "reject")), ("keep", ("keep", "keep", "downgrade", "downgrade")), ("downgrade", ("downgrade", "downgrade", "downgrade", "downgrade")), ("reject", ("reject", "downgrade", "downgrade", "reject"))) for b, o in zip((None, "keep", "downgrade", "reject"), row)])
def test_merged_verdicts(spark, a, b, out):
    df = spark.createDataFrame([(a, b)], "v1 string, v2 string")
    assert df.select(C.merged_verdicts(df)).first()[0] == out


def test_routes(spark):
    c = spark.createDataFrame([("a", 0, "d", 0.6), ("b", 0, "d", 0.59), ("c", 0, "d", 0.1), ("d", 0, "d", 0.9)], "cid string, idx int, failure_dimension string, confidence double")
    j = spark.createDataFrame([("c", 0, True, "high", "x"), ("d", 0, False, None, None)], "cid string, candidate_index int, should_keep boolean, overall_quality string, corrected_dimension string")
    got = {r["cid"]: (r["route"], r["quality"], r["failure_dimension"], r["reason"]) for r in C.routed(c, j).collect()}
    assert got == {"a": ("saved", "medium", "d", None), "b": ("rejected", None, "d", "judge_batch_missed_low_conf"), "c": ("saved", "high", "x", None), "d": ("rejected", None, "d", "judge_rejected:low")}


def test_stratified_sample(spark):
    rows = [(f"{t}{i}", t, "s", float(i % 5), i + 100 * "abc".index(t)) for t in "abc" for i in range(12)] + [("a0", "b", "s", 9.0, 999)]
    df = spark.createDataFrame(rows, "cid string, type string, scenario string, judge_average double, id long")
    got = K.stratified(df, "type", "id", 10, ["s"], floor=2).collect()
    assert len(got) == 10 and len({r["cid"] for r in got}) == 10
    assert max(sum(r["type"] == t for r in got if r["stage"] == "quota") for t in "abc") <= 4


def test_near_duplicates(spark):
    q = "how do I cook rice in a small pot without burning it"
    rows = [(1, "c", 3, (2, q), 3.0), (2, "c", 3, (2, q + "?"), 4.0), (3, "c", 5, (2, q), 5.0), (4, "d", 3, (2, q), 1.0)]
    df = spark.createDataFrame(rows, "id long, cid string, dislike_turn_id int, source_query struct<turn_index:int,message:string>, judge_average double")
    assert [tuple(r) for r in C.near_duplicates(df, "id").collect()] == [(1, 2)]


def test_row_order_and_partitions_change_nothing(spark, sf_dir):
    from verdigris.sources import fixtures as X

    t = X.turns(spark, sf_dir)
    out = lambda df: sorted(map(repr, O.summaries(O.signals(df), O.reactions(df)).collect()))
    assert out(t.repartition(1)) == out(t.orderBy(F.rand(3)).repartition(7))
