"""Turn signals, reactions, recovery chains and the roll-up of a dialogue.

Input is the turns table (cid, pos, turn_index, role, message, create_time, is_unliked, length). All windows and
groupings are by cid, so one exchange serves them.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from verdigris.functions import text as T


def by_cid():
    return W.partitionBy("cid").orderBy("pos")


def before():
    return by_cid().rowsBetween(W.unboundedPreceding, -1)


def after():
    return by_cid().rowsBetween(1, W.unboundedFollowing)


def signals(turns: DataFrame) -> DataFrame:
    """Adds gap_s, gap_ratio, skip_read, interrupted. The time is that of the last message with one, role and length are the previous message's."""
    since = F.last("create_time", ignorenulls=True).over(before())
    gap = F.unix_micros("create_time") / 1e6 - F.unix_micros(since) / 1e6
    ratio = F.when((F.lag("role").over(by_cid()) == "assistant") & (F.col("role") == "user") & (F.lag("length").over(by_cid()) > 50), gap / F.lag("length").over(by_cid()))
    return turns.withColumns({"_gap": gap, "_ratio": ratio}).select(
        *turns.columns,
        F.round("_gap", 2).alias("gap_s"),
        F.round("_ratio", 4).alias("gap_ratio"),
        F.coalesce((F.col("_ratio") < 0.15) & (F.col("_gap") < 30), F.lit(False)).alias("skip_read"),
        ((F.col("role") == "assistant") & T.is_interrupted(F.col("message"))).alias("interrupted"),
    )


def with_neighbours(turns: DataFrame) -> DataFrame:
    """Adds next_user and previous_user (structs; null where there is none)."""
    user = F.when(F.col("role") == "user", F.struct("turn_index", "message", *(c for c in ("skip_read", "gap_ratio") if c in turns.columns)))
    return turns.withColumns({"next_user": F.first(user, ignorenulls=True).over(after()), "previous_user": F.last(user, ignorenulls=True).over(before())})


@F.arrow_udf(DoubleType())
def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Null texts are pairs that are decided already."""
    return pa.array([None if x is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def sequence_similarity(pairs: DataFrame, a: str, b: str, name: str, thresholds: tuple[float, ...] = ()) -> DataFrame:
    """Adds the sequence similarity of two cleaned texts, in this order.

    With thresholds, pairs that share enough characters to pass the largest one keep that share, and pairs whose upper
    bound lies under all thresholds keep the bound: either decides every comparison with them. Only what is left
    goes through Python, in a branch of its own.
    """
    x, y = F.col(a), F.col(b)
    trivial = F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).when(x == y, F.lit(1.0))
    if thresholds:
        trivial = trivial.when(T.ratio_bound(x, y) < min(thresholds), T.ratio_bound(x, y))
    known = pairs.withColumn(name, trivial)
    return known.filter(F.col(name).isNotNull()).unionByName(known.filter(F.col(name).isNull()).withColumn(name, _ratio(x, y)))


#: Texts of so many characters are bounded by their edit distance, whose cost is the product of the lengths.
EDITS = 1000


def _reaction_rows(turns: DataFrame, complaint: str | None, group: int, dismissals: list[str] | None) -> DataFrame:
    t = with_neighbours(turns if "skip_read" in turns.columns else signals(turns)).filter("role = 'assistant'")
    text, asked = F.coalesce("next_user.message", F.lit("")), F.coalesce("previous_user.message", F.lit(""))
    return t.select(
        "cid",
        "pos",
        F.col("turn_index").alias("asst_turn_id"),
        F.col("next_user.turn_index").alias("next_user_turn_id"),
        text.alias("text"),
        asked.alias("before"),
        F.col("next_user").isNull().alias("_none"),
        T.complaint_snippet(text, complaint, group).alias("snippet"),
        F.coalesce("next_user.skip_read", F.lit(False)).alias("_skip"),
        F.col("next_user.gap_ratio").alias("gap_ratio"),
        T.is_short_dismissal(text, dismissals).alias("_dismiss"),
        T.clean(asked).alias("_a"),
        T.clean(text).alias("_b"),
    ).withColumn("jaccard", T.jaccard(F.col("_a"), F.col("_b")))


def _labelled(rows: DataFrame, best: Column, exact: bool) -> DataFrame:
    long, both = F.length(T.strip(F.col("text"))) > 4, (F.length(T.strip(F.col("before"))) >= 5) & (F.length(T.strip(F.col("text"))) >= 5)
    label = (
        F.when(F.col("_none"), "no_followup")
        .when(F.col("snippet").isNotNull(), "complain")
        .when(F.col("_skip"), "skip_read")
        .when(F.col("_dismiss"), "short_dismiss")
        .when((best > 0.80) & long, "repeat")
        .when((best > 0.45) & long, "rephrase")
        .when(both & (best < 0.15), "abandon")
        .otherwise("satisfied")
    )
    out = rows.withColumn("reaction", label)
    details = (
        F.when(F.col("reaction") == "no_followup", "conversation ends after this assistant turn")
        .when(F.col("reaction") == "complain", F.concat(F.lit("complaint: '"), "snippet", F.lit("'")))
        .when(F.col("reaction") == "skip_read", F.concat(F.lit("gap_ratio="), F.col("gap_ratio").cast("string")))
        .when(F.col("reaction") == "short_dismiss", F.concat(F.lit("'"), F.substring(T.strip(F.col("text")), 1, 30), F.lit("'")))
        .when(F.col("reaction").isin("repeat", "rephrase"), F.concat(F.lit("similarity="), F.format_string("%.2f", best), F.lit(" with previous query")) if exact else F.lit("similar to the previous query"))
        .when(F.col("reaction") == "abandon", "topic completely changed")
        .otherwise("")
    )
    return out.select("cid", "pos", "asst_turn_id", "next_user_turn_id", "reaction", details.alias("details"), (~F.col("reaction").isin("satisfied", "no_followup")).alias("dissatisfied"))


def reactions(turns: DataFrame, complaint: str | None = None, group: int = 0, dismissals: list[str] | None = T.L.DISMISSALS, similarity: str = "gated") -> DataFrame:
    """The reaction of the next user message to each assistant turn, by priority.

    similarity: 'exact' computes the sequence similarity of every compared pair and writes it in details; 'gated' computes it only where
    the label depends on it; 'jaccard' compares characters only.
    """
    rows = _reaction_rows(turns, complaint, group, dismissals)
    j = F.col("jaccard")
    if similarity == "jaccard":
        return _labelled(rows, j, False)
    compared = ~F.col("_none") & F.col("snippet").isNull() & ~F.col("_skip") & ~F.col("_dismiss") & (F.col("before") != "")
    if similarity == "exact":
        some = sequence_similarity(rows.filter(compared), "_a", "_b", "_s")
        return _labelled(rows.filter(~compared).withColumn("_s", F.lit(0.0)).unionByName(some), F.greatest(j, F.col("_s")), True)
    # lengths, and the edits that short texts are apart, bound the similarity; one branch, so that the windows before are computed once
    a, b, long = F.length("_a"), F.length("_b"), F.length(T.strip(F.col("text"))) > 4
    rows = rows.withColumn("_bound", F.coalesce(2.0 * F.least(a, b) / F.nullif(a + b, F.lit(0)), F.lit(0.0)))
    doubtful = compared & long & (j <= 0.80) & ~((j > 0.45) & (F.col("_bound") <= 0.80)) & (F.greatest(a, b) <= EDITS)
    rows = rows.withColumn("_bound", F.when(doubtful, F.least("_bound", T.edit_bound(F.col("_a"), F.col("_b")))).otherwise(F.col("_bound")))
    bound = F.col("_bound")
    best = F.greatest(j, bound)
    decided = ~compared | ~long | (j > 0.80) | ((j > 0.45) & (bound <= 0.80)) | ((j >= 0.15) & (best <= 0.45)) | (best < 0.15) | (a == 0) | (b == 0) | (F.col("_a") == F.col("_b"))
    rows = rows.withColumn("_open", ~decided)
    ratio = _ratio(F.when(F.col("_open"), F.col("_a")), F.when(F.col("_open"), F.col("_b")))
    return _labelled(rows.withColumn("_s", F.coalesce(ratio, F.lit(0.0))), F.greatest(j, F.col("_s")), False)


def complaints(turns: DataFrame, complaint: str | None = None, group: int = 0) -> DataFrame:
    """Explicit complaints and the assistant turn before them."""
    trigger = F.last(F.when(F.col("role") == "assistant", F.col("turn_index")), ignorenulls=True).over(before())
    t = turns.withColumns({"triggered_asst_turn_id": trigger, "snippet": T.complaint_snippet(F.col("message"), complaint, group)})
    return t.filter("role = 'user' and snippet is not null").select("cid", "pos", "turn_index", "snippet", F.substring("message", 1, 200).alias("full_text"), "triggered_asst_turn_id")


STEP = "struct<turn_id:int,role:string,action:string,text_preview:string>"


def chains(turns: DataFrame, reacted: DataFrame, complaint: str | None = None, group: int = 0, dismissals: list[str] | None = T.L.DISMISSALS, steps: int = 6) -> DataFrame:
    """Recovery chains: up to so many turns after each dissatisfied one, until the user dismisses, and how they end.

    The text is cut before the complaint test, so long complaints count here.
    """
    text = F.substring("message", 1, 300)
    action = F.when(F.col("role") != "user", "retry").when(T.complaint_snippet(text, complaint, group).isNotNull(), "complain").when(T.is_short_dismissal(text, dismissals), "dismiss").otherwise("followup")
    step = F.struct(F.col("turn_index").alias("turn_id"), "role", action.alias("action"), F.substring("message", 1, 150).alias("text_preview"))
    following = turns.withColumn("_step", step).select("cid", "pos", F.collect_list("_step").over(by_cid().rowsBetween(1, steps)).alias("_steps"))
    r = reacted.select("cid", "pos", "asst_turn_id", "reaction", "dissatisfied")
    unhappy = F.collect_list(F.struct("asst_turn_id", "dissatisfied")).over(W.partitionBy("cid"))
    failed = r.withColumn("_all", unhappy).filter("dissatisfied").join(following, ["cid", "pos"])
    stop = F.array_position(F.transform("_steps", lambda s: s["action"]), F.lit("dismiss"))
    cut = F.when(stop > 0, F.slice("_steps", F.lit(1), stop.cast("int"))).otherwise(F.col("_steps"))
    out = failed.withColumn("recovery_chain", cut)
    last = F.try_element_at(F.col("recovery_chain"), F.lit(-1))
    answer = F.try_element_at(F.filter("recovery_chain", lambda s: s["role"] == "assistant"), F.lit(-1))["turn_id"]
    of_answer = F.try_element_at(F.filter("_all", lambda x: x["asst_turn_id"] == F.col("_answer")), F.lit(-1))["dissatisfied"]
    outcome = (
        F.when(F.size("recovery_chain") == 0, "no_recovery")
        .when((last["role"] == "user") & (last["action"] == "dismiss"), "user_gave_up")
        .when(F.exists("recovery_chain", lambda s: s["action"] == "retry"), F.when(F.col("_answer").isNull() | (F.col("_answer") == 0) | of_answer.isNull(), "partial_recovery").when(~of_answer, "recovered").otherwise("failed_recovery"))
        .otherwise("no_recovery")
    )
    out = out.withColumn("_answer", F.when(F.size("recovery_chain") > 0, answer))
    return out.select("cid", "pos", F.col("asst_turn_id").alias("failure_turn_id"), F.col("reaction").alias("failure_reaction"), "recovery_chain", outcome.alias("recovery_outcome"), F.size("recovery_chain").alias("chain_length"))


def summaries(signalled: DataFrame, reacted: DataFrame) -> DataFrame:
    """One row per dialogue: turn_count, unliked and dissatisfied turns, has_interrupted, reaction_summary (map)."""
    ordered = lambda c, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", c)))), lambda x: x[c])
    of_turns = signalled.groupBy("cid").agg(
        F.count("*").alias("turn_count"),
        ordered("turn_index", (F.col("role") == "assistant") & F.col("is_unliked")).alias("unliked_turns"),
        F.bool_or("interrupted").alias("has_interrupted"),
    )
    kinds = reacted.groupBy("cid", "reaction").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("dissatisfied"), F.struct("pos", "asst_turn_id"))).alias("turns"))
    of_reactions = kinds.groupBy("cid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reaction", "n")))).alias("reaction_summary"), F.transform(F.array_sort(F.flatten(F.collect_list("turns"))), lambda x: x["asst_turn_id"]).alias("dissatisfied_turns"))
    none = F.array().cast("array<int>")
    return (
        of_turns.join(of_reactions, "cid", "left")
        .withColumns({"dissatisfied_turns": F.coalesce("dissatisfied_turns", none), "total_unliked": F.size("unliked_turns")})
        .withColumn("total_dissatisfied", F.size("dissatisfied_turns"))
    )


def enriched(turns: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, what: df, **lexicon) -> DataFrame:
    """summaries() with the nested reactions, complaints and chains of each dialogue. keep: writes what several of these read, so that it is computed once."""
    dismissals = lexicon.pop("dismissals", T.L.DISMISSALS)
    s = keep(signals(turns), "signals")
    r = keep(reactions(s, dismissals=dismissals, **lexicon), "reactions")
    words = {k: v for k, v in lexicon.items() if k in ("complaint", "group")}
    nested = lambda df, name: df.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct(*(c for c in df.columns if c != "cid")))).alias(name))
    out = summaries(s, r)
    for df, name in ((r, "user_reactions"), (complaints(turns, **words), "explicit_complaints"), (chains(turns, r, dismissals=dismissals, **words), "recovery_chains")):
        out = out.join(nested(df, name), "cid", "left")
    return out


def prefilter(signalled: DataFrame, unsafe: str | None = None) -> DataFrame:
    """cid, reason: the first rule that a dialogue fails, or pass."""
    assistant = F.col("role") == "assistant"
    snippet = T.unsafe_snippet(F.col("message"), unsafe)
    g = signalled.withColumn("_unsafe", snippet).groupBy("cid").agg(
        F.count_if(assistant & F.col("is_unliked")).alias("unliked"),
        F.count("*").alias("n"),
        F.count_if(assistant).alias("n_assistant"),
        F.count_if(assistant & ~F.col("interrupted")).alias("real"),
        F.min_by("_unsafe", F.when(F.col("_unsafe").isNotNull(), F.col("pos"))).alias("unsafe"),
    )
    reason = F.when(F.col("unliked") == 0, "no_unliked_turns").when(F.col("n") < 2, "too_short").when((F.col("n_assistant") > 0) & (F.col("real") == 0), "all_interrupted").when(F.col("unsafe").isNotNull(), F.concat(F.lit("unsafe_match:"), "unsafe")).otherwise("pass")
    return g.select("cid", reason.alias("reason"))


MARKS = {"complain": "💢", "repeat": "🔄", "rephrase": "🔀", "short_dismiss": "😐", "abandon": "🏃", "skip_read": "⏩"}


def rendered(signalled: DataFrame, complained: DataFrame, reacted: DataFrame, most: int = 1500) -> DataFrame:
    """cid, dialogue: all turns with their marks, gaps and lengths, long texts cut."""
    t = signalled.join(complained.select("cid", "pos", F.lit(True).alias("_complaint")), ["cid", "pos"], "left").join(reacted.select("cid", "pos", "reaction", "dissatisfied"), ["cid", "pos"], "left")
    mark = F.lit("⚠")
    for k, v in MARKS.items():
        mark = F.when(F.col("reaction") == k, v).otherwise(mark)
    marks = F.concat_ws(" ", F.when(F.col("is_unliked"), "👎DISLIKED"), F.when(F.col("interrupted"), "⚠INTERRUPTED"), F.when(F.col("_complaint"), "💢EXPLICIT_COMPLAINT"), F.when(F.col("dissatisfied"), F.concat(mark, F.lit("USER_REACTION="), "reaction")))
    text = T.strip(F.col("message"))
    body = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("...[truncated, total "), F.length("message"), F.lit(" chars]"))).when(text == "", "(empty)").otherwise(text)
    gap = F.when(F.coalesce("gap_s", F.lit(0.0)) != 0, F.concat(F.lit(" (+"), F.col("gap_s").cast("string"), F.lit("s)"))).otherwise("")
    head = F.concat(F.lit("[turn "), "turn_index", F.lit(" | "), "role", F.when(marks != "", F.concat(F.lit(" ["), marks, F.lit("]"))).otherwise(""), gap, F.lit("] ("), F.length("message"), F.lit("字)"))
    line = F.concat(head, F.lit("\n"), body, F.lit("\n"))
    return t.select("cid", "pos", line.alias("line")).groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("dialogue"))


def labelled_turns(turns: DataFrame, reacted: DataFrame) -> DataFrame:
    """Behaviour labels of all assistant turns: preceding query, up to six turns of context, signals and reaction."""
    context = F.collect_list(F.struct("turn_index", "role", F.substring("message", 1, 2000).alias("content"))).over(by_cid().rowsBetween(-6, -1))
    asked = F.last(F.when(F.col("role") == "user", F.col("message")), ignorenulls=True).over(before())
    t = turns.withColumns({"history_context": context, "preceding_query": F.substring(F.coalesce(asked, F.lit("")), 1, 1000)}).filter("role = 'assistant'")
    j = t.join(reacted.select("cid", "pos", "reaction", "details", "dissatisfied"), ["cid", "pos"], "left")
    kinds = ("repeat", "rephrase", "short_dismiss", "abandon", "skip_read")
    found = F.array_compact(F.array(F.when(F.col("is_unliked"), "dislike"), F.when(F.col("reaction") == "complain", "explicit_complaint"), F.when(F.col("reaction").isin(*kinds), F.col("reaction"))))
    return j.select(
        "cid",
        "pos",
        F.col("turn_index").alias("turn_id"),
        F.substring("message", 1, 2000).alias("agent_response"),
        "preceding_query",
        "history_context",
        (~(F.coalesce("dissatisfied", F.lit(False)) | F.col("is_unliked"))).alias("user_satisfied"),
        found.alias("dissatisfaction_signals"),
        F.coalesce("reaction", F.lit("unknown")).alias("user_reaction"),
        F.coalesce("details", F.lit("")).alias("reaction_details"),
        "is_unliked",
    )
