"""Queries on turns: features, windows, reactions, chains, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators import turns as O
from verdigris.plans.registry import query
from verdigris.sources import fixtures as X

LEXICON = {"complaint": X.COMPLAINT, "group": 2, "dismissals": None}
WORDS = {"complaint": X.COMPLAINT, "group": 2}

#: SQL of what several queries share.
CLEAN = r"regexp_replace(lower(trim({}, E' \n\t\r')), '[，。！？、；：“”‘’（）()\[\]{{}}\s\n\r]+', '', 'g')"
COMPLAINS = f"(length({{0}}) <= 300 AND regexp_matches({{0}}, '{X.COMPLAINT}', 'i'))"
SIGNALS = """w AS (SELECT *, last_value(create_time IGNORE NULLS) OVER (PARTITION BY cid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since,
    lag(role) OVER v AS prole, lag(length) OVER v AS plen FROM turns WINDOW v AS (PARTITION BY cid ORDER BY pos)),
  g AS (SELECT *, epoch_us(create_time) / 1e6 - epoch_us(since) / 1e6 AS gap, CASE WHEN prole = 'assistant' AND role = 'user' AND plen > 50 THEN gap / plen END AS ratio FROM w),
  s AS (SELECT *, coalesce(ratio < 0.15 AND gap < 30, false) AS skip_read, role = 'assistant' AND length(trim(message)) < 4 AS interrupted FROM g)"""
REACTED = rf"""{SIGNALS},
  n AS (SELECT *, first_value(CASE WHEN role = 'user' THEN {{{{'t': turn_index, 'm': message, 's': skip_read}}}} END IGNORE NULLS) OVER (PARTITION BY cid ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nu,
    last_value(CASE WHEN role = 'user' THEN message END IGNORE NULLS) OVER (PARTITION BY cid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pu FROM s),
  c AS (SELECT cid, pos, turn_index, nu, coalesce(nu.m, '') AS txt, coalesce(pu, '') AS bef, {CLEAN.format("coalesce(nu.m, '')")} AS b, {CLEAN.format("coalesce(pu, '')")} AS a FROM n WHERE role = 'assistant'),
  j AS (SELECT *, list_distinct(regexp_split_to_array(a, '')) AS x, list_distinct(regexp_split_to_array(b, '')) AS y,
    CASE WHEN a = '' OR b = '' THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END AS sim FROM c),
  r AS (SELECT *, CASE WHEN nu IS NULL THEN 'no_followup' WHEN {COMPLAINS.format("txt")} THEN 'complain' WHEN nu.s THEN 'skip_read' WHEN length(trim(txt)) <= 20 THEN 'short_dismiss'
    WHEN sim > 0.8 AND length(trim(txt)) > 4 THEN 'repeat' WHEN sim > 0.45 AND length(trim(txt)) > 4 THEN 'rephrase'
    WHEN length(trim(bef)) >= 5 AND length(trim(txt)) >= 5 AND sim < 0.15 THEN 'abandon' ELSE 'satisfied' END AS reaction, reaction NOT IN ('satisfied', 'no_followup') AS dissatisfied FROM j)""".replace("{{", "{").replace("}}", "}")


def _reactions(spark, d, kind="jaccard") -> DataFrame:
    return O.reactions(X.turns(spark, d), similarity=kind, **LEXICON)


@query("s5_turns", "SELECT cid, pos, role, length, is_unliked::INT AS is_unliked FROM turns")
def s5(spark, d):
    rows = exploded_turns(X.dialogues(X.turns(spark, d)))
    return rows.select("cid", "pos", "role", "length", F.col("is_unliked").cast("int").alias("is_unliked"))


def exploded_turns(dialogues: DataFrame) -> DataFrame:
    """Turns from dialogues; pos is the place in the list, whatever the turn's own number."""
    return dialogues.select("cid", F.posexplode("history").alias("pos", "m")).select("cid", "pos", "m.*")


@query("p1_parse_time", "SELECT strftime(try_strptime(t, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM events) GROUP BY 1")
def p1(spark, d):
    e = X.table(spark, d, "events").select(F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("t"))
    return e.groupBy(F.date_format(T.parse_time(F.col("t")), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("p2_complaints", f"SELECT cid, pos, lower(regexp_extract(message, '{X.COMPLAINT}', 2, 'i')) AS snippet FROM turns WHERE role = 'user' AND {COMPLAINS.format('message')}")
def p2(spark, d):
    t = X.turns(spark, d).filter("role = 'user'").select("cid", "pos", F.lower(T.complaint_snippet(F.col("message"), **{"pattern": X.COMPLAINT, "group": 2})).alias("snippet"))
    return t.filter("snippet is not null")


@query("p3_interrupted", "SELECT cid, pos, role, (length(trim(message)) < 4)::INT AS interrupted FROM turns")
def p3(spark, d):
    return X.turns(spark, d).select("cid", "pos", "role", T.is_interrupted(F.col("message")).cast("int").alias("interrupted"))


@query("p4_cleaned", f"SELECT cid, pos, md5({CLEAN.format('message')}) AS cleaned FROM turns")
def p4(spark, d):
    return X.turns(spark, d).select("cid", "pos", F.md5(T.clean(F.col("message"))).alias("cleaned"))


def _pairs(spark, d) -> DataFrame:
    t = O.with_neighbours(X.turns(spark, d)).filter("role = 'user' and previous_user is not null")
    return t.select("cid", "pos", T.clean(F.col("previous_user.message")).alias("a"), T.clean(F.col("message")).alias("b"), F.col("previous_user.message").alias("before"), "message")


@query(
    "p5_character_jaccard",
    f"""WITH p AS (SELECT cid, pos, message, role, last_value(CASE WHEN role = 'user' THEN message END IGNORE NULLS) OVER (PARTITION BY cid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turns),
    c AS (SELECT cid, pos, {CLEAN.format('before')} AS a, {CLEAN.format('message')} AS b, list_distinct(regexp_split_to_array(a, '')) AS x, list_distinct(regexp_split_to_array(b, '')) AS y FROM p WHERE role = 'user' AND before IS NOT NULL)
    SELECT cid, pos, round(CASE WHEN a = '' OR b = '' THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END, 6) AS jaccard FROM c""",
)
def p5(spark, d):
    return _pairs(spark, d).select("cid", "pos", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("p6_sequence_similarity")
def p6(spark, d):
    return O.sequence_similarity(_pairs(spark, d), "a", "b", "similarity").select("cid", "pos", F.round("similarity", 6).alias("similarity"))


@query("p7_short_dismissals", "SELECT role, (length(trim(message)) <= 20)::INT AS dismissal, count(*) AS n FROM turns GROUP BY ALL")
def p7(spark, d):
    return X.turns(spark, d).groupBy("role", T.is_short_dismissal(F.col("message"), None).cast("int").alias("dismissal")).agg(F.count("*").alias("n"))


@query("p8_topic_change")
def p8(spark, d):
    p = O.sequence_similarity(_pairs(spark, d), "a", "b", "s", thresholds=(0.15,))
    changed = (F.length(T.strip(F.col("before"))) >= 5) & (F.length(T.strip(F.col("message"))) >= 5) & (F.greatest("s", T.jaccard(F.col("a"), F.col("b"))) < 0.15)
    return p.groupBy(changed.cast("int").alias("changed")).agg(F.count("*").alias("n"))


@query("p9_unsafe", f"SELECT cid, arg_min(regexp_extract(message, '{X.UNSAFE}', 0, 'i'), pos) AS snippet FROM turns WHERE regexp_matches(message, '{X.UNSAFE}', 'i') GROUP BY cid")
def p9(spark, d):
    t = X.turns(spark, d).select("cid", "pos", T.unsafe_snippet(F.col("message"), X.UNSAFE).alias("snippet")).filter("snippet is not null")
    return t.groupBy("cid").agg(F.min_by("snippet", "pos").alias("snippet"))


@query("w1_gaps", f"WITH {SIGNALS} SELECT cid, pos, round(gap, 2) AS gap_s, round(ratio, 4) AS gap_ratio, skip_read::INT AS skip_read, interrupted::INT AS interrupted FROM s")
def w1(spark, d):
    return O.signals(X.turns(spark, d)).select("cid", "pos", "gap_s", "gap_ratio", F.col("skip_read").cast("int").alias("skip_read"), F.col("interrupted").cast("int").alias("interrupted"))


@query("w2_next_user_turn", "SELECT cid, pos, first_value(CASE WHEN role = 'user' THEN turn_index END IGNORE NULLS) OVER (PARTITION BY cid ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_user_turn FROM turns")
def w2(spark, d):
    return O.with_neighbours(X.turns(spark, d)).select("cid", "pos", F.col("next_user.turn_index").alias("next_user_turn"))


@query("w3_previous_user_turn", "SELECT cid, pos, last_value(CASE WHEN role = 'user' THEN turn_index END IGNORE NULLS) OVER (PARTITION BY cid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_user_turn FROM turns")
def w3(spark, d):
    return O.with_neighbours(X.turns(spark, d)).select("cid", "pos", F.col("previous_user.turn_index").alias("previous_user_turn"))


@query("w4_reactions")
def w4(spark, d):
    return _reactions(spark, d, "exact")


@query("w4_reactions_gated")
def w4_gated(spark, d):
    return _reactions(spark, d, "gated").groupBy("reaction").agg(F.count("*").alias("n"), F.count_if("dissatisfied").alias("n_dissatisfied"))


@query("w4_reactions_by_characters", f"WITH {REACTED} SELECT reaction, count(*) AS n, count(*) FILTER (dissatisfied) AS n_dissatisfied FROM r GROUP BY reaction")
def w4_characters(spark, d):
    return _reactions(spark, d).groupBy("reaction").agg(F.count("*").alias("n"), F.count_if("dissatisfied").alias("n_dissatisfied"))


@query(
    "w5_complaint_triggers",
    f"""WITH t AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN turn_index END IGNORE NULLS) OVER (PARTITION BY cid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS triggered_asst_turn_id FROM turns)
    SELECT cid, turn_index, triggered_asst_turn_id, substring(message, 1, 200) AS full_text FROM t WHERE role = 'user' AND {COMPLAINS.format('message')}""",
)
def w5(spark, d):
    return O.complaints(X.turns(spark, d), **WORDS).select("cid", "turn_index", "triggered_asst_turn_id", "full_text")


CHAINS = f"""{REACTED},
  a AS (SELECT t.cid, t.pos, t.turn_index, t.role, CASE WHEN role <> 'user' THEN 'retry' WHEN {COMPLAINS.format("substring(message, 1, 300)")} THEN 'complain' WHEN length(trim(substring(message, 1, 300))) <= 20 THEN 'dismiss' ELSE 'followup' END AS action FROM turns t),
  k AS (SELECT f.cid, f.pos AS fpos, f.turn_index AS ftid, f.reaction, a.pos, a.turn_index AS tid, a.role, a.action, row_number() OVER (PARTITION BY f.cid, f.pos ORDER BY a.pos) AS i,
    count(*) FILTER (a.action = 'dismiss') OVER (PARTITION BY f.cid, f.pos ORDER BY a.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM r f JOIN a ON a.cid = f.cid AND a.pos > f.pos WHERE f.dissatisfied),
  ch AS (SELECT * FROM k WHERE i <= 6 AND done = 0),
  o AS (SELECT cid, fpos, count(*) AS n, arg_max(action, pos) AS last_action, bool_or(action = 'retry') AS retried, arg_max(tid, pos) FILTER (role = 'assistant') AS answer FROM ch GROUP BY ALL),
  oc AS (SELECT f.cid, f.pos AS fpos, f.turn_index AS failure_turn_id, f.reaction AS failure_reaction, coalesce(o.n, 0) AS chain_length, CASE WHEN o.n IS NULL THEN 'no_recovery' WHEN last_action = 'dismiss' THEN 'user_gave_up'
    WHEN retried THEN CASE WHEN answer IS NULL OR answer = 0 OR z.cid IS NULL THEN 'partial_recovery' WHEN NOT z.dissatisfied THEN 'recovered' ELSE 'failed_recovery' END ELSE 'no_recovery' END AS recovery_outcome
    FROM r f LEFT JOIN o ON o.cid = f.cid AND o.fpos = f.pos LEFT JOIN r z ON z.cid = f.cid AND z.turn_index = o.answer WHERE f.dissatisfied)"""


def _chains(spark, d) -> DataFrame:
    t = X.turns(spark, d)
    return O.chains(t, O.reactions(t, similarity="jaccard", **LEXICON), **LEXICON)


@query("w6_chain_steps", f"WITH {CHAINS} SELECT cid, ftid AS failure_turn_id, i AS step, tid AS turn_id, role, action FROM ch")
def w6(spark, d):
    return _chains(spark, d).select("cid", "failure_turn_id", F.posexplode("recovery_chain").alias("p", "s")).select("cid", "failure_turn_id", (F.col("p") + 1).cast("long").alias("step"), "s.turn_id", "s.role", "s.action")


W7_SQL = f"WITH {CHAINS} SELECT cid, failure_turn_id, failure_reaction, chain_length, recovery_outcome FROM oc"


@query("w7_chain_outcomes", W7_SQL)
def w7(spark, d):
    return _chains(spark, d).select("cid", "failure_turn_id", "failure_reaction", F.col("chain_length").cast("long").alias("chain_length"), "recovery_outcome")


@query("j7_failures_with_messages", f"WITH {REACTED} SELECT r.cid, r.turn_index AS failure_turn_id, substring(t.message, 1, 100) AS failure_text, substring(u.message, 1, 100) AS next_text FROM r JOIN turns t ON t.cid = r.cid AND t.turn_index = r.turn_index LEFT JOIN turns u ON u.cid = r.cid AND u.turn_index = r.nu.t WHERE dissatisfied")
def j7(spark, d):
    t = X.turns(spark, d)
    r = O.reactions(t, similarity="jaccard", **LEXICON).filter("dissatisfied")
    f = t.select("cid", F.col("turn_index").alias("asst_turn_id"), F.substring("message", 1, 100).alias("failure_text"))
    u = t.select("cid", F.col("turn_index").alias("next_user_turn_id"), F.substring("message", 1, 100).alias("next_text"))
    return r.join(f, ["cid", "asst_turn_id"]).join(u, ["cid", "next_user_turn_id"], "left").select("cid", F.col("asst_turn_id").alias("failure_turn_id"), "failure_text", "next_text")


A1_SQL = f"""WITH {REACTED}, t AS (SELECT cid, count(*) AS turn_count, coalesce(string_agg(turn_index, ',' ORDER BY pos) FILTER (role = 'assistant' AND is_unliked), '') AS unliked_turns, bool_or(interrupted)::INT AS has_interrupted FROM s GROUP BY cid),
    q AS (SELECT cid, string_agg(reaction || '=' || n, ',' ORDER BY reaction) AS reaction_summary FROM (SELECT cid, reaction, count(*) AS n FROM r GROUP BY ALL) GROUP BY cid),
    u AS (SELECT cid, coalesce(string_agg(turn_index, ',' ORDER BY pos) FILTER (dissatisfied), '') AS dissatisfied_turns, count(*) FILTER (dissatisfied) AS total_dissatisfied FROM r GROUP BY cid)
    SELECT t.*, coalesce(reaction_summary, '') AS reaction_summary, coalesce(dissatisfied_turns, '') AS dissatisfied_turns, coalesce(total_dissatisfied, 0) AS total_dissatisfied FROM t LEFT JOIN q USING (cid) LEFT JOIN u USING (cid)"""


def rollup(e: DataFrame, *also) -> DataFrame:
    """The roll-up of dialogues in flat columns."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    summary = F.array_join(F.transform(F.array_sort(F.map_entries("reaction_summary")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return e.select(
        "cid", "turn_count", joined("unliked_turns").alias("unliked_turns"), F.col("has_interrupted").cast("int").alias("has_interrupted"), F.coalesce(summary, F.lit("")).alias("reaction_summary"), joined("dissatisfied_turns").alias("dissatisfied_turns"), F.col("total_dissatisfied").cast("long").alias("total_dissatisfied"), *also
    )


@query("a1_dialogue_rollup", A1_SQL)
def a1(spark, d):
    s = O.signals(X.turns(spark, d))
    return rollup(O.summaries(s, O.reactions(s, similarity="jaccard", **LEXICON)))


@query("o1_enriched_dialogues")
def o1(spark, d):
    e = O.enriched(X.turns(spark, d), similarity="gated", **LEXICON)
    return e.select("cid", "turn_count", "total_unliked", "total_dissatisfied", F.to_json("reaction_summary").alias("reaction_summary"), F.size(F.coalesce("explicit_complaints", F.array())).alias("n_complaints"), F.to_json("recovery_chains").alias("recovery_chains"))


COMPLAINED = f"role = 'user' AND {COMPLAINS.format('message')}"


@query(
    "o1_enriched_by_characters",
    f"""WITH {CHAINS}, roll AS ({A1_SQL}), st AS (SELECT cid, fpos, string_agg(tid || ' ' || role || ' ' || action, ';' ORDER BY pos) AS steps FROM ch GROUP BY ALL),
    cs AS (SELECT oc.cid, string_agg(failure_turn_id || '=' || failure_reaction || '>' || recovery_outcome || '[' || coalesce(steps, '') || ']', ',' ORDER BY oc.fpos) AS chains FROM oc LEFT JOIN st ON st.cid = oc.cid AND st.fpos = oc.fpos GROUP BY oc.cid),
    co AS (SELECT cid, count(*) AS n_complaints FROM turns WHERE {COMPLAINED} GROUP BY cid), re AS (SELECT cid, string_agg(turn_index || ':' || reaction, ',' ORDER BY pos) AS reactions FROM r GROUP BY cid)
    SELECT roll.*, coalesce(n_complaints, 0) AS n_complaints, coalesce(chains, '') AS chains, coalesce(reactions, '') AS reactions FROM roll LEFT JOIN cs USING (cid) LEFT JOIN co USING (cid) LEFT JOIN re USING (cid)""",
)
def o1_characters(spark, d):
    """Whole enriched dialogues, in flat columns; sequences are compared by their characters."""
    e = O.enriched(X.turns(spark, d), similarity="jaccard", **LEXICON)
    step = lambda s: F.concat(s["turn_id"], F.lit(" "), s["role"], F.lit(" "), s["action"])
    chain = lambda c: F.concat(c["failure_turn_id"], F.lit("="), c["failure_reaction"], F.lit(">"), c["recovery_outcome"], F.lit("["), F.array_join(F.transform(c["recovery_chain"], step), ";"), F.lit("]"))
    reaction = lambda r: F.concat(r["asst_turn_id"], F.lit(":"), r["reaction"])
    listed = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    return rollup(e, F.coalesce(F.size("explicit_complaints"), F.lit(0)).cast("long").alias("n_complaints"), listed("recovery_chains", chain).alias("chains"), listed("user_reactions", reaction).alias("reactions"))


F1_SQL = f"""WITH {SIGNALS}, g1 AS (SELECT cid, count(*) FILTER (role = 'assistant' AND is_unliked) AS u, count(*) AS n, count(*) FILTER (role = 'assistant') AS na, count(*) FILTER (role = 'assistant' AND NOT interrupted) AS nr,
    arg_min(regexp_extract(message, '{X.UNSAFE}', 0, 'i'), pos) FILTER (regexp_matches(message, '{X.UNSAFE}', 'i')) AS x FROM s GROUP BY cid)
    SELECT cid, CASE WHEN u = 0 THEN 'no_unliked_turns' WHEN n < 2 THEN 'too_short' WHEN na > 0 AND nr = 0 THEN 'all_interrupted' WHEN x IS NOT NULL THEN 'unsafe_match:' || x ELSE 'pass' END AS reason FROM g1"""


@query("f1_prefilter", F1_SQL)
def f1(spark, d):
    return O.prefilter(O.signals(X.turns(spark, d)), X.UNSAFE)


@query("p27_rendered_dialogues")
def p27(spark, d):
    s = O.signals(X.turns(spark, d))
    return O.rendered(s, O.complaints(s, **WORDS), O.reactions(s, similarity="gated", **LEXICON))


_MARK = "CASE r.reaction " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.MARKS.items()) + " ELSE '⚠' END"


@query(
    "p27_rendered_by_characters",
    f"""WITH {REACTED}, x AS (SELECT s.*, trim(s.message, E' \n\t\r') AS said, round(s.gap, 2) AS gap_s, concat_ws(' ', CASE WHEN s.is_unliked THEN '👎DISLIKED' END, CASE WHEN s.interrupted THEN '⚠INTERRUPTED' END, CASE WHEN {COMPLAINED} THEN '💢EXPLICIT_COMPLAINT' END,
      CASE WHEN r.dissatisfied THEN {_MARK} || 'USER_REACTION=' || r.reaction END) AS marks FROM s LEFT JOIN r ON r.cid = s.cid AND r.pos = s.pos),
    l AS (SELECT cid, pos, '[turn ' || turn_index || ' | ' || role || CASE WHEN marks <> '' THEN ' [' || marks || ']' ELSE '' END || CASE WHEN coalesce(gap_s, 0) <> 0 THEN ' (+' || gap_s || 's)' ELSE '' END || '] (' || length(message) || '字)' || chr(10)
      || CASE WHEN length(said) > 1500 THEN substring(said, 1, 1500) || '...[truncated, total ' || length(message) || ' chars]' WHEN said = '' THEN '(empty)' ELSE said END || chr(10) AS line FROM x)
    SELECT cid, md5(string_agg(line, chr(10) ORDER BY pos)) AS dialogue FROM l GROUP BY cid""",
)
def p27_characters(spark, d):
    s = O.signals(X.turns(spark, d))
    return O.rendered(s, O.complaints(s, **WORDS), O.reactions(s, similarity="jaccard", **LEXICON)).select("cid", F.md5("dialogue").alias("dialogue"))


def _signal_summaries(e: DataFrame) -> DataFrame:
    """cid, summary: what a miner is shown of an enriched dialogue, as JSON."""
    pick = lambda c, **names: F.transform(c, lambda x: F.struct(*(x[v].alias(k) for k, v in names.items())))
    unhappy = F.filter("user_reactions", lambda r: r["dissatisfied"])
    body = F.struct(
        "unliked_turns",
        pick("explicit_complaints", turn="turn_index", trigger_asst_turn="triggered_asst_turn_id", snippet="snippet").alias("explicit_complaints"),
        "dissatisfied_turns",
        pick(unhappy, asst_turn="asst_turn_id", reaction="reaction", dissatisfied="dissatisfied", details="details").alias("user_reactions"),
        pick("recovery_chains", failure_turn="failure_turn_id", outcome="recovery_outcome", chain_length="chain_length").alias("recovery_chains"),
        "reaction_summary",
        "has_interrupted",
        "turn_count",
        "total_dissatisfied",
    )
    return e.select("cid", F.to_json(body).alias("summary"))


@query("p28_signal_summaries")
def p28(spark, d):
    return _signal_summaries(O.enriched(X.turns(spark, d), similarity="gated", **LEXICON))


@query(
    "p28_summaries_by_characters",
    f"""WITH {CHAINS}, roll AS ({A1_SQL}), tr AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN turn_index END IGNORE NULLS) OVER (PARTITION BY cid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trg FROM turns),
    co AS (SELECT cid, string_agg(turn_index || '<' || coalesce(trg::VARCHAR, ''), ',' ORDER BY pos) AS complaints FROM tr WHERE {COMPLAINED} GROUP BY cid), re AS (SELECT cid, string_agg(turn_index || ':' || reaction, ',' ORDER BY pos) AS reactions FROM r WHERE dissatisfied GROUP BY cid),
    cs AS (SELECT cid, string_agg(failure_turn_id || '=' || recovery_outcome || chain_length, ',' ORDER BY fpos) AS chains FROM oc GROUP BY cid)
    SELECT cid, unliked_turns, dissatisfied_turns, has_interrupted, turn_count, total_dissatisfied, reaction_summary, coalesce(complaints, '') AS complaints, coalesce(reactions, '') AS reactions, coalesce(chains, '') AS chains FROM roll LEFT JOIN co USING (cid) LEFT JOIN re USING (cid) LEFT JOIN cs USING (cid)""",
)
def p28_characters(spark, d):
    """The summaries as a reader gets them, read back from their JSON."""
    rows = _signal_summaries(O.enriched(X.turns(spark, d), similarity="jaccard", **LEXICON))
    kind = "struct<unliked_turns:array<int>,explicit_complaints:array<struct<turn:int,trigger_asst_turn:int,snippet:string>>,dissatisfied_turns:array<int>,user_reactions:array<struct<asst_turn:int,reaction:string,dissatisfied:boolean,details:string>>,recovery_chains:array<struct<failure_turn:int,outcome:string,chain_length:int>>,reaction_summary:map<string,bigint>,has_interrupted:boolean,turn_count:bigint,total_dissatisfied:int>"
    e = rows.select("cid", F.from_json("summary", kind).alias("s")).select("cid", "s.*")
    listed = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    return rollup(
        e,
        listed("explicit_complaints", lambda c: F.concat(c["turn"], F.lit("<"), F.coalesce(c["trigger_asst_turn"].cast("string"), F.lit("")))).alias("complaints"),
        listed("user_reactions", lambda r: F.concat(r["asst_turn"], F.lit(":"), r["reaction"])).alias("reactions"),
        listed("recovery_chains", lambda c: F.concat(c["failure_turn"], F.lit("="), c["outcome"], c["chain_length"])).alias("chains"),
    )


LABELS = f"""{REACTED}, b AS (SELECT t.cid, t.pos, t.turn_index AS turn_id, t.is_unliked, reaction, (NOT (dissatisfied OR t.is_unliked))::INT AS user_satisfied,
  array_to_string(list_filter([CASE WHEN t.is_unliked THEN 'dislike' END, CASE WHEN reaction = 'complain' THEN 'explicit_complaint' END, CASE WHEN reaction IN ('repeat', 'rephrase', 'short_dismiss', 'abandon', 'skip_read') THEN reaction END], lambda x: x IS NOT NULL), ',') AS signals,
  least(6, t.pos - (SELECT min(pos) FROM turns m WHERE m.cid = t.cid)) AS n_context, substring(r.bef, 1, 50) AS query FROM turns t JOIN r ON r.cid = t.cid AND r.pos = t.pos)"""


@query("o12_behaviour_labels", f"WITH {LABELS} SELECT cid, turn_id, user_satisfied, signals, reaction AS user_reaction, n_context, query FROM b")
def o12(spark, d):
    t = X.turns(spark, d)
    b = O.labelled_turns(t, O.reactions(t, similarity="jaccard", **LEXICON))
    return b.select("cid", "turn_id", F.col("user_satisfied").cast("int").alias("user_satisfied"), F.array_join("dissatisfaction_signals", ",").alias("signals"), "user_reaction", F.size("history_context").alias("n_context"), F.substring("preceding_query", 1, 50).alias("query"))


@query("a12_label_counts", f"WITH {CHAINS}, lab AS (SELECT reaction FROM r) SELECT 'reaction' AS facet, reaction AS value, count(*) AS n FROM lab GROUP BY ALL UNION ALL SELECT 'outcome', recovery_outcome, count(*) FROM oc GROUP BY ALL")
def a12(spark, d):
    t = X.turns(spark, d)
    r = O.reactions(t, similarity="jaccard", **LEXICON)
    facets = r.select(F.lit("reaction").alias("facet"), F.col("reaction").alias("value")).unionByName(O.chains(t, r, **LEXICON).select(F.lit("outcome").alias("facet"), F.col("recovery_outcome").alias("value")))
    return facets.groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("o13_recovery_records", f"WITH {CHAINS} SELECT oc.cid, failure_turn_id, substring(t.message, 1, 80) AS failure_response, failure_reaction, recovery_outcome, chain_length FROM oc JOIN turns t ON t.cid = oc.cid AND t.turn_index = oc.failure_turn_id")
def o13(spark, d):
    t = X.turns(spark, d)
    c = O.chains(t, O.reactions(t, similarity="jaccard", **LEXICON), **LEXICON)
    f = t.select("cid", F.col("turn_index").alias("failure_turn_id"), F.substring("message", 1, 2000).alias("failure_response"))
    return c.join(f, ["cid", "failure_turn_id"]).select("cid", "failure_turn_id", F.substring("failure_response", 1, 80).alias("failure_response"), "failure_reaction", "recovery_outcome", F.col("chain_length").cast("long").alias("chain_length"))


@query("w8_context_before", "SELECT t.cid, t.pos, count(m.pos) AS n_before, coalesce(string_agg(m.role || ':' || substring(m.message, 1, 20), '|' ORDER BY m.pos), '') AS context FROM turns t LEFT JOIN turns m ON m.cid = t.cid AND m.pos < t.pos WHERE t.role = 'user' GROUP BY t.cid, t.pos")
def w8(spark, d):
    t = X.turns(spark, d).withColumn("c", F.collect_list(F.struct("role", F.substring("message", 1, 2000).alias("content"))).over(O.before())).filter("role = 'user'")
    return t.select("cid", "pos", F.size("c").cast("long").alias("n_before"), F.array_join(F.transform("c", lambda m: F.concat(m["role"], F.lit(":"), F.substring(m["content"], 1, 20))), "|").alias("context"))
