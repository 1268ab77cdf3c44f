"""Labels, filters, routes and records of saved bad cases.

Input is the saved table (``sources.fixtures.saved`` gives its columns). Everything is a Column expression or a join
on a key; nested histories are read with array functions, so no row is exploded to be put together again.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.functions import lexicons as L
from verdigris.functions import text as T
from verdigris.sources.shared import materialize


def message_at(history: Column, turn: Column) -> Column:
    """The first message with this turn number."""
    return F.get(F.filter(history, lambda m: m["turn_index"] == turn), F.lit(0))


def normalised(df: DataFrame, raw: str, out: str = "dimension", **rules) -> DataFrame:
    """Adds the canonical dimension; the patterns run on the distinct labels only."""
    names = df.select(raw).distinct().withColumn(out, T.dimension(F.col(raw), **rules)).withColumnRenamed(raw, "_raw")
    return df.join(names, df[raw].eqNullSafe(names["_raw"]), "left").drop("_raw")


def mapped(df: DataFrame, column: str, canonical: list[str], mapping: dict[str, str]) -> DataFrame:
    """Adds <column>_mapped and <column>_unmapped: the mapping's label, or the given one; unmapped if it is neither canonical nor mapped."""
    table = df.sparkSession.createDataFrame(list(mapping.items()), f"{column} string, _to string")
    c = F.col(column)
    foreign = c.isNotNull() & (c != "") & ~c.isin(canonical)
    return df.join(F.broadcast(table), column, "left").withColumns({f"{column}_mapped": F.when(foreign, F.coalesce("_to", c)).otherwise(c), f"{column}_unmapped": foreign & F.col("_to").isNull()}).drop("_to")


def quality_gate(df: DataFrame) -> Column:
    conf = F.coalesce("signal_confidence", F.lit(""))
    return (F.col("overall_quality") == "high") & (F.coalesce("judge_average", F.lit(0.0)) >= 4.0) & F.forall(F.coalesce(F.map_values("judge_scores"), F.array().cast("array<double>")), lambda v: v.isNull() | (v >= 3)) & conf.isin("high", "medium", "")


def solvable(dimension: Column, query: Column, explanation: Column, least_query: int = 15, least_explanation: int = 40) -> Column:
    q = T.strip(query)
    return ~T.strip(dimension).isin(L.UNSOLVABLE_TYPES) & (F.length(q) >= least_query) & ~q.rlike("(?iu)" + L.UNSOLVABLE_QUERY) & (F.length(T.strip(explanation)) >= least_explanation)


def difficult(df: DataFrame) -> Column:
    score = lambda k: F.coalesce(F.col("judge_scores")[k] >= 3, F.lit(True))
    return (F.lower(F.coalesce("representativeness", F.lit(""))) != "low") & score("query_completeness") & score("response_quality")


FUNNEL = ("quality", "needs_context", "dimension", "duplicate", "needs_image", "query_len", "judge_avg", "no_response", "wrong_cutoff")


def benchmark_funnel(df: DataFrame, qualities: tuple[str, ...] = ("high", "medium"), least_average: float = 3.5, least_query: int = 5, dedup: bool = True) -> DataFrame:
    """Adds fail_reason, the first rule that a record fails; null if it passes all."""
    response = message_at(F.col("full_history"), F.col("dislike_turn_id"))["message"]
    dim = F.col("failure_dimension")
    last = F.array_max(F.transform("selected_history", lambda m: F.coalesce(m["turn_index"], F.lit(-1))))
    fails = (
        ~F.coalesce(F.col("overall_quality").isin(*qualities), F.lit(False)),
        ~F.coalesce(F.col("needs_context") == F.lit(False), F.lit(False)),
        dim.isNull() | (dim == L.OTHER),
        F.coalesce("is_duplicate", F.lit(False)) if dedup else F.lit(False),
        F.coalesce("needs_image", F.lit(False)),
        F.length(F.coalesce("source_query.message", F.lit(""))) < least_query,
        F.col("judge_average").isNull() | (F.col("judge_average") < least_average),
        F.coalesce(response, F.lit("")) == "",
        F.coalesce(last >= F.coalesce("source_query.turn_index", F.lit(0)), F.lit(False)),
    )
    reason = F.lit(None).cast("string")
    for name, bad in reversed(list(zip(FUNNEL, fails))):
        reason = F.when(bad, name).otherwise(reason)
    return df.withColumn("fail_reason", reason)


def benchmark_entries(df: DataFrame) -> DataFrame:
    """The 29 fields of a benchmark case, of records that pass the funnel."""
    response = F.coalesce(message_at(F.col("full_history"), F.col("dislike_turn_id"))["message"], F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    none = F.array().cast("array<string>")
    return df.filter("fail_reason is null").select(
        "cid",
        "save_time",
        F.struct(F.col("source_query.turn_index").alias("turn_index"), F.coalesce("source_query.message", F.lit("")).alias("message")).alias("source_query"),
        F.transform("selected_history", lambda m: m["turn_index"]).alias("selected_turn_indices"),
        "selected_history",
        response.alias("agent_response_full"),
        "failure_dimension",
        "failure_dimension_raw",
        "scenario",
        "severity_tier",
        "overall_quality",
        "judge_average",
        "judge_scores",
        "judge_audit",
        "needs_context",
        flag("needs_image"),
        flag("is_duplicate"),
        "explanation",
        F.col("agent_response_preview") if "agent_response_preview" in df.columns else F.substring(response, 1, 200).alias("agent_response_preview"),
        "signal_type",
        "signal_confidence",
        "dislike_turn_id",
        "representativeness",
        "confidence",
        F.col("qa_verdict.verdict").alias("qa_verdict"),
        F.coalesce("qa_verdict.issues", none).alias("qa_issues"),
        F.coalesce("qa_verdict.notes", F.lit("")).alias("qa_notes"),
        flag("failure_dimension_reclassified"),
        "reclassify_confidence",
    )


def review_summary(df: DataFrame, strong: bool = False) -> Column:
    """What a reviewer is shown of a record. Short: 150 characters of query and explanation, 250 of the reply. Strong: 300, 500, and what came before the query."""
    text = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    said = lambda turn: F.coalesce(F.get(F.filter("full_history", lambda m: (m["turn_index"] == turn) & (m["role"] == "assistant")), F.lit(0))["message"], F.lit(""))
    asked = F.coalesce("source_query.turn_index", F.lit(0))
    plain = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    average = F.coalesce("judge_average", F.lit(0.0)).alias("judge_average")
    if not strong:
        return F.struct(text(F.col("source_query.message"), 150).alias("source_query"), text(said(F.col("dislike_turn_id")), 250).alias("agent_response_preview"), plain("failure_dimension"), text(F.col("explanation"), 150).alias("explanation"), plain("signal_type"), average, plain("overall_quality"))
    return F.struct(
        text(F.col("source_query.message"), 300).alias("source_query"),
        text(said(asked - 1), 300).alias("prior_turn"),
        text(said(F.col("dislike_turn_id")), 500).alias("agent_response_preview"),
        plain("failure_dimension"),
        text(F.col("explanation"), 300).alias("explanation"),
        plain("signal_type"),
        plain("signal_confidence"),
        average,
        F.floor(asked / 2).cast("int").alias("context_rounds"),
    )


#: The fields of a candidate's summary for a judge, with their types.
SUMMARY = (
    ("dislike_turn_id", "int"), ("source_query_turn_id", "int"), ("source_query_text", "string"), ("agent_response_preview", "string"), ("failure_dimension", "string"), ("scenario", "string"), ("signal_type", "string"), ("signal_confidence", "string"),
    ("sentiment", "string"), ("complaint_snippet", "string"), ("explanation", "string"), ("user_reaction_after_failure", "string"), ("recovery_attempted", "boolean"), ("recovery_successful", "boolean"), ("representativeness", "string"), ("confidence", "double"),
)


def candidate_summary(df: DataFrame, index: str = "idx", preview: int = 200) -> Column:
    """A candidate as a JSON text of its index and the fields of SUMMARY; those that df lacks are null, and the answer is cut."""
    value = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    cut = F.substring(F.coalesce(value("agent_response_preview", "string"), F.lit("")), 1, preview)
    fields = [(cut if c == "agent_response_preview" else value(c, kind)).alias(c) for c, kind in SUMMARY]
    return F.to_json(F.struct(F.coalesce(value(index, "int"), F.lit(0)).alias("candidate_index"), *fields), {"ignoreNullFields": "false"})


def track(df: DataFrame) -> Column:
    signal, dislike = F.col("signal_type"), F.col("signal_type") == "dislike"
    explicit = signal.isin(L.EXPLICIT_SIGNALS) | (dislike & (F.col("sentiment") == "explicit"))
    sure = dislike & (F.coalesce("judge_average", F.lit(0.0)) >= 4.5) & (F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) >= 0.9)
    return F.when(F.coalesce(explicit | sure, F.lit(False)), "A").otherwise("B")


def track_a(df: DataFrame, after: int = 6) -> DataFrame:
    """Dialogue up to the failing reply, which is blanked, and the turns after it."""
    at = F.col("dislike_turn_id")
    until = F.when(at.isNull() | (at == 0), 999).otherwise(at)
    failing = lambda m: (m["turn_index"] == at) & (m["role"] == "assistant")
    context = F.transform(
        F.filter("full_history", lambda m: F.coalesce(failing(m), F.lit(False)) | (m["turn_index"] <= until)),
        lambda m: F.struct(m["turn_index"].alias("turn_index"), m["role"].alias("role"), F.when(failing(m), L.BLANK).otherwise(F.substring(F.coalesce(m["message"], F.lit("")), 1, 2000)).alias("content")),
    )
    place = F.array_position(F.transform("full_history", lambda m: m["turn_index"]), at)
    rest = F.when(place > 0, F.filter(F.slice("full_history", place.cast("int") + 1, F.greatest(F.size("full_history"), F.lit(1))), lambda m: m["turn_index"] != at))
    recovery = F.transform(F.slice(F.coalesce(rest, F.slice("full_history", 1, 0)), 1, after), lambda m: F.struct(m["turn_index"].alias("turn_index"), m["role"].alias("role"), F.substring(F.coalesce(m["message"], F.lit("")), 1, 1000).alias("content")))
    failed = F.coalesce(F.get(F.filter("full_history", failing), F.lit(0))["message"], F.lit(""))
    return df.withColumns({"dialogue_context": context, "recovery_turns": recovery, "original_failed_response": F.substring(failed, 1, 3000)}).withColumn("has_recovery", F.size("recovery_turns") > 0)


def track_b(df: DataFrame, reactions: DataFrame) -> DataFrame:
    """Dialogue with labelled turns. reactions: cid, user_reactions (array of asst_turn_id, reaction, dissatisfied)."""
    joined = df.join(reactions, "cid", "left")
    at = F.col("dislike_turn_id")

    def labelled(m: Column) -> Column:
        of = F.get(F.filter("user_reactions", lambda r: (r["asst_turn_id"] == m["turn_index"]) & (m["role"] == "assistant")), F.lit(0))
        return F.struct(
            m["turn_index"].alias("turn_index"),
            m["role"].alias("role"),
            F.substring(F.coalesce(m["message"], F.lit("")), 1, 2000).alias("content"),
            F.coalesce(m["is_unliked"], F.lit(False)).alias("is_unliked"),
            of["reaction"].alias("user_reaction"),
            of["dissatisfied"].alias("user_dissatisfied"),
            F.coalesce(m["turn_index"] == at, F.lit(False)).alias("is_failure_turn"),
        )

    return joined.withColumn("labeled_turns", F.transform("full_history", labelled)).drop("user_reactions")


def repaired_order(df: DataFrame) -> DataFrame:
    """Where the source query comes after the disliked turn, the last user turn before that takes its place; the original stays beside it."""
    s, d = F.expr("try_cast(source_query.turn_index as int)"), F.expr("try_cast(dislike_turn_id as int)")
    before = F.filter("full_history", lambda m: (m["turn_index"] < d) & (m["role"] == "user"))
    new = F.try_element_at(before, F.lit(-1))
    fixed = F.coalesce((s > d) & (F.size(before) > 0), F.lit(False))
    replaced = F.when(fixed, F.struct(new["turn_index"].alias("turn_index"), F.coalesce(new["message"], F.lit("")).alias("message"))).otherwise(F.col("source_query"))
    return df.withColumns({"source_query_original": F.when(fixed, F.col("source_query")), "ordering_fixed": fixed, "source_query": replaced})


#: Queries are compared by so many characters where a caller doesn't ask for whole ones.
COMPARED = 100
#: Groups of so many different texts are compared text by text.
SMALL = 5
#: Texts of a tile of a group; so many characters count as one text more.
TILE, TEXT = 16_384, 2_000
#: Buckets by which characters are counted. Counts are held up to MOST, so that differences are never overstated and their sum stays below 65,536.
LETTERS, MOST = 32, 2_047
#: From this length on, difflib looks up only characters that make up a hundredth of the second text at most.
POPULAR = 200
#: Characters of the grams of texts up to so many characters, of longer ones the last.
GRAMS = ((POPULAR, 2), (1_000, 4), (8_000, 6), (math.inf, 8))
#: Bits for the grams of a text, as a power of two: four to eight for each character, no more than this.
MOST_BITS = 17
#: Pairs whose counts are compared at once, words of grams, and pairs that are kept before they are settled.
BLOCK, WORDS, KEPT = 65_536, 131_072, 262_144


def _longest_common(text: str, other: str) -> int:
    """The length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i
    full = v = (1 << len(text)) - 1
    for c in other:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(text) - v.bit_count()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _gram_size(length: int) -> int:
    return next(size for most, size in GRAMS if length < most)


def _grams(p: np.ndarray, size: int) -> np.ndarray:
    mixed = p[: max(0, len(p) - size + 1)].copy()
    for i in range(1, size):
        mixed *= np.uint32(2654435761)
        mixed += p[i : len(mixed) + i]
    return mixed


def _buckets(grams: np.ndarray, buckets: int) -> np.ndarray:
    return ((grams ^ (grams >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(33 - buckets.bit_length())


def _grams_differ(x: str, y: str, threshold: float) -> bool:
    """Whether two texts have grams too different to be near (see ``_similar``), of which here all occurrences count."""
    size, u, x, y = _gram_size(len(y)), (1.0 - threshold) * (len(x) + len(y)) + 0.01, _points(x), _points(y)
    of_x, of_y = (np.bincount(p, minlength=int(max(x.max(), y.max())) + 1) for p in (x, y))
    found = of_y <= len(y) // 100 + 1
    buckets = 1 << (8 * len(y)).bit_length()
    differ = np.abs(np.subtract(*(np.bincount(_buckets(_grams(p, size), buckets), minlength=buckets) for p in (x, y)))).sum()
    return differ > u + 2 * (size - 1) * min(u, np.minimum(of_x, of_y)[found].sum())


def _is_near(x: str, y: str, threshold: float) -> bool:
    """Whether difflib's ratio of two texts is above the threshold. Its blocks are looked for until that is certain."""
    both = len(x) + len(y)
    above = lambda m: 2.0 * m / both > threshold
    short, long = sorted((x, y), key=len)
    if not above(len(short)):
        return False
    if long.startswith(short):  # the longest block is the whole of it
        return True
    if both < 2 * POPULAR and not above(_longest_common(x, y)):  # what is matched is a common subsequence
        return False
    if len(y) >= POPULAR and _grams_differ(x, y, threshold):
        return False
    blocks = _Blocks(x, y)
    matched, left, parts = 0, len(short), [(0, len(x), 0, len(y))]
    while parts and not above(matched) and above(matched + left):
        x0, x1, y0, y1 = parts.pop()
        i, j, k = blocks.longest(x0, x1, y0, y1)
        left -= min(x1 - x0, y1 - y0)
        matched += k
        for part in ((x0, i, y0, j), (i + k, x1, j + k, y1)) if k else ():
            if size := min(part[1] - part[0], part[3] - part[2]):
                left += size
                parts.append(part)
    return above(matched)


class _Blocks:
    """The blocks that difflib's SequenceMatcher(None, x, y) finds; only the places of characters that it looks up are visited."""

    def __init__(self, x: str, y: str):
        self.x, self.y, often = x, y, Counter(y)
        if len(y) >= POPULAR:
            most = len(y) // 100 + 1
            often = {c for c, n in often.items() if n <= most}
        self.places: dict[str, list[int]] = {c: [] for c in often}
        for j, c in enumerate(y):
            if c in often:
                self.places[c].append(j)
        self.visited = [i for i, c in enumerate(x) if c in often]

    def longest(self, x0: int, x1: int, y0: int, y1: int) -> tuple[int, int, int]:
        """What find_longest_match says."""
        x, y, visited = self.x, self.y, self.visited
        i, j, k, last, lengths = x0, y0, 0, -1, {}
        for at in visited[bisect_left(visited, x0) : bisect_left(visited, x1)]:
            if at != last + 1:
                lengths = {}
            last, new, places = at, {}, self.places[x[at]]
            for p in places[bisect_left(places, y0) : bisect_left(places, y1)]:
                new[p] = n = lengths.get(p - 1, 0) + 1
                if n > k:
                    i, j, k = at - n + 1, p - n + 1, n
            lengths = new
        while i > x0 and j > y0 and x[i - 1] == y[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < x1 and j + k < y1 and x[i + k] == y[j + k]:
            k += 1
        return i, j, k


def _near(groups: DataFrame, threshold: float) -> DataFrame:
    """g, q, best: the best judged near text of each text that has one. groups: g, texts (w, first, q), the best judged first."""
    kinds = dict(groups.select(F.col("texts")[0]["w"]["j"].alias("judged"), F.col("texts")[0]["w"]["of"].alias("of")).dtypes)

    def run(batches):
        for batch in batches:
            lists, found = batch.column("texts"), []
            flat, at = lists.flatten(), 0
            q, first, (judged, of) = flat.field("q"), flat.field("first"), flat.field("w").flatten()
            for size in pc.list_value_length(lists).to_pylist():
                of_group = range(at, at := at + size)
                texts = {i: (first[i].as_py(), q[i].as_py()) for i in of_group}
                w = {i: repr((judged[i].as_py(), of[i].as_py())) for i in of_group}
                for i in of_group:
                    near = (o for o in range(of_group.start, i) if w[o] != w[i] and _is_near(*(t[1] for t in sorted((texts[i], texts[o]))), threshold))
                    found += [(i, o) for o in itertools.islice(near, 1)]
            left, right = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
            yield pa.record_batch([batch.column("g").take(pc.list_parent_indices(lists).take(left)), q.take(left), judged.take(right), of.take(right)], names=["g", "q", "judged", "of"])

    near = groups.select("g", "texts").mapInArrow(run, f"g string, q string, judged {kinds['judged']}, of {kinds['of']}")
    return near.select("g", "q", F.struct(F.col("judged").alias("j"), "of").alias("best"))


def near_duplicates(df: DataFrame, id_column: str, threshold: float = 0.90, compared: int | None = COMPARED) -> DataFrame:
    """id, duplicate_of: records of one dialogue, failing turn and source turn whose queries are nearly the same.

    Queries are compared by their first characters, or, with None, as a whole. The better judged record stays, of equals the one with the
    smaller id. Null keys are equal to each other; rows without an id or a query are no duplicates. Equal queries are merged first.

    What a record needs is its best judged near text. Small groups are compared text by text, larger ones by ``nearest_better``.
    Pairs are compared in the order of their first ids. df is read twice: for fingerprints of all queries, and for those that have others beside them.
    """
    keys = F.to_json(F.struct("cid", "dislike_turn_id", F.col("source_query.turn_index").alias("st")))
    message = F.coalesce("source_query.message", F.lit(""))
    query = message if compared is None else F.substring(message, 1, compared)
    fingerprint = F.unhex(F.sha2("q", 256))
    rows = df.select(F.col(id_column).alias("id"), keys.alias("g"), query.alias("q"), F.struct((-F.coalesce("judge_average", F.lit(0.0))).alias("j"), F.col(id_column).alias("of")).alias("w")).filter("q <> '' and id is not null").withColumn("h", fingerprint)
    k = materialize(rows.select("id", "g", "h", "w"), "queries")
    texts = materialize(k.groupBy("g", "h").agg(F.min("id").alias("first"), F.min("w").alias("w")), "texts")
    # a text alone in its group is near no other
    sizes = texts.groupBy("g").agg(F.count("*").alias("size")).filter("size > 1")
    wanted = materialize(texts.join(sizes, "g").withColumnsRenamed({"first": "id", "w": "best"}), "wanted")
    several = rows.select("id", "g", "h", "q").join(wanted, ["id", "g", "h"]).dropDuplicates(["id", "g", "h"])
    several = materialize(several.select("g", "q", F.col("id").alias("first"), F.col("best").alias("w"), "size"), "several")

    few, many = several.filter(F.col("size") <= SMALL), several.filter(F.col("size") > SMALL).drop("size")
    groups = few.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("w", "first", "q"))).alias("texts"))
    near = _near(groups, threshold).unionByName(nearest_better(many, threshold)).select("g", fingerprint.alias("h"), "best")
    best = texts.select("g", "h", F.col("w").alias("best")).unionByName(near).groupBy("g", "h").agg(F.min("best").alias("best"))
    marked = k.join(best, ["g", "h"]).filter((F.col("best") < F.col("w")) & (F.col("best")["of"] != F.col("id")))
    return marked.groupBy("id").agg(F.min("best")["of"].alias("duplicate_of"))


def _ranks(columns: list[pa.Array]) -> np.ndarray:
    """The place of each row in the order of these columns; equal rows have the same."""
    table = pa.table(dict(zip("abc", columns)))
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names])
    new = np.zeros(len(order), bool)
    for c in table.columns:
        x = c.take(order).combine_chunks()
        same = pc.equal(x[1:], x[:-1])
        if pa.types.is_floating(x.type):  # all that are no numbers are equal
            same = pc.or_(same, pc.and_(pc.is_nan(x[1:]), pc.is_nan(x[:-1])))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    out = np.empty(len(order), np.int64)
    out[order.to_numpy()] = np.cumsum(new)
    return out


def _gram_bits(texts: list[str], size: int, bits: int) -> np.ndarray:
    """For each text (a row) the buckets that its grams fall into, as bits; a gram's second place counts as another gram, and so on."""
    out, seen = np.empty((len(texts), bits // 8), np.uint8), np.zeros(bits, bool)
    for row, text in zip(out, texts):
        grams = _grams(_points(text), size)
        grams.sort()
        at = np.arange(len(grams), dtype=np.uint32)
        at[1:] -= np.maximum.accumulate(np.where(grams[1:] != grams[:-1], at[1:], 0))
        found = _buckets(grams + at * np.uint32(2246822519), bits)
        seen[found] = True
        row[:] = np.packbits(seen)
        seen[found] = False
    return out.view(np.uint64)


def _count_bits(x: np.ndarray) -> np.ndarray:
    """The bits of each row, whose words are a multiple of eight: counts of a byte are added in pairs, then in four lanes."""
    x = np.bitwise_count(x).view(np.uint64)
    even = np.uint64(0x00FF00FF00FF00FF)
    lanes = ((x & even) + ((x >> np.uint64(8)) & even)).sum(1)
    return lanes.view(np.uint16).reshape(len(x), 4).sum(1, dtype=np.int64)


class _Tile:
    """Texts of a tile in the order of their lengths, with the counts of their characters and how many of them difflib looks up."""

    def __init__(self, texts: list[str], places: np.ndarray, turns: np.ndarray):
        lengths = np.array([len(texts[i]) for i in places], np.int64)
        order = np.argsort(lengths, kind="stable")
        self.places, self.lengths = places[order], lengths[order]
        self.texts, self.turns = [texts[i] for i in self.places], turns[self.places]
        self.counts, self.looked_up = np.empty((LETTERS, len(order)), np.int16), self.lengths.copy()
        for i, text in enumerate(self.texts):
            p = _points(text)
            self.counts[:, i] = np.minimum(np.bincount(p % LETTERS, minlength=LETTERS), MOST)
            if len(p) >= POPULAR:
                often = np.bincount(p) if p.max() < 65_536 else np.unique(p, return_counts=True)[1]
                self.looked_up[i] = often[often <= len(p) // 100 + 1].sum()


def _similar(a: _Tile, b: _Tile, threshold: float):
    """The places of the pairs of two tiles (of one, with itself) that may be near, in parts. No text of b is shorter than one of a.

    Texts with m matched characters differ by u unmatched ones, their lengths less 2m: in their counts of characters by as many at most. What is
    matched lies in blocks; between two of them is an unmatched character, and all but the first hold a character that difflib looks up. A
    block has all its grams but size - 1, so texts differ by u + 2 (size - 1) grams for each block but the first.
    """
    share, reach = 1.0 - threshold, (2.0 - threshold) / threshold
    start = 0
    while start < len(a.lengths):
        stop = int(np.searchsorted(a.lengths, a.lengths[start] * 1.25, "right"))
        low = start if a is b else 0
        high = int(np.searchsorted(b.lengths, a.lengths[stop - 1] * reach + 0.01, "right"))
        if high > low:
            longest = int(b.lengths[high - 1])
            size, bits = _gram_size(longest), 1 << min(max(9, (4 * longest).bit_length()), MOST_BITS)
            theirs = _gram_bits(b.texts[low:high], size, bits)
            mine = theirs if a is b else _gram_bits(a.texts[start:stop], size, bits)
            rows = max(1, BLOCK // (high - low))
            for r in range(start, stop, rows):
                end = min(r + rows, stop)
                c, c_end = (r if a is b else low), int(np.searchsorted(b.lengths, a.lengths[end - 1] * reach + 0.01, "right"))
                total, one = np.zeros((end - r, c_end - c), np.uint16), np.empty((end - r, c_end - c), np.int16)
                for x, y in zip(a.counts[:, r:end, None], b.counts[:, None, c:c_end]):
                    np.subtract(x, y, out=one)
                    np.absolute(one, out=one)
                    np.add(total, one.view(np.uint16), out=total)
                x, y = np.nonzero(total <= (share * a.lengths[r:end, None] + 0.01).astype(np.float32) + (share * b.lengths[c:c_end]).astype(np.float32))
                ends = np.searchsorted(x, np.arange(1, end - r + 1)).tolist()
                for i, first, last in zip(range(r, end), [0, *ends], ends):
                    places = y[first:last] + c
                    places = places[np.searchsorted(places, i, "right") if a is b else 0 :]
                    for k in range(0, len(places), step := max(1, WORDS * 64 // bits)):
                        j = places[k : k + step]
                        u = share * (a.lengths[i] + b.lengths[j]) + 0.01
                        blocks = np.minimum(u, np.where(a.turns[i] < b.turns[j], b.looked_up[j], a.looked_up[i]))
                        differ = theirs[j - low]
                        differ ^= mine[i - start]
                        j = j[_count_bits(differ) <= u + 2 * (size - 1) * blocks]
                        yield np.full(len(j), a.places[i]), b.places[j]
        start = stop


def nearest_better(texts: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """g, q, best: the best judged near text of each text of a group (g, q, first, w) that has one.

    Texts are near only if their lengths are. So groups are cut by length into tiles, and each two tiles whose lengths are near meet in a task: counts
    of characters, then grams, which no near text may have too different, rule out nearly all pairs; what is left is compared, the best judged first,
    until one is near. No pair becomes a row: what is shuffled is a text for each tile of near lengths. The pairs of counts are quadratic in
    the texts of near lengths.
    """
    texts = texts.withColumn("n", F.length("q"))
    by_length = W.partitionBy("g").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    reach = W.partitionBy("g").orderBy((F.log("n") * 1_000_000).cast("long"))
    far = int(1_000_000 * math.log((2.0 - threshold) / threshold)) + 2
    lengths = texts.groupBy("g", "n").agg(F.sum(TEXT + F.col("n")).alias("weight")).withColumn("until", F.sum("weight").over(by_length))
    # a length lies in one tile, or is spread over several
    lengths = lengths.withColumns({"t0": F.expr(f"int((until - weight) div {tile * TEXT})"), "t1": F.expr(f"int((until - 1) div {tile * TEXT})")})
    lengths = lengths.withColumns({"from": F.min("t0").over(reach.rangeBetween(-far, 0)), "to": F.max("t1").over(reach.rangeBetween(0, far))})
    cut = texts.join(lengths.select("g", "n", "t0", "t1", "from", "to"), ["g", "n"]).withColumn("t", (F.col("t0") + F.pmod(F.xxhash64("q"), F.col("t1") - F.col("t0") + 1)).cast("int"))
    rows = cut.withColumn("k", F.explode(F.sequence("from", "to"))).select("g", F.least("t", "k").alias("i"), F.greatest("t", "k").alias("j"), "t", "q", "first", F.col("w.j").alias("judged"), F.col("w.of").alias("of"))
    kinds = dict(rows.dtypes)

    def run(group: pa.Table) -> pa.Table:
        judged, of, first, q = (group.column(c).combine_chunks() for c in ("judged", "of", "first", "q"))
        ranks, turns = _ranks([judged, of]), _ranks([first, q])
        texts, tiles = q.to_pylist(), group.column("t").to_numpy()
        a, *others = (_Tile(texts, np.flatnonzero(tiles == t), turns) for t in np.unique(tiles))
        best: dict[int, int] = {}

        def settle(kept: list[tuple[np.ndarray, np.ndarray]]) -> None:
            x, y = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
            worse, better = np.where(ranks[x] > ranks[y], x, y), np.where(ranks[x] > ranks[y], y, x)
            order = np.lexsort((ranks[better], worse))
            for w, o in zip(worse[order].tolist(), better[order].tolist()):
                if ranks[o] < ranks[best.get(w, w)] and _is_near(*((texts[w], texts[o]) if turns[w] < turns[o] else (texts[o], texts[w])), threshold):
                    best[w] = o

        if group.column("i")[0] == group.column("j")[0] or others:
            kept, n = [], 0
            for pairs in _similar(a, *(others or [a]), threshold):
                kept.append(pairs)
                n += len(pairs[0])
                if n >= KEPT:
                    settle(kept)
                    kept, n = [], 0
            if kept:
                settle(kept)
        left, right = (pa.array(list(x), pa.int64()) for x in (best.keys(), best.values()))
        return pa.table([group.column("g").take(left), q.take(left), judged.take(right), of.take(right)], names=["g", "q", "judged", "of"])

    near = rows.groupBy("g", "i", "j").applyInArrow(run, f"g string, q string, judged {kinds['judged']}, of {kinds['of']}")
    return near.groupBy("g", "q").agg(F.min(F.struct(F.col("judged").alias("j"), "of")).alias("best"))


def numbered(df: DataFrame, order: list[str], prefix: str, name: str = "id") -> DataFrame:
    """Adds ids <prefix>_00001 and on in a total order, with no window over all rows.

    Rows are range-partitioned by the order; the partitions' sizes, one row each, give every partition its first number.
    """
    sorted_rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = sorted_rows.groupBy("_part").agg(F.count("*").alias("n"))
    first = sizes.withColumn("_first", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    n = F.col("_first") + F.col("_in")
    return sorted_rows.withColumn("_in", inside).join(F.broadcast(first), "_part").withColumn(name, F.concat(F.lit(f"{prefix}_"), F.lpad(n.cast("string"), 5, "0"))).drop("_part", "_first", "_in")


def merged_verdicts(df: DataFrame, v1: str = "v1", v2: str = "v2") -> Column:
    """One verdict of two: both reject, else one of them or a downgrade downgrades; a missing one leaves the other."""
    a, b = F.col(v1), F.col(v2)
    return (
        F.when(a.isNull() & b.isNull(), "keep").when(a.isNull(), b).when(b.isNull(), a)
        .when((a == "reject") & (b == "reject"), "reject")
        .when((a == "reject") | (b == "reject") | (a == "downgrade") | (b == "downgrade"), "downgrade")
        .otherwise("keep")
    )


def routed(candidates: DataFrame, judged: DataFrame, reasons: DataFrame | None = None, least_confidence: float = 0.6) -> DataFrame:
    """Adds route, quality and reason to candidates (cid, idx, ...).

    reasons: cid, reason of the prefilter; dialogues that don't pass are deleted. A candidate without a judgement is saved as
    medium if the miner was sure enough. Corrections of the judge take effect.
    """
    j = judged.withColumnRenamed("candidate_index", "idx")
    out = candidates.join(j, ["cid", "idx"], "left")
    if reasons is not None:
        out = out.join(reasons.withColumnRenamed("reason", "_reason"), "cid", "left")
    else:
        out = out.withColumn("_reason", F.lit("pass"))
    sure = F.coalesce("confidence", F.lit(0.0)) >= least_confidence
    failed, missing = F.coalesce("_reason", F.lit("pass")) != "pass", F.col("should_keep").isNull()
    route = F.when(failed, "deleted").when(missing, F.when(sure, "saved").otherwise("rejected")).when(F.col("should_keep"), "saved").otherwise("rejected")
    quality = F.when(failed, F.lit(None)).when(missing, F.when(sure, "medium")).otherwise(F.col("overall_quality"))
    why = F.when(failed, F.concat(F.lit("prefilter:"), "_reason")).when(missing, F.when(~sure, "judge_batch_missed_low_conf")).when(~F.col("should_keep"), F.concat(F.lit("judge_rejected:"), F.coalesce("overall_quality", F.lit("low"))))
    return out.withColumns({"route": route, "quality": quality, "reason": why, "failure_dimension": F.coalesce("corrected_dimension", "failure_dimension")}).drop("_reason")


#: Label fields of a saved record that come from the miner as they are, and those with a default.
MINED = ("dislike_turn_id", "scenario", "sentiment", "complaint_snippet", "explanation", "recovery_attempted", "recovery_successful", "representativeness", "confidence")
MINED_DEFAULTS = {"signal_type": "dislike", "signal_confidence": "high", "agent_response_preview": "", "user_reaction_after_failure": ""}


def saved_entries(candidates: DataFrame, dialogues: DataFrame, enrichment: DataFrame | None = None, saved_at: Column | None = None) -> DataFrame:
    """Saved records of routed candidates: cid, save_time, tags, source query, history before it, full history, enrichment and the 24 labels.

    enrichment: cid, user_reactions, recovery_chains, reaction_summary, total_dissatisfied. Fields that the candidates lack are null, or their default.
    """
    joined = candidates.filter("route = 'saved'").join(dialogues, "cid")
    has = lambda c: F.col(c) if c in joined.columns else F.lit(None)
    source = F.col("source_query_turn_id")
    sentiment = F.coalesce(has("sentiment").cast("string"), F.lit("implicit"))
    labelled = normalised(joined.withColumn("_raw_dim", F.coalesce("failure_dimension", F.lit(""))), "_raw_dim", "_dim")
    label = F.struct(
        *((sentiment if c == "sentiment" else has(c)).alias(c) for c in MINED),
        F.col("_dim").alias("failure_dimension"),
        F.col("_raw_dim").alias("failure_dimension_raw"),
        *(F.coalesce(has(c).cast("string"), F.lit(v)).alias(c) for c, v in MINED_DEFAULTS.items()),
        *(has(c).alias(c) for c in ("judge_scores", "judge_average")),
        F.col("quality").alias("overall_quality"),
        *(has(c).alias(c) for c in ("judge_audit", "miner_model", "judge_model", "miner_latency_s", "judge_latency_s")),
        (F.coalesce(has("miner_tokens").cast("long"), F.lit(0)) + F.coalesce(has("judge_tokens").cast("long"), F.lit(0))).alias("total_tokens"),
    )
    before = F.filter("history", lambda m: m["turn_index"] < F.coalesce(source, F.lit(0)))
    out = labelled.withColumns(
        {
            "save_time": F.date_format(F.current_timestamp() if saved_at is None else saved_at, "yyyy-MM-dd HH:mm:ss"),
            "tags": F.array(F.when(sentiment == "explicit", "failure_testcase").otherwise("query_testcase")),
            "source_query": F.struct(source.alias("turn_index"), F.coalesce(message_at(F.col("history"), source)["message"], F.lit("")).alias("message")),
            "selected_turn_indices": F.transform(before, lambda m: m["turn_index"]),
            "selected_history": before,
            "auto_label": label,
        }
    )
    columns = ["cid", "idx", "save_time", "tags", "source_query", "selected_turn_indices", "selected_history", F.col("history").alias("full_history"), "auto_label"]
    if enrichment is None:
        return out.select(*columns)
    fields = ("user_reactions", "recovery_chains", "reaction_summary", "total_dissatisfied")
    found = enrichment.select("cid", F.struct(*fields).alias("enrichment"))
    return out.select(*columns).join(found, "cid", "left")
