"""Text features as Column expressions. Lists and patterns are arguments, with the lexicons as defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions import lexicons as L


def or_default(c: Column, default) -> Column:
    """c, or the default where c is null, empty, 0 or false."""
    value = F.lit(default)
    empty = F.lit("") if isinstance(default, str) else F.lit(0)
    return F.when(c.isNull() | (c == empty), value).otherwise(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def alternation(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def parse_time(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def complaint_snippet(text: Column, pattern: str | None = None, group: int = 0, limit: int = 300) -> Column:
    """The first complaint in a text of at most limit characters; null if there is none."""
    p = "(?iu)" + (pattern or alternation(L.COMPLAINT_PATTERNS))
    return F.when((F.length(text) <= limit) & text.rlike(p), F.regexp_extract(text, p, group))


def is_interrupted(text: Column, markers: list[str] = L.INTERRUPTIONS) -> Column:
    t = strip(text)
    return t.isin(markers) | (F.length(t) < 4)


def clean(text: Column) -> Column:
    """For comparisons: stripped, lower case, without the listed punctuation and white space."""
    return F.regexp_replace(F.lower(strip(text)), r"(?U)[，。！？、；：“”‘’（）()\[\]{}\s\n\r]+", "")


def characters(cleaned: Column) -> Column:
    return F.array_distinct(F.filter(F.split(cleaned, ""), lambda c: c != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the characters of two cleaned texts; 0 if either is empty."""
    x, y = characters(a), characters(b)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of the sequence similarity: twice the common characters, counted with repeats, over both lengths."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(characters(a), F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(2.0 * common / (F.length(a) + F.length(b)))


def edit_bound(a: Column, b: Column) -> Column:
    """An upper bound of the sequence similarity: with m matched characters in order, at most both lengths less 2m edits lead from a to b."""
    return F.coalesce(1.0 - F.levenshtein(a, b) / F.nullif(F.length(a) + F.length(b), F.lit(0)), F.lit(0.0))


def is_short_dismissal(text: Column, words: list[str] | None = L.DISMISSALS, limit: int = 20) -> Column:
    """At most limit characters and one of the words, but for case and marks at the end; without words, any short text."""
    t = strip(text)
    short = F.length(t) <= limit
    return short if words is None else short & F.regexp_replace(F.lower(t), "[。.！!~～]+$", "").isin(words)


def unsafe_snippet(text: Column, pattern: str | None = None) -> Column:
    p = "(?iu)" + (pattern or alternation(L.UNSAFE_PATTERNS))
    return F.when(text.rlike(p), F.substring(F.regexp_extract(text, p, 0), 1, 30))


def needs_image(query: Column, history: Column, pattern: str | None = None, uploads: tuple[str, ...] = ("用户上传了图片", "[图片]")) -> Column:
    p = pattern or "|".join(L.IMAGE_KEYWORDS)

    def uploaded(m: Column) -> Column:
        text = F.coalesce(m["message"], F.lit(""))
        found = F.lit(False)
        for u in uploads:
            found = found | F.contains(text, F.lit(u))
        return found

    return F.coalesce(query, F.lit("")).rlike(p) | F.coalesce(F.exists(F.slice(history, 1, 5), uploaded), F.lit(False))


def needs_context(completeness: Column) -> Column:
    return or_default(completeness, 5) <= 2


def severity_tier(severity: Column) -> Column:
    s = or_default(severity, 3)
    return F.when(s >= 4, "critical").when(s >= 3, "moderate").otherwise("mild")


def dimension(raw: Column, canonical: list[str] = L.DIMENSIONS, rules: list[tuple[str, str]] = L.DIMENSION_RULES) -> Column:
    found = F.when(raw.isNull() | (raw == "") | (raw == "?"), L.OTHER).when(raw.isin(canonical), raw)
    for pattern, name in rules:
        found = found.when(raw.rlike("(?iu)" + pattern), name)
    return found.otherwise(L.OTHER)


def query_key(query: Column) -> Column:
    """White space collapsed, lower case, first 60 characters."""
    return F.substring(F.lower(F.regexp_replace(strip(query), r"(?U)\s+", " ")), 1, 60)


def _bucket(v: Column, bounds: list[tuple[int, str]], last: str) -> Column:
    out = F.when(v.isNull(), "Unknown").when(v == 0, "0")
    for most, name in bounds:
        out = out.when(v <= most, name)
    return out.otherwise(last)


def depth_bucket(turn: Column) -> Column:
    return _bucket(turn, [(2, "1-2"), (5, "3-5"), (10, "6-10"), (20, "11-20"), (50, "21-50")], "50+")


def history_bucket(n: Column) -> Column:
    return _bucket(n, [(2, "1-2"), (5, "3-5"), (10, "6-10"), (15, "11-15")], "16+")


def position(order: list[str], c: Column) -> Column:
    """Place of a bucket in its canonical order, from 0."""
    return F.array_position(F.array(*map(F.lit, order)), c).cast("int") - 1


def rfind(text: Column, ch: str) -> Column:
    """Place of the last ch, from 0; -1 if there is none."""
    at = F.locate(ch, F.reverse(text))
    return F.when(at == 0, -1).otherwise(F.length(text) - at)


def _verdict_of(text: Column, source: str) -> Column:
    s = strip(text)
    good, bad, no = L.GOOD, L.BAD, L.NOT + L.GOOD
    last = strip(F.element_at(F.split(s, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), -1))
    has = lambda t, x: F.contains(t, F.lit(x))
    lh, lc = rfind(text, good), rfind(text, bad)
    lh = F.when((lh >= 1) & (F.substr(text, lh, F.lit(1)) == L.NOT), -1).otherwise(lh)
    out = lambda v, note: F.struct(F.lit(v).cast("int").alias("verdict"), F.lit(f"{note}_{source}").alias("note"))
    return F.when(
        F.length(F.coalesce(text, F.lit(""))) > 0,
        F.when(s == good, out(1, "exact"))
        .when(s == bad, out(-1, "exact"))
        .when(F.startswith(s, F.lit(good)), out(1, "starts"))
        .when(F.startswith(s, F.lit(bad)), out(-1, "starts"))
        .when(F.endswith(s, F.lit(good)), out(1, "ends"))
        .when(F.endswith(s, F.lit(bad)), out(-1, "ends"))
        .when(has(last, good) & ~has(last, bad) & ~has(last, no), out(1, "last_line"))
        .when(has(last, bad) & ~has(last, good), out(-1, "last_line"))
        .when(((lh > lc) & (lc >= 0)) | ((lh >= 0) & (lc < 0)), out(1, "rfind"))
        .when(((lc > lh) & (lh >= 0)) | ((lc >= 0) & (lh < 0)), out(-1, "rfind"))
        .when(has(text, "不满意") | has(text, "无法令用户满意"), out(-1, "kw_bad"))
        .when(has(text, "令用户满意") & ~has(text, "不令用户满意"), out(1, "kw_good")),
    )


def verdict(content: Column, reasoning: Column | None = None) -> Column:
    """(verdict, note) of a judge's answer: the answer first, then the end of its reasoning."""
    tail = F.lit("") if reasoning is None else F.substring(F.coalesce(reasoning, F.lit("")), -500, 500)
    none = F.struct(F.lit(None).cast("int").alias("verdict"), F.lit("cannot_parse").alias("note"))
    return F.coalesce(_verdict_of(F.coalesce(content, F.lit("")), "content"), _verdict_of(tail, "reasoning"), none)


def unfenced(text: Column) -> Column:
    s = strip(text)
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    return F.when(s.rlike(fence), strip(F.regexp_extract(s, fence, 1))).otherwise(s)


def binary_verdict(text: Column) -> Column:
    """(verdict, note) of an answer that should be a JSON object with a verdict of 1, 0 or -1."""
    c = unfenced(text)
    whole = F.get_json_object(c, "$.verdict")
    number = whole.rlike(r"^(-?1|0)(\.0+)?$") | whole.isin("true", "false")
    field, lone = r'"verdict"\s*:\s*(-?[01])', r'\{\s*"verdict"\s*:\s*(-?[01])\s*\}'
    bare = F.regexp_replace(c, r"""^"+|"+$""", "")
    bare = F.regexp_replace(bare, r"""^'+|'+$""", "")
    out = lambda v, note: F.struct(v.cast("int").alias("verdict"), F.lit(note).alias("note"))
    value = F.when(whole == "true", F.lit(1)).when(whole == "false", F.lit(0)).otherwise(whole.cast("double").cast("int"))
    return (
        F.when(text.isNull() | (text == ""), out(F.lit(None), "empty"))
        .when(number, out(value, "json_full"))
        .when(c.rlike(field), out(F.regexp_extract(c, field, 1), "regex"))
        .when(text.rlike(lone), out(F.regexp_extract(text, lone, 1), "reverse_scan"))
        .when(bare.isin("1", "-1"), out(bare, "bare_int"))
        .otherwise(out(F.lit(None), "no_verdict_found"))
    )


def preference_score(good: Column, bad: Column) -> Column:
    """Share of the good token in the probability of both, from log-probabilities."""
    return F.when(good.isNotNull() & bad.isNotNull(), F.exp(good) / (F.exp(good) + F.exp(bad))).when(good.isNotNull(), F.exp(good)).when(bad.isNotNull(), 1 - F.exp(bad))


def first_character_verdict(content: Column) -> Column:
    first = F.substring(strip(content), 1, 1)
    return F.when(first == L.GOOD, 1).when(first == L.BAD, -1).otherwise(0)


def quality_tier(average: Column, least: Column) -> Column:
    return F.when((average >= 4) & (least >= 3), "high").when((average >= 3) & (least >= 2), "medium").otherwise("low")


def truncated(text: Column, most: int) -> Column:
    return text if most <= 0 else F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(L.TRUNCATED))).otherwise(text)
