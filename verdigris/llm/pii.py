"""Operator 5, information-theoretic sanitisation of personal data, with native expressions only.

Base: e-mail addresses, IP addresses, payment cards and phone numbers by pattern (Luhn check, digit
counts and part sizes included); values assigned to names like token or password are secrets, found by pattern too. Their
places come from splitting the text at the pattern: the lengths of the gaps and of the matches add up to the starts.

Beyond the patterns, corpus co-occurrence estimates how strongly a term reveals a protected entity. Entities are the
normalised values, and what they have in common: the domain and the name of an address, the network of an IP address, the
issuer of a card, the area of a phone number, and each kind as such. For an entity e and a term t, with N documents,

    disclosure(t, e) = log(p(t, e) / (p(t) p(e))) / -log p(e)

is the share of e's information content that t gives away. In a document that holds e, terms with ``DISCLOSURE`` or
more are generalised to their class (number, code, name or word); terms that occur with e alone are removed. A pair counts
if it occurs in ``SUPPORT`` different texts at least, so that copies of a page prove nothing, and in so many that chance would
bring about ``CHANCE`` such meetings at most: texts * -log p(e) >= log(N / CHANCE).
Terms are the runs of letters, marks and digits outside the patterns' matches, and the runs of letters and marks in
them (a name before a number). Documents without matches are never changed.

Every statistic covers all documents. Equal texts are one row with its number of copies. Entities that occur in the same texts
have the same statistics and are one row, and so are terms of the same texts and count: a page that lists thousands of addresses
is not multiplied by its words. Pairs are counted with map-side combining, and joins are plain
equi-joins (skewed sides are split at run time); nothing is broadcast or collected.

Cases: null texts are empty; ids play no part, so repeated or null ones keep their own rows;
very long texts add up starts in blocks, in linear time; an empty table gives an empty result;
columns other than doc_id and text are kept by ``sanitised`` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import materialize, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE, SECRET, TERM = 4, 4, 5
DISCLOSURE, SUPPORT, CHANCE, BLOCK = 0.8, 2, 0.01, 256
#: What a word may hold, without and with digits.
LETTERS, WORD = r"\p{L}\p{M}", r"\p{L}\p{M}\p{N}"
# The patterns of the contract. Where a match can only start at the head of a run of characters
# (or where the last match ended), this is said, and what can't help by giving back is possessive:
# both keep the work linear in the length of a run and change no match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?i)(?:(?<=token)|(?<=secret)|(?<=passw(?:or)?d)|(?<=api[_-]?key))[\"']?[ \t]*[=:][ \t]*[\"']?[A-Za-z0-9+/_-]{16,}+",
}
#: A cheap test of whether a pattern can match at all.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "+", "secret": "[=:][ \t]*[\"']?[A-Za-z0-9+/_-]{16}"}
_SPAN = "struct<kind:int,start:bigint,end:bigint,value:string>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _matches(text: Column, pattern: Column | str) -> Column:
    """(start, end, value) of all matches; starts are added up in blocks, as growing one long array step by step is quadratic."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.zip_with(
        F.call_function("regexp_extract_all", text, pattern, F.lit(0)),
        F.call_function("split", text, pattern, F.lit(-1)),
        lambda m, g: F.struct(m.alias("m"), F.length(g).cast("long").alias("g"), F.coalesce(F.length(m), F.lit(0)).cast("long").alias("n")),
    )
    pairs = F.filter(pairs, lambda p: p["m"].isNotNull())
    at = "struct<at:bigint,out:array<struct<start:bigint,end:bigint,value:string>>>"
    block = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(block, lambda b: F.struct(b.alias("b"), F.aggregate(b, F.lit(0).cast("long"), lambda a, p: a + p["g"] + p["n"]).alias("n")))
    state = "struct<at:bigint,out:array<bigint>>"
    begins = F.aggregate(
        sums,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")).cast(state),
        lambda a, s: F.struct((a["at"] + s["n"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")).cast(state),
    )["out"]
    placed = F.zip_with(
        block,
        begins,
        lambda b, s: F.aggregate(
            b,
            F.struct(s.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("out")).cast(at),
            lambda a, p: F.struct(
                (a["at"] + p["g"] + p["n"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + p["g"]).alias("start"), (a["at"] + p["g"] + p["n"]).alias("end"), p["m"].alias("value")))).alias("out"),
            ).cast(at),
        )["out"],
    )
    return F.when(F.size(pairs) > 0, F.flatten(placed))


def base_spans(text: Column) -> Column:
    """All spans of the contract's four kinds, by kind as listed in KINDS, then start."""
    return F.concat(*(_of_kind(text, k, kind) for k, kind in enumerate(KINDS[:BASE])))


def secret_spans(text: Column) -> Column:
    """Assigned secrets, of each the value with its sign."""
    return _of_kind(text, SECRET, "secret")


def _of_kind(text: Column, k: int, kind: str) -> Column:
    gate = F.contains(text, F.lit(GATES[kind])) if len(GATES[kind]) == 1 else text.rlike(GATES[kind])
    found = F.when(gate, _matches(text, PATTERNS[kind]))
    kept = F.filter(found, lambda m: _valid(kind, m["value"]))
    spans = F.transform(kept, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.coalesce(spans, F.array().cast(f"array<{_SPAN}>"))


def _terms(found: DataFrame, term_chars: int, *keep: str) -> DataFrame:
    """The columns in keep, and the distinct terms of each text outside its spans. found: text, base, the columns in keep."""
    gaps = F.transform("base", lambda s: F.struct(F.lit(TERM).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("value")))
    rest = found.select(*keep, F.lower(F.when(F.size("base") > 0, redacted(F.col("text"), gaps)).otherwise(F.col("text"))).alias("rest"))
    words = F.split("rest", f"[^{WORD}]+")
    # of words with digits also the letters
    every = F.when(F.col("rest").rlike(r"\p{N}"), F.concat(words, F.split("rest", f"[^{LETTERS}]+"))).otherwise(words)
    terms = F.array_remove(F.array_distinct(every), "")
    return rest.select(*keep, (F.filter(terms, lambda t: F.length(t) >= term_chars) if term_chars > 1 else terms).alias("terms"))


def _entities(span: Column) -> Column:
    """What a match stands for: its value, what others may share with it, and its kind."""
    kind, value = span["kind"], F.when(span["kind"].isin(2, 3), _digits(span["value"])).otherwise(F.lower(span["value"]))
    shared = (
        F.when(kind == 0, F.array(F.concat(F.lit("domain:"), F.substring_index(value, "@", -1)), F.concat(F.lit("name:"), F.regexp_extract(value, "^[^@]*?([a-z]{2,})", 1))))
        .when(kind == 1, F.array(F.concat(F.lit("network:"), F.substring_index(value, ".", 3))))
        .when(kind == 2, F.array(F.concat(F.lit("issuer:"), F.substring(value, 1, 6))))
        .when(kind == 3, F.array(F.concat(F.lit("area:"), F.substring(value, 1, 5))))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.concat(F.array(F.concat(kind.cast("string"), F.lit(":"), value), kind.cast("string")), F.filter(shared, lambda e: e != "name:"))


def holders_of(found: DataFrame, term_chars: int) -> DataFrame:
    """same (hash of the text), copies, entities, terms of each different text with matches. found: text, base."""
    rows = found.filter(F.size("base") > 0)
    texts = rows.select(F.xxhash64("text").alias("same"), "text", "base").dropDuplicates(["same"])
    copies = rows.groupBy(F.xxhash64("text").alias("same")).agg(F.count("*").alias("copies"))
    named = texts.join(copies, "same").withColumn("entities", F.array_distinct(F.flatten(F.transform("base", _entities))))
    return _terms(named, term_chars, "same", "copies", "entities")


def _merged(rows: DataFrame, what: str, *also: str) -> DataFrame:
    """rows: same, copies, what, also. what, class (the least of those in the same texts), n (documents), texts; from SUPPORT texts on."""
    marks = (F.bit_xor(F.xxhash64("same", F.lit(k))).alias(f"mark{k}") for k in (1, 2))
    sums = rows.groupBy(what, *also).agg(F.sum("copies").alias("n"), F.count("*").alias("texts"), *marks).filter(F.col("texts") >= SUPPORT)
    classes = sums.groupBy("mark1", "mark2", "texts", *also).agg(F.min(what).alias("class"))
    return sums.join(classes, ["mark1", "mark2", "texts", *also]).select(what, "class", "n", "texts", *also)


def scored_terms(holders: DataFrame, found: DataFrame, term_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entity, class of entities; h (hash of a term), class of terms; entity class, term class, n_both, texts, n_entity, n_term, n_docs, disclosure of each pair."""
    named = holders.select("same", "copies", F.explode("entities").alias("entity"))
    entities = materialize(_merged(named, "entity"), "entities")
    held = named.join(entities.filter("entity = class").select("entity", F.col("n").alias("n_entity")), "entity")
    said = holders.select("same", "copies", F.explode("terms").alias("term")).select("same", "copies", F.xxhash64("term").alias("h"))
    often = said.groupBy("h").agg(F.count("*").alias("texts")).filter(F.col("texts") >= SUPPORT).select("h")
    # a term counts for as many documents as hold it, over the whole corpus
    in_docs = _terms(found, term_chars).select(F.explode("terms").alias("term")).groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("n_term"))
    terms = materialize(_merged(said.join(in_docs.join(often, "h", "left_semi"), "h"), "h", "n_term"), "terms")
    mine = said.join(terms.filter("h = class").select("h", "n_term"), "h").drop("copies")
    both = held.join(mine, "same").groupBy("entity", "h", "n_entity", "n_term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("texts")).filter(F.col("texts") >= SUPPORT)
    total = found.agg(F.count("*").alias("n_docs"))  # one row
    information = F.nullif(F.log(F.col("n_docs") / F.col("n_entity")), F.lit(0.0))
    scored = both.crossJoin(F.broadcast(total)).filter(F.col("texts") * information >= F.log(F.col("n_docs") / CHANCE))
    return entities, terms, scored.withColumn("disclosure", F.log(F.col("n_both") * F.col("n_docs") / (F.col("n_term") * F.col("n_entity"))) / information)


def disclosing_terms(found: DataFrame, term_chars: int = 1) -> DataFrame:
    """same and revealing, the (term, certain) that give away an entity of that text. found: text, base of all documents."""
    holders = materialize(holders_of(found, term_chars), "holders")
    entities, terms, scored = scored_terms(holders, found, term_chars)
    flagged = scored.filter(F.col("disclosure") >= DISCLOSURE).select("entity", F.col("h").alias("class"), (F.col("n_both") >= F.col("n_term")).alias("certain"))
    # back from classes to texts: those that hold the entity, and of their terms those of the class
    held = holders.select("same", F.explode("entities").alias("entity")).join(flagged, "entity").select("same", "class", "certain")
    said = holders.select("same", F.explode("terms").alias("term")).withColumn("h", F.xxhash64("term")).join(terms.select("h", "class"), "h")
    hits = said.join(held, ["same", "class"]).groupBy("same", "term").agg(F.max("certain").alias("certain"))
    return hits.groupBy("same").agg(F.sort_array(F.collect_list(F.struct("term", "certain"))).alias("revealing"))


def _class(value: Column) -> Column:
    """The tag of a generalised term."""
    return F.when(value.rlike(r"^\p{N}+$"), "[NUMBER]").when(value.rlike(r"\p{N}"), "[CODE]").when(value.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def detected(docs: DataFrame, keep: list[str] | None = None, term_chars: int = 1) -> DataFrame:
    """doc_id, text, the columns in keep, base, secrets and terms: arrays of (kind, start, end, value)."""
    keep = keep or []
    # matched once and written: every later step reads the spans
    text = F.col("text")
    found = materialize(docs.select("doc_id", text_or_empty("text").alias("text"), *keep).withColumns({"base": base_spans(text), "secrets": secret_spans(text)}), "based")
    every = found.select("text", F.concat("base", "secrets").alias("base"))
    # documents with matches are few, and no others can hold disclosing terms
    has = (F.size("base") > 0) | (F.size("secrets") > 0)
    some = found.filter(has).withColumn("same", F.xxhash64("text")).join(disclosing_terms(every, term_chars), "same", "left")
    # a term with digits is a whole word, others end where letters do; terms with digits come first, as they may begin with another term
    digits = F.filter("revealing", lambda r: r["term"].rlike(r"\p{N}"))
    letters = F.filter("revealing", lambda r: ~r["term"].rlike(r"\p{N}"))
    words = F.array_join(F.concat(F.transform(digits, lambda r: F.concat(F.lit(r"(?<!\p{N})"), r["term"], F.lit(r"(?!\p{N})"))), F.transform(letters, lambda r: r["term"])), "|")
    hits = _matches(F.col("text"), F.concat(F.lit(f"(?iu)(?<![{LETTERS}])(?:"), words, F.lit(f")(?![{LETTERS}])")))
    apart = F.filter(F.when(F.size("revealing") > 0, hits), lambda t: ~F.exists(F.concat("base", "secrets"), lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    certain = F.transform(F.filter("revealing", lambda r: r["certain"]), lambda r: r["term"])
    spans = F.transform(apart, lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.when(F.array_contains(certain, F.lower(t["value"])), F.lit("")).otherwise(_class(t["value"])).alias("value")))
    empty = F.array().cast(f"array<{_SPAN}>")
    some = some.select("doc_id", "text", *keep, "base", "secrets", F.coalesce(spans, empty).alias("terms"))
    return found.filter(~has).select("doc_id", "text", *keep, "base", "secrets", empty.alias("terms")).unionByName(some)


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its tag; of spans that overlap, the first gives the tag."""
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:TERM]))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["kind"] < TERM, F.get(tags, s["kind"])).otherwise(s["value"]).alias("tag"))))
    state = "struct<reach:bigint,out:array<struct<gap:bigint,start:bigint,tag:string>>>"
    laid = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("reach"), F.array().cast("array<struct<gap:bigint,start:bigint,tag:string>>").alias("out")).cast(state),
        lambda a, s: F.struct(
            F.greatest(a["reach"], s["end"]).alias("reach"),
            F.when(s["start"] >= a["reach"], F.concat(a["out"], F.array(F.struct(a["reach"].alias("gap"), s["start"].alias("start"), s["tag"].alias("tag"))))).otherwise(a["out"]).alias("out"),
        ).cast(state),
    )
    parts = F.transform(laid["out"], lambda p: F.concat(F.substring(text, p["gap"].cast("int") + 1, (p["start"] - p["gap"]).cast("int")), p["tag"]))
    rest = F.substring(text, laid["reach"].cast("int") + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)


def sanitised(docs: DataFrame, term_chars: int = 1) -> DataFrame:
    """docs with the same columns, in which matches are tags and disclosing terms are generalised or gone; null texts stay null."""
    own = docs.withColumn("_null", F.col("text").isNull())
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    renamed = own.withColumnsRenamed({c: f"_own_{c}" for c in keep})
    out = detected(renamed, [*(f"_own_{c}" for c in keep), "_null"], term_chars)
    text = F.when(~F.col("_null"), redacted(F.col("text"), F.concat("base", "secrets", "terms")))
    return out.withColumn("text", text).drop("base", "secrets", "terms").withColumnsRenamed({f"_own_{c}": c for c in keep}).select(*docs.columns)


def op5_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detected(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    every = F.concat("base", "secrets", "terms")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *map(count, range(BASE)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))
