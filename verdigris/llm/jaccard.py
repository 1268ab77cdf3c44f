"""Operator 6, n-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are hashed word shingles. Documents with the same
set are one row (their class); a row is known by its signature.

Two sets A, B with Jaccard similarity t or more differ in at most (|A| + |B|)(1 - t)/(1 + t) columns.
For every range of sizes this gives a bound d; the columns are cut into d + 1 blocks by hash, and two
rows within the bound have at least one block whose non-zeros are the same. Blocks without non-zeros are
the same for many rows, so where the bound leaves few columns a block, s more blocks are cut: two rows then have
s + 1 same blocks, and a row with s empty ones or fewer sends only the others. Pairs that share no block
are discarded unseen, and so are pairs whose sizes differ too much: a size range only meets those that
the bound allows. The product is then taken for the pairs that are left: overlap counts of both rows,
exactly, from the whole sets.

A block that many rows share is never expanded into pairs. Its rows are first multiplied with one of
them only, its star; rows that this links (directly or through other stars) are in the same component
already and need no further product. What is left are rows of one star in different components. They are
cut into tiles, each two tiles are multiplied in a task, and a row for each two components that are found
to be linked comes out, so no link between components is lost.

Keys are made in two passes over the texts, which must bring the same rows together: ``same_splits`` sees to it.

A set's signature is a 63-bit hash. A second one of 64 bits is kept beside it: where two different sets have one signature,
all with that signature are signed anew by another hash.

Cases: null and empty texts, and texts without words, have an empty set and are linked with nothing; with
fewer words than a shingle the whole sequence is one shingle; repeated rows and ties are in one
class, whose smallest id counts; rows that share an id and differ in text are told apart; a row with a null id has the
component of its class, null if no row of it has an id; very long texts are sets like others; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm import words as wd
from verdigris.llm.common import bound_batches, materialize, pieces, table, text_or_empty
from verdigris.llm.components import components

SHINGLE, PERCENT, CHUNK = 3, 90, 1 << 20
#: [^\x20\x09-\x0D]+ after A-Z are lower-cased.
WORD_BYTES = wd.table_of(lambda c: c != 32 and not 9 <= c <= 13)
#: Signatures that a task remembers to have sent.
SEEN = 500_000
#: Rows of keys that a task holds at a time.
FLUSH = 1 << 20
#: Rows of a tile of the matrix product.
TILE = 1024


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles."""
    data = np.frombuffer(b" ".join(texts).translate(WORD_BYTES), np.uint8)
    starts, ends = wd.spans(data)
    h = wd.hashes(data, starts, ends)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, begins)
    g = wd.grams(h, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(wd.grams(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray, met: frozenset[int] = frozenset()) -> int:
    """A 63-bit hash of a set; another one for signatures that different sets have been met with."""
    first = int(wd.mix(np.array([wd.mix(s + np.uint64(0x51ED270B)).sum() + np.uint64(len(s))], np.uint64))[0] >> np.uint64(1))
    return check(s) >> 1 & (1 << 63) - 1 if first in met else first


def check(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set, by other numbers than its signature."""
    return int(wd.mix(np.array([wd.mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


class Ranges:
    """Size ranges, and in how many blocks their columns are cut."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]
        self.cut: dict[int, tuple[int, int]] = {}

    def of(self, n: int) -> int:
        """Number of the range that holds n: single sizes first, then ever wider ones."""
        while self.low[-1] <= n:
            a = self.low[-1]
            self.low.append(max(a + 1, a * 100 // self.percent) if a > 20 else a + 1)
        return int(np.searchsorted(self.low, n, "right")) - 1

    def blocks(self, k: int) -> tuple[int, int]:
        """The number of blocks of range k, and how many of them a row may have empty without sending those."""
        if k not in self.cut:
            low, high = self.low[k], self.low[k + 1] - 1
            m = (high + high * 100 // self.percent) * (100 - self.percent) // (100 + self.percent) + 1
            spare = 0
            while m > 1 and not self.rare(low, m + spare, spare):
                spare += 1
            self.cut[k] = m + spare, spare
        return self.cut[k]

    @staticmethod
    def rare(n: int, m: int, spare: int) -> bool:
        """Whether more than spare of m blocks are seldom empty for n columns (three standard deviations)."""
        mean = m * (1 - 1 / m) ** n
        return mean + 3 * max(0.0, m * (m - 1) * (1 - 2 / m) ** n + mean - mean * mean) ** 0.5 < spare + 1

    def met(self, n: int) -> range:
        """The ranges of all sizes of the same or smaller sets that can be linked with a set of n."""
        return range(self.of(max(1, -(-n * self.percent // 100))), self.of(n) + 1)


def block_keys(s: np.ndarray, ranges: Ranges) -> np.ndarray:
    out = []
    for k in ranges.met(len(s)):
        m, spare = ranges.blocks(k)
        if m == 1:  # nothing may differ: such sets have the same signature
            continue
        block = (wd.mix(s) % np.uint64(m)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        sums = np.zeros(m, np.uint64)
        at = np.flatnonzero(np.diff(block[order], prepend=-1))
        sums[block[order][at]] = np.add.reduceat(wd.mix(s[order] + np.uint64(0xA24BAED4)), at)
        keys = wd.mix(sums + wd.mix(np.arange(m, dtype=np.uint64) + np.uint64(k << 32 | 1)))
        out.append(keys if m - len(at) > spare else keys[block[order][at]])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _source(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    text = text_or_empty("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def signatures(docs: DataFrame, n: int = SHINGLE, met: frozenset[int] = frozenset()) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, sig, check of every row (sig is null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK):
            sets = shingle_sets([t.encode() for t in batch.column("text").to_pylist()], n)
            cols = ([len(s) for s in sets], [signature(s, met) if len(s) else None for s in sets], [check(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "row", "n_shingles", "sig", "check"])

    return _source(docs).mapInArrow(run, "doc_id long, row long, n_shingles long, sig long, check long")


def keyed(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, met: frozenset[int] = frozenset(), members: bool = False) -> DataFrame:
    """key, sig, least: the column blocks of every set, of which tasks bring the rows together that they hold at a time.

    A key has one row of those, with the least signature; with members, the others come instead, with the least one beside.
    So a key that any share of the sets have is a row for each FLUSH rows, and never met whole in one task. A task sends a set once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, seen = Ranges(percent), set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def together() -> pa.RecordBatch:
            keys, sigs = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*held) if held else ((), ())))
            order = np.lexsort((sigs, keys))
            keys, sigs = keys[order], sigs[order]
            first = np.diff(keys, prepend=keys[:1] - 1) != 0
            least = sigs[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
            take = (sigs != least) if members else first
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c[take]) for c in (keys, sigs, least)], names=["key", "sig", "least"])

        size = 0
        for batch in pieces(batches, CHUNK):
            for s in shingle_sets([t.encode() for t in batch.column("text").to_pylist()], n):
                if len(s) and (sig := signature(s, met)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sig)
                    keys = block_keys(s, ranges)
                    held.append((keys, np.full(len(keys), sig)))
                    size += len(keys)
            if size >= FLUSH:
                size = 0
                yield together()
        if held:
            yield together()

    return _source(docs).mapInArrow(run, "key long, sig long, least long")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int = SHINGLE) -> DataFrame:
    """sig, shingles (sorted 64-bit values) of the wanted (row, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK):
            sets = shingle_sets([t.encode() for t in batch.column("text").to_pylist()], n)
            yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "shingles"])

    return _source(docs).join(wanted, "row").select("sig", "text").mapInArrow(run, "sig long, shingles binary").dropDuplicates(["sig"])


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of signatures whose sets overlap enough, by exact counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(p), len(q)) * 100 < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left, right = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("left")), sets.select(F.col("sig").alias("b"), F.col("shingles").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def products(rows: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """rows: star, sig, part, shingles. A link (a, b) for each two parts of a star's rows that one joins.

    The rows of a star are cut into tiles, and each two tiles are one block of the matrix product: a task holds two tiles
    and adds up the overlaps of one row of it with all others at a time. Rows of the largest part are multiplied with
    rows of other parts only.
    """
    sizes = rows.groupBy("star").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    cut = rows.join(sizes, "star").withColumn("t", F.pmod(F.xxhash64("sig"), F.col("tiles")).cast("int"))
    blocks = cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("star", F.least("t", "k").alias("i"), F.greatest("t", "k").alias("j"), "t", "sig", "part", "shingles")

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        tiles, sigs, parts = (group.column(c).to_numpy() for c in ("t", "sig", "part"))
        out: dict[tuple[int, int], tuple[int, int]] = {}
        kinds, place, count = np.unique(parts, return_inverse=True, return_counts=True)
        if len(kinds) > 1:
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            n = np.array([len(x) for x in sets])
            columns, flat = np.unique(np.concatenate(sets), return_inverse=True)
            begins = np.cumsum(n) - n
            here = np.zeros(len(columns), bool)
            for a in np.flatnonzero(place != count.argmax()).tolist():
                mine = flat[begins[a] : begins[a] + n[a]]
                here[mine] = True
                both = np.add.reduceat(here[flat], begins, dtype=np.int64)
                here[mine] = False
                ok = (100 * both >= percent * (n + n[a] - both)) & (parts != parts[a])
                if i != j:
                    ok &= tiles != tiles[a]
                for b in np.flatnonzero(ok).tolist():
                    out.setdefault((min(parts[a], parts[b]), max(parts[a], parts[b])), (int(sigs[a]), int(sigs[b])))
        return pa.table({k: pa.array([x[c] for x in out.values()], pa.int64()) for c, k in enumerate("ab")})

    return blocks.groupBy("star", "i", "j").applyInArrow(run, "a long, b long")


def signed(docs: DataFrame, n: int) -> tuple[DataFrame, frozenset[int]]:
    """The signatures, and those that had to be replaced as different sets had them."""
    rows = materialize(signatures(docs, n), "signatures")
    odd = rows.filter("sig is not null").groupBy("sig").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low <> high")
    met = frozenset(r["sig"] for r in odd.select("sig").toLocalIterator())  # hardly ever one: it takes about 3,000,000,000 sets
    return (materialize(signatures(docs, n, met), "signatures") if met else rows), met


#: Nodes of a plan whose rows come in the same splits and order whenever they are read.
_STEADY = re.compile(r"Project|Filter|Relation|SubqueryAlias|Scan")


@contextmanager
def same_splits(docs: DataFrame) -> Iterator[DataFrame]:
    """docs such that each pass over it within has the same rows in the same tasks, in the same order.

    How files are split follows from the number of cores that there are when a pass is planned, unless a least number of splits is set: it
    is set to that of now, so executors that come or go between two passes change nothing. What is not read from files is written to a table first.
    """
    spark, name = docs.sparkSession, "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    read = "Relation" in plan and all(_STEADY.match(x.lstrip(" +-:")) for x in plan.strip().split("\n"))
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield docs if read else materialize(docs, "given")
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def linked(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and sig, part (equal for what is linked) of all sets that aren't empty."""
    with same_splits(docs) as steady:
        return _linked(steady, n, percent, tile)


def _linked(docs: DataFrame, n: int, percent: int, tile: int) -> tuple[DataFrame, DataFrame]:
    rows, met = signed(docs, n)
    classes = materialize(rows.filter("sig is not null").groupBy("sig").agg(F.min("row").alias("row")), "classes")
    # rows that share a block share its star, the least of them: among what tasks bring together, and then among those
    by_key = W.partitionBy("key")
    first = keyed(docs, n, percent, met).select("key", "sig").withColumns({"star": F.min("sig").over(by_key), "most": F.max("sig").over(by_key)}).filter("star <> most")
    first = materialize(first.select("key", "star", "sig"), "first")
    others = keyed(docs, n, percent, met, members=True).join(first.select("key", "star").distinct(), "key", "left")
    stars = first.select("star", "sig").union(others.select(F.coalesce("star", "least").alias("star"), "sig"))
    stars = materialize(stars.filter("sig <> star").distinct(), "stars")
    members = stars.union(stars.select("star", F.col("star").alias("sig")).distinct())
    wanted = members.select("sig").distinct().join(classes, "sig").select("row", "sig")
    sets = materialize(sets_of(docs, wanted, n), "sets")
    links = materialize(overlaps(stars.select(F.col("star").alias("a"), F.col("sig").alias("b")), sets, percent), "links")
    known = components(links)
    # what no star has linked: rows of one star in different components
    labelled = members.join(known, members["sig"] == known["node"], "left").select("star", "sig", F.coalesce("component", "sig").alias("part"))
    # a star with one other row has been multiplied with it
    open_stars = labelled.groupBy("star").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("rows")).filter("low <> high and rows > 2").select("star")
    open_rows = materialize(labelled.join(open_stars, "star", "left_semi"), "open")
    parts = components(links.unionByName(products(open_rows.join(sets, "sig"), percent, tile)))
    return rows, classes.join(parts, classes["sig"] == parts["node"], "left").select("sig", F.coalesce("component", "sig").alias("part"))


def joined(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id of every row."""
    rows, parts = linked(docs, n, percent, tile)
    ids = rows.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("class_id"))
    # signatures are unordered labels; the smallest id of a component is its name
    of_class = ids.join(parts, "sig")
    names = of_class.groupBy("part").agg(F.min("class_id").alias("name"))
    named = of_class.join(names, "part").select("sig", "class_id", F.col("name").alias("component_id"))
    return rows.join(named, "sig", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with the smallest id (rows without an id come last), with the same columns; rows without words stay."""
    text, own = text_or_empty("text"), F.col("doc_id").cast("long")
    named = docs.select(F.col("doc_id"), "text")
    rows, parts = linked(named, n, percent)
    nobody, key = (1 << 63) - 1, ["_id", "_row"]
    kept = rows.join(parts, "sig").groupBy("part").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(nobody)).alias("_id"), F.col("row").alias("_row"))).alias("k")).select("k._id", "k._row").distinct()
    keyed_docs = docs.withColumns({"_id": F.coalesce(own, F.lit(nobody)), "_row": F.xxhash64(text)})
    some = F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]"))
    # rows that repeat id and text are copies of each other
    stay = keyed_docs.filter(some).join(kept, key, "left_semi").dropDuplicates(key)
    return stay.unionByName(keyed_docs.filter(~some)).drop(*key).select(*docs.columns)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "class_id", "component_id")
