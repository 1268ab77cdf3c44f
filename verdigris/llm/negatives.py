"""Operator 13, hard negatives by angular triangle filtering.

Components become integers (floor(256 * x)); a score is an integer inner product. Each row stores its norm and its angles to
``REFERENCES`` directions, which are taken from a bounded sample of rows, far from each other. For a row x and an anchor a, and any
direction r, |angle(a, r) - angle(x, r)| <= angle(a, x) <= min(s, 2 pi - s) with s the sum of the two: this bounds
the cosine, and times the two norms the score. Bounds are moved outwards by more than rounding can amount to (``SLACK``, in units
of the product of the norms, and one besides).

Rows lie in cells (dimensions, label modulo ``LABELS``, nearest direction), cells in parts of about ``PART`` rows. A cell's
least and greatest angles and norms bound the scores of all its rows, so an anchor visits only cells that can matter;
in a part, rows whose bounds can't reach what is wanted are left out, and only the others are scored.

1. Positives: each anchor first visits the part of its own cell that it falls in, which gives it a k-th best score of its label; then
   all parts whose bounds reach that score. The best of all parts are the positives.
2. Negatives: the windows [50 p, 95 p] / 100 of an anchor's positives; parts and rows whose bounds overlap no window are left out.

A part and the anchors that visit it are brought together by hash; within a partition a part's rows come before its visits, which stream past
it: a task holds one part and one batch of anchors, however many there are. The bounds of cells are broadcast; their number doesn't
grow with the rows (directions x ``LABELS`` for each length of vectors).

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do those with a component of
2**18 or more in size, as their scores may not fit a long. Vectors are compared with those of their own length; zero and empty
vectors score 0. An anchor leaves out all rows with its own id; rows that repeat an id are rows of their own, an anchor that is repeated
as a whole counts once. Equal vectors may be a third of all: parts are cut by a hash of the id. An empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.common import bound_batches, materialize, table

REFERENCES, SAMPLE, PART, LABELS, SLACK = 16, 4096, 8192, 16, 1e-6
K_POSITIVE, K_NEGATIVE, EVERY, SCALE, LARGEST = 5, 3, 50, 256, float(1 << 18)
#: Least and greatest score of a negative, in hundredths of the positive's.
LOW, HIGH = 50, 95
INDEX = "vec_id long, label long, dims int, cell long, part int, norm double, angles array<double>, q array<long>"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, v (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    return out.filter("vec_id is not null and label is not null and v is not null").filter(ok)


def directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit rows of the sample, each as far from those before it as can be."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.eye(max(1, sample.shape[1]))[:1] if sample.shape[1] else np.zeros((1, 0))
    chosen, near = [0], units @ units[0]
    while len(chosen) < min(count, len(units)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, units @ units[chosen[-1]])
    return units[chosen]


def angles_to(ways: np.ndarray, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Angles of rows to directions; those of zero rows are 0, and their norm makes every bound 0."""
    cosines = (q @ ways.T) / np.where(norms > 0, norms, 1)[:, None]
    return np.where(norms[:, None] > 0, np.arccos(np.clip(cosines, -1, 1)), 0.0)


def bounds(low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of scores: a row for each anchor (angles, norms), a column for each row or cell, whose angles lie in low..high and norms in least..most."""
    nearest, furthest = np.zeros((len(angles), len(low))), np.full((len(angles), len(low)), np.pi)
    for r in range(angles.shape[1]):
        a = angles[:, r, None]
        nearest = np.maximum(nearest, np.maximum(low[None, :, r] - a, a - high[None, :, r]))
        # of the sums from a + low to a + high the one nearest to pi allows the widest angle
        lo, hi = a + low[None, :, r], a + high[None, :, r]
        furthest = np.minimum(furthest, np.where(hi <= np.pi, hi, np.where(lo >= np.pi, 2 * np.pi - lo, np.pi)))
    up, down = np.cos(np.clip(nearest, 0, np.pi)) + SLACK, np.cos(np.clip(furthest, 0, np.pi)) - SLACK
    n = norms[:, None]
    return np.minimum(down * n * least, down * n * most) - 1, np.maximum(up * n * least, up * n * most) + 1


def row_bounds(row_angles: np.ndarray, row_norms: np.ndarray, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for single rows: their angles and norms are what they are."""
    nearest, fold = np.zeros((len(angles), len(row_angles))), np.zeros((len(angles), len(row_angles)))
    for r in range(angles.shape[1]):
        a, x = angles[:, r, None], row_angles[None, :, r]
        np.maximum(nearest, np.abs(a - x), out=nearest)
        np.maximum(fold, np.abs(np.pi - a - x), out=fold)
    n = norms[:, None] * row_norms
    return (np.cos(np.pi - fold) - SLACK) * n - 1, (np.cos(np.minimum(nearest, np.pi)) + SLACK) * n + 1


def _matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


class Part:
    """The rows of a part, and the exact scores of those of them that are wanted."""

    def __init__(self, batches: list[pa.RecordBatch], dims: int, ways: int):
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        ids = rows.column("vec_id").to_numpy()
        o = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[o], rows.column("label").to_numpy()[o]
        self.norms, self.angles = rows.column("norm").to_numpy()[o], _matrix(rows.column("angles"), ways)[o]
        self.q = _matrix(rows.column("q"), dims, np.int64)[o]
        self.small = dims * (int(np.abs(self.q).max(initial=0)) ** 2) < 1 << 52
        self.exact = self.q.astype(np.float64) if self.small else self.q

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Integer inner products; floats hold them exactly where they are small enough."""
        if self.small and len(q) * int(np.abs(q).max(initial=0)) * int(np.abs(self.q).max(initial=0)) < 1 << 52:
            return (self.exact[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.q[rows] @ q


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by place."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.argsort(-score[some], kind="stable")[:k]]
    return np.argsort(-score, kind="stable")


def _positives(part: Part, q: np.ndarray, vec_id: int, label: int, lower: np.ndarray, upper: np.ndarray, floor: int, k: int) -> Iterator[tuple]:
    mine = np.flatnonzero((part.labels == label) & (part.ids != vec_id) & (upper >= floor))
    if len(mine) > k:  # the k-th best lower bound is reached in any case
        mine = mine[upper[mine] >= np.partition(lower[mine], len(mine) - k)[len(mine) - k]]
    score = part.scores(mine, q)
    for i in _first(score, k):
        yield 0, int(part.ids[mine[i]]), int(score[i])


def _negatives(part: Part, q: np.ndarray, vec_id: int, label: int, lower: np.ndarray, upper: np.ndarray, positives: np.ndarray, k: int) -> Iterator[tuple]:
    low, high = -(-LOW * positives // 100), HIGH * positives // 100
    wanted = np.zeros(len(lower), bool)
    for a, b in set(zip(low.tolist(), high.tolist())):
        wanted |= (upper >= a) & (lower <= b)
    other = np.flatnonzero(wanted & (part.labels != label) & (part.ids != vec_id))
    score = part.scores(other, q)
    for at, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
        within = np.flatnonzero((score >= a) & (score <= b))
        for i in _first(score[within], k):
            yield at, int(part.ids[other[within[i]]]), int(score[within[i]])


FOUND = "anchor_id long, anchor long, at int, vec_id long, score long"
VISIT = "cell long, part int, row boolean, vec_id long, label long, dims int, norm double, angles array<double>, q array<long>, anchor long, floor long, positives array<long>"


def _met(index: DataFrame, visits: DataFrame, find, ways: int, k: int) -> DataFrame:
    """What find(part, ...) yields for each visit. index: the rows with cell and part; visits: anchors with the cell and part that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor_id", pa.int64()), ("anchor", pa.int64()), ("at", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
        key, rows, part = None, [], None
        for batch in batches:
            keys = np.stack([batch.column("cell").to_numpy(), batch.column("part").to_numpy(), batch.column("row").to_numpy(zero_copy_only=False)])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1 if batch.num_rows > 1 else np.zeros(0, int)
            for start, end in zip([0, *edges], [*edges, batch.num_rows]):
                here = batch.slice(int(start), int(end - start))
                now = (int(keys[0, start]), int(keys[1, start]))
                if now != key:
                    key, rows, part = now, [], None
                dims = here.column("dims")[0].as_py()
                if keys[2, start]:
                    rows.append(here)
                    continue
                if not rows and part is None:
                    continue
                if part is None:
                    part, rows = Part(rows, dims, ways), []
                out: list[tuple] = []
                angles, norms, q = _matrix(here.column("angles"), ways), here.column("norm").to_numpy(), _matrix(here.column("q"), dims, np.int64)
                ids, labels, anchors, floors, positives = (here.column(c).to_pylist() for c in ("vec_id", "label", "anchor", "floor", "positives"))
                for s in range(0, len(q), 64):
                    lower, upper = row_bounds(part.angles, part.norms, angles[s : s + 64], norms[s : s + 64])
                    for i in range(s, min(s + 64, len(q))):
                        wanted = floors[i] if positives[i] is None else np.array(positives[i], np.int64)
                        out += [(ids[i], anchors[i], *x) for x in find(part, q[i], ids[i], labels[i], lower[i - s], upper[i - s], wanted, k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    held = index.select("cell", "part", F.lit(True).alias("row"), "vec_id", "label", "dims", "norm", "angles", "q", F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("long").alias("floor"), F.lit(None).cast("array<long>").alias("positives"))
    asked = visits.select("cell", "part", F.lit(False).alias("row"), "vec_id", "label", "dims", "norm", "angles", "q", "anchor", "floor", "positives")
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = held.unionByName(asked).repartition(n, "cell", "part").sortWithinPartitions("cell", "part", F.col("row").desc())
    return together.mapInArrow(run, FOUND)


def _part_of(vec_id: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(vec_id), parts.cast("long")).cast("int")


def mined(rows: DataFrame, every: int = EVERY, k_positive: int = K_POSITIVE, k_negative: int = K_NEGATIVE, references: int = REFERENCES, part_rows: int = PART) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id, embedding, label; the anchors are those whose id is divisible by every."""
    spark = rows.sparkSession
    bound_batches(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    valid = usable(rows)
    # a bounded sample, by hash, for the directions of each length of vectors
    lengths = W.partitionBy(F.size("v")).orderBy(F.xxhash64("vec_id"), "vec_id")
    few = valid.filter(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(max(1, valid.count() // SAMPLE))) == 0)
    sample: dict[int, list] = {}
    for r in few.withColumn("n", F.row_number().over(lengths)).filter(F.col("n") <= SAMPLE).select("v").limit(4 * SAMPLE).collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    ways = {d: directions(np.floor(np.array(x, np.float64) * SCALE), references) for d, x in sample.items()}
    width = references
    plan = spark.sparkContext.broadcast(ways)  # bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("dims"))
            for d in np.unique(sizes).tolist():
                some = batch.take(pa.array(np.flatnonzero(sizes == d)))
                q = np.floor(_matrix(some.column("v"), d) * SCALE)
                norms = np.sqrt((q**2).sum(1))
                own = plan.value.get(d)
                own = own if own is not None else np.eye(max(1, d))[:1, :d]
                angles = angles_to(own, q, norms)
                cell = (np.int64(d) * LABELS + some.column("label").to_numpy() % LABELS) * width + angles.argmin(1)
                if angles.shape[1] < width:
                    angles = np.concatenate([angles, np.repeat(angles[:, :1], width - angles.shape[1], 1)], 1)
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(np.full(len(q), d, np.int32)), pa.array(cell), pa.array(norms), _lists(angles), _lists(q.astype(np.int64))], names=["vec_id", "label", "dims", "cell", "norm", "angles", "q"])

    placed = materialize(valid.withColumn("dims", F.size("v")).mapInArrow(place, "vec_id long, label long, dims int, cell long, norm double, angles array<double>, q array<long>"), "vectors")
    extent = [f(F.col("angles")[r]).alias(f"{n}{r}") for r in range(width) for n, f in (("low", F.min), ("high", F.max))]
    cells = placed.groupBy("cell", "dims").agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"), *extent).collect()  # directions x LABELS rows for each length
    if not cells:
        return spark.createDataFrame([], schema)
    parts = spark.createDataFrame([(c["cell"], max(1, -(-c["n"] // part_rows))) for c in cells], "cell long, parts int")
    index = placed.join(F.broadcast(parts), "cell").withColumn("part", _part_of(F.col("vec_id"), F.col("parts")))
    anchors = materialize(index.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "label", "q"]).withColumn("anchor", F.xxhash64("label", "q")).withColumn("anchor_id", F.col("vec_id")), "anchors")
    facts = spark.sparkContext.broadcast({k: np.array([c[k] for c in cells]) for k in ("cell", "dims", "least", "most")} | {k: np.array([[c[f"{k}{r}"] for r in range(width)] for c in cells]) for k in ("low", "high")})

    def visits(asked: DataFrame, wanted) -> DataFrame:
        """asked, once for each part that it has to visit. wanted(batch, cells, lower, upper) tells which cells."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = facts.value
            for batch in batches:
                lower, upper = bounds(f["low"], f["high"], f["least"], f["most"], _matrix(batch.column("angles"), width), batch.column("norm").to_numpy())
                see = wanted(batch, f["cell"], lower, upper) & (f["dims"][None] == batch.column("dims").to_numpy()[:, None])
                i, j = np.nonzero(see)
                out = batch.take(pa.array(i))
                yield out.set_column(out.schema.get_field_index("cell"), "cell", pa.array(f["cell"][j]))

        kind = "cell long, vec_id long, label long, dims int, norm double, angles array<double>, q array<long>, anchor long, floor long, positives array<long>"
        columns = [x.split()[0] for x in kind.split(", ")]
        return asked.select(*columns).mapInArrow(run, kind).join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def of_label(batch: pa.RecordBatch, cell: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        same = (cell // width % LABELS)[None] == (batch.column("label").to_numpy() % LABELS)[:, None]
        return same & (upper >= batch.column("floor").to_numpy()[:, None])

    def in_windows(batch: pa.RecordBatch, cell: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        see = np.zeros(lower.shape, bool)
        for i, p in enumerate(batch.column("positives").to_pylist()):
            for x in set(p):
                see[i] |= (upper[i] >= -(-LOW * x // 100)) & (lower[i] <= HIGH * x // 100)
        return see

    none = F.lit(None).cast("array<long>")
    least = -(1 << 62)
    own = anchors.withColumns({"floor": F.lit(least).cast("long"), "positives": none})
    home = materialize(_met(index, own, _positives, width, k_positive), "home")
    key = ["anchor_id", "anchor"]
    reached = home.groupBy(*key).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floor = F.coalesce(F.when(F.col("n") >= k_positive, F.col("least")), F.lit(least).cast("long"))
    more = visits(anchors.join(reached, key, "left").withColumns({"floor": floor, "positives": none}), of_label)
    # the part at home has been searched
    more = more.join(anchors.select("vec_id", "anchor", "cell", "part"), ["vec_id", "anchor", "cell", "part"], "left_anti")
    best = W.partitionBy(*key).orderBy(F.col("score").desc(), "vec_id")
    positive = materialize(home.unionByName(_met(index, more, _positives, width, k_positive)).withColumn("at", F.row_number().over(best) - 1).filter(F.col("at") < k_positive), "positives")
    listed = positive.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "score"))).alias("p")).select(*key, F.transform("p", lambda x: x["score"]).alias("positives"))
    asked = anchors.join(listed, key).withColumn("floor", F.lit(None).cast("long"))
    found = _met(index, visits(asked, in_windows), _negatives, width, k_negative)
    first = W.partitionBy(*key, "at").orderBy(F.col("score").desc(), "vec_id")
    negative = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k_negative).select(*key, "at", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positive.select(*key, "at", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negative.join(named, [*key, "at"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return mined(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
