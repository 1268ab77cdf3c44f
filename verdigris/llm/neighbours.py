"""Operator 7, nearest neighbours by stable projections and a kd-tree with a chi-square stopping test.

Vectors are projected to ``DIMS`` dimensions with normal (2-stable) directions: for a pair at distance d, the
squared distance of the projections is d**2 times a chi-square variable with DIMS degrees of freedom. A
kd-tree over the projections, fitted on a bounded sample (``SAMPLE`` rows), cuts the space into cells; all
vectors are indexed, each in its cell, and cells are the unit of distribution.

A query first searches its own cell. The k-th distance found, d, bounds what is left: a vector nearer than
d has a projection within d * sqrt(chi-square quantile) with the chosen confidence, so the query
visits only cells that come that near, nearest projections first, verifies each with the original vector,
and stops in a cell as soon as the next projected distance fails the test for the d it has by then.

Equal vectors are one entry of the index with its k + 1 smallest ids (ties go to the smaller id, and a query
leaves out itself), and equal queries are asked once: a vector may make up any share of the rows. A cell
that is still too large is cut by hash into parts that are searched alike.

Cases: vectors that are null, empty, zero, of another length than most of the sample, or hold null or non-finite
components take no part; with fewer candidates than k all are returned; rows that repeat id and vector count once,
rows of one id with different vectors are entries of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.common import bound_batches, materialize, table

K, DIMS, SAMPLE, CELL_ROWS, CONFIDENCE, EVERY = 10, 8, 20_000, 4096, 0.97, 100
_STEP = 512


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile for an even number of degrees of freedom, whose distribution function is a finite sum."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - np.exp(-x / 2) * total < p else (low, x)
    return (low + high) / 2


class Cells:
    """A kd-tree over projections: median cuts along the widest axis, down to cells of the wanted number of rows."""

    def __init__(self, sample: np.ndarray, rows: int, cell_rows: int):
        self.axis: list[int] = []
        self.cut: list[float] = []
        self.child: list[tuple[int, int]] = []  # a negative child is cell -child - 1
        dims = sample.shape[1]
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        share = max(1.0, rows / max(1, len(sample)))

        def build(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
            wide = np.ptp(points, axis=0) if len(points) else np.zeros(dims)
            axis = int(wide.argmax())
            cut = float(np.median(points[:, axis])) if len(points) else 0.0
            left = points[:, axis] < cut
            if len(points) * share <= cell_rows or len(points) < 16 or not left.any():
                self.low.append(low)
                self.high.append(high)
                return -len(self.low)
            n = len(self.axis)
            self.axis.append(axis)
            self.cut.append(cut)
            self.child.append((0, 0))
            high_left, low_right = high.copy(), low.copy()
            high_left[axis] = low_right[axis] = cut
            self.child[n] = (build(points[left], low, high_left), build(points[~left], low_right, high))
            return n

        self.root = build(sample, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                left = points[rows, self.axis[node]] < self.cut[node]
                todo += [(self.child[node][0], rows[left]), (self.child[node][1], rows[~left])]
        return out

    def within(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that come as near as radius to a point."""
        gap = np.maximum(np.maximum(self.low[None] - points[:, None], points[:, None] - self.high[None]), 0)
        return np.nonzero((gap**2).sum(2) <= radius[:, None] ** 2)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)  # a slice has its own rows only


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _search(vectors: np.ndarray, flat: np.ndarray, q: np.ndarray, q_flat: np.ndarray, bound: float, k: int, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest entries of a cell that can still matter, by the incremental search."""
    near = ((flat - q_flat) ** 2).sum(1)
    order = np.argsort(near, kind="stable")
    best = np.full(0, np.inf)
    at = np.zeros(0, np.int64)
    for i in range(0, len(order), _STEP):
        limit = min(bound, best[k - 1] if len(best) >= k else np.inf)
        if near[order[i]] > stop * limit**2:
            break
        rows = order[i : i + _STEP]
        d = np.sqrt(((vectors[rows] - q) ** 2).sum(1))
        best, at = np.concatenate([best, d]), np.concatenate([at, rows])
        # all at the k-th distance stay, for ties
        if len(best) > k:
            last = np.partition(best, k - 1)[k - 1]
            keep = best <= last
            best, at = best[keep], at[keep]
            o = np.argsort(best, kind="stable")
            best, at = best[o], at[o]
    return at, best


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null").filter(ok)


def nearest(rows: DataFrame, every: int = EVERY, k: int = K, cell_rows: int = CELL_ROWS, confidence: float = CONFIDENCE, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other vectors of each vector whose id is divisible by every."""
    spark = rows.sparkSession
    bound_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    valid = usable(rows)
    sample = [r["v"] for r in valid.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], schema)
    sizes = np.bincount([len(v) for v in sample])
    dims = int(sizes.argmax())
    valid = valid.filter(F.size("v") == dims)
    # one entry for equal vectors, with its smallest ids; salted first, as one vector may be a third of all
    same = ["v"]
    first = W.partitionBy(*same, F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = valid.dropDuplicates(["vec_id", "v"]).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).drop("n")
    entries = few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    directions = np.random.default_rng(seed).standard_normal((dims, DIMS))
    held = spark.sparkContext.broadcast
    n_rows = valid.count()
    cells = Cells(np.unique(np.array([v for v in sample if len(v) == dims]), axis=0) @ directions, n_rows, cell_rows)
    plan = held((cells, directions))  # bounded by the sample
    stop = chi_square_quantile(confidence, DIMS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, way = plan.value
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            flat = x @ way
            yield pa.RecordBatch.from_arrays([batch.column("v"), _lists(flat), pa.array(tree.of(flat)), batch.column("ids")], names=["v", "flat", "cell", "ids"])

    index = materialize(entries.mapInArrow(place, "v array<double>, flat array<double>, cell long, ids array<long>"), "index")
    queries = valid.filter(F.pmod("vec_id", F.lit(every)) == 0).select("v", F.col("vec_id").alias("query_id")).distinct()
    asked = materialize(index.join(queries.select("v").distinct(), "v").select(F.xxhash64("v").alias("q"), "v", "flat", "cell"), "queries")
    # large cells in parts, so that a part and a block of queries fit in a task
    split = index.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / (2 * cell_rows)).cast("int").alias("parts"))
    parted = index.join(split, "cell").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).select("cell", "part", "v", "flat", "ids")
    found_schema = "v array<double>, ids array<long>, score double"

    def search(visits: DataFrame) -> DataFrame:
        """visits: cell, part, v, flat, bound. The nearest entries of each visited part."""

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table({"v": pa.array([], pa.list_(pa.float64())), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
            x, flat = _matrix(left.column("v").combine_chunks(), dims), _matrix(left.column("flat").combine_chunks(), DIMS)
            ask, places, scores = [], [], []
            bounds = right.column("bound").to_numpy()
            for i, (q, q_flat) in enumerate(zip(_matrix(right.column("v").combine_chunks(), dims), _matrix(right.column("flat").combine_chunks(), DIMS))):
                at, d = _search(x, flat, q, q_flat, bounds[i], k + 1, stop)
                ask += [i] * len(at)
                places.append(at)
                scores.append(d)
            return pa.table({"v": right.column("v").take(pa.array(ask, pa.int64())), "ids": left.column("ids").take(pa.array(np.concatenate(places), pa.int64())), "score": pa.array(np.concatenate(scores))})

        return parted.groupBy("cell", "part").cogroup(visits.groupBy("cell", "part")).applyInArrow(run, found_schema)

    def parts_of(visits: DataFrame) -> DataFrame:
        return visits.join(split, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "v", "flat", "bound")

    home = materialize(search(parts_of(asked.withColumn("bound", F.lit(float("inf"))))), "home")
    # the entries up to the one that holds the (k + 1)-th id
    up_to = W.partitionBy("v").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    reach = home.withColumn("before", F.coalesce(F.sum(F.size("ids")).over(up_to), F.lit(0)))
    bounds = reach.filter(F.col("before") <= k).groupBy("v").agg(F.max("score").alias("d"), F.sum(F.size("ids")).alias("n")).select("v", F.when(F.col("n") > k, F.col("d")).otherwise(float("inf")).alias("bound"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, _ = plan.value
        for batch in batches:
            row, cell = tree.within(_matrix(batch.column("flat"), DIMS), np.sqrt(stop) * batch.column("bound").to_numpy())
            other = cell != batch.column("cell").to_numpy()[row]
            row = pa.array(row[other])
            yield pa.RecordBatch.from_arrays([pa.array(cell[other]), batch.column("v").take(row), batch.column("flat").take(row), batch.column("bound").take(row)], names=["cell", "v", "flat", "bound"])

    more = asked.join(bounds, "v", "left").select("cell", "v", "flat", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    away = search(parts_of(more.mapInArrow(visit, "cell long, v array<double>, flat array<double>, bound double")))
    top = W.partitionBy("v").orderBy("score", "vec_id")
    listed = home.unionByName(away).select("v", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1)
    answers = listed.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    own = queries.join(answers, "v").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
