"""Tables that are read in small parts: pages of an order, substring search, counters that are kept up to date."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verdigris.sources.shared import materialize

#: Rows of a block of a page index, blocks of a search index, parts of its grams, and the length of grams.
BLOCK_ROWS, BLOCKS, GRAM_PARTS, GRAM = 10_000, 64, 64, 3
#: Grams that a task holds before it forgets equal ones.
HELD = 1 << 21


def write_pages(df: DataFrame, order: list[Column | str], path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Writes the rows of df with their places (from 0) in a total order, in folders of block_rows places each.

    Places come from range partitions and their sizes, so no task sees all rows; the number of rows lies beside the blocks.
    """
    sorted_rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "paged")
    sizes = sorted_rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = sizes.withColumn("_first", before).drop("_n")
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    placed = sorted_rows.withColumn("_in", inside).join(F.broadcast(first), "_part").withColumn("place", F.col("_first") + F.col("_in")).drop("_part", "_first", "_in")
    placed = placed.withColumn("block", F.floor(F.col("place") / block_rows))
    placed.write.partitionBy("block").parquet(f"{path}/rows")
    sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.lit(block_rows).cast("long").alias("block_rows"), F.lit(placed.schema.json()).alias("kind")).write.parquet(f"{path}/size")


def page(spark: SparkSession, path: str, offset: int, limit: int) -> DataFrame:
    """The rows at these places, with their place and the total. Only the blocks that hold them are read."""
    size = spark.read.schema("total long, block_rows long, kind string").parquet(f"{path}/size")
    block_rows, kind = size.select("block_rows", "kind").first()
    rows = spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(f"{path}/rows")
    here = rows.filter(F.col("block").between(offset // block_rows, (offset + limit - 1) // block_rows) & F.col("place").between(offset, offset + limit - 1)).drop("block")
    return here.crossJoin(F.broadcast(size.select("total")))  # one row


def page_after(spark: SparkSession, path: str, place: int, limit: int) -> DataFrame:
    """The page behind a place: what a reader who knows the last row seen asks for."""
    return page(spark, path, place + 1, limit)


def _codes(text: str) -> np.ndarray:
    """The different grams of a text, as numbers: 21 bits for each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = max(0, len(points) - GRAM + 1)
    code = np.zeros(n, np.int64)
    for k in range(GRAM):
        code = code << 21 | points[k : k + n]
    return code


def _different(codes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, gram: the grams of the texts of each block, once for each task that holds any."""
    held: dict[int, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        for block, text in zip(batch.column("block").to_pylist(), batch.column("_hay").to_pylist()):
            codes = _codes(text or "")
            held.setdefault(block, []).append(codes)
            size += len(codes)
            if size > HELD:
                held = {b: [_different(c)] for b, c in held.items()}
                size = 0
    for block, codes in held.items():
        found = _different(codes)
        for at in range(0, len(found), HELD):
            part = found[at : at + HELD]
            points = np.stack([part >> 21 * k & (1 << 21) - 1 for k in reversed(range(GRAM))], 1).astype("<u4")
            text = points.tobytes().decode("utf-32-le", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int32)), pa.array([text[i : i + GRAM] for i in range(0, len(text), GRAM)], pa.string())], names=["block", "gram"])


def write_search(df: DataFrame, key: str, fields: list[Column | str], path: str, blocks: int = BLOCKS) -> None:
    """Writes the rows of df in blocks, and which blocks hold which grams of the lower-case text of all fields.

    The index has a row for each gram and block at most, however often a gram stands in a block, and is laid out by gram. Tasks
    bring each gram once, as they hold grams as numbers and forget equal ones.
    """
    hay = F.lower(F.concat_ws(" ", *fields))
    rows = df.withColumns({"_hay": hay, "block": F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")})
    rows.repartition("block").write.partitionBy("block").parquet(f"{path}/rows")
    texts = df.sparkSession.read.schema("_hay string, block int").parquet(f"{path}/rows").select("block", "_hay")
    held = texts.mapInArrow(_grams, "block int, gram string").distinct()
    held.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(GRAM_PARTS)).cast("int")).repartition("part").sortWithinPartitions("gram").write.partitionBy("part").parquet(f"{path}/grams")


def search(spark: SparkSession, path: str, needle: str, **facets: str) -> DataFrame:
    """The rows whose text holds the needle, in any case, and whose columns equal the facets. Blocks that lack a gram of the needle aren't read; one shorter than a gram is looked for everywhere."""
    rows = spark.read.parquet(f"{path}/rows")
    wanted = sorted({needle.lower()[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
    if wanted:
        hashed = spark.range(1).select(F.transform(F.array(*map(F.lit, wanted)), lambda g: F.pmod(F.xxhash64(g), F.lit(GRAM_PARTS)).cast("int")).alias("p")).first()["p"]
        grams = spark.read.schema("gram string, block int, part int").parquet(f"{path}/grams")
        hit = grams.filter(F.col("part").isin(hashed) & F.col("gram").isin(wanted)).groupBy("block").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted))
        rows = rows.filter(F.col("block").isin([r["block"] for r in hit.collect()]))  # one row a block at most
    for name, value in facets.items():
        rows = rows.filter(F.col(name) == value)
    return rows.filter(F.contains("_hay", F.lit(needle.lower()))).drop("_hay", "block")


def facet_counts(df: DataFrame, facets: dict[str, Column], sums: dict[str, Column], sign: int = 1) -> DataFrame:
    """facet, value, n, total: how many rows have each value of each facet, and the sums, in one pass. sign -1 takes them back."""
    rows = [F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value"), F.lit(0.0).alias("x")) for k, v in facets.items()]
    rows += [F.struct(F.lit(k).alias("facet"), F.lit(None).cast("string").alias("value"), F.coalesce(v.cast("double"), F.lit(0.0)).alias("x")) for k, v in sums.items()]
    g = df.select(F.explode(F.array(*rows)).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"), F.sum("f.x").alias("total"))
    return g.select("facet", "value", (F.col("n") * sign).alias("n"), (F.col("total") * sign).alias("total"))


def add_counts(counts: DataFrame, path: str, change: str) -> None:
    """Puts counts of rows that came or went beside those before. A change has a name, and is put once however often it is tried."""
    counts.write.mode("overwrite").parquet(f"{path}/change={change}")


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """facet, value, n, total of all changes so far; values that no row has any more are gone."""
    kept = spark.read.schema("facet string, value string, n long, total double, change string").parquet(path)
    return kept.groupBy("facet", "value").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n <> 0")


def fold_counts(spark: SparkSession, path: str, into: str) -> None:
    """All changes so far as the first one of a new folder."""
    add_counts(current_counts(spark, path), into, "0")
