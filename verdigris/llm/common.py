"""What the operators of this subpackage share: tables, shared folders, batch bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.shared import fresh

#: Rows and bytes of one Arrow batch handed to Python, so that long texts stay in bounds.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes; texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    spark, path = df.sparkSession, fresh(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, column: str) -> DataFrame:
    """df written as a table in the shared folder that is bucketed by a column, so that grouping and joining by it moves the other side only."""
    spark, path = df.sparkSession, fresh(df.sparkSession, what)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about most bytes of the column; a longer text comes alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)
