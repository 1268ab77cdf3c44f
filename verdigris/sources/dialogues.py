"""Dialogue and record files: tolerant scans, append and versioned sinks."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verdigris.functions import text as T

MESSAGE = "struct<turn_index:int,role:string,message:string,create_time:string,length:int,is_unliked:int>"
RAW = "cid string, history string, _corrupt_record string"


def scan(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """JSON lines; blank lines are skipped and lines that can't be parsed keep their text in _corrupt_record."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def tolerant(spark: SparkSession, path: str, schema: str = RAW, limit: int | None = None) -> DataFrame:
    """The lines that can be parsed; with a limit, so many of them."""
    # the corrupt column can't be the only one read, so it is read with the others
    good = scan(spark, path, schema).filter("_corrupt_record is null").drop("_corrupt_record")
    return good if limit is None else good.limit(limit)


def accounted(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """One row: lines loaded, lines that failed."""
    lines = spark.read.text(path).filter(T.strip(F.col("value")) != "")
    bad = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull()
    return lines.agg(F.count_if(~bad).alias("n_loaded"), F.count_if(bad).alias("n_errors"))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(T.strip(F.col("value")) != "").agg(F.count("*").alias("n"))


def dialogues(spark: SparkSession, path: str) -> DataFrame:
    """cid, history (array of messages) of dialogue files whose history is a list or a JSON string of one."""
    return tolerant(spark, path).select("cid", F.from_json("history", f"array<{MESSAGE}>").alias("history"))


@F.pandas_udf(StringType())
def _literal(text: pd.Series) -> pd.Series:
    """Python literals as JSON; null where the text isn't a list."""

    def one(t: str) -> str | None:
        try:
            found = ast.literal_eval(t)
            return json.dumps(found, ensure_ascii=False) if isinstance(found, list) else None
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None

    return text.map(one)


def parsed_histories(df: DataFrame, column: str, kind: str = "array<struct<role:string,content:string,message:string>>") -> DataFrame:
    """Replaces a history column that is JSON, a Python literal or neither by an array (empty where it is neither).

    JSON is parsed natively; only what is left goes through Python.
    """
    c = F.col(column)
    named = [f for f in df.columns if f != column]
    tried = df.withColumn("_h", F.from_json(c, kind)).withColumn("_ok", F.col("_h").isNotNull() & ~F.exists("_h", lambda m: m.isNull()) | (T.strip(c) == ""))
    easy = tried.filter("_ok").select(*named, F.coalesce("_h", F.array().cast(kind)).alias(column))
    rest = tried.filter("not coalesce(_ok, false)").select(*named, F.coalesce(F.from_json(_literal(F.coalesce(c, F.lit(""))), kind), F.array().cast(kind)).alias(column))
    return easy.unionByName(rest)


def responses_by_model(spark: SparkSession, folder: str, excluded: list[str] | None = None, schema: str = "cid string, generated_response string") -> DataFrame:
    """All response files, or folders of part files, of a folder; the name before .jsonl is the model's."""
    df = spark.read.schema(schema).json(f"{folder}/*.jsonl").select("*", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.jsonl(?:/[^/]*)?$", 1).alias("model"))
    return df.filter(~F.col("model").isin(excluded or []))


def append(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("append").format(form).save(path)


def rewrite(df: DataFrame, base: str, version: str, form: str = "parquet") -> str:
    """Writes a new version beside the old ones, and fails if a row was lost; returns its path. No input is overwritten."""
    path = f"{base}/version={version}"
    expected = df.count()
    df.write.mode("errorifexists").format(form).save(path)
    written = df.sparkSession.read.schema(df.schema).format(form).load(path).count()
    if written != expected:
        raise ValueError(f"{written} of {expected} rows were written to {path}")
    return path


def latest(spark: SparkSession, base: str, form: str = "parquet") -> DataFrame:
    """The newest version of a rewritten table."""
    versions = spark.read.format(form).load(base)
    newest = versions.agg(F.max("version")).first()[0]  # one value
    return versions.filter(F.col("version") == newest)


