"""Streaming forms: incremental curation, running counters, closed and enriched dialogues, one record per dialogue.

What is known of earlier batches lies in keyed state (RocksDB, by hash of the key, its changes written to the checkpoint), not in the
sinks: a batch looks up its own keys and reads no result of an earlier one. Sinks are written by batch; a batch that runs again after
a failure replaces its own folder, so each result is there once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators import turns as O
from verdigris.sources.dialogues import MESSAGE
from verdigris.sources.shared import materialize

CURATED = "cid string, reason string, batch long, route string"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB; the session's settings are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dialogue_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Dialogue files as they arrive; a history may be a list or a JSON string of one."""
    reader = spark.readStream.schema("cid string, history string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).select("cid", F.from_json("history", f"array<{MESSAGE}>").alias("history"))


def turns_of(dialogues: DataFrame) -> DataFrame:
    return dialogues.select("cid", F.posexplode("history").alias("pos", "m")).select(
        "cid", "pos", F.coalesce("m.turn_index", "pos").alias("turn_index"), "m.role", F.coalesce("m.message", F.lit("")).alias("message"),
        F.try_to_timestamp("m.create_time", F.lit("yyyy-MM-dd HH:mm:ss")).alias("create_time"), (F.coalesce("m.is_unliked", F.lit(0)) == 1).alias("is_unliked"),
        F.coalesce(F.nullif("m.length", F.lit(0)), F.length(F.coalesce("m.message", F.lit("")))).alias("length"),
    )


def curate(stream: DataFrame, sink: str, checkpoint: str, unsafe: str | None = None, seen: str | None = None) -> StreamingQuery:
    """Starts a query that prefilters new dialogues and appends them to sink by batch and route, each cid once, also across restarts.

    A dialogue is whole in its record; the only state is the cids that were met. seen: a folder of tables with a column cid, dialogues
    that were processed elsewhere; they enter the state with the first batch, the only one that compares with the folder itself.
    """
    spark = stream.sparkSession
    rows = stream.withColumn("_seen", F.lit(False))
    if seen:
        known = spark.readStream.schema("cid string").parquet(seen)
        rows = rows.unionByName(known.withColumn("_seen", F.lit(True)), allowMissingColumns=True)

    def add(batch: DataFrame, number: int) -> None:
        new = batch.filter("not _seen").drop("_seen")
        if seen and number == 0:
            new = new.join(batch.sparkSession.read.schema("cid string").parquet(seen), "cid", "left_anti")
        out = O.prefilter(O.signals(turns_of(new)), unsafe).withColumn("route", F.when(F.col("reason") == "pass", "kept").otherwise("deleted"))
        out.write.mode("overwrite").partitionBy("route").parquet(f"{sink}/batch={number}")

    with keyed_state(spark):
        return rows.dropDuplicates(["cid"]).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def curated(spark: SparkSession, sink: str) -> DataFrame:
    """cid, reason, batch, route of all that curate has written."""
    return spark.read.schema(CURATED).parquet(sink)


def counters(events: DataFrame, time: str, by: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts per time window and key. On a stream, a window leaves the state when the watermark passes it; a batch gets the same rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def count_on(stream: DataFrame, sink: str, checkpoint: str, time: str, by: str, late: str = "10 minutes", width: str = "5 minutes") -> StreamingQuery:
    """Starts a query that keeps counters() running: each batch writes the windows that it changed, with their new counts. Events later than the watermark count nowhere."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    with keyed_state(stream.sparkSession):
        return counters(stream, time, by, late, width).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, sink: str, by: str) -> DataFrame:
    """The newest count of each window and key: start, by, n."""
    rows = spark.read.schema(f"start timestamp, {by} string, n long, batch long").parquet(sink)
    return rows.groupBy("start", by).agg(F.max_by("n", "batch").alias("n"))


def closed_dialogues(turns: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Dialogues of a stream of turns, closed after a pause: cid, start, end, history. Turns later than the watermark are dropped."""
    m = F.struct("pos", "turn_index", "role", "message", "create_time", "length", "is_unliked")
    g = turns.withWatermark("create_time", late).groupBy(F.session_window("create_time", gap), "cid").agg(F.array_sort(F.collect_list(m)).alias("history"))
    return g.select("cid", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "history")


def enriched_sessions(closed: DataFrame, **lexicon) -> DataFrame:
    """Signals, reactions, chains and roll-up of closed dialogues, in one pass of the batch operators: cid, start, end and the columns of turns.enriched.

    A dialogue that was closed, and opened again after the pause, is two sessions, each enriched on its own.
    """
    key = F.concat_ws("\x1f", "cid", F.unix_micros("start").cast("string"))
    rows = closed.withColumn("_key", key)
    turn = rows.select(F.col("_key").alias("cid"), F.explode("history").alias("m")).select("cid", "m.*")
    return rows.select("cid", "start", "end", "_key").join(O.enriched(turn, keep=materialize, **lexicon).withColumnRenamed("cid", "_key"), "_key").drop("_key")


def enrich_closed(stream: DataFrame, sink: str, checkpoint: str, gap: str = "30 minutes", late: str = "10 minutes", **lexicon) -> StreamingQuery:
    """Starts a query that enriches each dialogue of a stream of turns when it closes. The state holds the turns of open dialogues only."""

    def add(batch: DataFrame, number: int) -> None:
        closed = materialize(batch, "closed")  # the state is read once
        if number and closed.isEmpty():
            return
        enriched_sessions(closed, **lexicon).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    with keyed_state(stream.sparkSession):
        return closed_dialogues(stream, gap, late).writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(records: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """One record of each cid within the watermark. Its cid leaves the state when the watermark passes its time by as much; records later than the watermark are dropped."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark(["cid"])


def write_once(records: DataFrame, sink: str, checkpoint: str, time: str, late: str = "1 hour") -> StreamingQuery:
    """Starts a query that writes once() to sink."""
    with keyed_state(records.sparkSession):
        return once(records, time, late).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
