"""Operator 10, best-fit packing: exact-complement hashing over the histogram of lengths.

Texts become token ids and then pieces of at most ``capacity`` tokens. Only the histogram of piece
lengths reaches the driver (``capacity`` rows at most, whatever the corpus holds). There each length
looks up its gap in an index of single, pair and triple sums of lengths that are still available and
takes combinations that fill the gap exactly; what is left goes best fit. The plan is a list of
patterns, each with a number of sequences, and at least one length runs out with every pattern, so
the plan is bounded by the number of lengths too. Pieces find their place by their rank within
their length, which is counted in salted groups: one length may hold any share of the rows.

Token ids are those of the tokenizer of byte_bpe_50k.json without special tokens added around a text: an added token of
that file (<|endoftext|>) that stands inside a text is its one id there too, and the parts beside it are encoded alone.

Cases: a null text is an empty one and still has the end token; repeated rows, and rows with repeated or null ids, are packed
each; a very long text, also one of a single run of blanks or letters, is encoded whole and its ids are cut into pieces; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.common import bound_batches, materialize, table, text_or_empty

CAPACITY, SALTED = 2048, 1 << 20
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens() -> dict[str, int]:
    """The tokens that the tokenizer matches inside texts before all else."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoder(path: str, added: dict[str, int]):
    """A byte-level BPE encoder of a rank file and the added tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encoding(path: str, added: dict[str, int], json_path: str | None = None):
    """A function from a text to its ids. What the fast encoder refuses (a run of a million blanks overflows its stack) goes to the tokenizer itself."""
    fast, slow = partial(encoder(path, added).encode, allowed_special="all"), []

    def ids(text: str) -> list[int]:
        try:
            return fast(text)
        except ValueError:
            if not slow:
                import public_tokenizers
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

    return ids


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole pieces at the end, the rest first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    path, added = path or vocabulary(), added_tokens()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, added)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text)
                ids.append(end)
                data = array("I", ids).tobytes()
                rows += [(doc, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths that share a sequence) and how many sequences each is used for."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] += c
    out: list[tuple[list[int], int]] = []

    def take(pattern: list[int]) -> None:
        lengths, need = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // need).min())
        left[lengths] -= need * times
        out.append((pattern, times))

    def pair(total: int, used: list[int]) -> list[int] | None:
        """Two available lengths with this sum, the larger as large as can be."""
        if total < 2:
            return None
        have = left[: total + 1].copy()
        for u in used:
            if u <= total:
                have[u] -= 1
        a = np.arange((total + 1) // 2, total)
        ok = (have[a] > 0) & (have[total - a] > (a == total - a))
        found = np.flatnonzero(ok)
        return [int(a[found[-1]]), int(total - a[found[-1]])] if len(found) else None

    def exact(n: int) -> list[int] | None:
        gap = capacity - n
        if gap == 0:
            return [n]
        if left[gap] > (gap == n):
            return [n, gap]
        if two := pair(gap, [n]):
            return [n, *two]
        for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if left[a] > (a == n) and (two := pair(gap - a, [n, a])):
                return [n, a, *two]
        return None

    def best(n: int) -> list[int]:
        pattern, gap, have = [n], capacity - n, left.copy()
        have[n] -= 1
        while gap > 0 and len(found := np.flatnonzero(have[1 : gap + 1] > 0)):
            pattern.append(int(found[-1]) + 1)
            have[pattern[-1]] -= 1
            gap -= pattern[-1]
        return pattern

    for n in range(capacity, 0, -1):
        while left[n] > 0:
            if (pattern := exact(n)) is None:
                break
            take(pattern)
    for n in range(capacity, 0, -1):
        while left[n] > 0:
            take(best(n))
    return out


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, sequence, times, offset): ranks lo to hi of a length fill these sequences."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            lo = given.get(n, 0)
            rows.append((n, lo, lo + times, sequence, times, offset))
            given[n] = lo + times
            offset += n
        sequence += times
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table with doc_id, piece and length."""
    spark = parts.sparkSession
    # at most capacity rows reach the driver
    lengths = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # salts of about SALTED rows each, as many as a length needs
    salts = spark.createDataFrame([(n, max(1, -(-c // SALTED))) for n, c in lengths.items()], "length long, salts long")
    salted = parts.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("salts"))).drop("salts")
    # as many rows as there are salts, a row for each SALTED pieces and length at most
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("ranks_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    places = spark.createDataFrame(slots(plan(lengths, capacity)), "length long, lo long, hi long, sequence long, times long, at long")
    ranked = (
        salted.withColumn("in_salt", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
        .join(offsets.select("length", "salt", "ranks_before"), ["length", "salt"])
        .withColumn("rank", F.col("in_salt") + F.col("ranks_before"))
    )
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(places["length"])
    return placed.withColumns({"sequence_id": F.col("sequence") + F.col("rank") - F.col("lo"), "offset": F.col("at")}).drop("salt", "in_salt", "ranks_before", "rank", "lo", "hi", "sequence", "times", "at")


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    parts = materialize(tokenized(docs, capacity), "pieces")
    return pack(parts, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
