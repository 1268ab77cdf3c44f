"""Operator 8, language identification with error-correcting output codes.

Every language gets a codeword; one linear classifier per bit of the code, over hashed byte n-grams,
predicts that bit. A text's language is the codeword with the least logistic loss over all bits
(loss-weighted decoding: each bit counts by how sure its classifier is), and the share of that
codeword in the softmax of the losses is the score. A text whose two nearest codewords lie close
together is flagged as ambiguous.

The classifiers are fitted on the driver from a bounded sample of labelled texts: ``sample`` rows of each language at
most, and ``most`` of all languages together (both parameters of ``fit``), those with the smallest hash of their id. Tasks
turn the whole texts of the sample into features, so that a row is ``BUCKETS`` numbers at most on the driver, however
long its text. Prediction reads every whole text.

Cases: a null text, or one without a letter, is ``und`` with score 0 and not ambiguous; without any
labelled text every row is ``und``; with a single language all texts with letters get it; repeated
rows get the same answer; very long texts are read in blocks; further columns are kept, and columns of the same names are
replaced. ``accepted`` drops what has no letter, and, where nothing is labelled, keeps all else with a warning.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.common import bound_batches, pieces, table

SAMPLE, MOST, BUCKETS, BITS, CHUNK, BLOCK = 1000, 4000, 1 << 13, 15, 1 << 20, 1 << 20
#: Rows of the sample that are computed with at a time.
FIT_ROWS = 256
#: Softmax share below which the nearest codeword isn't clear.
AMBIGUOUS = 0.6
UNKNOWN = "und"


def _squeeze() -> bytes:
    """Lower-cases A-Z and makes all that isn't a letter byte a space."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


LETTERS = _squeeze()


def features(text: str) -> np.ndarray:
    """Square roots of the counts of hashed byte 1- to 4-grams, scaled to length 1."""
    data = np.frombuffer(b" " + b" ".join(text.encode("utf-8", "replace").translate(LETTERS).split()) + b" ", np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(data), BLOCK):  # a very long text in bounded memory
        part = data[start : start + BLOCK + 3].astype(np.uint32)
        h = np.zeros(len(part), np.uint32)
        for n in range(min(4, len(part))):
            h = h[: len(part) - n] * np.uint32(0x01000193) + part[n:] + np.uint32(1)
            counts += np.bincount(((h[:BLOCK] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64), minlength=BUCKETS)
    x = np.sqrt(counts.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(k: int, bits: int = BITS) -> np.ndarray:
    """k rows of -1 and 1 that differ in many places: the widest of a fixed number of random drawings without constant columns."""
    if k == 1:
        return np.ones((1, 1), np.float32)
    width = max(bits, int(np.ceil(10 * np.log2(k))) if k > 8 else bits)
    draw, best, wide = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.float32), (k, width))
        for j in np.flatnonzero(np.abs(code.sum(0)) == k):
            code[j % k, j] *= -1
        least = min((code[a] != code[b]).sum() for a in range(k) for b in range(a))
        if least > wide:
            best, wide = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    ambiguous: float = AMBIGUOUS

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and its share, for each row."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]).mean(2)
        share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        at = share.argmax(1)
        return at, share[np.arange(len(at)), at]


def sampled(rows: DataFrame) -> DataFrame:
    """lang, places, values: the features of texts with letters that aren't 0, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK):
            out: tuple[list, ...] = ([], [], [])
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if has_letter(text):
                    x = features(text)
                    at = np.flatnonzero(x)
                    for c, v in zip(out, (lang, at.astype("<u2").tobytes(), x[at].astype("<f2").tobytes())):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.binary(), pa.binary()))], names=["lang", "places", "values"])

    return rows.mapInArrow(run, "lang string, places binary, values binary")


def fit(labelled: DataFrame, sample: int = SAMPLE, steps: int = 40, most: int = MOST) -> Model | None:
    """labelled: doc_id, text, lang. Takes at most sample texts of each language, and most of all."""
    bound_batches(labelled.sparkSession)
    rows = labelled.filter("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string")).alias("key"), "text")
    # keys alone are ranked, in salted groups first, as one language may hold most rows; texts are read only of the sample
    first = W.partitionBy("lang", F.pmod("key", F.lit(64))).orderBy("key")
    again = W.partitionBy("lang").orderBy("key")
    few = rows.select("lang", "key").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample).withColumn("n", F.row_number().over(again)).filter(F.col("n") <= sample)
    bounds = few.groupBy("lang").agg(F.sort_array(F.collect_list("key")).alias("keys")).collect()  # one row a language, sample keys at most in each
    if not bounds:
        return None
    each = max(2, min(sample, most // len(bounds)))
    within = F.lit(False)
    for r in bounds:
        within = within | ((F.col("lang") == r["lang"]) & (F.col("key") <= r["keys"][min(each, len(r["keys"])) - 1]))
    # rows that repeat a key are as many as they are: the last key's may pass the bound, so it is held again, for each language, in salted groups first
    order = ("key", F.xxhash64("text"))
    parts = W.partitionBy("lang", F.pmod(F.xxhash64("text"), F.lit(64))).orderBy(*order)
    held = rows.filter(within).withColumn("n", F.row_number().over(parts)).filter(F.col("n") <= each).withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("n") <= each)
    taken = sampled(held.select("lang", "text"))
    got = sorted((r["lang"], bytes(r["places"]), bytes(r["values"])) for r in taken.toLocalIterator())
    if not got:
        return None
    languages = sorted({a for a, *_ in got})
    y = np.array([languages.index(a) for a, *_ in got])
    x = np.zeros((len(got), BUCKETS), np.float16)  # 64 MB for 4000 rows
    for i, (_, places, values) in enumerate(got):
        x[i, np.frombuffer(places, "<u2")] = np.frombuffer(values, "<f2")
    del got
    code = codewords(len(languages))
    target = code[y]
    each = (1 / np.bincount(y, minlength=len(languages)))[y]  # languages count alike
    each = (each / each.sum()).astype(np.float32)[:, None]
    weights, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    step = np.zeros_like(weights)
    for _ in range(steps):
        slope, shift = np.zeros_like(weights), np.zeros_like(bias)
        for i in range(0, len(x), FIT_ROWS):
            rows, goal = x[i : i + FIT_ROWS].astype(np.float32), target[i : i + FIT_ROWS]
            pull = each[i : i + FIT_ROWS] * goal / (1 + np.exp(np.clip(goal * (rows @ weights + bias), -30, 30)))
            slope += rows.T @ pull
            shift += pull.sum(0)
        step = 0.9 * step + 60 * (slope - 1e-6 * weights)
        weights += step
        bias += 4 * shift
    return Model(languages, code, weights.astype(np.float32), bias.astype(np.float32))


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs and lang_pred, score, ambiguous."""
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.drop("lang_pred", "score", "ambiguous")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    held = spark.sparkContext.broadcast(model)  # size fixed by BUCKETS and the number of bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in pieces(batches, CHUNK):
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            name, score, unclear = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
            if known:
                at, share = m.predict(np.stack([features(texts[i]) for i in known]))
                for i, a, s in zip(known, at.tolist(), share.tolist()):
                    name[i], score[i], unclear[i] = m.languages[a], min(1.0, max(0.0, s)), s < m.ambiguous
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(unclear, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return source.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame) -> DataFrame:
    """docs whose language is known, with the same columns: texts without letters go."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    if model is None:
        warnings.warn("no labelled text to learn a language from: only texts without letters are dropped", stacklevel=2)
        return docs.filter(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    own = [c for c in docs.columns if c in ("lang_pred", "score", "ambiguous")]
    kept = docs.withColumnsRenamed({c: f"_own_{c}" for c in own})
    return identified(kept, model).filter(F.col("lang_pred") != UNKNOWN).drop("lang_pred", "score", "ambiguous").withColumnsRenamed({f"_own_{c}": c for c in own}).select(*docs.columns)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identified(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
