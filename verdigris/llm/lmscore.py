"""Operator 2, language-model scoring with stupid backoff.

For a word w after its history h of n - 1 words, S(w | h) is count(h w) / count(h) if h w was seen at least
``SEEN`` times in the corpus, and ``BACKOFF`` times S(w | h without its first word) otherwise; a single word
has count(w) / all words. A document's score is the sum of log10 S over its words.

Texts become a table of batches, bucketed by batch: word hashes of each batch once, and the words as places in that list.
The counts are made order by order. A batch sends its distinct n-grams with their counts, partitioned by hash; every hash
partition is a slice of the corpus count table of that order, sums the counts, and answers each batch in the order of its
question. N-grams are only asked for where both n-grams one word shorter were seen ``SEEN`` times: no other can have been,
so nothing is lost, and most rare n-grams are never sent. At last the answers join the batches, where they are spread
over the positions and summed per document. An n-gram crosses the network once per batch that has it, however often it
occurs, and all partitions are alike in size; rows, of a batch and a partition each, are never more than the n-grams sent.

A row for every position and order, exploded and joined, would be the plainer form. It is about 780 million rows for each
GB of Parquet, 12 GB before any join, which no disk budget here holds; so n-grams move by batch, in sorted arrays.
N-grams are known by 64-bit hashes.

Cases: null and empty texts have no words, sum 0 and no mean; repeated rows and ties are scored alike and counted
each; a null id keeps its row; an empty table gives an empty result; very long texts are a batch of their own; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import words as wd
from verdigris.llm.common import bound_batches, bucketed, materialize, table, text_or_empty
from verdigris.llm.decontaminate import shard

ORDER, SEEN, BACKOFF = 3, 2, 0.4
NO_ID = -(1 << 63)
BATCH_TEXT, BUCKET_NGRAMS, STEP = 6 << 20, 1 << 21, 1 << 20


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _pack_sorted(h: np.ndarray) -> bytes:
    """Sorted 64-bit values: differences, each byte place together."""
    d = np.diff(h, prepend=np.uint64(0))
    return _pack(d.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _unpack_sorted(b: bytes) -> np.ndarray:
    raw = _unpack(b, np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


_BATCH = "batch long, n_words long, docs binary, counts binary, vocabulary binary, words binary"


def batches_of(docs: DataFrame) -> DataFrame:
    """The corpus as a table of batches; words hold a 0 after each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        words: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def send() -> pa.RecordBatch:
            h = np.concatenate(words)
            vocabulary, place = np.unique(h, return_inverse=True)
            n = np.concatenate(counts)
            row = ([base + k], [int(n.sum())], [_pack(np.array(ids, np.int64))], [_pack(n.astype(np.int64))], [_pack_sorted(vocabulary)], [_pack(place.astype(np.uint32))])
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=[x.split()[0] for x in _BATCH.split(", ")])

        def add(group: list[tuple[int, bytes]]) -> None:
            s = shard([t for _, t in group])
            ids.extend(i for i, _ in group)
            words.append(s.hashes)
            counts.append(s.counts)

        for batch in batches:
            group: list[tuple[int, bytes]] = []
            held = 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                group.append((doc, text.encode()))
                held += len(group[-1][1])
                if held >= STEP:
                    add(group)
                    size, group, held = size + held, [], 0
                    if size >= BATCH_TEXT:
                        yield send()
                        ids, words, counts, size, k = [], [], [], 0, k + 1
            if group:
                add(group)
                size += held
        if ids:
            yield send()

    return docs.mapInArrow(run, _BATCH)


def _ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words that end at each place; 0 where a text has no such words yet."""
    if n == 1:
        return h
    out = np.zeros(len(h), np.uint64)
    g = np.maximum(wd.grams(h, n) ^ np.uint64(n), np.uint64(1))
    stop = np.concatenate([[0], np.cumsum(h == 0)])
    ends = np.arange(n - 1, len(h))
    whole = stop[ends + 1] == stop[ends - n + 1]
    out[n - 1 :][whole] = g[whole]
    return out


class Counted:
    """A batch, and the counts of its n-grams as far as they are known, by position."""

    def __init__(self, vocabulary: bytes, words: bytes, seen: int):
        self.vocabulary, self.place, self.seen = _unpack_sorted(vocabulary), _unpack(words, np.uint32), seen
        self.hashes = self.vocabulary[self.place]
        self.counts: list[np.ndarray] = []

    def asked(self, n: int, inverse: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams to be counted, with their counts here, or with the place in them of each position of the third."""
        if n == 1:
            word = self.vocabulary != 0
            at = np.flatnonzero(self.hashes)
            own = self.place[at] - int(not word.all())  # the mark between texts is the first of the vocabulary
            return self.vocabulary[word], own if inverse else np.bincount(own, minlength=int(word.sum())), at
        g = _ngrams(self.hashes, n)
        often = self.counts[n - 2] >= self.seen
        at = np.flatnonzero((g != 0) & often & np.append(False, often[:-1]))
        u, other = np.unique(g[at], return_inverse=inverse, return_counts=not inverse)
        return u, other, at

    def answered(self, n: int, totals: np.ndarray) -> None:
        """totals: of asked(n), in its order."""
        _, place, at = self.asked(n, True)
        counts = np.zeros(len(self.hashes), np.int64)
        counts[at] = totals[place]
        self.counts.append(counts)

    def told(self, answers: pa.Table, orders: int) -> None:
        """answers: bucket, n, totals of the orders up to this one."""
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("n", "bucket", "totals")))) if len(answers) else []
        for n in range(1, orders + 1):
            parts = [np.ascontiguousarray(_unpack(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel() for k, _, b in rows if k == n]
            self.answered(n, np.concatenate([np.zeros(0, np.int64), *parts]))


_ASKED = "bucket int, batch long, n int, ngrams binary, counts binary"
_TOLD = "batch long, bucket int, n int, totals binary"
_SCORES = "doc_id long, n_words long, log10_sum double, n_backoff long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _questions(batch: Counted, key: int, n: int, buckets: int) -> pa.Table:
    """A row for each bucket that has n-grams of the batch."""
    u, c, _ = batch.asked(n)
    # the high bits choose the bucket, so that sorted hashes are in bucket order
    cut = np.searchsorted(u, (np.arange(buckets + 1, dtype=object) * (1 << 64) // buckets)[1:-1].astype(np.uint64)) if buckets > 1 else []
    rows = [(b, key, n, _pack_sorted(x), _pack(y.astype(np.uint32))) for b, (x, y) in enumerate(zip(np.split(u, cut), np.split(c, cut))) if len(x)]
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({k: pa.array(v, t) for k, v, t in zip(_names(_ASKED), zip(*rows) if rows else [[]] * 5, types)})


def _count(group: pa.Table) -> pa.Table:
    """The count table of one bucket, and its answers."""
    hashes = [_unpack_sorted(b) for b in group.column("ngrams").to_pylist()]
    counts = [_unpack(b, np.uint32) for b in group.column("counts").to_pylist()]
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)[place]
    answers = np.split(sums, np.cumsum([len(x) for x in hashes])[:-1])
    packed = pa.array([_pack(a.view(np.uint8).reshape(-1, 8).T) for a in answers], pa.binary())
    return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"), "n": group.column("n"), "totals": packed})


def scored(docs: DataFrame, order: int = ORDER, seen: int = SEEN, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log10_sum, log10_mean, n_backoff (words scored with less than the full history there was)."""
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_or_empty("text").alias("text"))
    corpus = bucketed(batches_of(source), "batches", "batch")
    total = corpus.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_NGRAMS))
    batches, answers = corpus.groupBy("batch"), spark.createDataFrame([], _TOLD)

    def ask(n: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = left.select(["batch", "vocabulary", "words"]).to_pylist()
            out = []
            for r in rows:
                batch = Counted(r["vocabulary"], r["words"], seen)
                batch.told(right, n - 1)
                out.append(_questions(batch, r["batch"], n, buckets))
            return pa.concat_tables(out)

        return run

    for n in range(1, order + 1):
        questions = batches.cogroup(answers.groupBy("batch")).applyInArrow(ask(n), _ASKED)
        # written, as the next order and the scores read it
        answers = answers.unionByName(materialize(questions.groupBy("bucket").applyInArrow(_count, _TOLD), "answers"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        batch = Counted(row["vocabulary"], row["words"], seen)
        batch.told(right, order)
        word = batch.hashes != 0
        value, fewer = np.zeros(len(word)), np.zeros(len(word), bool)
        for n, counts in enumerate(batch.counts, 1):
            if n == 1:
                value[word] = np.log10(counts[word] / total)
                continue
            has = _ngrams(batch.hashes, n) != 0
            ok = np.flatnonzero(counts >= seen)
            # the n - 1 words before are those that end one place before
            value[has] += np.log10(backoff)
            value[ok] = np.log10(counts[ok] / batch.counts[n - 2][ok - 1])
            fewer[has] = True
            fewer[ok] = False
        n_words = _unpack(row["counts"], np.int64)
        at = np.repeat(np.arange(len(n_words)), n_words + 1)
        out = (_unpack(row["docs"], np.int64), n_words, np.bincount(at, weights=np.where(word, value, 0.0), minlength=len(n_words)), np.bincount(at[word & fewer], minlength=len(n_words)))
        return pa.table({k: pa.array(v, t) for k, v, t in zip(_names(_SCORES), out, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))})

    rows = batches.cogroup(answers.groupBy("batch")).applyInArrow(score, _SCORES)
    return rows.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words", "log10_sum", (F.col("log10_sum") / F.nullif(F.col("n_words"), F.lit(0))).alias("log10_mean"), "n_backoff")


def _query(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), order)
    return out.select("doc_id", "n_words", F.round("log10_sum", 4).alias("log10_sum"), F.round("log10_mean", 6).alias("log10_mean"), "n_backoff")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, ORDER)


def op2_lm_scoring_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one word of context."""
    return _query(spark, sf_dir, 2)


def op2_lm_scoring_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production query by the name that says its order."""
    return _query(spark, sf_dir, 3)


ORACLE_BIGRAMS = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)),
g AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM w),
c1 AS (SELECT word, count(*) AS n FROM g GROUP BY word),
c2 AS (SELECT prev, word, count(*) AS n FROM g WHERE prev IS NOT NULL GROUP BY prev, word),
s AS (
  SELECT doc_id,
    CASE WHEN g.prev IS NULL THEN log10(a.n / t.n) WHEN c2.n >= 2 THEN log10(c2.n / p.n) ELSE log10(a.n / t.n) + log10(0.4) END AS v,
    CASE WHEN c2.n < 2 THEN 1 ELSE 0 END AS b
  FROM g JOIN c1 a ON a.word = g.word LEFT JOIN c1 p ON p.word = g.prev LEFT JOIN c2 ON c2.prev = g.prev AND c2.word = g.word, (SELECT count(*)::DOUBLE AS n FROM g) t),
d AS (SELECT doc_id, count(*) AS n_words, sum(v) AS v, sum(b)::BIGINT AS n_backoff FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(v, 0), 4) AS log10_sum, round(v / n_words, 6) AS log10_mean, coalesce(n_backoff, 0)::BIGINT AS n_backoff
FROM documents LEFT JOIN d USING (doc_id)
"""

ORACLE_TRIGRAMS = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents)),
g AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev, lag(word, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS prev2 FROM w),
c1 AS (SELECT word, count(*) AS n FROM g GROUP BY word),
c2 AS (SELECT prev, word, count(*) AS n FROM g WHERE prev IS NOT NULL GROUP BY prev, word),
c3 AS (SELECT prev2, prev, word, count(*) AS n FROM g WHERE prev2 IS NOT NULL GROUP BY prev2, prev, word),
s AS (
  SELECT doc_id,
    CASE WHEN c3.n >= 2 THEN log10(c3.n / h.n) ELSE
      CASE WHEN g.prev2 IS NULL THEN 0 ELSE log10(0.4) END +
      CASE WHEN g.prev IS NULL THEN log10(a.n / t.n) WHEN c2.n >= 2 THEN log10(c2.n / p.n) ELSE log10(a.n / t.n) + log10(0.4) END END AS v,
    CASE WHEN g.prev2 IS NULL THEN CASE WHEN c2.n < 2 THEN 1 ELSE 0 END WHEN c3.n < 2 THEN 1 ELSE 0 END AS b
  FROM g JOIN c1 a ON a.word = g.word LEFT JOIN c1 p ON p.word = g.prev LEFT JOIN c2 ON c2.prev = g.prev AND c2.word = g.word
    LEFT JOIN c2 h ON h.prev = g.prev2 AND h.word = g.prev LEFT JOIN c3 ON c3.prev2 = g.prev2 AND c3.prev = g.prev AND c3.word = g.word, (SELECT count(*)::DOUBLE AS n FROM g) t),
d AS (SELECT doc_id, count(*) AS n_words, sum(v) AS v, sum(b)::BIGINT AS n_backoff FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(v, 0), 4) AS log10_sum, round(v / n_words, 6) AS log10_mean, coalesce(n_backoff, 0)::BIGINT AS n_backoff
FROM documents LEFT JOIN d USING (doc_id)
"""
