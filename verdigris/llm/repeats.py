"""Operator 3, removal of repeated byte strings with suffix arrays.

A byte goes when a ``length``-byte string that covers it also starts anywhere else in the corpus.

Every window of that length belongs to one anchor, the first of its 200-byte strings with the least hash, which
depends on nothing but the window's bytes: equal windows have equal anchors at equal places. (Shorter anchors
would bring together all that shares a short line; longer ones make more contexts.) The
consecutive windows of one anchor are a stretch of text, a context. So

1. contexts are hashed where they are read; equal ones are counted, with partial counts by task:
   their windows are all repeated;
2. an anchor with one context only has no other repeats;
3. the contexts of the other anchors, one copy of each and cut to what they share with another on either side
   of the anchor, go through suffix arrays made by linear grouping (``suffixes``), shard by shard; neighbours
   in the array that share ``length`` bytes are repeated.

An anchor may have any number of different contexts (a common passage among changing neighbours). They are
dealt out to shards of about ``SHARD`` contexts; each shard sends one copy of every window of its own, as a
hash and packed by hash bucket, and the buckets count those across the shards.

Places are kept by id and hash of the text, so rows that share an id, or have none, are told apart by what they say.
Equal contexts are known by two 64-bit hashes, of the anchor and of the whole context, windows of hot anchors by one of 128 bits.

``passages`` counts what repeats in words: of every 16 consecutive runs of 36 words the one with the least hash is a
fingerprint, and those that other texts hold too are counted. Any run of more than 50 words that two texts share holds one,
also where it is shorter than ``length`` bytes.

Cases: null and empty texts, and texts shorter than the length, lose nothing; a text that repeats
within itself counts; rows with one id and different texts lose each their own places; rows that repeat id and
text are copies of each other and lose the same; a null id is an id like any other; very long texts are read in overlapping
blocks; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm import words as wd
from verdigris.llm.common import bound_batches, materialize, pieces, table, text_or_empty
from verdigris.llm.decontaminate import shard
from verdigris.llm.suffixes import suffix_array

LENGTH, ANCHOR, CHUNK, SHARD, SHARD_BYTES = 400, 200, 1 << 19, 256, 1 << 15
#: A passage has more than RUN + PICK - 2 words.
RUN, PICK = 36, 16
#: What tells rows apart.
KEY = ("doc_id", "row")
NO_ID = -(1 << 63)
_IDX = np.uint64((1 << 20) - 1)


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if w > size else v


def _prefix(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * wd._power("up", len(data)), out=total[1:])
    return total


def contexts(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """anchor hash, first and last window start, hash of the context, place of the anchor in it, of each context in up to 2**20 bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none.astype(np.uint64), none
    total, k = _prefix(data), min(ANCHOR, length)
    at = np.arange(len(data) - k + 1)
    h = wd.mix((total[k:] - total[:-k]) * wd._power("down", len(data) + 1)[at])
    place = (_least((h & ~_IDX) | at.astype(np.uint64), length - k + 1) & _IDX).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    anchor = place[first]
    stop = last + length
    body = (total[stop] - total[first]) * wd._power("down", len(data) + 1)[first]
    same = wd.mix(body ^ wd.mix((stop - first).astype(np.uint64) << np.uint64(32) | (anchor - first).astype(np.uint64)))
    return h[anchor], first, last, same, anchor - first


def of_text(data: bytes, length: int = LENGTH) -> list[tuple[np.ndarray, ...]]:
    """contexts() of a text, in overlapping blocks if it is long."""
    raw, block = np.frombuffer(data, np.uint8), 1 << 19
    out = []
    for b in range(0, max(1, len(raw) - length + 1), block):
        a, first, last, same, at = contexts(raw[b : b + block + length - 1], length)
        out.append((a, first + b, last + b, same, at))
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, as maximal runs in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x


def found_contexts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """anchor, same, doc_id, row, first, last, at (the anchor's place in it), n (1): a row for each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK):
            cols: list[list[np.ndarray]] = [[], [], [], [], [], [], [], []]
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text"))):
                for a, first, last, same, at in of_text(text.encode(), length):
                    for c, v in zip(cols, (_signed(a), _signed(same), np.full(len(a), doc), np.full(len(a), row), first, last, at, np.ones(len(a), np.int64))):
                        c.append(v)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in flat], names=["anchor", "same", *KEY, "first", "last", "at", "n"])

    return docs.mapInArrow(run, "anchor long, same long, doc_id long, row long, first long, last long, at long, n long")


def _windows(texts: list[bytes], firsts: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of some contexts: context, window start in its document, whether it is repeated here, whether it is the first of its kind here."""
    joined = b"\0".join(texts) + b"\0"
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    rank, before = {}, None
    twin: set[int] = set()
    lead: list[int] = []
    owner = np.searchsorted(begins, np.arange(len(joined)), "right") - 1
    room = (begins[1:] - 1)[owner] - np.arange(len(joined))
    ok = (room >= length).tolist()
    for p in suffix_array(joined):
        if not ok[p]:
            continue
        if before is not None and joined[before : before + length] == joined[p : p + length]:
            twin.add(before)
            twin.add(p)
        else:
            lead.append(p)
        before = p
    at = np.flatnonzero(np.array(ok))
    leads = np.zeros(len(joined), bool)
    leads[lead] = True
    twins = np.zeros(len(joined), bool)
    if twin:
        twins[list(twin)] = True
    return owner[at], at - begins[owner[at]] + np.array(firsts, np.int64)[owner[at]], twins[at], leads[at]


def _shared(texts: list[bytes]) -> list[int]:
    """The length of the longest prefix that each text shares with any other."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    out = [0] * len(texts)
    for i, j in zip(order, order[1:]):
        n = min(len(texts[i]), len(texts[j]))
        differ = np.flatnonzero(np.frombuffer(texts[i], np.uint8, n) != np.frombuffer(texts[j], np.uint8, n)) if n else ()
        n = int(differ[0]) if len(differ) else n
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def trimmed(rows: list[tuple], length: int = LENGTH) -> list[tuple]:
    """(hot, doc, first, body) of one anchor's (hot, doc, first, at, body); doc is the row's key.

    Left and right of the anchor, bytes that a context shares with no other of its anchor lie in no repeated window and go, and so
    does a context that is then too short for a window. Contexts of hot anchors stay whole, as other shards hold more of them.
    """
    if rows and rows[0][0]:
        return [(hot, doc, first, body) for hot, doc, first, _, body in rows]
    k, out = min(ANCHOR, length), []
    left, right = _shared([r[4][: r[3]][::-1] for r in rows]), _shared([r[4][r[3] + k :] for r in rows])
    for (hot, doc, first, at, body), a, b in zip(rows, left, right):
        if a + k + b >= length:
            out.append((hot, doc, first + at - a, body[at - a : at + k + b]))
    return out


def _runs(doc: tuple[int, int], starts: np.ndarray, length: int) -> list[tuple]:
    """(doc_id, row, start, end) of the bytes that windows with these sorted starts cover, a row for each run of starts."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [(*doc, int(starts[a]), int(starts[b]) + length) for a, b in zip(np.append(0, cut + 1), np.append(cut, len(starts) - 1))]


_ASKED = np.dtype([("high", "<u8"), ("low", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i8")])
_MATCHED = "doc_id long, row long, start long, end long, bucket int, asked binary"


def matched(open_contexts: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """open_contexts: anchor, shard, hot, doc_id, row, first, at, body, with the rows of a shard together.

    Rows with a document say that its bytes from start to end go. Rows with a bucket hold the windows of hot anchors that
    other shards may have too (start is -1 where the window itself is decided).
    """

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (hot, (doc_id, row), first, body) of whole shards."""
        owner, start, twin, lead = _windows([r[3] for r in rows], [r[2] for r in rows], length)
        found: list[tuple] = []
        for i in np.unique(owner[twin]).tolist():
            found += [(*r, None, None) for r in _runs(rows[i][1], start[(owner == i) & twin], length)]
        asked = []
        for i, (hot, doc, first, body) in enumerate(rows):
            if hot:
                for j in np.flatnonzero((owner == i) & lead).tolist():
                    at = int(start[j]) - first
                    h = xxhash.xxh3_128_intdigest(body[at : at + length])
                    asked.append((h >> 64, h & (1 << 64) - 1, *doc, -1 if twin[j] else int(start[j])))
        if asked:
            windows = np.array(asked, _ASKED)
            of = windows["high"] % np.uint64(buckets)
            found += [(None, None, None, None, int(b), windows[of == b].tobytes()) for b in np.unique(of)]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 6, types)], names=[*KEY, "start", "end", "bucket", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        mine: list[tuple] = []
        last = None
        for batch in batches:
            for anchor, shard, hot, doc, row, *rest in zip(*(batch.column(n).to_pylist() for n in ("anchor", "shard", "hot", *KEY, "first", "at", "body"))):
                if (anchor, shard) != last:
                    held += trimmed(mine, length)
                    mine, last = [], (anchor, shard)
                    if sum(len(r[3]) for r in held) >= SHARD_BYTES:
                        yield solve(held)
                        held = []
                mine.append((hot, (doc, row), *rest))
        if held := held + trimmed(mine, length):
            yield solve(held)

    return open_contexts.mapInArrow(run, _MATCHED)


def counted(asked: DataFrame, length: int = LENGTH) -> DataFrame:
    """bucket, asked to the doc_id, row, start, end of windows that more than one shard has."""

    def count(group: pa.Table) -> pa.Table:
        windows = np.frombuffer(b"".join(group.column("asked").to_pylist()), _ASKED)
        _, place, n = np.unique(windows[["high", "low"]], return_inverse=True, return_counts=True)
        again = windows[(n[place] > 1) & (windows["start"] >= 0)]
        again = np.sort(again, order=("doc", "row", "start"))
        cut = np.flatnonzero((np.diff(again["doc"]) != 0) | (np.diff(again["row"]) != 0)) + 1
        rows = [r for part in np.split(again, cut) if len(part) for r in _runs((int(part["doc"][0]), int(part["row"][0])), part["start"], length)]
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip((*KEY, "start", "end"), zip(*rows) if rows else [[]] * 4)})

    return asked.groupBy("bucket").applyInArrow(count, "doc_id long, row long, start long, end long")


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, row, start, end (bytes) of what repeats; ranges may overlap. docs: doc_id, row, text without nulls."""
    all_contexts = materialize(found_contexts(docs, length), "contexts")
    # equal contexts: partial counts first, so a hot one is a row per task
    kinds = all_contexts.groupBy("anchor", "same").agg(F.sum("n").alias("n"), F.min(F.struct(*KEY, "first", "last", "at")).alias("one"))
    by_anchor = kinds.groupBy("anchor").agg(F.sum("n").alias("all"), F.count("*").alias("different")).filter("all > 1")
    judged = materialize(kinds.join(by_anchor.select("anchor", "different"), "anchor").filter("n > 1 or different > 1"), "judged")
    decided = all_contexts.join(judged.filter("n > 1").select("anchor", "same"), ["anchor", "same"], "left_semi").select(*KEY, F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    hot = F.col("different") > SHARD
    undecided = judged.filter("different > 1").select("anchor", F.pmod("same", F.ceil(F.col("different") / SHARD).cast("long")).alias("shard"), hot.alias("hot"), "one.*")
    body = F.substring(F.col("text").cast("binary"), F.col("first").cast("int") + 1, (F.col("last") - F.col("first") + length).cast("int"))
    bodies = docs.join(undecided, list(KEY)).select("anchor", "shard", "hot", *KEY, "first", "at", body.alias("body"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = bodies.dropDuplicates(["anchor", "shard", *KEY, "first"]).repartition(parts, "anchor", "shard").sortWithinPartitions("anchor", "shard")
    found = materialize(matched(together, 4 * parts, length), "matched")
    across = counted(found.filter("bucket is not null").select("bucket", "asked"), length)
    return decided.unionByName(found.filter("bucket is null").select(*KEY, "start", "end")).unionByName(across)


def _report(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    runs = merged([(a, min(b, len(text))) for a, b in ranges if a < len(text)])
    kept, at = hashlib.sha256(), 0
    for a, b in runs:
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()


def fingerprints(words: np.ndarray) -> np.ndarray:
    """Hashes of the picked runs of words of a text: of any PICK runs of RUN words in a row one at least."""
    g = wd.grams(words, RUN)
    return np.unique(_least(g, min(PICK, len(g)))) if len(g) else g


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_passages: the fingerprints of a text that other rows hold too. docs: doc_id, row, text without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK):
            s = shard([t.encode() for t in batch.column("text").to_pylist()])
            picked = [fingerprints(s.hashes[a : a + n]) for a, n in zip(s.first.tolist(), s.counts.tolist())]
            at = pa.array(np.repeat(np.arange(len(picked)), [len(h) for h in picked]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(picked).view(np.int64)), *(batch.column(c).take(at) for c in KEY)], names=["run", *KEY])

    found = materialize(docs.mapInArrow(run, "run long, doc_id long, row long"), "fingerprints")
    shared = found.groupBy("run").agg(F.count("*").alias("n")).filter("n > 1").select("run")
    return found.join(shared, "run", "left_semi").groupBy(*KEY).agg(F.countDistinct("run").alias("n_passages"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, own_id (which may be null), row, text."""
    own, text = F.col("doc_id").cast("long"), text_or_empty("text")
    return docs.select(own.alias("own_id"), F.coalesce(own, F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of every document."""
    return _removed(keyed(docs), length).drop("n_passages")


def _removed(source: DataFrame, length: int, counts: DataFrame | None = None) -> DataFrame:
    bound_batches(source.sparkSession)
    ranges = repeated_ranges(source.select(*KEY, "text"), length)
    # ranges of one document: neighbours are merged before they are collected, as they are bounded by the document's length then
    w = W.partitionBy(*KEY).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = ranges.withColumn("run", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("run").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy(*KEY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    runs = runs.join(counts, list(KEY), "full") if counts is not None else runs.withColumn("n_passages", F.lit(0).cast("long"))
    joined = source.join(runs, list(KEY), "left").select("own_id", "text", F.col("ranges.start").alias("starts"), F.col("ranges.end").alias("ends"), F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 * CHUNK):
            rows, kept = [], []
            for text, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                raw = text.encode()
                rows.append(_report(raw, list(zip(a or [], b or []))))
                at, keep = 0, []
                for x, y in merged(list(zip(a or [], b or []))):
                    keep.append(raw[at:x])
                    at = y
                kept.append(b"".join([*keep, raw[at:]]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = [batch.column("own_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types)), pa.array(kept, pa.binary()), batch.column("n_passages")]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_passages"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passages long")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    source = keyed(table(spark, sf_dir, "documents"))
    return _removed(source, LENGTH, passages(source.select(*KEY, "text"))).drop("kept")
