"""Operator 4, benchmark decontamination with training suffix arrays.

Each task turns its documents into word arrays and builds the suffix array of that shard: the
positions of its words in the order of the words that follow, ``window`` words deep, with a mark
between documents so that no match crosses them. Suffixes that share no leading words with any
test suffix can't be found by any search and are left out before sorting. Every test suffix is
then binary-searched in the array of every shard; the range it falls in holds the documents and
places of its matches. Equal test suffixes are searched once, so a place is found once for each length of suffixes, however often the
words of an item or a document repeat. From the places found on, the longest verbatim match is searched in the items' own suffix array by sums
of hashes, without going word by word. Of each document the longest is
reported with its item and its places in both, the first of equal ones; ``longest_matches`` lists all.

The benchmark is the query set: it goes to the tasks in blocks of at most ``BLOCK_BYTES``
(one broadcast each, size checked), and what the blocks find in a document is merged by document.

Cases: null or empty texts have no words and no hits; an item of fewer words than a window is one
window, an item without words none; repeated items and documents each count; documents with repeated or null ids are rows like
others, items with null ids are left out; very long texts are shards of their own; empty tables give
empty results or documents without hits; further columns of documents are kept, except for those named like a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import words as wd
from verdigris.llm.common import bound_batches, pieces, table, text_or_empty

WINDOW, LEAD, BLOCK_BYTES, CHUNK = 13, 4, 32 << 20, 1 << 20
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased.
WORD_BYTES = wd.table_of(lambda c: 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
_FILTER_BITS = 22


@dataclass
class Shard:
    """The words of some texts: hashes with a 0 after each text, and the text that each belongs to."""

    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray
    counts: np.ndarray


def shard(texts: list[bytes]) -> Shard:
    data = np.frombuffer(b" ".join(texts).translate(WORD_BYTES), np.uint8)
    starts, ends = wd.spans(data)
    h = wd.hashes(data, starts, ends)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    word_text = np.searchsorted(begins, starts, "right") - 1
    counts = np.bincount(word_text, minlength=len(texts))
    out = np.zeros(len(h) + len(texts), np.uint64)
    out[np.arange(len(h)) + word_text] = h
    first = np.cumsum(np.concatenate([[0], counts + 1]))[:-1]
    owner = np.repeat(np.arange(len(texts)), counts + 1)
    return Shard(out, owner, first, counts)


def _keys(h: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The next depth words of each place as byte strings that sort like the words' hashes."""
    padded = np.concatenate([h, np.zeros(depth, np.uint64)])
    rows = padded[at[:, None] + np.arange(depth)]
    stop = np.cumsum(rows == 0, axis=1) > 0
    rows[stop] = 0  # nothing beyond the end of the text
    return np.ascontiguousarray(rows.astype(">u8")).view(f"S{8 * depth}").ravel()


class Tests:
    """The test suffixes of a block of items: one for each window, with what is needed to search them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        texts = [(t or "").encode() for _, t in items]
        s = shard(texts)
        at, length, owner = [], [], []
        for i, (first, n) in enumerate(zip(s.first.tolist(), s.counts.tolist())):
            if n:
                size = min(n, window)
                at += range(first, first + n - size + 1)
                length += [size] * (n - size + 1)
                owner += [i] * (n - size + 1)
        self.names, self.begins = [k for k, _ in items], s.first
        self.window, self.words = window, s.hashes
        self.at, self.length, self.owner = np.array(at, np.int64), np.array(length, np.int64), np.array(owner, np.int64)
        self.lo = _keys(s.hashes, self.at, window)
        mask = np.arange(window)[None, :] >= self.length[:, None]
        raw = self.lo.view(np.dtype(">u8")).reshape(-1, window) if len(at) else np.zeros((0, window), ">u8")
        low, high = raw.copy(), raw.copy()
        low[mask], high[mask] = 0, np.uint64(2**64 - 1)
        self.lo = np.ascontiguousarray(low).view(f"S{8 * window}").ravel()
        self.hi = np.ascontiguousarray(high).view(f"S{8 * window}").ravel()
        #: Test suffixes that are equal are searched once: a first one of each, its length, and the items that have it.
        _, first, same = np.unique(np.stack([self.lo, self.hi], 1).view(f"S{16 * window}").ravel(), return_index=True, return_inverse=True) if len(at) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.lo, self.hi, self.size, self.first_at = self.lo[first], self.hi[first], self.length[first], self.at[first]
        pairs = np.unique(same.ravel() * len(items) + self.owner) if len(at) else np.zeros(0, np.int64)
        self.items, self.item_first = pairs % max(1, len(items)), np.searchsorted(pairs // max(1, len(items)), np.arange(len(first) + 1))
        self._order: np.ndarray | None = None
        #: Leading words by which suffixes of the shard are kept, and those that test suffixes have.
        self.leads: dict[int, np.ndarray] = {}
        for n in sorted(set(np.minimum(self.length, LEAD).tolist())):
            rows = self.at[np.minimum(self.length, LEAD) == n]
            bits = np.zeros(1 << _FILTER_BITS, bool)
            if len(rows):
                bits[wd.grams(s.hashes, n)[rows] >> np.uint64(64 - _FILTER_BITS)] = True
            self.leads[n] = bits

    def search(self, s: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(different test suffix, place in the shard) wherever the shard has the suffix's words: as many as places times lengths of suffixes at most."""
        keep = np.zeros(len(s.hashes), bool)
        for n, bits in self.leads.items():
            g = wd.grams(s.hashes, n)
            keep[: len(g)] |= bits[g >> np.uint64(64 - _FILTER_BITS)]
        at = np.flatnonzero(keep & (s.hashes != 0))
        if not len(at) or not len(self.lo):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = _keys(s.hashes, at, self.window)
        order = np.argsort(keys, kind="stable")
        array, at = keys[order], at[order]  # the suffix array of the shard
        lo, hi = np.searchsorted(array, self.lo, "left"), np.searchsorted(array, self.hi, "right")
        n = np.maximum(hi - lo, 0)
        test = np.repeat(np.arange(len(lo)), n)
        place = at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        return test, place

    def found(self, s: Shard, test: np.ndarray, place: np.ndarray) -> list[set[str]]:
        """The items with a window in each text of the shard."""
        out: list[set[str]] = [set() for _ in s.first]
        pairs = np.unique(s.text[place] * len(self.lo) + test)
        for p in pairs.tolist():
            i, t = divmod(p, len(self.lo))
            out[i].update(self.names[k] for k in self.items[self.item_first[t] : self.item_first[t + 1]].tolist())
        return out

    @property
    def order(self) -> np.ndarray:
        """The places of whole windows in the order of what follows them, to the end of the block: the items' suffix array, by doubling."""
        if self._order is None:
            _, rank = np.unique(self.words, return_inverse=True)
            depth = 1
            while len(rank) and rank.max() < len(rank) - 1 and depth < len(rank):
                behind = np.append(rank[depth:] + 1, np.zeros(min(depth, len(rank)), rank.dtype))
                _, rank = np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)
                depth *= 2
            whole = np.zeros(len(rank), bool)
            whole[self.at[self.length == self.window]] = True
            order = np.argsort(rank, kind="stable")
            self._order = order[whole[order]]
        return self._order

    def longest(self, s: Shard, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of the shard where a whole window stands, the words of the longest verbatim match, and the range of the test suffixes that have it in the order.

        The place is searched in the test words' suffix array; its best match stands beside where it would stand.
        """
        w, h = Sums(self.words, 1), Sums(s.hashes, 2)
        low, high = np.zeros(len(place), np.int64), np.full(len(place), len(self.order))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            t = self.order[np.minimum(mid, len(self.order) - 1)]
            n = same_words(w, t, h, place)
            less = w.next(t, n) < h.next(place, n)
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        best = np.zeros(len(place), np.int64)
        for near in (low - 1, low):
            t = self.order[np.clip(near, 0, len(self.order) - 1)]
            best = np.maximum(best, np.where((near >= 0) & (near < len(self.order)), same_words(w, t, h, place), 0))
        # all that match as far stand together around it
        ends = []
        for step in (-1, 1):
            inner = low - 1 if step < 0 else low
            reach = np.zeros(len(place), np.int64)
            size = 1 << max(0, int(len(self.order)).bit_length())
            while size:
                far = inner + step * (reach + size - 1)
                t = self.order[np.clip(far, 0, len(self.order) - 1)]
                ok = (far >= 0) & (far < len(self.order)) & (same_words(w, t, h, place) >= best)
                reach = np.where(ok, reach + size, reach)
                size //= 2
            ends.append(reach)
        return best, low - ends[0], low + ends[1]

    def report(self, s: Shard, test: np.ndarray, place: np.ndarray) -> dict[int, tuple]:
        """(words, item, word of the item, word of the text) of the longest match of each text of the shard: the first in the text, then in the items.

        Items of fewer words than a window match as a whole; whole windows as far as the words are the same.
        """
        short = self.size[test] < self.window
        n, at, where = [self.size[test[short]]], [self.first_at[test[short]]], [place[short]]
        places = np.unique(place[~short])
        if len(places):
            far, low, high = self.longest(s, places)
            best = np.lexsort((places, -far, s.text[places]))
            best = best[np.flatnonzero(np.diff(s.text[places[best]], prepend=-1))]
            n.append(far[best])
            at.append(np.array([self.order[a:b].min() for a, b in zip(low[best], high[best])], np.int64))
            where.append(places[best])
        n, at, where = (np.concatenate(x) for x in (n, at, where))
        owner = s.text[where]
        first = np.lexsort((at, where, -n, owner))
        first = first[np.flatnonzero(np.diff(owner[first], prepend=-1))]
        item = np.searchsorted(self.begins, at[first], "right") - 1
        cols = (n[first], [self.names[i] for i in item], at[first] - self.begins[item], where[first] - s.first[owner[first]])
        return {int(i): (int(a), b, int(c), int(d)) for i, a, b, c, d in zip(owner[first], *cols)}


class Sums:
    """Words, and sums of their hashes by which two runs of words can be compared at once; a mark behind each text differs between the two sides."""

    def __init__(self, words: np.ndarray, side: int):
        self.words = np.append(words, np.uint64(0))
        marked = np.where(self.words == 0, np.uint64(side), self.words)
        self.total = np.zeros(len(marked) + 1, np.uint64)
        np.cumsum(marked * wd._power("up", len(marked)), out=self.total[1:])
        self.down = wd._power("down", len(marked) + 1)
        # words from each place to the mark behind its text
        ends = np.flatnonzero(self.words == 0)
        self.left = ends[np.searchsorted(ends, np.arange(len(marked)))] - np.arange(len(marked))

    def run(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.total[at + n] - self.total[at]) * self.down[at]

    def next(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.words[at + n]


def same_words(a: Sums, i: np.ndarray, b: Sums, j: np.ndarray) -> np.ndarray:
    """How many words are the same from the places i of a and j of b on, up to the ends of the texts."""
    n = np.zeros(len(i), np.int64)
    most = np.minimum(a.left[i], b.left[j])
    size = 1 << int(most.max(initial=0)).bit_length()
    while size:
        ok = n + size <= most
        more = np.where(ok, n + size, 0)
        n = np.where(ok & (a.run(i, more) == b.run(j, more)), n + size, n)
        size //= 2
    return n


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of bounded size; a longer item is a block of its own."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).filter("item_id is not null")
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r[1] or "")
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, item_word, doc_word, n_words of each verbatim match of at least a window that is no part of a longer one: of the places of a document where one begins, the longest, with one item that has it (places count words from 0)."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
    spark = docs.sparkSession
    bound_batches(spark)
    out = None
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tests = Tests(held.value, window)
            for batch in pieces(batches, CHUNK):
                ids = np.array(batch.column("doc_id").to_numpy(zero_copy_only=False))
                s = shard([t.encode() for t in batch.column("text").to_pylist()])
                test, place = tests.search(s)
                short = tests.size[test] < window
                whole, part = (test[short], place[short]), np.unique(place[~short])
                place = part
                n, low, _ = tests.longest(s, place) if len(place) else (np.zeros(0, np.int64),) * 3
                # a match that goes on from the word before is part of a longer one
                before = dict(zip(place.tolist(), n.tolist()))
                new = np.array([before.get(p - 1, 0) <= k for p, k in zip(place.tolist(), n.tolist())], bool)
                place, n, at = (np.concatenate(x) for x in ((place[new], whole[1]), (n[new], tests.size[whole[0]]), (tests.order[low[new]], tests.first_at[whole[0]])))
                owner, item = s.text[place], np.searchsorted(tests.begins, at, "right") - 1
                cols = [ids[owner], [tests.names[i] for i in item], at - tests.begins[item], place - s.first[owner], n]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, "doc_id long, item_id string, item_word long, doc_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id string, item_word long, doc_word long, n_words long")


REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_item string, item_word long, doc_word long"


def _digest(n_words: int, n_hit: int, items: list[str]) -> tuple:
    return n_words, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


def _covered(test: np.ndarray, place: np.ndarray, s: Shard, tests: Tests) -> np.ndarray:
    """Which words of the shard lie inside a found suffix."""
    size = len(s.hashes) + 1
    edge = np.bincount(place, minlength=size) - np.bincount(place + tests.size[test], minlength=size)
    return np.cumsum(edge[:-1]) > 0


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs and n_words, n_hit, n_items, items_sha256, contaminated, and words, item and places of the longest verbatim match."""
    spark = docs.sparkSession
    bound_batches(spark)
    own = [c for c in docs.columns if c not in {x.split()[0] for x in REPORT.split(", ")}]
    source = docs.select(*own)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    held = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, block_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one block is the usual case; more are read one after the other, so that one is in memory at a time
        single = Tests(held[0].value, window) if len(held) == 1 else None
        for batch in pieces(batches, CHUNK):
            s = shard([(t or "").encode() for t in batch.column("text").to_pylist()])
            found: list[set[str]] = [set() for _ in s.first]
            longest: list[tuple] = [(0, None, None, None)] * len(found)
            hit = np.zeros(len(s.hashes), bool)
            for block in held:
                tests = single or Tests(block.value, window)
                test, place = tests.search(s)
                if len(test):
                    hit |= _covered(test, place, s, tests)
                    for i, names in enumerate(tests.found(s, test, place)):
                        found[i] |= names
                    for i, row in tests.report(s, test, place).items():
                        longest[i] = max(longest[i], row, key=lambda r: r[0])
                if not single:
                    vars(block).pop("_value", None)  # this task's copy; it is read again from the broadcast's file
            n_hit = np.bincount(s.text[hit], minlength=len(found))
            rows = [(*_digest(int(n), int(k), list(items)), *row) for n, k, items, row in zip(s.counts, n_hit, found, longest)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=[*batch.schema.names, *(x.split()[0] for x in REPORT.split(", "))])

    return source.mapInArrow(run, f"{kinds}, {REPORT}")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, with the same columns."""
    names = {x.split()[0] for x in REPORT.split(", ")}
    own = {c: f"_own_{c}" for c in docs.columns if c in names}
    kept = contamination(docs.withColumnsRenamed(own), benchmark).filter(~F.col("contaminated")).drop(*names)
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination(docs.select("doc_id", "text"), items).drop("text")
