"""Operator 11, cross-tokenizer alignment: byte-exact groups of the tokens of a byte-level BPE (A) and a sentencepiece model (B).

A encodes a space and the text, B the text, to which it adds a space itself. The character offsets of A and the spans of B
(those of its proto, asked for by ``return_type="offset_mapping"``: the installed library refuses "immutable_proto") are coarse cuts in bytes.
Where the span of a token isn't as long as the token's own bytes, as in the parts of a multibyte character and in byte-fallback
pieces, the token's end is refined with decoded bytes, counted from the last coarse cut before it. Offsets where A and B both
end cut the tokens into groups; tokens that end together are a link.

No token of either model holds a space after another character, so a text falls apart at each space between two other
characters, and what stands between is encoded alike wherever it stands. Each worker encodes what it hasn't met yet, joined
to strings of some thousands, and keeps a bounded number of answers, the most used ones where they would be too many.

Two tokens can only be linked if the bytes of one end in those of the other. The pairs of this kind follow from the two
vocabularies (``Pairs``), whatever the corpus holds; so links are places in that list, tasks count them in an
array of that length, and the counts that are summed over the corpus and sent back have that many rows at most.

Cases: null and empty texts, and texts whose decoded tokens differ from the text (a text that holds U+2581), have no tokens: zeros;
repeated rows, and rows with repeated or null ids, are aligned each; a very long text comes alone, and one without spaces is encoded as a
whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import bound_batches, materialize, pieces, table

#: Answers that a worker keeps, the longest text that it keeps one for, and the bytes of texts that are handled together.
KEPT, KEPT_CHARS, TOGETHER = 600_000, 64, 4 << 20
#: Texts that are joined to one string to be encoded: the tokenizers are slower on very long strings.
JOINED = 4096
_ODD = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def bytes_of_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = bytes(letters[c] for c in token)
    return out


def bytes_of_b(path: str) -> list[bytes | None]:
    """The bytes of each id of a sentencepiece model; None for ids that no text brings."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: list[bytes | None] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(None if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    return out


class Pairs:
    """The id pairs that can be linked, as sorted numbers a * width + b, and the B id of each."""

    def __init__(self, a: list[bytes], b: list[bytes | None]):
        self.width = len(b)
        of_a: dict[bytes, list[int]] = {}
        of_b: dict[bytes, list[int]] = {}
        for i, x in enumerate(a):
            of_a.setdefault(x, []).append(i)
        for i, y in enumerate(b):
            if y is not None:
                of_b.setdefault(y, []).append(i)
        codes = {i * self.width + j for x, ids in of_a.items() for k in range(len(x) + 1) for j in of_b.get(x[k:], ()) for i in ids}
        codes |= {i * self.width + j for y, ids in of_b.items() for k in range(len(y) + 1) for i in of_a.get(y[k:], ()) for j in ids}
        self.codes = np.array(sorted(codes), np.int64)
        self.b = (self.codes % self.width).astype(np.int32)


class _Places(dict):
    """Texts to their places among the answers. One that isn't known gets the next place and is kept in new until it is learnt."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, text: str) -> int:
        self[text] = at = len(self)
        self.new.append(text)
        return at


class Aligner:
    """Groups and links of texts, by two tokenizers."""

    def __init__(self, a_path: str, b_path: str, pairs: np.ndarray):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes, self.pairs = bytes_of_a(a_path), bytes_of_b(b_path), pairs
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x or b"") for x in self.b_bytes], np.int64)
        self.written = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.forget()

    def forget(self) -> None:
        self.place = _Places()
        self.groups: list[str | None] = []  # None where the bytes differ
        self.links: list[bytes] = []
        self.counts, self.uses = array("q"), array("q")

    def shrink(self, most: int) -> None:
        """Keeps the most used answers; none for long texts. What they were used before counts half."""
        uses, counts, groups, links = np.array(self.uses), np.array(self.counts).reshape(-1, 3), self.groups, self.links
        least = np.partition(uses, -most)[-most] if len(uses) > most else 0
        enough = (uses >= least).tolist()
        kept = [(t, i) for t, i in self.place.items() if enough[i] and len(t) <= KEPT_CHARS][:most]
        at = [i for _, i in kept]
        self.forget()
        self.place.update((t, i) for i, (t, _) in enumerate(kept))
        self.groups, self.links = list(map(groups.__getitem__, at)), list(map(links.__getitem__, at))
        self.counts.frombytes(counts[at].tobytes())
        self.uses.frombytes((uses[at] // 2).tobytes())

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of A's and B's tokens of a space and the text; None if their bytes aren't those."""
        whole = (" " + text).encode()
        enc = self.a.encode(" " + text, add_special_tokens=False)
        a = np.array(enc.ids, np.int64)
        spans = self.b.encode(text, return_type="offset_mapping", return_bytes=True)
        b = np.array(spans["ids"], np.int64)
        if b"".join([self.a_bytes[i] for i in enc.ids]) != whole or b"".join([self.b_bytes[i] or b"" for i in spans["ids"]]) != whole:
            return None
        chars = np.fromiter(chain.from_iterable(enc.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        if len(whole) > len(text) + 1:  # byte offsets of characters
            data = np.frombuffer(whole, np.uint8)
            chars = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))[chars]
        of_b = np.fromiter(chain.from_iterable(spans["offsets"]), np.int64, 2 * len(b)).reshape(-1, 2) + 1
        of_b[:1, 0] = 0  # the first piece has the space that B adds
        return a, _refined(chars, self.a_len[a]), b, _refined(of_b, self.b_len[b])

    def aligned(self, text: str) -> list[tuple[int, int, list[int], list[int]]]:
        """(start, end, A ids, B ids) of each group, in bytes of a space and the text."""
        if not text or (found := self.tokens(text)) is None:
            return []
        a, a_end, b, b_end = found
        cuts = np.intersect1d(a_end, b_end)
        i, j = np.searchsorted(a_end, cuts, "right"), np.searchsorted(b_end, cuts, "right")
        return [(s, e, a[p:q].tolist(), b[x:y].tolist()) for s, e, p, q, x, y in zip([0, *cuts[:-1].tolist()], cuts.tolist(), [0, *i[:-1]], i, [0, *j[:-1]], j)]

    def _linked(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Places of the links in the list of pairs; a token without bytes ends where the one before it ends."""
        width = len(self.b_bytes)
        low, high = np.searchsorted(b_end, a_end, "left"), np.searchsorted(b_end, a_end, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.searchsorted(self.pairs, np.repeat(a, n) * width + b[at]).astype(np.int32)

    def learn(self, new: list[str]) -> None:
        """Answers for these texts, which stand behind the others: those that neither begin nor end in white space are encoded together."""
        first = len(self.groups)
        self.groups.extend([None] * len(new))
        self.links.extend([b""] * len(new))
        self.counts.frombytes(bytes(24 * len(new)))
        self.uses.frombytes(bytes(8 * len(new)))
        plain = [i for i, t in enumerate(new, first) if t and not t[0].isspace() and not t[-1].isspace()]
        done: set[int] = set()
        for k in range(0, len(plain), JOINED):
            if len(at := plain[k : k + JOINED]) > 1 and self._learn_joined(at, [new[i - first] for i in at]):
                done.update(at)
        for i, t in enumerate(new, first):
            if i in done or not t or (found := self.tokens(t)) is None:
                continue
            groups = self.aligned(t)
            self.groups[i] = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for _, _, x, y in groups)
            self.links[i] = self._linked(*found).tobytes()
            self.counts[3 * i : 3 * i + 3] = array("q", (len(found[0]), len(found[2]), len(groups)))

    def _learn_joined(self, at: list[int], texts: list[str]) -> bool:
        """Puts the answers of these texts, encoded as one, at these places; False if the bytes differ."""
        if (found := self.tokens(" ".join(texts))) is None:
            return False
        a, a_end, b, b_end = found
        ends = np.cumsum([len(t.encode()) + 1 for t in texts])
        i, j = np.searchsorted(a_end, ends, "right"), np.searchsorted(b_end, ends, "right")
        heads = b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end  # tokens of A that have a link
        cuts = a_end[heads]
        cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])]
        p, q, k = np.searchsorted(a_end, cuts, "right").tolist(), np.searchsorted(b_end, cuts, "right").tolist(), np.searchsorted(cuts, ends, "right")
        links = self._linked(a, a_end, b, b_end)
        x, y = list(map(self.written.__getitem__, a.tolist())), list(map(self.written.__getitem__, b.tolist()))
        g = [f"{x[s] if e - s == 1 else ','.join(x[s:e])}|{y[u] if v - u == 1 else ','.join(y[u:v])}" for s, e, u, v in zip([0, *p[:-1]], p, [0, *q[:-1]], q)]
        upto = np.stack([i, j, k], 1)
        counts = np.frombuffer(self.counts, np.int64).reshape(-1, 3)
        counts[at] = np.diff(upto, axis=0, prepend=np.zeros((1, 3), np.int64))
        del counts  # else the array could not grow
        if len(links) == heads.sum():
            raw, to = links.tobytes(), (4 * np.cumsum(heads)[i - 1]).tolist()
            own = [raw[s:e] for s, e in zip([0, *to[:-1]], to)]
        else:
            own = [self._linked(a[s:e], a_end[s:e], b[u:v], b_end[u:v]).tobytes() for s, e, u, v in zip([0, *i[:-1]], i, [0, *j[:-1]], j)]
        k = k.tolist()
        for n, s, e, of_n in zip(at, [0, *k[:-1]], k, own):
            self.groups[n], self.links[n] = g[s] if e - s == 1 else ";".join(g[s:e]), of_n
        return True

    def run(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """n_a, n_b, n_groups, the groups as text and the links of each text."""
        none = (0, 0, 0, "", np.zeros(0, np.int32))
        place = self.place.__getitem__
        places = [list(map(place, _parts(t))) if t else () for t in texts]
        new, self.place.new = self.place.new, []
        self.learn(new)
        counts, uses, out = np.array(self.counts).reshape(-1, 3), np.frombuffer(self.uses, np.int64), []
        for at in places:
            groups = list(map(self.groups.__getitem__, at))
            if not at or None in groups:
                out.append(none)
            else:
                where = np.array(at)
                uses[where] += 1
                out.append((*counts[where].sum(0).tolist(), ";".join(groups), np.frombuffer(b"".join(map(self.links.__getitem__, at)), np.int32)))
        del uses
        if len(self.place) > KEPT or any(len(t) > KEPT_CHARS for t in new):
            self.shrink(KEPT // 2 if len(self.place) > KEPT else KEPT)
        return out


def _refined(spans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ends of tokens in bytes: the ends of spans that are as long as their tokens' bytes, and between these the bytes themselves."""
    ends = spans[:, 1].copy()
    coarse = spans[:, 1] - spans[:, 0] == lengths
    if not coarse.all():
        total = np.cumsum(lengths)
        last = np.maximum.accumulate(np.where(coarse, np.arange(len(ends)), -1))
        base = np.where(last >= 0, ends[last] - total[last], 0)
        ends = base + total
    return ends


def _parts(text: str) -> list[str]:
    """What stands between the spaces at which both tokenizers cut, without the space before it."""
    if text[0].isspace() or text[-1].isspace() or _ODD.search(text):
        return [p[1:] for p in _CUT.split(" " + text)]
    return text.split(" ")


_aligners: dict[tuple[str, str, int], Aligner] = {}


def aligner(a_path: str, b_path: str, pairs: np.ndarray) -> Aligner:
    """One of each kind in a worker, which serves many tasks."""
    key = (a_path, b_path, len(pairs))
    if key not in _aligners:
        _aligners[key] = Aligner(a_path, b_path, pairs)
    return _aligners[key]


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, Pairs]:
    """A table of doc_id, n_a, n_b, n_groups, groups_sha256, links (places in the list of pairs), and that list."""
    a_path, b_path = a_path or paths()[0], b_path or paths()[1]
    spark = docs.sparkSession
    pairs = Pairs(bytes_of_a(a_path), bytes_of_b(b_path))
    held = spark.sparkContext.broadcast(pairs.codes)  # bounded by the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path, held.value)
        for batch in pieces(batches, TOGETHER):
            found = align.run(batch.column("text").to_pylist())
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for _, _, _, g, _ in found]
            sizes = np.cumsum([0, *(len(x[4]) for x in found)]).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([x[4] for x in found]) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[k] for x in found], pa.int64()) for k in range(3)), pa.array(digests, pa.string()), links], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>"), "alignment"), pairs


def pair_counts(links: DataFrame, pairs: Pairs) -> np.ndarray:
    """How many links hold each pair. Tasks count in arrays; as many rows as there are pairs reach the driver at most."""
    size = len(pairs.codes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("links").flatten().to_numpy(), minlength=size)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], names=["pair", "n"])

    rows = links.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out


def id_pairs(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a_id, b_id, n: how often tokens of these ids end together in the corpus; best: no A id has more links with the B id."""
    links, pairs = aligned(docs, a_path, b_path)
    n = pair_counts(links, pairs)
    at = np.flatnonzero(n)
    rows = pa.table({"a_id": pairs.codes[at] // pairs.width, "b_id": pairs.codes[at] % pairs.width, "n": n[at], "best": _best(n, pairs)[at]})
    return docs.sparkSession.createDataFrame(rows)


def _best(n: np.ndarray, pairs: Pairs) -> np.ndarray:
    most = np.zeros(pairs.width, np.int64)
    np.maximum.at(most, pairs.b, n)
    return n == most[pairs.b]


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, group, start, end, a_ids, b_ids: the groups themselves, with places in bytes of a space and the text."""
    a_path, b_path = a_path or paths()[0], b_path or paths()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path, np.zeros(0, np.int64))
        schema = pa.schema([("doc_id", pa.int64()), ("group", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("a_ids", pa.list_(pa.int64())), ("b_ids", pa.list_(pa.int64()))])
        for batch in pieces(batches, TOGETHER):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if rows := [(doc, k, *g) for k, g in enumerate(align.aligned(text or ""))]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, group long, start long, end long, a_ids array<long>, b_ids array<long>")


def scored(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document with the counts of the contract."""
    links, pairs = aligned(docs, a_path, b_path)
    n = pair_counts(links, pairs)
    held = docs.sparkSession.sparkContext.broadcast((n, _best(n, pairs)))  # bounded by the vocabularies
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = held.value
        for batch in batches:
            column = batch.column("links")
            sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            total = np.zeros(len(sizes), np.int64)
            np.add.at(total, row, counts[flat])
            n_best = np.bincount(row[best[flat]], minlength=len(sizes)).astype(np.int64)
            own = {"n_links": pa.array(sizes.astype(np.int64)), "n_best": pa.array(n_best), "count_sum": pa.array(total)}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in columns], names=columns)

    bound_batches(docs.sparkSession)
    return links.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
