"""Operator 11 against whole texts encoded at once and compared byte by byte."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigris.llm import alignment as al


class Plain:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = al.paths()
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.a_bytes, self.b_bytes = al.bytes_of_a(a), al.bytes_of_b(b)

    def __call__(self, text: str | None) -> tuple[int, int, int, str, list[tuple[int, int]]]:
        whole = f" {text}".encode()
        a, b = (self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)) if text else ([], [])
        if not a or b"".join(self.a_bytes[i] for i in a) != whole or b"".join(self.b_bytes[i] or b"" for i in b) != whole:
            return 0, 0, 0, "", []
        ends: list[list[int]] = []
        for ids, names in ((a, self.a_bytes), (b, self.b_bytes)):
            at = 0
            ends.append([at := at + len(names[i]) for i in ids])
        both, groups, x, y = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for cut in both:
            u, v = [], []
            while x < len(a) and ends[0][x] <= cut:
                u.append(str(a[x]))
                x += 1
            while y < len(b) and ends[1][y] <= cut:
                v.append(str(b[y]))
                y += 1
            groups.append(f"{','.join(u)}|{','.join(v)}")
        at_end: dict[int, list[int]] = {}
        for i, e in zip(b, ends[1]):
            at_end.setdefault(e, []).append(i)
        return len(a), len(b), len(groups), ";".join(groups), [(i, j) for i, e in zip(a, ends[0]) for j in at_end.get(e, ())]


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def odd_texts() -> list[str | None]:
    rng = random.Random(9)
    parts = [*"ab .,'\n\t  éß日本語🙂𓀀́   \x1c\x85\x00<|s>0123", "<|endoftext|>", "<s>", " the ", " don't", " ", "word", "▁"]
    out: list[str | None] = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    return out + [None, "", " ", "  ", " x", "x ", "a▁b", "▁", "ﬁ é", " " * 5000, "x" + "\n" * 3000, "é" * 4000, "日" * 4000, "🙂𓀀" * 500, "word " * 20_000, "the the", "the the"]


def test_against_whole_texts(spark, texts, odd_texts, plain):
    given = [t for _, t in texts] + odd_texts
    docs = spark.createDataFrame([(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(given)], "doc_id long, text string, links string, n_a int").repartition(3)
    want = [plain(t) for t in given]
    counts = Counter(x for w in want for x in w[4])
    best: dict[int, int] = {}
    for (_, j), n in counts.items():
        best[j] = max(n, best.get(j, 0))
    got = {r.doc_id: tuple(r)[1:] for r in al.scored(docs).collect()}
    assert len(got) == len(given)
    for i, w in enumerate(want):
        digest = hashlib.sha256(w[3].encode()).hexdigest() if w[3] else ""
        assert got[i if i != 3 else None] == (*w[:3], len(w[4]), sum(counts[x] == best[x[1]] for x in w[4]), sum(counts[x] for x in w[4]), digest), given[i]
    assert {(r.a_id, r.b_id): r.n for r in al.id_pairs(docs).collect()} == counts


def test_groups_cover_the_text(spark, odd_texts, plain):
    docs = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")
    rows = al.groups(docs).orderBy("doc_id", "group").collect()
    for i, t in enumerate(odd_texts):
        own = [r for r in rows if r.doc_id == i]
        assert ";".join(f"{','.join(map(str, r.a_ids))}|{','.join(map(str, r.b_ids))}" for r in own) == plain(t)[3]
        for r in own:
            piece = f" {t}".encode()[r.start : r.end]
            assert b"".join(plain.a_bytes[k] for k in r.a_ids) == piece == b"".join(plain.b_bytes[k] for k in r.b_ids)


def test_answers_stay_right_when_they_are_too_many(plain, texts, monkeypatch):
    monkeypatch.setattr(al, "KEPT", 50)
    monkeypatch.setattr(al, "KEPT_CHARS", 6)
    a, b = al.paths()
    pairs = al.Pairs(al.bytes_of_a(a), al.bytes_of_b(b))
    align = al.Aligner(a, b, pairs.codes)
    for _, t in texts:
        n_a, n_b, n, groups, links = align.run([t])[0]
        w = plain(t)
        assert (n_a, n_b, n, groups) == w[:4] and sorted(pairs.codes[links].tolist()) == sorted(i * pairs.width + j for i, j in w[4])
        assert len(align.place) <= 50 + len(set((t or "").split(" ")))


def test_new_texts_are_encoded_in_bounded_strings_and_much_used_ones_stay(plain, monkeypatch):
    monkeypatch.setattr(al, "KEPT", 50)
    monkeypatch.setattr(al, "JOINED", 20, raising=False)
    a, b = al.paths()
    pairs = al.Pairs(al.bytes_of_a(a), al.bytes_of_b(b))
    align, asked = al.Aligner(a, b, pairs.codes), []
    real = align.tokens
    monkeypatch.setattr(align, "tokens", lambda text: asked.append(text) or real(text))
    texts = ["common"] * 40 + [" ".join(f"{k}w{i}" for i in range(45)) + " common"[: 7 * (k < 1)] for k in range(4)] + ["common ▁ x▁ once"]
    for t in texts:
        w = plain(t)
        n_a, n_b, n, groups, links = align.run([t])[0]
        assert (n_a, n_b, n, groups) == w[:4] and sorted(pairs.codes[links].tolist()) == sorted(i * pairs.width + j for i, j in w[4])
    assert {t for t in asked if "common" in t.split(" ")} == {"common"} and "common" not in asked[3:]
    assert max(t.count(" ") for t in asked) < 20


def test_empty_table(spark, no_docs):
    assert al.scored(no_docs).count() == 0 and al.id_pairs(no_docs).count() == 0 and al.groups(no_docs).withColumn("x", F.lit(1)).count() == 0
