"""Disclosure scores against plain counting, secrets, and the odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from brute import personal
from pyspark.sql import functions as F

from verdigris.llm import pii


def entities(t):
    out = set()
    for s in personal(t):
        k, a, b = s.split(":")
        v = t[int(a) : int(b)].lower()
        if k in ("card", "phone"):
            v = re.sub("[^0-9]", "", v)
        n = pii.KINDS.index(k)
        out |= {f"{n}:{v}", f"{n}"}
        if k == "email":
            out.add("domain:" + v.split("@")[1])
            if m := re.match("[^@]*?([a-z]{2,})", v):
                out.add("name:" + m[1])
        out |= {"ip": {"network:" + v.rpartition(".")[0]}, "card": {"issuer:" + v[:6]}, "phone": {"area:" + v[:5]}}.get(k, set())
    return out


def terms(t):
    for s in sorted(personal(t), key=lambda s: -int(s.split(":")[1])):
        _, a, b = s.split(":")
        t = f"{t[: int(a)]} {t[int(b) :]}"
    words = re.findall(r"\w+", t.lower())
    return set(words) | {p for w in words for p in re.findall("[a-z]+", w)}


def by_hand(texts):
    """(entity, term): n_both, texts, n_entity, n_term, disclosure of what counts."""
    n = len(texts)
    n_entity, n_term, n_both, distinct = Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        e, w = entities(t), terms(t)
        n_entity.update(e)
        n_term.update(w)
        for x in e:
            for y in w:
                n_both[x, y] += 1
                distinct[x, y].add(t)
    out = {}
    for (x, y), b in n_both.items():
        info = math.log(n / n_entity[x])
        if len(distinct[x, y]) >= pii.SUPPORT and info > 0 and len(distinct[x, y]) * info >= math.log(n / pii.CHANCE):
            out[x, y] = (b, len(distinct[x, y]), n_entity[x], n_term[y], math.log(b * n / (n_term[y] * n_entity[x])) / info)
    return out


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    mails = [f"{rng.choice(['ann', 'bob', 'x'])}.{k}@{rng.choice(['corp', 'mail'])}.example" for k in range(4)] + ["10.1.2.3", "10.1.2.9", "+49 30 1234567", "4111 1111 1111 1111"]
    texts = []
    for k in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(1, 25))]
        if k % 4 == 0:
            for m in rng.sample(mails, rng.randint(1, 3)):
                w += [m, f"near{mails.index(m)}", f"b{mails.index(m)}x7"]
        texts.append(" ".join(w))
    return texts + texts[:40]


def test_scores_by_hand(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = docs.withColumn("base", pii.base_spans(F.col("text")))
    ents, words, scored = pii.scored_terms(pii.holders_of(found, 1), found, 1)
    members, of = defaultdict(list), defaultdict(list)
    for r in ents.collect():
        members[r["class"]].append(r["entity"])
    names = {r["h"]: r["t"] for r in found.select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("t")).union(found.select(F.explode(F.split(F.lower("text"), "[^a-z]+")))).select("t", F.xxhash64("t").alias("h")).distinct().collect()}
    for r in words.collect():
        of[r["class"]].append(names[r["h"]])
    got = {(e, t): (r["n_both"], r["texts"], r["n_entity"], r["n_term"], r["disclosure"]) for r in scored.collect() for e in members[r["entity"]] for t in of[r["h"]]}
    want = by_hand(texts)
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    # what is flagged is what changes
    flagged = defaultdict(set)
    for (e, t), v in want.items():
        if v[-1] >= pii.DISCLOSURE - 1e-12:
            flagged[e].add(t)
    assert flagged
    for r in pii.detected(docs).collect():
        mine = set().union(*(flagged[e] for e in entities(r["text"])), set()) & terms(r["text"])
        assert {s["start"] >= 0 and r["text"][s["start"] : s["end"]].lower() for s in r["terms"]} <= mine and bool(mine) == bool(r["terms"])


def test_secrets_and_odd_rows(spark):
    key = "0123456789abcdefABCDEF"
    rows = [(1, f'a token = "{key}" b'), (1, "no such thing"), (None, f"password: {key}"), (2, "token = short"), (3, None), (4, ""), (5, f"API_KEY={key}, " + "word " * 50_000 + "a@b.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"terms": F.lit("clash"), "same": F.lit(1), "base": F.lit(2)})
    out = sorted((str(r["doc_id"]), r["text"] and r["text"][-40:]) for r in pii.sanitised(docs).collect())
    assert out == sorted([("1", "a token[SECRET]\" b"), ("1", "no such thing"), ("None", "password[SECRET]"), ("2", "token = short"), ("3", None), ("4", ""), ("5", ("word " * 50)[-33:] + "[EMAIL]")], key=str)
    assert pii.sanitised(docs).columns == docs.columns
