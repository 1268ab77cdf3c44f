"""Operator 12 against a plain version: words compared one by one, every rule tried on every text, all pairs of detections."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from verdigris.llm import licenses

LINES = [
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files; sublicense; MERCHANTABILITY",
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version: redistribute",
    "BSD 3-Clause License or the two clause BSD",
    "https://creativecommons.org/licenses/by-sa/3.0 and https://www.apache.org/licenses/LICENSE-2.0.html",
    "All rights reserved. Mozilla Public License v2.0; MPL 1.1; the Unlicense",
]


def words(text: str | None) -> list[str]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text: str | None) -> tuple:
    w = words(text)
    base = [(i, i + len(p.split()), label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    norm = f" {' '.join(w)} "
    spans = []
    for r in licenses.rules():
        for m in re.finditer(r["pattern"], norm):
            spans.append((norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" "), r["level"], r["rule"], r["label"]))
    kept = []
    for s in spans:
        inside = (o for o in spans if o != s and o[0] <= s[0] and s[1] <= o[1] and o[2] <= s[2])
        if not any((o[0], o[1]) != (s[0], s[1]) or (o[2], o[3]) < (s[2], s[3]) for o in inside):
            kept.append(s)
    best = max([licenses.CONFIDENCE[s[2] - 1] for s in kept] + [licenses.BASE_CONFIDENCE] * bool(base) + [0.0])
    starts = [b[0] for b in base]
    listed = lambda x: ",".join(sorted(set(x)))
    return len(w), len(base), min(starts, default=None), max(starts, default=None), listed(b[2] for b in base), listed([b[2] for b in base] + [s[4] for s in kept]), best, len(kept)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    filler = ["mit", "der", "license", "apache", "gnu", "cc", "by", "and", "the", "version", "2", "0", "bsd", "clause", "été", "日本", "general", "public", "gpl", "3"]
    out: list[str | None] = [None, "", " \x00 ", "CC by", "cc BY cc by", "MIT license mit licence", *LINES, "; ".join(LINES), "apache license " * 3000, "cc by nc 4 0 " * 500]
    for _ in range(150):
        parts = [rng.choice(LINES) if rng.random() < 0.1 else rng.choice(filler) for _ in range(rng.randint(1, 60))]
        out.append(rng.choice([" ", "-", ", ", "\n"]).join(parts))
    return out


def test_against_a_plain_version(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, words string").drop("words").withColumn("labels", F.lit("clash")).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in licenses.scanned(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if len(t or "") < 20_000:
            assert got[i] == plain(t), t


def test_lines_have_their_labels(spark):
    want = ["apache,apache-2.0", "gpl,gpl-3.0", "mit", "cc-by,cc-by-nc-4.0", "gpl-2.0", "mit", "lgpl-2.1-or-later", "bsd-2-clause,bsd-3-clause", "apache-2.0,cc-by-sa-3.0", "all-rights-reserved,mpl-1.1,mpl-2.0,unlicense"]
    docs = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")
    assert [r["labels"] for r in licenses.scanned(docs).orderBy("doc_id").collect()] == want


def test_prose_has_none(spark):
    docs = spark.createDataFrame([(1, "Mit der Lizenz zum Töten. The public general went by the apache cc. He was released by the version 2."), (1, None)], "doc_id long, text string")
    assert [tuple(r)[1:] for r in licenses.scanned(docs).orderBy("n_words").collect()] == [(0, 0, None, None, "", "", 0.0, 0), (20, 0, None, None, "", "", 0.0, 0)]


def test_very_long_and_repetitive(spark):
    docs = spark.createDataFrame([(1, "apache license version 2 0 " * 40_000)], "doc_id long, text string")
    r = licenses.scanned(docs).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels, r.n_detections) == (200_000, 40_000, 0, 199_995, "apache,apache-2.0", 40_000)


def test_empty_table_and_native_plan(spark, docs):
    assert licenses.scanned(docs.filter("doc_id < 0")).count() == 0
    plan = licenses.scanned(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
    assert licenses.detected(docs).columns[-3:] == ["base", "words", "detections"]
