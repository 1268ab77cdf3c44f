"""The stages of the pipeline by their own rules, where these differ from those of the queries."""

from __future__ import annotations

import random
import re
from itertools import combinations

import corpus_pipeline
from brute import lower


def five_words(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def kept(rows):
    """Ids that stay: the smallest of each group linked by 5-word Jaccard of 0.8 or more."""
    sets = {i: five_words(t) for i, t in rows}
    group = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    return sorted(set(group.values()))


def test_near_copies_of_the_stage(spark, sf_dir):
    """Edits that leave 0.8 of the 5-word shingles but less than 0.9 of the 3-word ones, and up to the bound from both sides."""
    rng, rows = random.Random(8), []
    for k, n in enumerate((3, 5, 9, 20, 45, 94, 150, 400)):
        base = [f"t{k}x{i}" for i in range(n)]
        rows.append((100 * k, " ".join(base)))
        for j in range(1, 13):  # j words changed, in one run or anywhere
            run, any_ = list(base), list(base)
            at = rng.randrange(max(1, n - j))
            run[at : at + j] = [f"run{k}y{j}z{i}" for i in range(len(run[at : at + j]))]
            for i in rng.sample(range(n), min(n, j)):
                any_[i] = f"any{k}y{j}z{i}"
            rows += [(100 * k + 2 * j, " ".join(run)), (100 * k + 2 * j + 1, " ".join(any_))]
        rows.append((100 * k + 50, " ".join(base[: -max(1, n // 6)])))
    # the first 80 of 100 shingles, and one less
    rows += [(900, " ".join(f"u{i}" for i in range(104))), (901, " ".join(f"u{i}" for i in range(84))), (902, " ".join(f"v{i}" for i in range(104))), (903, " ".join(f"v{i}" for i in range(83)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r[0] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).select("doc_id").collect())
    assert got == kept(rows)
    assert 901 not in got and 903 in got
