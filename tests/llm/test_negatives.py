"""Operator 13 against all scores of all rows."""

from __future__ import annotations

import numpy as np
import pytest

from verdigris.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def plain(rows) -> list[tuple]:
    """Rows: (id, vector, label). All anchors that differ, each against all rows."""
    kept = [(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v), y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) and abs(x) < N.LARGEST for x in v)]
    out = []
    for i, q, y in dict.fromkeys(kept):
        if i % N.EVERY:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(q, p)), j, z) for j, p, z in kept if j != i and len(p) == len(q)))
        for s, j, _ in [x for x in scores if x[2] == y][: N.K_POSITIVE]:
            window = [(-t, k) for t, k, z in scores if z != y and 50 * -s <= 100 * -t <= 95 * -s][: N.K_NEGATIVE]
            out += [(i, j, r, k, -s, t) for r, (t, k) in enumerate(window, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12))
    out = [(i, (centres[i % 6] + rng.standard_normal(12) * rng.choice([0.1, 1.0])).tolist(), int(rng.integers(0, 4))) for i in range(900)]
    same = centres[0].tolist()
    out += [(i, same, i % 2) for i in range(900, 1300)]  # a hot vector
    out += [(i, [0.0] * 12, 1) for i in range(1300, 1320)] + [(i, [float(i), -2.0, 0.5], i % 3) for i in range(1320, 1420)] + [(i, [], 1 + i % 2) for i in range(1420, 1460)]
    out += [(1500, None, 1), (1550, [None] * 12, 1), (1600, [float("nan")] * 12, 2), (1650, [float("inf")] + [1.0] * 11, 2), (1700, [1.0] * 12, None), (None, [1.0] * 12, 1), (1750, [3e5] * 12, 1)]
    out += [(50, out[50][1], out[50][2]), (100, out[3][1], 2), (7, out[7][1], out[7][2])]  # repeated rows and ids
    return out


@pytest.mark.parametrize("part_rows", [64, 8192])
def test_against_all_scores(spark, rows, part_rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in N.mined(df, part_rows=part_rows).collect())
    assert got == plain(rows)


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(1)
    x = np.floor(rng.standard_normal((500, 8)) * 256)
    ways = N.directions(x[:100], 16)
    n = np.linalg.norm(x, axis=1)
    a = N.angles_to(ways, x, n)
    low, high = N.row_bounds(a, n, a[:50], n[:50])
    score = x[:50] @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert (high < 0.5 * n[:50, None] * n).mean() > 0.2
    low, high = N.bounds(a[:30].min(0)[None], a[:30].max(0)[None], n[:30].min(keepdims=True), n[:30].max(keepdims=True), a[:50], n[:50])
    assert (low <= score[:, :30]).all() and (score[:, :30] <= high).all()


def test_large_components_are_exact(spark):
    rows = [(i, [float(200_000 - i * 3), float(i * 17 % 1000), -1.5], i % 2) for i in range(0, 260)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in N.mined(df).collect()) == plain(rows)


def test_few_rows_and_none(spark):
    assert N.mined(spark.createDataFrame([], SCHEMA)).count() == 0
    two = [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [0.9, 0.9], 2)]
    got = [tuple(r) for r in N.mined(spark.createDataFrame([(*r, "") for r in two], SCHEMA)).collect()]
    assert got == plain(two) and len(got) == 1
