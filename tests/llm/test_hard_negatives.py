"""Hard negatives against plain Python: bounds, ties, equal rows, blocks, odd vectors."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quotelens.llm import hard_negatives as hn
from quotelens.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, _row string, rank int"


def brute(rows):
    good = [(i, v, y) for i, v, y, *_ in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (key, vector, label) in enumerate(good):
        if key is None or key % 10:
            continue
        scored = [(int(sum(int(x) * int(y) for x, y in zip(vector, v, strict=False))), i, y) for b, (i, v, y) in enumerate(good) if b != a]
        for p, i, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            fits = sorted((s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p), key=order)[:5]
            out += [(key, i, k, n, p, s) for k, (s, n, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect()), key=str)


def some_rows(n, seed, width=40, spread=3):
    rng = random.Random(seed)
    centres = [[rng.randint(-40, 40) for _ in range(width)] for _ in range(5)]
    return [(rng.randint(0, 3 * n), [float(c + rng.randint(-spread, spread)) for c in rng.choice(centres)], rng.randint(0, 3)) for _ in range(n)]


@pytest.mark.parametrize("spread", [0, 3, 200])
def test_equal_to_all_scores(spark, spread):
    rows = some_rows(300, spread, spread=spread) + [(10, [1.0] * 40, 2), (10, [1.0] * 40, 2), (20, [-1.0] * 40, 1)]
    assert got(spark, rows) == brute(rows)


def test_blocks_of_anchors_give_the_same(spark):
    rows = some_rows(400, 7)
    assert got(spark, rows, block_numbers=16 * 40) == brute(rows)


def test_one_vector_in_a_third_of_the_rows(spark):
    rows = some_rows(200, 5) + [(1000 + k, [3.0] * 40, k % 2) for k in range(120)]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0, 5.0], 2), (None, [1.0, 2.0], 2), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 2),
        (6, [float("inf"), 1.0], 2), (7, [1.0, 2.0], None), (8, [], 2), (10, [], 1), (20, [0.0, 0.0], 3), (9, [1.0, 2.0], 2),
    ]
    assert got(spark, rows) == brute(rows) != []
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0], 1)]) == []


def test_large_numbers_are_exact(spark):
    rows = [(0, [2.0**30, 1.0, 3.0], 1), (1, [2.0**30, 1.0, 4.0], 1), (2, [2.0**30, 0.0, 5.0], 2), (3, [2.0**30, 1.0, 3.0], 2), (4, [2.0**30, 1.0, 5.0], 3)]
    assert got(spark, rows) == brute(rows) != []
    # beyond 64 bits scores are held at the limit, and tie
    huge = [(0, [2.0**40], 1), (1, [2.0**40], 1), (3, [2.0**41], 2), (2, [2.0**42], 2)]
    assert got(spark, huge) == [(0, 1, 1, 2, hn.LARGEST, hn.LARGEST), (0, 1, 2, 3, hn.LARGEST, hn.LARGEST)]


def test_bounds_hold_and_drop_pairs():
    rng = np.random.default_rng(3)
    code = np.round(rng.normal(0, 3, (200, 37)) + rng.choice([-90, 0, 90], (200, 1)))
    as_lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    means, devs = hn.summaries(code)
    v = hn.Vectors.of(as_lists(code), as_lists(means), as_lists(devs), 37)
    scores = code @ code.T
    for level, length in enumerate(hn.SEGMENTS):
        middle, off = v.mean[level] @ v.mean[level].T * length, v.dev[level] @ v.dev[level].T + 1e-3
        assert (scores <= middle + off).all() and (scores >= middle - off).all()
    low, high = np.full(200, 200_000.0), np.full(200, 320_000.0)
    found = {(a, int(r)): int(s) for a, rows, ss in hn.candidates(v, v, np.ones((200, 200), dtype=bool), low, high) for r, s in zip(rows, ss)}
    inside = {(int(a), int(b)) for a, b in np.argwhere((scores >= 200_000) & (scores <= 320_000))}
    assert inside <= found.keys() and all(found[p] == scores[p] for p in found)
    assert len(found) < 20_000  # most of the 40,000 pairs go unscored
    best = list(hn.candidates(v, v, ~np.eye(200, dtype=bool), np.full(200, -np.inf), np.full(200, np.inf), 5))
    top = np.sort(np.where(np.eye(200, dtype=bool), -np.inf, scores), axis=1)[:, -5:]
    assert all(sorted(s)[-5:] == top[a].tolist() for a, _, s in best) and sum(len(s) for _, _, s in best) < 20_000
