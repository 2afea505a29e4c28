"""Hard negatives against a plain search: nulls, non-finite components, ties, repeated rows, short vectors, one label of most rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, k, m, percent):
    ok = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        ok[i] = min(ok.get(i, key), key)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (label, x) in ok.items():
        if i % every:
            continue
        scored = sorted((-dot(x, y), j, other == label) for j, (other, y) in ok.items() if j != i)
        for p, j, _ in [s for s in scored if s[2]][:k]:
            fit = [s for s in scored if not s[2] and percent[0] * -p <= 100 * -s[0] <= percent[1] * -p][:m]
            out += [(i, j, rank, n, -p, -q) for rank, (q, n, _) in enumerate(fit, 1)]
    return sorted(out)


def table(seed, n, d, coarse=False):
    draw = random.Random(seed)
    one = lambda: draw.choice([-1.0, 0.0, 0.25, 0.5]) if coarse else draw.gauss(0.05, 0.2)
    rows = [(i, [one() for _ in range(d)], 1 if draw.random() < 0.4 else draw.randrange(5)) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [one()] * d, None), (None, [one()] * d, 1), (n + 3, [math.nan] * d, 1), (n + 4, [math.inf] + [0.0] * (d - 1), 1), (n + 5, [None] + [0.1] * (d - 1), 1)]
    rows += [(n + 6, [], 1), (n + 7, [0.5], 2), (n + 8, [0.1] * d, 99), rows[0], rows[7], (7, [one() for _ in range(d)], 3)]
    return rows


@pytest.mark.parametrize(("n", "d", "coarse", "k", "m", "percent"), [(300, 8, False, 5, 5, (80, 100)), (260, 4, True, 5, 5, (80, 100)), (200, 6, False, 3, 2, (-50, 33)), (120, 1, True, 2, 7, (0, 120))])
def test_like_plain_search(spark, monkeypatch, n, d, coarse, k, m, percent):
    monkeypatch.setattr(negatives, "TILE_ROWS", 32)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 3)
    monkeypatch.setattr(negatives, "LEAST_ROWS", 64)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 10)
    monkeypatch.setattr(negatives, "FIRST_LOOK", 4)
    rows = table(n + d, n, d, coarse)
    frame = spark.createDataFrame(rows, SCHEMA).select("vec_id", "embedding", "label", F.lit(1).alias("x"), F.lit(1).alias("anchor"), F.lit(2).alias("id"), F.lit(0).alias("group"))
    got = negatives.hard_negatives(frame, F.col("vec_id") % 7 == 0, positives=k, negatives=m, percent=percent)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 7, k, m, percent)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], SCHEMA)
    assert negatives.hard_negatives(few, F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(few, F.col("vec_id") == 1).count() == 0


def test_products_that_leave_a_long_are_refused(spark):
    with pytest.raises(ValueError, match="do not fit"):
        negatives.hard_negatives(spark.createDataFrame([(0, [3e9], 1), (1, [1.0], 1)], SCHEMA), F.col("vec_id") == 0)


@pytest.mark.parametrize("kind", ["float32", "float64", "int64"])
@pytest.mark.parametrize("same", [True, False])
def test_tile_keeps_what_can_qualify(kind, same):
    """Pairs that a tile gives up are none of the first k of any window; those it keeps have exact scores."""
    draw = np.random.default_rng(3)
    x, q = draw.integers(-90, 90, (400, 16)), draw.integers(-90, 90, (9, 16))
    size = negatives.Sizes(400, 16, 8, kind)
    exact = q @ x.T
    allowed = draw.random(exact.shape) < (0.3 if same else 0.9)
    floors, ceilings = np.full((9, 2), -(1 << 62)), np.full((9, 2), 1 << 62)
    ceilings[:, 1], floors[:, 1] = np.median(exact, axis=1), -5000
    ceilings[4, 0] = -(1 << 62)
    a, r, score = negatives.Tile(q, floors, ceilings, 5, size).pairs(x, allowed)
    assert (score == exact[a, r]).all() and len(a) < allowed.sum()
    kept = set(zip(a.tolist(), r.tolist()))
    for i in range(9):
        for j in range(2):
            fit = [(-s, k) for k, s in enumerate(exact[i]) if allowed[i, k] and floors[i, j] <= s <= ceilings[i, j]]
            assert all((i, k) in kept for _, k in sorted(fit)[:5])
