"""Hard negatives against all pairs by brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from fuzzloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, q string, slot int"


def brute(rows):
    held = []
    for k, (i, v, label, *_) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        held.append((k, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, q))
    out = []
    for k, i, label, q in held:
        if i is None or i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, x[3])), x[1] is None, x[1] or 0, x[2] == label) for x in held if x[0] != k]
        scored.sort()
        for p in [x for x in scored if x[3]][:5]:
            ok = [x for x in scored if not x[3] and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0]][:10]
            out += [(i, None if p[1] else p[2], r + 1, None if x[1] else x[2], -p[0], -x[0]) for r, x in enumerate(ok)]
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    vector = lambda: [r.gauss(0.1, 0.3) for _ in range(12)]
    out = [(i, vector(), r.randint(0, 3)) for i in range(420)]
    same = vector()
    out += [(i, same, i % 2) for i in range(500, 720)]  # ties of a hot vector
    out += [(100, same, 1), (100, same, 1), (100, out[100][1], out[100][2])] + [(None, vector(), 1) for _ in range(5)]
    out += [(900, [], 1), (901, [0.5], 1), (1000, None, 1), (1001, vector(), None), (1100, [float("nan")] * 12, 1), (1200, [float("inf")] + vector()[1:], 2), (1300, [None] + vector()[1:], 2), (1400, [-x for x in same], 1)]
    return [(*x, 7, "q", 3) for x in out]


@pytest.mark.parametrize(("held", "tile", "anchors", "lead"), [(65_536, 4_096, 256, (16, 32)), (100, 32, 3, (2, 5))])
def test_negatives(spark, rows, monkeypatch, held, tile, anchors, lead):
    for name, value in (("HELD", held), ("TILE", tile), ("ANCHORS", anchors), ("LEAD", lead)):
        monkeypatch.setattr(hard_negatives, name, value)
    got = hard_negatives.mine_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_no_vectors(spark):
    got = hard_negatives.mine_embeddings(spark.createDataFrame([], SCHEMA))
    assert got.isEmpty() and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    few = spark.createDataFrame([(100, [1.0, 0.5], 1, 1, "q", 1), (3, [0.9, 0.5], 2, 1, "q", 1)], SCHEMA)
    assert hard_negatives.mine_embeddings(few).isEmpty()


def test_scores_that_do_not_fit(spark):
    df = spark.createDataFrame([(100, [2.0**40], 1, 1, "q", 1), (3, [2.0**40], 1, 1, "q", 1)], SCHEMA)
    with pytest.raises(Exception, match="scores of 2"):
        hard_negatives.mine_embeddings(df).collect()


def test_bounds_hold_and_discard(spark):
    """Partial products with their gaps enclose all scores, and few pairs are verified."""
    r = np.random.default_rng(1)
    q = np.floor(256 * (r.normal(size=(3000, 64)) * np.geomspace(1, 0.02, 64)) @ np.linalg.qr(r.normal(size=(64, 64)))[0])
    base = spark.createDataFrame([(i, i, 0, x.astype(int).tolist()) for i, x in enumerate(q)], "row long, vec_id long, label long, q array<long>")
    turn = hard_negatives.rotation(base, 64)
    assert np.abs(turn.T @ turn - np.eye(64)).max() < 1e-12
    a = hard_negatives.Rotated(q, turn, [16, 32])
    exact = q @ q.T
    for k, lead in enumerate([16, 32]):
        part = a.y[:, :lead] @ a.y[:, :lead].T
        gap = np.outer(a.rest[k], a.rest[k]) + 72 * hard_negatives.ROUNDING * np.outer(a.norm, a.norm) + 1e-6
        assert (np.abs(exact - part) <= gap).all()
    seen = []
    plain = hard_negatives.exact_scores
    hard_negatives.exact_scores = lambda *x: (seen.append(len(x[2])), plain(*x))[1]
    try:
        need, high = np.full((100, 1), np.iinfo(np.int64).min), np.full((100, 1), np.iinfo(np.int64).max)
        row, label = np.arange(3000), np.zeros(3000, int)
        b, few = hard_negatives.Rotated(q, turn, [16, 32]), hard_negatives.Rotated(q[:100], turn, [16, 32])
        found = hard_negatives.best_of(few, row[:100], label[:100], need, high, b, row, label, [16, 32], True, 5)
        need[:, 0] = [found[0][1][found[0][0] == i].min() for i in range(100)]
        seen.clear()
        again = hard_negatives.best_of(few, row[:100], label[:100], need, high, b, row, label, [16, 32], True, 5)
    finally:
        hard_negatives.exact_scores = plain
    assert sorted(zip(*map(np.ndarray.tolist, found[0]), strict=True)) == sorted(zip(*map(np.ndarray.tolist, again[0]), strict=True))
    assert sum(seen) < 0.1 * 100 * 3000
