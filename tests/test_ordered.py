"""Running values over ranges, and what is built on them, against plain forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fuzzloom.functions import stats
from fuzzloom.operators.ordered import before


@pytest.mark.parametrize("how", ["sum", "max"])
def test_before(spark, how):
    r = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 4}", i * 7 % 1000, r.randint(-9, 9)) for i in range(900)] + [(None, 1, 5), (None, 2, 6)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(6)
    got = {(x["g"], x["o"]): x["before"] for x in before(df, ["g"], [F.asc("o")], F.col("v"), getattr(F, how)).collect()}
    for g, o, _ in rows:
        less = [v for h, p, v in rows if h == g and p < o]
        assert got[(g, o)] == ((sum(less) if how == "sum" else max(less)) if less else None)
    alone = {x["o"]: x["before"] for x in before(df.filter("g = 'hot'"), [], [F.desc("o")], F.col("v"), getattr(F, how)).collect()}
    top = max(alone)
    assert alone[top] is None and sum(v is None for v in alone.values()) == 1


@pytest.mark.parametrize("down", [False, True])
def test_average_ranks(spark, down):
    r = random.Random(2)
    rows = [(i, "hot" if i % 4 else "few", r.choice([None, float("nan"), *map(float, range(12))])) for i in range(400)]
    got = {x["i"]: x["rank_avg"] for x in stats.average_ranks(spark.createDataFrame(rows, "i int, g string, v double"), ["g"], "v", down).collect()}
    key = lambda v: (0, 0) if v is None else (2, 0) if math.isnan(v) else (1, v)
    for i, g, v in rows:
        own = [key(w) for _, h, w in rows if h == g]
        less, same = sum(k > key(v) if down else k < key(v) for k in own), own.count(key(v))
        assert got[i] == less + (same + 1) / 2


def test_holm(spark):
    r = random.Random(3)
    ps = [round(r.random() ** 3, 2) for _ in range(120)] + [0.0, 0.0, 1.0]
    rows = [(i, p) for i, p in enumerate(ps)] + [(900, None), (901, float("nan"))]
    got = {x["i"]: (x["p_adj"], x["reject"]) for x in stats.holm(spark.createDataFrame(rows, "i int, p double")).collect()}
    top, want = 0.0, {}
    for k, (p, i) in enumerate(sorted((p, i) for i, p in enumerate(ps))):
        top = max(top, min(1.0, p * (len(ps) - k)))
        want.setdefault(p, top)
        assert math.isclose(got[i][0], want[p]) and got[i][1] == (want[p] <= 0.05)
    assert got[900] == got[901] == (None, False)


def test_front_and_knee(spark):
    r = random.Random(4)
    rows = [(float(c), round(6 * c**0.5 + r.random() * 2, 1)) for c in (r.randint(0, 40) for _ in range(300))]
    front = sorted({(c, b) for c, b in rows if not any(x <= c and y >= b and (x < c or y > b) for x, y in rows)})
    df = spark.createDataFrame(rows, "cost double, benefit double")
    assert sorted({(x["cost"], x["benefit"]) for x in stats.pareto_front(df).collect()}) == front
    (x0, y0), (x1, y1) = front[0], front[-1]
    scaled = [((x - x0) / (x1 - x0), (y - min(b for _, b in front)) / (max(b for _, b in front) - min(b for _, b in front)), x) for x, y in front]
    slope = scaled[-1][1] - scaled[0][1]
    want = max(scaled, key=lambda t: (round(abs(slope * t[0] - t[1] + scaled[0][1]) / math.hypot(1, slope), 12), -t[2]))
    assert stats.knee_on_front(df).first()["cost"] == want[2]
    assert stats.pareto_front(df.limit(0)).isEmpty() and stats.knee(df.limit(0), "cost", "benefit").isEmpty()


def test_bootstrap(spark):
    r = np.random.default_rng(5)
    v = r.gamma(2.0, 3.0, 250)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(5)
    low, high = stats.bootstrap_ci(df, rounds=4000, seed=3).first()
    means = v[r.integers(0, len(v), (4000, len(v)))].mean(axis=1)
    assert abs(low - np.percentile(means, 2.5)) < 0.08 and abs(high - np.percentile(means, 97.5)) < 0.08
    staged = stats.bootstrap_ci(df, rounds=50, seed=3)
    assert staged.columns == ["low", "high"] and stats.bootstrap_ci(df.limit(0), rounds=5).first()["low"] is None


def test_power_law_goes_on(spark):
    df = spark.createDataFrame([(float(n), 3.0 * n**1.5) for n in (1, 2, 5, 10)] + [(0.0, 1.0)], "n double, s double")
    got = {x["n"]: x["s"] for x in stats.extrapolated(df, [100.0, 1000.0]).collect()}
    assert math.isclose(got[100.0], 3000.0) and math.isclose(got[1000.0], 3 * 1000**1.5)


def test_quantiles_by_pieces(spark):
    """Values of a few pieces are put in order, to the same quantiles as of all values at once."""
    from fuzzloom.operators.ordered import fitted

    r = random.Random(11)
    rows = [(None if i % 9 == 0 else r.gauss(0, 1), float(r.randint(0, 3)), None) for i in range(500)] + [(float("inf"), 7.0, None), (-0.0, -1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double").cache()
    at = [0.0, 0.01, 1 / 3, 0.5, 2 / 3, 0.977, 1.0]
    assert fitted(df, ["a", "b", "c"], at, few=0, pieces=7) == fitted(df, ["a", "b", "c"], at)
    assert fitted(df, ["a", "c"], at, few=0, pieces=1)["c"] is None
