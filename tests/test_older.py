"""Older forms, test families and profiles against plain computations."""

import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fuzzloom.functions import stats
from fuzzloom.operators import older
from fuzzloom.plans import profiles, protocols


def test_older_levels(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 5.0), (3, None), (4, float("nan"))], "i int, v double")
    got = {r["i"]: (r["w"], r["b"]) for r in df.select("i", older.by_wide_cuts(F.col("v"), [1.0, 2.0]).alias("w"), older.by_open_bins(F.col("v"), ((2.0, "S"), (5.0, "M"), (None, "X"))).alias("b")).collect()}
    assert got == {0: ("Low", "S"), 1: ("Medium", "M"), 2: ("High", "X"), 3: ("High", "X"), 4: ("High", "X")}


def test_older_statistics(spark):
    assert older.spread_quota([10, 30], [[1.0, 1.0], [0.0, 2.0]], 0.2) == [1, 8]
    ps = spark.createDataFrame([(0.025,), (0.05,), (0.9,)], "p double")
    assert older.holm_strict(ps.filter("p > 0.04"), alpha=0.1).filter("reject").count() == 0 and stats.holm(ps.filter("p > 0.04"), alpha=0.1).filter("reject").count() == 1
    assert older.paired_size(spark.createDataFrame([(1.0,), (1.0,)], "d double")).first()["dz"] == 0.0
    one = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, score double")
    assert older.auc_or_half(one).first()["auc"] == 0.5 and older.relative_auc(one, 0.8).first()["auc_rel"] == 0.625 and older.relative_auc(one, 0.0).first()["auc_rel"] == 1.0
    scored = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (1, None)], "y int, score double")
    assert older.first_best_threshold(scored, [0.9, 0.2, 0.3, 0.5]) == 0.2 and older.first_best_threshold(scored, []) is None and older.first_best_threshold(one, [0.1]) is None


def test_older_lookup(spark):
    r = random.Random(1)
    rules = [(i, r.choice("xyz"), r.choice("pq"), i % 2, round(r.random(), 2), round(r.random(), 2)) for i in range(30)]
    df = spark.createDataFrame(rules, "id long, a string, b string, y int, support double, confidence double")
    w = defaultdict(float)
    for _, a, b, y, s, c in rules:
        w[("a", a, y)] += s * c
        w[("b", b, y)] += s * c
    seen = {k[:2] for k in w}
    asked = {0: {"a-x": 0.7, "a-y": 0.3, "b-p": 1.0}, 1: {"a-z": 1.0, "b-none": 0.5}, 2: {"c-x": 1.0}, 3: {"a-x": 0.0}}
    want = {}
    for i, m in asked.items():
        c = defaultdict(lambda: [0.0, 0.0])
        for t, mu in m.items():
            n, v = t.rsplit("-", 1)
            if mu > 0 and (n, v) in seen:
                for y in (0, 1):
                    c[n][y] += mu * w[(n, v, y)]
        want[i] = [min(x[y] for x in c.values()) + max(x[y] for x in c.values()) for y in (0, 1)] if c else None
    got = {x["id"]: x for x in older.evidence_scores(spark.createDataFrame(list(asked.items()), "id long, membership map<string,double>"), df, ["a", "b"]).collect()}
    for i, d in want.items():
        if d is None:
            assert got[i]["d"] is None and got[i]["pred"] is None and got[i]["p"] == [0.5, 0.5]
        else:
            assert all(math.isclose(x, y) for x, y in zip(got[i]["d"], d)) and got[i]["pred"] == d.index(max(d))
            assert math.isclose(got[i]["p"][1], 1 / (1 + math.exp(d[0] - d[1])), abs_tol=1e-9)
    crisp = {x["id"]: x["d"] for x in older.evidence_scores(spark.createDataFrame([(0, "x", "p"), (1, "no", "no")], "id long, a string, b string"), df, ["a", "b"]).collect()}
    assert crisp[1] is None and math.isclose(crisp[0][0], w[("a", "x", 0)] + w[("b", "p", 0)])
    row = older.beats_majority(spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "y int, pred int")).first()
    assert tuple(row) == (0.75, 0.75, 0, False)


def test_families(spark):
    r = random.Random(2)
    raw = []
    for f in range(5):
        raw.append((f, "full", 1.0, None, None, 0.7 + 0.01 * f))
        for t in (0.1, 0.3):
            for m in ("greedy", "stratified", "clustered"):
                raw.append((f, m, t, None, 0.6 + r.random() / 4, 0.6 + r.random() / 5))
            for m in ("random", "strat_random"):
                raw += [(f, m, t, s, 0.5 + r.random() / 4, 0.55 + r.random() / 5) for s in range(4)]
    df = spark.createDataFrame(raw, "fold int, method string, theta double, seed int, rep double, auc double")
    got = {(x["metric"], x["baseline"], x["theta"], x["method"]): x for x in protocols.family_tests(df).collect()}
    assert len(got) == 5 * 2 * 3
    mean = lambda v: sum(v) / len(v)
    for (metric, base, t, m), x in got.items():
        k = 4 if metric == "rep" else 5
        own = [mean([y[k] for y in raw if y[0] == f and y[1] == m and y[2] == t]) for f in range(5)]
        others = [[y[k] for y in raw if y[0] == f and y[1] == base and y[2] == (1.0 if base == "full" else t)] for f in range(5)]
        d = [a - mean(b) for a, b in zip(own, others)]
        assert math.isclose(x["mean_gap"], mean(d), abs_tol=1e-12) and x["better"] == sum(v > 0 for v in d) and x["n"] == 5
        assert math.isclose(x["p"], stats.wilcoxon_greater(d)) and x["p_adj"] >= x["p"]
        assert (x["beaten"] is None) if base == "full" else math.isclose(x["beaten"], sum(a > v for a, b in zip(own, others) for v in b) / 20)
    top = protocols.method_summary(df, ("rep",)).filter("method = 'random' AND theta = 0.1").first()
    assert top["folds"] == 5 and math.isclose(top["mean"], mean([mean([y[4] for y in raw if y[0] == f and y[1] == "random" and y[2] == 0.1]) for f in range(5)]))


def test_profiles():
    s = profiles.quick(profiles.Study(alpha=0.1))
    assert (s.folds, s.pool, s.alpha, s.quick) == (3, 300, 0.1, True)
    text, print_ = profiles.snapshot(s, data="abc")
    assert json.loads(text)["settings"]["folds"] == 3 and json.loads(text)["run"]["data"] == "abc" and print_ == profiles.snapshot(s)[1] != profiles.snapshot(profiles.Study())[1]
    with pytest.raises(ValueError):
        s.changed(fold=2)
