"""Hand cases, naive differentials and properties of the rule engine."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fuzzloom.functions import stats
from fuzzloom.operators import graph, infer, matrices, metrics, prep, sampling, split

FS = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def base(spark):
    r = random.Random(1)
    rows = [(i, *(r.choice("LMH") for _ in FS), r.randint(0, 1)) for i in range(60)]
    return rows, spark.createDataFrame(rows, "id long, f0 string, f1 string, f2 string, f3 string, y int").cache()


def test_matrices_against_loops(base):
    rows, df = base
    cs = matrices.cells(df, FS)
    first = {r["cell"] for r in cs.collect()}
    a = {r["cell"]: r["n"] for r in matrices.agreement(cs, FS, 4).collect()}
    b = {(r["cell"], r["node"]): r["b"] for r in matrices.node_weights(cs, FS).collect()}
    for t in rows:
        if t[0] in first:
            assert a[t[0]] == sum(s[1:5] == t[1:5] for s in rows)
            m = [sum(s[1 + i] == t[1 + i] and s[5] == t[5] for s in rows) for i in range(4)]
            for node, c in enumerate(combinations(range(4), 3)):
                assert b[(t[0], node)] == a[t[0]] * min(m[i] for i in c)


@pytest.mark.parametrize("scope, want", [("global", 6), ("adjacent", 4), ("upper", 2)])
def test_one_rule_hand_case(spark, scope, want):
    df = spark.createDataFrame([(1, "a", "b", "c", 0), (2, "x", "y", "z", 1)], "id long, f0 string, f1 string, f2 string, y int")
    fs = ["f0", "f1", "f2"]
    table = matrices.pair_table(matrices.cells(df, fs), fs, scope)
    got = infer.pair_scores(df.filter("id = 1"), table, fs).first()
    assert got["d0"] == want and got["d1"] == 0


def test_unseen_levels(spark, base):
    _, df = base
    table = matrices.pair_table(matrices.cells(df, FS), FS)
    asked = spark.createDataFrame([(900, "?", "?", "?", "?", 1)], df.schema)
    row = infer.decided(infer.pair_scores(asked, table, FS)).first()
    assert row["d0"] is None and row["pred"] == 0 and row["score"] == 0


def test_greedy_hand_case(spark):
    df = spark.createDataFrame([(0, "L", "L", 0), (1, "L", "H", 0), (2, "H", "H", 1)], "id long, f0 string, f1 string, y int")
    cs = matrices.cells(df, FS[:2])
    got = sampling.greedy(cs, FS[:2], 2)
    assert [r["cell"] for r in got.collect()] == [0, 2]
    assert math.isclose(sampling.coverage_stats(sampling.coverage(cs, got, FS[:2]), 2).first()["rep"], 5 / 6)
    with pytest.raises(ValueError):
        sampling.greedy_by_label(cs, FS[:2], -1)


def test_greedy_bound_and_submodular(base):
    _, df = base
    cs = matrices.cells(df, FS).orderBy("cell").limit(10)
    cs = df.sparkSession.createDataFrame(cs.collect(), cs.schema)
    best = sampling.best_subset(cs, FS, 3).first()["covered"]
    got = sum(r["gain"] for r in sampling.greedy(cs, FS, 3).collect())
    assert (1 - 1 / math.e) * best <= got <= best
    gains = [r["gain"] for r in sampling.greedy_by_label(cs, FS, 9).filter("y = 1").orderBy("rank").collect()]
    assert gains == sorted(gains, reverse=True)


def test_allocation_is_exact():
    r = random.Random(7)
    for _ in range(300):
        sizes = [r.randint(0, 30) for _ in range(r.randint(1, 6))]
        theta = r.random()
        for method in ("proportional", "equal", "neyman"):
            q = split.allocate(sizes, theta, method, diversity=[r.random() for _ in sizes])
            assert sum(q) == split.budget(theta, sum(sizes)) and all(a <= b for a, b in zip(q, sizes))
    for bad in ((-0.1, 3), (1.1, 3), (0.5, -1)):
        with pytest.raises(ValueError):
            split.budget(*bad)
    with pytest.raises(ValueError):
        split.allocate([1], 0.5, "other")


def test_folds(base, spark):
    _, df = base
    got = split.stratified_folds(df, k=5).collect()
    for y in (0, 1):
        n = Counter(r["fold"] for r in got if r["y"] == y)
        assert max(n.values()) - min(n.values()) <= 1
    with pytest.raises(ValueError):
        split.stratified_folds(df.limit(0))
    grouped = split.group_folds(split.duplicate_groups(df, FS), "grp").collect()
    assert len({(r["grp"], r["fold"]) for r in grouped}) == len({r["grp"] for r in grouped})


def test_prep_rules(spark):
    spec = prep.DatasetSpec(("a", "c"), "y", ("a",), ("c",), {})
    df = spark.createDataFrame([("1", "u", 0), ("0", None, 1), ("x", "v", 1), ("3", "u", 0), (None, "u", 0)], "a string, c string, y int")
    med = prep.fit_medians(df, spec)
    assert med.first()["a"] == 2.0
    assert sorted(r["a"] for r in prep.impute(df, med, spec).collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        prep.fit_medians(df.filter("a = 'x'"), spec)
    with pytest.raises(ValueError):
        prep.check_columns(df.drop("c"), spec)
    flipped = df.withColumn("y", 1 - F.col("y"))
    assert prep.fit_medians(flipped, spec).first() == med.first()
    level = spark.range(1).select(prep.by_cuts(F.lit(2.0), [2.0, 3.0]).alias("a"), prep.by_bins(F.lit(2.0), ((2.0, "low"), (None, "high"))).alias("b")).first()
    assert tuple(level) == ("Low", "high")


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 0, 0.1), (0, 1, 0.8)], "y int, pred int, score double")
    c = metrics.confusion(df).first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == (1, 1, 2, 1) and math.isclose(c["bacc"], (0.5 + 2 / 3) / 2)
    assert math.isclose(metrics.auc(df).first()[0], (3 + 1.5) / 6)
    assert metrics.auc(df.filter("y = 1")).first()[0] is None
    assert math.isclose(metrics.by_class(df).first()["macro_f1"], (2 / 4 + 4 / 6) / 2)


def test_statistics(spark):
    assert stats.wilcoxon_greater([1, 2, 3, 4, 5]) == 1 / 32 and stats.wilcoxon_greater([0, 0]) == 1.0
    df = spark.createDataFrame([(1, 0.001), (2, 0.02), (3, 0.04), (4, 0.2), (5, float("nan"))], "k int, p double")
    got = {r["k"]: r for r in stats.holm(df).collect()}
    assert [round(got[k]["p_adj"], 6) for k in (1, 2, 3, 4)] == [0.004, 0.06, 0.08, 0.2] and got[5]["p_adj"] is None
    assert abs(stats.studentized_range_quantile(4) / math.sqrt(2) - 2.569) < 2e-3
    assert abs(stats.t_quantile(0.975, 4) - 2.776) < 1e-3 and abs(stats.gamma_tail(1.0, 3.0) - math.exp(-3)) < 1e-12
    q, p = stats.friedman(spark.createDataFrame([(b, m, float(v)) for b, vs in enumerate([(1, 2, 3), (1, 2, 3), (2, 1, 3)]) for m, v in enumerate(vs)], "block int, method int, v double"))
    assert math.isclose(q, 14 / 3) and math.isclose(p, math.exp(-7 / 3))
    front = stats.pareto_front(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (2.0, 1.0), (4.0, 3.5)], "cost double, benefit double"))
    assert [tuple(r) for r in front.collect()] == [(1.0, 1.0), (2.0, 3.0), (4.0, 3.5)]
    assert stats.knee(spark.createDataFrame([(0.0, 0.0), (1.0, 0.9), (2.0, 1.0)], "x double, y double")).first()["x"] == 1.0


def test_embedding_gradient():
    r = np.random.default_rng(0)
    z, c, a = r.normal(size=(5, 3)), r.normal(size=(5, 3)), r.integers(0, 4, (5, 5)).astype(float)
    _, gz, gc = graph.edge_loss_and_gradient(z, c, a, 1.5)
    for m, g in ((z, gz), (c, gc)):
        m[2, 1] += 1e-6
        up = graph.edge_loss_and_gradient(z, c, a, 1.5)[0]
        m[2, 1] -= 2e-6
        down = graph.edge_loss_and_gradient(z, c, a, 1.5)[0]
        m[2, 1] += 1e-6
        assert abs((up - down) / 2e-6 - g[2, 1]) < 1e-6


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_clustered_greedy(base):
    _, df = base
    got = sampling.greedy_clustered(matrices.cells(df, FS), FS, 0.2, clusters=3).collect()
    assert got and len({r["cell"] for r in got}) == len(got)


def test_legacy_and_attribution_against_loops(base):
    rows, df = base
    cs = matrices.cells(df, FS)
    triples, n = list(combinations(range(4), 3)), len(rows)
    a = [sum(s[1:5] == t[1:5] for s in rows) for t in rows]
    m = [[sum(s[1 + i] == t[1 + i] and s[5] == t[5] for s in rows) for i in range(4)] for t in rows]
    b = [[a[r] * min(m[r][i] for i in c) for c in triples] for r in range(n)]
    same = lambda r, q, c: all(rows[r][1 + i] == rows[q][1 + i] for i in c)
    legacy = {x["id"]: x for x in infer.legacy_decided(infer.node_scores(df, infer.legacy_table(df, FS), FS), df).collect()}
    scores = infer.node_scores(df, matrices.node_table(cs, FS), FS).withColumn("pred", (F.col("d1") > F.col("d0")).cast("int")).cache()
    pred = {x["id"]: x["pred"] for x in scores.collect()}
    got = {(x["id"], x["cell"]): x["v"] for x in infer.attribution(scores, df, cs, FS).collect()}
    cell = [min(s[0] for s in rows if s[1:] == t[1:]) for t in rows]
    ones = sum(t[5] for t in rows)
    want = {}
    for q in range(n):
        held, every = [[0] * 4, [0] * 4], [[0] * 4, [0] * 4]
        for k, c in enumerate(triples):
            for r in range(n):
                if same(r, q, c):
                    total = sum(b[s][k] for s in range(n) if same(s, r, c) and rows[s][5] == rows[r][5])
                    every[rows[r][5]][k] = total
                    if r < n - 1:
                        held[rows[r][5]][k] = total
        d0, d1 = (max(x) + min(x) for x in held)
        assert (legacy[q]["d0"], legacy[q]["d1"]) == (d0, d1)
        assert legacy[q]["pred"] == int(not d0 > 9 * d1) and legacy[q]["prior_pred"] == int(not d0 > ((n - ones) / ones) ** 2 * d1)
        v = every[pred[q]]
        own = [r for r in range(n) if rows[r][5] == pred[q]]
        part = {r: sum(b[r][k] for k in (v.index(min(v)), v.index(max(v))) if same(r, q, triples[k])) for r in own}
        for r in own:
            if part[r]:
                want[(q, cell[r])] = want.get((q, cell[r]), 0) + part[r] / sum(part.values())
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x]) for x in want)
    even = scores.limit(1).withColumns({"id": F.lit(999).cast("long"), "n_seen": F.lit(0).cast("long")})
    nothing = df.limit(1).select(F.lit(999).cast("long").alias("id"), *[F.lit("?").alias(c) for c in FS])
    assert math.isclose(sum(x["v"] for x in infer.attribution(even, nothing, cs, FS).collect()), 1)
