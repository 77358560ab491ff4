"""Fallback, out-of-fold scores, curves, bounds, statistics, generated tables and streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fuzzloom.functions import stats
from fuzzloom.operators import graph, infer, matrices, sampling, split
from fuzzloom.sources import synthetic
from fuzzloom.streaming.score import pair_stream

FS = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def rules(spark):
    return synthetic.rules(spark, 300, 4).cache()


def test_generated_rules(spark, rules):
    rows = rules.collect()
    assert rows == synthetic.rules(spark, 300, 4).repartition(7).orderBy("id").collect()
    hidden = sum(int(sum(r[f] == "High" for f in FS) >= 2) == r["y"] for r in rows)
    assert hidden > 250 and {r["f0"] for r in rows} == set(synthetic.LEVELS)
    t = graph.tokens(matrices.cells(rules, FS), FS)
    mu = {(r["u"], r["v"]): r["mu"] for r in synthetic.edges(t).collect()}
    low = [r for r in rows if r["f0"] == "Low"]
    assert mu[("f0-Low", "f1-High")] == round(sum(r["f1"] == "High" for r in low) / len(low), 4)


def test_generated_samples(spark):
    for r in synthetic.samples(spark, 50, 3).collect():
        assert len(r["membership"]) == 9 and r["y"] in (0, 1)
        assert abs(sum(v for k, v in r["membership"].items() if k.startswith("f0-")) - 1) < 2e-4


def test_generated_patients(spark):
    df = synthetic.patients(spark, 2000)
    assert df.count() == 2000 and 1700 <= df.drop("id").distinct().count() <= 1701
    row = df.agg(F.avg("outcome").alias("p"), F.avg((F.col("level") == 0).cast("int")).alias("z")).first()
    assert 0.15 < row["p"] < 0.6 and 0.03 < row["z"] < 0.07


def test_fallback(spark):
    train = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "id long, y int")
    s = spark.createDataFrame([(7, 0, 5, 9, 2), (8, 0, 5, 5, 1), (9, 1, 0, 0, 0)], "id long, y int, d0 long, d1 long, n_seen long")
    got = {r["id"]: (r["matched"], r["pred"]) for r in infer.with_fallback(s, train).collect()}
    assert got == {7: (True, 1), 8: (True, 0), 9: (False, 1)}


def test_out_of_fold(rules):
    folded = split.stratified_folds(rules, k=3).select("id", *FS, "y", "fold").cache()
    got = {r["id"]: r for r in infer.out_of_fold(folded, FS, 3).collect()}
    table = matrices.node_table(matrices.cells(folded.filter("fold <> 1"), FS), FS)
    for r in infer.node_scores(folded.filter("fold = 1"), table, FS).collect():
        assert (got[r["id"]]["d0"], got[r["id"]]["d1"], got[r["id"]]["fold"]) == (r["d0"], r["d1"], 1)
    assert len(got) == 300


def test_budget_curve(rules):
    cs = matrices.cells(rules, FS).cache()
    picks = sampling.greedy(cs, FS, 30).cache()
    for r in sampling.budget_curve(picks, cs, FS, [0.0, 0.02, 0.1]).collect():
        chosen = picks.orderBy(F.desc("gain"), "cell").limit(r["m"])
        want = sampling.coverage_stats(sampling.coverage(cs, cs.join(chosen.select("cell"), "cell"), FS), 4).first()["rep"] if r["m"] else 0.0
        assert abs(r["rep"] - want) < 1e-9


def test_greedy_bound(rules):
    cs = matrices.cells(rules, FS).orderBy("cell").limit(20).cache()
    parts = cs.select("cell", (F.col("cell") % 2).alias("part"))
    for r in sampling.decomposition(cs, parts, FS, 2).collect():
        assert (1 - 1 / math.e) * r["best"] <= r["covered"] <= r["best"]
    with pytest.raises(ValueError):
        sampling.decomposition(cs, parts.limit(0), FS, 2)


def test_statistics(spark):
    r = random.Random(0)
    df = spark.createDataFrame([(b, m, k + r.random()) for b in range(30) for k, m in enumerate("abc")], "block int, method string, v double")
    got = {(x["a"], x["b"]): (x["gap"], x["differs"]) for x in stats.ranking_gaps(df).collect()}
    assert got[("a", "c")] == (2.0, True) and len(got) == 3
    one = stats.fold_interval(spark.createDataFrame([("m", float(v)) for v in (1, 2, 3, 4, 5)], "method string, v double"), ["method"]).first()
    assert one["mean"] == 3 and abs(one["half"] - 2.7764 * math.sqrt(2.5 / 5)) < 1e-3
    assert stats.fold_interval(spark.createDataFrame([("m", 1.0)], "method string, v double"), ["method"]).first()["half"] is None
    p = spark.createDataFrame([(0.25,), (0.00012,), (None,), (float("nan"),)], "p double")
    assert [x[0] for x in p.select(stats.format_p("p")).collect()] == ["0.2500", "1.20e-04", "n/a", "n/a"]
    front = spark.createDataFrame([(1.0, 1.0), (2.0, 9.0), (3.0, 10.0), (3.0, 2.0)], "cost double, benefit double")
    assert tuple(stats.knee_on_front(front).first()) == (2.0, 9.0)


def test_evidence(spark):
    df = spark.createDataFrame([(1, "a", 0, 0.5, 0.5), (2, "a", 0, 1.0, 0.25), (3, None, 1, 1.0, 1.0)], "id long, f0 string, y int, support double, confidence double")
    assert [tuple(r) for r in infer.evidence_table(df, ["f0"]).collect()] == [(0, "a", 0, 0.5)]


def test_stream_equals_batch(spark, rules, tmp_path):
    table = matrices.pair_table(matrices.cells(rules.filter("id < 200"), FS), FS)
    asked = rules.filter("id >= 200").select("id", *FS, "y").unionByName(spark.createDataFrame([(900, "?", None, "?", "?", 0)], "id long, f0 string, f1 string, f2 string, f3 string, y int"))
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    q = pair_stream(stream, table, FS).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = {r["id"]: (r["d0"], r["d1"], r["pred"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["id"]: (r["d0"], r["d1"], r["pred"]) for r in infer.decided(infer.pair_scores(asked, table, FS)).collect()}
    assert got == want and got[900] == (None, None, 0)


def test_compare_budgets(rules):
    from fuzzloom.plans import experiments

    folded = split.stratified_folds(rules.select("id", *FS, "y"))
    got = experiments.compare_budgets(folded.filter("fold <> 0"), folded.filter("fold = 0"), FS, [0.02, 0.2, 1.0], ("greedy", "random")).cache()
    rep = {(r["method"], r["theta"]): r["rep"] for r in got.collect()}
    assert len(rep) == 6 and all(rep[("greedy", t)] >= rep[("random", t)] for t in (0.02, 0.2, 1.0)) and rep[("random", 1.0)] == 1
    assert {r["method"] for r in experiments.best_budget(got).collect()} == {"greedy", "random"}


def test_train_validation(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(100)] + [(200, 2)], "id long, y int")
    got = split.train_validation(df).groupBy("y").agg(F.count_if("held").alias("n"), F.count("*").alias("all")).collect()
    assert {r["y"]: (r["n"], r["all"]) for r in got} == {0: (18, 90), 1: (2, 10), 2: (0, 1)}


def test_positive_share(spark):
    df = spark.createDataFrame([(1, 1, 4), (2, 0, 3)], "id long, pred long, votes long")
    assert [r["score"] for r in graph.positive_share(df).collect()] == [0.8, 0.4]


def test_knn_vote_in_blocks(spark):
    import numpy as np

    from fuzzloom.operators import graph

    r = np.random.default_rng(7)
    vecs = r.integers(-3, 4, (90, 4)).astype(float)
    rows = [(i, v.tolist(), int(r.integers(0, 3))) for i, v in enumerate(vecs)]
    base = spark.createDataFrame(rows, "id long, v array<double>, label long")
    unit = vecs / np.sqrt((vecs**2).sum(axis=1, keepdims=True) + 1e-12)
    want = []
    for i in range(90):
        top = [j for j in np.lexsort((np.arange(90), -np.round(unit @ unit[i], 9))).tolist() if j != i][:5]
        labels = [rows[j][2] for j in top]
        pred = max(labels, key=labels.count)
        want.append((i, pred, labels.count(pred)))
    got = graph.knn_vote(base, base, 5, 20).collect()
    assert sorted(tuple(x) for x in got) == want
    assert [tuple(x) for x in graph.knn_vote(base.limit(1), base.filter("id < 0")).collect()] == [(0, None, 0)]


def test_nearest_of_near_copies():
    """Single precision tells none of these apart; what it leaves is weighed in double precision, a bounded part at a time."""
    import numpy as np

    from fuzzloom.operators import graph

    r = np.random.default_rng(11)
    unit = lambda m: m / np.sqrt((m**2).sum(axis=1, keepdims=True) + 1e-12)
    for b in (r.normal(size=(3000, 8)), r.normal(size=(1, 8)) + 1e-8 * r.normal(size=(700, 8)), r.integers(-1, 2, (900, 3)).astype(float), r.normal(size=(3, 4))):
        b, ids, mine = unit(b), np.sort(r.integers(0, 2000, len(b))), r.integers(0, 2000, 150)
        q = b[r.integers(0, len(b), 150)]
        want = []
        for i in range(150):
            d = np.round((q[i] * b).sum(axis=1), 9)
            want += [(i, j) for j in np.lexsort((np.arange(len(b)), -d)).tolist() if ids[j] != mine[i]][:5]
        i, j, _ = graph.nearest(q, mine, b, ids, 5, many=1000)
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_knn_vote_of_copies(spark):
    from fuzzloom.operators import graph

    rows = [(i, [1.0, 0.0], i % 3) for i in range(400)] + [(5, [1.0, 0.0], 2)] * 9 + [(900, [0.0, 1.0], 7), (None, [0.0, 1.0], 8)]
    base = spark.createDataFrame(rows, "id long, v array<double>, label long")
    asked = spark.createDataFrame([(0, [2.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (900, [0.0, 3.0]), (None, [0.0, 1.0])], "id long, v array<double>")
    got = sorted((tuple(x) for x in graph.knn_vote(asked, base, 5, 100).collect()), key=str)
    # of the query 0 (1, 2, 3, 4, 5), of 5 (0, 1, 2, 3, 4), of 900 (null, 0, 1, 2, 3), of null (null, 900, 0, 1, 2)
    assert got == sorted([(0, 1, 2), (5, 0, 2), (5, 0, 2), (900, 0, 2), (None, 8, 1)], key=str)
    assert "WindowGroupLimit" in graph.lowest(base, 5)._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="vectors of one length"):
        graph.knn_vote(asked, base.unionByName(spark.createDataFrame([(1000, [1.0], 1)], base.schema))).collect()
