"""Factorial analyses in one plan against a pass for each fold and setting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fuzzloom.operators import infer, matrices, metrics, prep, sampling
from fuzzloom.plans import analyses

NUMERIC, FS = {"a": "f0", "b": "f1", "c": "f2"}, ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def folded(spark):
    r = random.Random(7)
    rows = []
    for i in range(180):
        y = int(r.random() < 0.4)
        rows.append((i, y, i % 3, None if r.random() < 0.1 else r.gauss(y, 1), 0.0 if r.random() < 0.1 else round(r.gauss(3 + y, 1), 1), float(r.randint(1, 5))))
    return spark.createDataFrame(rows, "id long, y int, fold int, a double, b double, c double").cache()


def one_pass(folded, fold, impute, scope, method, theta):
    train, test = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
    spec = prep.DatasetSpec(("a", "b", "c"), "y", ("b",))
    per = [r.asDict() for r in train.groupBy("y").agg(*[F.median(prep.valid(c, spec)).alias(c) for c in "abc"]).collect()]
    if impute == "class":
        fill = lambda df: df.withColumns({c: F.coalesce(prep.valid(c, spec), F.create_map(*[F.lit(x) for p in per for x in (p["y"], p[c])])[F.col("y")]) for c in "abc"})
    else:
        medians = prep.fit_medians(train, spec)
        fill = lambda df: prep.impute(df, medians, spec)
    train, test = fill(train), fill(test)
    cuts = prep.fit_cuts(train, list("abc"))
    rules, asked = (prep.fuzzify(x, cuts, NUMERIC).select("id", *FS, "y") for x in (train, test))
    if method == "greedy":
        cs = matrices.cells(rules, FS)
        rules = rules.join(sampling.greedy_rules(rules, cs, FS, math.ceil(theta * rules.count() - 1e-12)).select("id"), "id", "left_semi")
    s = infer.probabilities(infer.decided(infer.pair_scores(asked, matrices.pair_table(matrices.cells(rules, FS), FS, scope), FS)))
    auc = {k: metrics.auc(s.withColumn("score", F.round(v, 12))).first()["auc"] for k, v in (("softmax", "p1"), ("margin", "score"))}
    return auc, metrics.confusion(s).first()["bacc"]


def test_factorial(folded):
    got = {(r["fold"], r["impute"], r["scope"], r["method"], r["score"]): r for r in analyses.factorial(folded, NUMERIC, 0.2, scopes=("global", "upper"), zero_missing=("b",)).collect()}
    assert len(got) == 3 * 2 * 2 * 2 * 2
    for fold, impute, scope, method in [(1, "class", "upper", "full"), (2, "global", "global", "greedy")]:
        auc, bacc = one_pass(folded, fold, impute, scope, method, 0.2)
        for k, v in auc.items():
            row = got[(fold, impute, scope, method, k)]
            assert math.isclose(row["auc"], v, abs_tol=1e-12) and math.isclose(row["bacc"], bacc, abs_tol=1e-12) and row["n_unique"] > 1


def test_samples_meet_their_budgets(folded):
    rows = analyses.settings(folded, NUMERIC, ("global",)).filter("part = 'train'").cache()
    for method in analyses.METHODS[1:]:
        got = analyses.chosen(rows, FS, 0.13, method, 2).groupBy("cfg").agg(F.count("*").alias("n"), F.count_distinct("id").alias("k")).collect()
        assert [(r["n"], r["k"]) for r in got] == [(16, 16)] * 3
    with pytest.raises(ValueError):
        analyses.chosen(rows, FS, 0.1, "best")


def test_effects(spark):
    rows = spark.createDataFrame([("p", "s", 1.0), ("p", "t", 3.0), ("q", "s", 2.0), ("q", "t", 8.0), ("q", "t", None)], "a string, b string, auc double")
    got = {(r["factor"], r["level"]): (r["mean"], r["effect"], r["n"]) for r in analyses.effects(rows, ["a", "b"]).collect()}
    assert got == {("a", "p"): (2.0, -3.0, 2), ("a", "q"): (5.0, 3.0, 2), ("b", "s"): (1.5, -4.0, 2), ("b", "t"): (5.5, 4.0, 2)}


def test_counts_give_the_chosen_cells(folded):
    """Counts by pieces of ids lead to the cells of the rows that are chosen one by one."""
    rows = analyses.settings(folded, NUMERIC, zero_missing=("b",)).cache()
    counts, told = analyses.counted_settings(folded, NUMERIC, zero_missing=("b",), by_id=True)
    key = ["cfg", *FS, "y"]
    each = lambda df, n: {tuple(r[c] for c in key): r["n"] for r in df.groupBy(*key).agg(n.alias("n")).collect()}
    for part in ("train", "test"):
        assert each(counts.filter(F.col("part") == part), F.sum("n")) == each(rows.filter(F.col("part") == part), F.count("*"))
    for theta, method in ((0.1, "full"), (0.02, "greedy"), (0.4, "greedy"), (1.0, "greedy"), (0.3, "stratified"), (0.45, "clustered")):
        got = analyses.chosen_cells(counts.filter("part = 'train'"), told, FS, theta, method, 2)
        assert each(got, F.sum("w")) == each(analyses.chosen(rows.filter("part = 'train'"), FS, theta, method, 2), F.count("*"))


def test_effects_of_all_switches(spark, monkeypatch, folded):
    """the effects are those of every switch of the ablation, the method among them."""
    from fuzzloom.plans import studies

    monkeypatch.setattr(studies, "_folded_orders", lambda spark, d: folded.withColumnsRenamed({"a": "price", "b": "balance", "c": "number"}))
    got = {(r["factor"], r["level"]): r["n"] for r in studies.factor_effects(spark, "").collect()}
    assert got == {(f, v): 24 for f, vs in (("method", ("full", "greedy")), ("impute", analyses.IMPUTE), ("scope", ("upper", "global")), ("score", analyses.SCORES)) for v in vs}
