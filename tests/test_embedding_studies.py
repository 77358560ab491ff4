"""Embedding studies: variants over folds, with kept results, and metric bundles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fuzzloom.plans import embedding_studies as es
from fuzzloom.sources.staging import new_path

FS = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def folds(spark):
    r = random.Random(3)
    rows = [(i, r.choice("LMH"), r.choice("LMH"), r.choice("LH")) for i in range(90)]
    rows = [(*x, int((x[1] == "H") + (x[2] == "H") + (r.random() < 0.2) > 0)) for x in rows]
    df = spark.createDataFrame(rows, "id long, f0 string, f1 string, f2 string, y int")
    return {f"fold {k}": df.withColumn("part", F.when(F.col("id") % 3 == k, "test").otherwise("train")).cache() for k in range(2)}


def test_study(spark, folds, monkeypatch):
    path, trained, plain = new_path(spark), [], es.fit
    monkeypatch.setattr(es, "fit", lambda df, features, **s: (trained.append(s["dim"]), plain(df, features, **s))[1])
    small = {"steps": 2, "dim": 4}
    got = {(r["variant"], r["metric"]): r for r in es.study(spark, path, folds, FS, es.by_dims((4, 6)), defaults=small).collect()}
    assert sorted(trained) == [4, 4, 6, 6] and {v for v, _ in got} == {"dim 4", "dim 6"}
    for m in ("accuracy", "bacc", "macro_f1", "auc", "log_loss", "agreement", "train_s", "rules"):
        assert got[("dim 4", m)]["folds"] == 2 and math.isfinite(got[("dim 4", m)]["mean"])
    es.study(spark, path, folds, FS, {"whole": es.ABLATIONS["whole"]}, defaults=small)  # known as dim 4
    assert len(trained) == 4
    more = {(r["variant"], r["metric"]): r["mean"] for r in es.study(spark, path, {"fold 0": folds["fold 0"]}, FS, {"half": {"rule_share": 0.5}, "alone": es.ABLATIONS["no teacher"]}, defaults=small).collect()}
    assert len(trained) == 6 and more[("half", "rules")] == 30
    with pytest.raises(ValueError):
        es.study(spark, path, folds, FS, {"x": {"dims": 3}})


def test_grids():
    assert es.by_weights({"edge": (0, 1), "inf": (0.5,)}) == {"edge=0 inf=0.5": {"edge": 0.0, "inf": 0.5}, "edge=1 inf=0.5": {"edge": 1.0, "inf": 0.5}}
    assert len(es.ABLATIONS) == 8 and es.by_negatives((2,)) == {"negatives 2": {"negatives": 2.0}} and list(es.by_share((0.5,)).values()) == [{"rule_share": 0.5}]


def test_bundles(spark, folds):
    df = spark.createDataFrame([(1, 0, 0, -1.0, [0.7, 0.3]), (2, 1, 1, 1.0, [0.2, 0.8]), (3, 1, 0, -0.5, [0.6, 0.4])], "id long, y int, pred int, score double, p array<double>")
    row = es.bundle(df, spark.createDataFrame([(1, 0), (2, 0), (9, 1)], "id long, pred int")).first()
    assert math.isclose(row["accuracy"], 2 / 3) and row["sensitivity"] == 0.5 and row["specificity"] == 1.0 and row["auc"] == 1.0 and row["agreement"] == 0.5
    assert math.isclose(row["log_loss"], -(math.log(0.7) + math.log(0.8) + math.log(0.4)) / 3) and es.bundle(df).first()["agreement"] is None
    fold = folds["fold 0"]
    got = es.lookup_bundle(fold.filter("part = 'train'").drop("part"), fold.filter("part = 'test'").drop("part"), FS, 2)
    assert 0 <= got["accuracy"] <= 1 and got["ms"] > 0 and got["ms_alone"] > 0
