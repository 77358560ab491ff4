"""Fold sources in turn, splits in file order, and what operators refuse."""

import json

import pytest
from pyspark.sql import functions as F

from fuzzloom.operators import contracts, matrices, prep
from fuzzloom.sources import folds


def _samples(path, sizes):
    n = 0
    for k, size in enumerate(sizes):
        rows = [{"membership": {"f0-Low": 0.5}, "label": f"class-{i % 2}", "rule_id": n + i, "grp": i} for i in range(size)]
        (path / f"part{k}.json").write_text(json.dumps({"samples": rows}))
        n += size


def test_split_goes_over_files(spark, tmp_path):
    _samples(tmp_path, (7, 0, 5, 11))
    df = folds.json_samples(spark, str(tmp_path)).repartition(5)
    train, test = folds.split_by_position(df, 0.6)
    assert sorted(r["rule_id"] for r in train.collect()) == list(range(13)) and sorted(r["rule_id"] for r in test.collect()) == list(range(13, 23))
    assert [r["rule_id"] for r in train.orderBy("no").collect()] == list(range(13))
    assert folds.split_by_position(df, 0.0)[0].isEmpty() and folds.split_by_position(df, 1.0)[1].isEmpty()
    with pytest.raises(ValueError):
        folds.split_by_position(df, 1.5)


def test_sources_in_turn(spark, tmp_path):
    assert folds.sources(spark, "none", str(tmp_path / "no"), str(tmp_path / "r.json"), str(tmp_path / "s.json")) == []
    (one,) = folds.sources(spark, "drawn", str(tmp_path / "no"), place=3, allow_generated=True, rule_share=0.1)
    assert one.kind == "generated" and one.info["seeds"] == (103, 203, 0) and one.rules.count() == 25 and (one.train.count(), one.test.count()) == (120, 80)
    other = folds.generated(spark, "drawn", 4)
    assert other.rules.select("f0").collect() != folds.generated(spark, "drawn", 3).rules.select("f0").collect()
    (tmp_path / "s").mkdir()
    _samples(tmp_path / "s", (10,))
    (tmp_path / "r.json").write_text(json.dumps({"meta": {}, "vocab": [], "rules": [{"id": i, "antecedent_tokens": ["f0-Low"], "consequent_token": "class-1", "confidence": 1.0, "support": 0.1, "grp": i} for i in range(8)], "edges": []}))
    (two,) = folds.sources(spark, "json", str(tmp_path / "no"), str(tmp_path / "r.json"), str(tmp_path / "s"), allow_generated=True, rule_share=0.5, rule_seed=1)
    assert two.kind == "json" and two.info["rules"] == "random_0.5" and two.rules.count() == 4 and two.train.count() == 6
    for k in (1, 2):
        at = tmp_path / "f" / f"fold_0{k}"
        at.mkdir(parents=True)
        for part, rows in (("train", 6), ("test", 3)):
            (at / f"{part}.csv").write_text("0,1,2\n" + "".join(f"{1 + i % 5},{k},{1 + i % 2}\n" for i in range(rows)))
    got = folds.sources(spark, "real", str(tmp_path / "f"), str(tmp_path / "r.json"), str(tmp_path / "s"), attributes=2)
    assert [(x.name, x.kind, x.rules.count(), x.test.count()) for x in got] == [("fold_01", "folds", 6, 3), ("fold_02", "folds", 6, 3)]


def test_rule_bases_that_are_refused(spark):
    rules = spark.createDataFrame([(1, "x", 0)], "id long, a string, y int")
    contracts.check_rules(rules, ["a"])
    for bad, features in ((None, ["a"]), (rules.limit(0), ["a"]), (rules, []), (rules, ["a", "z"])):
        with pytest.raises(ValueError):
            contracts.check_rules(bad, features)
    with pytest.raises(ValueError):
        matrices.cells(rules, [])
    lists = lambda *rows: spark.createDataFrame([(i, x, 0) for i, x in enumerate(rows)], "id long, levels array<string>, y int")
    df, names = contracts.from_lists(lists(["L", "H"], ["H", None]))
    assert names == ["f0", "f1"] and df.columns == ["id", "f0", "f1", "y"] and df.count() == 2
    for bad in (lists(["L", "H"], ["H"]), lists(["L"], None), lists([], []), lists(["L"]).limit(0)):
        with pytest.raises(ValueError):
            contracts.from_lists(bad)


def test_transform_needs_a_fit(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 == 0 else f"c{i % 2}", i % 2) for i in range(9)], "a double, b string, y int")
    f = contracts.Fuzzifier(prep.DatasetSpec(("a", "b"), "y", (), ("b",)))
    with pytest.raises(RuntimeError):
        f.transform(df)
    with pytest.raises(ValueError):
        f.fit(df.drop("a"))
    f.fit(df)
    got = f.transform(df.drop("y").withColumn("a", F.when(F.col("a") > 0, F.col("a"))))  # no label, a missing value
    assert {r["a"] for r in got.collect()} == {"Low", "Medium", "High"} and {r["b"] for r in got.collect()} == {"Missing", "c0", "c1"}
    with pytest.raises(ValueError):
        f.transform(df.drop("b"))
