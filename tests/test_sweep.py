"""Kept results and kept models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fuzzloom.operators import embedding, matrices
from fuzzloom.plans import states, sweep
from fuzzloom.sources.staging import new_path

FS = ["a", "b"]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([(i, "xyz"[i % 3], "pq"[i % 2], int(i % 5 == 0)) for i in range(40)], "id long, a string, b string, y int").cache()


def test_second_sweep_trains_nothing(spark, rules):
    path, calls = new_path(spark), []

    def train(df, rate, steps):
        calls.append((df.count(), rate, steps))
        return {"loss": rate * steps, "none": None, "note": f"r{rate}"}

    run = lambda inputs, settings: {(r["input"], r["settings"]): (r["metrics"], r["note"]) for r in sweep.sweep(spark, path, "s", inputs, settings, train, {"rate": 1, "steps": 2}).collect()}
    first = run({"all": rules, "some": rules.limit(10)}, [{"rate": 3}, {"rate": 1}, {}, {"rate": 3, "steps": 2}])
    assert len(calls) == 4 and first[("all", '{"rate": 3}')] == ({"loss": 6.0, "none": None}, "r3") and len(first) == 4
    again = run({"renamed": rules.repartition(7)}, [{"rate": 3}, {"rate": 5}])  # one of them is new, and rows in another order are the same input
    assert len(calls) == 5 and again[("renamed", '{"rate": 3}')][0]["loss"] == 6.0
    run({"other": rules.withColumn("y", F.lit(1))}, [{"rate": 3}])
    assert len(calls) == 6


def test_broken_off_sweep_goes_on(spark, rules):
    path, calls = new_path(spark), []

    def train(df, k):
        if k == 2 and not calls.count("broken"):
            calls.append("broken")
            raise RuntimeError("lost")
        calls.append(k)
        return {"k": k}

    ask = lambda: sweep.sweep(spark, path, "s", {"r": rules}, [{"k": k} for k in (1, 2, 3)], train)
    with pytest.raises(RuntimeError):
        ask()
    assert ask().count() == 3 and calls == [1, "broken", 2, 3]


def test_content(spark, rules):
    assert sweep.content_of(rules) == sweep.content_of(rules.select("y", "b", "a", "id").repartition(3))
    twice = rules.unionByName(rules.limit(1))
    assert len({sweep.content_of(x) for x in (rules, twice, rules.withColumnRenamed("a", "c"), rules.limit(0), rules.limit(0).withColumn("z", F.lit(1)))}) == 5


def test_models_are_restored(spark, rules):
    cs = matrices.cells(rules, FS)
    s = embedding.Settings(dim=4, steps=3)
    m = embedding.train(embedding.rule_graph(cs, FS, s), embedding.crisp_samples(rules, FS), s)
    path = new_path(spark)
    with pytest.raises(ValueError):
        states.load(spark, path)
    m.threshold = None
    assert states.save(spark, path, m, "first") == 1
    m2 = embedding.Model(m.graph, s, m.z * 2, m.c, m.u, 0.25, m.history, m.stopped)
    assert states.save(spark.newSession(), path, m2) == 2
    asked = embedding.crisp_samples(rules, FS)
    for version, want in ((1, m), (2, m2), (None, m2)):
        got = states.load(spark.newSession(), path, version)
        assert got.threshold == want.threshold and got.history == want.history and got.settings == want.settings and got.stopped == want.stopped
        a, b = (embedding.predict(asked, x).orderBy("id").collect() for x in (want, got))
        assert [r["p"] for r in a] == [r["p"] for r in b] and [r["pred"] for r in a] == [r["pred"] for r in b]
        x, y = (embedding.objective(k)[0] for k in (want, got))
        assert np.isclose(x, y, atol=1e-12)
    assert [r["note"] for r in states.versions(spark, path).orderBy("version").collect()] == ["first", ""]
