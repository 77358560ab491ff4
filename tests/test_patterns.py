"""Gains, coverage and greedy choice by patterns against pairs of cells."""

import random

import pytest
from pyspark.sql import functions as F

from fuzzloom.operators import matrices, sampling

FS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def cs(spark):
    r = random.Random(9)
    rows = [(i, r.choice("xyz"), r.choice(["p", None]), r.choice("uvw"), r.choice("12"), int(r.random() < 0.3)) for i in range(150)]
    return matrices.cells(spark.createDataFrame(rows, "id long, a string, b string, c string, d string, y int"), FS).cache()


def test_gains_and_coverage(spark, cs):
    rows = [x.asDict() for x in cs.collect()]
    same = lambda x, y: sum(x[f] == y[f] for f in FS) if x["y"] == y["y"] else 0
    for chosen in ([], rows[:1], rows[3:9]):
        picks = spark.createDataFrame([(x["cell"],) for x in chosen], "cell long")
        cov = {x["cell"]: max((same(x, c) for c in chosen), default=0) for x in rows}
        assert {x["cell"]: x["cov"] for x in sampling.coverage(cs, picks, FS).collect()} == cov
        gain = {x["cell"]: sum(max(same(x, j) - cov[j["cell"]], 0) * j["w"] for j in rows) for x in rows}
        assert {x["cell"]: x["gain"] for x in sampling.marginal_gains(cs, picks, FS).collect()} == gain
    for x in sampling.diversity(cs, FS).collect():
        own = [c for c in rows if c["y"] == x["y"]]
        n = sum(c["w"] for c in own)
        assert x["diversity"] == pytest.approx(1 - sum(same(c, d) * c["w"] * d["w"] for c in own for d in own) / (n * n * 4))


@pytest.mark.parametrize(("m", "stop", "mode"), [(6, None, "mean"), (200, 0.8, "mean"), (200, 0.5, "all"), (0, None, "mean")])
def test_tables_choose_alike(cs, m, stop, mode):
    by = lambda df: sorted(map(tuple, df.select("cell", "y", "rank", "gain").collect()))
    assert by(sampling.greedy_tables(cs, FS, m, stop, mode)) == by(sampling.greedy_by_label(cs, FS, m, stop, mode))


def test_switch_by_size(cs, monkeypatch):
    few = sampling.greedy(cs, FS, 5)
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(sampling, "LOCAL_CELLS", 3)
    assert sorted(map(tuple, sampling.greedy(cs, FS, 5).select(*few.columns).collect())) == want
    assert sampling.greedy(cs.filter(F.lit(False)), FS, 5).isEmpty()


def test_too_many_attributes(cs):
    with pytest.raises(ValueError):
        sampling.patterns(cs, ["a"] * 13)
