"""Vectors as tables are those of one process."""

import numpy as np
import pytest

from fuzzloom.operators import graph, triples

ROWS = [("a", 0, "b"), ("b", 0, "a"), ("a", 0, "c"), ("c", 0, "d"), ("a", 1, "class-1"), ("d", 1, "class-0"), ("b", 1, "class-1"), ("e", 0, "a")]


@pytest.mark.parametrize("model", ["translation", "product"])
def test_triples(spark, model):
    df = spark.createDataFrame(ROWS * 2, "h string, r int, t string")
    a, b = ({(r["kind"], r["name"]): r["v"] for r in triples.train_triples(df, model, 4, 2, 0.3, batch=5, seed=3, local=k).collect()} for k in (100, 1))
    assert a.keys() == b.keys() and len(a) == 9
    assert all(np.allclose(a[k], b[k], atol=1e-9) for k in a)
    start = {n: triples._start("token", n, 4, 3) for _, n in a}
    assert any(not np.allclose(v, start[n]) for (kind, n), v in a.items() if kind == "token")


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 3)
    df = spark.createDataFrame([(h, t, i + 1) for i, (h, _, t) in enumerate(ROWS)] + [("a", "b", 4), ("b", "e", 2)], "u string, v string, n long")
    a, b = ({r["token"]: r["v"] for r in graph.train_embedding(df, 3, 2.0, 1e-2, 3, 1, local=k).collect()} for k in (100, 1))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-8) for k in a)


def test_nothing_to_train(spark):
    with pytest.raises(ValueError):
        triples.train_triples(spark.createDataFrame([], "h string, r int, t string"))
    with pytest.raises(ValueError):
        graph.train_embedding(spark.createDataFrame([], "u string, v string, n long"))
