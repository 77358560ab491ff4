"""Gradients against differences, training, explanations, triples and rule vectors."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fuzzloom.operators import embedding as em
from fuzzloom.operators import infer, matrices, triples

FS = ["f0", "f1", "f2", "f3"]
S = em.Settings(dim=4, tau=0.5, tau_c=0.5, sigma=0.5, steps=4)


@pytest.fixture(scope="module")
def base(spark):
    r = random.Random(3)
    rows = []
    for i in range(80):
        levels = [r.choice("LMH") for _ in FS]
        rows.append((i, *levels, int(levels.count("H") >= 2) if r.random() > 0.1 else 0))
    df = spark.createDataFrame(rows, "id long, f0 string, f1 string, f2 string, f3 string, y int").cache()
    cs = matrices.cells(df, FS).cache()
    return df, cs, em.rule_graph(cs, FS, S)


def _numeric(f, p, spots):
    out = []
    for i in spots:
        at = np.unravel_index(i, p.shape)
        q, r = p.copy(), p.copy()
        q[at] += 1e-6
        r[at] -= 1e-6
        out.append((f(q) - f(r)) / 2e-6)
    return np.array(out)


def test_gradients(base):
    _, _, g = base
    m = em.start(g, S)
    spots = list(range(0, m.z.size, 5))
    total = lambda z, c, u: sum(getattr(S, k) * v for k, v in em.structural(g, S, z, c, u)[0].items())
    gz, gc, gu = em.structural(g, S, m.z, m.c, m.u)[1]
    assert np.allclose(_numeric(lambda z: total(z, m.c, m.u), m.z, spots), gz.ravel()[spots], atol=1e-6)
    assert np.allclose(_numeric(lambda c: total(m.z, c, m.u), m.c, spots), gc.ravel()[spots], atol=1e-6)
    assert np.allclose(_numeric(lambda u: total(m.z, m.c, u), m.u, range(m.u.size)), gu.ravel(), atol=1e-6)
    rng = np.random.default_rng(0)
    n = 7
    q, y, y_f = rng.random((n, len(g.vocab))) / 4, rng.integers(0, 2, n), rng.integers(0, 2, n)
    p_f, e = rng.dirichlet([1, 1], n), rng.random((n, len(g.cells)))
    e /= e.sum(axis=1, keepdims=True)
    args = (q, y, rng.random(n), p_f, y_f, e, np.where(np.arange(n) % 2, g.cells[3], -1))

    def value(z, u):
        return sum(em.instance(em.Model(g, S, z, m.c, u), *args)[0].values())

    gz, gu = em.instance(m, *args)[1]
    assert np.allclose(_numeric(lambda z: value(z, m.u), m.z, spots), gz.ravel()[spots], atol=1e-5)
    assert np.allclose(_numeric(lambda u: value(m.z, u), m.u, range(m.u.size)), gu.ravel(), atol=1e-5)


def test_cells_weigh_as_rules(base, spark):
    df, cs, g = base
    m = em.start(g, S)
    each = [[list(g.cells).index(r["cell"])] * r["w"] for r in cs.collect()]
    rules = [k for ks in each for k in ks]
    one = em.RuleGraph(g.vocab, 4, np.arange(len(rules)), g.labels[rules], np.ones(len(rules)), g.pool[rules], g.own[rules], g.edges, g.shares, 2)
    q = np.random.default_rng(1).random((5, len(g.vocab)))
    p = [em.class_scores(x, em.similarities(x, q)[0])[0] for x in (m, em.Model(one, S, m.z, m.c, m.u))]
    assert np.allclose(*p)


def test_distributed_sums_equal_local(base, spark):
    df, cs, g = base
    samples = em.crisp_samples(df, FS).join(df.join(cs.drop("w"), [*FS, "y"]).select("id", F.col("cell").alias("grp")), "id")
    m = em.start(g, S)
    parts, grads = em._sums(samples.repartition(5), m)
    rows = samples.collect()
    q = np.zeros((len(rows), len(g.vocab)))
    for i, r in enumerate(rows):
        for t in r["membership"]:
            q[i, g.vocab.index(t)] = 0.25
    want, (gz, gu) = em.instance(m, q, np.array([r["y"] for r in rows]), np.ones(len(rows)), grp=np.array([r["grp"] for r in rows]))
    assert abs(parts["pred"] - want["pred"] / len(rows)) < 1e-9
    assert np.allclose(grads[0], gz / len(rows)) and np.allclose(grads[1], gu / len(rows))


def test_training_with_a_teacher(base, spark):
    df, cs, g = base
    samples = em.crisp_samples(df, FS)
    scores = infer.node_scores(df, matrices.node_table(cs, FS), FS).withColumn("pred", (F.col("d1") > F.col("d0")).cast("int"))
    shares = infer.attribution(scores, df, cs, FS)
    told, t = em.taught(samples, scores, shares, validation=scores)
    assert t in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0) and told.count() == 80
    m = em.train(g, told.cache(), S, validation=samples.filter("id % 5 = 0"))
    losses = [h["loss"] for h in m.history]
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:])) and m.threshold is not None
    out = em.predict(samples, m).collect()
    assert len(out) == 80 and all(abs(sum(r["p"]) - 1) < 1e-9 and r["pred"] == int(r["score"] > m.threshold) for r in out)
    top = em.explain(samples, m, None).groupBy("id").agg(F.sum("v").alias("v")).collect()
    assert len(top) == 80 and all(abs(r["v"] - 1) < 1e-9 for r in top)
    assert em.components(m, spark).count() == len(losses)


@pytest.mark.parametrize("optimizer", ["amsgrad", "sgd"])
def test_batches(base, optimizer):
    df, _, g = base
    m = em.train(g, em.crisp_samples(df, FS), replace(S, optimizer=optimizer, steps=2, batches=2))
    assert len(m.history) == 2 and np.isfinite(m.z).all()


def test_edge_cases(base, spark):
    df, cs, g = base
    m = em.start(g, S)
    odd = spark.createDataFrame([(1, None), (2, {}), (3, {"f0-?": 1.0}), (4, {"f0-L": None})], "id long, membership map<string,double>")
    got = em.predict(odd, m).collect()
    assert len({tuple(r["p"]) for r in got}) == 1 and len(got) == 4
    assert em.predict(odd.limit(0), m).count() == 0
    with pytest.raises(ValueError):
        em.Settings(decay=0)
    with pytest.raises(ValueError):
        em.rule_graph(matrices.cells(df, FS[:1]), FS[:1])


@pytest.mark.parametrize("model", ["translation", "product"])
def test_triples(spark, model):
    df = spark.createDataFrame([("a", 0, "b"), ("b", 0, "a"), ("c", 1, "k"), ("d", 1, "k"), ("e", 1, "l")], "h string, r int, t string")
    v = triples.train_triples(df, model, 8, 400, 0.05)
    told = {(r["h"], r["t"]): r["score"] for r in triples.plausibility(df.unionByName(spark.createDataFrame([("c", 1, "l"), ("x", 1, "l")], df.schema)), v, model).collect()}
    assert told[("c", "k")] > told[("c", "l")] and ("x", "l") not in told
    assert sorted(map(tuple, v.collect())) == sorted(map(tuple, triples.train_triples(df, model, 8, 400, 0.05).collect()))


def test_mean_vectors(spark):
    v = spark.createDataFrame([("token", "a", [3.0, 0.0]), ("token", "b", [0.0, 4.0])], "kind string, name string, v array<double>")
    m = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 0.5), (2, "?", 1.0), (3, "?", 1.0)], "id long, token string, mu double")
    got = {r["id"]: r["v"] for r in triples.mean_vectors(m, v).collect()}
    assert set(got) == {1, 2} and np.allclose(got[1], [0.6, 0.8]) and got[2] == [1.0, 0.0]
