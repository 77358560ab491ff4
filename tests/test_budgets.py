"""Budgets that are met in full, shares with binding caps, stops, fast against slow greedy, protocols, sources."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fuzzloom.operators import infer, matrices, metrics, prep, sampling, split
from fuzzloom.plans import protocols
from fuzzloom.sources import files
from fuzzloom.sources.staging import staged

FS = ["f0", "f1", "f2", "f3"]


def base(r, n):
    return [(i, *[r.choice("LMH") for _ in range(4)], r.randint(0, 1)) for i in range(n)]


@pytest.fixture(scope="module")
def rules(spark):
    return staged(spark.createDataFrame(base(random.Random(3), 60), "id long, f0 string, f1 string, f2 string, f3 string, y int"))


def slow_greedy(rows, m, stop=None, mode="mean"):
    """Rule by rule over all pairs; ties and gainless picks by the lower id."""
    cov, picks, left = {r[0]: 0 for r in rows}, [], {r[0]: r for r in rows}
    sim = lambda a, b: sum(x == y for x, y in zip(a[1:5], b[1:5], strict=True)) if a[5] == b[5] else 0
    while left and len(picks) < m:
        gains = {i: sum(max(sim(r, x) - cov[x[0]], 0) for x in rows) for i, r in left.items()}
        best = min(gains, key=lambda i: (-gains[i], i))
        picks.append((best, gains[best]))
        for x in rows:
            cov[x[0]] = max(cov[x[0]], sim(left[best], x))
        del left[best]
        value = min(cov.values()) if mode == "all" else sum(cov.values()) / len(cov)
        if stop is not None and value >= 4 * stop - 1e-12:
            break
    return picks


@pytest.mark.parametrize("m", [0, 1, 7, 55, 60, 99])
def test_greedy_meets_the_budget(spark, rules, m):
    got = sampling.greedy_rules(rules, staged(matrices.cells(rules, FS)), FS, m).collect()
    want = slow_greedy([tuple(r) for r in rules.collect()], m)
    assert {(r["id"], r["gain"]) for r in got} == set(want) and len(got) == min(m, 60)


@pytest.mark.parametrize(("stop", "mode"), [(0.5, "mean"), (0.8, "mean"), (0.5, "all"), (0.75, "all")])
def test_stops(rules, stop, mode):
    got = sampling.greedy(staged(matrices.cells(rules, FS)), FS, 60, stop, mode).collect()
    assert {r["cell"] for r in got} == {i for i, _ in slow_greedy([tuple(r) for r in rules.collect()], 60, stop, mode)}


def test_unknown_mode(rules):
    with pytest.raises(ValueError):
        sampling.greedy_by_label(matrices.cells(rules, FS), FS, 3, 0.5, "most")


@pytest.mark.parametrize("theta", [0.0, 0.1, 0.5, 1.0])
def test_every_method_meets_the_budget(rules, theta):
    cs, m = staged(matrices.cells(rules, FS)), split.budget(theta, 60)
    ways = [sampling.greedy_stratified_rules(rules, cs, FS, theta, x) for x in ("proportional", "neyman")]
    ways += [sampling.greedy_clustered_rules(rules, cs, FS, theta, 3), split.strat_random(rules, theta)]
    for got in ways:
        ids = [r["id"] for r in got.select("id").collect()]
        assert len(ids) == len(set(ids)) == m


def slow_shares(sizes, m, weights):
    """One unit after another to the open stratum that lacks most of its quota."""
    m, total = min(m, sum(sizes)), sum(weights)
    if total <= 0:
        weights, total = sizes, sum(sizes)
    quota = [m * w / total if total else 0 for w in weights]
    out = [min(math.floor(q), s) for q, s in zip(quota, sizes, strict=True)]
    while sum(out) < m:
        i = min((i for i in range(len(sizes)) if out[i] < sizes[i]), key=lambda i: (out[i] - quota[i], i))
        out[i] += 1
    return out


def test_shares_with_caps():
    assert split.largest_remainder([18, 27, 1, 15, 7], 51, [1.8, 13.5, 0.9, 13.5, 6.3]) == slow_shares([18, 27, 1, 15, 7], 51, [1.8, 13.5, 0.9, 13.5, 6.3])
    r = random.Random(1)
    for _ in range(3000):
        sizes = [r.randint(0, 20) for _ in range(r.randint(1, 6))]
        weights = [r.choice([0, r.random(), r.randint(0, 9)]) for _ in sizes]
        m = r.randint(0, sum(sizes) + 3)
        assert split.largest_remainder(sizes, m, weights) == slow_shares(sizes, m, weights)
    assert split.allocate([1, 9], 0.2, "equal") == [1, 1] and split.allocate([1, 1], 0.5, exact=False) == [1, 1]
    with pytest.raises(ValueError):
        split.largest_remainder([3], -1)


def test_numbers_run_through(spark):
    df = spark.range(9000).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    rows = split.numbered(df, ["y"], "id").collect()
    for y in (0, 1):
        own = sorted((r["_no"], r["id"]) for r in rows if r["y"] == y)
        assert [n for n, _ in own] == list(range(len(own)))
    import hashlib

    order = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i in range(0, 9000, 7))
    assert [i for _, i in order] == [i for _, i in sorted((r["_no"], r["id"]) for r in rows if r["y"] == 1)]


def test_running_sums(spark):
    r = random.Random(5)
    rows = [(round(r.gauss(0, 1), 2), r.randint(0, 9)) for _ in range(3000)]
    got = metrics.running(spark.createDataFrame(rows, "s double, n long"), "s", "n").collect()
    for x in got[::97]:
        assert x["before"] == sum(n for s, n in rows if s < x["s"])


def test_calibration_against_all_thresholds(spark):
    import numpy as np

    r = random.Random(2)
    for n in (5, 40, 400):
        rows = [(int(r.random() < 0.3), round(r.gauss(0, 1), 2)) for _ in range(n - 2)] + [(0, 0.5), (1, 0.1)]
        df = spark.createDataFrame(rows, "y int, score double")
        y, s = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
        for criterion in ("bacc", "acc"):
            ts = sorted({0.0, *np.quantile(s, np.linspace(0.01, 0.99, 197))})
            value = lambda t: round(((s > t)[y == 1].mean() + (s <= t)[y == 0].mean()) / 2 if criterion == "bacc" else ((s > t) == y).mean(), 12)  # noqa: B023, E731
            best = max(value(t) for t in ts)
            assert value(infer.calibrate(df, criterion)) == best
    assert infer.calibrate(spark.createDataFrame([(1, 0.5)], "y int, score double")) == 0.0
    assert infer.calibrate(spark.createDataFrame([], "y int, score double")) == 0.0


def test_decisions(spark):
    df = spark.createDataFrame([(0, 5, 5, 1), (1, 9, 1, 1), (2, 10, 1, 1), (3, 0, 0, 0)], "id long, d0 long, d1 long, n_seen long")
    pred = lambda *a, **k: [r["pred"] for r in infer.decide(df, *a, **k).orderBy("id").collect()]
    assert pred() == [0, 0, 0, 0] and pred(ties=1) == [1, 0, 0, 0] and pred("ratio9") == [1, 1, 0, 0]
    assert pred("calibrated", -2.25, 1) == [1, 1, 0, 1] and pred("calibrated") == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        infer.decide(df, "other")


def test_fuzzy_attribution_of_crisp_queries(rules):
    cs = staged(matrices.cells(rules.filter("id < 45"), FS))
    asked = rules.filter("id >= 45")
    told = staged(infer.node_scores(asked, matrices.node_table(cs, FS), FS).withColumn("pred", (F.col("d1") > F.col("d0")).cast("int")))
    m = asked.select("id", F.posexplode(F.array(*FS)).alias("attr", "level")).withColumn("mu", F.lit(1.0))
    near = lambda df: {(r["id"], r["cell"]): round(r["v"], 9) for r in df.collect()}
    assert near(infer.fuzzy_attribution(told, m, cs, FS)) == near(infer.attribution(told, asked, cs, FS))


def test_prepared_fold(rules):
    told, threshold, table = protocols.prepare(rules, FS, 3)
    rows = told.collect()
    assert len(rows) == 60 and table.count() and threshold == infer.calibrate(told)
    groups = {}
    for r in rows:
        groups.setdefault(r["grp"], set()).add(r["held"])
    assert all(len(x) == 1 for x in groups.values()) and 0 < sum(r["held"] for r in rows) < 60


def test_budget_protocols(rules):
    raw = staged(protocols.equal_budgets(split.stratified_folds(rules, k=2), FS, [0.1], ("greedy", "stratified", "random")))
    assert raw.count() == 6 and {r["m"] for r in raw.collect()} == {3}
    tests = protocols.paired_tests(raw).collect()
    assert len(tests) == 6 and all(t["n"] == 2 and t["p"] <= 1 and not t["reject"] for t in tests)
    q, p, gaps = protocols.rank_methods(raw)
    assert 0 <= p <= 1 and q >= 0 and gaps.count() == 3
    curve, best, test = protocols.budget_study(rules, FS, [0.1, 0.3, 0.6])
    assert curve.count() == 3 and best in (0.1, 0.3, 0.6) and test.first()["theta"] == best


def test_published_configurations(spark):
    r = random.Random(9)
    rows = [(i, r.random(), r.random(), r.choice("ab"), int(r.random() < 0.4)) for i in range(120)]
    raw = spark.createDataFrame(rows, "id long, a double, b double, f2 string, y int")
    got = protocols.published_all(raw, {"a": "f0", "b": "f1"}, ["f0", "f1", "f2"], (("orig", (0.1, 0.9), (42,)), ("pair", (1 / 3, 2 / 3), (42,)))).collect()
    assert {(x["variant"], x["rule"]) for x in got} == {(v, k) for v in ("orig", "pair") for k in ("argmax", "ratio9", "calib_acc", "calib_bacc")}
    with pytest.raises(ValueError):
        protocols.published(raw, {"a": "f0", "b": "f1"}, ["f0", "f1", "f2"], "other").collect()


def test_rule_base_files(spark, rules, tmp_path):
    import json

    r = rules.limit(4).select("id", F.array(F.concat(F.lit("f0-"), "f0")).alias("antecedent_tokens"), F.concat(F.lit("class-"), F.col("y").cast("string")).alias("consequent_token"), F.lit(0.5).alias("confidence"), F.lit(0.25).alias("support"), F.col("id").alias("grp"))
    e = spark.createDataFrame([("f0-L", "f0-H", 0.5)], "u string, v string, mu double")
    files.write_rule_base(r, e, {"name": "toy"}, str(tmp_path / "base"))
    back = files.read_rule_base(spark, str(tmp_path / "base")).first()
    assert [x["id"] for x in back["rules"]] == sorted(x["id"] for x in r.collect()) and back["meta"] == {"name": "toy"} and back["edges"][0]["mu"] == 0.5
    s = spark.createDataFrame([({"f0-L": 0.7}, "1", 3, 2)], "membership map<string,double>, label string, rule_id long, grp long")
    files.write_samples(s, str(tmp_path / "samples"))
    assert [tuple(x) for x in files.read_samples(spark, str(tmp_path / "samples")).collect()] == [({"f0-L": 0.7}, "1", 3, 2)]
    for k in (2, 1):
        (tmp_path / f"fold_0{k}").mkdir()
        (tmp_path / f"fold_0{k}" / "t.csv").write_text("0,1,2\n1,2,1\n,,\n3,3,2\n1,2,1\n")
    assert files.list_folds(spark, str(tmp_path)) == ["fold_01", "fold_02"] and files.list_folds(spark, str(tmp_path / "none")) == []
    fold = files.read_fold(spark, str(tmp_path / "fold_01" / "t.csv"), 2).orderBy("id").collect()
    assert [(x["id"], x["grp"]) for x in fold] == [(0, 0), (1, 1), (2, 0)]
    assert json.dumps(files.environment(spark)) and files.fingerprint(spark, [str(tmp_path / "fold_01")]) == files.fingerprint(spark, [str(tmp_path / "fold_02")])
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "missing.csv"), "a int")
    assert files.read_csv(spark, str(tmp_path / "missing.csv"), "a int", lambda: spark.range(3)).count() == 3


def test_rule_filters(spark, rules):
    assert prep.keep_rules(rules, spark.range(5)).count() == 5 and prep.thin_rules(rules, 0.11).count() == 7
    e = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "u string, v string, n int")
    assert [tuple(r) for r in prep.pruned(e, spark.createDataFrame([("a",), ("b",)], "token string")).collect()] == [("a", "b", 1)]
    x = prep.one_hot(rules, FS).alias("x")
    assert x.count() == 240
    assert metrics.first_over(spark.createDataFrame([(0.1, 0.5), (0.2, 0.8), (0.3, 0.9)], "theta double, rep double"), "rep", 0.8).first()["theta"] == 0.2
    assert metrics.speed_up(4.0, 2.0) == 2 and metrics.speed_up(1.0, 0.0) is None and metrics.per_query_ms(2.0, 4) == 500


def test_equal_queries_are_attributed_once(spark, rules, monkeypatch):
    """Of 40 times as many queries, each shares what its like has; the nodes of a kind are made once."""
    cs = staged(matrices.cells(rules.filter("id < 45"), FS))
    few = rules.filter("id >= 45").select("id", *FS).unionByName(spark.createDataFrame([(99, "?", None, "?", "?")], "id long, f0 string, f1 string, f2 string, f3 string"))
    many = few.crossJoin(spark.range(40).withColumnRenamed("id", "r")).withColumn("of", F.col("id")).withColumn("id", F.col("id") + 1000 * F.col("r"))
    degrees = lambda q: q.select("id", F.posexplode(F.array(*FS)).alias("attr", "level")).filter("level IS NOT NULL").select("id", "attr", "level", F.lit(0.7).alias("mu")).unionByName(q.select("id", F.lit(0).alias("attr"), F.lit("L").alias("level"), F.lit(0.2).alias("mu")))
    table, own, met = matrices.node_table(cs, FS), infer._attribution, []
    monkeypatch.setattr(infer, "_attribution", lambda decided, *a: met.append(decided.count()) or own(decided, *a))
    told = lambda q: staged(infer.fuzzy_node_scores(degrees(q), table, FS).withColumn("pred", (F.col("d1") > F.col("d0")).cast("int")))
    shares = lambda df: {(r["id"], r["cell"]): round(r["v"], 9) for r in df.collect()}
    one, all_ = told(few), told(many)
    assert {(r["id"] % 1000, r["d0"], r["d1"]) for r in all_.collect()} == {tuple(r)[:3] for r in one.collect()} and all_.count() == 40 * one.count()
    for f, shape in ((infer.fuzzy_attribution, degrees), (infer.attribution, lambda q: q.select("id", *FS))):
        want = shares(own(one, infer.fuzzy_nodes(degrees(few), FS) if shape is degrees else matrices.exploded(few, FS, 3).withColumn("p", F.lit(1)), cs, FS, 3))
        got = shares(f(all_, shape(many), cs, FS))
        assert got == {(i + 1000 * r, c): v for (i, c), v in want.items() for r in range(40)}
    assert len(met) == 2 and max(met) <= few.count()


def test_fuzzy_queries_of_equal_levels_are_asked_once(spark, monkeypatch):
    """degrees are made for distinct levels, not for each query, and all queries are told."""
    from fuzzloom.plans import catalog

    seen, of = [], catalog._degrees
    monkeypatch.setattr(catalog, "_degrees", lambda asked: seen.append(asked.count()) or of(asked))
    d = "/root/testdata/sf0.001"
    got = catalog.fuzzy_attribution(spark, d)
    asked = catalog._held_out(spark, d)[1]
    assert got.select("id").distinct().count() == asked.count()
    assert seen == [asked.select(*catalog.FEATURES).distinct().count()] and seen[0] < asked.count()
