"""Clusters and selection by clusters against slow forms."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from fuzzloom.operators import clusters, matrices, sampling, split

F3 = ["a", "b", "c"]


def slow_clusters(cells, features, k, by, seed):
    """{cell: cluster} of dicts with cell, w, y and levels, by loops."""
    groups, out = defaultdict(list), {}
    text = lambda x: "null" if x is None else str(x)
    for c in cells:
        groups["|".join(["g", *[text(c[b]) for b in by]])].append(c)
    for g, rows in groups.items():
        tokens = {c["cell"]: [f"{i}:{text(c[f])}" for i, f in enumerate(features)] for c in rows}

        def race(turn, weight):
            best = None
            for c in rows:
                if weight(c) > 0:
                    u = (int(hashlib.md5(f"{seed}:{turn}:{g}:{c['cell']}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
                    best = min(filter(None, [best, (-math.log(u) / weight(c), c["cell"])]))
            return best and tokens[best[1]]

        centres = {0: dict.fromkeys(race(0, lambda c: c["w"]), 1.0)}
        for turn in range(1, k):
            d = {c["cell"]: min(2 * sum(t not in x for t in tokens[c["cell"]]) for x in centres.values()) for c in rows}
            got = race(turn, lambda c: c["w"] * d[c["cell"]])
            if got is None:
                break
            centres[turn] = dict.fromkeys(got, 1.0)
        at = None
        for _ in range(100):
            near = {c: min((round(sum(v * v for v in x.values()) - 2 * sum(x.get(t, 0.0) for t in ts), 9), i) for i, x in centres.items())[1] for c, ts in tokens.items()}
            if near == at:
                break
            at = near
            for i in centres:
                own = [c for c in rows if at[c["cell"]] == i]
                if own:
                    n, sums = sum(c["w"] for c in own), Counter()
                    for c in own:
                        for t in tokens[c["cell"]]:
                            sums[t] += c["w"]
                    centres[i] = {t: v / n for t, v in sums.items()}
        names = {i: n for n, i in enumerate(sorted(set(at.values())))}
        out |= {c: names[i] for c, i in at.items()}
    return out


@pytest.fixture(scope="module")
def rules(spark):
    r = random.Random(2)
    rows = [(i, r.choice("xyz"), r.choice(["p", "q", None]), r.choice("uvwst"), int(r.random() < 0.3)) for i in range(160)]
    return spark.createDataFrame(rows, "id long, a string, b string, c string, y int").cache()


@pytest.mark.parametrize(("k", "by", "seed"), [(1, ["y"], 0), (3, ["y"], 0), (4, [], 1), (50, ["y"], 2)])
def test_clusters(spark, rules, k, by, seed):
    cs = matrices.cells(rules, F3).cache()
    got = {r["cell"]: r["cluster"] for r in clusters.clustered(cs, F3, k, by, seed).collect()}
    assert got == slow_clusters([r.asDict() for r in cs.collect()], F3, k, by, seed)


def test_clusters_of_equal_cells(spark):
    one = spark.createDataFrame([(1, "x", 5, 0), (2, "x", 3, 1)], "cell long, a string, w long, y int")
    assert {r["cluster"] for r in clusters.clustered(one, ["a"], 4).collect()} == {0}
    assert clusters.clustered(one.limit(0), ["a"], 4).isEmpty()
    with pytest.raises(ValueError):
        clusters.clustered(one, ["a"], 0)


def slow_select(rows, cells, part_of, quota):
    """Greedy within each part, then other rules of it by id."""
    out = []
    for part, q in quota.items():
        own = [c for c in cells if part_of[c["cell"]] == part]
        same = lambda x, y: sum(x[f] == y[f] for f in F3) if x["y"] == y["y"] else 0
        cover, chosen = {c["cell"]: 0 for c in own}, []
        while len(chosen) < q:
            gain, cell = max(((sum(max(same(c, x) - cover[x["cell"]], 0) * x["w"] for x in own), -c["cell"]) for c in own), default=(0, 0))
            if gain <= 0:
                break
            pick = next(c for c in own if c["cell"] == -cell)
            cover = {x["cell"]: max(cover[x["cell"]], same(pick, x)) for x in own}
            chosen.append(-cell)
        key = {tuple(c[f] for f in (*F3, "y")): part_of[c["cell"]] for c in cells}
        rest = sorted(r["id"] for r in rows if key[tuple(r[f] for f in (*F3, "y"))] == part and r["id"] not in chosen)
        out += [(i, part) for i in chosen + rest[: q - len(chosen)]]
    return sorted(out)


@pytest.mark.parametrize(("within", "mode"), [(True, "exact"), (True, "ceil"), (False, "exact"), (False, "ceil")])
def test_selection(spark, rules, within, mode):
    theta, k = 0.17, 3
    cs = matrices.cells(rules, F3).cache()
    cells, rows = [r.asDict() for r in cs.collect()], [r.asDict() for r in rules.collect()]
    at = slow_clusters(cells, F3, k if within else 2 * k, ["y"] if within else [], 0)
    part = {c["cell"]: f"{c['y']}:{at[c['cell']]}" if within else str(at[c["cell"]]) for c in cells}
    size = Counter()
    for c in cells:
        size[part[c["cell"]]] += c["w"]
    m = math.ceil(theta * len(rows) - 1e-12)
    names = sorted(size, key=lambda p: [int(x) for x in p.split(":")])
    if mode == "ceil":
        quota = {p: math.ceil(theta * n - 1e-12) for p, n in size.items()}
    elif not within:
        quota = dict(zip(names, split.largest_remainder([size[p] for p in names], m)))
    else:
        quota, labels = {}, [0, 1]
        for y, q in zip(labels, split.largest_remainder([sum(r["y"] == y for r in rows) for y in labels], m)):
            own = [p for p in names if p.startswith(f"{y}:")]
            quota |= dict(zip(own, split.largest_remainder([size[p] for p in own], q)))
    got = sampling.cluster_select(rules, cs, F3, theta, k, mode=mode, within_label=within)
    assert sorted((r["id"], r["part"]) for r in got.collect()) == slow_select(rows, cells, part, quota)
    if mode == "exact":
        assert got.count() == m


def test_one_stage_and_names(spark, rules):
    cs = matrices.cells(rules, F3)
    assert sampling.cluster_select(rules, cs, F3, 0.1, 2, design="one_stage").count() == 160
    assert sampling.cluster_select(rules, cs, F3, 0.0, 2).isEmpty() and sampling.cluster_select(rules, cs, F3, 0.0, 2, design="one_stage").isEmpty()
    for bad in ({"design": "x"}, {"mode": "x"}):
        with pytest.raises(ValueError):
            sampling.cluster_select(rules, cs, F3, 0.1, 2, **bad)
