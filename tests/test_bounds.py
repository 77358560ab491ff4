"""The bound check against plain enumeration."""

import hashlib
import math
import random
from collections import defaultdict
from itertools import combinations

import pytest

from fuzzloom.operators import bounds, split
from fuzzloom.sources.staging import staged
from tests.test_clusters import slow_clusters

FS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rules(spark):
    r = random.Random(6)
    return spark.createDataFrame([(i, r.choice("xyz"), r.choice("pq"), r.choice(["u", "v", None]), int(r.random() < 0.35)) for i in range(60)], "id long, a string, b string, c string, y int").cache()


def slow(rows, sizes, ratios, repeats):
    same = lambda x, y: sum(x[f] == y[f] for f in FS) if x["y"] == y["y"] else 0
    cover = lambda s, over: sum(max((same(x, y) for y in s), default=0) for x in over)

    def greedy(part, m):
        s = []
        for _ in range(min(m, len(part))):
            s.append(max((x for x in part if x not in s), key=lambda x: (cover([*s, x], part), -x["id"])))
        return s

    out, no = {}, 0
    for n in sizes:
        for ratio in ratios:
            for _ in range(repeats):
                own = sorted(rows, key=lambda x: (hashlib.md5(f"0:{no}:{x['id']}".encode()).hexdigest(), x["id"]))[:n]
                own.sort(key=lambda x: x["id"])
                m, scale = max(1, round(ratio * n)), n * len(FS)
                best = lambda part, b: max(cover(s, part) for s in combinations(part, b))
                labels = sorted({x["y"] for x in own})
                strata = [[x for x in own if x["y"] == y] for y in labels]
                quota = split.largest_remainder([len(s) for s in strata], m)
                at = slow_clusters([{**x, "cell": x["id"], "w": 1, "subset": no} for x in own], FS, 2, ["subset", "y"], 0)
                row, kinds = {}, {"s": (strata, quota), "c": ([], [])}
                for s, q in zip(strata, quota):
                    parts = defaultdict(list)
                    for x in s:
                        parts[at[x["id"]]].append(x)
                    kinds["c"][0].extend(parts[k] for k in sorted(parts))
                    kinds["c"][1].extend(split.largest_remainder([len(parts[k]) for k in sorted(parts)], q))
                row |= {"n": n, "m": m, "opt": best(own, m) / scale, "greedy_rep": cover(greedy(own, m), own) / scale}
                share = sum(x["y"] for x in own) / n
                for k, (parts, budgets) in kinds.items():
                    chosen = [greedy(p, b) for p, b in zip(parts, budgets)]
                    every = [x for s in chosen for x in s]
                    local, top = [cover(s, p) for s, p in zip(chosen, parts)], [best(p, b) for p, b in zip(parts, budgets)]
                    row |= {f"{k}_rep": cover(every, own) / scale, f"{k}_opt": sum(top) / scale, f"{k}_worst": min([a / b for a, b in zip(local, top) if b] or [1.0]), f"{k}_gap": (cover(every, own) - sum(local)) / scale, f"{k}_off": abs(sum(x["y"] for x in every) / len(every) - share), f"{k}_size": len(every)}
                out[no] = row
                no += 1
    return out


def test_bound_check(spark, rules):
    checked = staged(bounds.bound_check(rules, FS, (6, 9), (0.2, 0.4), 3))
    got = {r["subset"]: r.asDict() for r in checked.collect()}
    want = slow([r.asDict() for r in rules.collect()], (6, 9), (0.2, 0.4), 3)
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert all(math.isclose(got[k][c], v, abs_tol=1e-12) for c, v in row.items()), (k, row, got[k])
    counted = bounds.violations(checked).first().asDict()
    assert counted.pop("subsets") == 12 and {k for k, v in counted.items() if v} <= {"off_s", "off_c"}


def test_counters_count(spark):
    cols = ["subset", "n", "m", "opt", "greedy_rep", *[f"{k}_{f}" for k in "sc" for f in ("rep", "opt", "worst", "gap", "off", "size")]]
    good = (0, 10, 2, 0.8, 0.8, 0.7, 0.7, 1.0, 0.0, 0.1, 2, 0.6, 0.6, 1.0, 0.1, 0.1, 2)
    bad = (1, 10, 2, 0.5, 0.9, 0.1, 0.7, 0.2, 0.3, 0.9, 1, 0.1, 0.8, 0.1, -0.5, 0.5, 3)
    low = (2, 10, 2, 0.9, 0.1, 0.7, 0.7, 1.0, 0.0, 0.1, 2, 0.6, 0.6, 1.0, 0.1, 0.1, 2)
    row = bounds.violations(spark.createDataFrame([good, bad, low], cols)).first().asDict()
    assert row == {"greedy": 1, "s": 1, "c": 1, "s_decomposition": 1, "c_negative_gap": 1, "chain": 1, "off_s": 1, "off_c": 1, "greedy_above_opt": 1, "size": 1, "subsets": 3}


def test_too_large(rules):
    with pytest.raises(ValueError):
        bounds.subsets(rules, (19,))
