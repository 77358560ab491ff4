"""Skip-gram with drawn negatives against a slow form."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from fuzzloom.operators import skipgram


def digits(*parts, at=1):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[at - 1 : at + 7], 16)


WALKS = [(w, s, p.split()) for w, s, p in [(1, "a", "a b c a d"), (2, "a", "a d d b"), (1, "b", "b c"), (1, "e", "e"), (1, "f", "f a a a g h a a"), (2, "f", "f")]] + [(9, "z", [])]


def swept(counts, scale=1 << 20):
    """An alias table by a loop: light tokens in order of their hashes take from the heavy one that is open."""
    w = {t: max(round(n**0.75 * scale), 1) for t, n in counts.items()}
    k, total = len(w), sum(w.values())
    order = sorted(w, key=lambda t: hashlib.md5(t.encode()).hexdigest() + t)
    left = {t: w[t] * k for t in w}
    heavy = [t for t in order if left[t] > total]
    out, j = {}, 0
    for t in [t for t in order if left[t] <= total]:
        if left[t] == total:
            out[t] = (1.0, t)
            continue
        need = total - left[t]
        out[t] = (1 - need / total, heavy[j])
        left[heavy[j]] -= need
        while j < len(heavy) and left[heavy[j]] <= total:
            rest = total - left[heavy[j]]
            out[heavy[j]] = (1 - rest / total, heavy[j + 1]) if j + 1 < len(heavy) else (1.0, heavy[j])
            if j + 1 < len(heavy):
                left[heavy[j + 1]] -= rest
            j += 1
    return out


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 3, "b": 3}, {"a": 100, "b": 1, "c": 1}, {f"t{i}": 1 + (i * i) % 97 for i in range(200)}, {f"t{i}": 10**6 if i % 50 == 0 else 1 for i in range(300)}])
def test_alias_table(spark, counts):
    rows = skipgram.alias_table(spark.createDataFrame(list(counts.items()), "token string, n long")).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(counts)))
    share = defaultdict(float)
    for r in rows:
        assert 0 <= r["own"] <= 1
        share[r["token"]] += r["own"] / len(rows)
        share[r["other"]] += (1 - r["own"]) / len(rows)
    total = sum(n**0.75 for n in counts.values())
    assert all(math.isclose(share[t], n**0.75 / total, rel_tol=1e-3, abs_tol=1e-6) for t, n in counts.items())
    want = swept(counts)
    assert all(math.isclose(r["own"], want[r["token"]][0], abs_tol=1e-9) for r in rows)
    assert all(r["other"] == want[r["token"]][1] for r in rows if r["own"] < 1 - 1e-9)


def test_pairs_in_window(spark):
    df = spark.createDataFrame(WALKS, "walk int, start string, path array<string>")
    got = Counter((r["u"], r["v"]) for r in skipgram.walk_pairs(df, 2).collect())
    want = Counter((p[i], p[j]) for _, _, p in WALKS for i in range(len(p)) for j in range(max(0, i - 2), min(len(p), i + 3)) if i != j)
    assert got == want


@pytest.mark.parametrize("most", [7, 10**6])
def test_skip_gram(spark, most):
    dim, window, k, epochs, rate, seed = 4, 2, 3, 3, 0.2, 5
    got = {r["token"]: r["v"] for r in skipgram.skip_gram(spark.createDataFrame(WALKS, "walk int, start string, path array<string>").repartition(2), dim, window, k, epochs, most, rate, seed).collect()}
    counts = Counter(t for _, _, p in WALKS for t in p)
    table = swept(counts)
    slot = sorted(counts, key=lambda t: (hashlib.md5(f"0:{t}".encode()).hexdigest(), t))
    z = {t: [(digits("start", seed, t, i) / 2**32 * 2 - 1) * 0.1 for i in range(dim)] for t in counts}
    pairs = [(f"{s}:{w}:{i}:{j}", p[i], p[j]) for w, s, p in WALKS for i in range(len(p)) for j in range(max(0, i - window), min(len(p), i + window + 1)) if i != j]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for epoch in range(epochs):
        chosen = sorted(pairs, key=lambda x: (hashlib.md5(f"{1000 * seed + epoch}:{x[0]}".encode()).hexdigest(), x[0]))[:most]
        step = defaultdict(lambda: [0.0] * dim)
        for name, u, v in chosen:
            others = [(v, 1.0)]
            for d in range(1, k + 1):
                t = slot[digits(seed, epoch, name, d) % len(slot)]
                own, other = table[t]
                others.append((t if digits(seed, epoch, name, d, at=9) / 2**32 < own else other, 0.0))
            for x, label in others:
                g = 1 / (1 + math.exp(-dot(z[u], z[x]))) - label
                step[u] = [a + g * b for a, b in zip(step[u], z[x])]
                step[x] = [a + g * b for a, b in zip(step[x], z[u])]
        z = {t: [a - rate * b for a, b in zip(v, step[t])] for t, v in z.items()}
    assert got.keys() == z.keys()
    assert all(math.isclose(a, b, abs_tol=1e-9) for t in z for a, b in zip(got[t], z[t]))


def test_no_walk(spark):
    assert skipgram.skip_gram(spark.createDataFrame([], "walk int, start string, path array<string>"), epochs=1).isEmpty()
