"""Near-duplicate joins against all pairs by brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from fuzzloom.llm import near, shingle_forest
from fuzzloom.llm.common import shingles


def sets_of(text, width=5):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_classes(rows, threshold=0.8):
    """doc row number -> (class, links), by all pairs of distinct shingle sets."""
    sets = [sets_of(t) for _, t in rows]
    distinct = sorted(set(sets), key=lambda s: min(i for i, x in enumerate(sets) if x == s))
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    n_links = defaultdict(int)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                n_links[a] += 1
                n_links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for (doc, _), s in zip(rows, sets, strict=True):
        if doc is not None:
            k = find(s)
            least[k] = min(least.get(k, doc), doc)
    return [(least.get(find(s)), n_links[s]) for s in sets]


def family(r, n, size, edits):
    words = [f"w{r.randint(0, 5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(size)] = f"e{r.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows(odd_rows):
    r = random.Random(11)
    texts = [t for k in range(12) for t in family(r, r.randint(2, 9), r.choice([30, 120, 400]), k % 6)]
    texts += family(r, 60, 150, 5) + [" ".join(f"z{r.randint(0, 9999)}" for _ in range(100)) for _ in range(40)]
    r.shuffle(texts)
    return [(x[0], x[1]) for x in odd_rows] + [(1000 + i, t) for i, t in enumerate(texts)]


def test_forest_join(spark, rows, none):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(zip((d for d, _ in rows), brute_classes(rows), strict=True), key=str)
    got = sorted(((r["doc_id"], (r["class_id"], r["n_links"])) for r in shingle_forest.link_documents(df).collect()), key=str)
    assert got == want
    assert shingle_forest.link_documents(none).count() == 0


def test_one_of_each(spark, odd, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, media string")
    kept = shingle_forest.one_of_each(df).collect()
    assert {r["doc_id"] for r in kept} == {c for c, _ in brute_classes(rows)}
    assert len(kept) == len({c for c, _ in brute_classes(rows)})
    assert shingle_forest.one_of_each(odd).columns == odd.columns


def test_blocks_compare_as_one(spark, monkeypatch):
    r = random.Random(2)
    rows = list(enumerate(family(r, 50, 100, 3)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {tuple(x) for x in shingle_forest.link_documents(df).select("doc_id", "class_id", "n_links").collect()}
    monkeypatch.setattr(near, "BLOCK", 8)
    assert {tuple(x) for x in shingle_forest.link_documents(df).select("doc_id", "class_id", "n_links").collect()} == whole
    want = brute_classes(rows)
    assert whole == {(i, *want[i]) for i in range(50)}


def test_jaccards_exact():
    r = random.Random(8)
    some = [shingles(t) for t in family(r, 30, 60, 4)]
    got = near.jaccards(some)
    for i, a in enumerate(some):
        for j, b in enumerate(some):
            assert i == j or abs(got[i, j] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 1e-12
    assert np.allclose(near.jaccards(some[:10], some[10:]), got[:10, 10:])  # a set against itself is not compared


def test_prefix_shortens():
    length = shingle_forest.prefix_length
    assert length(24, 8, 0.8, 0.9999) == 5 and length(24, 8, 0.8, 0.5) == 8
    with pytest.raises(ValueError):
        length(2, 8, 0.5, 0.999)


def test_neighbours(spark):
    r = random.Random(4)
    rows = [(bytes(r.randint(0, 2) for _ in range(5)), bytes([k // 256, k % 256])) for k in range(600)] + [(b"hotxx", bytes([9, k])) for k in range(100)]
    df = spark.createDataFrame(rows, "path binary, item binary").repartition(5)
    for prefix in (1, 3, 5):
        count = Counter(p[:prefix] for p, _ in rows)
        got = [(bytes(x["path"]), bytes(x["item"])) for x in near.neighbours(df, 5, prefix).collect()]
        want = {x for x in rows if count[x[0][:prefix]] > 1}
        assert len(got) == len(set(got)) and want <= set(got) and len(set(got) - want) <= 8


@pytest.mark.parametrize("node", [50_000, 3])
def test_hubs_reach_all_links(spark, monkeypatch, node):
    """Sketches that hold the sets themselves: every link's two items share a hub's two circles."""
    r = random.Random(6)
    base = [r.sample(range(64), 32) for _ in range(9)]
    sketches = {}
    for k in range(150):
        bits = np.zeros(64, np.uint8)
        bits[base[k % 9]] = 1
        flips = r.sample(range(64), r.randint(0, 6))
        bits[flips] ^= 1
        sketches[bytes([k])] = bits
    signed = spark.createDataFrame([(k, v.tobytes()) for k, v in sketches.items()], "item binary, sketch binary")
    held = spark.createDataFrame([(b"x", k) for k in sketches], "path binary, item binary")
    monkeypatch.setattr(near, "NODE", node)
    monkeypatch.setattr(near, "BLOCK", 8)
    edges, buckets = near.searched(held, signed, [1], 0.8, np.uint8)
    done = defaultdict(list)
    for x in near.units(edges, buckets).collect():
        done[bytes(x["item"])].append(((bytes(x["unit"]["grp"]), x["unit"]["i"], x["unit"]["j"]), x["side"]))
    met = lambda x, y: sum(u == v and (i != j or u[1] == u[2]) for u, i in done[x] for v, j in done[y])
    for x, s in sketches.items():
        for y, t in sketches.items():
            if x < y and (s == t).mean() >= 0.8 + 2 * near.MARGIN:
                assert met(x, y) == 1


def test_shortening_stops_per_item():
    """Items 0 and 1 are alike and have enough at the first step; 2 has no partner and goes on."""
    raw = np.array([[1, 1, 1], [1, 1, 1], [1, 2, 1], [1, 2, 2]], np.uint8)
    same, other = np.arange(100), np.arange(100) + 50
    sketch = np.array([same, same, other, same], np.uint16)
    asked = []

    def chance(nears):
        asked.append(len(nears))
        return np.ones((3, len(nears)))

    assert near.bucket_roots(raw, np.arange(4), sketch, [3, 2, 1], 0.8, chance, 0.9).tolist() == [0, 0, 2, 0] and asked == [1, 2]
    assert near.bucket_roots(raw[:2], np.arange(2), sketch[:2], [3, 2, 1], 0.8, chance, 0.9).tolist() == [0, 0] and asked == [1, 2, 1]
    assert near.bucket_roots(raw, np.arange(4)[::-1].copy(), sketch, [3], 0.8).tolist() == [1, 1, 2, 3]


@pytest.mark.parametrize("hubs", [2000, 5])
def test_hot_bucket_in_bounded_memory(monkeypatch, hubs):
    """Thousands of items of mutual nearness 0.64 are one part, and no list of their pairs is held."""
    import tracemalloc

    monkeypatch.setattr(near, "HUBS", hubs)
    r = np.random.default_rng(4)
    n, base = 20_000, r.integers(0, 1 << 16, 192)
    keep = r.random((n, 192)) < 0.8
    sketch = np.where(keep, base, r.integers(0, 1 << 16, (n, 192))).astype(np.uint16)
    tracemalloc.start()
    root = near.bucket_roots(np.zeros((n, 1), np.uint8), r.permutation(n), sketch, [1], 0.8, lambda x: np.ones((1, len(x))), 0.9)
    assert len(set(root.tolist())) == 1 and tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(map(tuple, near.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
