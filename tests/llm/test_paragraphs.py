"""Paragraph banding against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from test_near import sets_of

from fuzzloom.llm import paragraph_bands as pb


def layout(text):
    """(start, end, text) of a text's paragraphs by layout."""
    at, run, out = 0, [], []

    def close():
        if len(run) > 1 and run[-1][1] - run[0][0] >= pb.LEAST:
            out.append((run[0][0], run[-1][1], " ".join(x for _, _, x in run)))
        run.clear()

    for line in (text or "").split("\n"):
        n = len(line.encode().split())
        if 0 < n < pb.LEAST:
            run.append((at, at + n, line))
        else:
            close()
            if n:
                out.append((at, at + n, line))
        at += n
    close()
    return out


def brute(rows):
    """doc_id -> (spans, first holders, all earlier holders), by all pairs of distinct paragraphs and by all runs of PASSAGE words."""
    paras = [((doc_id, a, b), sets_of(x)) for doc_id, text in rows for a, b, x in layout(text)]
    distinct = list(dict.fromkeys(s for _, s in paras))
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if len(a & b) >= 0.8 * len(a | b) - 1e-12:
                root[find(a)] = find(b)
    first, gone, partners = {}, defaultdict(set), defaultdict(set)
    for (doc_id, a, b), s in sorted(paras, key=lambda x: x[0]):
        if find(s) in first:
            gone[doc_id] |= set(range(a, b))
            partners[doc_id].add(first[find(s)])
        else:
            first[find(s)] = doc_id
    held, every = {}, defaultdict(set, {k: set(v) for k, v in partners.items()})
    for doc_id, text in sorted(rows, key=lambda x: x[0]):
        w = (text or "").encode().split()
        for i in range(len(w) - pb.PASSAGE + 1):
            run = tuple(w[i : i + pb.PASSAGE])
            if run in held:
                gone[doc_id] |= set(range(i, i + pb.PASSAGE))
                partners[doc_id].add(min(held[run]))
                every[doc_id] |= held[run]
            held.setdefault(run, set()).add(doc_id)
    out = {}
    for doc_id, _ in rows:
        spans = []
        for k in sorted(gone[doc_id]):
            if spans and spans[-1][1] == k:
                spans[-1][1] += 1
            else:
                spans.append([k, k + 1])
        out[doc_id] = ",".join(f"{a}:{b}" for a, b in spans), partners[doc_id] - {doc_id}, every[doc_id]
    return out


def corpus():
    r = random.Random(13)
    word = lambda: f"w{r.randint(0, 10**7)}"
    line = lambda n: " ".join(word() for _ in range(n))
    docs = ["\n".join(line(r.randint(3, 60)) for _ in range(r.randint(1, 8))) for _ in range(60)]
    pool, phrase = [line(40) for _ in range(4)], line(9)
    for k in range(20):
        w = pool[k % 4].split()
        if k >= 8:
            w[r.randrange(40)] = word()
        docs[k] += "\n" + " ".join(w)
    passage = line(51)
    for k in range(30, 34):  # in the middle of lines, over a line break
        docs[k] = f"{line(20)} {passage} {line(30)}" if k % 2 else f"{line(9)}\n{line(14)} {passage.replace(' ', chr(10), 1)} {line(3)}"
    hot = line(70)
    for k in range(34, 60):
        docs[k] += f"\n{phrase}\n{line(r.randint(0, 40))} {hot} {line(r.randint(0, 40))}"
    docs[22] += "\n" + docs[22] + "\n" + line(4) + " " + hot
    return list(enumerate(docs)) + [(100, None), (101, ""), (102, "a\nb")]


@pytest.mark.parametrize("hot", [2048, 3])
def test_digest(spark, none, monkeypatch, hot):
    monkeypatch.setattr(pb, "HOT", hot)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, want = {r["doc_id"]: r for r in pb.digest(df).collect()}, brute(rows)
    assert {k: r["spans"] for k, r in got.items()} == {k: x[0] for k, x in want.items()}
    for doc_id, text in rows:
        assert want[doc_id][1] <= set(got[doc_id]["partners"]) <= want[doc_id][2]
        spans = [tuple(map(int, x.split(":"))) for x in want[doc_id][0].split(",") if x]
        assert got[doc_id]["n_removed"] == len(spans) and got[doc_id]["removed_words"] == sum(b - a for a, b in spans)
        assert got[doc_id]["n_words"] == len((text or "").split()) and got[doc_id]["n_paragraphs"] == len(layout(text))
    assert sum(1 for x in want.values() if x[0]) > 30 and pb.digest(none).count() == 0


def test_whole_runs(spark):
    r = random.Random(29)
    line = lambda n: [f"w{r.randint(0, 10**9)}" for _ in range(n)]
    hot, run = line(22), line(51)
    long = line(40) + hot + line(45)
    docs = [line(30) + hot + line(40), line(60) + run + line(70), line(90) + long + line(80), line(33) + run + line(44), line(5) + long + line(95), run + line(64)]
    rows = [(k, " ".join(x)) for k, x in enumerate(docs)]
    out = {x["doc_id"]: x["spans"] for x in pb.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [out[k] for k in range(6)] == ["", "", "", "33:84", "5:112", "0:51"]


def test_classes(spark):
    r = random.Random(31)
    line = lambda n=30: " ".join(f"w{r.randint(0, 10**9)}" for _ in range(n))
    a, b, c, d, e, f = (line() for _ in range(6))
    rows = [(1, f"{a}\n{line()}"), (2, f"{a}\n{b}"), (3, f"{b}\n{c}"), (4, f"{line()}\n{c}"), (5, d), (6, line()), (None, f"{d}\n{e}"), (None, f"{line()}\n{f}"), (7, f"{line()}\n{e}"), (8, f), (9, f)]
    out = pb.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {x["doc_id"]: (x["class_id"], x["partners"]) for x in out if x["doc_id"] is not None}
    assert got == {1: (1, []), 2: (1, [1]), 3: (1, [2]), 4: (1, [3]), 5: (5, []), 6: (6, []), 7: (5, []), 8: (8, []), 9: (8, [])}
    assert sorted(x["class_id"] for x in out if x["doc_id"] is None) == [5, 8]


def test_short_lines(spark):
    r = random.Random(37)
    line = lambda n: [f"w{r.randint(0, 10**9)}" for _ in range(n)]
    wrap = lambda x: "\n".join(" ".join(x[i : i + 8]) for i in range(0, len(x), 8))
    block, few, own = line(60), " ".join(line(6)), " ".join(line(9))
    near = [*block[:30], "other", *block[31:]]
    texts = [f"{wrap(block)}\n\n{few}", f"{' '.join(line(30))}\n{wrap(near)}\n\n{' '.join(line(25))}", f"{' '.join(line(25))}\n{few}", f"b\n{own}", f"{own}\nb", f"{' '.join(near)}"]
    out = {x["doc_id"]: x for x in pb.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [out[k]["spans"] for k in range(6)] == ["", "30:90", "", "", "", "0:60"]
    assert [out[k]["partners"] for k in range(6)] == [[], [0], [], [], [], [0, 1]]


def test_longest_seen():
    r = random.Random(3)
    for _ in range(200):
        seen, runs = pb.Seen(), []
        for _ in range(30):
            run = [r.randint(0, 1) for _ in range(r.randint(0, 8))]
            want = max((next((i for i, (a, b) in enumerate(zip(run, x, strict=False)) if a != b), min(len(run), len(x))) for x in runs), default=0)
            assert seen.longest(pb.array("I", run)) == want
            runs.append(run)


def test_odd(odd, odd_rows):
    assert pb.digest(odd).count() == len(odd_rows)


def test_windows_are_shared():
    r = np.random.default_rng(3)
    for _ in range(50):
        shared = r.integers(0, 1 << 62, 50 - pb.WINDOW + 1, dtype=np.uint64)
        a, b = (np.concatenate([r.integers(0, 1 << 62, n, dtype=np.uint64), shared, r.integers(0, 1 << 62, n, dtype=np.uint64)]) for n in (40, 77))
        assert set(a[pb.picked(a)]) & set(b[pb.picked(b)]) & set(shared)
    for n in (1, 5, 31, 32, 100):
        h = r.integers(0, 9, n, dtype=np.uint64)
        want = {max(j for j in range(i, i + min(31, n)) if h[j] == h[i : i + min(31, n)].min()) for i in range(n - min(31, n) + 1)}
        assert set(pb.picked(h).tolist()) == want


def test_tuning():
    assert pb.tune_bands(0.8, 0.999, 2) == 7 and pb.tune_bands(0.8, 0.999, 3) == 10


def test_wide_windows_from_running_sums():
    """The same values as word by word, at any width and length."""
    from fuzzloom.llm import common

    r = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 20, 51, 3000):
        h = r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(3)
        for width in (1, 5, 8, 20, 50):
            w = min(width, n)
            want = [sum(int(x) * pow(common._C, w - 1 - k, 1 << 64) for k, x in enumerate(h[i : i + w])) + w for i in range(n - w + 1)]
            got = common.window_hashes(h, width)
            assert (got == common.mixed(np.array([x % (1 << 64) for x in want], np.uint64))).all()


def test_texts_side_by_side():
    """Many texts are read at once: each word's hash is its own, wherever it stands, and lines and windows end with their text."""
    import pyarrow as pa

    r = random.Random(37)
    word = lambda: "".join(r.choice("abé\x00\x1c　") for _ in range(r.choice([1, 2, 3, 63, 64, 65, 70])))
    texts = [None, "", " ", "\n", "\n\na", "a\x0bb\x0cc\rd\n" + "x" * 300, "ab " * 50_000, "z" * 70_000 + " y", *["".join(word() + r.choice([" ", "\t", "\n", "\n\n "]) for _ in range(r.randint(0, 90))) for _ in range(200)], None]
    h, heads, sizes = pb.side_by_side(pa.array(texts, pa.string()))
    seen, words = {}, [(x or "").encode().split() for x in texts]
    assert np.diff(heads).tolist() == list(map(len, words)) and sizes.sum() == len(h) and len(sizes) == sum((x or "").count("\n") + 1 for x in texts) + len(texts) - 1
    assert all(seen.setdefault(w, x) == x for w, x in zip([w for ws in words for w in ws], h.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    start, stop, sets, first = pb.paragraphs(h, sizes)
    of = np.searchsorted(heads, start, "right") - 1
    got = sorted(zip(of.tolist(), (start - heads[of]).tolist(), (stop - heads[of]).tolist(), strict=True))
    assert got == sorted((k, a, b) for k, x in enumerate(texts) for a, b, p in layout(x) if b - a >= pb.LEAST)
    at = r.choices(range(4), k=len(h))  # many equals
    w, low, high = np.array(at, np.uint64) + np.uint64(1), heads[:-1], np.maximum(heads[1:] - 19, heads[:-1])
    want = set()
    for x, y in zip(low.tolist(), high.tolist(), strict=True):
        for run in range(x, max(y - pb.AMONG, x) + 1) if y > x else ():
            want.add(max(range(run, min(run + pb.AMONG, y)), key=lambda k: (-at[k], k)))
    assert pb.picked(w, pb.AMONG, low, high).tolist() == sorted(want)
