"""WARC archives with their capture index, and block-max search, against plain forms."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from fuzzloom.llm import block_max, capture_index
from fuzzloom.llm.common import new_folder, store

PAGES = "page_id long, url string, html string, key string, text string, mark binary, n long"


@pytest.fixture(scope="module")
def pages():
    r = random.Random(3)
    rows = [(i, f"http://www.h{i % 7}.example.org:80/p{i % 11}?b=2&a=1#x", "x" * (i % 5) + "é" * (i % 3)) for i in range(120)]
    rows += [(None, "http://a.b/", "xx"), (None, None, None), (500, None, ""), (501, "not a url\nat all", "new"), (502, "http://h.org/ü ü", "y" * 200_000)]
    rows += [(503, "http://same.org/", "same")] * 40 + [(504, "http://same.org/", "same"), (504, "http://other.org/", "same")]
    r.shuffle(rows)
    return [(*x, "k", "t", b"m", 1) for x in rows]


def plain_captures(pages, least=0):
    sets, out = {}, []
    for i, u, h, *_ in pages:
        sets.setdefault(h or "", []).append((i is not None, i or 0, u is not None, u or ""))
    for h, rows in sets.items():
        raw = h.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        best = max(rows)
        for k, x in enumerate(sorted(rows, reverse=True)):
            alone = k == 0 or len(raw) < least
            out.append((x[1] if x[0] else None, len(raw), digest, "response" if alone else "revisit", None if alone or not best[0] else best[1]))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 3])
def test_captures(spark, pages, least):
    df = spark.createDataFrame(pages, PAGES).repartition(5)
    assert Counter(map(tuple, capture_index.capture_digest(df, least).collect())) == plain_captures(pages, least)


def test_no_captures(spark):
    got = capture_index.capture_digest(spark.createDataFrame([], PAGES))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and got.isEmpty()


def test_two_level_lookup(spark, monkeypatch):
    """Blocks of few lines, a key that goes over many of them, and keys that are not held."""
    monkeypatch.setattr(capture_index, "BLOCK", 4)
    rows = [(f"org,{'h' * (i % 9)})/{i % 3}".encode(), i % 13, "response", "a", i, 1) for i in range(300)] + [(b"z)/", 7, "revisit", "b", i, 1) for i in range(50)]
    places = spark.createDataFrame(rows, capture_index.PLACES)
    folder = new_folder(spark)
    shards = capture_index.write_index(places, folder)
    wanted = sorted({x[:2] for x in rows}) + [(b"a", 1), (b"zz", 1), (b"z)/", 8), (b"org,)/0", None)]
    got = capture_index.lookup(shards, spark.createDataFrame(wanted, "key binary, page_id long"), folder)
    assert Counter((r["page_id"], r["kind"], r["file"], r["offset"]) for r in got.collect()) == Counter(x[1:5] for x in rows)
    row = shards.first()
    shard = capture_index.Shard(folder, row["lines"], row["directory"])
    assert all(a <= b for a, b in zip(shard.first, shard.first[1:])) and all(len(shard.read(b)[0]) <= 4 for b in range(len(shard.first)))


def test_archives_are_warc(spark, pages):
    folder = new_folder(spark)
    places = capture_index.write_archives(capture_index.records(spark.createDataFrame(pages, PAGES)), folder)
    fs, at = store(folder)
    names = {r["file"] for r in places.collect()}
    kinds = Counter()
    for name in names:
        with fs.open_input_file(f"{at}/{name}") as file:
            raw = gzip.decompress(file.read())  # an archive is its members, one after the other
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and rest[int(fields["Content-Length"]) :][:4] == b"\r\n\r\n"
            kinds[fields["WARC-Type"]] += 1
            raw = rest[int(fields["Content-Length"]) + 4 :]
    assert kinds["response"] + kinds["revisit"] == len(pages) and kinds["warcinfo"] == len(names)


def test_keys():
    assert capture_index.surt("HTTPS://u:p@www2.Blog.Example.org:443/a/b?z=1&a=2#f") == b"org,example,blog)/a/b?a=2&z=1"
    assert capture_index.surt("http://example.org:8080") == b"org,example:8080)/" and capture_index.surt(None) == b"-"
    assert b"\n" not in capture_index.surt("x\ny z") and capture_index.surt("") == b"-"


def plain_search(docs, items, best=10):
    import re

    cut = lambda x: [t.translate({k: k + 32 for k in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", x or "")]
    held = [(i, Counter(t), len(t)) for i, x in docs if (t := cut(x))]
    n, every = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 25 + 75 * size * n // every
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in cut(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if x[1] else x[2], -x[0]) for k, x in enumerate(sorted(scores)[:best])]
    return Counter(out)


@pytest.fixture(scope="module")
def corpus(odd_rows):
    r = random.Random(8)
    words = [f"W{i}" for i in range(60)] + ["É漢", "ß9", "a", "b"]
    text = lambda: " ".join(words[min(len(words) - 1, int(r.expovariate(0.12)))] + r.choice(["", ",", "-", "\n"]) for _ in range(r.randint(1, 90)))
    docs = [(100 + i, text()) for i in range(400)]
    docs += [(i, docs[0][1]) for i in range(30)] + [docs[3]] * 25 + [(None, docs[5][1])] * 2 + [(x[0], x[1]) for x in odd_rows]
    items = [(i, text()) for i in range(25)] + [(3, text()), (None, "w1 w2"), (90, None), (91, ""), (92, "unheard"), (93, "a a a W1 b"), (94, docs[0][1] * 3)]
    return docs, items


@pytest.mark.parametrize("segment", [60, 3000, 10**7])
def test_search(spark, corpus, segment, monkeypatch):
    monkeypatch.setattr(block_max, "BLOCK", 8)
    docs, items = corpus
    clash = lambda rows, c: spark.createDataFrame([(*x, 1, "t", 2) for x in rows], f"{c} long, text string, segment int, term string, score int")
    got = block_max.search(clash(docs, "doc_id").repartition(3), clash(items, "item_id"), segment=segment)
    assert Counter(map(tuple, got.collect())) == plain_search(docs, items)


def test_search_nothing(spark):
    empty = lambda c: spark.createDataFrame([], f"{c} long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert block_max.search(empty("doc_id"), some).isEmpty() and block_max.search(some.withColumnRenamed("item_id", "doc_id"), empty("item_id")).isEmpty()


def test_blocks_are_skipped(spark):
    """With a high threshold most blocks stay compressed, and the best documents are the same."""
    r = np.random.default_rng(2)
    each = [np.concatenate([r.integers(0, 50, 40), np.full(5 if 2000 <= i < 2030 else 0, 60)]) for i in range(4000)]
    some, every = len(each), sum(map(len, each))
    rows = [x for part in block_max.segment_rows(1, list(range(4000)), [0] * 4000, each, [b"t%d" % i for i in range(61)], some, every) for x in part.to_pylist()]
    m = np.frombuffer(rows[0]["data"], np.dtype([("f0", np.int64), ("f1", np.int8), ("f2", np.int64), ("f3", np.int64)]))["f3"]

    def lists():
        out = {}
        for x in rows[1:]:
            out.setdefault(x["term"], []).append([x[k] for k in ("first", "last", "n", "top", "wide", "data")])
        return {t: block_max._Postings(*(np.array(c, np.int64) for c in list(zip(*b))[:5]), [x[5] for x in b], m) for t, b in out.items()}

    names, weights = [b"t1", b"t2", b"t60"], [300, 300, 5000]
    free, bound = lists(), lists()
    docs, scores = block_max.search_segment(free, names, weights, 1)
    again = block_max.search_segment(bound, names, weights, int(scores[-1]))
    assert docs.tolist() == again[0].tolist() and scores.tolist() == again[1].tolist()
    assert bound[b"t1"].open.mean() < 0.7 and bound[b"t60"].open.any()
