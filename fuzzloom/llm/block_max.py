"""Ranked lexical search by block-max WAND.

The index.  Documents are dealt to segments, each of at most SEGMENT terms unless one document
has more, and numbered in a segment by doc_id.  A term's postings in a segment are cut into
blocks of BLOCK; a block is one row of a Parquet table: first and last document, number of
postings, the greatest impact in it, and the postings themselves, compressed by frame of
reference (offsets from the first document and frequencies, in as few bytes as the block
needs).  A posting's impact is (10^9 tf) div (1000 tf + 8 m), m from the document's length
and the corpus totals, so the stored maxima are exact integers.

The search.  A task holds one segment with its postings compressed, and streams the items by
it from their written table.  For an item, the ends of all its terms' blocks cut the segment
into windows, in each of which every term has one block at most.  Shallow pointer moves, which
touch first, last and greatest impact only, give each window the sum of its blocks' weighted
maxima.  A window is a pivot only if this sum reaches the threshold; the others are skipped and
their blocks stay compressed.  Windows are taken by falling sums, and each lot raises the
threshold to the tenth best score so far, until no sum reaches it.  One segment in SCOUTS
is searched first, and the tenth best score found there is where the other segments start.  All
thresholds are scores of found documents, so no document of the ten best is skipped, ties
included.

Results: an item's ten best documents with a score above 0, higher scores first, then
smaller doc_ids, a null doc_id last.  Rows that repeat a doc_id or a whole row are ranked each
on their own; between equal doc_ids the text's hash decides.  A null or termless text is in no
result and counts nowhere.  An item without terms has no result; items that repeat an item_id
are searched each on their own, and rows of a null item_id, too.  Only doc_id, text and
item_id, text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.llm.common import new_folder, rows_in_slices, stored_batches, written

BLOCK, SEGMENT, SCOUTS, BEST = 128, 4_000_000, 16, 10
#: ASCII letters and digits and all bytes of other characters stay, A-Z in lower case; the rest parts terms.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
_WIDTHS = (1, 2, 4)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text, with repeats."""
    return (text or b"").translate(FOLD).split()


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def run(batches):
        some = every = 0
        for part in rows_in_slices(batches):
            n = [len(terms(x)) for x in part.column(0).to_pylist()]
            some, every = some + sum(map(bool, n)), every + sum(n)
        yield pa.RecordBatch.from_pydict({"some": [some], "every": [every]})

    got = docs.select(F.col("text").cast("binary")).mapInArrow(run, "some long, every long").agg(F.sum("some"), F.sum("every")).first()
    return got[0] or 0, got[1] or 0


class _Numbers(dict):
    """Numbers of terms, by first sight."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def _pack(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Little-endian values of so many bytes each, at their places."""
    for w in _WIDTHS:
        pick = width == w
        a, v = at[pick], values[pick]
        for k in range(w):
            out[a + k] = (v >> (8 * k)) & 255


def _unpack(raw: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for w in _WIDTHS:
        pick = width == w
        a = at[pick]
        out[pick] = sum(raw[a + k].astype(np.int64) << (8 * k) for k in range(w)) if len(a) else 0
    return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _runs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n values: each value's run, and its place in it."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


SCHEMA = "segment long, term binary, first int, last int, n int, top long, wide int, data binary"


def segment_rows(number: int, ids: list, ties: list, each: list[np.ndarray], names: list[bytes], some: int, every: int) -> Iterator[pa.RecordBatch]:
    """The rows of a segment: one without a term for its documents, then its blocks by term and document."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, ties[i]))
    length = np.array([len(each[i]) for i in order], np.int64)
    m = np.array([25 + 75 * int(x) * some // every for x in length], np.int64)
    docs = np.rec.fromarrays([np.array([ids[i] or 0 for i in order], np.int64), np.array([ids[i] is None for i in order], np.int8), np.array([ties[i] for i in order], np.int64), m])
    kinds = {"segment": pa.int64(), "term": pa.binary(), "first": pa.int32(), "last": pa.int32(), "n": pa.int32(), "top": pa.int64(), "wide": pa.int32(), "data": pa.binary()}
    batch = lambda *columns: pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))
    yield batch([number], [None], [0], [len(ids)], [len(ids)], [0], [0], [docs.tobytes()])

    rank = np.empty(len(names), np.int64)
    by_name = sorted(range(len(names)), key=names.__getitem__)
    rank[by_name] = np.arange(len(names))
    key, tf = np.unique(rank[np.concatenate([each[i] for i in order])] * len(ids) + np.repeat(np.arange(len(ids)), length), return_counts=True)
    term, doc = np.divmod(key, len(ids))
    held = np.bincount(term, minlength=len(names))
    _, place = _runs(held)
    start = np.flatnonzero(place % BLOCK == 0)
    n = np.diff(np.append(start, len(doc)))
    of, within = _runs(n)
    first, last = doc[start], doc[start + n - 1]
    offset = doc - first[of]
    wide_doc, wide_tf = _width(last - first), _width(np.maximum.reduceat(tf, start))
    ends = np.cumsum(n * (wide_doc + wide_tf))
    begin = ends - n * (wide_doc + wide_tf)
    data = np.zeros(ends[-1], np.uint8)
    _pack(data, begin[of] + within * wide_doc[of], offset, wide_doc[of])
    _pack(data, begin[of] + (n * wide_doc)[of] + within * wide_tf[of], tf, wide_tf[of])
    top = np.maximum.reduceat(impacts(tf, m[doc]), start)
    for at in range(0, len(start), 16_384):
        cut = slice(at, at + 16_384)
        lows = np.append(begin[cut], ends[cut][-1]) - begin[at]
        packed = pa.Array.from_buffers(pa.binary(), len(lows) - 1, [None, pa.py_buffer(lows.astype(np.int32).tobytes()), pa.py_buffer(data[begin[at] : ends[cut][-1]].tobytes())])
        yield batch(np.full(len(lows) - 1, number), [names[by_name[t]] for t in term[start[cut]].tolist()], first[cut].astype(np.int32), last[cut].astype(np.int32), n[cut].astype(np.int32), top[cut], (16 * wide_doc + wide_tf)[cut].astype(np.int32), packed)


def build(docs: DataFrame, some: int, every: int, segment: int = SEGMENT) -> DataFrame:
    """The index's rows (SCHEMA), written; a segment's number is its task's and its place in that task, whatever runs again."""

    def run(batches):
        pid, made = TaskContext.get().partitionId(), 0
        ids, ties, each, words, held = [], [], [], _Numbers(), 0
        for part in rows_in_slices(batches, 128):
            for doc, tie, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                got = terms(text)
                if not got:
                    continue
                ids.append(doc)
                ties.append(tie)
                each.append(np.fromiter(map(words.__getitem__, got), np.int64, len(got)))
                held += len(got)
                if held >= segment:
                    yield from segment_rows((pid << 32) + made, ids, ties, each, list(words), some, every)
                    made, ids, ties, each, words, held = made + 1, [], [], [], _Numbers(), 0
        if ids:
            yield from segment_rows((pid << 32) + made, ids, ties, each, list(words), some, every)

    return written(docs.select("doc_id", F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA))


def weighted_items(items: DataFrame, index: DataFrame, some: int, path: str) -> DataFrame:
    """(item, item_id, terms, weights) of the items' terms that the index holds, written to path; weights count repeats."""

    def run(batches):
        for part in rows_in_slices(batches):
            rows = [(item, i, t) for item, i, x in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True) for t in terms(x)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["item", "item_id", "term"])

    numbered = written(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")))
    asked = written(numbered.mapInArrow(run, "item long, item_id long, term binary").groupBy("item", "item_id", "term").agg(F.count("*").alias("repeats")))
    df = index.filter("term is not null").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").cast("long").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * some + 2) / (2.0 * F.col("df") + 1))).cast("long")
    each = asked.join(df, "term").select("item", "item_id", F.struct("term", (weight * F.col("repeats")).alias("w")).alias("t"))
    gathered = each.filter("t.w > 0").groupBy("item", "item_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))  # an item's own terms
    return written(gathered.select("item", "item_id", F.col("ts.term").alias("terms"), F.col("ts.w").alias("weights")), path=path)


class _Postings:
    """A term's blocks in a segment; postings are decompressed on demand, a block once."""

    def __init__(self, first, last, n, top, wide, data, m):
        self.first, self.last, self.n, self.top, self.m = first, last, n, top, m
        self.doc_width, self.tf_width = wide // 16, wide % 16
        self.raw = np.frombuffer(b"".join(data), np.uint8)
        size = n * (self.doc_width + self.tf_width)
        self.at, self.start = np.cumsum(size) - size, np.cumsum(n) - n
        self.open = np.zeros(len(n), bool)
        self.docs = self.gain = np.zeros(0, np.int64)

    def read(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the picked blocks."""
        if not len(self.docs):
            self.docs, self.gain = np.zeros(int(self.n.sum()), np.int32), np.zeros(int(self.n.sum()), np.int32)
        new = np.flatnonzero(pick & ~self.open)
        if len(new):
            of, place = _runs(self.n[new])
            of = new[of]
            to = self.start[of] + place
            docs = self.first[of] + _unpack(self.raw, self.at[of] + place * self.doc_width[of], self.doc_width[of])
            tf = _unpack(self.raw, self.at[of] + self.n[of] * self.doc_width[of] + place * self.tf_width[of], self.tf_width[of])
            self.docs[to], self.gain[to] = docs, impacts(tf, self.m[docs])
            self.open[new] = True
        if pick.all():
            return self.docs, self.gain
        held = np.repeat(pick, self.n)
        return self.docs[held], self.gain[held]


def search_segment(lists: dict[bytes, _Postings], names: list[bytes], weights: list[int], need: int, best: int = BEST) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of an item's best documents in a segment with a score of need or more, best first, then by number."""
    mine = [(lists[t], w) for t, w in zip(names, weights, strict=True) if t in lists]
    none = np.zeros(0, np.int64)
    if not mine:
        return none, none
    first, after, most = (np.concatenate(x) for x in zip(*((p.first, p.last + 1, p.top * w) for p, w in mine), strict=True))
    edges = np.unique(np.concatenate([first, after]))
    low, high = np.searchsorted(edges, first), np.searchsorted(edges, after)
    bound = np.zeros(len(edges), np.int64)
    np.add.at(bound, low, most)
    np.subtract.at(bound, high, most)
    bound = np.cumsum(bound)[:-1]
    order = np.argsort(-bound, kind="stable")
    docs, scores, at, size = none, none, 0, 16
    while at < len(order) and bound[order[at]] >= need:
        lot = order[at : at + size]
        live = np.zeros(len(edges), bool)
        live[lot[bound[lot] >= need]] = True
        before = np.concatenate([[0], np.cumsum(live)])
        hit = before[high] > before[low]
        found, gains, k = [], [], 0
        for p, w in mine:
            pick = hit[k : k + len(p.n)]
            k += len(p.n)
            if pick.any():
                d, g = p.read(pick)
                found.append(d)
                gains.append(g.astype(np.int64) * w)
        d, g = np.concatenate(found), np.concatenate(gains)
        inside = live[np.searchsorted(edges, d, side="right") - 1]
        d, g = d[inside], g[inside]
        d, code = np.unique(d, return_inverse=True)
        total = np.zeros(len(d), np.int64)
        np.add.at(total, code, g)
        keep = total >= need
        docs, scores = np.concatenate([docs, d[keep]]), np.concatenate([scores, total[keep]])
        top = np.lexsort((docs, -scores))[:best]
        docs, scores = docs[top], scores[top]
        if len(docs) == best:
            need = max(need, int(scores[-1]))
        at, size = at + size, size * 4
    return docs, scores


def _found(rows: DataFrame, items_at: str, best: int) -> DataFrame:
    """(item, item_id, doc_id, tie, score) of the best documents of each segment, from index rows with their segment's documents."""

    def run(batches):
        now, docs, blocks = None, None, {}

        def done():
            if docs is None or not blocks:
                return
            lists = {t: _Postings(*(np.array(x, np.int64) for x in list(zip(*b, strict=True))[:5]), [x[5] for x in b], docs["f3"]) for t, b in blocks.items()}
            for part in stored_batches(items_at, ["item", "item_id", "terms", "weights", "need"], 256):
                rows = []
                for item, item_id, names, weights, need in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    d, s = search_segment(lists, names, weights, need, best)
                    rows += [(item, item_id, None if docs["f1"][x] else int(docs["f0"][x]), int(docs["f2"][x]), int(y)) for x, y in zip(d.tolist(), s.tolist(), strict=True)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "item_id", "doc_id", "tie", "score"])

        for part in batches:
            for segment, term, *block in zip(*(part.column(i).to_pylist() for i in range(8)), strict=True):
                if segment != now:
                    yield from done()
                    now, docs, blocks = segment, None, {}
                if term is None:
                    docs = np.frombuffer(block[5], np.dtype([("f0", np.int64), ("f1", np.int8), ("f2", np.int64), ("f3", np.int64)]))
                else:
                    blocks.setdefault(term, []).append(block)
        yield from done()

    dealt = rows.repartition("segment").sortWithinPartitions("segment", "term", "first")
    return dealt.mapInArrow(run, "item long, item_id long, doc_id long, tie long, score long")


def _ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "tie")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, segment: int = SEGMENT) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's best documents."""
    some, every = totals(docs)
    index = build(docs, some, every, segment)
    spark, path = docs.sparkSession, new_folder(docs.sparkSession)
    asked = weighted_items(items, index, some, path)
    words = asked.select(F.explode("terms").alias("term")).distinct()
    # blocks of asked terms only; Spark broadcasts the terms where they are few
    rows = written(index.filter("term is null").unionByName(index.join(words, "term", "left_semi").select(*index.columns)))
    scout = F.pmod(F.xxhash64("segment"), F.lit(SCOUTS)) == 0

    def among(part: DataFrame, known: DataFrame) -> DataFrame:
        at = new_folder(spark)
        written(known, path=at)
        return written(_ranked(_found(part, at, best), best).drop("rank"))

    first = among(rows.filter(scout), asked.withColumn("need", F.lit(1).cast("long")))
    tenth = _ranked(first, best).filter(F.col("rank") == best).select("item", F.col("score").alias("need"))
    rest = among(rows.filter(~scout), asked.join(tenth, "item", "left").withColumn("need", F.coalesce("need", F.lit(1)).cast("long")))
    return _ranked(first.unionByName(rest), best).select("item_id", "rank", "doc_id", "score")


def weight(some: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * some + 2) / (2 * df + 1)))


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, hash(text) AS tie,
           translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM documents),
tf AS (SELECT r, doc_id, tie, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
    SELECT item_id,
           translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM benchmark),
asked AS (
    SELECT item_id, term, count(*) * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM q JOIN df USING (term), total GROUP BY item_id, term, df, docs),
scored AS (
    SELECT item_id, r, doc_id, tie,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN n USING (r), total GROUP BY item_id, r, doc_id, tie)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, tie))::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
