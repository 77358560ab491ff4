"""Substring dedup by paragraph MinHash banding.

Paragraphs come in two cuts.  Those by layout are the lines of LEAST words or more, and each run of
consecutive shorter lines (as in hard-wrapped text), joined, if it has as many.  Those by
content are all runs of PASSAGE words, wherever they begin, so that a passage is found inside
of any line; their MinHash is the least hash of their windows of WINDOW words, in one band of
one row, and as neighbours share it, one row stands for many.  Shorter repeats, as of a
common phrase or a license line, are no paragraphs and stay.

By layout, paragraphs of equal shingles are one item.  The bands are tuned to a high recall at
the threshold; colliding items are verified exactly on their shingles and clustered by
components (see ``near``).  By content, paragraphs that collide are verified word by word: a
later window is stretched to both sides by the words that it shares there with any earlier
place of it, and goes if PASSAGE words or more are equal.  Equal paragraphs always collide
there, so the spans hold all of every run of PASSAGE words that stands earlier.

The first paragraph of a cluster, by doc_id and place, stays; all later ones are removed,
and the merged spans of words tell what goes.  Repeats within a document count as well.

One row per document: doc_id, n_words, n_paragraphs (by layout), n_removed (merged spans),
removed_words, spans (of words, end exclusive, comma-joined), partners (doc_ids that hold the first
paragraph of a cluster by layout, or the first place of a window by content, itself not counted) and class_id, the least doc_id of all documents that such
links join with it, over any number of steps.  Null and empty texts have no paragraphs.  Rows
that share doc_id and text are the same document.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzloom.llm.common import by_slice, done_with, mixed, powers, window_hashes, written
from fuzzloom.llm.near import Bander, components, links, neighbours, searched

THRESHOLD, WIDTH, RECALL = 0.8, 5, 0.999
LEAST = 25  # words of a paragraph by layout
ROWS, SKETCH = 2, 64  # rows of a band; values of a sketch
PASSAGE, WINDOW = 50, 20  # words of a paragraph by content, and of the windows whose least hash is its MinHash
AMONG = PASSAGE - WINDOW + 1
REACH = AMONG - 1  # a shared run goes on at most so far before its next window, or ends
HOT = 100_000  # places of a window that one task compares


def tune_bands(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of so many rows that find a pair at the threshold with that probability."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


def of_runs(least: np.ufunc, h: np.ndarray, among: int) -> np.ndarray:
    """The least (or greatest) value of each run of so many, by doubling."""
    reach = 1
    while reach < among:
        step = min(reach, among - reach)
        h = least(h[step:], h[:-step])
        reach += step
    return h


def picked(h: np.ndarray, among: int = AMONG, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Places of the least hash in each run of so many (the rightmost of equals), or in all where they are fewer; low and high tell where texts that stand side by side begin and end."""
    low, high = (np.array([0]), np.array([len(h)])) if low is None else (low, high)
    size = high - low
    few = (size > 0) & (size <= among)
    at = np.array([y - 1 - int(np.argmin(h[x:y][::-1])) for x, y in zip(low[few].tolist(), high[few].tolist(), strict=True)], np.int64)
    if not (size > among).any():
        return at
    inside = np.zeros(len(h) + 1, np.int64)
    inside[low[size > among]] += 1
    inside[high[size > among] - among + 1] -= 1
    least = np.where(np.cumsum(inside)[: len(h) - among + 1] > 0, of_runs(np.minimum, h, among), 0)  # of the runs inside of a text
    none = np.zeros(among - 1, h.dtype)
    more = np.flatnonzero(h == of_runs(np.maximum, np.concatenate([none, least, none]), among))  # the least of some run that holds it
    near = np.flatnonzero((h[more[1:]] == h[more[:-1]]) & (np.diff(more) < among))
    if len(near):  # equals that runs share: a run counts for its last one
        first, then = more[near].tolist(), more[near + 1].tolist()
        alone = [bool((least[max(x - among + 1, 0) : max(y - among + 1, 0)] == h[x]).any()) for x, y in zip(first, then, strict=True)]
        more = np.delete(more, near[~np.array(alone)])
    return np.sort(np.concatenate([at, more]))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LONG, _PIECE = 64, 1 << 16  # bytes of a word that is hashed by itself, and of a text that is hashed at once


def split_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in bytes.  bytes.split() splits alike."""
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = _SPACE.take(b)
    turns = np.flatnonzero(space[1:] != space[:-1])
    return turns[::2], turns[1::2]


def hashed(b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word: a polynomial of its bytes and its length, from running sums; long words by themselves."""
    up, down = powers(_PIECE + _LONG)
    size = end - begin
    out = size.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    cuts = np.searchsorted(begin, np.arange(0, len(b) + _PIECE, _PIECE)).tolist()
    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = b[k * _PIECE : (k + 1) * _PIECE + _LONG]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * down[: len(part)], out=sums[1:])
        at = begin[x:y] - k * _PIECE
        out[x:y] += (sums[at + np.minimum(size[x:y], _LONG)] - sums[at]) * up[at]
    out = mixed(out)
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(b[begin[k] : end[k]].tobytes())
    return out


def side_by_side(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words of several texts, the first word of each and the end, and the words of each line.  An empty line stands between two texts."""
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    b = np.frombuffer(b"\n\n".join(raw), np.uint8)
    begin, end = split_words(b)
    heads = np.searchsorted(begin, np.cumsum([0, *[len(x) + 2 for x in raw]]))
    sizes = np.diff(np.concatenate([[0], np.searchsorted(begin, np.flatnonzero(b == 10)), [len(begin)]]))
    return hashed(b, begin, end), heads, sizes


def paragraphs(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first word and end of each paragraph by layout, from the hashes of all words and the words of each line; their shingles side by side; each one's first place."""
    ends = np.cumsum(sizes)
    short = np.concatenate([[False], (sizes > 0) & (sizes < LEAST), [False]])
    turns = np.flatnonzero(short[1:] != short[:-1])
    low, high = turns[::2], turns[1::2]  # runs of shorter lines; an empty line ends one
    several = high - low > 1
    start = np.concatenate([ends - sizes, (ends - sizes)[low[several]]])
    stop = np.concatenate([ends, ends[high[several] - 1]])
    enough = stop - start >= LEAST
    start, stop = start[enough], stop[enough]
    if not len(start):
        return start, stop, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = stop - start - WIDTH + 1
    first = np.cumsum(counts) - counts
    at = np.arange(int(counts.sum())) + np.repeat(start - first, counts)
    return start, stop, window_hashes(h, WIDTH)[at], first


def names(sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits of hash of each set's sorted distinct shingles."""
    n = len(first)
    ends = np.append(first, len(sets))
    owner = np.repeat(np.arange(n), np.diff(ends))
    sets, cuts = sets.copy(), ends.tolist()
    for x, y in zip(cuts, cuts[1:], strict=False):
        sets[x:y].sort()
    new = np.ones(len(sets), bool)
    new[1:] = (sets[1:] != sets[:-1]) | (owner[1:] != owner[:-1])
    raw, at = sets[new].tobytes(), (8 * np.searchsorted(owner[new], np.arange(n + 1))).tolist()
    return [xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(at, at[1:], strict=False)]


DOC, WIN, LINE = 0, 1, 2
PART = "kind int, doc_id long, tie long, start int, stop int, win long, item binary, keys array<long>, sketch binary"


def parts(docs: DataFrame, bands: int, rows: int = ROWS) -> DataFrame:
    """What one reading of the texts gives, told apart by kind.

    DOC: each document with its words (start) and paragraphs (stop); WIN: the first word and hash
    (win) of each window that is a MinHash; LINE: each paragraph by layout, with item, keys and sketch."""

    def make():
        sign = Bander(bands, rows, SKETCH)

        def f(part):
            ids, ties = part.column(0), np.asarray(part.column(1))
            h, heads, sizes = side_by_side(part.column(2))
            at, w = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            if len(h) >= WINDOW:
                w = window_hashes(h, WINDOW)
                at = picked(w, AMONG, heads[:-1], np.maximum(heads[1:] - WINDOW + 1, heads[:-1]))
            start, stop, every, first = paragraphs(h, sizes)
            of = np.arange(part.num_rows)  # rows of the slice that each kind's rows are of
            win_of, line_of = (np.searchsorted(heads, x, "right") - 1 for x in (at, start))
            words, spans = np.diff(heads), np.bincount(line_of, minlength=len(of))
            keys, sketch = sign(every, first) if len(first) else (np.zeros((0, 1), np.uint64), np.zeros((0, 1), np.uint8))
            d, m, n = len(of), len(win_of), len(line_of)
            rows = np.concatenate([of, win_of, line_of])
            none = lambda k, kind: pa.nulls(k, kind)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).ravel()))
            began = np.concatenate([words, at - heads[win_of], start - heads[line_of]]).astype(np.int32)
            ended = [pa.array(spans.astype(np.int32)), none(m, pa.int32()), pa.array((stop - heads[line_of]).astype(np.int32))]
            return {
                "kind": np.repeat(np.array([DOC, WIN, LINE], np.int32), [d, m, n]),
                "doc_id": ids.take(pa.array(rows)),
                "tie": ties[rows],
                "start": began,
                "stop": pa.concat_arrays(ended),
                "win": pa.concat_arrays([none(d, pa.int64()), pa.array(w[at].view(np.int64)), none(n, pa.int64())]),
                "item": pa.concat_arrays([none(d + m, pa.binary()), pa.array(names(every, first) if n else [], pa.binary())]),
                "keys": pa.concat_arrays([none(d + m, lists.type), lists]),
                "sketch": pa.concat_arrays([none(d + m, pa.binary()), pa.array([x.tobytes() for x in sketch[:n]], pa.binary())]),
            }

        return f

    return by_slice(docs.select("doc_id", F.xxhash64("text").alias("tie"), "text"), make, PART, 128)


def by_layout(docs: DataFrame, cut: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, tie, start, stop, first, first_tie) of all but the first paragraph by layout of each cluster."""
    spot = F.struct("doc_id", "start", "tie", "stop")
    lines = cut.filter(F.col("kind") == LINE).select("doc_id", "tie", "start", "stop", "item", "keys", "sketch")
    items = written(lines.groupBy("item").agg(F.min(spot).alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    keyed = items.select(F.explode("keys").alias("key"), "item").select(F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("path"), "item")

    def content(members: DataFrame) -> DataFrame:
        at = members.join(items.select("item", "rep"), "item")
        texts = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_own"), F.col("text").alias("whole"))
        both = at.join(texts, F.col("rep.doc_id").eqNullSafe(F.col("_doc")) & (F.col("rep.tie") == F.col("_own"))).select("unit", "side", "item", "rep.start", "rep.stop", "whole")
        return words_at(both)

    of = lines.select("doc_id", "tie", "start", "stop", F.col("item").alias("root"))
    found = links(*searched(neighbours(keyed, 8, 8), items.select("item", "sketch"), [8], threshold, np.uint8), content, threshold, WIDTH)
    if found is not None:
        roots = written(found.select("item", F.col("root").alias("least")))
        of = written(of.join(roots, F.col("root") == F.col("item"), "left").select("doc_id", "tie", "start", "stop", F.coalesce("least", "root").alias("root")))
    heads = written(of.groupBy("root").agg(F.min(spot).alias("first"), F.max(spot).alias("top")).filter(~F.col("first").eqNullSafe(F.col("top"))).drop("top"))
    return of.join(heads, "root").filter(~spot.eqNullSafe(F.col("first"))).select("doc_id", "tie", "start", "stop", F.col("first.doc_id").alias("first"), F.col("first.tie").alias("first_tie"))


def by_content(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """(doc_id, tie, start, stop, first, first_tie) of all later windows, with the words around that an earlier place has too, where these are PASSAGE words or more."""
    windows = cut.filter(F.col("kind") == WIN).select("win", "doc_id", "tie", "start")
    shared = written(neighbours(windows, 8, 8, order=["win", "doc_id", "start", "tie"]))
    often = written(shared.groupBy("win").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("win"))
    if often.isEmpty():  # the words around go straight to where windows are compared
        out = stretched(around(docs, shared))
    else:
        found = written(around(docs, shared.join(often, "win", "left_semi")))
        hot = written(found.groupBy("item", "check").agg(F.min(F.struct("doc_id", "start", "tie")).alias("first"), F.count("*").alias("n")).filter(F.col("n") > HOT))
        held = found.join(hot, ["item", "check"], "left")
        out = stretched(around(docs, shared.join(often, "win", "left_anti"))).unionByName(stretched(held.filter("n IS NULL"))).unionByName(stretched_hot(held.filter("n IS NOT NULL")))
    return out.filter(F.col("stop") - F.col("start") >= PASSAGE)


def repeats(docs: DataFrame, threshold: float = THRESHOLD, cut: DataFrame | None = None) -> DataFrame:
    """(doc_id, tie, start, stop, first, first_tie, line boolean): all later paragraphs; first is the doc_id that holds the first one, line tells those by layout.

    cut is a written table of the documents' parts, where the caller has one."""
    cut = written(parts(docs, tune_bands(threshold, RECALL, ROWS))) if cut is None else cut
    spark = docs.sparkSession
    layout = done_with(spark, lambda: by_layout(docs, cut, threshold))
    content = done_with(spark, lambda: by_content(docs, cut))
    return layout.withColumn("line", F.lit(True)).unionByName(content.withColumn("line", F.lit(False)))


AROUND = "item long, check long, doc_id long, start int, tie long, before binary, after binary"


def around(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Windows (win, doc_id, tie, start) with a second hash of their words and 32-bit hashes of the words around, nearest first."""
    per = shared.groupBy("doc_id", "tie").agg(F.collect_set("start").alias("hits"))  # a document's own windows at most
    texts = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_own"), F.col("text").alias("whole"))
    both = per.join(texts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_own"))).select("doc_id", "tie", "hits", "whole")

    def make():
        def f(part):
            h, heads, _ = side_by_side(part.column(3))
            of = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(part.column(2)), 0))
            places = np.asarray(part.column(2).flatten())
            at = heads[of] + places
            words = (h >> np.uint64(32)).astype(np.uint32)
            n, whole, ahead, back = len(h), h.tobytes(), words.tobytes(), words[::-1].tobytes()
            low, high = np.maximum(at - REACH, heads[of]), np.minimum(at + WINDOW + REACH, heads[of + 1])
            cut = list(zip(at.tolist(), low.tolist(), high.tolist(), strict=True))
            out = {
                "item": window_hashes(h, WINDOW).view(np.int64)[at] if len(at) else at,
                "check": [xxhash.xxh3_64_intdigest(whole[8 * x : 8 * (x + WINDOW)]) - (1 << 63) for x, _, _ in cut],
                "doc_id": part.column(0).take(pa.array(of)),
                "start": places,
                "tie": part.column(1).take(pa.array(of)),
                "before": [back[4 * (n - x) : 4 * (n - y)] for x, y, _ in cut],
                "after": [ahead[4 * (x + WINDOW) : 4 * y] for x, _, y in cut],
            }
            return out

        return f

    return by_slice(both, make, AROUND, 128)


class Seen:
    """Runs of words seen so far, as a tree that has nodes only where they part."""

    def __init__(self):
        self.tree: dict = {}

    def longest(self, run: array) -> int:
        """How many of its first words an earlier run begins with, too; the run counts as seen from then on."""
        node = self.tree
        for d, word in enumerate(run):
            other = node.get(word)
            if other is None:
                node[word] = run
                return d
            if isinstance(other, dict):
                node = other
                continue
            m, end = d + 1, min(len(run), len(other))
            while m < end and run[m] == other[m]:
                m += 1
            if m < end:
                inner = {other[m]: other, run[m]: run}
                for k in range(m - 1, d, -1):
                    inner = {run[k]: inner}
                node[word] = inner
            elif len(run) > m:
                node[word] = run
            return m
        return len(run)


FOUND = ["doc_id", "tie", "start", "stop", "first", "first_tie"]


def stretched(held: DataFrame) -> DataFrame:
    """(doc_id, tie, start, stop, first, first_tie) of all but the first place of each window, with the words around that an earlier place has too.

    Rows are read in the order of window and place."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        now, last, first, seen = None, None, (), ()
        for part in batches:
            out = []
            for item, check, doc_id, start, tie, *sides in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
                new, place = (item, check) != now, (doc_id, start, tie)
                if not new and place == last:  # a row that comes twice
                    continue
                last = place
                if new:
                    now, first, seen = (item, check), (doc_id, tie), (Seen(), Seen())
                before, after = (s.longest(array("I", x)) for s, x in zip(seen, sides, strict=True))
                if not new:
                    out.append((doc_id, tie, start - before, start + WINDOW + after, *first))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=FOUND)

    ordered = held.select("item", "check", "doc_id", "start", "tie", "before", "after").repartition("item", "check").sortWithinPartitions("item", "check", "doc_id", "start", "tie")
    return ordered.mapInArrow(run, "doc_id long, tie long, start int, stop int, first long, first_tie long")


def stretched_hot(held: DataFrame) -> DataFrame:
    """The same of windows with very many places, by counts only: a place shares k words on a side with an earlier one if it is not the first to have these k."""
    place = F.struct("doc_id", "start", "tie")
    levels = lambda side: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(side) / 4).cast("int"))), lambda d: F.struct(F.lit(side).alias("side"), d.alias("d"), F.xxhash64(F.substring(side, F.lit(1), d * 4)).alias("run")))
    each = held.select("item", "check", place.alias("place"), F.inline(F.concat(F.filter(levels("before"), lambda x: F.length("before") >= 4), F.filter(levels("after"), lambda x: F.length("after") >= 4))))
    firsts = each.groupBy("item", "check", "side", "d", "run").agg(F.min("place").alias("place")).groupBy("item", "check", "place").agg(*[F.min(F.when(F.col("side") == k, F.col("d") - 1)).alias(f"own_{k}") for k in ("before", "after")])
    both = held.withColumn("place", place).join(written(firsts.withColumnsRenamed({"item": "i", "check": "c", "place": "p"})), (F.col("item") == F.col("i")) & (F.col("check") == F.col("c")) & F.col("place").eqNullSafe(F.col("p")), "left")
    shared = lambda k: F.coalesce(F.col(f"own_{k}"), (F.length(k) / 4).cast("int"))
    later = both.filter(~F.col("place").eqNullSafe(F.col("first")))
    return later.select("doc_id", "tie", (F.col("start") - shared("before")).alias("start"), (F.col("start") + WINDOW + shared("after")).alias("stop"), F.col("first.doc_id").alias("first"), F.col("first.tie").alias("first_tie"))


def words_at(rows: DataFrame) -> DataFrame:
    """The rows with text: the words of whole from start to stop."""
    fields = rows.schema

    def make():
        def f(part):
            texts = []
            for start, stop, whole in zip(*(part.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                texts.append(b" ".join((whole or "").encode().split(None, stop)[start:stop]).decode())
            return {"unit": part.column(0), "side": part.column(1), "item": part.column(2), "text": texts}

        return f

    return by_slice(rows, make, f"unit {fields['unit'].dataType.simpleString()}, side int, item binary, text string", 256)


def node(doc_id: str, tie: str) -> Column:
    """A document as a number: its doc_id, or beyond all of these where it has none."""
    big = lambda x: F.col(x).cast("decimal(20,0)")
    return F.coalesce(big(doc_id), F.lit(str(2**64)).cast("decimal(20,0)") + big(tie)).cast("decimal(21,0)")


def digest(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document, as above."""
    docs = docs.select("doc_id", "text")
    cut = written(parts(docs, tune_bands(threshold, RECALL, ROWS)))
    gone = repeats(docs, threshold, cut)
    classes = components(gone.select(node("doc_id", "tie").alias("a"), node("first", "first_tie").alias("b")).distinct())
    per = gone.groupBy("doc_id", "tie").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("cuts"),  # a document's own paragraphs at most
        F.array_sort(F.collect_set("first")).alias("firsts"),
    )
    sizes = cut.filter(F.col("kind") == DOC).select("doc_id", "tie", F.col("start").cast("long").alias("n_words"), F.col("stop").cast("long").alias("n_paragraphs"))
    per = per.withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
    both = sizes.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    both = both.withColumn("id", node("doc_id", "tie")).join(classes, "id", "left")
    kind = "array<struct<start:int,stop:int>>"
    touch = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(x)))
    merged = F.aggregate(F.coalesce("cuts", F.array().cast(kind)), F.array().cast(kind), touch)
    out = both.withColumn("merged", merged).withColumn("partners", F.filter(F.coalesce("firsts", F.array().cast("array<bigint>")), lambda x: ~x.eqNullSafe(F.col("doc_id"))))
    return out.select(
        "doc_id",
        F.when(F.col("root") < F.lit(str(2**63)).cast("decimal(21,0)"), F.col("root").cast("long")).otherwise(F.col("doc_id")).alias("class_id"),
        "n_words",
        "n_paragraphs",
        F.size("merged").cast("long").alias("n_removed"),
        F.aggregate("merged", F.lit(0), lambda a, x: a + x["stop"] - x["start"]).cast("long").alias("removed_words"),
        F.array_join(F.transform("merged", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("spans"),
        "partners",
    )

