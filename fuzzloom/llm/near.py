"""What the near-duplicate operators share: signatures, candidate hubs, exact verification, components.

An item is a distinct set of word shingles, named by 128 bits of hash; equal sets are one
item, so copies never meet each other.  Items that share a key form a bucket.  A bucket's
least item is its hub, and only (hub, item) pairs are looked at.  Let h be the hub and x, y two
members with J(x, y) >= t.  By the triangle inequality of the Jaccard distance, if
J(h, x) >= 2t - 1 then J(h, y) >= 3t - 2.  So members as near to a hub as 2t - 1 leave the
bucket, members as near as 3t - 2 are joined with it, and the others elect the next hub, until
the bucket holds one at most.  These nearnesses come from sketches, with a margin of MARGIN
(four standard errors of 192 values, 2.4 of 64).  A task does this for one bucket at a time
and tells one row for each item; buckets of over NODE items do the same in rounds over all
tasks, with twice as many hubs in each.

Items that are joined in any bucket, over any number of steps, are a group.  Groups are
compared exactly, as products of incidence blocks; what leaves a block is a row per item.  A
group of over BLOCK items is cut into blocks of neighbours, and two blocks are compared only
if some bucket has items of both: work grows with buckets, not with the square of a chain of
them.  Classes are components of verified links only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzloom.llm.common import mixed, rows_in_slices, shingles, written

MARGIN = 0.15
BLOCK = 768  # items of a block in the exact comparison
NODE = 50_000  # items of a bucket that one task searches
HUBS = 2_000  # hubs of a branch, before its items are one part
_U64 = np.uint64


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(20240229))
    draw = r.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return (draw[0] << _U64(1) | _U64(1))[:, None], draw[1][:, None]


def minima(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of each function over the shingles, by chunks that stay in cache."""
    out = np.full(a.shape[0], 0xFFFFFFFFFFFFFFFF, _U64)
    for at in range(0, len(sets), 256):
        x = sets[at : at + 256, None] * a.T
        x += b.T
        np.minimum(out, x.min(axis=0), out=out)
    return out >> _U64(32)


class Signer:
    """MinHash signatures of shingle sets: so many labels a tree, for so many trees, side by side."""

    def __init__(self, trees: int, depth: int):
        self.a, self.b = _constants(trees * depth)

    def __call__(self, sets: np.ndarray) -> tuple[bytes, bytes]:
        """A set's name and its labels, 16 bits each; none of an empty set."""
        return xxhash.xxh3_128_digest(sets.tobytes()), minima(sets, self.a, self.b).astype(np.uint16).tobytes() if len(sets) else b""


class Bander:
    """Band keys and sketches of shingle sets: bands of so many rows, and a sketch of 8-bit minima."""

    def __init__(self, bands: int, rows: int, sketch: int):
        self.bands, self.rows = bands, rows
        self.a, self.b = _constants(max(sketch, bands * rows))
        self.salt = mixed(np.arange(1, bands + 1, dtype=_U64) * _U64(0xA24BAED4963EE407))

    def __call__(self, windows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of several sets that stand side by side, from their first places on."""
        low = np.empty((len(starts), len(self.a)), _U64)
        held = np.empty_like(windows)
        for k in range(len(self.a)):  # one function at a time stays in cache
            np.multiply(windows, self.a[k], out=held)
            np.add(held, self.b[k], out=held)
            low[:, k] = np.minimum.reduceat(held, starts)
        low >>= _U64(32)
        rows = low[:, : self.bands * self.rows].reshape(len(starts), self.bands, self.rows)
        key = np.tile(self.salt, (len(starts), 1))
        for k in range(self.rows):
            key = mixed(key * _U64(0x9E3779B97F4A7C15) + rows[:, :, k])
        return key, low.astype(np.uint8)


def neighbours(rows: DataFrame, size: int, prefix: int, order: tuple[str, ...] = ("path", "item")) -> DataFrame:
    """The rows whose first column of order shares its first prefix bytes with another row's: a binary of size bytes, or a long.

    Rows are sorted over all partitions in the given order, and a task looks from each row to the
    next one only, so a value that many rows share is spread like any others.  A task's first
    and last rows stay, too, as their neighbours are elsewhere."""
    columns = rows.columns
    first = columns.index(order[0])

    def run(batches: Iterator[pa.RecordBatch]):
        held, before = None, True
        for part in batches:
            part = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            if not part.num_rows:
                continue
            key = part.column(first)
            raw = np.asarray(key).reshape(-1, 1).view(np.uint8) if pa.types.is_integer(key.type) else np.frombuffer(b"".join(key.to_pylist()), np.uint8).reshape(-1, size)
            same = np.concatenate([[before], (raw[1:, :prefix] == raw[:-1, :prefix]).all(axis=1)])
            yield part.slice(0, part.num_rows - 1).filter(pa.array(same[:-1] | same[1:]))
            held, before = part.slice(part.num_rows - 1), bool(same[-1])
        if held is not None:
            yield held

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, rows.schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in edges (a, b): the least id that it is linked with.

    Every id points to its least neighbour and to that one's; edges are contracted to what
    they point to, and shrink fast, until none is left.  Nothing is collected."""
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    while True:
        ends = left.select(F.col("b").alias("id"), "a").unionByName(left.select(F.col("a").alias("id"), "a"))
        point = ends.groupBy("id").agg(F.min("a").alias("to"))
        over = point.select(F.col("id").alias("to"), F.col("to").alias("then"))
        point = written(point.join(over, "to").select("id", F.col("then").alias("to")))
        steps.append(point)
        by = lambda k: point.select(F.col("id").alias(k), F.col("to").alias(f"_{k}"))  # noqa: B023, E731
        moved = left.filter("a <> b").join(by("a"), "a").join(by("b"), "b").filter("_a <> _b")
        left = written(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        if left.isEmpty():
            break
    label = steps[0].withColumnRenamed("to", "root")
    for later in steps[1:]:
        label = label.join(later.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return label


def circles(threshold: float) -> tuple[float, float]:
    """How near to a hub an item leaves a bucket, and how near it is kept in mind."""
    return 2 * threshold - 1 + MARGIN, 3 * threshold - 2 - MARGIN


class Parts:
    """Numbers that are joined step by step; a part's root has its least rank."""

    def __init__(self, rank: np.ndarray):
        self.rank, self.root = rank, np.arange(len(rank))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def join(self, hub: int, others: np.ndarray) -> None:
        for i in others[self.root[others] != self.root[hub]].tolist():
            a, b = self.find(hub), self.find(i)
            if a != b:
                low, high = (a, b) if self.rank[a] < self.rank[b] else (b, a)
                self.root[high] = low
        self.root[others] = self.root[hub] = self.find(hub)

    def roots(self) -> np.ndarray:
        while True:
            new = self.root[self.root]
            if (new == self.root).all():
                return self.root
            self.root = new


def bucket_roots(raw: np.ndarray, rank: np.ndarray, sketch: np.ndarray, prefixes: list[int], threshold: float, chance: Callable | None = None, recall: float = 1.0) -> np.ndarray:
    """Each item's root in one node of a trie, given its items' sorted paths, ranks by name, and sketches.

    Hubs are items of the least rank, so that a group's trees agree on few of them.  What is held is a root
    and, for each step, a weight an item, however many pairs are near.  A bucket's hubs come to an end when those that
    are left are one part; after HUBS of them, the ones left and what they may be near to are one part as well, which
    costs comparisons but loses nothing.

    Prefixes are shortened step by step.  A branch is looked at if it has not been before and holds
    an item that is short of partners: chance(nears) tells for each step how likely possible links of such
    nearness are found by then, so each stands for 1 / chance partners, of which recall have to be found."""
    inner, outer = circles(threshold)
    n, parts = len(raw), Parts(rank)
    weight, count = np.zeros((len(prefixes), n)), np.zeros(n)
    short = np.ones(n, bool)
    for step, length in enumerate(prefixes):
        edge = np.flatnonzero((raw[1:, :length] != raw[:-1, :length]).any(axis=1)) + 1
        for low, high in zip([0, *edge.tolist()], [*edge.tolist(), n], strict=True):
            if high - low < 2 or not short[low:high].any() or step and (raw[low, : prefixes[step - 1]] == raw[high - 1, : prefixes[step - 1]]).all():
                continue
            rest, hubs = low + np.argsort(rank[low:high]), 0
            while len(rest) > 1:
                hub, rest, hubs = int(rest[0]), rest[1:], hubs + 1
                near = np.concatenate([(sketch[rest[at : at + 8192]] == sketch[hub]).mean(axis=1) for at in range(0, len(rest), 8192)])
                parts.join(hub, rest[near >= outer])
                likely = near >= threshold - MARGIN
                if chance is not None and likely.any():
                    each = 1 / chance(near[likely])
                    weight[:, rest[likely]] += each
                    weight[:, hub] += each.sum(axis=1)
                    count[rest[likely]] += 1
                    count[hub] += likely.sum()
                rest = rest[near < inner]
                if hubs >= HUBS:
                    parts.join(hub, rest)
                    break
                if hubs % 8 == 1 and len(rest) > 1 and (parts.roots()[rest] == parts.root[rest[0]]).all():
                    break
        if chance is not None and step < len(prefixes) - 1:
            short = ~((count > 0) & (count >= recall * weight[step]))
    return parts.roots()


def searched(shared: DataFrame, sketches: DataFrame, prefixes: list[int], threshold: float, wide: type, chance: Callable | None = None, recall: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that join the items of each bucket, and the buckets (node, item), of rows shared (path, item); prefixes are lengths, the longest first."""
    rows = written(shared.withColumn("node", F.substring("path", 1, prefixes[-1])))
    sizes = written(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"))
    held = rows.join(sizes, "node").join(sketches, "item").select("node", "path", "item", "sketch", "n")

    def run(batches):
        now, paths, items, sketch = None, [], [], []

        def table(rows):
            cols = list(zip(*rows, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["a", "b"])

        def done():
            raw, held = (np.frombuffer(b"".join(x), t).reshape(len(items), -1) for x, t in ((paths, np.uint8), (sketch, wide)))
            rank = np.empty(len(items), np.int64)
            rank[sorted(range(len(items)), key=items.__getitem__)] = np.arange(len(items))
            root = bucket_roots(raw, rank, held, prefixes, threshold, chance, recall)
            return [(items[root[i]], items[i]) for i in np.flatnonzero(root != np.arange(len(items))).tolist()]

        out = []
        for part in batches:
            for node, path, item, s in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if node != now:
                    out += done() if items else []
                    now, paths, items, sketch = node, [], [], []
                paths.append(path)
                items.append(item)
                sketch.append(s)
            if len(out) > 4096:
                yield table(out)
                out = []
        yield table(out + (done() if items else []))

    small = held.filter(F.col("n") <= NODE).select("node", "path", "item", "sketch").repartition("node").sortWithinPartitions("node", "path", "item")
    found = small.mapInArrow(run, "a binary, b binary")
    large = sizes.filter(F.col("n") > NODE)
    if not large.isEmpty():
        rounds = gathered(written(rows.join(large, "node").select("node", "item")), sketches, threshold, wide)
        found = found if rounds is None else found.unionByName(rounds.select(F.col("hub").alias("a"), F.col("item").alias("b")))
    return written(found.distinct()), rows.select("node", "item")


def _nearness(pairs: DataFrame, sketches: DataFrame, wide: type) -> DataFrame:
    """(hub, item, near) by the share of equal sketch values."""
    both = pairs.join(sketches.select(F.col("item"), F.col("sketch").alias("s")), "item").join(sketches.select(F.col("item").alias("hub"), F.col("sketch").alias("t")), "hub")

    def run(batches):
        for part in rows_in_slices(batches, 4096):
            s, t = (np.frombuffer(b"".join(part.column(i).to_pylist()), wide).reshape(part.num_rows, -1) for i in (2, 3))
            near = (s == t).mean(axis=1) if part.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near, pa.float64())], names=["hub", "item", "near"])

    return both.select("hub", "item", "s", "t").mapInArrow(run, "hub binary, item binary, near double")


def gathered(held: DataFrame, sketches: DataFrame, threshold: float, wide: type = np.uint16) -> DataFrame | None:
    """(hub, item, near) of all buckets held (node, item): each item with the hubs that it may share links with.

    Tables are written between a count and a join by the same key, so that a hot bucket's rows can be split."""
    out, hubs_each = [], 1
    inner, outer = circles(threshold)
    while True:
        dealt = held.groupBy("node", F.pmod(F.xxhash64("item"), F.lit(hubs_each)).alias("part")).agg(F.min("item").alias("hub"), F.max("item").alias("top"))
        several = dealt.groupBy("node").agg(F.collect_set("hub").alias("hubs"), F.min("hub").alias("low"), F.max("top").alias("high"))  # hubs_each at most
        hubs = written(several.filter("low <> high").select("node", "hubs"))
        met = written(held.join(hubs, "node").select("node", "item", F.explode("hubs").alias("hub")))
        if met.isEmpty():
            break
        near = written(_nearness(met.filter("item <> hub").select("hub", "item").distinct(), sketches, wide))
        out.append(near.filter(F.col("near") >= outer))
        seen = met.join(near, ["hub", "item"], "left").groupBy("node", "item").agg(F.max(F.when(F.col("item") == F.col("hub"), 1.0).otherwise(F.col("near"))).alias("near"))
        held = written(seen.filter(F.col("near") < inner).select("node", "item"))
        hubs_each *= 2
    if not out:
        return None
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def units(edges: DataFrame, buckets: DataFrame) -> DataFrame:
    """(item, unit, side): each group as one unit, or a large one as units of the pairs of its blocks that some bucket has both of.

    Blocks hold items that the same least neighbour joins, so that a bucket has few of them."""
    least = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("owner"))
    members = written(components(edges).join(least, "id", "left").select(F.col("id").alias("item"), F.col("root").alias("grp"), F.coalesce("owner", "id").alias("owner")))
    sizes = written(members.groupBy("grp").agg(F.count("*").alias("m")))
    unit = lambda i, j: F.struct("grp", i.alias("i"), j.alias("j")).alias("unit")
    zero, side = F.lit(0).cast("long"), lambda k: F.lit(k).alias("side")
    small = members.join(sizes.filter(F.col("m") <= BLOCK), "grp").select("item", unit(zero, zero), side(0))
    large = written(members.join(sizes.filter(F.col("m") > BLOCK), "grp"))
    if large.isEmpty():
        return small
    owners = written(large.groupBy("owner").agg(F.count("*").alias("k")))
    share = lambda n: F.ceil(F.col(n) / (BLOCK / 3))
    alone = F.xxhash64("owner", F.pmod(F.xxhash64("item"), share("k")))
    dealt = F.when(F.col("k") > BLOCK / 3, alone).otherwise(F.xxhash64("grp", F.pmod(F.xxhash64("owner"), share("m"))))
    blocks = written(large.join(owners, "owner").select("item", "grp", dealt.alias("block")))
    met = buckets.join(blocks, "item").groupBy("node", "grp").agg(F.array_sort(F.collect_set("block")).alias("bs")).select("grp", "bs").distinct()
    firsts = met.select("grp", F.explode("bs").alias("i"), "bs").repartition("grp", "i")  # a row for a block, not for all pairs
    both = written(firsts.select("grp", "i", F.explode(F.filter("bs", lambda b: b >= F.col("i"))).alias("j")).distinct())
    left = blocks.join(both.withColumn("block", F.col("i")), ["grp", "block"]).select("item", unit(F.col("i"), F.col("j")), side(0))
    right = blocks.join(both.filter("i <> j").withColumn("block", F.col("j")), ["grp", "block"]).select("item", unit(F.col("i"), F.col("j")), side(1))
    return small.unionByName(left).unionByName(right)


def jaccards(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Exact Jaccard similarities of all pairs; only shingles that two sets share take part in the product."""
    every = left + (right or [])
    sizes = np.array([len(x) for x in every], np.float64)
    owner = np.repeat(np.arange(len(every)), sizes.astype(np.int64))
    _, code, count = np.unique(np.concatenate(every) if every else np.zeros(0, _U64), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    n, m = len(left), len(every)
    inter = np.zeros((n, m - n if right is not None else m), np.float64)
    width = min(max(1, 8_000_000 // max(m, 1)), int(code.max()) + 1 if len(code) else 1)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        low, high = np.searchsorted(code, [at, at + width])
        x = np.zeros((m, width), np.float32)
        x[owner[low:high], code[low:high] - at] = 1
        inter += x[:n] @ (x[n:] if right is not None else x).T
    a, b = sizes[:n, None], (sizes[n:] if right is not None else sizes)[None, :]
    return inter / np.maximum(a + b - inter, 1)


def _linked(lone: bool, left: dict, right: dict, threshold: float, width: int) -> list[tuple[bytes, bytes, int]]:
    """(item, a linked item, n_links) of one unit's items with a link: among left if lone, else between left and right (item -> text)."""
    items = [*left, *right]
    if len(left) < 2 if lone else not (left and right):
        return []
    sets = [shingles(x, width) for x in left.values()], [shingles(x, width) for x in right.values()]
    if len(items) == 2:  # most units
        x, y = sets[0] + sets[1]
        inter = len(np.intersect1d(x, y, assume_unique=True))
        return [(k, items[0], 1) for k in items] if inter / max(len(x) + len(y) - inter, 1) >= threshold - 1e-12 else []
    hit = (jaccards(sets[0]) if lone else jaccards(*sets)) >= threshold - 1e-12
    if lone:
        np.fill_diagonal(hit, False)
    count = hit.sum(axis=1).tolist() + ([] if lone else hit.sum(axis=0).tolist())
    n, every, label = len(left), len(items), np.arange(len(items), dtype=np.int32)
    while True:  # the least number that links join with an item, without a list of the links
        if lone:
            new = np.minimum(label, np.where(hit, label[None, :], every).min(axis=1))
        else:
            x, y = label[:n], label[n:]
            new = np.concatenate([np.minimum(x, np.where(hit, y[None, :], every).min(axis=1)), np.minimum(y, np.where(hit, x[:, None], every).min(axis=0))])
        new = new[new].astype(np.int32)
        if (new == label).all():
            break
        label = new
    return [(items[i], items[label[i]], k) for i, k in enumerate(count) if k]


def _compare(rows: DataFrame, threshold: float, width: int) -> DataFrame:
    """(item, near, n_links) of all units (unit, side, item, text).

    Rows are sorted by unit and read in that order, so a task holds one unit at a time and small ones cost little."""

    def table(rows):
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["item", "near", "n_links"])

    def run(batches):
        now, sides, out = None, ({}, {}), []

        def done():
            return _linked(now[1] == now[2], *sides, threshold, width) if now else []

        for part in batches:
            for *unit, side, item, text in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                if unit != now:
                    out += done()
                    now, sides = unit, ({}, {})
                sides[side].setdefault(item, text)
            if len(out) > 4096:
                yield table(out)
                out = []
        yield table(out + done())

    ordered = rows.select("unit.grp", "unit.i", "unit.j", "side", "item", "text").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return ordered.mapInArrow(run, "item binary, near binary, n_links long")


def links(edges: DataFrame, buckets: DataFrame, content: Callable[[DataFrame], DataFrame], threshold: float = 0.8, width: int = 5) -> DataFrame | None:
    """(item, root, n_links) of all items with a link: the least item of its class, and its number of linked items.

    content(df with item) gives the same rows with the item's text; a row that comes twice does no harm."""
    if edges.isEmpty():
        return None
    exact = written(_compare(content(written(units(edges, buckets))), threshold, width))
    counted = exact.groupBy("item").agg(F.sum("n_links").alias("n_links"))
    roots = components(exact.select(F.col("item").alias("a"), F.col("near").alias("b")))
    return counted.join(roots.withColumnRenamed("id", "item"), "item").select("item", "root", "n_links")
