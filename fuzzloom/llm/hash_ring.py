"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns virtual nodes on a ring of 64-bit hashes; the keys between two nodes form
an arc and belong to the arc's node.  Shards have capacities: keys above a full shard's
capacity continue clockwise to the next node whose shard has room.  All that leaves the
executors is the number of keys of each arc's pieces (shards x nodes x PIECES rows, whatever
the input); from these the flow of the surplus is planned, as ranges of ranks within arcs, and a key's
rank within its arc then gives both its shard and its slot.  DataFrame functions only.

Null doc_ids hash like any key.  Null texts have no bytes.  Equal keys are neighbours on
the ring; rows that tie in doc_id are ranked by their text's checksum and size, and a doc_id with very
many rows is ranked in pieces by these.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fuzzloom.llm.common import packed

NODES = 128
PIECES = 16  # of an arc, that are ranked apart: rows of one key go to these by their ties
_CELLS = 4096  # of the ring, to find an arc by an equi-join


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise.  A shard's nodes don't depend on the others'."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"shard {s} node {v}".encode()).digest()[:8], "big", signed=True)
    return sorted((at(s, v), s) for s in range(shards) for v in range(nodes))


def exact_capacities(n: int, shards: int) -> list[int]:
    """Capacities that differ by one at most and hold exactly n keys."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def loose_capacities(n: int, shards: int, slack: float) -> list[int]:
    """The same capacity for each shard: (1 + slack) times the mean, rounded up."""
    return [-(-int(n * (1 + slack) * 1_000_000) // (shards * 1_000_000))] * shards


def plan(counts: dict[int, int], owners: list[int], capacities: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, below rank, shard, first slot) for all keys, given the keys of each arc.

    Shards take their own arcs' keys first, clockwise; what is left over goes on clockwise."""
    load, out, over = [0] * len(capacities), [], []
    for arc in range(len(owners)):
        n, s = counts.get(arc, 0), owners[arc]
        took = min(n, capacities[s] - load[s])
        if took:
            out.append((arc, 0, took, s, load[s]))
            load[s] += took
        if took < n:
            over.append((arc, took, n))
    for arc, low, high in over:
        at = arc
        for _ in owners:
            if low == high:
                break
            at = (at + 1) % len(owners)
            s = owners[at]
            took = min(high - low, capacities[s] - load[s])
            if took:
                out.append((arc, low, low + took, s, load[s]))
                load[s] += took
                low += took
        if low < high:
            raise ValueError("the capacities are too small for the keys")
    return out


def _table(spark: SparkSession, rows: list[list], schema: str) -> DataFrame:
    """A small table as one literal."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = "array<struct<" + ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in schema.split(", ")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def with_arc(df: DataFrame, key, nodes: list[tuple[int, int]]) -> DataFrame:
    """The rows with ring_hash and arc: the number of the first node at or after the hash, clockwise."""
    positions = [p for p, _ in nodes]
    cells = [[] for _ in range(_CELLS)]
    for p in positions:
        cells[(p >> 52) + _CELLS // 2].append(p)
    rows = [[c, bisect.bisect_left(positions, (c - _CELLS // 2) << 52), own] for c, own in enumerate(cells)]
    table = F.broadcast(_table(df.sparkSession, rows, "cell int, before int, own array<bigint>"))  # 4096 rows
    hashed = df.withColumn("ring_hash", F.xxhash64(key)).withColumn("cell", (F.shiftright("ring_hash", 52) + _CELLS // 2).cast("int"))
    found = hashed.join(table, "cell")
    arc = (F.col("before") + F.size(F.filter("own", lambda p: p < F.col("ring_hash")))) % len(nodes)
    return found.withColumn("arc", arc.cast("int")).drop("cell", "before", "own")


def assign(df: DataFrame, key: str, shards: int, nodes: int = NODES, slack: float | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The rows with shard and slot, a number within the shard from 0 without gaps.

    slack None: loads differ by one at most; else no shard has over (1 + slack) times the mean."""
    if {"shard", "slot"} & {*df.columns}:
        raise ValueError("the rows have a column shard or slot already")
    on = ring(shards, nodes)
    owners = [s for _, s in on]
    piece = F.pmod(F.xxhash64(*[f"tie{i}" for i in range(len(ties))]), F.lit(PIECES)).cast("int") if ties else F.lit(0)
    rows = packed(df, key, *ties).toDF("whole", "key", *[f"tie{i}" for i in range(len(ties))])
    placed = with_arc(rows, F.col("key"), on).withColumn("piece", piece)
    counts, base = {}, []
    for r in placed.groupBy("arc", "piece").agg(F.count("*").alias("n")).orderBy("arc", "piece").collect():  # at most arcs x PIECES rows
        base.append([r["arc"], r["piece"], counts.get(r["arc"], 0)])
        counts[r["arc"]] = counts.get(r["arc"], 0) + r["n"]
    total = sum(counts.values())
    room = exact_capacities(total, shards) if slack is None else loose_capacities(total, shards, slack)
    flow = _table(df.sparkSession, [list(x) for x in plan(counts, owners, room)], "arc int, low bigint, high bigint, shard int, first bigint")
    before = F.broadcast(_table(df.sparkSession, base, "arc int, piece int, base bigint"))
    order = Window.partitionBy("arc", "piece").orderBy("ring_hash", *rows.columns[1:])
    numbered = placed.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(before, ["arc", "piece"])
    ranked = numbered.withColumn("rank", F.col("rank") + F.col("base")).withColumnRenamed("arc", "own_arc")
    hit = (F.col("own_arc") == F.col("arc")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    out = ranked.join(F.broadcast(flow), hit)  # at most arcs x shards rows
    return out.select("whole.*", "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document under the law `rows`: the shards' numbers of documents differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign(rows, "doc_id", shards, ties=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
