"""Clusters of cells on one-hot levels: weighted k-means++ with hashed draws, then Lloyd's steps, for all groups at once.

A group (the columns by: a label, a label of a subset, or nothing) and a cluster are columns, so one plan
serves all groups.  A draw with probability in proportion to weight times squared distance is the least of
-ln(u) / (weight * distance), u a hash of seed, round, group and cell, which is a minimum and needs no running
sum.  Centres are one row a group; Spark broadcasts them while they are small and joins them otherwise.
Distances are rounded to nine places, and a tie goes to the lower cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.sources.staging import staged

ROUNDS = 100


def _draw(seed: int, turn: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(turn)), "_g", F.col("cell").cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def _first(rows: DataFrame, weight: Column, seed: int, turn: int) -> DataFrame:
    """(_g, c, turn): the tokens of the cell drawn in each group that has a weight above 0."""
    race = F.min(F.struct((-F.ln(_draw(seed, turn)) / weight).alias("e"), "cell", "_t")).alias("m")
    return rows.filter(weight > 0).groupBy("_g").agg(race).select("_g", F.col("m._t").alias("c"), F.lit(turn).alias("turn"))


def start_centres(rows: DataFrame, clusters: int, attributes: int, seed: int) -> DataFrame:
    """(_g, c, turn): up to so many starting cells a group; no further one where all cells have a centre on them."""
    picks = staged(_first(rows, F.col("w").cast("double"), seed, 0))
    out, near = picks, rows.withColumn("_d", F.lit(2.0 * attributes))
    for turn in range(1, clusters):
        same = F.size(F.array_intersect("_t", "c"))
        last = near.join(picks.select("_g", "c"), "_g", "left")
        near = staged(last.withColumn("_d", F.when(F.col("c").isNull(), 0.0).otherwise(F.least("_d", 2.0 * (attributes - same)))).drop("c"))
        picks = staged(_first(near, F.col("w") * F.col("_d"), seed, turn))
        if picks.isEmpty():
            break
        out = out.unionByName(picks)
    return staged(out)


def _rows_of(means: DataFrame) -> DataFrame:
    """(_g, cs): each group's centres (cluster, norm, at: token to share) in one row, from (_g, cluster, token, x)."""
    one = means.groupBy("_g", "cluster").agg(F.sum(F.col("x") * F.col("x")).alias("norm"), F.map_from_entries(F.collect_list(F.struct("token", "x"))).alias("at"))  # a vocabulary's levels
    return one.groupBy("_g").agg(F.collect_list(F.struct("cluster", "norm", "at")).alias("cs"))  # clusters of a group


def _nearest(tokens: str, centres: str) -> Column:
    share = lambda c: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(c["at"], t), F.lit(0.0)))
    each = F.transform(centres, lambda c: F.struct(F.round(c["norm"] - 2 * share(c), 9).alias("d"), c["cluster"].alias("cluster")))
    return F.array_min(each)["cluster"]


def clustered(cs: DataFrame, features: list[str], clusters: int = 5, by: tuple[str, ...] | list[str] = ("y",), seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """cs (cell, w, features) with cluster 0, 1, ... in each group; empty clusters are taken out, so there can be fewer.

    A null level is a level of its own.  A group of fewer cells than clusters has one for each at most."""
    if clusters < 1:
        raise ValueError("there must be a cluster at least")
    group = F.concat_ws("|", F.lit("g"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by])
    token = [F.concat(F.lit(f"{i}:"), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for i, c in enumerate(features)]
    rows = staged(cs.withColumn("_g", group).withColumn("_t", F.array(*token)))
    starts = start_centres(rows.select("_g", "cell", "w", "_t"), clusters, len(features), seed)
    means = starts.select("_g", F.col("turn").alias("cluster"), F.explode("c").alias("token"), F.lit(1.0).alias("x"))
    at = None
    for _ in range(rounds):
        centres = staged(_rows_of(means))
        held = rows if at is None else at.withColumnRenamed("cluster", "_old")
        at = staged(held.join(centres, "_g").withColumn("cluster", _nearest("_t", "cs")).drop("cs"))
        if "_old" in at.columns:
            moved = not at.filter("cluster <> _old").isEmpty()
            at = at.drop("_old")
            if not moved:
                break
        total = at.groupBy("_g", "cluster").agg(F.sum("w").alias("_n"))
        new = at.select("_g", "cluster", "w", F.explode("_t").alias("token")).groupBy("_g", "cluster", "token").agg(F.sum("w").alias("_w")).join(total, ["_g", "cluster"]).select("_g", "cluster", "token", (F.col("_w") / F.col("_n")).alias("x"))
        means = staged(new.unionByName(means.join(total, ["_g", "cluster"], "left_anti")))  # an empty cluster keeps its centre
    kept = at.select("_g", "cluster").distinct().withColumn("_k", (F.row_number().over(Window.partitionBy("_g").orderBy("cluster")) - 1).cast("int"))  # clusters of a group
    return at.join(kept, ["_g", "cluster"]).withColumn("cluster", F.col("_k")).drop("_g", "_t", "_k")
