"""Deterministic splits and allocations: order by md5 of seed and id."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def numbered(df: DataFrame, by: list[str], key: str, seed: int = 42, name: str = "_no") -> DataFrame:
    """df with the number, from 0, of each row within its group by order of the hash.

    Rows are counted by group and the hash's first three digits, sums of these counts tell where
    each piece begins, and only pieces are sorted: no task holds a group.  Groups are few."""
    x = df.withColumn("_h", shuffled(key, seed)).withColumn("_p", F.substring("_h", 1, 3))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy(*by, "_p").agg(F.count("*").alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")  # 4096 rows a group
    right = base.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(by)} | {"_p": "_q"})
    on = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    own = Window.partitionBy(*by, "_p").orderBy("_h", key)
    return x.withColumn("_r", F.row_number().over(own)).join(F.broadcast(right), on).withColumn(name, F.col("_r") - 1 + F.col("_b")).select(*df.columns, name)


def stratified_folds(df: DataFrame, label: str = "y", key: str = "id", k: int = 5, seed: int = 42) -> DataFrame:
    """fold 0..k-1, dealt in turn within each label."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0]
    if least is None or not 2 <= k <= least:
        raise ValueError("k must be from 2 to the smallest class size, of rows that exist")
    return numbered(df, [label], key, seed).withColumn("fold", F.pmod("_no", F.lit(k)).cast("int")).drop("_no")


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold of each group: all copies of a row stay together."""
    names = numbered(df.select(group).distinct(), [], group, seed)
    return df.join(names.select(group, F.pmod("_no", F.lit(k)).cast("int").alias("fold")), group)


def duplicate_groups(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """grp: the least id among rows with equal columns."""
    least = df.groupBy(*columns).agg(F.min(key).alias("grp"))
    return df.join(least, columns)


def budget(theta: float, n: int) -> int:
    if not 0 <= theta <= 1 or n < 0:
        raise ValueError("theta must be in [0, 1] and n at least 0")
    return math.ceil(theta * n - 1e-12)


def largest_remainder(sizes: list[int], m: int, weights: list[float] | None = None) -> list[int]:
    """Whole shares of min(m, all) by weight, never above a size; by size where no weight is above 0.

    Each open stratum first has the whole part of its quota; then units go one by one to the one
    that lacks most of its quota, ties to the lower index."""
    if m < 0:
        raise ValueError("the budget must be at least 0")
    m = min(m, sum(sizes))
    weights = list(map(float, sizes if weights is None or sum(weights) <= 0 else weights))
    total = sum(weights)
    quota = [m * w / total if total else 0.0 for w in weights]
    out = [min(math.floor(q), s) for q, s in zip(quota, sizes, strict=True)]
    lacking = [(out[i] - q, i) for i, q in enumerate(quota) if out[i] < sizes[i]]
    heapq.heapify(lacking)
    for _ in range(m - sum(out)):
        over, i = heapq.heappop(lacking)
        out[i] += 1
        if out[i] < sizes[i]:
            heapq.heappush(lacking, (over + 1, i))
    return out


def allocate(sizes: list[int], theta: float, method: str = "proportional", exact: bool = True, diversity: list[float] | None = None) -> list[int]:
    """Budgets of strata: proportional, equal or neyman (size times diversity); exact in all, or rounded up in each."""
    if method not in ("proportional", "equal", "neyman"):
        raise ValueError(f"unknown method {method}")
    n, spread = sum(sizes), diversity or [1.0] * len(sizes)
    weights = {"proportional": sizes, "equal": [1.0] * len(sizes), "neyman": [s * d for s, d in zip(sizes, spread, strict=True)]}[method]
    if exact:
        return largest_remainder(sizes, budget(theta, n), weights)
    budget(theta, n)
    total = sum(weights) or 1.0
    return [min(s, math.ceil(theta * n * w / total - 1e-12)) for s, w in zip(sizes, weights, strict=True)]


def random_sample(df: DataFrame, m: int, key: str = "id", seed: int = 0) -> DataFrame:
    return df.orderBy(shuffled(key, seed), key).limit(m)


def strat_random(df: DataFrame, theta: float, label: str = "y", key: str = "id", seed: int = 0, method: str = "proportional") -> DataFrame:
    """A random sample of each label, of exactly the budget in all."""
    strata = sorted((r[0], r[1]) for r in df.groupBy(label).count().collect())  # one row for each label
    quota = allocate([n for _, n in strata], theta, method)
    return firsts(numbered(df, [label], key, seed), label, dict(zip([v for v, _ in strata], quota, strict=True)))


def firsts(df: DataFrame, label: str, quota: dict) -> DataFrame:
    """The rows whose number _no is below their label's quota."""
    most = F.create_map(*[x for v, q in quota.items() for x in (F.lit(v), F.lit(q))]) if quota else F.lit(None).cast("map<int,int>")
    return df.filter(F.col("_no") < most[F.col(label)]).drop("_no")


def train_validation(df: DataFrame, share: float = 0.2, label: str = "y", key: str = "id", seed: int = 42) -> DataFrame:
    """df with held: true for the first floor(share * n) rows of each label by hash, one at least where a label has two rows."""
    if not 0 < share < 1:
        raise ValueError("the share is between 0 and 1")
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    take = F.when(F.col("_n") < 2, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("_n") * share + 1e-12)))
    return numbered(df, [label], key, seed).join(F.broadcast(sizes), label).withColumn("held", F.col("_no") < take).drop("_no", "_n")
