"""Older published forms, as options beside the present ones: for comparisons with published tables only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzloom.operators import metrics
from fuzzloom.operators.infer import evidence_table
from fuzzloom.operators.matrices import exploded

WIDE_CUTS = (0.1, 0.9)


def by_wide_cuts(value: Column, cuts: list[float]) -> Column:
    """Low up to the first cut, Medium up to the second, else High: a value that can't be compared is High."""
    ok = value.isNotNull() & ~F.isnan(value)
    return F.when(ok & (value <= cuts[0]), "Low").when(ok & (value <= cuts[1]), "Medium").otherwise("High")


def by_open_bins(value: Column, bins) -> Column:
    """The first bin whose bound is above the value, else the last, missing values included."""
    ok, out = value.isNotNull() & ~F.isnan(value), F
    for bound, level in bins[:-1]:
        out = out.when(ok & (value < bound), level)
    return out.otherwise(bins[-1][1])


def spread_quota(sizes: list[int], values: list[list[float]], theta: float) -> list[int]:
    """Budgets by size times the spread of values supplied for each stratum, rounded up in each: in all they can be over the budget."""
    n = sum(sizes)

    def deviation(v: list[float]) -> float:
        mean = sum(v) / len(v)
        return math.sqrt(sum((x - mean) ** 2 for x in v) / len(v)) + 1e-9

    weight = [s * deviation(v) for s, v in zip(sizes, values, strict=True)]
    return [min(s, math.ceil(theta * n * w / sum(weight))) for s, w in zip(sizes, weight, strict=True)]


def holm_strict(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Holm's adjusted values, rejected only below alpha."""
    from fuzzloom.functions import stats

    return stats.holm(df, p, alpha).withColumn("reject", F.coalesce(F.col("p_adj") < alpha, F.lit(False)))


def paired_size(df: DataFrame, d: str = "d") -> DataFrame:
    """One row dz: mean over deviation, 0 where there is no deviation."""
    sd = F.stddev_samp(d)
    return df.agg(F.when(sd < 1e-12, 0.0).otherwise(F.avg(d) / sd).alias("dz"))


def auc_or_half(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """The area under the curve, 1/2 where a class is empty."""
    return metrics.auc(df, y, score).select(F.coalesce("auc", F.lit(0.5)).alias("auc"))


def relative_auc(df: DataFrame, whole: float, y: str = "y", score: str = "score") -> DataFrame:
    """The area under the curve over that of all rules; 1 where that is 0."""
    return auc_or_half(df, y, score).select((F.col("auc") / F.lit(whole) if whole > 1e-9 else F.lit(1.0)).alias("auc_rel"))


def first_best_threshold(scored: DataFrame, candidates: list[float]) -> float | None:
    """The first candidate whose `score > t` has the greatest balanced accuracy, compared without tolerance.

    Scores are counted by the candidates that they are above, so nothing but these counts is gathered."""
    if not candidates:
        return None
    order = sorted(set(candidates))
    above = F.size(F.filter(F.array(*map(F.lit, order)), lambda t: t < F.col("score")))
    rows = {r["a"]: (r["pos"], r["neg"]) for r in scored.filter(F.col("score").isNotNull()).groupBy(above.alias("a")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).collect()}
    pos, neg = (sum(c[i] for c in rows.values()) for i in (0, 1))
    if not pos or not neg:
        return None
    value = {}
    for k, t in enumerate(order):
        tp = sum(c[0] for a, c in rows.items() if a > k)
        tn = sum(c[1] for a, c in rows.items() if a <= k)
        value[t] = (tp / pos + tn / neg) / 2
    return max(candidates, key=lambda t: value[t])


def evidence_scores(asked: DataFrame, rules: DataFrame, features: list[str], labels: int = 2, temperature: float = 1.0) -> DataFrame:
    """(id, d, p, pred): least plus greatest evidence over the attributes seen, a softmax of it, and the first greatest label.

    asked is crisp (id, levels) or fuzzy (id, membership: token to degree); evidence is the sum of degree times support times
    confidence of the rules that hold the level.  A row that meets no level has null d and pred, and equal shares."""
    table = evidence_table(rules, features)
    if "membership" in asked.columns:
        long = asked.select("id", F.explode("membership").alias("token", "mu")).filter("mu > 0").select("id", F.regexp_extract("token", "^(.*)-([^-]*)$", 1).alias("name"), F.regexp_extract("token", "^(.*)-([^-]*)$", 2).alias("level"), "mu")
        long = long.withColumn("attr", F.array_position(F.array(*map(F.lit, features)), F.col("name")).cast("int") - 1).filter("attr >= 0")
    else:
        long = exploded(asked.select("id", *features), features, 1).select("id", F.col("node").alias("attr"), F.col("key").alias("level"), F.lit(1.0).alias("mu"))
    met = long.join(table, ["attr", "level"])
    grid = met.select("id", "attr").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(labels - 1))))
    sums = met.groupBy("id", "attr", "y").agg(F.sum(F.col("mu") * F.col("w")).alias("c"))
    each = grid.join(sums, ["id", "attr", "y"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    d = each.groupBy("id", "y").agg((F.min("c") + F.max("c")).alias("s")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "s"))), lambda x: x["s"]).alias("d"))
    out = asked.select("id").join(d, "id", "left")
    shifted = F.transform("d", lambda x: F.exp((x - F.array_max("d")) / F.lit(max(temperature, 1e-6))))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    p = F.coalesce(F.transform(shifted, lambda x: x / (total + 1e-12)), F.array_repeat(F.lit(1.0 / labels), labels))
    return out.select("id", "d", p.alias("p"), (F.array_position("d", F.array_max("d")) - 1).cast("int").alias("pred"))


def beats_majority(decided: DataFrame, margin: float = 0.02, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row (accuracy, majority, label, beats): whether decisions are better than always telling the most frequent label, ties to the lower one."""
    most = decided.groupBy(y).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col(y)).alias("k"))).alias("m"), F.sum("n").alias("all"))
    right = decided.agg(F.count_if(F.col(y) == F.col(pred)).alias("hit"))
    share = F.try_divide(F.col("hit").cast("double"), F.col("all"))
    top = F.try_divide(F.col("m.n").cast("double"), F.col("all"))
    return right.crossJoin(F.broadcast(most)).select(share.alias("accuracy"), top.alias("majority"), (-F.col("m.k")).cast("int").alias("label"), (share > top + margin).alias("beats"))  # one row each
