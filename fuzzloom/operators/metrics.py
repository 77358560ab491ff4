"""Metrics of decisions and scores, and aggregation over folds and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _count(told: Column, weight: str | None) -> Column:
    return F.coalesce(F.sum(F.when(told, F.col(weight)).otherwise(0)), F.lit(0)) if weight else F.count_if(told)


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """One row: counts, sensitivity, specificity, precision, F1, accuracy and balanced accuracy; null where a class is empty.  With a weight a row counts so many times."""
    n = lambda a, b: _count((F.col(y) == a) & (F.col(pred) == b), weight)
    c = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))
    div = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double"))
    return c.select("*", div("tp", "tp + fn").alias("sensitivity"), div("tn", "tn + fp").alias("specificity"), div("tp", "tp + fp").alias("precision"), div("2 * tp", "2 * tp + fp + fn").alias("f1"), div("tp + tn", "tp + tn + fp + fn").alias("accuracy"), ((div("tp", "tp + fn") + div("tn", "tn + fp")) / 2).alias("bacc"))


def by_class(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row: macro_f1 over all classes told or predicted (0 where undefined), and balanced accuracy over those present."""
    both = df.select(F.col(y).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(y) == F.col(pred)).cast("int").alias("h")).unionByName(df.select(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))
    per = both.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    return per.agg(F.avg(2 * F.col("h") / (F.col("t") + F.col("p"))).alias("macro_f1"), F.avg(F.when(F.col("t") > 0, F.col("h") / F.col("t"))).alias("bacc"))


def auc(df: DataFrame, y: str = "y", score: str = "score", weight: str | None = None) -> DataFrame:
    """One row: auc by Mann-Whitney with average ranks, null for one class.

    Equal scores are counted first, so the ranking window has a row for each distinct score."""
    c = df.groupBy(F.col(score).alias("s")).agg(_count(F.col(y) == 1, weight).alias("pos"), _count(F.col(y) == 0, weight).alias("neg"))
    below = running(c, "s", "neg")
    r = below.select("pos", "neg", (F.col("pos") * (F.col("before") + F.col("neg") / 2.0)).alias("u"))
    return r.agg(F.try_divide(F.sum("u").cast("double"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def running(df: DataFrame, order: str, value: str, pieces: int = 64) -> DataFrame:
    """df with before: the sum of value over all rows of a lesser order.

    Rows are dealt by approximate quantiles of order, so that each piece is summed in a task of
    its own; the sums of the pieces, a row each, tell where a piece begins."""
    at = ", ".join(f"{(i + 1) / pieces!r}D" for i in range(pieces - 1))
    cuts = df.agg(F.expr(f"array_sort(array_distinct(approx_percentile({order}, array({at}), 1000)))").alias("_cuts"))
    x = df.crossJoin(F.broadcast(cuts)).withColumn("_piece", F.size(F.filter("_cuts", lambda t: t < F.col(order)))).drop("_cuts")  # one row
    first = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    base = x.groupBy("_piece").agg(F.sum(value).alias("_s")).select("_piece", F.coalesce(F.sum("_s").over(first), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_piece").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mine = F.sum(value).over(Window.partitionBy("_piece", order))
    return x.withColumn("before", F.sum(value).over(own) - mine).join(F.broadcast(base), "_piece").withColumn("before", F.col("before") + F.col("_base")).drop("_piece", "_base")


def evaluate(scored: DataFrame) -> DataFrame:
    """One row for (y, pred, score, d0, d1[, n_seen]): accuracy, macro F1, balanced accuracy, AUC, the same decisions by greater score and by ratio, unseen queries."""
    from fuzzloom.operators.infer import ratio_decision

    x = scored.withColumns({"d0": F.coalesce("d0", F.lit(0)), "d1": F.coalesce("d1", F.lit(0))})
    plain = x.withColumns({"pred_max": (F.col("d1") > F.col("d0")).cast("int"), "pred_ratio": ratio_decision(F.col("d0"), F.col("d1"))})
    out = plain.agg(F.count("*").alias("n"), (F.count_if(F.col("n_seen") == 0) if "n_seen" in x.columns else F.count_if((F.col("d0") == 0) & (F.col("d1") == 0))).alias("n_unseen"))
    for name in ("pred", "pred_max", "pred_ratio"):
        end = name.removeprefix("pred")
        acc = confusion(plain, pred=name).select(F.col("accuracy").alias("accuracy" + end))
        out = out.crossJoin(acc).crossJoin(by_class(plain, pred=name).select(F.col("macro_f1").alias("macro_f1" + end), F.col("bacc").alias("bacc" + end)))  # one row each
    return out.crossJoin(auc(plain))


def log_loss(df: DataFrame, y: str = "y", p: str = "p1") -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    return df.agg((-F.avg(F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q)))).alias("log_loss"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, dev): half the absolute difference of two attributions (id, rule, v), where a missing rule counts 0."""
    both = a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), ["id", "rule"], "full")
    return both.groupBy("id").agg((F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))) / 2).alias("dev"))


def over_folds(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sd of fold means (ddof 1); for one fold, sd over seeds (ddof 0)."""
    per = df.filter(~F.isnan(value)).groupBy(*by, "fold").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return per.groupBy(*by).agg(F.avg("m").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("m")).otherwise(F.max("s")).alias("sd"), F.count("*").alias("folds"))


def collapse_warnings(df: DataFrame, margin: float = 0.02) -> DataFrame:
    """One row of flags: scores hardly vary, no better than the majority, balanced accuracy near one half."""
    c = confusion(df).crossJoin(df.agg(F.stddev_pop("p1").alias("sd"), F.greatest(F.avg("y"), 1 - F.avg("y")).alias("majority")))
    return c.select((F.col("sd") < 0.02).alias("flat"), (F.col("accuracy") <= F.col("majority") + margin).alias("majority_like"), (F.col("bacc") <= 0.52).alias("chance_like"))


def record(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """One row for (y, pred, score[, n_seen]): accuracy, balanced accuracy, F1, AUC, sensitivity, specificity, the rate and number of positive decisions, distinct scores, unseen queries.  With a weight a row counts so many times."""
    c = confusion(scored, weight=weight).select("accuracy", "bacc", F.coalesce("f1", F.lit(0.0)).alias("f1"), "sensitivity", "specificity")
    seen = _count(F.col("n_seen") == 0, weight) if "n_seen" in scored.columns else F.lit(0).cast("long")
    w = F.col(weight) if weight else F.lit(1)
    rate = F.avg("pred") if weight is None else F.try_divide(F.sum(F.col("pred") * w).cast("double"), F.sum(F.when(F.col("pred").isNotNull(), w)).cast("double"))
    more = scored.agg(rate.alias("pos_rate"), F.sum(F.col("pred") * w).alias("pred_pos"), F.countDistinct("score").alias("n_unique_scores"), seen.alias("n_unseen"))
    return c.crossJoin(auc(scored, weight=weight)).crossJoin(more)  # one row each


def group_means(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and sample standard deviation of each value by group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[f(v).alias(f"{v}_{k}") for v in values for k, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def series(df: DataFrame, by: list[str], fold: str, value: str) -> DataFrame:
    """The mean of each fold for each group that is anywhere, null where a group has no row in a fold."""
    grid = df.select(*by).distinct().crossJoin(F.broadcast(df.select(fold).distinct()))  # folds are few
    return grid.join(df.groupBy(*by, fold).agg(F.avg(value).alias("mean")), [*by, fold], "left")


def speed_up(slow: float, fast: float) -> float | None:
    """How many times faster; None where nothing was measured."""
    return slow / fast if fast > 0 else None


def per_query_ms(seconds: float, queries: int) -> float | None:
    return 1000 * seconds / queries if queries else None


def first_over(curve: DataFrame, value: str, threshold: float, at: str = "theta") -> DataFrame:
    """One row: the least budget whose value reaches the threshold, null if none does."""
    return curve.agg(F.min(F.when(F.col(value) >= threshold - 1e-12, F.col(at))).alias(at))
