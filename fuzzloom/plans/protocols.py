"""Whole evaluation protocols: folds with everything fitted on their training part, published comparisons, budget studies.

Loops run over configurations, folds and budgets, which are few; each pass is one plan over its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzloom.functions import stats
from fuzzloom.operators import infer, matrices, metrics, prep, split
from fuzzloom.plans import experiments
from fuzzloom.sources.staging import staged


def build_fold(train: DataFrame, test: DataFrame, numeric: dict[str, str], features: list[str], pool: int | None = None, val_share: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, features, y, part, pool): rows of train, val and test as levels, whose cuts come from train alone.

    With val_share a part of each label's training rows is held out; pool marks a sample of train
    by label, or all of it."""
    inner = split.train_validation(train, val_share, seed=1000 + seed) if val_share else train.withColumn("held", F.lit(False))
    inner = staged(inner)
    cuts = prep.fit_cuts(inner.filter("NOT held"), list(numeric))
    parts = inner.withColumn("part", F.when(F.col("held"), "val").otherwise("train")).drop("held").unionByName(test.withColumn("part", F.lit("test")))
    rows = prep.fuzzify(parts, cuts, numeric).select("id", *features, "y", "part")
    if pool is None:
        return rows.withColumn("pool", F.col("part") == "train")
    own = inner.filter("NOT held")
    sizes = sorted((r[0], r[1]) for r in own.groupBy("y").count().collect())  # a row for each label
    quota = dict(zip([y for y, _ in sizes], split.largest_remainder([n for _, n in sizes], pool), strict=True))
    chosen = split.firsts(split.numbered(own.select("id", "y"), ["y"], "id", seed), "y", quota).select("id", F.lit(True).alias("pool"))
    return rows.join(chosen, "id", "left").withColumn("pool", F.coalesce("pool", F.lit(False)))


def _scores(variant: str, train: DataFrame, asked: DataFrame, features: list[str]) -> DataFrame:
    """(id, y, d0, d1, score, n): queries of equal levels and label have equal scores and go on as one with their number n."""
    cs = staged(matrices.cells(train, features))
    asked = staged(asked.groupBy(*features, "y").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    if variant == "pair":
        out = infer.pair_scores(asked, matrices.pair_table(cs, features), features)
    elif variant == "orig":
        out = infer.node_scores(asked, matrices.node_table(cs, features), features)
    else:
        raise ValueError(f"unknown variant {variant}")
    out = out.withColumns({d: F.coalesce(d, F.lit(0)) for d in ("d0", "d1")}).join(asked.select("id", "n"), "id")
    return staged(out.withColumn("score", F.round(infer.log_ratio(), 9)))


def published(raw: DataFrame, numeric: dict[str, str], features: list[str], variant: str = "pair", quantiles: tuple[float, float] = (1 / 3, 2 / 3), seed: int = 42) -> DataFrame:
    """(rule, acc, bacc, f1, auc, sens, spec, pos_rate, threshold) of a 70/30 split by label, for four decision rules.

    Thresholds come from a fifth of the training part, by models of the rest.  Ties of argmax go to label 1."""
    halves = staged(split.train_validation(staged(raw), 0.3, seed=seed))
    train, test = halves.filter("NOT held").drop("held"), halves.filter("held").drop("held")
    inner = staged(split.train_validation(train, 0.2, seed=seed + 1))

    def levels(own: DataFrame, other: DataFrame):
        cuts = prep.fit_cuts(own, list(numeric), quantiles)
        return (prep.fuzzify(x, cuts, numeric).select("id", *features, "y") for x in (own, other))

    held = _scores(variant, *levels(inner.filter("NOT held").drop("held"), inner.filter("held").drop("held")), features)
    at = {"calib_acc": infer.calibrate(held, "acc", zero=False, weight="n"), "calib_bacc": infer.calibrate(held, "bacc", zero=False, weight="n")}
    s, out = _scores(variant, *levels(train, test), features), []
    for rule in ("argmax", "ratio9", *at):
        if rule in at:
            done = s.withColumn("pred", (F.col("score") > at[rule]).cast("int"))
        else:
            done = s.withColumn("pred", (F.col("d1") >= F.col("d0")).cast("int") if rule == "argmax" else infer.ratio_decision(F.col("d0"), F.col("d1")))
        r = metrics.record(done, weight="n")
        out.append(r.select(F.lit(rule).alias("rule"), F.col("accuracy").alias("acc"), "bacc", "f1", "auc", F.col("sensitivity").alias("sens"), F.col("specificity").alias("spec"), "pos_rate", F.lit(at.get(rule)).cast("double").alias("threshold")))
    return reduce(DataFrame.unionByName, out)


CONFIGS = (("orig", (0.1, 0.9), (42,)), ("orig", (1 / 3, 2 / 3), (42, 43, 44, 45, 46)), ("pair", (0.1, 0.9), (42, 43, 44, 45, 46)), ("pair", (1 / 3, 2 / 3), (42, 43, 44, 45, 46)))


def published_all(raw: DataFrame, numeric: dict[str, str], features: list[str], configs=CONFIGS) -> DataFrame:
    """The rows of published with variant, low, high and seed, for all configurations."""
    out = []
    for variant, (low, high), seeds in configs:
        for seed in seeds:
            got = published(raw, numeric, features, variant, (low, high), seed)
            out.append(got.select(F.lit(variant).alias("variant"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(seed).alias("seed"), "*"))
    return reduce(DataFrame.unionByName, out)


def prepare(rules: DataFrame, features: list[str], k: int = 5, seed: int = 42, val_share: float = 0.2) -> tuple[DataFrame, float, DataFrame]:
    """Out-of-fold teacher scores by groups of equal rules (id, y, grp, fold, d0, d1, n_seen, score, pred, held), their threshold, and the final weights of all rules.

    Held marks whole groups for validation, about val_share of them."""
    grouped = split.duplicate_groups(rules, [*features, "y"])
    folded = staged(split.group_folds(grouped, "grp", k, seed))
    oof = infer.out_of_fold(folded, features, k)
    scored = staged(oof.withColumn("score", F.when(F.col("n_seen") > 0, infer.log_ratio()).otherwise(0.0)))
    threshold = infer.calibrate(scored)
    told = infer.decide(scored, "calibrated", threshold)
    held = split.group_folds(folded.select("id", "grp"), "grp", max(2, round(1 / val_share)), seed + 1).select("id", "grp", (F.col("fold") == 0).alias("held"))
    return told.join(held, "id"), threshold, matrices.node_table(staged(matrices.cells(rules, features)), features)


METRICS = ("rep", "auc", "bacc")


def equal_budgets(folded: DataFrame, features: list[str], thetas: list[float], methods: tuple[str, ...] = experiments.METHODS) -> DataFrame:
    """(fold, method, theta, m, rep, auc, bacc): every method under every budget, each fold asked of the others."""
    folds = sorted(r[0] for r in folded.select("fold").distinct().collect())  # folds are few
    out = [experiments.compare_budgets(folded.filter(F.col("fold") != i).drop("fold"), folded.filter(F.col("fold") == i).drop("fold"), features, thetas, methods).withColumn("fold", F.lit(i)) for i in folds]
    return reduce(DataFrame.unionByName, out)


def paired_tests(raw: DataFrame, best: str = "greedy", alpha: float = 0.05) -> DataFrame:
    """(metric, theta, other, n, mean_gap, dz, p, p_adj, reject): best against each other method over folds, by signed ranks; Holm within each metric.

    raw has a row for each fold, method and budget."""
    long = raw.select("fold", "method", "theta", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x")).select("fold", "method", "theta", "x.*")
    own, other = long.filter(F.col("method") == best).withColumnRenamed("v", "a").drop("method"), long.filter(F.col("method") != best).withColumnRenamed("method", "other")
    gaps = other.join(own, ["fold", "theta", "metric"]).select("metric", "theta", "other", (F.col("a") - F.col("v")).alias("d"))
    rows = []
    for r in gaps.groupBy("metric", "theta", "other").agg(F.collect_list("d").alias("d"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).orderBy("metric", "theta", "other").collect():  # a number for each fold
        rows.append((r["metric"], r["theta"], r["other"], len(r["d"]), r["mean"], r["mean"] / r["sd"] if r["sd"] else None, stats.wilcoxon_greater(r["d"])))
    table = raw.sparkSession.createDataFrame(rows, "metric string, theta double, other string, n int, mean_gap double, dz double, p double")
    return reduce(DataFrame.unionByName, [stats.holm(table.filter(F.col("metric") == m), alpha=alpha) for m in METRICS])


#: What the chosen rules are tested against: a metric and another method, or all rules, at whatever budget.
FAMILIES = (("rep", "random"), ("rep", "strat_random"), ("auc", "random"), ("auc", "strat_random"), ("auc", "full"))


def family_tests(raw: DataFrame, methods: tuple[str, ...] = ("greedy", "stratified", "clustered"), families=FAMILIES, alpha: float = 0.05) -> DataFrame:
    """(metric, baseline, theta, method, mean_gap, half, better, n, dz, p, beaten, p_adj, reject): the methods against each family's baseline over folds.

    raw has (fold, method, theta, seed, rep, auc): a fold's value is the mean over its seeds.  A baseline named full counts at any
    budget.  beaten is the share of the baseline's seeds that the method is above, fold by fold.  All gaps come from one plan; only
    tests of a number for each fold are made on the driver.  Holm within a family."""
    keys = sorted({m for m, _ in families})
    long = raw.select("fold", "method", "theta", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in keys])).alias("x")).select("fold", "method", "theta", "x.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    own = long.filter(F.col("method").isin(*methods)).groupBy("fold", "method", "theta", "metric").agg(F.avg("v").alias("a"))
    asked = raw.sparkSession.createDataFrame(list(families), "metric string, baseline string")
    other = long.join(F.broadcast(asked), "metric").filter(F.col("method") == F.col("baseline")).select("metric", "baseline", F.col("fold").alias("_f"), F.col("theta").alias("_t"), "v")  # a row for each family
    met = own.join(other, "metric").filter((F.col("fold") == F.col("_f")) & ((F.col("baseline") == "full") | (F.col("theta") == F.col("_t"))))
    by = ["metric", "baseline", "theta", "method"]
    per = met.groupBy(*by, "fold").agg((F.first("a") - F.avg("v")).alias("d"), F.count_if(F.col("a") > F.col("v")).alias("won"), F.count("*").alias("of"))
    gathered = per.groupBy(*by).agg(F.collect_list("d").alias("d"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") > 0).alias("better"), (F.sum("won") / F.sum("of")).alias("beaten"))
    rows = []
    for r in gathered.orderBy(*by).collect():  # a number for each fold
        n, sd = len(r["d"]), r["sd"]
        half = stats.t_quantile(0.975, n - 1) * sd / n**0.5 if n > 1 else None
        dz = None if n < 2 else (0.0 if abs(r["mean"]) < 1e-12 else float("inf") * (1 if r["mean"] > 0 else -1)) if sd < 1e-12 else r["mean"] / sd
        rows.append((*[r[k] for k in by], r["mean"], half, r["better"], n, dz, stats.wilcoxon_greater(r["d"]), r["beaten"] if r["baseline"] != "full" else None))
    table = raw.sparkSession.createDataFrame(rows, "metric string, baseline string, theta double, method string, mean_gap double, half double, better int, n int, dz double, p double, beaten double")
    return reduce(DataFrame.unionByName, [stats.holm(table.filter((F.col("metric") == m) & (F.col("baseline") == b)), alpha=alpha) for m, b in families])


def method_summary(raw: DataFrame, values: tuple[str, ...] = ("rep", "auc", "bacc")) -> DataFrame:
    """(method, theta, metric, mean, sd, folds): over folds, of each fold's mean over its seeds."""
    long = raw.select("fold", "method", "theta", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in values])).alias("x")).select("fold", "method", "theta", "x.*")
    per = long.groupBy("method", "theta", "metric", "fold").agg(F.avg("v").alias("v"))
    return per.groupBy("method", "theta", "metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("v").alias("folds"))


def budget_study(rules: DataFrame, features: list[str], thetas: list[float], seed: int = 42) -> tuple[DataFrame, float, DataFrame]:
    """The greedy curve (theta, m, rep, auc, bacc) on an inner validation part, the budget where coverage bends, and the test row at that budget."""
    outer = staged(split.train_validation(rules, 0.2, seed=seed))
    inner = staged(split.train_validation(outer.filter("NOT held").drop("held"), 0.2, seed=seed + 1))
    curve = staged(experiments.compare_budgets(inner.filter("NOT held").drop("held"), inner.filter("held").drop("held"), features, thetas, ("greedy",)))
    best = experiments.best_budget(curve).first()["theta"]
    return curve, best, experiments.compare_budgets(outer.filter("NOT held").drop("held"), outer.filter("held").drop("held"), features, [best], ("greedy",))


def rank_methods(raw: DataFrame, metric: str = "rep", theta: float | None = None) -> tuple[float, float, DataFrame]:
    """Friedman's statistic and tail, and the gaps of mean ranks with their critical difference: of methods over folds at a budget, or over folds and budgets as blocks."""
    rows = raw if theta is None else raw.filter(F.col("theta") == theta)
    blocks = rows.select(F.concat_ws(":", "fold", "theta").alias("block"), "method", F.col(metric).alias("v"))
    q, p = stats.friedman(blocks)
    return q, p, stats.ranking_gaps(blocks)
