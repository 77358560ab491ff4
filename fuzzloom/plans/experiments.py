"""Comparisons of sampling methods at equal budgets, and the budget where the curve bends.

Each method and budget is a few jobs over the tables; their rows are written one by one, as a
plan of all of them outgrows the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzloom.functions import stats
from fuzzloom.operators import infer, matrices, metrics, sampling, split
from fuzzloom.sources.staging import staged

METHODS = ("greedy", "stratified", "clustered", "random", "strat_random")


def sampled(method: str, rules: DataFrame, cs: DataFrame, features: list[str], theta: float, m: int, seed: int = 0) -> DataFrame:
    """The chosen rules as cells, with w of them each: min(m, all) rules by any method."""
    pick = {
        "greedy": lambda: sampling.greedy_rules(rules, cs, features, m),
        "stratified": lambda: sampling.greedy_stratified_rules(rules, cs, features, theta),
        "clustered": lambda: sampling.greedy_clustered_rules(rules, cs, features, theta),
        "random": lambda: split.random_sample(rules, m, seed=seed),
        "strat_random": lambda: split.strat_random(rules, theta, seed=seed),
    }
    if method not in pick:
        raise ValueError(f"unknown method {method}")
    rows = rules.join(pick[method]().select("id"), "id", "left_semi")
    own, of = matrices.cells(rows, features).drop("cell").alias("l"), cs.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*features, "y")]
    return own.join(of, reduce(lambda a, b: a & b, same)).select("l.*", "r.cell")


def compare_budgets(rules: DataFrame, asked: DataFrame, features: list[str], thetas: list[float], methods: tuple[str, ...] = METHODS, seed: int = 0) -> DataFrame:
    """(method, theta, m, rep, auc, bacc): coverage of the rules by each sample, and decisions on asked rows by its weights."""
    rules = staged(rules)
    cs = staged(matrices.cells(rules, features))
    n, out = rules.count(), []
    for method in methods:
        for theta in thetas:
            m = split.budget(theta, n)
            chosen = staged(sampled(method, rules, cs, features, theta, m, seed))
            rep = sampling.coverage_stats(sampling.coverage(cs, chosen, features), len(features)).select("rep")
            scored = staged(infer.decided(infer.pair_scores(asked, matrices.pair_table(chosen, features), features)).withColumn("score", F.round("score", 9)).select("y", "score", "pred"))
            row = rep.crossJoin(metrics.auc(scored)).crossJoin(metrics.confusion(scored).select("bacc"))  # one row each
            # Written as it is found: the driver then plans one of them at a time.
            out.append(staged(row.select(F.lit(method).alias("method"), F.lit(theta).alias("theta"), F.lit(m).alias("m"), "rep", "auc", "bacc")))
    return reduce(DataFrame.unionByName, out)


def best_budget(curve: DataFrame, value: str = "rep") -> DataFrame:
    """The row of each method where its curve of running greatest values bends; methods are few."""
    rows = []
    for (method,) in curve.select("method").distinct().orderBy("method").collect():
        rows.append(stats.knee(curve.filter(F.col("method") == method), "theta", value))
    if not rows:
        raise ValueError("the curve is empty")
    return reduce(DataFrame.unionByName, rows)
