"""Inference by lookup: scores of queries against weight tables, decisions, calibration."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.operators.matrices import exploded, node_table, node_weights
from fuzzloom.operators.ordered import fitted
from fuzzloom.sources.staging import staged

EPS = 1e-12


def kinds(queries: DataFrame, features: list[str], k: int) -> tuple[DataFrame, list[str]]:
    """The distinct levels of queries with node and key, and the names of their columns.  Queries of equal levels have equal scores."""
    names = [f"_k{i}" for i in range(len(features))]
    return exploded(queries.select(*[F.col(c).alias(n) for c, n in zip(features, names, strict=True)]).distinct(), names, k), names


def told(queries: DataFrame, scores: DataFrame, features: list[str], names: list[str]) -> DataFrame:
    """(id, y) of queries with the scores of their levels, null where there are none; staged, so that few are sent to the queries."""
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(features, names, strict=True)])
    return queries.select("id", "y", *features).join(staged(scores), same, "left").select("id", "y", *[c for c in scores.columns if c not in names])


def pair_scores(queries: DataFrame, table: DataFrame, features: list[str]) -> DataFrame:
    """(id, d0, d1): least plus greatest weight over the levels that the table knows; null where it knows none."""
    each, names = kinds(queries, features, 1)
    long = each.withColumnsRenamed({"node": "attr", "key": "level"})
    d = long.join(table, ["attr", "level"]).groupBy(*names).agg(*[(F.min(F.when(F.col("y") == k, F.col("w"))) + F.max(F.when(F.col("y") == k, F.col("w")))).alias(f"d{k}") for k in (0, 1)])
    return told(queries, d, features, names)


def log_ratio(n: int = 1) -> Column:
    """Guarded log ratio of d1 and d0; 0 where nothing was decided."""
    d0, d1 = F.col("d0"), F.col("d1")
    return F.coalesce(F.ln(d1 / F.lit(float(n)) + EPS) - F.ln(d0 / F.lit(float(n)) + EPS), F.lit(0.0))


def decided(scores: DataFrame) -> DataFrame:
    """With margin, score and pred: the greater score, ties and undecided to label 0."""
    return scores.withColumns({"margin": F.coalesce(F.col("d1") - F.col("d0"), F.lit(0)), "score": log_ratio(), "pred": F.coalesce((F.col("d1") > F.col("d0")).cast("int"), F.lit(0))})


def probabilities(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """p1 by a softmax of the scores; 1/2 where undecided."""
    return scores.withColumn("p1", F.coalesce(1 / (1 + F.exp((F.col("d0") - F.col("d1")) / F.lit(temperature))), F.lit(0.5)))


def calibrate(scored: DataFrame, criterion: str = "bacc", zero: bool = True, weight: str | None = None) -> float:
    """The threshold among 197 quantiles, and with zero 0, whose `score > t` is best; the first of the best, to 12 digits.  With a weight a row counts so many times."""
    if criterion not in ("bacc", "acc"):
        raise ValueError(f"unknown criterion {criterion}")
    cuts = fitted(scored, ["score"], [0.01 + 0.98 * i / 196 for i in range(197)], weight=weight)["score"]
    ts = [] if cuts is None else sorted({0.0, *cuts} if zero else set(cuts))
    # A score is above the first so many thresholds; scores are counted by that number, at most 198.
    above = F.when(F.col("score").isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, ts)) if ts else F.array().cast("array<double>"), lambda t: t < F.col("score"))))
    counts = {r["above"]: (r["pos"], r["neg"]) for r in scored.groupBy(above.alias("above")).agg(*[F.sum(F.when(F.col("y") == y, F.col(weight) if weight else 1).otherwise(0)).alias(k) for y, k in ((1, "pos"), (0, "neg"))]).collect()}
    pos, neg = (sum(c[i] for c in counts.values()) for i in (0, 1))
    best, found = None, 0.0
    if not pos or not neg:
        return found
    tp, tn = pos - counts.get(-1, (0, 0))[0], 0
    for j, t in enumerate(ts):
        p, n = counts.get(j, (0, 0))
        tp, tn = tp - p, tn + n
        value = round((tp / pos + tn / neg) / 2 if criterion == "bacc" else (tp + tn) / (pos + neg), 12)
        if best is None or value > best:
            best, found = value, t
    return found


def node_scores(queries: DataFrame, table: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """(id, y, d0, d1, n_seen): greatest plus least node value, where nodes without a match count 0.  Crisp queries."""
    from math import comb

    n = comb(len(features), min(k, len(features)))
    each, names = kinds(queries, features, min(k, len(features)))
    hit = each.join(table, ["node", "key"])
    aggs = [F.countDistinct("node").alias("n_seen")]
    for y in (0, 1):
        v = F.when(F.col("y") == y, F.col("w"))
        aggs.append((F.coalesce(F.max(v), F.lit(0)) + F.when(F.count(v) < n, F.lit(0)).otherwise(F.min(v))).alias(f"d{y}"))
    return told(queries, hit.groupBy(*names).agg(*aggs), features, names).select("id", "y", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("d0", "d1", "n_seen")])


def fuzzy_nodes(memberships: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """(id, node, key, p) of queries given as (id, attr, level, mu): p is the product of degrees."""
    from itertools import combinations

    k, spark = min(k, len(features)), memberships.sparkSession
    nodes = F.broadcast(spark.createDataFrame([(i, list(t)) for i, t in enumerate(combinations(range(len(features)), k))], "node int, attrs array<int>"))
    m = memberships.filter("mu > 0")
    x = m.select("id").distinct().crossJoin(nodes).withColumn("key", F.lit(None).cast("string")).withColumn("p", F.lit(1.0))
    for j in range(k):
        one = m.select("id", F.col("attr").alias("_a"), "level", "mu")
        x = x.withColumn("_a", F.col("attrs")[j]).join(one, ["id", "_a"]).select("id", "node", "attrs", F.concat_ws("\u0001", "key", "level").alias("key"), (F.col("p") * F.col("mu")).alias("p"))
    return x.drop("attrs")


def fuzzy_node_scores(memberships: DataFrame, table: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """(id, d0, d1) of queries given as (id, attr, level, mu): nodes weigh by the product of degrees."""
    from math import comb

    each = staged(degrees(memberships))
    cases = staged(each.groupBy("held").agg(F.min("id").alias("id")))  # queries of equal degrees have equal scores
    per = fuzzy_nodes(cases.select("id", F.inline("held")), features, k).join(table, ["node", "key"]).groupBy("id", "node", "y").agg(F.sum(F.col("p") * F.col("w")).alias("v"))
    n = comb(len(features), min(k, len(features)))
    aggs = [(F.coalesce(F.max(F.when(F.col("y") == y, F.col("v"))), F.lit(0.0)) + F.when(F.count(F.when(F.col("y") == y, F.col("v"))) < n, 0.0).otherwise(F.min(F.when(F.col("y") == y, F.col("v"))))).alias(f"d{y}") for y in (0, 1)]
    scores = staged(cases.join(per.groupBy("id").agg(*aggs), "id").drop("id"))
    return each.join(scores, "held", "left").select("id", "d0", "d1").na.fill(0.0, ["d0", "d1"])


def sequential_scores(queries: DataFrame, cs: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """As node_scores, but each rule is weighed against each query in every node, as a check of the lookup.

    Equal rules are weighed once with their number, and equal queries once: its cost is distinct queries x cells x nodes."""
    from math import comb

    k = min(k, len(features))
    n = comb(len(features), k)
    rules = node_weights(cs, features, k).join(cs.select("cell", "y", F.col("w").alias("n")), "cell").select("node", F.col("key").alias("own"), F.col("y").alias("label"), (F.col("b") * F.col("n")).alias("w"))
    asked, names = kinds(queries, features, k)
    each = asked.join(rules, "node").groupBy(*names, "node", "label").agg(F.sum(F.when(F.col("key") == F.col("own"), F.col("w")).otherwise(0)).alias("v"))
    value = lambda y: F.when((F.col("label") == y) & (F.col("v") > 0), F.col("v"))
    aggs = [(F.coalesce(F.max(value(y)), F.lit(0)) + F.when(F.count(value(y)) < n, F.lit(0)).otherwise(F.min(value(y)))).cast("long").alias(f"d{y}") for y in (0, 1)]
    aggs.append(F.countDistinct(F.when(F.col("v") > 0, F.col("node"))).alias("n_seen"))
    return told(queries, each.groupBy(*names).agg(*aggs), features, names).na.fill(0, ["d0", "d1", "n_seen"])


DECISIONS = ("argmax", "calibrated", "ratio9")


def decide(scores: DataFrame, how: str = "argmax", threshold: float | None = None, fallback: int = 0, ties: int = 0) -> DataFrame:
    """scores (d0, d1[, n_seen]) with pred: by the greater value (ties as told), by the log ratio against a threshold, or by the fixed ratio.

    Where nothing was seen pred is the fallback.  Calibrated decisions without a threshold are argmax ones."""
    if how not in DECISIONS:
        raise ValueError(f"unknown decision {how}")
    d0, d1 = F.coalesce("d0", F.lit(0)), F.coalesce("d1", F.lit(0))
    seen = F.col("n_seen") > 0 if "n_seen" in scores.columns else (d0 != 0) | (d1 != 0)
    greater = (d1 >= d0 if ties else d1 > d0).cast("int")
    pred = {"argmax": greater, "calibrated": greater if threshold is None else (F.ln(d1 + EPS) - F.ln(d0 + EPS) > F.lit(float(threshold))).cast("int"), "ratio9": ratio_decision(d0, d1)}[how]
    return scores.withColumn("pred", F.when(seen, pred).otherwise(fallback))


def ratio_decision(d0: Column, d1: Column, ratio: float | Column = 9.0) -> Column:
    return F.when(d0 > d1 * ratio, 0).otherwise(1)


def legacy_table(rules: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """The node table as the legacy form sees it: without entries that only the rule of the greatest id holds.

    Rules of equal levels and label share one value, so which of them is taken last does not matter."""
    last = rules.agg(F.max("id").alias("last"))
    cs = rules.groupBy(*features, "y").agg(F.count("*").alias("w"), F.min("id").alias("cell"), F.max("id").alias("top"))
    seen = exploded(cs, features, k).crossJoin(F.broadcast(last)).groupBy("node", "key", "y").agg(F.sum(F.col("w") - (F.col("top") == F.col("last")).cast("int")).alias("n")).filter("n > 0")
    return node_table(cs.drop("top"), features, k).join(seen, ["node", "key", "y"], "left_semi")


def prior_ratio(rules: DataFrame) -> DataFrame:
    """One row: ratio, the squared quotient of the labels' counts; null where label 1 has no rule."""
    n = lambda y: F.count_if(F.col("y") == y).cast("double")
    return rules.agg(F.pow(F.try_divide(n(0), n(1)), F.lit(2)).alias("ratio"))


def legacy_decided(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """With pred by the fixed ratio and prior_pred by the labels' own."""
    with_ratio = scores.crossJoin(F.broadcast(prior_ratio(rules)))
    return with_ratio.withColumns({"pred": ratio_decision(F.col("d0"), F.col("d1")), "prior_pred": ratio_decision(F.col("d0"), F.col("d1"), F.col("ratio"))}).drop("ratio")


def calibrated_probabilities(scores: DataFrame, threshold: float, temperature: float = 1.0) -> DataFrame:
    """p1 by a softmax of log scores, where label 1 loses the threshold; 1/2 where no node was seen."""
    gap = F.ln(F.col("d1") + EPS) - F.lit(float(threshold)) - F.ln(F.col("d0") + EPS)
    return scores.withColumn("p1", F.when(F.col("n_seen") == 0, 0.5).otherwise(1 / (1 + F.exp(-gap / F.lit(max(float(temperature), 1e-6))))))


def attribution(decided: DataFrame, queries: DataFrame, cs: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """(id, cell, v): the share that a cell's rules have in the decision; decided has (id, pred, d0, d1, n_seen) of crisp queries."""
    names = [f"_k{i}" for i in range(len(features))]
    levels = queries.select("id", *[F.col(c).alias(n) for c, n in zip(features, names, strict=True)])
    nodes = lambda cases: exploded(cases.select("id", *names), names, min(k, len(features))).select("id", "node", "key", F.lit(1).alias("p"))
    return _by_case(decided, levels, names, nodes, cs, features, k)


def degrees(memberships: DataFrame) -> DataFrame:
    """(id, held): all degrees above 0 of each query as one sorted value, null where the id is; a query has as many as levels at most."""
    one = F.when(F.col("id").isNotNull() & (F.col("mu") > 0), F.struct("attr", "level", "mu"))
    return memberships.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("held"))


def fuzzy_attribution(decided: DataFrame, memberships: DataFrame, cs: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """The same of queries given as (id, attr, level, mu); decided has (id, pred)."""
    nodes = lambda cases: fuzzy_nodes(cases.select("id", F.inline("held")), features, k)
    return _by_case(decided, degrees(memberships), ["held"], nodes, cs, features, k)


def _by_case(decided: DataFrame, asked: DataFrame, names: list[str], nodes: Callable[[DataFrame], DataFrame], cs: DataFrame, features: list[str], k: int) -> DataFrame:
    """Queries of equal levels or degrees (columns names) and decision have equal shares: the first of them is attributed, and all are told."""
    each = staged(decided.select("id", "pred").join(asked, "id", "left"))
    cases = staged(each.groupBy(*names, "pred").agg(F.min("id").alias("id")))
    shares = staged(_attribution(cases.select("id", "pred"), nodes(cases), cs, features, k))
    first = cases.select(F.col("id").alias("_case"), *[F.col(c).alias(f"_{c}") for c in [*names, "pred"]])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*names, "pred"]])
    return each.join(first, same).select("id", "_case").join(shares.withColumnRenamed("id", "_case"), "_case").select("id", "cell", "v")


def _attribution(decided: DataFrame, asked: DataFrame, cs: DataFrame, features: list[str], k: int) -> DataFrame:
    """Only rules of the decided label count, at its first least and first greatest node, where
    unmatched nodes hold 0.  Shares are even over that label's rules if nothing was seen or won."""
    from math import comb

    k = min(k, len(features))
    asked = asked.join(decided.select("id", "pred"), "id")
    table = node_table(cs, features, k).withColumnRenamed("y", "pred")
    value = F.coalesce(F.sum(F.col("p") * F.col("w")), F.lit(0))
    per = asked.join(table, ["node", "key", "pred"], "left").groupBy("id", "node").agg(value.alias("w"))
    every = asked.select("id").distinct().withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(comb(len(features), k) - 1))))  # nodes that a null level leaves out hold 0
    hit = every.join(per, ["id", "node"], "left").withColumn("w", F.coalesce("w", F.lit(0)))
    ends = hit.groupBy("id").agg(F.min(F.struct("w", "node")).alias("low"), F.min(F.struct((-F.col("w")).alias("w"), "node")).alias("high"))
    nodes = ends.select("id", F.explode(F.array("low.node", "high.node")).alias("node"))
    b = node_weights(cs, features, k).join(cs.select("cell", F.col("y").alias("pred"), F.col("w").alias("n")), "cell")
    parts = asked.join(nodes, ["id", "node"]).join(b, ["node", "key", "pred"]).groupBy("id", "cell").agg(F.sum(F.col("p") * F.col("b") * F.col("n")).alias("c"))
    shares = parts.withColumn("v", F.col("c") / F.sum("c").over(Window.partitionBy("id"))).select("id", "cell", "v")
    even = cs.select("cell", F.col("y").alias("pred"), (F.col("w") / F.sum("w").over(Window.partitionBy("y"))).alias("v"))
    rest = decided.select("id", "pred").join(shares.select("id").distinct(), "id", "left_anti").join(even, "pred").select("id", "cell", "v")
    return shares.unionByName(rest)


def with_fallback(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """With matched and pred: the greater score, ties to label 0; the majority label (ties to the lower) where no node matched."""
    most = rules.groupBy("y").agg(F.count("*").alias("n")).agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("_m"))
    x = scores.crossJoin(F.broadcast(most)).withColumn("matched", F.col("n_seen") > 0)
    return x.withColumn("pred", F.when(F.col("matched"), (F.col("d1") > F.col("d0")).cast("int")).otherwise(F.col("_m"))).drop("_m")


def out_of_fold(rules: DataFrame, features: list[str], k: int, k_node: int = 3) -> DataFrame:
    """(id, y, d0, d1, n_seen, fold): each fold of 0 to k-1 scored by the node table of the others.

    Rules are read once for the cells of all folds."""
    by_fold, parts = staged(rules.groupBy(*features, "y", "fold").agg(F.count("*").alias("w"), F.min("id").alias("cell"))), []
    for i in range(k):
        cs = by_fold.filter(F.col("fold") != i).groupBy(*features, "y").agg(F.sum("w").alias("w"), F.min("cell").alias("cell"))
        table = node_table(staged(cs), features, k_node)
        parts.append(node_scores(rules.filter(F.col("fold") == i), table, features, k_node).withColumn("fold", F.lit(i)))
    return reduce(DataFrame.unionByName, parts)


def evidence_table(rules: DataFrame, features: list[str]) -> DataFrame:
    """(attr, level, y, w): sums of support times confidence, the older weights."""
    x = exploded(rules, features, 1)
    return x.groupBy(F.col("node").alias("attr"), F.col("key").alias("level"), "y").agg(F.sum(F.col("support") * F.col("confidence")).alias("w"))


def top_rules(contributions: DataFrame, k: int = 5) -> DataFrame:
    """The k largest contributions (id, rule, c) of each query; ties to the lower rule."""
    order = Window.partitionBy("id").orderBy(F.desc("c"), "rule")
    return contributions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
