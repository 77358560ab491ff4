"""Similarity of rules, coverage, and submodular selection.

Similarity counts matching attributes among rules of the same label; other labels never
cover.  Gains are whole numbers of matches, so ties are exact and go to the lower id.
Greedy selection runs on cells, one task for each label, which hold few rows however many
rules there are; equal cells of one label differ in nothing but their number."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.operators.clusters import clustered as form_clusters
from fuzzloom.operators.split import allocate, budget, largest_remainder
from fuzzloom.sources.staging import staged


def matches(features: list[str], a: str = "l", b: str = "r"):
    return sum((F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")).cast("int") for c in features), F.lit(0))


def similarity(cs: DataFrame, features: list[str]) -> DataFrame:
    """(i, j, y, m): matching attributes of all pairs of cells with the same label."""
    return cs.alias("l").join(cs.alias("r"), "y").select(F.col("l.cell").alias("i"), F.col("r.cell").alias("j"), "y", matches(features).alias("m"))


SEP, MOST_FEATURES = "\u0001", 12


def patterns(df: DataFrame, features: list[str]) -> DataFrame:
    """df with _s, _k and _key: a row for each choice of attributes (_s its number, _k their count) with their levels; a null is a level of its own."""
    if len(features) > MOST_FEATURES:
        raise ValueError(f"patterns are made of {MOST_FEATURES} attributes at most")
    level = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in features]
    each = [F.struct(F.lit(s).alias("_s"), F.lit(s.bit_count()).alias("_k"), F.concat_ws(SEP, *[x for i, x in enumerate(level) if s >> i & 1]).alias("_key")) for s in range(1, 1 << len(features))]
    return df.withColumn("_x", F.explode(F.array(*each))).select(*df.columns, "_x.*")


def _worth(k, cov):
    """What a cell that is covered so much adds to a pattern of k attributes, by inclusion and exclusion.

    A cell counts for a candidate once for each v from cov + 1 to their number of matches.  Matches of v or more
    are a sum over the attributes on which both agree: of (-1)^(k - v) * C(k - 1, v - 1) for each k of them."""
    from math import comb

    table = [[sum((-1) ** (n - v) * comb(n - 1, v - 1) for v in range(c + 1, n + 1)) for c in range(n + 1)] for n in range(1, MOST_FEATURES + 1)]
    rows = F.array(*[F.array(*[F.lit(x) for x in row]) for row in table])
    return F.coalesce(F.get(F.get(rows, k - 1), cov.cast("int")), F.lit(0)).cast("long")


def coverage(cs: DataFrame, chosen: DataFrame, features: list[str]) -> DataFrame:
    """(cell, w, cov): the most matches with a chosen cell (column cell) of the same label, 0 without.

    Cells meet the chosen ones by equal patterns, so no pairs of a label are made."""
    few = patterns(cs.join(chosen.select("cell").distinct(), "cell").select("y", *features), features).select(F.col("y").alias("_y2"), F.col("_s").alias("_s2"), F.col("_key").alias("_key2")).distinct()
    met = patterns(cs.select("cell", "y", *features), features).join(few, F.col("y").eqNullSafe(F.col("_y2")) & (F.col("_s") == F.col("_s2")) & (F.col("_key") == F.col("_key2")), "left_semi")
    near = met.groupBy("cell").agg(F.max("_k").alias("cov"))
    return cs.select("cell", "w").join(near, "cell", "left").na.fill(0, ["cov"])


def coverage_stats(cov: DataFrame, n_features: int, delta: float = 0.8) -> DataFrame:
    """One row: rep, min_cov, frac_covered and full_cover at delta, weighted by the cells' rules."""
    c = F.col("cov") / F.lit(float(n_features))
    at = c >= delta - 1e-12
    return cov.agg((F.sum(F.col("cov") * F.col("w")) / (F.sum("w") * F.lit(float(n_features)))).alias("rep"), F.min(c).alias("min_cov"), (F.sum(F.when(at, F.col("w")).otherwise(0)) / F.sum("w")).alias("frac_covered"), F.bool_and(at).alias("full_cover"))


def pattern_gains(cs: DataFrame, features: list[str]) -> DataFrame:
    """(cell, gain) of all cells (cell, y, w, cov, features): counts by pattern, and a sum over a candidate's own patterns."""
    each = staged(patterns(cs.select("cell", "y", "w", "cov", *features), features))
    worth = each.groupBy("y", "_s", "_key").agg(F.sum(F.col("w") * _worth(F.col("_k"), F.col("cov"))).alias("g")).withColumnsRenamed({"y": "_y2", "_s": "_s2", "_key": "_key2"})
    return each.join(worth, F.col("y").eqNullSafe(F.col("_y2")) & (F.col("_s") == F.col("_s2")) & (F.col("_key") == F.col("_key2"))).groupBy("cell").agg(F.sum("g").alias("gain"))


def marginal_gains(cs: DataFrame, chosen: DataFrame, features: list[str]) -> DataFrame:
    """(cell, gain): matches that each cell would add, over all rules."""
    return pattern_gains(cs.join(coverage(cs, chosen, features).drop("w"), "cell"), features)


def diversity(cs: DataFrame, features: list[str]) -> DataFrame:
    """(y, diversity): 1 less the mean similarity within the label, 1e-9 at least; from the squares of each level's count."""
    levels = cs.select("y", "w", F.posexplode(F.array(*[F.col(c).cast("string") for c in features])).alias("f", "level"))
    same = levels.groupBy("y", "f", "level").agg(F.sum("w").alias("n")).groupBy("y").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    size = cs.groupBy("y").agg(F.sum("w").alias("n")).select(F.col("y").alias("_y2"), F.col("n"))
    joined = same.join(size, F.col("y").eqNullSafe(F.col("_y2")))
    return joined.select("y", F.greatest(1 - F.col("pairs") / (F.col("n") * F.col("n") * F.lit(float(len(features)))), F.lit(1e-9)).alias("diversity"))


def _greedy(features: list[str], m: int, stop: float | None, mode: str = "mean"):
    """Lazy greedy choice of cells; a gain is found when it is asked for, so no matrix of all pairs is held."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell").reset_index(drop=True)
        codes = np.stack([pd.factorize(pdf[c], use_na_sentinel=False)[0] for c in features], axis=1)
        w, cov, out, p = pdf["w"].to_numpy(np.int64), np.zeros(len(pdf), np.int64), [], len(features)
        label = pdf["y"].to_numpy()
        alike = lambda i: ((codes == codes[i]).sum(axis=1) * (label == label[i])).astype(np.int64)
        gain = lambda i: int((np.maximum(alike(i) - cov, 0) * w).sum())
        # Gains only fall as more is covered, so a cell whose old gain is below another's new one need not be looked at.
        heap = [(-(p * int(w.sum())), i, -1) for i in range(len(pdf))]
        while heap and len(out) < m:
            if stop is not None and out and ((cov * w).sum() >= (stop - 1e-12) * p * w.sum() if mode == "mean" else cov.min() >= (stop - 1e-12) * p):
                break
            old, i, at = heapq.heappop(heap)
            if at != len(out):
                heapq.heappush(heap, (-gain(i), i, len(out)))
                continue
            if old == 0:
                break
            cov = np.maximum(cov, alike(i))
            out.append((pdf["cell"][i], pdf["y"][i], len(out), -old))
        return pd.DataFrame(out, columns=["cell", "y", "rank", "gain"])

    return run


def greedy_by_label(cs: DataFrame, features: list[str], m: int, stop: float | None = None, mode: str = "mean") -> DataFrame:
    """(cell, y, rank, gain): the greedy order within each label, until nothing is gained; stop by mean coverage or, with mode all, by the least."""
    if m < 0 or m != int(m):
        raise ValueError("the budget must be a whole number from 0")
    if mode not in ("mean", "all"):
        raise ValueError(f"unknown mode {mode}")
    largest = cs.groupBy("y").count().agg(F.max("count")).first()[0] or 0
    if largest > LOCAL_CELLS and len(features) <= MOST_FEATURES:
        return greedy_tables(cs, features, m, stop, mode)
    return cs.groupBy("y").applyInPandas(_greedy(features, m, stop, mode), "cell long, y int, rank int, gain long")


LOCAL_CELLS = 100_000  # cells of a label that one task chooses from; of more, the same choice is made by tables


def greedy_tables(cs: DataFrame, features: list[str], m: int, stop: float | None = None, mode: str = "mean") -> DataFrame:
    """greedy_by_label with the gains of all cells in a table.

    A step takes the best cell of each label by one aggregation.  Cells that it covers better than before change
    what their patterns are worth, and only the gains of cells with such a pattern are updated."""
    p = len(features)
    start = cs.select("cell", F.col("y").cast("int").alias("y"), "w", *features).withColumn("cov", F.lit(0))
    now = staged(start.join(pattern_gains(start, features), "cell"))
    open_labels, out = staged(now.select(F.col("y").alias("_o")).distinct()), None
    for k in range(m):
        best = now.join(open_labels, F.col("y").eqNullSafe(F.col("_o")), "left_semi").groupBy("y").agg(F.max(F.struct("gain", (-F.col("cell")).alias("at"), *features)).alias("b"))
        if stop is not None and k:
            reached = F.sum(F.col("cov") * F.col("w")) >= (stop - 1e-12) * p * F.sum("w") if mode == "mean" else F.min("cov") >= (stop - 1e-12) * p
            left = now.groupBy("y").agg(reached.alias("r")).filter("NOT r").select(F.col("y").alias("_y2"))
            best = best.join(left, F.col("y").eqNullSafe(F.col("_y2")), "left_semi")
        picked = staged(best.filter("b.gain > 0").select((-F.col("b.at")).alias("cell"), "y", F.lit(k).alias("rank"), F.col("b.gain").alias("gain"), *[F.col(f"b.{c}").alias(f"_{c}") for c in features]))
        if picked.isEmpty():
            break
        rows = picked.select("cell", "y", "rank", "gain")
        out = rows if out is None else out.unionByName(rows)
        open_labels = picked.select(F.col("y").alias("_o"))
        same = sum((F.col(c).eqNullSafe(F.col(f"_{c}")).cast("int") for c in features), F.lit(0))
        met = now.join(picked.select(F.col("y").alias("_y2"), *[f"_{c}" for c in features]), F.col("y").eqNullSafe(F.col("_y2")), "left")  # one row a label
        new = staged(met.withColumn("_new", F.greatest("cov", F.coalesce(same, F.lit(0)))).drop("_y2", *[f"_{c}" for c in features]))
        changed = patterns(new.filter("_new > cov").select("y", "w", "cov", "_new", *features), features)
        delta = staged(changed.groupBy("y", "_s", "_key").agg(F.sum(F.col("w") * (_worth(F.col("_k"), F.col("_new")) - _worth(F.col("_k"), F.col("cov")))).alias("_d")).filter("_d <> 0").withColumnsRenamed({"y": "_y2", "_s": "_s2", "_key": "_key2"}))
        moved = patterns(new.select("cell", "y", *features), features).join(delta, F.col("y").eqNullSafe(F.col("_y2")) & (F.col("_s") == F.col("_s2")) & (F.col("_key") == F.col("_key2"))).groupBy("cell").agg(F.sum("_d").alias("_d"))
        now = staged(new.join(moved, "cell", "left").select("cell", "y", "w", *features, F.col("_new").alias("cov"), (F.col("gain") + F.coalesce("_d", F.lit(0))).alias("gain")))
    return out if out is not None else cs.sparkSession.createDataFrame([], "cell long, y int, rank int, gain long")


def greedy(cs: DataFrame, features: list[str], m: int, stop: float | None = None, mode: str = "mean") -> DataFrame:
    """The global greedy choice of cells that gain: the labels' orders merged by gain, as a rule covers its own label only."""
    if stop is None:
        return greedy_by_label(cs, features, m).orderBy(F.desc("gain"), "cell").limit(m)
    if mode == "all":  # every label's least coverage has to reach it; merged, the last label to do so ends the choice
        ends = greedy_by_label(cs, features, m, stop, mode)
        last = ends.groupBy("y").agg(F.max_by(F.struct("gain", (-F.col("cell")).alias("cell")), "rank").alias("e")).agg(F.min("e").alias("e"))
        every = greedy_by_label(cs, features, m).crossJoin(F.broadcast(last))  # one row
        return every.filter(F.struct("gain", (-F.col("cell")).alias("cell")) >= F.col("e")).drop("e").orderBy(F.desc("gain"), "cell").limit(m)
    total = cs.agg(F.sum("w")).first()[0] or 0
    order = Window.orderBy(F.desc("gain"), "cell")  # cells that gain, as many as the budget at most
    before = F.coalesce(F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = greedy_by_label(cs, features, m).orderBy(F.desc("gain"), "cell").limit(m)
    return every.withColumn("_b", before).filter((F.col("_b") < (stop - 1e-12) * len(features) * total) | (F.col("_b") == 0)).drop("_b")


def filled(rules: DataFrame, picks: DataFrame, quota: dict | int) -> DataFrame:
    """(id, y, rank, gain): the picked cells' first rules, and then others by id, which gain nothing, up to the budget in all or of each label (or other part: column part)."""
    if isinstance(quota, int):
        rules, picks, quota = rules.withColumn("part", F.lit(0)), picks.withColumn("part", F.lit(0)), {0: quota}
    chosen = picks.select(F.col("cell").alias("id"), "part", "rank", "gain")
    rest = rules.join(chosen.select("id"), "id", "left_anti").select("id", "y", "part")
    have = {r["part"]: r["n"] for r in chosen.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each part
    own = [rules.join(chosen.drop("part"), "id").select("id", "y", "part", "rank", "gain")]
    for part, q in quota.items():  # parts are few
        if (lack := q - have.get(part, 0)) > 0:
            some = rest.filter(F.col("part") == F.lit(part)).orderBy("id").limit(lack)
            own.append(some.select("id", "y", "part", F.lit(None).cast("int").alias("rank"), F.lit(0).cast("long").alias("gain")))
    out = own[0]
    for x in own[1:]:
        out = out.unionByName(x)
    return out


def greedy_rules(rules: DataFrame, cs: DataFrame, features: list[str], m: int) -> DataFrame:
    """(id, y, rank, gain): the global greedy choice of exactly min(m, all) rules."""
    return filled(rules, greedy(cs, features, m), m).drop("part")


def stratified_quota(cs: DataFrame, features: list[str], theta: float, method: str = "proportional", exact: bool = True) -> dict:
    strata = sorted((r[0], r[1]) for r in cs.groupBy("y").agg(F.sum("w")).collect())  # one row for each label
    spread = {r["y"]: r["diversity"] for r in diversity(cs, features).collect()} if method == "neyman" else {}
    quota = allocate([n for _, n in strata], theta, method, exact, [spread.get(y, 1.0) for y, _ in strata])
    return dict(zip([y for y, _ in strata], quota, strict=True))


def greedy_stratified(cs: DataFrame, features: list[str], theta: float, method: str = "proportional", exact: bool = True) -> DataFrame:
    """Greedy choice of cells within each label under its budget."""
    quota = stratified_quota(cs, features, theta, method, exact)
    picks = greedy_by_label(cs, features, max(quota.values(), default=0))
    most = F.create_map(*[x for y, q in quota.items() for x in (F.lit(y), F.lit(q))]) if quota else F.lit(None).cast("map<int,int>")
    return picks.filter(F.col("rank") < most[F.col("y")])


def greedy_stratified_rules(rules: DataFrame, cs: DataFrame, features: list[str], theta: float, method: str = "proportional", exact: bool = True) -> DataFrame:
    """(id, y, rank, gain): greedy within each label, of exactly its budget."""
    picks = greedy_stratified(cs, features, theta, method, exact).withColumn("part", F.col("y"))
    return filled(rules.withColumn("part", F.col("y")), picks, stratified_quota(cs, features, theta, method, exact)).drop("part")


def clustered(cs: DataFrame, features: list[str], clusters: int = 5, seed: int = 0) -> DataFrame:
    """The cells with cluster: k-means on one-hot levels within each label."""
    return form_clusters(cs, features, clusters, ["y"], seed)


def _part():
    return F.concat_ws(":", "y", "cluster")


def clustered_quota(parts: DataFrame, features: list[str], theta: float, method: str = "proportional") -> dict:
    """The budget of each part, y:cluster: first of labels, then of a label's clusters by size."""
    labels, out = stratified_quota(parts, features, theta, method), {}
    sizes = sorted(((r[0], r[1], r[2]) for r in parts.groupBy("y", "cluster").agg(F.sum("w")).collect()))  # labels x clusters rows
    for y, q in labels.items():
        own = [(c, n) for label, c, n in sizes if label == y]
        out |= {f"{y}:{c}": k for (c, _), k in zip(own, largest_remainder([n for _, n in own], q), strict=True)}
    return out


def greedy_clustered(cs: DataFrame, features: list[str], theta: float, clusters: int = 5, seed: int = 0, parts: DataFrame | None = None) -> DataFrame:
    """Greedy choice of cells within clusters of each label, under budgets of both levels."""
    parts = clustered(cs, features, clusters, seed) if parts is None else parts
    quota = clustered_quota(parts, features, theta)

    def picked(pdf: pd.DataFrame) -> pd.DataFrame:
        cluster = int(pdf["cluster"].iloc[0])
        return _greedy(features, quota[f"{pdf['y'].iloc[0]}:{cluster}"], None)(pdf).assign(cluster=cluster)

    return parts.groupBy("y", "cluster").applyInPandas(picked, "cell long, y int, rank int, gain long, cluster int")


def greedy_clustered_rules(rules: DataFrame, cs: DataFrame, features: list[str], theta: float, clusters: int = 5, seed: int = 0) -> DataFrame:
    """(id, y, rank, gain): greedy within clusters of each label, of exactly the budget in all."""
    parts = clustered(cs, features, clusters, seed)
    picks = greedy_clustered(cs, features, theta, parts=parts).withColumn("part", _part())
    of = parts.select(*[F.col(c).alias(f"_{c}") for c in (*features, "y")], _part().alias("part"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*features, "y")]
    with_part = rules.join(of, reduce(lambda a, b: a & b, on)).select(*rules.columns, "part")
    return filled(with_part, picks, clustered_quota(parts, features, theta)).drop("part")


DESIGNS, BUDGETS = ("two_stage", "one_stage"), ("exact", "ceil")


def cluster_budgets(parts: DataFrame, theta: float, within_label: bool = True, mode: str = "exact") -> dict:
    """The budget of each part: in whole parts of its own (ceil), or of exactly the budget in all, dealt to labels first where clusters are within labels."""
    if mode not in BUDGETS:
        raise ValueError(f"unknown budget mode {mode}")
    rows = sorted((r["y"] if within_label else None, r["cluster"], r["part"], r["n"]) for r in parts.groupBy(*(["y"] if within_label else []), "cluster", "part").agg(F.sum("w").alias("n")).withColumn("y", F.col("y") if within_label else F.lit(0)).collect()) if not parts.isEmpty() else []  # clusters are few
    sizes = [n for *_, n in rows]
    if mode == "ceil":
        return {part: min(budget(theta, n), n) for _, _, part, n in rows}
    m = budget(theta, sum(sizes))
    if not within_label:
        return dict(zip([r[2] for r in rows], largest_remainder(sizes, m), strict=True))
    labels = sorted({r[0] for r in rows})
    out = {}
    for y, q in zip(labels, largest_remainder([sum(r[3] for r in rows if r[0] == y) for y in labels], m), strict=True):
        own = [r for r in rows if r[0] == y]
        out |= dict(zip([r[2] for r in own], largest_remainder([r[3] for r in own], q), strict=True))
    return out


def cluster_select(rules: DataFrame, cs: DataFrame, features: list[str], theta: float, clusters: int = 5, seed: int = 0, design: str = "two_stage", mode: str = "exact", within_label: bool = True) -> DataFrame:
    """(id, y, part, rank, gain): rules chosen by clusters.

    One stage takes all rules of all clusters; two stages choose greedily within each, under budgets.
    Clusters are formed within labels, so many in each, or over all rules, so many for each label."""
    if design not in DESIGNS:
        raise ValueError(f"unknown design {design}")
    labels = 1 if within_label else cs.select("y").distinct().count()
    formed = form_clusters(cs, features, clusters * max(labels, 1), ["y"] if within_label else [], seed)
    parts = staged(formed.withColumn("part", _part() if within_label else F.col("cluster").cast("string")))
    of = parts.select(*[F.col(c).alias(f"_{c}") for c in (*features, "y")], "part")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*features, "y")])
    with_part = rules.join(of, on).select(*rules.columns, "part")
    if design == "one_stage":
        none = with_part if budget(theta, 1) else with_part.limit(0)
        return none.select("id", "y", "part", F.lit(None).cast("int").alias("rank"), F.lit(0).cast("long").alias("gain"))
    quota = cluster_budgets(parts, theta, within_label, mode)

    def picked(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf["part"].iloc[0]
        return _greedy(features, quota[part], None)(pdf).assign(part=part)

    picks = parts.groupBy("part").applyInPandas(picked, "cell long, y int, rank int, gain long, part string")
    return filled(with_part, picks, quota)


def best_subset(cs: DataFrame, features: list[str], m: int) -> DataFrame:
    """One row: the greatest sum of covered matches over all choices of m of at most 18 cells, and the first such choice as bits."""
    n = cs.count()
    if n > 18:
        raise ValueError("all subsets are tried for 18 cells at most")
    at = cs.withColumn("no", F.row_number().over(Window.orderBy("cell")) - 1)
    sim = similarity(cs, features).join(at.select(F.col("cell").alias("j"), "no"), "j").join(cs.select(F.col("cell").alias("i"), "w"), "i")
    subsets = cs.sparkSession.range(1 << n).filter(F.bit_count("id") == m).withColumnRenamed("id", "bits")
    hit = subsets.crossJoin(F.broadcast(sim)).filter(F.expr("(shiftright(bits, cast(no as int)) & 1) = 1"))
    each = hit.groupBy("bits", "i").agg((F.max("m") * F.first("w")).alias("c")).groupBy("bits").agg(F.sum("c").alias("covered"))
    return each.orderBy(F.desc("covered"), "bits").limit(1)


def budget_curve(picks: DataFrame, cs: DataFrame, features: list[str], thetas: list[float]) -> DataFrame:
    """(theta, m, rep): coverage at each budget.  Greedy picks are nested, so one order's running gains serve all budgets."""
    n = cs.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n")).first()["n"]
    sizes = cs.sparkSession.createDataFrame([(float(t), budget(t, n)) for t in thetas], "theta double, m int")
    order = Window.orderBy(F.desc("gain"), "cell")  # no more rows than the greatest budget
    run = picks.select(F.row_number().over(order).alias("k"), F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    return F.broadcast(sizes).join(run, F.col("k") <= F.col("m"), "left").groupBy("theta", "m").agg((F.coalesce(F.max("c"), F.lit(0)) / F.lit(float(max(n, 1) * len(features)))).alias("rep"))


def decomposition(cs: DataFrame, parts: DataFrame, features: list[str], m: int) -> DataFrame:
    """(part, m, covered, best): greedy and exhaustive coverage of each part (cell, part), for a bound check; at most 100 parts of 18 cells."""
    sizes = parts.groupBy("part").count().orderBy("part").limit(101).collect()
    if not 0 < len(sizes) <= 100:
        raise ValueError("the check takes 1 to 100 parts")
    out = []
    for p, size in sizes:
        own = cs.join(parts.filter(F.col("part") == p).select("cell"), "cell")
        best = best_subset(own, features, min(m, size)).select(F.col("covered").alias("best"))
        out.append(greedy(own, features, m).agg(F.sum("gain").alias("covered")).crossJoin(best).select(F.lit(p).alias("part"), F.lit(m).alias("m"), "covered", "best"))
    return reduce(DataFrame.unionByName, out)
