"""Factorial analyses: every fold under every setting of the switches, as columns of one plan.

A setting (cfg: a fold and a way to impute) is a prefix of the levels, so rows of different settings never
agree on anything and all operators on cells run over all settings at once.  Scopes, scores and
methods are further columns; an effect is a difference of means."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.operators import infer, matrices, sampling
from fuzzloom.operators.bounds import shares
from fuzzloom.operators.clusters import clustered
from fuzzloom.operators.ordered import before, bounds_of, dealt, quantiles
from fuzzloom.operators.prep import LEVELS
from fuzzloom.sources.staging import staged

IMPUTE, SCOPES, SCORES, METHODS = ("global", "class"), ("global", "adjacent", "upper"), ("softmax", "margin"), ("full", "greedy", "stratified", "clustered")


def _fit(folded: DataFrame, numeric: dict[str, str], ways: tuple[str, ...], zero_missing: tuple[str, ...], at: tuple[float, float]):
    """The rows with their values (id, y, of, numeric), what deals such rows to the settings, and each setting's medians and cuts from train alone, a row for each label.

    Values are counted by pieces, and only pieces that hold a median or a cut are put in order; rows never meet the settings here."""
    if unknown := set(ways) - set(IMPUTE):
        raise ValueError(f"unknown ways to impute {unknown}")
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.nullif(F.col(c).cast("double"), F.lit(0.0)) if c in zero_missing else F.col(c).cast("double")) for c in numeric}
    base = staged(folded.select("id", "y", F.col("fold").alias("of"), *[v.alias(c) for c, v in value.items()]))
    folds = sorted(r[0] for r in base.select("of").distinct().collect())  # folds are few
    each = F.array(*[F.struct(F.concat(F.lit(f"{f}/{w}")).alias("cfg"), F.lit(f).alias("fold"), F.lit(w).alias("impute")) for f in folds for w in ways])
    group = F.when(F.col("impute") == "class", F.col("y")).otherwise(F.lit(-1))
    under = lambda df: df.withColumn("_c", F.explode(each)).select("*", "_c.*").drop("_c").withColumn("part", F.when(F.col("of") == F.col("fold"), "test").otherwise("train")).withColumn("_g", group).drop("of")
    bounds = bounds_of(base, list(numeric))
    piece = lambda c: F.when(F.col(c).isNotNull(), F.col(f"_p_{c}"))
    long = dealt(base, bounds).select("of", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("_n"), piece(c).alias("_piece"), F.col(c).alias("_v")) for c in numeric])).alias("_x")).select("of", "y", "_x.*")
    counted = staged(long.groupBy("of", "y", "_n", "_piece").agg(F.count("*").alias("_f")))  # a row for each piece of a fold and label
    own = lambda df: under(df).filter("part = 'train' AND _g IS NOT NULL")
    valued = lambda of: own(long.join(F.broadcast(of.select("_n", "_piece").distinct()), ["_n", "_piece"]).groupBy("of", "y", "_n", "_piece", "_v").agg(F.count("*").alias("_f")))  # noqa: E731  few pieces
    summed = lambda df, *by: df.groupBy(*by).agg(F.sum("_f").alias("_f"))
    have = own(counted)
    by = ["cfg", "_g", "_n", "_piece"]
    medians = quantiles(summed(have.filter("_piece IS NOT NULL"), *by), lambda of: summed(valued(of), *by, "_v"), by[:3], [0.5])
    wide = lambda v, name: [F.max(F.when(F.col("_n") == c, F.col(v))).alias(f"{name}{c}") for c in numeric]
    groups = have.select("cfg", "_g", "_n").distinct()
    least = staged(groups.join(medians.select(*by[:3], F.col("q")[0].alias("_m")), by[:3], "left").groupBy("cfg", "_g").agg(*wide("_m", "_m_")))
    # What is missing counts as the median of its group.
    placed = dealt(least, bounds, source="_m_").select("cfg", "_g", F.explode(F.array(*[F.struct(F.lit(c).alias("_n"), F.col(f"_p_{c}").alias("_piece"), F.col(f"_m_{c}").alias("_v")) for c in numeric])).alias("_x")).select("cfg", "_g", "_x.*").filter("_v IS NOT NULL")
    filled = staged(summed(have.filter("_piece IS NULL"), *by[:3]).join(placed, by[:3]).select("cfg", "_n", "_piece", "_v", "_f"))
    by = ["cfg", "_n", "_piece"]
    both = have.filter("_piece IS NOT NULL").select(*by, "_f").unionByName(filled.select(*by, "_f"))
    met = lambda of: summed(valued(of).select(*by, "_v", "_f").unionByName(filled), *by, "_v")
    cuts = quantiles(summed(both, *by), met, by[:2], list(at)).groupBy("cfg").agg(*wide("q", "_q_"))
    fits = staged(least.join(cuts, "cfg", "left").withColumnsRenamed({"cfg": "_cfg", "_g": "_y"}))
    return base, under, fits


def settings(folded: DataFrame, numeric: dict[str, str], ways: tuple[str, ...] = IMPUTE, zero_missing: tuple[str, ...] = (), at: tuple[float, float] = (1 / 3, 2 / 3)) -> DataFrame:
    """(cfg, fold, impute, part, id, y, levels): folded rows (id, y, fold, numeric) for each fold and way to impute, as train or test, medians and cuts from train alone.

    A missing value becomes the median of all, or of the row's own class; the latter reads labels of test rows, too."""
    base, under, fits = _fit(folded, numeric, ways, zero_missing, at)
    whole = under(base).join(F.broadcast(fits), (F.col("cfg") == F.col("_cfg")) & (F.col("_g") == F.col("_y")))
    value = {c: F.coalesce(c, f"_m_{c}") for c in numeric}
    level = lambda c: F.when(value[c] <= F.col(f"_q_{c}")[0], LEVELS[0]).when(value[c] <= F.col(f"_q_{c}")[1], LEVELS[1]).otherwise(LEVELS[2])
    return whole.select("cfg", "fold", "impute", "part", "id", "y", *[F.concat_ws("|", "cfg", level(c)).alias(n) for c, n in numeric.items()])


def counted_settings(folded: DataFrame, numeric: dict[str, str], ways: tuple[str, ...] = IMPUTE, zero_missing: tuple[str, ...] = (), at: tuple[float, float] = (1 / 3, 2 / 3), by_id: bool = False):
    """The rows of settings by levels, with their number n and least id, without a row for each row and setting; and what tells the rows of some pieces.

    Between the cuts of all settings a value has the same level in each, so rows are counted by label, fold and
    the intervals of their values, and only these counts meet the settings.  With by_id they are counted by pieces of id (_p_id), too."""
    base, under, fits = _fit(folded, numeric, ways, zero_missing, at)
    held = fits.select(*[f"_q_{c}" for c in numeric]).collect()  # a row for each setting and label
    ts = {c: sorted({t for r in held for t in r[f"_q_{c}"] or []}) for c in numeric}
    below = lambda value, c: sum((F.when(value > t, 1).otherwise(0) for t in ts[c]), F.lit(0))
    kind = [F.when(F.col(c).isNotNull(), below(F.col(c), c)).alias(f"_k_{c}") for c in numeric]
    told = lambda c, i: F.when(F.col(f"_q_{c}")[i].isNotNull(), below(F.col(f"_q_{c}")[i], c)).alias(f"_j{i}_{c}")
    named = lambda c: F.when(F.col(f"_m_{c}") <= F.col(f"_q_{c}")[0], LEVELS[0]).when(F.col(f"_m_{c}") <= F.col(f"_q_{c}")[1], LEVELS[1]).otherwise(LEVELS[2])
    small = staged(fits.select("_cfg", "_y", *[x for c in numeric for x in (told(c, 0), told(c, 1), named(c).alias(f"_l_{c}"))]))
    level = lambda c: F.when(F.col(f"_k_{c}").isNull(), F.col(f"_l_{c}")).when(F.col(f"_k_{c}") <= F.col(f"_j0_{c}"), LEVELS[0]).when(F.col(f"_k_{c}") <= F.col(f"_j1_{c}"), LEVELS[1]).otherwise(LEVELS[2])
    piece = ["_p_id"] if by_id else []

    def dealt_out(kinds: DataFrame) -> DataFrame:
        met = under(kinds).join(F.broadcast(small), (F.col("cfg") == F.col("_cfg")) & (F.col("_g") == F.col("_y")))
        return met.select("cfg", "fold", "impute", "part", "y", *[F.concat_ws("|", "cfg", level(c)).alias(n) for c, n in numeric.items()], *piece, "id", "n")

    rows = base.withColumn("_id", F.col("id").cast("double"))
    rows = dealt(rows, bounds_of(rows, ["_id"])).withColumnRenamed("_p__id", "_p_id") if by_id else rows
    by = ["of", "y", *[f"_k_{c}" for c in numeric], *piece]
    each = rows.select("of", "y", *kind, *piece, "id")
    kinds = staged(each.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("id")))
    keys = ["cfg", "fold", "impute", "part", "y", *numeric.values(), *piece]
    counts = staged(dealt_out(kinds).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("id").alias("id")))
    return counts, lambda of: dealt_out(each.join(F.broadcast(of), "_p_id").withColumn("n", F.lit(1).cast("long")))


def _picks(cells: DataFrame, features: list[str], theta: float, method: str, clusters: int, seed: int):
    """The cells with cluster, the columns that have a budget (quota) each, these budgets, and the cells that gain (cfg, cell, gain)."""
    cells = staged(clustered(cells, features, clusters, ["cfg", "y"], seed)) if method == "clustered" else cells.withColumn("cluster", F.lit(0))
    groups = ["cfg", "y", "cluster"]
    sizes = cells.groupBy(*groups).agg(F.sum("w").alias("n"))
    budget = sizes.groupBy("cfg").agg(F.sum("n").alias("all")).select("cfg", F.ceil(theta * F.col("all") - 1e-12).cast("int").alias("m"))
    labels = shares(sizes.groupBy("cfg", "y").agg(F.sum("n").alias("n")).join(budget, "cfg"), ["cfg"], "y", "n", "m").select("cfg", "y", F.col("share").alias("of_label"))
    if method == "greedy":
        part, quota = ["cfg"], budget.select("cfg", F.col("m").alias("quota"))
    else:
        part, quota = groups, shares(sizes.join(labels, ["cfg", "y"]), ["cfg", "y"], "cluster", "n", "of_label").select(*groups, F.col("share").alias("quota"))
    quota = staged(quota)

    def picked(pdf: pd.DataFrame) -> pd.DataFrame:
        return sampling._greedy(features, int(pdf["quota"].iloc[0]), None)(pdf).assign(cfg=pdf["cfg"].iloc[0])[["cfg", "cell", "gain"]]

    return cells, part, quota, cells.join(quota, part).groupBy(*groups).applyInPandas(picked, "cfg string, cell long, gain long")


def chosen(train: DataFrame, features: list[str], theta: float, method: str, clusters: int = 5, seed: int = 0) -> DataFrame:
    """The rows of train (cfg, id, y, levels) that a method takes of each setting: a budget in all (greedy), dealt to labels, or to clusters within labels."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method == "full":
        return train
    cells = staged(train.groupBy("cfg", *features, "y").agg(F.count("*").alias("w"), F.min("id").alias("cell")))
    cells, part, quota, picks = _picks(cells, features, theta, method, clusters, seed)
    of = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("cfg", *features, "y")]
    rows = train.join(cells.select(*[F.col(c).alias(f"_{c}") for c in ("cfg", *features, "y")], "cluster"), reduce(lambda a, b: a & b, of)).select(*train.columns, "cluster")
    order = rows.join(picks.select(F.col("cfg").alias("_cfg"), F.col("cell").alias("_id"), "gain"), (F.col("cfg") == F.col("_cfg")) & (F.col("id") == F.col("_id")), "left").drop("_cfg", "_id")
    ranked = before(order.withColumn("gain", F.coalesce("gain", F.lit(0))), part, [F.desc("gain"), F.asc("id")], F.lit(1).cast("long"), name="_k")
    return ranked.join(quota, part).filter(F.coalesce("_k", F.lit(0)) < F.col("quota")).select(*train.columns)


def chosen_cells(train: DataFrame, rows: Callable[[DataFrame], DataFrame], features: list[str], theta: float, method: str, clusters: int = 5, seed: int = 0) -> DataFrame:
    """(cfg, levels, y, cell, w): the cells of the rows that chosen takes, from counts (cfg, levels, y, _p_id, n, id) of train by pieces of id.

    After the cells that gain come the rows of least ids.  Counts tell the piece in which a budget ends; only rows of such
    pieces (rows tells them) are put in order."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    cells = staged(train.groupBy("cfg", *features, "y").agg(F.sum("n").alias("w"), F.min("id").alias("cell"), F.min_by("_p_id", "id").alias("_first")))
    if method == "full":
        return cells.drop("_first")
    cells, part, quota, picks = _picks(cells, features, theta, method, clusters, seed)
    cells = staged(cells)
    best = cells.join(picks, ["cfg", "cell"]).join(quota, part).withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("gain"), "cell")))  # a row a cell
    won = staged(best.filter("_r <= quota").drop("_r", "gain", "w"))
    names = {c: f"_{c}" for c in ("cfg", *features, "y")}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    known = cells.select(*[F.col(c).alias(n) for c, n in names.items()], "cell", "cluster")
    within = lambda df: df.join(F.broadcast(known), same).drop(*names.values())  # noqa: E731  levels of all settings
    taken = won.select("cfg", "cell", F.col("_first").alias("_p_id"), F.lit(1).alias("_w"))
    rest = staged(within(train.select("cfg", *features, "y", "_p_id", "n")).join(taken, ["cfg", "cell", "_p_id"], "left").withColumn("n", F.col("n") - F.coalesce("_w", F.lit(0))).drop("_w"))
    need = quota.join(won.groupBy(*part).agg(F.count("*").alias("_won")), part, "left").select(*part, (F.col("quota") - F.coalesce("_won", F.lit(0))).alias("_need"))
    run = Window.partitionBy(*part).orderBy("_p_id").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    begun = rest.groupBy(*part, "_p_id").agg(F.sum("n").alias("n")).withColumn("_b", F.coalesce(F.sum("n").over(run), F.lit(0)))
    ends = staged(begun.join(need, part).filter("_b < _need AND _need <= _b + n").select(*part, F.col("_p_id").alias("_end"), (F.col("_need") - F.col("_b")).alias("_left")))
    lower = rest.join(F.broadcast(ends), part).filter("_p_id < _end").select("cfg", "cell", "n")
    last = within(rows(ends.select(F.col("_end").alias("_p_id")).distinct()).filter("part = 'train'").select("cfg", *features, "y", "_p_id", "id", "n"))
    last = last.join(F.broadcast(ends), part).filter("_p_id = _end").join(won.select("cfg", F.col("cell").alias("id")), ["cfg", "id"], "left_anti")
    first = last.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("id"))).filter("_r <= _left").select("cfg", "cell", "n")  # a piece of a group
    got = won.select("cfg", "cell", F.lit(1).cast("long").alias("n")).unionByName(lower).unionByName(first).groupBy("cfg", "cell").agg(F.sum("n").alias("w")).filter("w > 0")
    return cells.drop("w", "cluster", "_first").join(got, ["cfg", "cell"])


def auc_by(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc): Mann-Whitney with average ranks in each group, of (y, score), and n of them if there is such a column; null for one class."""
    n = lambda y: F.sum(F.when(F.col("y") == y, F.col("n") if "n" in df.columns else 1).otherwise(0))
    c = df.groupBy(*by, F.col("score").alias("s")).agg(n(1).alias("pos"), n(0).alias("neg"))
    below = before(c, by, [F.asc("s")], F.col("neg"))
    u = F.sum(F.col("pos") * (F.coalesce("before", F.lit(0)) + F.col("neg") / 2.0))
    return below.groupBy(*by).agg(F.try_divide(u.cast("double"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def factorial(folded: DataFrame, numeric: dict[str, str], theta: float = 0.3, ways: tuple[str, ...] = IMPUTE, scopes: tuple[str, ...] = SCOPES, methods: tuple[str, ...] = ("full", "greedy"), clusters: int = 5, **how) -> DataFrame:
    """(fold, impute, scope, method, score, auc, bacc, n_unique): scores of test rows by pair weights of the chosen train rows, under all settings.

    Test rows of a setting that are equal in label and levels have equal scores; they go on as one with their number n."""
    features = list(numeric.values())
    counts, rows = counted_settings(folded, numeric, ways, by_id=True, **how)
    asked = counts.filter("part = 'test'").groupBy("cfg", "fold", "impute", *features, "y").agg(F.min("id").cast("string").alias("id"), F.sum("n").alias("n"))
    asked = staged(asked.withColumn("id", F.concat_ws("|", "cfg", "id")))
    out = None
    for method in methods:
        held = chosen_cells(counts.filter("part = 'train'"), rows, features, theta, method, clusters)
        cells = staged(held.withColumn("cell", F.xxhash64("cfg", "cell")).drop("cfg"))
        for scope in scopes:
            s = infer.probabilities(infer.decided(infer.pair_scores(asked, matrices.pair_table(cells, features, scope), features)))
            one = s.select("id", "y", "pred", F.lit(method).alias("method"), F.lit(scope).alias("scope"), F.col("p1").alias("softmax"), F.col("score").alias("margin"))
            out = one if out is None else out.unionByName(one)
    scored = staged(out.join(asked.select("id", "fold", "impute", "n"), "id"))
    by = ["fold", "impute", "scope", "method", "score_name"]
    long = scored.select("fold", "impute", "scope", "method", "y", "pred", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("score_name"), F.round(k, 12).alias("score")) for k in SCORES])).alias("s")).select("fold", "impute", "scope", "method", "y", "pred", "n", "s.*")
    count = lambda told: F.sum(F.when(told, F.col("n")).otherwise(0))
    share = lambda y: F.try_divide(count((F.col("y") == y) & (F.col("pred") == y)), count(F.col("y") == y))
    rest = long.groupBy(*by).agg(((share(0) + share(1)) / 2).alias("bacc"), F.count_distinct("score").alias("n_unique"))
    return auc_by(long, by).join(rest, by).withColumnRenamed("score_name", "score").select("fold", "impute", "scope", "method", "score", "auc", "bacc", "n_unique")


def effects(rows: DataFrame, factors: list[str], value: str = "auc") -> DataFrame:
    """(factor, level, mean, effect, n): each level's mean over all other switches, and how far it is from the mean of the factor's other levels."""
    each = rows.select(value, F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])).alias("x")).select(value, "x.*")
    means = each.filter(F.col(value).isNotNull()).groupBy("factor", "level").agg(F.avg(value).alias("mean"), F.sum(value).alias("_s"), F.count("*").alias("n"))
    whole = means.groupBy(F.col("factor").alias("_f")).agg(F.sum("_s").alias("_all"), F.sum("n").alias("_n"))
    rest = F.try_divide(F.col("_all") - F.col("_s"), F.col("_n") - F.col("n"))
    return means.join(whole, F.col("factor") == F.col("_f")).select("factor", "level", "mean", (F.col("mean") - rest).alias("effect"), "n")


def ablation(folded: DataFrame, numeric: dict[str, str], theta: float = 0.3, **how) -> DataFrame:
    """(method, impute, scope, score, auc, n_unique): means over folds of the older and newer forms, from one plan."""
    rows = factorial(folded, numeric, theta, scopes=("upper", "global"), **how)
    return rows.groupBy("method", "impute", "scope", "score").agg(F.avg("auc").alias("auc"), F.avg("n_unique").alias("n_unique"))


def scope_sensitivity(folded: DataFrame, numeric: dict[str, str], theta: float = 0.3, **how) -> DataFrame:
    """(scope, method, auc, auc_sd, bacc, bacc_sd): pair scopes for all rules and three samples of them, over folds."""
    rows = factorial(folded, numeric, theta, ("global",), SCOPES, METHODS, **how).filter("score = 'margin'")
    return rows.groupBy("scope", "method").agg(F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("auc_sd"), F.avg("bacc").alias("bacc"), F.stddev_samp("bacc").alias("bacc_sd"))
