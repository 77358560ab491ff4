"""The coverage bound checked against exact optima, for many small subsets of rules at once.

Subsets, and the parts into which a method cuts them, are instances: rows of one table.  An instance knows
for each of its rules and each number of matching attributes the set of rules of the subset that match so much, as
bits; what a choice (bits again) covers is the number of these sets that it meets.  So optima, greedy
choices and coverage are expressions over bits, all subsets take part in one plan, and the counters of
violations are one aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.operators.clusters import clustered
from fuzzloom.sources.staging import staged

LARGEST = 18  # rules of a subset, as all its subsets are tried
BOUND = 1 - 1 / math.e
SIZES, RATIOS, REPEATS = (10, 14, 18), (0.2, 0.4), 20


def subsets(rules: DataFrame, sizes: tuple[int, ...] = SIZES, ratios: tuple[float, ...] = RATIOS, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """(subset, n, m, ratio, repeat, pos, id, y, ...): for each size, ratio and repeat the first n rules by their own hash, m of which may be chosen.

    Each hash's first rules are found by a window whose ranks are cut on the map side; fewer rules make smaller subsets."""
    if max(sizes) > LARGEST:
        raise ValueError(f"all subsets are tried for {LARGEST} rules at most")
    plan = enumerate((n, r, k) for n in sizes for r in ratios for k in range(repeats))
    each = [F.struct(F.lit(i).alias("subset"), F.lit(n).alias("n"), F.lit(max(1, round(r * n))).alias("m"), F.lit(float(r)).alias("ratio"), F.lit(k).alias("repeat")) for i, (n, r, k) in plan]
    key = F.concat_ws(":", F.lit(str(seed)), F.col("subset").cast("string"), F.col("id").cast("string"))
    order = Window.partitionBy("subset").orderBy(F.md5(key.cast("binary")), "id")
    taken = rules.withColumn("_s", F.explode(F.array(*each))).select(*rules.columns, "_s.*").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= LARGEST).filter(F.col("_k") <= F.col("n"))
    own = Window.partitionBy("subset")
    return taken.withColumn("pos", (F.row_number().over(own.orderBy("id")) - 1).cast("int")).withColumn("n", F.count("*").over(own).cast("int")).withColumn("m", F.least("m", "n")).drop("_k")


def reach(held: DataFrame, features: list[str]) -> DataFrame:
    """(subset, pos, masks): for each rule and each number of matches the bits of the rules of its label that match so much; empty sets are left out."""
    same = sum((F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")).cast("int") for c in features), F.lit(0))
    pairs = held.alias("l").join(held.alias("r"), (F.col("l.subset") == F.col("r.subset")) & F.col("l.y").eqNullSafe(F.col("r.y"))).select(F.col("l.subset").alias("subset"), F.col("l.pos").alias("pos"), F.col("r.pos").alias("to"), same.alias("k"))
    bits = F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("to")))
    at_least = pairs.select("subset", "pos", "to", F.explode(F.sequence(F.lit(1), F.lit(len(features)))).alias("v"), "k").filter("k >= v")
    return at_least.groupBy("subset", "pos", "v").agg(bits.alias("mask")).groupBy("subset", "pos").agg(F.collect_list("mask").alias("masks"))  # as many as attributes


def _covered(masks: str | Column, chosen: Column) -> Column:
    return F.size(F.filter(masks, lambda x: x.bitwiseAND(chosen) != 0))


def instances(members: DataFrame, near: DataFrame) -> DataFrame:
    """(subset, part, places, masks, budget): a part's places in its subset and the sets of its rules, from members (subset, part, pos, budget)."""
    return members.join(near, ["subset", "pos"]).groupBy("subset", "part", "budget").agg(F.array_sort(F.collect_list("pos")).alias("places"), F.flatten(F.collect_list("masks")).alias("masks"))  # LARGEST rules


def solved(parts: DataFrame) -> DataFrame:
    """parts with best (the greatest coverage of budget places), greedy (the coverage of a greedy choice) and chosen (its bits).

    A part's subsets are enumerated as rows of its own, so all parts are solved in one plan; greedy stops where nothing is gained, and
    then takes places in order."""
    n = F.size("places")
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p)
    rows = parts.withColumn("local", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1)))
    rows = rows.filter(F.bit_count("local") == F.col("budget"))
    spread = F.aggregate("places", F.struct(F.lit(0).cast("long").alias("s"), F.col("local").alias("rest")), lambda a, p: F.struct((a["s"] + F.when(a["rest"].bitwiseAND(F.lit(1).cast("long")) != 0, bit(p)).otherwise(F.lit(0).cast("long"))).alias("s"), F.shiftright(a["rest"], 1).alias("rest")))["s"]
    best = rows.withColumn("_s", spread).groupBy("subset", "part").agg(F.max(_covered("masks", F.col("_s"))).cast("long").alias("best"))

    def grown(s: Column, _: Column) -> Column:
        each = F.transform(F.filter("places", lambda p: bit(p).bitwiseAND(s) == 0), lambda p: F.struct(_covered("masks", s.bitwiseOR(bit(p))).alias("c"), (-p).alias("p")))
        return F.when(F.size(each) == 0, s).otherwise(s.bitwiseOR(bit(-F.array_max(each)["p"])))

    steps = F.filter(F.sequence(F.lit(0), F.greatest("budget", F.lit(1))), lambda i: (i > 0) & (i <= F.col("budget")))
    chosen = F.aggregate(steps, F.lit(0).cast("long"), grown)
    greedy = parts.withColumn("chosen", chosen).withColumn("greedy", _covered("masks", F.col("chosen")).cast("long"))
    return greedy.join(best, ["subset", "part"])


def shares(sizes: DataFrame, over: list[str], part: str, size: str, total: str) -> DataFrame:
    """sizes with share: whole shares of total by size within the columns over, by largest remainders, ties to the lesser part."""
    w = Window.partitionBy(*over)
    quota = F.col(total) * F.col(size) / F.sum(size).over(w)
    x = sizes.withColumn("_q", quota).withColumn("_f", F.floor(F.round("_q", 9)))
    rest = F.col(total) - F.sum("_f").over(w)
    return x.withColumn("share", (F.col("_f") + (F.row_number().over(w.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), part)) <= rest).cast("int")).cast("int")).drop("_q", "_f")


def bound_check(rules: DataFrame, features: list[str], sizes: tuple[int, ...] = SIZES, ratios: tuple[float, ...] = RATIOS, repeats: int = REPEATS, clusters: int = 2, seed: int = 0) -> DataFrame:
    """One row a subset: its optimum (opt), the greedy choice, and for choices by labels (s) and by clusters within labels (c) the coverage of the union,
    the optimum of the parts, the worst ratio of a part, the gap between the union and its parts, the deviation of the label share and the size.

    Coverage is a mean share of matching attributes; labels are 0 and 1."""
    held = staged(subsets(rules, sizes, ratios, repeats, seed))
    near = staged(reach(held, features))
    formed = clustered(held.withColumn("w", F.lit(1).cast("long")).withColumn("cell", F.col("id").cast("long")), features, clusters, ["subset", "y"], seed)
    cluster_of = staged(formed.select("subset", "pos", "cluster"))
    base = held.join(cluster_of, ["subset", "pos"]).select("subset", "n", "m", "pos", "y", "cluster")
    whole = base.select("subset", F.lit("all").alias("kind"), F.lit("all").alias("part"), "pos", F.col("m").alias("budget"))
    labels = shares(base.groupBy("subset", "m", "y").agg(F.count("*").alias("k")), ["subset"], "y", "k", "m").select("subset", "y", F.col("share").alias("of_label"))
    strata = base.join(labels, ["subset", "y"]).select("subset", F.lit("s").alias("kind"), F.concat(F.lit("s:"), F.col("y").cast("string")).alias("part"), "pos", F.col("of_label").alias("budget"))
    inner = shares(base.groupBy("subset", "y", "cluster").agg(F.count("*").alias("k")).join(labels, ["subset", "y"]), ["subset", "y"], "cluster", "k", "of_label").select("subset", "y", "cluster", F.col("share").alias("budget"))
    by_cluster = base.join(inner, ["subset", "y", "cluster"]).select("subset", F.lit("c").alias("kind"), F.concat_ws(":", F.lit("c"), F.col("y").cast("string"), F.col("cluster").cast("string")).alias("part"), "pos", "budget")
    every = whole.unionByName(strata).unionByName(by_cluster)
    kinds = every.select("subset", "kind", "part").distinct()
    done = staged(solved(instances(every.drop("kind"), near)).join(kinds, ["subset", "part"]))
    scale = F.lit(float(len(features)))
    union = done.groupBy("subset", "kind").agg(F.sum("chosen").alias("chosen"), F.sum("best").alias("best"), F.sum("greedy").alias("parts"), F.min(F.when(F.col("best") > 0, F.col("greedy") / F.col("best"))).alias("worst"))
    sets = near.groupBy("subset").agg(F.flatten(F.collect_list("masks")).alias("masks"))
    positive = base.groupBy("subset", "n", "m").agg(F.sum(F.when(F.col("y") == 1, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos"))).otherwise(F.lit(0).cast("long"))).alias("ones"))
    at = union.join(sets, "subset").join(positive, "subset").withColumn("covered", _covered("masks", F.col("chosen")))
    rep = F.col("covered") / (F.col("n") * scale)
    taken = F.bit_count("chosen")
    off = F.abs(F.bit_count(F.col("chosen").bitwiseAND(F.col("ones"))) / F.greatest(taken, F.lit(1)) - F.bit_count("ones") / F.col("n"))
    row = F.struct(rep.alias("rep"), (F.col("best") / (F.col("n") * scale)).alias("opt"), F.coalesce("worst", F.lit(1.0)).alias("worst"), ((F.col("covered") - F.col("parts")) / (F.col("n") * scale)).alias("gap"), off.alias("off"), taken.cast("int").alias("size"))
    wide = at.select("subset", "n", "m", "kind", row.alias("r")).groupBy("subset", "n", "m").pivot("kind", ["all", "s", "c"]).agg(F.first("r"))
    out = [F.col("all.opt").alias("opt"), F.col("all.rep").alias("greedy_rep")]
    for k in ("s", "c"):
        out += [F.col(f"{k}.{f}").alias(f"{k}_{f}") for f in ("rep", "opt", "worst", "gap", "off", "size")]
    return wide.select("subset", "n", "m", *out)


def violations(checked: DataFrame, bound: float = BOUND) -> DataFrame:
    """One row of ten counters over the rows of bound_check; 0 everywhere means that all holds."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    low = lambda x: x < bound - 1e-9
    count = {
        "greedy": low(ratio("greedy_rep", "opt")),
        "s": low(ratio("s_rep", "s_opt")) | low(F.col("s_worst")),
        "c": low(ratio("c_rep", "c_opt")) | low(F.col("c_worst")),
        "s_decomposition": F.abs("s_gap") > 1e-9,
        "c_negative_gap": F.col("c_gap") < -1e-9,
        "chain": (F.col("c_opt") > F.col("s_opt") + 1e-12) | (F.col("s_opt") > F.col("opt") + 1e-12),
        "off_s": F.col("s_off") >= 1 / F.col("m"),
        "off_c": F.col("c_off") >= 1 / F.col("m"),
        "greedy_above_opt": F.col("greedy_rep") > F.col("opt") + 1e-12,
        "size": (F.col("s_size") != F.col("m")) | (F.col("c_size") != F.col("m")),
    }
    return checked.agg(*[F.count_if(v).alias(k) for k, v in count.items()], F.count("*").alias("subsets"))
