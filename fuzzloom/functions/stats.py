"""Statistics of small result tables: exact tests by whole-number arithmetic, tails by series."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzloom.operators.ordered import before
from fuzzloom.sources.staging import staged


def average_ranks(df: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """rank_avg within by; ties share their mean rank.

    Equal values are counted on the map side, and only the distinct ones are put in order, over ranges."""
    keys = [*by, value]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = before(counts, by, [F.desc(value) if descending else F.asc(value)], F.col("_n"))
    rank = (F.coalesce("before", F.lit(0)) + 1 + (F.col("_n") - 1) / F.lit(2.0)).alias("rank_avg")
    named = ranked.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], rank)
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    return df.join(named, on).select(*df.columns, "rank_avg")


def wilcoxon_greater(differences: list[float]) -> float:
    """One-sided signed-rank p-value: exact to 50 differences, else normal with tie correction."""
    d = [x for x in differences if math.isfinite(x)]
    d = [x for x in d if x != 0]
    if not d:
        return 1.0
    order = sorted(d, key=abs)
    sizes, doubled, at = Counter(map(abs, d)), {}, 0
    for a in sorted(sizes):
        doubled[a] = 2 * at + sizes[a] + 1  # twice the mean rank
        at += sizes[a]
    plus = sum(doubled[abs(x)] for x in order if x > 0)
    if len(sizes) <= 50:
        ways = Counter({0: 1})
        for x in order:
            ways = ways + Counter({s + doubled[abs(x)]: n for s, n in ways.items()})
        return sum(n for s, n in ways.items() if s >= plus) / 2 ** len(d)
    n = len(d)
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in sizes.values()) / 48
    return 0.5 * math.erfc((plus / 2 - n * (n + 1) / 4) / math.sqrt(2 * var))


def holm(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """With p_adj (null for null or NaN p, which are not counted) and reject.

    Equal p-values get one adjusted value, so only the distinct ones are put in order, over ranges."""
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    counts = staged(df.filter(ok).groupBy(F.col(p).alias("_p0")).agg(F.count("*").alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).first()["t"]
    less = before(counts, [], [F.asc("_p0")], F.col("_n"))
    steps = less.select("_p0", F.least(F.col("_p0") * (F.lit(total) - F.coalesce("before", F.lit(0))), F.lit(1.0)).alias("_s"))
    top = before(steps, [], [F.asc("_p0")], F.col("_s"), F.max).select("_p0", F.greatest("_s", "before").alias("p_adj"))
    return df.join(top, F.when(ok, F.col(p)) == F.col("_p0"), "left").drop("_p0").withColumn("reject", F.coalesce(F.col("p_adj") <= alpha, F.lit(False)))


def cohen_dz(df: DataFrame, d: str = "d") -> DataFrame:
    sd, mean = F.stddev_samp(d), F.avg(d)
    return df.agg(F.when(F.count(d) < 2, F.lit(None)).when(sd < 1e-12, F.when(F.abs(mean) < 1e-12, 0.0).otherwise(F.signum(mean) * F.lit(float("inf")))).otherwise(mean / sd).alias("dz"))


def gamma_tail(a: float, x: float) -> float:
    """The regularized upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def friedman(df: DataFrame, block: str = "block", method: str = "method", value: str = "v") -> tuple[float, float]:
    """Statistic with tie correction and its chi-square tail; (0, 1) if all are equal."""
    ranks = average_ranks(df, [block], value)
    k, n = (df.select(method).distinct().count(), df.select(block).distinct().count())
    if k < 3 or n < 2:
        raise ValueError("it takes three methods and two blocks")
    sums = [r[1] for r in ranks.groupBy(method).agg(F.sum("rank_avg")).collect()]
    ties = ranks.groupBy(block, value).count().agg(F.sum(F.col("count") * F.col("count") * F.col("count") - F.col("count"))).first()[0]
    scale = 1 - ties / (n * k * (k * k - 1))
    if scale <= 0:
        return 0.0, 1.0
    q = (12 / (n * k * (k + 1)) * sum(s * s for s in sums) - 3 * n * (k + 1)) / scale
    return q, gamma_tail((k - 1) / 2, q / 2)


def studentized_range_quantile(k: int, alpha: float = 0.05) -> float:
    """For many degrees of freedom, by integration of the range's distribution."""
    pdf, cdf = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi), lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    grid = [i * 0.02 - 8 for i in range(801)]
    below = lambda q: k * sum(pdf(z) * (cdf(z) - cdf(z - q)) ** (k - 1) for z in grid) * 0.02
    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < 1 - alpha else (low, mid)
    return low


def critical_difference(blocks: int, methods: int, alpha: float = 0.05) -> float:
    return studentized_range_quantile(methods, alpha) / math.sqrt(2) * math.sqrt(methods * (methods + 1) / (6 * blocks))


def t_quantile(p: float, df: int) -> float:
    """By integration and bisection."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def upto(t, n=2000):
        h = t / n
        f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
        return 0.5 + h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i * h) for i in range(n + 1))

    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if upto(mid) < p else (low, mid)
    return low


def bootstrap_ci(df: DataFrame, value: str = "v", level: float = 0.95, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """One row (low, high): percentiles of the means of so many resamples of all values that are not null.

    A round's draws are dealt to the partitions by a multinomial of their sizes, which every task
    draws alike, and by each task among its own values; so a round is a sum of one number a partition."""
    import numpy as np
    import pyarrow as pa

    held = staged(df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.spark_partition_id().alias("p")))
    sizes = {r["p"]: r["n"] for r in held.groupBy("p").agg(F.count("*").alias("n")).collect()}  # one row a partition
    parts, n = sorted(sizes), sum(sizes.values())
    share = [sizes[p] / n for p in parts]

    def sums(key, table):
        at, own = parts.index(key[0].as_py()), table.column("v").to_numpy()
        deal, draw = np.random.default_rng(seed), np.random.default_rng([seed, at + 1])
        out = [own[draw.integers(0, len(own), deal.multinomial(n, share)[at])].sum() for _ in range(rounds)]
        return pa.table({"round": np.arange(rounds), "s": out})

    means = held.groupBy("p").applyInArrow(sums, "round long, s double").groupBy("round").agg((F.sum("s") / n if n else F.lit(None)).alias("m"))
    return means.agg(*[F.expr(f"percentile(m, {p!r}D)").alias(k) for k, p in (("low", (1 - level) / 2), ("high", (1 + level) / 2))])


def pareto_front(df: DataFrame, cost: str = "cost", benefit: str = "benefit") -> DataFrame:
    """Rows that no other dominates: the greatest benefit of each cost, against the running greatest of lesser costs."""
    best = df.groupBy(cost).agg(F.max(benefit).alias("_b"))
    less = before(best, [], [F.asc(cost)], F.col("_b"), F.max, "_m")
    front = less.filter(F.col("_m").isNull() | (F.col("_b") > F.col("_m"))).select(cost, F.col("_b").alias(benefit))
    return df.join(front, [cost, benefit], "left_semi").orderBy(cost, benefit)


def knee(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """The row farthest from the chord between the ends, after scaling to the unit square; of two rows or fewer the highest."""
    ends = df.agg(F.count("*").alias("_n"), *[f(c).alias(f"_{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))], F.min_by(y, x).alias("_y0"), F.max_by(y, x).alias("_y1"))
    scale = lambda v, c: F.coalesce(F.try_divide(v - F.col(f"_lo{c}"), F.col(f"_hi{c}") - F.col(f"_lo{c}")), F.lit(0.0))
    s = df.crossJoin(F.broadcast(ends))  # one row
    first, last, at, up = scale(F.col("_y0"), y), scale(F.col("_y1"), y), scale(F.col(x), x), scale(F.col(y), y)
    far = F.when(F.col("_n") <= 2, up).otherwise(F.abs((last - first) * at - up + first) / F.hypot(F.lit(1.0), last - first))
    return s.withColumn("_d", F.round(far, 12)).orderBy(F.desc("_d"), x).limit(1).select(*df.columns)


def power_fit(df: DataFrame, x: str = "n", y: str = "s") -> DataFrame:
    """One row (slope, intercept) of a line through the logarithms."""
    return df.agg(F.regr_slope(F.ln(y), F.ln(x)).alias("slope"), F.regr_intercept(F.ln(y), F.ln(x)).alias("intercept"))


def extrapolated(df: DataFrame, at: list[float], x: str = "n", y: str = "s") -> DataFrame:
    """(n, s): the fitted power law at other sizes; null where there is no fit."""
    fit = power_fit(df.filter((F.col(x) > 0) & (F.col(y) > 0)), x, y)
    return fit.select(F.explode(F.array(*[F.lit(float(a)) for a in at])).alias("n"), "slope", "intercept").select("n", F.exp(F.col("intercept") + F.col("slope") * F.ln("n")).alias("s"))


def knee_on_front(df: DataFrame, cost: str = "cost", benefit: str = "benefit") -> DataFrame:
    return knee(pareto_front(df, cost, benefit), cost, benefit)


def format_p(p):
    """A p-value as text: below 0.001 in scientific form."""
    return F.when(F.col(p).isNull() | F.isnan(p), "n/a").when(F.col(p) < 0.001, F.format_string("%.2e", F.col(p).cast("double"))).otherwise(F.format_string("%.4f", F.col(p).cast("double")))


def ranking_gaps(df: DataFrame, block: str = "block", method: str = "method", value: str = "v", alpha: float = 0.05) -> DataFrame:
    """(a, b, gap, differs): pairs of methods by the gap of their mean ranks; the greatest value has rank 1."""
    ranks = average_ranks(df, [block], value, descending=True)
    per = ranks.groupBy(method).agg(F.avg("rank_avg").alias("r"), F.count("*").alias("n"))
    size = per.agg(F.count("*").alias("k"), F.max("n").alias("n")).first()
    cd = critical_difference(size["n"], size["k"], alpha) if size["k"] > 1 else float("inf")
    a, b = per.select(F.col(method).alias("a"), F.col("r").alias("ra")), per.select(F.col(method).alias("b"), F.col("r").alias("rb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.abs(F.col("ra") - F.col("rb")).alias("gap"), (F.abs(F.col("ra") - F.col("rb")) > cd).alias("differs"))


def fold_interval(df: DataFrame, by: list[str], value: str = "v", folds: int = 5) -> DataFrame:
    """Mean, sd and half width of the t interval at 0.95; null unless there are exactly so many folds."""
    d = df.filter(~F.isnan(value)).groupBy(*by).agg(F.count("*").alias("folds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.when(F.col("folds") == folds, F.lit(t_quantile(0.975, folds - 1)) * F.col("sd") / F.sqrt(F.lit(float(folds))))
    return d.withColumn("half", half)
