"""Running sums and maxima in an order, and exact quantiles, without a task that holds a whole group.

Rows are dealt to ranges of (group, order), so a group of any size is spread over many tasks.  What a range
adds to a group is one row, and the running value over these rows is what the next range begins with.

For quantiles rows are counted by pieces of a column's values.  The counts tell which piece holds a rank, and only
the values of such pieces are put in order, so no task holds a column's distinct values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.sources.staging import staged


def before(df: DataFrame, by: list[str], order: list[Column], value: Column, how: Callable = F.sum, name: str = "before") -> DataFrame:
    """df with name: how (F.sum or F.max) of value over the group's rows of a lesser order, null where there is none.

    Rows of a group that are equal in order come in any order among themselves."""
    held = df.withColumn("_v", value)
    dealt = staged(held.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_piece", F.spark_partition_id()))
    own = Window.partitionBy("_piece", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_piece").agg(how("_v").alias("_t"))
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = totals.withColumn("_c", how("_t").over(earlier)).select(F.col("_piece").alias("_p"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], "_c")
    on = F.col("_piece") == F.col("_p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    both = dealt.withColumn("_o", how("_v").over(own)).join(carried, on, "left")
    joined = F.when(F.col("_o").isNull(), F.col("_c")).when(F.col("_c").isNull(), F.col("_o")).otherwise(F.col("_o") + F.col("_c") if how is F.sum else F.greatest("_o", "_c"))
    return both.withColumn(name, joined).select(*df.columns, name)


PIECES, FEW = 1000, 200_000  # pieces of a column; distinct values that one task counts


def bounds_of(df: DataFrame, columns: list[str], pieces: int = PIECES) -> dict[str, list[float]]:
    """The bounds between pieces of each column of doubles, from one pass over all rows.  Any bounds give right quantiles; these make pieces of like size."""
    at = ", ".join(f"{(i + 1) / pieces!r}D" for i in range(pieces - 1))
    row = df.agg(*[F.expr(f"approx_percentile(`{c}`, array({at}), {2 * pieces})").alias(c) for c in columns]).first()
    inf = float("inf")
    return {c: [-inf, *(sorted({v + 0.0 for v in row[c] or [] if -inf < v < inf}) or [0.0]), inf] for c in columns}


def dealt(df: DataFrame, bounds: dict[str, list[float]], prefix: str = "_p_", source: str = "") -> DataFrame:
    """df with the number of the piece of each column's value; what it is for a null means nothing."""
    names = list(bounds)
    return Bucketizer(splitsArray=[bounds[c] for c in names], inputCols=[source + c for c in names], outputCols=[prefix + c for c in names], handleInvalid="keep").transform(df)


def quantiles(counts: DataFrame, values: Callable[[DataFrame], DataFrame], by: list[str], at: list[float]) -> DataFrame:
    """(by, q): the quantiles of each group, an array, with linear interpolation as `percentile` has it.

    counts (by, _piece, _f) has the number of values in each piece; values tells (by, _piece, _v, _f) of the pieces that it gets
    as a table (by, _piece).  Groups are few and by is never null."""
    pieces = Window.partitionBy(*by)
    begun = counts.withColumn("_b", F.coalesce(F.sum("_f").over(pieces.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_f").over(pieces))  # a row a piece
    place = begun.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(at)]))).withColumn("_pos", (F.col("_all") - 1) * F.col("_at.p"))
    ranks = place.withColumn("_rank", F.explode(F.array(F.floor("_pos"), F.ceil("_pos")))).filter((F.col("_b") <= F.col("_rank")) & (F.col("_rank") < F.col("_b") + F.col("_f")))
    asked = staged(ranks.select(*by, "_piece", F.col("_at.i").alias("_i"), "_pos", "_rank", "_b"))
    run = Window.partitionBy(*by, "_piece").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    each = values(asked.select(*by, "_piece").distinct()).withColumn("_o", F.coalesce(F.sum("_f").over(run), F.lit(0)))
    first = F.col("_b") + F.col("_o")
    hit = each.join(F.broadcast(asked), [*by, "_piece"]).filter((first <= F.col("_rank")) & (F.col("_rank") < first + F.col("_f")))  # a row a rank
    ends = hit.groupBy(*by, "_i", "_pos").agg(F.max(F.when(F.col("_rank") == F.floor("_pos"), F.col("_v"))).alias("_lo"), F.max(F.when(F.col("_rank") == F.ceil("_pos"), F.col("_v"))).alias("_hi"))
    q = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((F.ceil("_pos") - F.col("_pos")) * F.col("_lo") + (F.col("_pos") - F.floor("_pos")) * F.col("_hi"))
    return ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", q.alias("q")))).alias("_q")).select(*by, F.transform("_q", lambda x: x["q"]).alias("q"))


def fitted(df: DataFrame, columns: list[str], at: list[float], few: int = FEW, pieces: int = PIECES, weight: str | None = None) -> dict[str, list[float] | None]:
    """The exact quantiles of each column of numbers, None for one without a value: by `percentile`, or by pieces where a column has many distinct values.  df is read up to four times.

    With a weight, a column of whole numbers, a row counts so many times."""
    told = ", ".join(f"{p!r}D" for p in at)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    most = max(rows.agg(*[F.approx_count_distinct(c) for c in columns]).first())
    if most <= few:
        return rows.agg(*[F.expr(f"percentile(`{c}`, array({told}){', _w' if weight else ''})").alias(c) for c in columns]).first().asDict()
    held = dealt(rows, bounds_of(rows, columns, pieces))
    long = held.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_n"), F.col(f"_p_{c}").alias("_piece"), F.col(c).alias("_v")) for c in columns])).alias("_x"), "_w").select("_x.*", "_w").filter("_v IS NOT NULL AND _w > 0")
    counts = staged(long.groupBy("_n", "_piece").agg(F.sum("_w").alias("_f")))
    values = lambda of: long.join(F.broadcast(of), ["_n", "_piece"]).groupBy("_n", "_piece", "_v").agg(F.sum("_w").alias("_f"))  # noqa: E731  few pieces
    got = {r["_n"]: r["q"] for r in quantiles(counts, values, ["_n"], at).collect()}  # a row a column
    return {c: got.get(c) for c in columns}
