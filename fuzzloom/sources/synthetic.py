"""Generated tables for tests and trials: every value is a hash of seed, row and name, so reruns agree at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("Low", "Medium", "High")


def draw(seed: int, name: str, key: str = "id") -> Column:
    """A number of 32 bits from md5, the same in other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(name))), 1, 8), 16, 10).cast("long")


def uniform(seed: int, name: str, key: str = "id") -> Column:
    return (draw(seed, name, key) + 0.5) / float(2**32)


def normal(seed: int, name: str, key: str = "id") -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, name + "/r", key))) * F.cos(F.lit(6.283185307179586) * uniform(seed, name + "/a", key))


def _label(high: Column, n: int, seed: int, classes: int) -> Column:
    """By the share of High levels; 15 of 100 labels are drawn."""
    hidden = F.least(F.lit(classes - 1), F.floor(high * classes / n)).cast("int")
    return F.when(draw(seed, "noise") % 100 < 15, (draw(seed, "label") % classes).cast("int")).otherwise(hidden)


def rules(spark: SparkSession, n: int | DataFrame, attributes: int = 6, classes: int = 2, seed: int = 42) -> DataFrame:
    """(id, f0.., y, confidence, support): a level for every attribute; for so many ids, or for those of a table (id)."""
    df = spark.range(n) if isinstance(n, int) else n.select("id")
    names = [f"f{i}" for i in range(attributes)]
    df = df.withColumns({c: F.element_at(F.array(*map(F.lit, LEVELS)), (draw(seed, c) % 3 + 1).cast("int")) for c in names})
    high = sum(((F.col(c) == "High").cast("int") for c in names), F.lit(0))
    return df.withColumns({"y": _label(high, attributes, seed, classes), "confidence": F.round(0.6 + 0.35 * uniform(seed, "confidence"), 3), "support": F.round(0.02 + 0.2 * uniform(seed, "support"), 3)})


def edges(tokens: DataFrame) -> DataFrame:
    """(u, v, mu): the share of u's rules that hold v, at most 1, from (cell, w, token)."""
    from fuzzloom.operators.graph import edge_weights

    alone = tokens.groupBy(F.col("token").alias("u")).agg(F.sum("w").alias("n_u"))
    return edge_weights(tokens).join(alone, "u").select("u", "v", F.round(F.least(F.col("n") / F.col("n_u"), F.lit(1.0)), 4).alias("mu"))


def samples(spark: SparkSession, n: int, attributes: int = 6, classes: int = 2, seed: int = 123) -> DataFrame:
    """(id, membership, y): degrees that sum to 1 in each attribute; the label follows the dominant levels."""
    df, parts, high = spark.range(n), [], F.lit(0)
    for i in range(attributes):
        raw = [draw(seed, f"f{i}/{v}").cast("double") for v in LEVELS]
        total = raw[0] + raw[1] + raw[2]
        high = high + ((raw[2] > raw[0]) & (raw[2] > raw[1])).cast("int")
        parts += [x for v, r in zip(LEVELS, raw) for x in (F.lit(f"f{i}-{v}"), F.round(r / total, 4))]
    return df.select("id", F.create_map(*parts).alias("membership"), _label(high, attributes, seed, classes).alias("y"))


def patients(spark: SparkSession, n: int, duplicates: float = 0.15, zeros: float = 0.05, seed: int = 7) -> DataFrame:
    """(id, count, level, pressure, index, years, outcome): normal, Poisson-like and uniform columns, a logistic label, zeros for missing values, and repeated rows."""
    copies = int(n * duplicates)
    # The last rows repeat earlier ones: their values are drawn by those rows' ids.
    df = spark.range(n).withColumnRenamed("id", "row").withColumn("id", F.when(F.col("row") < n - copies, F.col("row")).otherwise(F.col("row") % max(n - copies, 1)))
    v = df.withColumns({
        "count": F.floor(-F.ln(uniform(seed, "count")) * 3.5).cast("double"),
        "level": F.greatest(F.lit(44.0), 120 + 30 * normal(seed, "level")),
        "pressure": F.greatest(F.lit(24.0), 70 + 12 * normal(seed, "pressure")),
        "index": F.greatest(F.lit(15.0), 32 + 7 * normal(seed, "index")),
        "years": F.floor(21 + 45 * uniform(seed, "years")),
    })
    odds = (F.col("level") - 120) / 25 + (F.col("index") - 32) / 10 + (F.col("years") - 40) / 25 - 0.7
    v = v.withColumn("outcome", (uniform(seed, "outcome") < 1 / (1 + F.exp(-odds))).cast("int"))
    v = v.withColumns({c: F.when(uniform(seed, c + "/zero") < zeros, 0.0).otherwise(F.round(c, 1)) for c in ("level", "pressure", "index")})
    return v.select(F.col("row").alias("id"), "count", "level", "pressure", "index", F.col("years").cast("double").alias("years"), "outcome")
