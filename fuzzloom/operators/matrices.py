"""Agreement matrices over cells.

A cell is a distinct tuple of levels and label with the number of its rules (w) and its
least id.  All matrices depend on a rule only through its cell.  Counts are whole numbers;
callers divide by the number of rules once."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEP = "\u0001"
EXACT = "decimal(38,0)"  # products of three counts leave 64 bits from some millions of rules on


def cells(rules: DataFrame, features: list[str]) -> DataFrame:
    """Distinct levels and label; a rule has an attribute at least."""
    if not features:
        raise ValueError("a rule needs an attribute at least")
    return rules.groupBy(*features, "y").agg(F.count("*").alias("w"), F.min("id").alias("cell"))


def exploded(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """df with node (the number of a k-tuple of attributes) and key (its levels); tuples with a null level drop out."""
    parts = [F.struct(F.lit(i).alias("node"), F.when(sum((F.col(c).isNull().cast("int") for c in t), F.lit(0)) == 0, F.concat_ws(SEP, *t)).alias("key")) for i, t in enumerate(combinations(features, k))]
    return df.withColumn("_x", F.explode(F.array(*parts))).select(*df.columns, "_x.node", "_x.key").filter("key is not null")


def agreement(cs: DataFrame, features: list[str], k: int) -> DataFrame:
    """(cell, node, key, n): rules that agree with the cell on each k-tuple."""
    x = exploded(cs, features, k)
    return x.join(x.groupBy("node", "key").agg(F.sum("w").alias("n")), ["node", "key"]).select("cell", "node", "key", "n")


def label_agreement(cs: DataFrame, features: list[str]) -> DataFrame:
    """(cell, attr, n): rules that agree on one attribute and the label."""
    x = exploded(cs, features, 1)
    return x.join(x.groupBy("node", "key", "y").agg(F.sum("w").alias("n")), ["node", "key", "y"]).select("cell", F.col("node").alias("attr"), "n")


def node_weights(cs: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """(cell, node, key, b): the sum of (k+1)-tuple agreements times the least label agreement in the node."""
    k = min(k, len(features))
    total = agreement(cs, features, min(k + 1, len(features))).groupBy("cell").agg(F.sum("n").alias("total"))
    m = label_agreement(cs, features)
    member = cs.sparkSession.createDataFrame([(i, features.index(c)) for i, t in enumerate(combinations(features, k)) for c in t], "node int, attr int")
    least = m.join(F.broadcast(member), "attr").groupBy("cell", "node").agg(F.min("n").alias("least"))
    return exploded(cs, features, k).select("cell", "node", "key").join(total, "cell").join(least, ["cell", "node"]).select("cell", "node", "key", (F.col("total") * F.col("least")).alias("b"))


def node_table(cs: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """(node, key, y, w): node weights of all rules by their own label."""
    return node_weights(cs, features, k).join(cs.select("cell", "y", F.col("w").alias("n")), "cell").groupBy("node", "key", "y").agg(F.sum(F.col("b") * F.col("n")).alias("w"))


def rule_matrix(cs: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """(cell, node, key, y, c): for each cell and node the weights of all rules that agree with it there, by their label y."""
    table = node_table(cs, features, k).withColumnRenamed("w", "c")
    return exploded(cs.select("cell", *features), features, min(k, len(features))).select("cell", "node", "key").join(table, ["node", "key"])


def pair_sums(cs: DataFrame, features: list[str], scope: str = "global") -> DataFrame:
    """(cell, attr, s): sums of pair agreements: all pairs, those that hold the attribute (adjacent), or those it begins (upper)."""
    if scope not in ("global", "adjacent", "upper"):
        raise ValueError(f"unknown scope {scope}")
    pairs = list(combinations(range(len(features)), 2))
    held = [(p, a) for p, t in enumerate(pairs) for a in range(len(features)) if scope == "global" or (a in t if scope == "adjacent" else a == t[0])]
    use = F.broadcast(cs.sparkSession.createDataFrame(held, "node int, attr int"))
    every = cs.select("cell", F.explode(F.array(*[F.lit(i) for i in range(len(features))])).alias("attr"))
    sums = agreement(cs, features, 2).join(use, "node").groupBy("cell", "attr").agg(F.sum("n").alias("s"))
    return every.join(sums, ["cell", "attr"], "left").select("cell", "attr", F.coalesce("s", F.lit(0)).cast("long").alias("s"))


def pair_table(cs: DataFrame, features: list[str], scope: str = "global") -> DataFrame:
    """(attr, level, y, w): sum of pair sums of a level times its rules with the label, as decimals; every label has an entry."""
    s = pair_sums(cs, features, scope)
    x = exploded(cs, features, 1).select("cell", F.col("node").alias("attr"), F.col("key").alias("level"), "y", "w").join(s, ["cell", "attr"])
    total = x.groupBy("attr", "level").agg(F.sum(F.col("s").cast(EXACT) * F.col("w")).cast(EXACT).alias("s"))
    have = x.groupBy("attr", "level", "y").agg(F.sum("w").alias("n"))
    grid = total.crossJoin(F.broadcast(cs.select("y").distinct()))  # labels are few
    return grid.join(have, ["attr", "level", "y"], "left").select("attr", "level", "y", (F.col("s") * F.coalesce("n", F.lit(0))).cast(EXACT).alias("w"))


def narrowed(table: DataFrame, column: str = "w") -> DataFrame:
    """The table with a column of decimals as 64-bit numbers if the sum of any two is one; else as it is.  The table is read twice."""
    most = table.agg(F.max(F.abs(column))).first()[0] or 0
    return table if 2 * most >= 1 << 63 else table.withColumn(column, F.col(column).cast("long"))
