"""Rule tables derived from the star schema, and the SQL of the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzloom.operators import prep
from fuzzloom.sources.staging import staged

FEATURES = ["f0", "f1", "f2", "f3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    raw = staged(o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("a"), F.col("c_acctbal").cast("double").alias("b"), F.col("o_orderpriority").alias("f2"), F.col("c_mktsegment").alias("f3"), (F.col("o_orderstatus") == "F").cast("int").alias("y")))
    fuzzy = prep.fuzzify(raw, prep.fit_cuts(raw, ["a", "b"]), {"a": "f0", "b": "f1"})
    return fuzzy.select("id", *FEATURES, "y")


def rules_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    raw = d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("a"), F.col("lang").alias("f1"), F.when(number < 5, "A").when(number < 10, "B").otherwise("C").alias("f2"), F.when(F.col("toxic") == 1, "T").otherwise("N").alias("f3"), F.col("quality").cast("int").alias("y"))
    return prep.fuzzify(raw, prep.fit_cuts(raw, ["a"]), {"a": "f0"}).select("id", *FEATURES, "y")


_TERTILE = "CASE WHEN {v} <= {q}[1] THEN 'Low' WHEN {v} <= {q}[2] THEN 'Medium' ELSE 'High' END"
SQL_ORDERS = f"""
raw AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS a, CAST(c_acctbal AS DOUBLE) AS b, o_orderpriority AS f2, c_mktsegment AS f3, CAST(o_orderstatus = 'F' AS INT) AS y
        FROM orders JOIN customer ON o_custkey = c_custkey),
cut AS (SELECT quantile_cont(a, [1.0/3, 2.0/3]) AS qa, quantile_cont(b, [1.0/3, 2.0/3]) AS qb FROM raw),
rules AS (SELECT id, {_TERTILE.format(v="a", q="qa")} AS f0, {_TERTILE.format(v="b", q="qb")} AS f1, f2, f3, y FROM raw, cut)"""
SQL_DOCS = f"""
raw AS (SELECT d.doc_id AS id, CAST(n_chars AS DOUBLE) AS a, lang AS f1, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) AS s, toxic, CAST(quality AS INT) AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
cut AS (SELECT quantile_cont(a, [1.0/3, 2.0/3]) AS qa FROM raw),
rules AS (SELECT id, {_TERTILE.format(v="a", q="qa")} AS f0, f1, CASE WHEN s < 5 THEN 'A' WHEN s < 10 THEN 'B' ELSE 'C' END AS f2, CASE WHEN toxic = 1 THEN 'T' ELSE 'N' END AS f3, y FROM raw, cut)"""
SQL_SPLIT = """
split AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1) % 5 AS fold FROM rules),
train AS (SELECT * FROM split WHERE fold <> 0), query AS (SELECT * FROM split WHERE fold = 0)"""
