"""Sources and sinks: tables with provenance, fold files, rule bases and samples as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RULE_BASE = "meta map<string,string>, vocab array<string>, rules array<struct<id:bigint,antecedent_tokens:array<string>,consequent_token:string,confidence:double,support:double,grp:bigint>>, edges array<struct<u:string,v:string,mu:double>>"
SAMPLES = "samples array<struct<membership:map<string,double>,label:string,rule_id:bigint,grp:bigint>>"


def present(spark: SparkSession, path: str) -> bool:
    """Whether any file is there, on any store that Spark reads."""
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException:
        return False


def read_csv(spark: SparkSession, path: str, schema: StructType | str, instead=None) -> DataFrame:
    """A table of a given schema; it is never inferred.  A missing file is an error unless a function tells what stands in."""
    if not present(spark, path):
        if instead is None:
            raise FileNotFoundError(path)
        return instead()
    return spark.read.schema(schema).option("header", True).csv(path)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def _with_positions(df: DataFrame) -> DataFrame:
    """df with id, each row's place in the file from 0: a partition's rows follow those of the partitions before."""
    x = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = x.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # blank rows are gone before rows are numbered, so places run on within a partition
    return x.join(F.broadcast(base), "_part").withColumn("id", F.col("_at") - F.col("_first") + F.col("_base")).drop("_at", "_part", "_first", "_base")


def read_fold(spark: SparkSession, path: str, attributes: int = 16, levels: int = 5) -> DataFrame:
    """(id, grp, f0.., y): level codes and labels 1 and 2; blank rows go, other values are an error."""
    names = [f"f{i}" for i in range(attributes)]
    df = spark.read.schema(", ".join(f"{n} int" for n in [*names, "y"])).option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path).na.drop("all")
    bad = sum(((~F.coalesce(F.col(n).between(1, levels), F.lit(False))).cast("int") for n in names), F.lit(0)) > 0
    if df.filter(bad | ~F.coalesce(F.col("y").isin(1, 2), F.lit(False))).limit(1).count():
        raise ValueError("a level or label is out of its domain")
    ordered = _with_positions(df)
    return ordered.join(ordered.groupBy(*names, "y").agg(F.min("id").alias("grp")), [*names, "y"])


def list_folds(spark: SparkSession, root: str) -> list[str]:
    """The names of the fold_* folders, sorted."""
    if not present(spark, f"{root}/fold_*/*"):
        return []
    name = F.regexp_extract("path", r"/(fold_[^/]*)/[^/]*$", 1)
    return [r[0] for r in spark.read.format("binaryFile").load(f"{root}/fold_*/*").select(name.alias("f")).distinct().orderBy("f").collect()]


def write_rule_base(rules: DataFrame, edges: DataFrame, meta: dict[str, str], path: str) -> None:
    """A rule base as one JSON object, of rules (id, antecedent_tokens, consequent_token, confidence, support, grp) and edges (u, v, mu).

    The format is one object, so its rules are gathered; a rule base is a compact table."""
    one = rules.agg(F.array_sort(F.collect_list(F.struct("id", "antecedent_tokens", "consequent_token", "confidence", "support", "grp"))).alias("rules"))
    vocab = F.array_sort(F.array_distinct(F.flatten(F.transform("rules", lambda r: F.concat(r["antecedent_tokens"], F.array(r["consequent_token"]))))))
    links = edges.agg(F.array_sort(F.collect_list(F.struct("u", "v", "mu"))).alias("edges"))
    told = F.create_map(*[F.lit(x) for kv in sorted(meta.items()) for x in kv]) if meta else F.create_map().cast("map<string,string>")
    one.crossJoin(links).select(told.alias("meta"), vocab.alias("vocab"), "rules", "edges").coalesce(1).write.mode("overwrite").json(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples (membership, label, rule_id, grp) as one JSON object."""
    names = ["membership", "label", "rule_id", "grp"]
    samples.agg(F.collect_list(F.struct(*names)).alias("samples")).coalesce(1).write.mode("overwrite").json(path)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """One SHA-256 over the names and contents of all files, in order of their names."""
    rows = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha"))), lambda x: F.concat_ws(":", x["name"], x["sha"])), "\n"), 256).alias("f")).first()["f"]


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions and settings that a result depends on."""
    import platform
    from importlib import metadata

    out = {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "master": spark.sparkContext.master}
    out |= {k: metadata.version(k) for k in ("numpy", "pandas", "pyarrow", "pyspark")}
    return out | {k: spark.conf.get(k, "") for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")}


def read_rule_base(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULE_BASE).option("multiLine", True).json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).option("multiLine", True).json(path).select(F.explode("samples").alias("s")).select("s.*")


def split_token(token):
    """Attribute and level of a token, split at its last hyphen."""
    return F.regexp_extract(token, "^(.*)-([^-]*)$", 1).alias("attr"), F.regexp_extract(token, "^(.*)-([^-]*)$", 2).alias("level")


def write_results(df: DataFrame, path: str, run_id: str, form: str = "parquet") -> None:
    """A result table with its run; NaN and infinities become null."""
    clean = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    df.withColumns(clean).withColumn("run_id", F.lit(run_id)).write.mode("overwrite").format(form).save(path)


def markdown(df: DataFrame) -> str:
    """A small table as Markdown."""
    rows = [list(df.columns), ["---"] * len(df.columns), *[["" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r] for r in df.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
