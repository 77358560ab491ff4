"""Cleaning and fuzzification: profile, imputation, cut points, levels, rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzloom.operators.ordered import fitted

LEVELS = ("Low", "Medium", "High")


@dataclass(frozen=True)
class DatasetSpec:
    """Columns of a table: its features, label, columns in which 0 is missing, categories, and fixed bins."""

    features: tuple[str, ...]
    label: str
    zero_missing: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    clinical: dict = field(default_factory=dict)  # column -> ((bound, level), ..., (None, last level))

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.features if c not in self.categorical]


def check_columns(df: DataFrame, spec: DatasetSpec) -> None:
    if missing := [c for c in (*spec.features, spec.label) if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")


def is_missing(column: str, spec: DatasetSpec) -> Column:
    return F.col(column).isNull() | (F.col(column) == 0) if column in spec.zero_missing else F.col(column).isNull()


def valid(column: str, spec: DatasetSpec) -> Column:
    """The number, null where it is missing or can't be read as one."""
    x = F.col(column).try_cast("double")
    return F.when(~F.isnan(x), F.nullif(x, F.lit(0.0)) if column in spec.zero_missing else x)


def profile(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One row: rows, distinct rows, duplicates, label counts and missing values of each feature."""
    check_columns(df, spec)
    rows = df.select(*spec.features, spec.label).groupBy(*spec.features, spec.label).agg(F.count("*").alias("_n"))
    aggs = [F.sum("_n").alias("n_raw"), F.count("*").alias("n_clean"), (F.sum("_n") - F.count("*")).alias("n_dup"), F.count_if(F.col(spec.label) == 1).alias("n_pos")]
    return rows.agg(*aggs, *[F.coalesce(F.sum(F.when(is_missing(c, spec), F.col("_n"))), F.lit(0)).cast("long").alias(f"missing_{c}") for c in spec.features])


def conflicts(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One row: n_conflicts, the distinct feature tuples that have more than one label."""
    return df.groupBy(*spec.features).agg((F.min(spec.label) != F.max(spec.label)).alias("c")).agg(F.count_if("c").alias("n_conflicts"))


def fit_medians(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One row of medians of the valid values; labels are never read."""
    got = fitted(df.select(*[valid(c, spec).alias(c) for c in spec.numeric]), spec.numeric, [0.5])
    if none := [c for c, v in got.items() if v is None]:
        raise ValueError(f"no valid value in {none}")
    return df.sparkSession.createDataFrame([tuple(got[c][0] for c in spec.numeric)], ", ".join(f"`{c}` double" for c in spec.numeric))


def impute(df: DataFrame, medians: DataFrame, spec: DatasetSpec) -> DataFrame:
    row = medians.first().asDict()
    cols = {c: F.coalesce(valid(c, spec), F.lit(row[c])) for c in spec.numeric}
    return df.withColumns(cols | {c: F.coalesce(F.col(c).cast("string"), F.lit("Missing")) for c in spec.categorical})


def fit_cuts(df: DataFrame, columns: list[str], at: tuple[float, ...] = (1 / 3, 2 / 3)) -> DataFrame:
    """One row of exact quantiles with linear interpolation, an array for each column."""
    got = fitted(df, columns, list(at))
    return df.sparkSession.createDataFrame([tuple(got[c] for c in columns)], ", ".join(f"`{c}` array<double>" for c in columns))


def by_cuts(value: Column, cuts: list[float]) -> Column:
    """Closed on the right: at most the first cut is Low."""
    return F.when(value <= cuts[0], LEVELS[0]).when(value <= cuts[1], LEVELS[1]).otherwise(LEVELS[2])


def by_bins(value: Column, bins) -> Column:
    """Closed on the left: the first bin whose bound is above the value, else the last."""
    out = reduce(lambda e, b: (F if e is None else e).when(value < b[0], b[1]), bins[:-1], None)
    return out.otherwise(bins[-1][1])


def fuzzify(df: DataFrame, cuts: DataFrame, names: dict[str, str]) -> DataFrame:
    """Levels under new names; the fitted cuts are one row."""
    if (row := cuts.first()) is None or any(row[c] is None for c in names):
        return df.withColumns({new: F.lit(None).cast("string") for new in names.values()})
    return df.withColumns({new: by_cuts(F.col(c), row[c]) for c, new in names.items()})


def fuzzify_spec(df: DataFrame, cuts: DataFrame, spec: DatasetSpec) -> DataFrame:
    """All features of a spec as levels: fixed bins, fitted cuts or the categories themselves."""
    row = cuts.first()
    cols = {c: by_bins(F.col(c), spec.clinical[c]) if c in spec.clinical else by_cuts(F.col(c), row[c]) for c in spec.numeric}
    return df.withColumns(cols | {c: F.col(c).cast("string") for c in spec.categorical})


def to_rules(fuzzy: DataFrame, spec: DatasetSpec, key: str) -> DataFrame:
    return fuzzy.select(F.col(key).alias("id"), *spec.features, F.col(spec.label).cast("int").alias("y"))


def level_codes(rules: DataFrame, features: list[str]) -> DataFrame:
    """(attr, level, code): codes by sorted distinct level, from 0; a level that is not here is unseen (-1 by left join)."""
    from pyspark.sql import Window

    levels = rules.select(F.explode(F.array(*[F.struct(F.lit(i).alias("attr"), F.col(c).alias("level")) for i, c in enumerate(features)])).alias("x")).select("x.*").distinct()
    return levels.withColumn("code", F.row_number().over(Window.partitionBy("attr").orderBy("level")) - 1)


def keep_rules(rules: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rules whose id is told."""
    return rules.join(ids.select(key), key, "left_semi")


def thin_rules(rules: DataFrame, share: float, key: str = "id", seed: int = 0) -> DataFrame:
    """A random share of the rules, rounded up: the first ones by hash."""
    from fuzzloom.operators.split import budget, numbered

    m = budget(share, rules.count())
    return numbered(rules, [], key, seed).filter(F.col("_no") < m).drop("_no")


def pruned(edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """The edges (u, v, ...) whose ends both are still among the rules' tokens (token)."""
    have = tokens.select("token").distinct()
    return edges.join(have.withColumnRenamed("token", "u"), "u", "left_semi").join(have.withColumnRenamed("token", "v"), "v", "left_semi").select(edges.columns)


def one_hot(rules: DataFrame, features: list[str], key: str = "id") -> DataFrame:
    """(id, attr, level): the long form of one-hot codes; squared distances are twice the number of attributes that differ."""
    return rules.select(key, F.posexplode(F.array(*features)).alias("attr", "level")).filter("level is not null")


def impute_by_class(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The older form: a missing value becomes the median of the row's own class, or the mean of the class medians.

    It reads labels, so results on held-out rows are too good; for comparisons only."""
    per = df.groupBy(spec.label).agg(*[F.median(valid(c, spec)).alias(f"_m_{c}") for c in spec.numeric])
    mean = per.agg(*[F.avg(f"_m_{c}").alias(f"_a_{c}") for c in spec.numeric])
    out = df.join(F.broadcast(per), spec.label).crossJoin(F.broadcast(mean))  # a row for each class; one row
    return out.select(*[F.coalesce(valid(c, spec), f"_m_{c}", f"_a_{c}").alias(c) if c in spec.numeric else F.col(c) for c in df.columns])
