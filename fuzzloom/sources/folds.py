"""Where the folds of a study come from: fold files, one split of JSON samples, or generated tables.

Sources are asked in turn, and the first that is there is used; what was used is told with it.  Each
generated table and each random share of rules has a seed of its own, from the data set's place in the study."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzloom.operators.ordered import before
from fuzzloom.operators.prep import thin_rules
from fuzzloom.sources import files, synthetic
from fuzzloom.sources.staging import staged

RULE_SEED, SAMPLE_SEED = 100, 200


@dataclass
class FoldSource:
    """rules, train and test of one fold; kind is folds, json or generated, info tells sizes and seeds."""

    name: str
    kind: str
    rules: DataFrame
    train: DataFrame
    test: DataFrame
    info: dict = field(default_factory=dict)


def in_file_order(df: DataFrame, file: str = "file", pos: str = "pos", name: str = "no") -> DataFrame:
    """df with no, each row's number from 0 over all files by name and then by place; counted over ranges, not in one task."""
    return before(df, [], [F.asc(file), F.asc(pos)], F.lit(1).cast("long"), name=name).withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def split_by_position(df: DataFrame, share: float = 0.6, file: str = "file", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """The first share of all rows in file order, rounded down, and the rest."""
    if not 0 <= share <= 1:
        raise ValueError("the share must be in [0, 1]")
    numbered = staged(in_file_order(df, file, pos))
    first = math.floor(share * numbered.count() + 1e-12)
    return numbered.filter(F.col("no") < first), numbered.filter(F.col("no") >= first)


def json_samples(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, membership, label, rule_id, grp) of the samples of all files at a path, pos their place in the file."""
    raw = spark.read.schema(files.SAMPLES).option("multiLine", True).json(path)
    return raw.select(F.input_file_name().alias("file"), F.posexplode("samples").alias("pos", "s")).select("file", "pos", "s.*")


def json_rules(spark: SparkSession, path: str) -> DataFrame:
    """(id, antecedent_tokens, consequent_token, confidence, support, grp) of a rule base."""
    return files.read_rule_base(spark, path).select(F.explode("rules").alias("r")).select("r.*")


def _kept(rules: DataFrame, share: float | None, seed: int) -> tuple[DataFrame, str]:
    if share is None or share >= 1:
        return rules, "full"
    return thin_rules(rules, share, seed=seed), f"random_{share:g}"


def from_folds(spark: SparkSession, root: str, attributes: int = 16, rule_share: float | None = None, rule_seed: int = 0) -> Iterator[FoldSource]:
    """A source for each fold_* folder with a train and a test file; samples stay whole where rules are thinned."""
    for fold in files.list_folds(spark, root):
        train, test = (files.read_fold(spark, f"{root}/{fold}/*{part}*.csv", attributes) for part in ("train", "test"))
        rules, kept = _kept(train, rule_share, rule_seed)
        yield FoldSource(fold, "folds", rules, train, test, {"rules": kept, "seed": rule_seed})


def from_json(spark: SparkSession, name: str, rules_path: str, samples_path: str, share: float = 0.6, rule_share: float | None = None, rule_seed: int = 0) -> FoldSource | None:
    """One split of samples in file order; None if a file is missing."""
    if not (files.present(spark, rules_path) and files.present(spark, samples_path)):
        return None
    rules, kept = _kept(json_rules(spark, rules_path), rule_share, rule_seed)
    train, test = split_by_position(json_samples(spark, samples_path), share)
    return FoldSource(name, "json", rules, train, test, {"rules": kept, "seed": rule_seed, "share": share})


def generated(spark: SparkSession, name: str, place: int, n_rules: int = 250, n_samples: int = 200, share: float = 0.6, rule_share: float | None = None, rule_seed: int = 0) -> FoldSource:
    """Rules and samples drawn by the seeds of a data set's place; for trials only."""
    rules, kept = _kept(synthetic.rules(spark, n_rules, seed=RULE_SEED + place), rule_share, rule_seed)
    samples = synthetic.samples(spark, n_samples, seed=SAMPLE_SEED + place).withColumns({"file": F.lit(""), "pos": F.col("id")})
    train, test = split_by_position(samples, share)
    return FoldSource(name, "generated", rules, train, test, {"rules": kept, "seeds": (RULE_SEED + place, SAMPLE_SEED + place, rule_seed), "share": share})


def sources(spark: SparkSession, name: str, folds_root: str | None = None, rules_path: str | None = None, samples_path: str | None = None, place: int = 0, allow_generated: bool = False, **how) -> list[FoldSource]:
    """The folds of a data set: fold files, else JSON, else generated tables where these are allowed, else none."""
    if folds_root and (found := list(from_folds(spark, folds_root, **how))):
        return found
    how.pop("attributes", None)
    if rules_path and samples_path and (one := from_json(spark, name, rules_path, samples_path, **how)):
        return [one]
    return [generated(spark, name, place, **how)] if allow_generated else []
