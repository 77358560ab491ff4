"""What operators refuse: empty rule bases, rules without attributes or of unequal length, unfitted transforms, unknown names.

Checks read at most one row or the schema, but for ragged rules, which one aggregation finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_rules(rules: DataFrame | None, features: list[str]) -> None:
    """A rule base has a rule, an attribute, and all of its columns."""
    if rules is None:
        raise ValueError("the rule base is empty")
    if not features:
        raise ValueError("a rule needs an attribute at least")
    if missing := [c for c in (*features, "y") if c not in rules.columns]:
        raise ValueError(f"columns are missing: {missing}")
    if rules.isEmpty():
        raise ValueError("the rule base is empty")


def from_lists(rules: DataFrame, levels: str = "levels", key: str = "id", label: str = "y") -> tuple[DataFrame, list[str]]:
    """(id, f0.., y) and the attributes' names, of rules that hold their levels in an array; all arrays must be as long."""
    size = rules.agg(F.min(F.size(levels)).alias("a"), F.max(F.size(levels)).alias("z"), F.count_if(F.col(levels).isNull()).alias("none"), F.count("*").alias("n")).first()
    if not size["n"]:
        raise ValueError("the rule base is empty")
    if size["none"] or size["a"] != size["z"]:
        raise ValueError("rules have unequal numbers of attributes")
    if not size["a"]:
        raise ValueError("a rule needs an attribute at least")
    names = [f"f{i}" for i in range(size["a"])]
    return rules.select(key, *[F.col(levels)[i].alias(n) for i, n in enumerate(names)], label), names


class Fuzzifier:
    """Medians, cuts and clinical bins of a training table, for any table with its columns; labels are not needed to transform."""

    def __init__(self, spec, at: tuple[float, ...] = (1 / 3, 2 / 3)):
        self.spec, self.at, self.medians, self.cuts = spec, at, None, None

    def fit(self, df: DataFrame) -> Fuzzifier:
        from fuzzloom.operators import prep

        prep.check_columns(df, self.spec)
        self.medians = prep.fit_medians(df, self.spec)
        self.cuts = prep.fit_cuts(prep.impute(df, self.medians, self.spec), self.spec.numeric, self.at)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """df with levels in place of the spec's features."""
        from fuzzloom.operators import prep

        if self.cuts is None:
            raise RuntimeError("fit comes before transform")
        if missing := [c for c in self.spec.features if c not in df.columns]:
            raise ValueError(f"columns are missing: {missing}")
        return prep.fuzzify_spec(prep.impute(df, self.medians, self.spec), self.cuts, self.spec)
