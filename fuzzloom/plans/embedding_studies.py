"""Studies of the rule embedding: sizes, negatives, loss weights, shares of rules, parts left out, each over folds and seeds.

A study is a list of variants; what was trained before, on the same fold with the same settings, is not trained
again, in whichever study it came (see ``sweep``).  A variant's row is the mean over folds of each fold's mean over seeds."""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuzzloom.operators import embedding, infer, matrices, metrics
from fuzzloom.operators.prep import thin_rules
from fuzzloom.plans import sweep
from fuzzloom.sources.staging import staged

DEFAULTS = asdict(embedding.Settings()) | {"rule_share": 1.0, "teacher": True}
DIMS, NEGATIVES, SHARES = (8, 16, 32, 64), (1.0, 3.0, 5.0, 10.0), (0.25, 0.5, 0.75, 1.0)
#: One part of the loss, the teacher, or the pooling changed at a time; the first changes nothing.
ABLATIONS = {"whole": {}, "no edge": {"edge": 0.0}, "no node": {"node": 0.0}, "no rule": {"rule": 0.0}, "no inf": {"inf": 0.0}, "no teacher": {"teacher": False}, "mean pooling": {"alpha": None}, "pred only": {"edge": 0.0, "node": 0.0, "rule": 0.0, "inf": 0.0}}


def bundle(decided: DataFrame, teacher: DataFrame | None = None) -> DataFrame:
    """One row of a model's metrics, from (id, y, pred, score, p): accuracy, balanced accuracy, macro F1, F1, sensitivity, specificity, AUC,
    log loss, and the share of rows on which a teacher (id, pred) decides alike."""
    rows = decided.withColumn("p1", F.element_at("p", 2))
    c = metrics.confusion(rows).select("accuracy", "sensitivity", "specificity", F.coalesce("f1", F.lit(0.0)).alias("f1_pos"))
    out = c.crossJoin(metrics.by_class(rows)).crossJoin(metrics.auc(rows)).crossJoin(metrics.log_loss(rows))  # one row each
    if teacher is None:
        return out.withColumn("agreement", F.lit(None).cast("double"))
    alike = rows.select("id", "pred").join(teacher.select("id", F.col("pred").alias("_t")), "id").agg(F.avg((F.col("pred") == F.col("_t")).cast("double")).alias("agreement"))
    return out.crossJoin(alike)


def lookup_bundle(train: DataFrame, test: DataFrame, features: list[str], timed: int = 50) -> dict:
    """The lookup teacher's metrics on test rows, the time of a row in one job over all, and that of the first rows asked one by one."""
    cs = staged(matrices.cells(train, features))
    table = staged(matrices.node_table(cs, features))

    def ask(rows: DataFrame) -> DataFrame:
        return infer.decided(infer.node_scores(rows, table, features))

    start = time.perf_counter()
    decided = staged(ask(test))
    whole, n = time.perf_counter() - start, test.count()
    d0, d1 = (F.coalesce(d, F.lit(0)) for d in ("d0", "d1"))
    out = bundle(decided.withColumn("p", F.array((d0 + 1) / (d0 + d1 + 2), (d1 + 1) / (d0 + d1 + 2)))).first().asDict()
    few, spent = [r["id"] for r in test.select("id").orderBy("id").limit(timed).collect()], 0.0
    for key in few[:timed]:
        start = time.perf_counter()
        ask(test.filter(F.col("id") == key)).collect()
        spent += time.perf_counter() - start
    return out | {"ms": metrics.per_query_ms(whole, n), "ms_alone": metrics.per_query_ms(spent, len(few))}


def fit(fold: DataFrame, features: list[str], **settings) -> dict:
    """Metrics of an embedding trained on a fold's rules (id, levels, y, part) and asked its test rows."""
    own, share, teach = {k: settings[k] for k in asdict(embedding.Settings())}, settings["rule_share"], settings["teacher"]
    s = embedding.Settings(**own)
    train, test = (fold.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
    rules = train if share >= 1 else thin_rules(train, share, seed=s.seed)
    cs = staged(matrices.cells(rules, features))
    table = staged(matrices.node_table(cs, features))
    samples = embedding.crisp_samples(matrices.cells(train, features).withColumnRenamed("cell", "id"), features)
    asked = cs.withColumnRenamed("cell", "id") if share >= 1 else matrices.cells(train, features).withColumnRenamed("cell", "id")
    if teach:
        scores = infer.node_scores(asked, table, features).withColumns({k: F.coalesce(k, F.lit(0)) for k in ("d0", "d1")}).withColumn("pred", (F.col("d1") > F.col("d0")).cast("int"))
        samples, _ = embedding.taught(samples, scores, infer.attribution(scores, asked, cs, features))
    start = time.perf_counter()
    model = embedding.train(embedding.rule_graph(cs, features, s), staged(samples), s)
    spent = time.perf_counter() - start
    teacher = infer.decided(infer.node_scores(test, table, features))
    start = time.perf_counter()
    decided = staged(embedding.predict(embedding.crisp_samples(test, features), model))
    ms = metrics.per_query_ms(time.perf_counter() - start, test.count())
    return bundle(decided, teacher).first().asDict() | {"train_s": spent, "ms": ms, "steps": len(model.history), "rules": rules.count(), "note": model.stopped}


def study(spark: SparkSession, path: str, folds: dict[str, DataFrame], features: list[str], variants: dict[str, dict], seeds: tuple[int, ...] = (42,), defaults: dict | None = None) -> DataFrame:
    """(variant, metric, mean, sd, folds) of all variants, trained on every fold under every seed, with results kept at path."""
    base = DEFAULTS | (defaults or {})
    settings = {(name, seed): base | v | {"seed": seed} for name, v in variants.items() for seed in seeds}
    if unknown := {k for v in settings.values() for k in v} - set(DEFAULTS):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    kept = sweep.sweep(spark, path, "embedding", folds, settings.values(), lambda df, **s: fit(df, features, **s), DEFAULTS)
    named = spark.createDataFrame([(name, sweep.canonical(s, DEFAULTS)) for (name, _), s in settings.items()], "variant string, settings string")
    long = kept.join(F.broadcast(named), "settings").select("variant", F.col("input").alias("fold"), F.explode("metrics").alias("metric", "v"))  # a row a variant
    return metrics.over_folds(long.filter(F.col("v").isNotNull()), ["variant", "metric"], "v")


def by_dims(dims: tuple[int, ...] = DIMS) -> dict:
    return {f"dim {d}": {"dim": d} for d in dims}


def by_negatives(counts: tuple[float, ...] = NEGATIVES) -> dict:
    return {f"negatives {k:g}": {"negatives": float(k)} for k in counts}


def by_weights(grid: dict[str, tuple[float, ...]]) -> dict:
    """A variant for each choice of one value a weight."""
    out = {"": {}}
    for name, values in grid.items():
        out = {f"{k} {name}={v:g}".strip(): s | {name: float(v)} for k, s in out.items() for v in values}
    return out


def by_share(shares: tuple[float, ...] = SHARES) -> dict:
    return {f"rules {x:g}": {"rule_share": x} for x in shares}
