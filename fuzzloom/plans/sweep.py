"""Sweeps of settings whose results are kept: what was done before, on the same input, is not done again.

A result's key is a fingerprint of its settings and its input.  Settings that equal the defaults do not
count, so a configuration is known again in whatever sweep it comes.  An input's fingerprint does not depend
on the order or number of partitions of its rows.  Each result is appended to a table when it is there, so a sweep
that was broken off goes on where it stopped; what is left to do is an anti-join."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = "key string, input string, settings string, metrics map<string,double>, note string"


def content_of(df: DataFrame) -> str:
    """A fingerprint of a table's columns and rows, repeated rows included, by one aggregation."""
    cols = sorted(df.columns)
    row = [F.coalesce(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols])), F.lit("")).alias("r")]
    got = df.select(*row).agg(F.count("*"), F.sum(F.xxhash64("r").cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), "r").cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([cols, *[str(x) for x in got]]).encode()).hexdigest()


def canonical(settings: dict, defaults: dict | None = None) -> str:
    """Settings as text, by name, without those that equal the defaults."""
    return json.dumps({k: v for k, v in sorted(settings.items()) if k not in (defaults or {}) or defaults[k] != v}, sort_keys=True)


def key_of(content: str, settings: str, study: str) -> str:
    return hashlib.sha256(json.dumps([study, content, settings]).encode()).hexdigest()


def results(spark: SparkSession, path: str) -> DataFrame:
    """The results kept at a path; none where nothing was kept.  A key that was appended twice, by sweeps side by side, comes once."""
    try:
        return spark.read.schema(RESULTS).parquet(path).dropDuplicates(["key"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULTS)


def sweep(spark: SparkSession, path: str, study: str, inputs: dict[str, DataFrame], settings: Iterable[dict], train: Callable[..., dict], defaults: dict | None = None) -> DataFrame:
    """(input, settings, key, metrics, note) of every input under all settings, in a table kept at path.

    train(input, **settings) gives a dict of numbers, and a note under that name if it likes; it runs for keys that are not kept."""
    texts = sorted({canonical(s, defaults) for s in settings})
    asked = [(key_of(content, s, study), name, s) for name, content in ((n, content_of(df)) for n, df in inputs.items()) for s in texts]
    wanted = spark.createDataFrame(asked, "key string, input string, settings string")
    left = wanted.join(results(spark, path).select("key"), "key", "left_anti").dropDuplicates(["key"]).orderBy("input", "settings").collect()  # one row a configuration
    for r in left:
        got = dict(train(inputs[r["input"]], **((defaults or {}) | json.loads(r["settings"]))))
        note = got.pop("note", None)
        row = (r["key"], r["input"], r["settings"], {k: None if v is None else float(v) for k, v in got.items()}, note)
        spark.createDataFrame([row], RESULTS).coalesce(1).write.mode("append").parquet(path)
    kept = results(spark, path).select("key", "metrics", "note")
    return wanted.join(kept, "key").select("input", "settings", "key", "metrics", "note")
