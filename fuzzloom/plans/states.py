"""Trained embeddings as versioned tables.

A version holds a model's tokens with their vectors, its cells, the edges and one row of settings,
threshold and history.  Its folder is written whole before the row that names it as
done, so a version that was broken off is never read.  Scores of a restored model are those of the saved one."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from fuzzloom.operators.embedding import Model, RuleGraph, Settings

DONE = "version int, settings string, attributes int, n_labels int, threshold double, stopped string, history string, note string"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The versions kept at a path, one row each."""
    try:
        return spark.read.schema(DONE).parquet(f"{path}/done")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DONE)


def save(spark: SparkSession, path: str, m: Model, note: str = "") -> int:
    """Keep a model as the next version, and tell its number."""
    version = (versions(spark, path).agg({"version": "max"}).first()[0] or 0) + 1
    g, at = m.graph, f"{path}/version-{version}"
    tokens = [(i, t, m.z[i].tolist(), m.c[i].tolist(), g.shares[i].tolist()) for i, t in enumerate(g.vocab)]
    cells = [(i, int(g.cells[i]), int(g.labels[i]), float(g.weights[i]), float(g.own[i]), np.flatnonzero(g.pool[i]).tolist(), g.pool[i][g.pool[i] != 0].tolist()) for i in range(len(g.cells))]
    edges = [(int(i), int(j), float(g.edges[i, j])) for i, j in zip(*np.nonzero(g.edges), strict=True)]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{at}/{name}")
    write(tokens, "no int, token string, z array<double>, c array<double>, shares array<double>", "tokens")
    write(cells, "no int, cell long, label int, weight double, own double, at array<int>, pool array<double>", "cells")
    write(edges, "u int, v int, n double", "edges")
    write([(i, x.tolist()) for i, x in enumerate(m.u)], "no int, u array<double>", "labels")
    row = (version, json.dumps(asdict(m.settings)), g.attributes, g.n_labels, m.threshold, m.stopped, json.dumps(m.history), note)
    spark.createDataFrame([row], DONE).coalesce(1).write.mode("append").parquet(f"{path}/done")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> Model:
    """A version, or the last one, with its settings, threshold and history."""
    held = versions(spark, path)
    row = held.orderBy(held["version"].desc()).first() if version is None else held.filter(held["version"] == version).first()
    if row is None:
        raise ValueError(f"no version {version or ''} at {path}")
    read = lambda name, *order: spark.read.parquet(f"{path}/version-{row['version']}/{name}").orderBy(*order).collect()  # noqa: E731  a model fits the driver
    tokens, cells, labels = read("tokens", "no"), read("cells", "no"), read("labels", "no")
    pool, edges = np.zeros((len(cells), len(tokens))), np.zeros((len(tokens), len(tokens)))
    for r in cells:
        pool[r["no"], r["at"]] = r["pool"]
    for r in read("edges", "u", "v"):
        edges[r["u"], r["v"]] = r["n"]
    column = lambda rows, name, kind=float: np.array([r[name] for r in rows], kind)
    graph = RuleGraph([r["token"] for r in tokens], row["attributes"], column(cells, "cell", np.int64), column(cells, "label", int), column(cells, "weight"), pool, column(cells, "own"), edges, column(tokens, "shares"), row["n_labels"])
    return Model(graph, Settings(**json.loads(row["settings"])), column(tokens, "z"), column(tokens, "c"), column(labels, "u"), row["threshold"], json.loads(row["history"]), row["stopped"])
