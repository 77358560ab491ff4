"""Mixing sources to target weights by cube-method balanced sampling.

Targets share a total by weight, each at most twice its source's size (a water level).
Every document of a source is wanted target / size times: the whole part is taken outright
and the fraction becomes an inclusion probability.  The cube method moves these
probabilities within the null space of the constraints, so that words and documents of a
source stay at their expected totals, until each is 0 or 1.  Blocks of a source fly in
parallel and leave at most two fractions each; these fly on together, level by level, and
the landing at the end gives up the document total first, then the words.

Null texts and texts without words have size 0; a null source is a source of its own and
comes last.  A source without words has target 0.  Rows that share a doc_id are decided
one by one.  The order within a block and its random numbers follow from the rows, so
that reruns agree.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.llm.common import n_words, packed, written

WEIGHTS = (3, 1, 2)
BLOCK, FAN = 1024, 512  # documents of a block; blocks whose remainders fly together
PIECE = 100_000  # equal rows that one task numbers
EPS = 1e-9


def fly(pi: list[float], sizes: list[float], rng: random.Random, land: bool) -> None:
    """Move pi in place until at most two fractions are left, or with land none.

    Three fractions have a direction that keeps both sum(pi) and sum(pi * size)."""
    live: list[int] = []

    def step(direction: list[float]) -> None:
        up = down = math.inf
        for i, u in zip(live, direction, strict=True):
            if u > 0:
                up, down = min(up, (1 - pi[i]) / u), min(down, pi[i] / u)
            elif u < 0:
                up, down = min(up, pi[i] / -u), min(down, (1 - pi[i]) / -u)
        by = up if rng.random() * (up + down) < down else -down
        for i, u in zip(live, direction, strict=True):
            pi[i] += by * u
            if pi[i] < EPS:
                pi[i] = 0.0
            elif pi[i] > 1 - EPS:
                pi[i] = 1.0
        live[:] = [i for i in live if 0 < pi[i] < 1]

    for i in range(len(pi)):
        if 0 < pi[i] < 1:
            live.append(i)
            while len(live) == 3:
                a, b, c = (sizes[j] for j in live)
                u = [b - c, c - a, a - b]
                top = max(map(abs, u))
                step([x / top for x in u] if top else [1.0, -1.0, 0.0])
    while land and live:
        if len(live) == 2:
            a, b = (sizes[j] for j in live)
            top = max(a, b)
            step([b / top, -a / top] if top else [1.0, -1.0])
        else:
            pi[live[0]] = float(rng.random() < pi[live[0]])
            live.clear()


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs, target): one row per source.

    The level is found over the sources in order of cap / weight: those below it get their cap."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    every = Window.partitionBy(F.lit(0))  # this table has one row per source
    code_points = every.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(code_points) - 1) % len(weights) + 1).cast("int"))
    ready = by.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(every))
    order = every.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = ready.withColumn("level", level).withColumn("above", F.col("level") * F.col("weight") <= F.col("most"))
    at = F.min(F.when(F.col("above"), F.struct(F.col("most") / F.col("weight"), "level"))).over(every)["level"]
    target = F.least(F.col("most"), F.coalesce(at * F.col("weight"), F.col("most")))
    return found.select("source", "source_size", "n_docs", target.alias("target"))


def _flight(rows: DataFrame, land: bool, seed: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["spread", "size", "tie", "again"], kind="stable")
        pi = pdf["pi"].tolist()
        fly(pi, pdf["size"].tolist(), random.Random(f"{seed} {pdf['source_no'].iloc[0]} {pdf['block'].iloc[0]} {land}"), land)
        return pdf.assign(pi=pi)

    return rows.groupBy("source_no", "block").applyInPandas(run, rows.schema)


def copies(rows: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """rows (source, size, spread, tie, again, ...) with source_size, target and copies: 0 up to the cap.

    spread is a hash that deals a source's rows to blocks; spread, size, tie and again order a block."""
    rows = written(rows)
    table = written(targets(rows, share, cap))
    numbered = table.withColumn("source_no", F.xxhash64("source")).withColumnRenamed("source", "s")
    most = table.agg(F.max("n_docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.greatest(F.ceil(F.col("n_docs") / BLOCK), F.lit(1))
    joined = rows.join(numbered, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    level = joined.select(
        *rows.columns,
        "source_no",
        "source_size",
        "target",
        F.floor(rate).cast("int").alias("whole"),
        F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("pi"),
        F.pmod("spread", blocks).alias("block"),
    )
    n, done = max(1, -(-most // BLOCK)), []
    while True:
        last = n == 1
        level = written(_flight(level, last, seed))
        whole = F.col("pi").isin(0.0, 1.0)
        done.append(level.filter(whole))
        if last:
            break
        level = level.filter(~whole).withColumn("block", F.floor(F.col("block") / FAN))
        n = -(-n // FAN)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("copies", F.col("whole") + F.col("pi").cast("int")).drop("pi", "whole", "block", "source_no")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie, again, spread), one row per document.

    Equal rows are counted on the map side and numbered by again, in pieces, so that they
    are dealt to blocks like any others."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    equal = rows.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("n"))
    pieces = equal.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))))
    dealt = pieces.repartition("doc_id", "tie", "low")
    every = dealt.withColumn("again", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + PIECE, F.col("n")) - 1)))
    return every.select("doc_id", "source", "size", "tie", "again", F.xxhash64("doc_id", "tie", "again").alias("spread"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """One row per document: how many of its words the mix takes, repeats counted."""
    return copies(sized(docs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it.

    Rows that share doc_id, source and text are told apart by their number among each other."""
    taken = copies(sized(docs)).filter("copies > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("tie").alias("own"), "again", "copies")
    rows = packed(docs, "doc_id", "source").withColumn("tie", F.xxhash64("whole.text"))
    among = Window.partitionBy("doc_id", "source", "tie").orderBy("tie")
    numbered = rows.withColumn("at", F.row_number().over(among) - 1)
    on = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("own")) & (F.col("at") == F.col("again"))
    return numbered.join(taken, on).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")
