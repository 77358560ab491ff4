"""Scoring of streams: a stateless look-up, the same on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from fuzzloom.operators.infer import decided

MAX_ENTRIES = 20_000


def pair_stream(queries: DataFrame, table: DataFrame, features: list[str]) -> DataFrame:
    """queries with d0, d1, margin, score and pred, row by row, so late or repeated events need no state.

    The weight table (attr, level, y, w) is one entry a level and label; its size is checked."""
    rows, kind = table.limit(MAX_ENTRIES + 1).collect(), table.schema["w"].dataType  # literals of decimals would have types of their own
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"over {MAX_ENTRIES} levels")
    out = queries
    for y in (0, 1):
        found = []
        for i, c in enumerate(features):
            of = [x for r in rows if r["attr"] == i and r["y"] == y for x in (F.lit(r["level"]), F.lit(r["w"]).cast(kind))]
            if of:
                found.append(F.try_element_at(F.create_map(*of), F.col(c).cast("string")))
        seen = F.filter(F.array(*found), lambda w: w.isNotNull()) if found else F.array().cast(ArrayType(kind))
        out = out.withColumn(f"d{y}", F.array_min(seen) + F.array_max(seen))
    return decided(out)
