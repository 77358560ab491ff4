"""Hard negatives by an orthogonal rotation and partial inner products.

A row is a vector of whole numbers, its score with an anchor their inner product.  All rows
are rotated by the eigenvectors of their second moments, leading components first; a rotation
keeps inner products, so the leading components of two vectors give a partial product, and by
Cauchy and Schwarz what is missing is at most the product of their remaining norms.  With a
slack for the rounding of 32-bit products (ROUNDING) this bounds every score from both sides.
A pair whose bounds miss what its anchor still asks for is discarded after LEAD[0] components,
the others after LEAD[1], and so on; survivors are verified by products of the whole numbers.

Two searches run like this over all rows.  The first asks for an anchor's best rows of the same
label, its positives.  The second asks, for each positive, for the best rows of other labels
with a score between LOW and HIGH percent of the positive's.  A task holds some thousand rows
at a time and streams the anchors by them, in blocks, from their written table, so nothing is
copied, broadcast or collected but the moments (at most WIDEST squared).  For each anchor it
keeps the best few so far and asks for scores above the last of them.  Each search is made
over the anchors alone first, and the last of an anchor's best there is what all tasks of the
search over all rows start with.

Equal scores are ordered by vec_id, a null one last, then by row; rows that repeat a vec_id are
rows of their own, as anchors, positives and negatives, and only a row itself is left out
of its positives.  Rows with a null label, a null vector, or a null or non-finite component
take no part.  A shorter vector ends in zeros; an empty one scores 0 with all.  A negative positive's
score leaves an empty range.  Scores of 2^56 or more are an error.  Only vec_id, embedding and label
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.llm.common import new_folder, rows_in_slices, stored_batches, written

POSITIVES, NEGATIVES, LOW, HIGH, EVERY = 5, 10, 30, 90, 100
LEAD = (16, 32)  # components of the partial products
HELD, TILE, ANCHORS, WIDEST = 65_536, 4_096, 256, 4_096
ROUNDING = 2.0**-22  # of each component and of the rotation, for 32-bit products
_NULL = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, q) of the rows that take part, q the whole numbers below scale times a component; written."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    part = rows.select("vec_id", "embedding", "label").filter(F.col("label").isNotNull() & x.isNotNull() & finite)
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return written(part.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q")))


def _matrix(q: pa.Array, width: int) -> np.ndarray:
    """Vectors side by side, as doubles; shorter ones end in zeros."""
    q = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    n = np.asarray(q.value_lengths()).astype(np.int64)
    flat = np.asarray(q.flatten()).astype(np.float64)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    of = np.repeat(np.arange(len(n)), n)
    out[of, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Orthogonal columns, those of the greatest second moment first, from sums over all rows."""

    def run(batches):
        total = np.zeros((width, width))
        for part in rows_in_slices(batches, 4096):
            x = _matrix(part.column(0), width)
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = rows.select("q").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()  # width squared over two
    moments = np.zeros((width, width))
    moments[sums["i"], sums["j"]] = moments[sums["j"], sums["i"]] = sums["s"]
    vectors = np.linalg.eigh(moments)[1][:, ::-1]
    return np.ascontiguousarray(np.linalg.qr(vectors)[0]) if width else vectors


class Rotated:
    """Vectors with their rotated form in 32 bits and the norms that remain after each lead."""

    def __init__(self, q: np.ndarray, turn: np.ndarray, leads: list[int]):
        self.q, exact = q, q @ turn
        self.y = exact.astype(np.float32)
        square = np.cumsum(exact[:, ::-1] ** 2, axis=1)[:, ::-1] if exact.shape[1] else np.zeros((len(q), 0))
        self.rest = [np.sqrt(square[:, k]) if k < exact.shape[1] else np.zeros(len(q)) for k in leads]
        self.norm = np.sqrt((q**2).sum(axis=1))


def _fits(a: float, b: float) -> bool:
    """Whether sums of products of such norms are exact in doubles."""
    if a * b >= 2.0**56:
        raise ValueError("scores of 2^56 or more; take a smaller scale")
    return a * b < 2.0**52


def exact_scores(a: Rotated, b: Rotated, ai: np.ndarray, bi: np.ndarray, low: int, high: int, whole: bool) -> np.ndarray:
    """Integer products of pairs of numbers, those of b counted from low."""
    if len(ai) > len(a.q) * (high - low) // 16 and whole:
        return (a.q @ b.q[low:high].T)[ai, bi].astype(np.int64)
    out = np.empty(len(ai), np.int64)
    for at in range(0, len(ai), 65_536):
        x, y = a.q[ai[at : at + 65_536]], b.q[low + bi[at : at + 65_536]]
        out[at : at + 65_536] = np.einsum("ij,ij->i", x, y) if whole else np.einsum("ij,ij->i", x.astype(np.int64), y.astype(np.int64))
    return out


def first_each(anchor: np.ndarray, score: np.ndarray, place: np.ndarray, best: int) -> np.ndarray:
    """Places of each anchor's best, by score, then place."""
    order = np.lexsort((place, -score, anchor))
    start = np.searchsorted(anchor[order], anchor[order])
    return order[np.arange(len(order)) - start < best]


def best_of(a: Rotated, a_row: np.ndarray, a_label: np.ndarray, need: np.ndarray, high: np.ndarray, b: Rotated, b_row: np.ndarray, b_label: np.ndarray, leads: list[int], same: bool, best: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, scores, places in b) for each column of need and high: scores from need to high, the best few of each anchor."""
    need, slots, width = need.copy(), need.shape[1], a.q.shape[1]
    kept = [(np.zeros(0, np.int64),) * 3 for _ in range(slots)]
    whole = _fits(a.norm.max(initial=0), b.norm.max(initial=0))
    for low in range(0, len(b_row), TILE):
        cut = slice(low, low + TILE)
        alive = (a_label[:, None] == b_label[None, cut]) == same
        if same:
            alive &= a_row[:, None] != b_row[None, cut]
        slack = (width + 8) * ROUNDING * np.outer(a.norm, b.norm[cut]) + 1e-6
        part, done = np.zeros(alive.shape, np.float32), 0
        for k, lead in enumerate(leads):
            if not alive.any():
                break
            part = part + a.y[:, done:lead] @ b.y[cut, done:lead].T
            done = lead
            gap = a.rest[k][:, None] * b.rest[k][None, cut] + slack
            alive &= np.any([(part + gap >= need[:, j, None]) & (part - gap <= high[:, j, None]) for j in range(slots)], axis=0)
        ai, bi = np.nonzero(alive)
        if not len(ai):
            continue
        score = exact_scores(a, b, ai, bi, low, min(low + TILE, len(b_row)), whole)
        for j in range(slots):
            ok = (score >= need[ai, j]) & (score <= high[ai, j])
            if ok.any():
                anchor, got, place = (np.concatenate([old, new]) for old, new in zip(kept[j], (ai[ok], score[ok], low + bi[ok]), strict=True))
                top = first_each(anchor, got, place, best)
                kept[j] = anchor[top], got[top], place[top]
                count = np.bincount(anchor[top], minlength=len(a_row))
                last = np.full(len(a_row), _NULL)
                np.minimum.at(last, anchor[top], got[top])
                full = count == best
                need[full, j] = np.maximum(need[full, j], last[full] + 1)  # what comes later loses ties
    return kept


def searched(base: DataFrame, anchors: DataFrame, turn: np.ndarray, same: bool, best: int) -> DataFrame:
    """(anchor, slot, score, vec_id, row): the best rows that tasks found, of anchors (row, label, q, need, high)."""
    path, width = new_folder(base.sparkSession), turn.shape[0]
    written(anchors.select("row", "label", "q", "need", "high"), path=path)
    leads = sorted({min(x, width) for x in LEAD})

    def against(held: pa.Table) -> Iterator[pa.RecordBatch]:
        row = np.asarray(held["row"]).astype(np.int64)
        order = np.lexsort((row, np.asarray(held["vec_id"].fill_null(_NULL)), np.asarray(held["vec_id"].is_null())))
        held, row = held.take(pa.array(order)), row[order]
        b, b_label = Rotated(_matrix(held["q"], width), turn, leads), np.asarray(held["label"])
        for part in stored_batches(path, ["row", "label", "q", "need", "high"], ANCHORS):
            a_row, a_label = (np.asarray(part.column(i)).astype(np.int64) for i in (0, 1))
            need, high = (np.asarray(part.column(i).flatten()).astype(np.int64).reshape(part.num_rows, -1) for i in (3, 4))
            found = best_of(Rotated(_matrix(part.column(2), width), turn, leads), a_row, a_label, need, high, b, row, b_label, leads, same, best)
            for j, (anchor, score, place) in enumerate(found):
                yield pa.RecordBatch.from_arrays([pa.array(a_row[anchor]), pa.array(np.full(len(anchor), j, np.int32)), pa.array(score), held["vec_id"].take(pa.array(place)).combine_chunks(), pa.array(row[place])], names=["anchor", "slot", "score", "vec_id", "row"])

    def run(batches):
        held, n = [], 0
        for part in rows_in_slices(batches, 8192):
            held.append(part)
            n += part.num_rows
            if n >= HELD:
                yield from against(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from against(pa.Table.from_batches(held))

    return base.select("row", "vec_id", "label", "q").mapInArrow(run, "anchor long, slot int, score long, vec_id long, row long")


def ranked(found: DataFrame, best: int) -> DataFrame:
    """The best few of each anchor and slot, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def best_rows(base: DataFrame, anchors: DataFrame, turn: np.ndarray, same: bool, best: int) -> DataFrame:
    """ranked() over all rows, after a search over the anchors alone, which tells what is asked for at least; written."""
    anchors = written(anchors)
    last = ranked(searched(anchors.select("row", "vec_id", "label", "q"), anchors, turn, same, best), best).filter(F.col("rank") == best)
    known = last.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("known"))  # a few slots
    asked = anchors.join(known, "row", "left").withColumn("need", F.transform("need", lambda x, j: F.greatest(x, F.try_element_at("known", j.cast("int")))))
    return written(ranked(searched(base, asked, turn, same, best), best))


def hard_negatives(base: DataFrame, anchor: object, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of base (row, vec_id, label, q), for the rows with anchor, a condition."""
    width = base.agg(F.max(F.size("q"))).first()[0] or 0
    if width > WIDEST:
        raise ValueError(f"vectors of over {WIDEST} components")
    turn = rotation(base, width)
    least, most = (F.array(F.lit(int(x)).cast("long")) for x in (np.iinfo(np.int64).min, np.iinfo(np.int64).max))
    anchors = base.filter(anchor)
    positive = best_rows(base, anchors.withColumn("need", least).withColumn("high", most), turn, True, positives).withColumn("slot", F.col("rank") - 1)
    # a positive's range, in whole numbers: low * positive <= 100 * negative <= high * positive
    exact = positive.select("anchor", "slot", F.expr(f"-((-score * {low} - pmod(-score * {low}, 100)) div 100)").alias("a"), F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100").alias("z"))
    slots = exact.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("a", "z")))).alias("at"))
    every = F.sequence(F.lit(0), F.lit(positives - 1))
    bound = lambda field, void: F.transform(every, lambda j: F.coalesce(F.try_element_at("at", j)[field], F.lit(int(void)).cast("long")))
    ranges = anchors.join(slots, "row").withColumn("need", bound("a", np.iinfo(np.int64).max)).withColumn("high", bound("z", np.iinfo(np.int64).min))
    negative = best_rows(base, ranges, turn, False, negatives)
    by = positive.select("anchor", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    both = negative.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(by, ["anchor", "slot"]).join(ids, "anchor")
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(rows: DataFrame) -> DataFrame:
    """The negatives of every anchor of embeddings: anchors have a vec_id divisible by 100; where 7 divides it, labels move on by one."""
    base = whole_vectors(rows)
    moved = base.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
    SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same,
           list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
positive AS (
    SELECT * FROM pair WHERE same
    QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       (row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.vec_id, n.br))::INT AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON n.ar = p.ar AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
