"""Graphs of rule tokens: edges, label distributions, triples, windows, walks, neighbours, embedding."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.operators.skipgram import start_vectors
from fuzzloom.sources.staging import new_path, staged


def tokens(cs: DataFrame, features: list[str]) -> DataFrame:
    """(cell, y, w, pos, token): attribute and level."""
    return cs.select("cell", "y", "w", F.posexplode(F.array(*[F.concat_ws("-", F.lit(c), c) for c in features])).alias("pos", "token"))


def edge_weights(t: DataFrame) -> DataFrame:
    """(u, v, n): rules that hold both tokens."""
    a, b = t.select("cell", F.col("token").alias("u"), "w"), t.select("cell", F.col("token").alias("v"))
    return a.join(b, "cell").filter("u <> v").groupBy("u", "v").agg(F.sum("w").alias("n"))


def label_distribution(t: DataFrame, smooth: float = 0.05) -> DataFrame:
    """(token, y, b): smoothed shares of labels; every label has an entry."""
    grid = t.groupBy("token").agg(F.sum("w").alias("all")).crossJoin(F.broadcast(t.select("y").distinct()))
    have = t.groupBy("token", "y").agg(F.sum("w").alias("n"))
    k = F.count("*").over(Window.partitionBy("token"))
    return grid.join(have, ["token", "y"], "left").select("token", "y", ((1 - smooth) * F.coalesce("n", F.lit(0)) / F.col("all") + smooth / k).alias("b"))


def triples(t: DataFrame) -> DataFrame:
    """(h, r, t): tokens that occur together (0), and labels that a token implies (1)."""
    together = edge_weights(t).select(F.col("u").alias("h"), F.lit(0).alias("r"), F.col("v").alias("t"))
    return together.unionByName(t.select(F.col("token").alias("h"), F.lit(1).alias("r"), F.concat(F.lit("class-"), F.col("y").cast("string")).alias("t")).distinct())


def window_pairs(t: DataFrame, width: int = 1) -> DataFrame:
    """(u, v, n): tokens at most so far apart in a rule."""
    a, b = t.select("cell", F.col("pos").alias("p"), F.col("token").alias("u"), "w"), t.select("cell", F.col("pos").alias("q"), F.col("token").alias("v"))
    return a.join(b, "cell").filter((F.col("p") != F.col("q")) & (F.abs(F.col("p") - F.col("q")) <= width)).groupBy("u", "v").agg(F.sum("w").alias("n"))


def random_walks(edges: DataFrame, walks: int = 10, length: int = 20, seed: int = 0) -> DataFrame:
    """(walk, start, path): hash-driven steps to a neighbour; a walk stops where there is none.

    The neighbour lists are those of a vocabulary; each step is a join."""
    near = edges.groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("next"))
    x = edges.select("u").distinct().withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks)))).select("walk", F.col("u").alias("start"), F.array("u").alias("path"))
    for k in range(length - 1):
        x = x.withColumn("u", F.element_at("path", -1)).join(near, "u", "left")
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("walk").cast("string"), "start", F.lit(str(k))))
        pick = F.element_at("next", (F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.size("next").cast("long")) + 1).cast("int"))
        x = x.select("walk", "start", F.when(F.col("next").isNull() | (F.size("path") <= k), F.col("path")).otherwise(F.concat("path", F.array(pick))).alias("path"))
    return x


def unit_vectors(column) -> np.ndarray:
    """The vectors of an Arrow list column, at length 1."""
    if column.null_count or len(np.unique(np.asarray(pc.list_value_length(column)))) > 1:
        raise ValueError("vectors of one length are needed")
    m = np.concatenate([np.asarray(x.flatten(), np.float64) for x in column.chunks]).reshape(len(column), -1)
    return m / np.sqrt((m**2).sum(axis=1, keepdims=True) + 1e-12)


def nearest(asked: np.ndarray, mine: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int, many: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in base, score) of the k greatest products of unit vectors, rounded to 9 digits, ties to the lower id; mine are the queries' ids (a base row of that id is left out), and ids ascend.

    Products in single precision bound the k-th best from below, by the greatest of some groups of the base;
    only what they leave within their error of it is weighed in double precision."""
    n, error = len(base), 2 * ((base.shape[1] + 4) * 2.0**-23 + 1e-9)
    width = max(1, n // 512)
    groups = -(-n // width)
    low = np.zeros((groups * width, base.shape[1]), np.float32)
    low[:n] = base
    begin, end = np.searchsorted(ids, mine, "left"), np.searchsorted(ids, mine, "right")
    out: list[tuple] = []
    for at in range(0, len(asked), 128):
        q = asked[at : at + 128]
        s = q.astype(np.float32) @ low.T
        s[:, n:] = -np.inf
        for i in np.flatnonzero(begin[at : at + 128] < end[at : at + 128]).tolist():
            s[i, begin[at + i] : end[at + i]] = -np.inf
        parts = s.reshape(len(q), groups, width)
        most = parts.max(axis=2)
        least = np.partition(most, -k, axis=1)[:, -k, None] - np.float32(error) if groups > k else np.full((len(q), 1), -np.inf, np.float32)
        i, g = np.nonzero((most >= least) & (most > -np.inf))
        rest = parts[i, g]
        r, j = np.nonzero((rest >= least[i]) & (rest > -np.inf))
        i, j = i[r], g[r] * width + j
        for x, y in _slices(i, len(q), many):  # near copies leave many
            d = np.round(np.einsum("ij,ij->i", q[i[x:y]], base[j[x:y]]), 9)
            order = np.lexsort((j[x:y], -d, i[x:y]))
            of = i[x:y][order]
            first = np.searchsorted(of, of)
            order = order[np.arange(len(of)) - first < k]
            out.append((i[x:y][order] + at, j[x:y][order], d[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _slices(i: np.ndarray, n: int, many: int):
    """(from, to) of whole queries' rows, of at most so many rows where a query has not more."""
    ends, x = np.searchsorted(i, np.arange(n), "right").tolist(), 0
    for y, then in zip(ends, [*ends[1:], None], strict=True):
        if y > x and (then is None or then - x > many):
            yield x, y
            x = y


def lowest(base: DataFrame, k: int) -> DataFrame:
    """Of rows (id, v, label) with one vector the 2k of the lowest ids, k of an id at most, so that k have another id than a query's.

    Tasks leave out the others before rows are dealt by vector, so a vector that many rows share is spread."""
    own = lambda by, n: F.row_number().over(Window.partitionBy(*by).orderBy("id", "label")) <= n
    return base.withColumn("_k", own(["v", "id"], k)).filter("_k").withColumn("_k", own(["v"], 2 * k)).filter("_k").drop("_k")


def knn_vote(queries: DataFrame, base: DataFrame, k: int = 5, block: int = 40_000) -> DataFrame:
    """(id, pred, votes): cosine neighbours' vote; queries (id, v) against base (id, v, label).

    Of rows with one vector those of the lowest ids are met, as many as can be among the nearest.  Each
    block of queries meets each block of the base in a task of its own, and the nearest k of
    all blocks are merged; nothing is collected.  Without neighbours pred is null."""
    import pyarrow as pa

    dealt = lambda n, size: max(1, -(-n // size))
    fresh = base.select(F.col("id").alias("_i"), F.col("v").alias("_w"), F.col("label").alias("_l")).select(F.col("_i").alias("id"), F.col("_w").alias("v"), F.col("_l").alias("label"))  # queries and base may be one table
    fresh = staged(lowest(fresh, k))
    n_base, n_queries = dealt(fresh.count(), block), dealt(queries.count(), max(1, block // 2))
    near_type = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("label", pa.int64())]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.groupBy("id", "v").agg(F.count("*").cast("int").alias("n"))  # a query that comes twice is answered twice
    left = left.withColumn("qb", F.pmod(F.xxhash64("id", "v"), F.lit(n_queries)).cast("int")).select("id", F.xxhash64("v").alias("key"), "n", "v", "qb", every(n_base).alias("bb"))
    right = fresh.select("id", "v", "label", F.pmod(F.xxhash64("id"), F.lit(n_base)).cast("int").alias("bb"), every(n_queries).alias("qb"))

    def search(q: pa.Table, b: pa.Table) -> pa.Table:
        counts, found = np.zeros(q.num_rows, np.int64), pa.array([], near_type.value_type)
        if q.num_rows and b.num_rows:
            none = np.iinfo(np.int64).min
            b = b.set_column(0, "id", pc.fill_null(b.column("id"), none)).sort_by("id") if b.column("id").null_count else b.sort_by("id")
            ids, mine = np.asarray(b.column("id")), np.asarray(pc.fill_null(q.column("id"), none + 1))
            i, j, d = nearest(unit_vectors(q.column("v")), mine, unit_vectors(b.column("v")), ids, k)
            hit = pa.array(ids[j], mask=ids[j] == none)
            found = pa.StructArray.from_arrays([pa.array(-d), hit, b.column("label").combine_chunks().take(pa.array(j))], fields=list(near_type.value_type))
            counts = np.bincount(i, minlength=q.num_rows)
        near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), found)
        return pa.table({"id": q.column("id"), "key": q.column("key"), "n": q.column("n"), "near": near})

    hits = left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInArrow(search, "id long, key long, n int, near array<struct<d:double,id:long,label:long>>")
    top = hits.groupBy("id", "key", "n").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("top"))
    # a tie goes to the label seen first, which is nearest
    votes = F.transform("top", lambda x, i: F.struct(F.size(F.filter("top", lambda y: y["label"].eqNullSafe(x["label"]))).cast("long").alias("votes"), (-i).alias("at"), x["label"].alias("pred")))
    best = top.select("id", "n", F.array_max(votes).alias("best"))
    return best.select("id", F.col("best.pred").alias("pred"), F.coalesce("best.votes", F.lit(0)).cast("long").alias("votes"), F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("col")


def positive_share(votes: DataFrame, k: int = 5) -> DataFrame:
    """Votes with score, the share of neighbours of label 1, for two labels and k neighbours each."""
    return votes.withColumn("score", F.when(F.col("pred") == 1, F.col("votes") / k).otherwise(1 - F.col("votes") / k))


def edge_loss_and_gradient(z: np.ndarray, c: np.ndarray, a: np.ndarray, negatives: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted skip-gram loss with exact expectation over negatives, and its gradients."""
    total, x = a.sum(), z @ c.T
    m = a.sum(axis=1)
    noise = negatives * np.outer(m, m) / total
    soft = lambda t: np.logaddexp(0, t)
    sig = 1 / (1 + np.exp(-x))
    g = (noise * sig - a * (1 - sig)) / total
    return float((a * soft(-x) + noise * soft(x)).sum() / total), g @ c, g.T @ z


LOCAL_TOKENS, BLOCK = 2048, 1024


def train_embedding(edges: DataFrame, dim: int = 16, negatives: float = 1.0, decay: float = 1e-3, steps: int = 60, seed: int = 0, local: int = LOCAL_TOKENS) -> DataFrame:
    """(token, v): gradient descent with step halving on all edges; the loss never rises.

    Up to so many tokens are trained in one process; more are a table, whose vectors meet those of all
    others in blocks, to the same result.  Vectors start from hashes of the tokens."""
    edges = staged(edges.select("u", "v", F.col("n").cast("double").alias("n")))
    tokens = staged(edges.select(F.explode(F.array("u", "v")).alias("token")).distinct())
    if tokens.isEmpty():
        raise ValueError("the graph has no edge")
    starts = {k: start_vectors(tokens, dim, 2 * seed + i).withColumnRenamed("v", k) for i, k in enumerate("zc")}
    nodes = staged(starts["z"].join(starts["c"], "token"))
    state = _Local(edges, nodes, negatives) if tokens.count() <= local else _Tables(edges, nodes, negatives)
    best, rate = state.loss(decay), 1.0
    for _ in range(steps):
        square = state.slope(decay)
        for _ in range(40):
            new = state.moved(rate)
            value = new.loss(decay)
            if value <= best - 1e-4 * rate * square:
                state, best, rate = new, value, rate * 1.5
                break
            rate /= 2
    return state.vectors()


class _Local:
    """Vectors of a small vocabulary as arrays."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, negatives: float, held: tuple | None = None):
        self.source, self.negatives, self.grad = (edges, nodes), negatives, None
        if held is None:
            rows = nodes.orderBy("token").collect()  # at most LOCAL_TOKENS
            self.names, at = [r["token"] for r in rows], {r["token"]: i for i, r in enumerate(rows)}
            self.a = np.zeros((len(rows), len(rows)))
            for r in edges.collect():
                self.a[at[r["u"]], at[r["v"]]] += r["n"]
            held = np.array([r["z"] for r in rows]), np.array([r["c"] for r in rows])
        self.z, self.c = held

    def loss(self, decay: float) -> float:
        value = edge_loss_and_gradient(self.z, self.c, self.a, self.negatives)[0]
        return value + decay / 2 * float((self.z**2).sum() + (self.c**2).sum())

    def slope(self, decay: float) -> float:
        _, gz, gc = edge_loss_and_gradient(self.z, self.c, self.a, self.negatives)
        self.grad = gz + decay * self.z, gc + decay * self.c
        return float((self.grad[0] ** 2).sum() + (self.grad[1] ** 2).sum())

    def moved(self, rate: float) -> _Local:
        new = object.__new__(_Local)
        new.names, new.a = self.names, self.a
        _Local.__init__(new, *self.source, self.negatives, (self.z - rate * self.grad[0], self.c - rate * self.grad[1]))
        return new

    def vectors(self) -> DataFrame:
        return self.source[1].sparkSession.createDataFrame([(t, self.z[i].tolist()) for i, t in enumerate(self.names)], "token string, v array<double>")


class _Tables:
    """Vectors as a table by token (token, z, c, m), m the token's edges; the loss and its gradient are jobs."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, negatives: float, total: float | None = None):
        self.edges, self.negatives, spark = edges, negatives, nodes.sparkSession
        if total is None:
            degree = edges.groupBy(F.col("u").alias("token")).agg(F.sum("n").alias("m"))
            nodes = nodes.join(degree, "token", "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
            total = edges.agg(F.sum("n")).first()[0]
        self.total, self.path = total, new_path(spark)
        self.nodes, self.grad = staged(nodes, self.path), None

    def _met(self, own: str, other: str, gradient: bool) -> DataFrame:
        """(token, d, loss): each token's sums over all tokens of the expected negatives; a task streams the table by its own rows."""
        path, scale = self.path, self.negatives / self.total**2

        def run(batches):
            import pyarrow as pa

            from fuzzloom.sources.staging import stored_batches

            side = lambda part, i: np.array(part.column(i).to_pylist(), float).reshape(part.num_rows, -1)
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    part = whole.slice(at, BLOCK)
                    x, m = side(part, 1), side(part, 2)
                    d, loss = np.zeros_like(x), np.zeros(len(x))
                    for block in stored_batches(path, [other, "m"], BLOCK):
                        y, k = side(block, 0), side(block, 1)
                        dot, noise = x @ y.T, scale * m * k.T
                        loss += (noise * np.logaddexp(0, dot)).sum(axis=1)
                        if gradient:
                            d += (noise / (1 + np.exp(-dot))) @ y
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(d)), pa.array(loss)], names=["token", "d", "loss"])

        return self.nodes.select("token", own, "m").mapInArrow(run, "token string, d array<double>, loss double")

    def _joined(self) -> DataFrame:
        of = lambda key, v, name: self.nodes.select(F.col("token").alias(key), F.col(v).alias(name))
        x = self.edges.join(of("u", "z", "zu"), "u").join(of("v", "c", "cv"), "v")
        return x.withColumn("x", F.aggregate(F.zip_with("zu", "cv", lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y))

    def loss(self, decay: float) -> float:
        square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)
        sizes = self.nodes.agg(F.sum(square("z") + square("c"))).first()[0]
        edge = self._joined().agg(F.sum(F.col("n") * (F.greatest(-F.col("x"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("x")))))).first()[0] / self.total
        return edge + self._met("z", "c", False).agg(F.sum("loss")).first()[0] + decay / 2 * sizes

    def slope(self, decay: float) -> float:
        x = self._joined().withColumn("g", -F.col("n") / (1 + F.exp("x")) / self.total)
        pull = x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(t).alias("token"), F.transform(v, lambda y: y * F.col("g")).alias("d")) for k, t, v in (("z", "u", "cv"), ("c", "v", "zu"))])).alias("s")).select("s.*")
        for k, other in (("z", "c"), ("c", "z")):
            pull = pull.unionByName(self._met(k, other, True).select(F.lit(k).alias("k"), "token", "d"))
            pull = pull.unionByName(self.nodes.select(F.lit(k).alias("k"), "token", F.transform(k, lambda y: y * decay).alias("d")))
        summed = pull.select("k", "token", F.posexplode("d").alias("i", "y")).groupBy("k", "token", "i").agg(F.sum("y").alias("y"))
        whole = summed.groupBy("token", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("d"))  # dim entries
        self.grad = staged(whole.groupBy("token").pivot("k", ["z", "c"]).agg(F.first("d")).withColumnsRenamed({"z": "gz", "c": "gc"}))
        return self.grad.select(F.explode(F.concat("gz", "gc")).alias("y")).agg(F.sum(F.col("y") * F.col("y"))).first()[0]

    def moved(self, rate: float) -> _Tables:
        step = lambda v, g: F.zip_with(v, g, lambda a, b: a - rate * b).alias(v)
        return _Tables(self.edges, self.nodes.join(self.grad, "token").select("token", step("z", "gz"), step("c", "gc"), "m"), self.negatives, self.total)

    def vectors(self) -> DataFrame:
        return self.nodes.select("token", F.col("z").alias("v"))
