"""Embeddings of triples, plausibility, and rule vectors for nearest neighbours."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzloom.operators import split
from fuzzloom.sources.staging import staged

LOCAL = 100_000  # triples that are trained in one process; more are trained as tables, to the same vectors
MODELS = ("translation", "product")


def _digits(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def _start(kind: str, name: str, dim: int, seed: int) -> list[float]:
    return [(_digits(f"{kind}:{seed}:{name}:{k}") / 2**32 * 2 - 1) * 0.1 for k in range(dim)]


def train_triples(triples: DataFrame, model: str = "translation", dim: int = 32, epochs: int = 30, rate: float = 0.02, margin: float = 1.0, batch: int = 256, seed: int = 0, local: int = LOCAL) -> DataFrame:
    """(kind, name, v) for tokens and relations: "translation" by margin ranking, "product" by a logistic ranking.

    Every epoch sees all triples, in batches by the order of their hashes, against heads (translation) or tails
    (product) drawn by hash; a batch's updates are summed.  Take larger batches for more triples."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    triples = staged(triples.select("h", "r", "t").distinct())
    n = triples.count()
    if not n:
        raise ValueError("there is no triple")
    return (_train_local if n <= local else _train_tables)(triples, model, dim, epochs, rate, margin, batch, seed)


def _train_local(triples: DataFrame, model: str, dim: int, epochs: int, rate: float, margin: float, batch: int, seed: int) -> DataFrame:
    rows = triples.collect()  # at most LOCAL
    key = [f"{row['h']}:{row['r']}:{row['t']}" for row in rows]
    names = sorted({x for row in rows for x in (row["h"], row["t"])}, key=lambda x: (hashlib.md5(f"0:{x}".encode()).hexdigest(), x))
    kinds = sorted({row["r"] for row in rows})
    at, kind_at = {n: i for i, n in enumerate(names)}, {k: i for i, k in enumerate(kinds)}
    data = np.array([(at[row["h"]], kind_at[row["r"]], at[row["t"]]) for row in rows])
    e, rel = np.array([_start("token", x, dim, seed) for x in names]), np.array([_start("relation", str(x), dim, seed) for x in kinds])
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for epoch in range(epochs):
        order = sorted(range(len(rows)), key=lambda i: (hashlib.md5(f"{1000 * seed + epoch}:{key[i]}".encode()).hexdigest(), key[i]))  # noqa: B023
        drawn = np.array([_digits(f"draw:{seed}:{epoch}:{k}") % len(names) for k in key])
        for k in range(0, len(order), batch):
            (h, r, t), other = data[order[k : k + batch]].T, drawn[order[k : k + batch]]
            ge, gr = np.zeros_like(e), np.zeros_like(rel)
            if model == "translation":
                good, bad = e[h] + rel[r] - e[t], e[other] + rel[r] - e[t]
                dg, db = np.linalg.norm(good, axis=1) + 1e-9, np.linalg.norm(bad, axis=1) + 1e-9
                on = (margin + dg - db > 0)[:, None]
                ug, ub = on * good / dg[:, None], on * bad / db[:, None]
                for where, step in ((h, ug), (t, ub - ug), (other, -ub)):
                    np.add.at(ge, where, step)
                np.add.at(gr, r, ug - ub)
            else:
                a = (sigmoid((e[h] * rel[r] * e[t]).sum(axis=1)) - 1)[:, None]
                b = sigmoid((e[h] * rel[r] * e[other]).sum(axis=1))[:, None]
                for where, step in ((h, rel[r] * (a * e[t] + b * e[other])), (t, a * rel[r] * e[h]), (other, b * rel[r] * e[h])):
                    np.add.at(ge, where, step)
                np.add.at(gr, r, e[h] * (a * e[t] + b * e[other]))
            e, rel = e - rate * ge, rel - rate * gr
    out = [("token", n, e[i].tolist()) for n, i in at.items()] + [("relation", str(k), rel[i].tolist()) for k, i in kind_at.items()]
    return triples.sparkSession.createDataFrame(out, "kind string, name string, v array<double>")


def _each(f, *columns) -> Column:
    """f over the components of vectors side by side."""
    return F.transform(F.arrays_zip(*[F.col(c).alias(c) for c in columns]), lambda x: f(*[x[c] for c in columns]))


def _train_tables(triples: DataFrame, model: str, dim: int, epochs: int, rate: float, margin: float, batch: int, seed: int) -> DataFrame:
    """Vectors are a table by kind and name; a batch joins those of its triples, and the summed updates are joined to the table."""
    digits = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")
    keyed = staged(triples.withColumn("key", F.concat_ws(":", "h", F.col("r").cast("string"), "t")))
    names = keyed.select(F.explode(F.array("h", "t")).alias("name")).distinct()
    numbered = staged(split.numbered(names, [], "name", 0, "no"))
    many = numbered.count()
    both = names.select(F.lit("token").alias("kind"), "name").unionByName(keyed.select(F.lit("relation").alias("kind"), F.col("r").cast("string").alias("name")).distinct())
    component = lambda k: (digits(F.col("kind"), F.lit(str(seed)), F.col("name"), k.cast("string")) / float(1 << 32) * 2 - 1) * 0.1
    vectors = staged(both.select("kind", "name", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component).alias("v")))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    for epoch in range(epochs):
        dealt = split.numbered(keyed, [], "key", 1000 * seed + epoch, "no").withColumn("b", F.floor(F.col("no") / batch)).drop("no")
        drawn = dealt.withColumn("no", F.pmod(digits(F.lit("draw"), F.lit(str(seed)), F.lit(str(epoch)), F.col("key")), F.lit(many)))
        asked = staged(drawn.join(numbered.withColumnRenamed("name", "o"), "no"))
        for b in range(-(-keyed.count() // batch)):
            of = lambda kind, key, v: vectors.filter(F.col("kind") == kind).select(F.col("name").alias(key), F.col("v").alias(v))  # noqa: B023, E731
            x = asked.filter(F.col("b") == b).withColumn("k", F.col("r").cast("string"))
            for kind, key, v in (("token", "h", "vh"), ("token", "t", "vt"), ("token", "o", "vo"), ("relation", "k", "vr")):
                x = x.join(of(kind, key, v), key)
            if model == "translation":
                x = x.withColumns({"good": _each(lambda h, r, t: h + r - t, "vh", "vr", "vt"), "bad": _each(lambda o, r, t: o + r - t, "vo", "vr", "vt")})
                x = x.withColumns({n: F.sqrt(total(F.transform(v, lambda y: y * y))) + 1e-9 for n, v in (("dg", "good"), ("db", "bad"))}).filter(margin + F.col("dg") - F.col("db") > 0)
                x = x.withColumns({"ug": F.transform("good", lambda y: y / F.col("dg")), "ub": F.transform("bad", lambda y: y / F.col("db"))})
                minus = lambda a, c: F.zip_with(a, c, lambda p, q: p - q)
                steps = (("token", "h", F.col("ug")), ("token", "t", minus("ub", "ug")), ("token", "o", F.transform("ub", lambda y: -y)), ("relation", "k", minus("ug", "ub")))
            else:
                soft = lambda *v: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total(_each(lambda p, q, r: p * q * r, *v))))))
                x = x.withColumns({"pa": soft("vh", "vr", "vt") - 1, "pb": soft("vh", "vr", "vo")})
                mix = lambda p, t, o: p * (F.col("pa") * t + F.col("pb") * o)
                steps = (("token", "h", _each(mix, "vr", "vt", "vo")), ("token", "t", _each(lambda r, h: F.col("pa") * r * h, "vr", "vh")), ("token", "o", _each(lambda r, h: F.col("pb") * r * h, "vr", "vh")), ("relation", "k", _each(mix, "vh", "vt", "vo")))
            moves = x.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(key).alias("name"), d.alias("d")) for kind, key, d in steps])).alias("s")).select("s.*")
            summed = moves.select("kind", "name", F.posexplode("d").alias("k", "y")).groupBy("kind", "name", "k").agg(F.sum("y").alias("y"))
            whole = summed.groupBy("kind", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "y"))), lambda s: s["y"]).alias("d"))  # dim entries
            vectors = staged(vectors.join(whole, ["kind", "name"], "left").select("kind", "name", F.when(F.col("d").isNull(), F.col("v")).otherwise(F.zip_with("v", "d", lambda p, q: p - rate * q)).alias("v")))
    return vectors


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def plausibility(triples: DataFrame, vectors: DataFrame, model: str = "translation") -> DataFrame:
    """(h, r, t, score): minus the distance, or the triple product; triples of unknown names drop out."""
    vectors = staged(vectors)  # of known size, so Spark broadcasts it only where it is small
    of = lambda kind, key, v: vectors.filter(F.col("kind") == kind).select(F.col("name").alias(key), F.col("v").alias(v))
    x = triples.withColumn("_r", F.col("r").cast("string")).join(of("token", "h", "_vh"), "h").join(of("token", "t", "_vt"), "t").join(of("relation", "_r", "_vr"), "_r")
    if model == "translation":
        gap = F.zip_with(F.zip_with("_vh", "_vr", lambda a, b: a + b), "_vt", lambda a, b: (a - b) * (a - b))
        score = -F.sqrt(_sum(gap))
    else:
        score = _sum(F.zip_with(F.zip_with("_vh", "_vr", lambda a, b: a * b), "_vt", lambda a, b: a * b))
    return x.select("h", "r", "t", score.alias("score"))


def mean_vectors(memberships: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, v): means of known tokens' vectors by degree (id, token, mu), scaled to length 1; ids with none drop out."""
    known = memberships.filter("mu > 0").join(staged(vectors.select(F.col("name").alias("token"), "v")), "token")
    per = known.select("id", "mu", F.posexplode("v").alias("k", "x")).groupBy("id", "k").agg((F.sum(F.col("mu") * F.col("x")) / F.sum("mu")).alias("x"))
    v = per.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    length = F.sqrt(_sum(F.transform("v", lambda x: x * x)))
    return v.select("id", F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.col("v")).alias("v"))
