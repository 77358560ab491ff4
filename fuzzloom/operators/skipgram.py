"""Skip-gram with negative sampling over walks; vectors are a table by token.

Nothing of the vocabulary's size is held by the driver or broadcast by hand: an epoch joins its
pairs with the vectors of their tokens, and sums the updates by token and component.  All
draws are hashes of (seed, epoch, pair, draw), so any task that runs again draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fuzzloom.operators import split
from fuzzloom.sources.staging import staged

UNIT = float(1 << 32)


def uniform(*parts: object, at: int = 1) -> Column:
    """A whole number below 2^32 from eight hexadecimal digits of the parts' md5, from the given digit on."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), at, 8), 16, 10).cast("long")


def walk_pairs(walks: DataFrame, window: int = 2) -> DataFrame:
    """(pair, u, v): every two places of a walk (walk, start, path) at most so far apart, in both orders; pair names the places."""
    at = walks.select("walk", "start", F.posexplode("path").alias("i", "u"), "path")
    near = F.filter(F.sequence(F.greatest(F.col("i") - window, F.lit(0)), F.least(F.col("i") + window, F.size("path") - 1)), lambda j: j != F.col("i"))
    each = at.select("walk", "start", "i", "u", "path", F.explode(near).alias("j"))
    return each.select(F.concat_ws(":", "start", F.col("walk").cast("string"), F.col("i").cast("string"), F.col("j").cast("string")).alias("pair"), "u", F.get("path", F.col("j")).alias("v"))


def prefix_sums(df: DataFrame, order: str, value: str, pieces: int = 256) -> DataFrame:
    """df with before: the sum of value over all rows of a lesser order; order is unique.

    Rows are dealt by the hash's first digits, which order begins with, and the pieces' sums tell where each begins."""
    x = df.withColumn("_p", F.substring(order, 1, 2))
    base = x.groupBy("_p").agg(F.sum(value).alias("_s")).withColumn("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_p").alias("_q"), "_b")  # 256 rows
    own = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("_o", F.coalesce(F.sum(value).over(own), F.lit(0))).join(F.broadcast(base), F.col("_p") == F.col("_q")).withColumn("before", F.col("_o") + F.col("_b")).drop("_p", "_q", "_o", "_b")


def alias_table(counts: DataFrame, power: float = 0.75, scale: int = 1 << 20) -> DataFrame:
    """(slot, token, own, other): slot's token is drawn with probability own, else other; counts (token, n).

    A token's weight is n^power in units of 1/scale.  With slots of the mean weight, light tokens
    lack something and heavy ones have more.  Laid side by side in order of their hashes, what the
    light lack is taken from the heavy in turn: the two running sums, of what is lacking and
    of what is left over, tell who gives to whom, so the table comes from sums and one merge
    of both sums instead of a loop.  All sums are of whole numbers."""
    w = counts.select("token", F.greatest(F.round(F.pow(F.col("n").cast("double"), F.lit(power)) * scale), F.lit(1)).cast("long").alias("w"))
    total = w.agg(F.count("*").alias("k"), F.sum("w").alias("t")).first()
    k, t = total["k"], total["t"] or 0
    x = staged(w.withColumn("h", F.concat(F.md5(F.col("token").cast("binary")), F.col("token"))).withColumn("d", F.col("w") * k - t))  # over or under a slot
    heavy = staged(prefix_sums(x.filter("d > 0"), "h", "d"))  # before: what heavier ones gave already
    light = staged(prefix_sums(x.filter("d <= 0").withColumn("need", -F.col("d")), "h", "need"))
    # merge: heavy tokens open at their running sum, light ones ask at theirs
    opens = heavy.select(F.col("before").alias("at"), F.lit(0).alias("kind"), "token", F.struct(F.col("before"), F.col("token")).alias("giver"), F.lit(None).cast("long").alias("need"))
    asks = light.filter("need > 0").select(F.col("before").alias("at"), F.lit(1).alias("kind"), "token", F.lit(None).cast("struct<before:long,token:string>").alias("giver"), "need")
    given = last_before(opens.unionByName(asks), "giver").filter("kind = 1")
    lights = light.filter("need = 0").select("token", F.lit(1.0).alias("own"), F.col("token").alias("other")).unionByName(given.select("token", (1 - F.col("need") / F.lit(float(max(t, 1)))).alias("own"), F.col("giver.token").alias("other")))
    # a heavy token ends at the first light one whose need reaches its end; it then lacks what that one took too much, and takes it from the next heavy one
    ends = heavy.select((F.col("before") + F.col("d")).alias("at"), F.lit(1).alias("kind"), "token", F.col("before").alias("own_before"), F.lit(None).cast("struct<at:long>").alias("taken"))
    reach = light.filter("need > 0").select((F.col("before") + F.col("need")).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("long").alias("own_before"), F.struct((F.col("before") + F.col("need")).alias("at")).alias("taken"))
    over = last_before(ends.unionByName(reach), "taken", forward=True).filter("kind = 1").select("token", F.col("at").alias("end"), (F.col("taken.at") - F.col("at")).alias("lack"))
    following = heavy.select(F.col("before").alias("end"), F.col("token").alias("next"))
    heavies = over.join(following, "end", "left").select("token", F.when(F.col("next").isNull(), 1.0).otherwise(1 - F.col("lack") / F.lit(float(max(t, 1)))).alias("own"), F.coalesce("next", "token").alias("other"))
    both = lights.unionByName(heavies)
    return split.numbered(both, [], "token", 0, "slot").select("slot", "token", F.col("own").cast("double").alias("own"), "other")


def last_before(rows: DataFrame, what: str, forward: bool = False, pieces: int = 64) -> DataFrame:
    """rows (at, kind, token, what, ...) with what filled from the last row of kind 0 at or before it, or with forward from the next one at or after it.

    Rows are dealt to ranges of at; a range's last (or first) value is carried over to the others."""
    sign = -1 if forward else 1
    x = rows.withColumn("_a", sign * F.col("at"))
    cuts = x.agg(F.expr("array_sort(array_distinct(approx_percentile(_a, array(" + ", ".join(f"{(i + 1) / pieces!r}D" for i in range(pieces - 1)) + "), 1000)))").alias("_cuts"))
    x = staged(x.crossJoin(F.broadcast(cuts)).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col("_a")))).drop("_cuts"))  # one row of cuts
    order = F.struct("_a", F.col("kind"), F.coalesce("token", F.lit("")))
    whole = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    ends = x.filter("kind = 0").groupBy("_piece").agg(F.max_by(what, order).alias("_e"))
    carried = x.select("_piece").distinct().join(ends, "_piece", "left").withColumn("_c", F.last("_e", True).over(whole)).select(F.col("_piece").alias("_q"), "_c")
    own = Window.partitionBy("_piece").orderBy("_a", "kind", F.coalesce("token", F.lit(""))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = x.withColumn("_f", F.last(what, True).over(own)).join(F.broadcast(carried), F.col("_piece") == F.col("_q"))
    return filled.withColumn(what, F.coalesce("_f", "_c")).drop("_a", "_piece", "_q", "_f", "_c")


def start_vectors(tokens: DataFrame, dim: int, seed: int, spread: float = 0.1) -> DataFrame:
    """(token, v): components between -spread and spread, by hash."""
    draw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (uniform("start", seed, F.col("token"), k) / UNIT * 2 - 1) * spread)
    return tokens.select("token", draw.alias("v"))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def drawn(pairs: DataFrame, table: DataFrame, slots: int, negatives: int, seed: int, epoch: int) -> DataFrame:
    """(u, v, label): the pairs with label 1, and for each its negatives, drawn by the alias table, with label 0."""
    x = pairs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(negatives)))).withColumn("_slot", F.pmod(uniform(seed, epoch, F.col("pair"), F.col("k")), F.lit(max(slots, 1))))
    coin = uniform(seed, epoch, F.col("pair"), F.col("k"), at=9) / UNIT
    other = x.withColumn("coin", coin).join(table.withColumnRenamed("slot", "_slot").withColumnRenamed("token", "_t"), "_slot")
    return pairs.select("u", "v", F.lit(1.0).alias("label")).unionByName(other.select("u", F.when(F.col("coin") < F.col("own"), F.col("_t")).otherwise(F.col("other")).alias("v"), F.lit(0.0).alias("label")))


def epoch_step(vectors: DataFrame, samples: DataFrame, rate: float) -> DataFrame:
    """Vectors after one step along the summed gradients of all samples, at the vectors before it."""
    by = lambda k, v: vectors.select(F.col("token").alias(k), F.col("v").alias(v))
    x = samples.groupBy("u", "v", "label").agg(F.count("*").alias("n")).join(by("u", "zu"), "u").join(by("v", "zv"), "v")
    g = F.col("n") * (1 / (1 + F.exp(-_dot("zu", "zv"))) - F.col("label"))
    steps = x.withColumn("g", g).select(F.explode(F.array(F.struct(F.col("u").alias("token"), F.transform("zv", lambda y: y * F.col("g")).alias("d")), F.struct(F.col("v").alias("token"), F.transform("zu", lambda y: y * F.col("g")).alias("d")))).alias("s")).select("s.*")
    summed = steps.select("token", F.posexplode("d").alias("k", "x")).groupBy("token", "k").agg(F.sum("x").alias("x"))
    whole = summed.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("d"))  # dim entries
    return vectors.join(whole, "token", "left").select("token", F.when(F.col("d").isNull(), F.col("v")).otherwise(F.zip_with("v", "d", lambda a, b: a - rate * b)).alias("v"))


def skip_gram(walks: DataFrame, dim: int = 32, window: int = 2, negatives: int = 5, epochs: int = 5, pairs: int = 2000, rate: float = 0.025, seed: int = 0) -> DataFrame:
    """(token, v) of all tokens of walks (walk, start, path): logistic loss of pairs in a window against drawn tokens.

    An epoch takes at most so many pairs, the first by hashes of the epoch; their updates are summed, not
    made one after the other.  Empty walks give no vector; a walk of one token gives its start vector."""
    counts = staged(walks.select(F.explode("path").alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    table = staged(alias_table(counts))
    slots, every = counts.count(), staged(walk_pairs(walks, window))
    vectors = staged(start_vectors(counts.select("token"), dim, seed))
    for epoch in range(epochs):
        chosen = split.numbered(every, [], "pair", 1000 * seed + epoch).filter(F.col("_no") < pairs).drop("_no")
        vectors = staged(epoch_step(vectors, drawn(chosen, table, slots, negatives, seed, epoch), rate))
    return vectors
