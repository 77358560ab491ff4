"""Secret scans: patterns for known forms, and character Markov models for the others.

Two first-order Markov models of characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples.  A token is a secret where the log-likelihood
ratio of the two is high, both in all and for each transition.  The trained table has the
alphabet's size squared and becomes a literal of the scanning expression, which runs over
whole texts.  DataFrame functions only.

Positions count code points and ends are exclusive.  Null and empty texts have no spans.
A found token that lies within a span of a pattern is not told again; one that reaches beyond it is.
Spans of a kind never overlap, so there are no ties; rows are scanned on their own, and rows that
repeat a doc_id or a text get their spans each.

The models are fitted on a bounded sample: random strings, the keys that the plain forms find in the sample's
documents, and the words of these documents.  The bounds are RANDOM_ROWS strings and DOCUMENT_ROWS
distinct documents, those of the least hashes of doc_id and text, however often rows repeat.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_K = len(ALPHABET) + 1  # 0: any other character
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: As the plain forms, of which shorter matches are dropped: the rest of a run that is too short holds no other match.
SHORTEST = 8  # below this no ratio can reach LEAST_ALL
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
#: Log-likelihood ratio, natural logarithm: of the whole token, and mean of its transitions.
LEAST_ALL, LEAST_MEAN = 14.0, 0.55
#: Rows that the models are fitted on, at most: random strings, and documents whose words are the identifiers.
RANDOM_ROWS, DOCUMENT_ROWS = 2000, 2000


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def labelled_samples(docs: DataFrame, random_rows: int = RANDOM_ROWS, document_rows: int = DOCUMENT_ROWS) -> DataFrame:
    """(word, random boolean): random strings of the usual alphabets and keys of known forms; words of some documents, alone and joined as identifiers, and decimal numbers.

    The documents are those with the smallest hashes of their ids and texts, so reruns agree."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    raw = F.base64(F.unhex(digest))
    upper = F.translate(raw, "abcdefghijklmnopqrstuvwxyz+/=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ012")
    noise = docs.sparkSession.range(random_rows).select(F.explode(F.array(digest, raw, F.translate(raw, "+/=", "ab"), upper)).alias("word"), F.lit(True).alias("random"))
    key = F.struct(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    held = docs.filter(F.col("text").isNotNull()).select(key.alias("k"), "text")
    edge = held.select("k").distinct().orderBy("k").limit(document_rows).agg(F.max("k").alias("k")).first()["k"]
    low = F.struct(*[F.lit(edge[c] if edge else None).cast("long").alias(c) for c in ("h", "t")])
    some = held.filter(F.col("k") <= low).dropDuplicates(["k"]) if edge else held.limit(0)
    words = F.filter(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{3,}(?![A-Za-z0-9])"), F.lit(0)), lambda w: F.length(w) < 24)
    pairs = lambda f: F.transform(words, lambda w: f(F.lower(w)))
    joined = F.flatten(F.array(words, pairs(lambda w: F.concat(w, F.lit("_id"))), pairs(lambda w: F.concat(F.lit("get"), F.initcap(w), F.lit("_"), w)), pairs(lambda w: F.concat(w, F.lit("-"), w, F.lit("/"), w))))
    plain = some.select(F.explode(joined).alias("word"), F.lit(False).alias("random"))
    known = some.select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))).alias("word"), F.lit(True).alias("random"))
    numbers = docs.sparkSession.range(random_rows).select(F.concat(F.abs(F.xxhash64("id")).cast("string"), F.lit("-"), F.lpad(F.pmod("id", F.lit(9999)).cast("string"), 6, "0")).alias("word"), F.lit(False).alias("random"))
    return noise.unionByName(known).unionByName(plain).unionByName(numbers)


def transition_counts(samples: DataFrame) -> DataFrame:
    """(random, pair, n): at most twice the alphabet's square rows."""
    steps = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    return samples.filter(F.length("word") > 1).select("random", F.explode(steps).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))


def fit(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each transition, random against ordinary, at from * K + to."""
    at = {c: i + 1 for i, c in enumerate(ALPHABET)}
    counts = {r: [[smoothing] * _K for _ in range(_K)] for r in (True, False)}
    for r in transition_counts(samples).collect():
        counts[r["random"]][at.get(r["pair"][0], 0)][at.get(r["pair"][1], 0)] += r["n"]
    log = lambda row: [math.log(x / sum(row)) for x in row]
    return [round(a - b, 4) for x, y in zip(counts[True], counts[False], strict=True) for a, b in zip(log(x), log(y), strict=True)]


def ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a token."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.position(F.substring(token, i, F.lit(1)), F.lit(ALPHABET)))
    score = lambda c: F.aggregate(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: table[a * _K + b]), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.length(token) > 1, _bound(codes, score)).otherwise(0.0)


def is_random(token: Column, model: list[float]) -> Column:
    return _bound(ratio(token, model), lambda r: (r >= LEAST_ALL) & (r >= LEAST_MEAN * (F.length(token) - 1)))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, kind, stop, word>> of all leftmost matches, in order.

    The text between matches gives their places.  Sums run by chunks, so long texts stay cheap."""
    chunk = 64
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def placed(x):
        found = x["found"]

        def starts(s):
            steps, sums = s["steps"], s["sums"]
            at = lambda i: total(F.slice(sums, F.lit(1), F.floor(i / chunk).cast("int"))) + total(F.slice(steps, (F.floor(i / chunk) * chunk + 1).cast("int"), F.pmod(i, F.lit(chunk))))
            return F.transform(found, lambda w, i: _bound(at(i) + F.length(x["between"][i]), lambda a: F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + F.length(w)).alias("stop"), w.alias("word"))))

        def summed(steps):
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / chunk).cast("int")), lambda c: total(F.slice(steps, c * chunk + 1, F.lit(chunk))))
            return _bound(F.struct(steps.alias("steps"), sums.alias("sums")), starts)

        return _bound(F.zip_with(F.slice(x["between"], F.lit(1), F.size(found)), found, lambda a, b: F.length(a) + F.length(b)), summed)

    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    none = F.array().cast("array<struct<start:int,kind:string,stop:int,word:string>>")
    return F.when(text.rlike(pattern), _bound(parts, placed)).otherwise(none)


KINDS = ("assign", "access", "hex", "markov")


def scan(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """The rows with assign, access, hex and markov: arrays of spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    long_enough = lambda s: F.length(F.regexp_extract(s["word"], ASSIGN, 2)) >= 6
    base = docs.withColumns({"assign": F.filter(matches(t, ASSIGN, "assign"), long_enough), "access": matches(t, ACCESS, "access"), "hex": matches(t, HEX, "hex")})
    suspects = F.exists(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), lambda w: is_random(w, model))
    held = F.concat("assign", "access", "hex")
    free = lambda hs: F.filter(F.filter(matches(t, TOKEN, "markov"), lambda s: is_random(s["word"], model)), lambda s: ~F.exists(hs, lambda h: (h["start"] <= s["start"]) & (s["stop"] <= h["stop"])))
    none = F.array().cast("array<struct<start:int,kind:string,stop:int,word:string>>")
    return base.withColumn("markov", F.when(suspects, _bound(held, free)).otherwise(none))


def told(spans: Column) -> Column:
    """kind:start:end by start, then by kind as listed, comma-joined."""
    rank = lambda s: reduce(lambda e, k: e.when(s["kind"] == k[1], k[0]), enumerate(KINDS[1:], 1), F.when(s["kind"] == KINDS[0], 0))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def trained(docs: DataFrame) -> list[float]:
    return fit(labelled_samples(docs.select("doc_id", "text")))


def secret_spans(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """One row per document: counts of the patterns' spans, their digest, and all spans."""
    rows = scan(docs.select("doc_id", "text"), model or trained(docs)).drop("text")
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(told(F.concat("assign", "access", "hex")), 256).alias("base_sha256"),
        told(F.concat(*KINDS)).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )

