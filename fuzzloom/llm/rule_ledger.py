"""Quality rules as a bitmask ledger.

``evaluate`` reads each text once and stores its measurements and one long of failure
bits, a bit for each rule.  Policies are versioned sets of rules, applied afterwards by a
bitwise AND (``apply_policy``); ``ablation`` tells for each rule of a policy how many
documents fail it and how many fail nothing else, from counts by bit pattern, without
reading a text again.

Null texts count as empty.  Equal rows get equal verdicts.  Ties at a threshold pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fuzzloom.llm.common import by_slice, packed, quoted

SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


@dataclass(frozen=True)
class Rule:
    """A rule that a document fails where the SQL condition on its measurements holds."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeats_itself", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule(4, "shouting", "5 * n_upper > 2 * n_letters"),
    Rule(5, "word_length", "word_chars < 2.5 * n_words OR word_chars > 14 * n_words"),
    Rule(6, "few_letters", "2 * n_letters < word_chars"),
)
#: Versions stay as they were; a new policy gets a new name.
POLICIES = {
    "base": ("too_short", "repeats_itself"),
    "v1": ("too_short", "repeats_itself", "symbols", "repeated_lines"),
    "v2": ("too_short", "repeats_itself", "symbols", "repeated_lines", "shouting", "word_length"),
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


def policy_mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in POLICIES[policy])


def _repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    u = len(seen)
    pair = ids[:-1] * u + ids[1:]
    if u > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * u + ids[2:]
    _, where, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    space = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    return (
        len(words),
        len(text) - space,
        sum(text.count(c) for c in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _LETTERS)),
    )


def evaluate(df: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept columns, each measurement and failed_bits (long).  A kept column may not have the name of one of these."""
    if clash := {*keep} & {*MEASURES, "failed_bits"}:
        raise ValueError(f"kept columns have names of the ledger: {sorted(clash)}")
    source = df.select(F.struct(*[F.col(quoted(k)) for k in keep]).alias("whole"), F.col(quoted(text)).alias("text"))

    def make():
        def f(batch):
            found = list(zip(*map(measure, batch.column(1).to_pylist()), strict=True)) or [()] * len(MEASURES)
            return {"whole": batch.column(0), **dict(zip(MEASURES, found, strict=True))}

        return f

    schema = StructType([source.schema["whole"], *[StructField(m, LongType()) for m in MEASURES]])
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in rules), F.lit(0).cast("long"))
    return by_slice(source, make, schema, 1024).withColumn("failed_bits", bits).select(*[F.col("whole")[k].alias(k) for k in keep], *MEASURES, "failed_bits")


def passes(policy: str = CURRENT, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def apply_policy(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    return ledger.withColumns({"base_failed": ~passes("base"), "kept": passes("base") & passes(policy), "policy": F.lit(policy)})


def ablation(ledger: DataFrame, policy: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: (rule, n_fail, n_only, kept_without).

    The ledger is first counted by its bit pattern, of which there are at most 2^rules."""
    mask = policy_mask(policy, rules)
    patterns = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if mask >> r.bit & 1])
    each = patterns.select("bits", "n", F.explode(named).alias("r")).select("bits", "n", "r.*")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(
        of(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        of(F.col("bits") == F.col("bit")).alias("n_only"),
        of(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )


def verdicts(df: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per document: measurements, bits and the verdict of the policy."""
    out = apply_policy(evaluate(df, ["doc_id"]), policy)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "n_letters", "failed_bits")


def keep_passing(df: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows, all columns, whose text passes the policy."""
    rows = evaluate(packed(df, "text"), ["whole"])
    return rows.filter(passes("base") & passes(policy)).select("whole.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS k FROM g),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM c, (VALUES (0), (1), (2)) AS v(o) WHERE k > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
             CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
             + 8 * (10 * n_dup_lines > 4 * n_lines)::INT + 16 * (5 * n_upper > 2 * n_letters)::INT
             + 32 * (word_chars < 2.5 * n_words OR word_chars > 14 * n_words)::INT + 64 * (2 * n_letters < word_chars)::INT AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       (failed_bits & 63) = 0 AS kept, n_lines, n_upper, n_letters, failed_bits FROM b"""
