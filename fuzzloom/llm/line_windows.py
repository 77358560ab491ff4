"""Line dedup by overlapping three-line windows.

Lines that hold a word are numbered within their document; every three consecutive ones
form a window, known by 128 bits of hash.  A window that is found more than once in the
corpus stays where it comes first, by doc_id and line; in all later places its lines are
covered, and the merged covered lines are removed.  Texts don't take part until then: only
hashes are shuffled, and equal windows are counted on the map side.  DataFrame functions only.

Documents with fewer than three such lines have no window and stay whole; so do null and
empty texts.  Lines without a word are kept.  A null doc_id comes first.  Rows that share
doc_id and text are the same document and are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzloom.llm.common import WORD, packed, written

WIDTH = 3


def _bound(value: Column, use):
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, tie, at, h1, h2): all windows; at is the number of its first line among those with a word."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))

    def hashed(ls):
        of = lambda i, salt: F.xxhash64(F.lit(salt), *[ls[(i + k).cast("int")] for k in range(width)])
        steps = F.when(F.size(ls) >= width, F.sequence(F.lit(0), F.size(ls) - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: F.struct(i.alias("at"), of(i, 1).alias("h1"), of(i, 2).alias("h2")))

    return docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("tie"), F.inline(_bound(lines, hashed)))


def first_places(all_windows: DataFrame) -> DataFrame:
    """(h1, h2, first, n) of the windows that have several places, counted on the map side."""
    place = F.struct("doc_id", "at", "tie")
    by = all_windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    return by.filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last")


def later_windows(all_windows: DataFrame) -> DataFrame:
    """(doc_id, tie, at) of all places but the first of each window.

    Windows that hold over a 4096th of all repeated places, so fewer than 4096 of them, find
    their first place by a broadcast, and don't meet in one task."""
    first = written(first_places(all_windows))
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * 4096 > total
    few = F.broadcast(first.filter(hot).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("first").alias("often")))
    rare = first.filter(~hot).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("first").alias("seldom"))
    place = F.struct("doc_id", "at", "tie")
    near = all_windows.join(few, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left").filter(F.col("often").isNull() | ~place.eqNullSafe(F.col("often")))
    spread = F.when(F.col("often").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id", "tie", "at"))
    dealt = near.select("doc_id", "tie", "at", spread.alias("h1"), "h2", F.col("often").isNotNull().alias("known"))
    both = dealt.join(rare, ~F.col("known") & (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left")
    return both.filter(F.col("known") | (F.col("seldom").isNotNull() & ~place.eqNullSafe(F.col("seldom")))).select("doc_id", "tie", "at")


def covered_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, tie, covered): the numbers of the lines that repeat an earlier window."""
    later = later_windows(windows(docs, width))
    cover = later.select("doc_id", "tie", F.explode(F.sequence(F.col("at"), F.col("at") + width - 1)).alias("line"))
    return cover.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("line")).alias("covered"))  # a document's own lines at most


def _kept(lines: Column, covered: Column) -> Column:
    """The lines that stay; covered counts only lines with a word."""
    def stay(held):
        worded = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
        gone = _bound(worded, lambda w: F.transform(held, lambda k: w[k.cast("int")]))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: lines[i])

    return _bound(covered, stay)


def removals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(whole, n_lines, n_removed, removed, kept_text): each row's columns as one struct, the line numbers removed, comma-joined, and the text left."""
    found = covered_lines(docs.select("doc_id", "text"), width).select(F.col("doc_id").alias("id"), F.col("tie").alias("of"), "covered")
    rows = packed(docs, "doc_id").withColumn("tie", F.xxhash64("whole.text"))  # the text once
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("of")), "left")
    lines = F.split("whole.text", "\n")
    text = F.when(F.col("covered").isNull(), F.col("whole.text")).otherwise(_bound(lines, lambda ls: F.array_join(_kept(ls, F.col("covered")), "\n")))
    return both.select(
        "whole",
        F.size(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.rlike(WORD))).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("covered").cast("array<string>"), ","), F.lit("")).alias("removed"),
        text.alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: what was removed, and the text that stays."""
    return removals(docs.select("doc_id", "text"), width).select("whole.doc_id", "n_lines", "n_removed", "removed", "kept_text")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, all columns, with repeated windows taken out of text and n_chars made to fit.

    A document that loses all of its lines goes; one that had none stays."""
    out = removals(docs, width).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    old = lambda c: F.col("whole")[c]
    return out.select(*[(F.when(F.col("n_removed") == 0, old(c)).otherwise(new[c]) if c in new else old(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
                  string_split(text, chr(10)) AS every FROM documents),
w AS (SELECT doc_id, unnest(range(1, greatest(len(ls) - 1, 1))) AS i, ls FROM l),
c AS (SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c FROM w),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM c),
g AS (SELECT DISTINCT doc_id, i + o - 1 AS line FROM f, (VALUES (0), (1), (2)) AS v(o) WHERE k > 1),
r AS (SELECT doc_id, list(line ORDER BY line) AS covered FROM g GROUP BY doc_id),
e AS (SELECT doc_id, every, generate_subscripts(every, 1) AS pos FROM l),
n AS (SELECT doc_id, pos, every[pos] AS line, regexp_matches(every[pos], '[^\x20\x09-\x0D]') AS word FROM e),
m AS (SELECT *, sum(word::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS no FROM n),
t AS (SELECT m.doc_id, string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT (m.word AND g.line IS NOT NULL)) AS kept_text
      FROM m LEFT JOIN g ON m.doc_id = g.doc_id AND m.no = g.line GROUP BY m.doc_id)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(covered), 0) AS BIGINT) AS n_removed,
       coalesce(array_to_string(covered, ','), '') AS removed, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(t.kept_text, '') END AS kept_text
FROM l LEFT JOIN r ON l.doc_id = r.doc_id LEFT JOIN t ON l.doc_id = t.doc_id"""
