"""N-gram Jaccard join by a MinHash LSH forest.

Each document's signature is cut into trees of labels.  A tree is the trie of its label
sequences, held as a table sorted by them: an inner node is a run of rows with a common prefix.
Nodes at full length are looked at first.  Then prefixes are shortened label by label, but
only for nodes that hold an item whose estimated recall is still below the target, and only
where branches meet, as others were looked at before.  An item's recall at a depth is
estimated from its partners in the tree so far: each stands for 1 / P(found at that depth, by
all trees, at its similarity) partners; an item without partners goes on up to the depth that
the target asks for right at the threshold, which is the shortest.  Candidates are then
verified exactly on their word shingles (see ``near``).

One row per document: its class, named by the least doc_id in it, and the number of
links of its text, that is of other shingle sets at or above the threshold.  Documents with
equal shingle sets are copies and share an item.  Texts shorter than a shingle are one
shingle; null, empty and white texts have none, are copies of each other and link with
nothing.  A null doc_id takes part; a class with only null ids has a null class_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzloom.llm.common import by_slice, packed, shingles, written
from fuzzloom.llm.near import Signer, links, neighbours, searched

TREES, LONGEST, THRESHOLD, WIDTH, RECALL = 24, 8, 0.8, 5, 0.9999


def prefix_length(trees: int, longest: int, threshold: float, recall: float) -> int:
    """The longest prefix at which so many trees find a pair at the threshold with at least that probability."""
    for d in range(longest, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError("no prefix is short enough for the recall; take more trees")


def signatures(docs: DataFrame, trees: int = TREES, longest: int = LONGEST, width: int = WIDTH) -> DataFrame:
    """(doc_id, tie, item, sketch) of every document; sketch holds the labels of all trees, 16 bits each."""

    def make():
        sign = Signer(trees, longest)

        def f(part):
            got = [sign(shingles(x, width)) for x in part.column(2).to_pylist()]
            return {"doc_id": part.column(0), "tie": part.column(1), "item": [x[0] for x in got], "sketch": [x[1] for x in got]}

        return f

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return by_slice(rows, make, "doc_id long, tie long, item binary, sketch binary", 256)


def forest_pairs(signed: DataFrame, trees: int = TREES, longest: int = LONGEST, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Edges and buckets of all items that may share links (see ``near``), from (item, sketch), once per item."""
    shortest, size = prefix_length(trees, longest, threshold, recall), 2 * longest
    tree = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda k: F.concat(F.unhex(F.lpad(F.hex(k), 2, "0")), F.substring("sketch", k * size + 1, F.lit(size))))
    paths = signed.filter(F.length("sketch") > 0).select(F.explode(tree).alias("path"), "item")
    depths = list(range(longest, shortest - 1, -1))

    def chance(nears: np.ndarray) -> np.ndarray:
        return np.stack([1 - (1 - nears**d) ** trees for d in depths])

    tries = neighbours(paths, 1 + size, 1 + 2 * shortest)
    return searched(tries, signed.select("item", "sketch"), [1 + 2 * d for d in depths], threshold, np.uint16, chance, recall)


def near_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """(doc_id, class_id, n_links, copy_id, tie) of every document; copy_id is the least doc_id with the same shingles."""
    signed = written(signatures(docs, width=width))
    items = written(signed.groupBy("item").agg(F.min(F.struct("doc_id", "tie")).alias("rep"), F.min("doc_id").alias("copy_id"), F.first("sketch").alias("sketch")))

    def content(members: DataFrame) -> DataFrame:
        at = members.join(items.select("item", F.col("rep.doc_id").alias("_id"), F.col("rep.tie").alias("_tie")), "item")
        texts = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_own"), "text")
        return at.join(texts, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_tie") == F.col("_own")))

    found = links(*forest_pairs(items.select("item", "sketch"), threshold=threshold, recall=recall), content, threshold, width)
    named = items.select("item", "copy_id", F.col("item").alias("root"), F.lit(0).cast("long").alias("n_links"))
    if found is not None:
        named = items.select("item", "copy_id").join(found, "item", "left").select("item", "copy_id", F.coalesce("root", "item").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    named = written(named)
    least = written(named.groupBy("root").agg(F.min("copy_id").alias("class_id")))
    return signed.select("doc_id", "tie", "item").join(written(named.join(least, "root")), "item").select("doc_id", "class_id", "n_links", "copy_id", "tie", "root")


def link_documents(docs: DataFrame) -> DataFrame:
    return near_documents(docs.select("doc_id", "text")).drop("tie", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, of which each class keeps the one with the least doc_id.

    Rows that share this doc_id and text stay together once."""
    kept = near_documents(docs.select("doc_id", "text")).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "tie")).alias("m")).select(F.col("m.doc_id").alias("least"), F.col("m.tie").alias("tie"))
    rows = packed(docs, "doc_id").withColumn("own", F.xxhash64("whole.text"))
    both = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("own") == F.col("tie")), "left_semi")
    return both.dropDuplicates(["doc_id", "own"]).select("whole.*")
