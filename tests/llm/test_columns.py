"""Extra columns of any name pass through the stages unchanged."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fuzzloom.llm import common, cube_mix, hash_ring, line_windows, rule_ledger, shingle_forest

OWN = {"doc_id", "text", "lang", "source", "n_chars"}
ODD = ["my col", "a.b", "x`y", "é", "select"]


def inner_names():
    """Every name that the modules give a column anywhere."""
    out = set()
    for path in Path(common.__file__).parent.glob("*.py"):
        code = path.read_text()
        for found in re.findall(r'alias\("(\w+)"\)|withColumn\("(\w+)"|withColumnRenamed\("\w+", "(\w+)"|"(_\w+|whole|tie|own)"', code):
            out |= {x for x in found if x}
    return sorted({x.lower(): x for x in out if x.lower() not in OWN}.values())


@pytest.fixture(scope="module")
def clashing(spark):
    text = lambda k: "\n".join(" ".join(f"word{(7 * k + i * j) % 211}" for j in range(1, 9)) for i in range(1, 12))
    rows = [(k, text(k), "en", f"s{k % 2}", len(text(k))) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = [*inner_names(), *ODD]
    assert len(extra) > 60
    return df.select("*", *[F.concat(F.lit(f"{i} "), F.col("doc_id").cast("string")).alias(c) for i, c in enumerate(extra)]), extra


@pytest.mark.parametrize("stage", [rule_ledger.keep_passing, line_windows.without_repeats, shingle_forest.one_of_each, cube_mix.mixed_rows])
def test_stages_keep_columns(clashing, stage):
    df, extra = clashing
    out = stage(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows
    for r in rows:
        assert list(r)[5:] == [f"{i} {r['doc_id']}" for i in range(len(extra))]


def test_ring_keeps_columns(clashing):
    df, extra = clashing
    out = hash_ring.assign(df.drop("shard", "slot"), "doc_id", 3, ties=("n_chars",))
    assert out.columns == [*df.drop("shard", "slot").columns, "shard", "slot"] and out.count() == 12
    with pytest.raises(ValueError):
        hash_ring.assign(df, "doc_id", 3)


def test_ledger_names_its_clashes(clashing):
    with pytest.raises(ValueError):
        rule_ledger.evaluate(clashing[0].withColumn("n_words", F.lit(1)), ["n_words"])


def test_shared_folder(spark):
    assert common.shared_dir(spark)
