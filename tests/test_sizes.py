"""Cases that only larger tables would meet, made small."""

from fuzzloom.operators import infer, matrices
from fuzzloom.plans import analyses
from fuzzloom.sources.staging import staged
from fuzzloom.streaming.score import pair_stream

FS = ["f0", "f1"]


def weighted(spark, n):
    return spark.createDataFrame([("a", "b", 0, n, 1), ("a", "c", 1, n, 2)], "f0 string, f1 string, y int, w long, cell long")


def test_pair_weights_beyond_64_bits(spark):
    n = 3_000_000
    table = matrices.narrowed(matrices.pair_table(weighted(spark, n), FS)).cache()
    got = {(r["attr"], r["level"], r["y"]): int(r["w"]) for r in table.collect()}
    assert got == {(0, "a", 0): 2 * n**3, (0, "a", 1): 2 * n**3, (1, "b", 0): n**3, (1, "b", 1): 0, (1, "c", 0): 0, (1, "c", 1): n**3}
    asked = spark.createDataFrame([(7, "a", "b", 0)], "id long, f0 string, f1 string, y int")
    for s in (infer.decided(infer.pair_scores(asked, table, FS)), pair_stream(asked, table, FS)):
        row = s.first()
        assert (int(row["d0"]), int(row["d1"]), int(row["margin"]), row["pred"]) == (3 * n**3, 2 * n**3, -(n**3), 0)


def test_small_pair_weights_stay_long(spark):
    table = matrices.narrowed(matrices.pair_table(weighted(spark, 3), FS))
    assert dict(table.dtypes)["w"] == "bigint" and table.filter("attr = 0 AND y = 1").first()["w"] == 54


def test_equal_queries_are_weighed_once(spark):
    """A lookup's rows before the queries are told depend on their distinct levels, not on their number; nulls and levels never seen count too."""
    table = matrices.node_table(weighted(spark, 3), FS)
    rows = [(i, *("ab", "ac", "a?", "??")[i % 4], i % 2) for i in range(400)] + [(400, "a", None, 0)]
    asked = spark.createDataFrame(rows, "id long, f0 string, f1 string, y int")
    each, _ = infer.kinds(asked, FS, 2)
    assert each.count() == 4
    got = {r["id"]: (r["d0"], r["d1"], r["n_seen"]) for r in infer.node_scores(asked, table, FS).collect()}
    assert len(got) == 401 and {got[i] for i in range(0, 400, 4)} == {got[0]} and got[0][0] > 0 and got[3] == got[400] == (0, 0, 0)
    slow = infer.sequential_scores(asked, weighted(spark, 3), FS).collect()
    assert {r["id"]: (r["d0"], r["d1"], r["n_seen"]) for r in slow} == got


def test_settings_write_no_row_for_each_setting(spark, monkeypatch):
    """Rows meet folds and ways to impute only on the way out; what is written before has a row for each row or value at most."""
    sizes = []

    def spy(df, *path):
        out = staged(df, *path)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(analyses, "staged", spy)
    folded = spark.createDataFrame([(i, i % 2, i % 3, float(i % 5) if i % 4 else None) for i in range(60)], "id long, y int, fold int, a double")
    assert analyses.settings(folded, {"a": "f0"}).count() == 360
    assert max(sizes) == 60


def test_published_scores_equal_queries_once(spark):
    """queries of equal levels and label are one row with their number, and records and thresholds of these are those of all rows."""
    from fuzzloom.operators import metrics
    from fuzzloom.plans import protocols

    rules = spark.createDataFrame([(i, "abc"[i % 3], "de"[i % 2], int(i % 7 < 3)) for i in range(210)], "id long, f0 string, f1 string, y int")
    got = protocols._scores("pair", rules, rules, FS)
    assert got.count() == 12 and got.groupBy().sum("n").first()[0] == 210
    few = got.withColumn("pred", (got["d1"] > got["d0"]).cast("int"))
    every = few.selectExpr("y", "pred", "score", "explode(sequence(1, n)) AS k")
    assert metrics.record(few, weight="n").first().asDict() == metrics.record(every).first().asDict()
    assert infer.calibrate(few, weight="n") == infer.calibrate(every)


def test_fallback_splits_once(spark, monkeypatch):
    """F8: node_fallback makes its split a single time."""
    from fuzzloom.plans import catalog

    made, split_of = [], catalog._held_out
    monkeypatch.setattr(catalog, "_held_out", lambda spark, d: made.append(d) or split_of(spark, d))
    assert catalog.node_fallback(spark, "/root/testdata/sf0.001").count() > 0 and len(made) == 1
