"""The pipeline's stages one by one against brute force."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from test_native import slow_lines
from test_near import brute_classes
from test_texts import slow_measure

from fuzzloom.llm import rule_ledger


def corpus():
    r = random.Random(21)
    line = lambda: " ".join(f"w{r.randint(0, 3000)}" for _ in range(r.randint(8, 20)))
    docs = ["\n".join(line() for _ in range(r.randint(5, 12))) for _ in range(60)]
    docs += docs[:6] + [d.replace("w1", "v1", 1) for d in docs[10:16]] + ["short text", "", "%%% " * 80, "same words\n" * 60]
    docs += ["\n".join([line(), docs[20], line()]) for _ in range(3)]
    return [(i, d, "en", f"s{i % 3}", len(d)) for i, d in enumerate(docs)] + [(None, None, None, None, None)]


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def reread(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    kept = reread(corpus_pipeline.quality(spark, docs, ""), "a")
    want = [r for r in rows if r[1] and slow_measure(r[1])["n_words"] >= 50 and 100 * slow_measure(r[1])["n_repeat_words"] <= 50 * slow_measure(r[1])["n_words"] and not rule_ledger.measure(r[1])[2]]
    assert sorted(map(tuple, kept.collect())) == sorted(want) and kept.columns == docs.columns
    clean = reread(corpus_pipeline.lines(spark, kept, ""), "b")
    gone, left = slow_lines(want), {}
    for doc_id, text, *_ in want:
        out = [x for k, x in enumerate(text.split("\n")) if k not in gone[(doc_id, text)]]
        if out:
            left[doc_id] = "\n".join(out)
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == left and clean.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    one = reread(corpus_pipeline.near_duplicates(spark, clean, ""), "c")
    classes = {c for c, _ in brute_classes(sorted(left.items()))}
    assert {r["doc_id"] for r in one.collect()} == classes and one.count() == len(classes)
    mixed = reread(corpus_pipeline.mix(spark, one, ""), "d")
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 2 and mixed.columns == docs.columns
    last = corpus_pipeline.tokens(spark, mixed, "").collect()
    assert Counter(r["doc_id"] for r in last) == times
    for r in last:
        assert r["decoded_sha256"] == hashlib.sha256(left[r["doc_id"]].encode()).hexdigest() and re.fullmatch("[0-9a-f]{64}", r["ids_sha256"])


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
