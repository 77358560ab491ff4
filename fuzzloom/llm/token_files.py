"""Token ids as Parquet list columns.

Documents are range-partitioned and sorted by doc_id, tokenized, and written by Spark's
Parquet writer with a chosen encoding (dictionary, or delta by format version 2), row
groups and pages of set sizes and column indexes, so that a reader can take a few
documents' ids or only the metadata.  Part files follow one another in doc_id order.
Offsets are prefix sums: within a file by the writer, over files from one row per file.

The tokenizer runs on white-space pieces and remembers a bounded number of them: it drops
white space, so the ids of a text are those of its pieces in order.

Null texts count as empty: only the end id.  Rows that share a doc_id stand next to each
other in an order given by their text.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fuzzloom.llm.common import by_slice, shared_dir, text_bytes

#: Bytes of text of a file, or more where there are fewer files than shuffle partitions.
FILE_BYTES = 256 << 20
_HELD: dict = {}


#: Pieces that a worker holds in each of two generations: what a full one held stays while it is used again.
LIMIT = 350_000


#: Marks around letters are tokens of their own; apostrophes may belong to the letters after them.
_AROUND = re.compile(r"([!-&(-/:-@\[-`{-~]*)([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def _latin(word: str) -> bool:
    """Letters that the tokenizer's normal form leaves in place and lower-cases one by one."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250" and "\u0130" not in word)


def _parts(piece: str) -> tuple[str, ...]:
    """A piece as parts whose ids stand side by side."""
    if _latin(piece):
        return (piece.lower(),)
    if "<|" not in piece and (m := _AROUND(piece)) and _latin(m[2]):
        return m[1], m[2].lower(), m[3]
    return (piece,)


def tokenizer_ids(path: str):
    """A function from an Arrow column of texts and an end id to all ids side by side and the number of each text's, the end id included.

    New stems of letters are encoded many at a time: each is one word, whose last token says so."""
    if path in _HELD:
        return _HELD[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    encode = getattr(t, "encode_batch_fast", t.encode_batch)
    closes = np.array([(t.id_to_token(i) or "").endswith("</w>") for i in range(t.get_vocab_size())])
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}

    def one_by_one(new: list[str]) -> None:
        for w, e in zip(new, encode(new, add_special_tokens=False), strict=True):
            young[w] = np.array(e.ids, np.uint32).tobytes()

    def learn(new: list[str]) -> None:
        words, others = [w for w in new if _latin(w)], [w for w in new if not _latin(w)]
        one_by_one(others)
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            ids = np.array(encode([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(closes[ids]) + 1
            if len(ends) != len(some):
                one_by_one(some)
                continue
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            for w, low, high in zip(some, at, at[1:], strict=False):
                young[w] = raw[low:high]

    def known(words: list[str]) -> list[bytes | None]:
        """What either generation knows of them; it is young now."""
        got = list(map(young.get, words))
        for i in [i for i, x in enumerate(got) if x is None]:
            if (x := old.get(words[i])) is not None:
                got[i] = young[words[i]] = x
        return got

    def of(words: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        got = known(words)
        new = [i for i, x in enumerate(got) if x is None]
        parts = [_parts(words[i]) for i in new]
        stems = list({x for p in parts for x in p})
        learn([w for w, x in zip(stems, known(stems), strict=True) if x is None])
        for i, p in zip(new, parts, strict=True):
            if len(p) == 3:
                got[i] = young[words[i]] = young[p[0]] + young[p[1]] + young[p[2]]
            else:
                got[i] = young[words[i]] = young[p[0]]
        return got

    def ids(texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal young, old
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        at = np.asarray(split.offsets)
        pieces = split.flatten().dictionary_encode()
        raw = [*of(pieces.dictionary.to_pylist()), np.array([end_id], np.uint32).tobytes()]
        codes = np.insert(np.asarray(pieces.indices), at[1:] - at[0], len(raw) - 1)  # the end id as a piece of its own
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        first = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        flat = np.frombuffer(b"".join(raw), np.uint32)[np.repeat(first[codes] - ends + n, n) + np.arange(int(ends[-1]) if len(n) else 0)]
        last = ends[at[1:] - at[0] + np.arange(len(texts))]
        if len(young) > LIMIT:
            young, old = {}, young
        return flat, np.diff(last, prepend=0)

    _HELD[path] = ids
    return ids


def _by_size(batches: Iterator[pa.RecordBatch], most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the Arrow batches whose texts (column 1) have at most so many bytes, or one row."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            past = int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + most, "right"))
            yield batch.slice(at, max(past - at, 1))
            at = max(past, at + 1)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, encoding: str = "dictionary", row_group: int = 32 << 20, page: int = 256 << 10, files: int | None = None) -> None:
    """Write (doc_id, n_tokens, file, file_start, tokens) in ascending doc_id order.

    encoding: "dictionary", or "delta" for DELTA_BINARY_PACKED."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    spark = docs.sparkSession
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // FILE_BYTES))
    key = docs.schema["doc_id"].dataType.simpleString()
    types = [("doc_id", None), ("n_tokens", pa.int64()), ("file", pa.int32()), ("file_start", pa.int64()), ("tokens", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]):
        ids, at, task = tokenizer_ids(tokenizer_path), 0, TaskContext.get().partitionId()
        for part in _by_size(batches):
            flat, n = ids(part.column(1), end_id)
            ends = np.cumsum(n)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32)))
            cols = [part.column(0), pa.array(n), pa.array(np.full(len(n), task, np.int32)), pa.array(at + ends - n), tokens]
            at += int(ends[-1]) if len(n) else 0
            yield pa.RecordBatch.from_arrays(cols, names=[k for k, _ in types])

    # Ranges are cut by the texts' beginnings, too, so that rows of one doc_id may lie in several files, in their order.
    ordered = docs.select("doc_id", "text").repartitionByRange(files, F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    out = ordered.mapInArrow(run, f"doc_id {key}, n_tokens long, file int, file_start long, tokens array<int>")
    (
        out.write.option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("parquet.page.row.count.limit", 4096)
        .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.column.index.access", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, start) without reading a token: start counts the ids of all documents before."""
    meta = spark.read.parquet(path).select("doc_id", "n_tokens", "file", "file_start")
    return _started(meta)


def _started(rows: DataFrame) -> DataFrame:
    meta = rows if "tokens" not in rows.columns else rows.drop("tokens")
    sums = meta.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))  # one row per part file
    base = F.broadcast(base) if len(rows.inputFiles()) <= 100_000 else base
    return rows.join(base, "file").withColumn("start", F.col("base") + F.col("file_start")).drop("file", "file_start", "base")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens, start), of doc_ids from low up to below high: pages outside are skipped by their index."""
    rows = spark.read.parquet(path)
    out = _started(rows)
    if low is not None:
        out = out.filter(F.col("doc_id") >= low)
    return out.filter(F.col("doc_id") < high) if high is not None else out


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2, encoding: str = "dictionary") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the written files."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fuzzloom-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_path, end_id, path, encoding)
    key = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def f(part):
            lists = part.column(3)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes(), (np.asarray(lists.offsets) - lists.offsets[0].as_py()).tolist()
            return {"doc_id": part.column(0), "start": part.column(1), "n_tokens": part.column(2), "ids_crc32": [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]}

        return f

    rows = read_tokens(spark, path).select("doc_id", "start", "n_tokens", "tokens")
    return by_slice(rows, make, f"doc_id {key}, start long, n_tokens long, ids_crc32 long")
