"""Session, storage and text helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: One word: a run of characters that are not ASCII white space.  bytes.split() splits alike.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the session's checkpoint folder where that is unset.

    Only a local session, whose executors are the driver, gets a new folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fuzzloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/fuzzloom-{uuid.uuid4().hex}"


#: Paths that tables were written to, by each done_with() that has not ended.
_HELD: list[list[str]] = []


def done_with(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written; the tables that it wrote on the way are deleted when that is done."""
    _HELD.append([])
    try:
        out, path = make(), new_folder(spark)
        out.write.option("compression", "zstd").parquet(path)
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for old in _HELD.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(old)
            at.getFileSystem(conf).delete(at, True)
    if _HELD:
        _HELD[-1].append(path)
    return spark.read.schema(out.schema).parquet(path)


def written(df: DataFrame, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write a larger table to the shared folder once, and read it from there."""
    spark, path = df.sparkSession, path or new_folder(df.sparkSession)
    if _HELD:
        _HELD[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system that holds a path of the shared folder, and the path there; for tasks that read or write byte ranges."""
    return pa.fs.FileSystem.from_uri(path)


def stored_batches(path: str, columns: list[str], size: int) -> Iterator[pa.RecordBatch]:
    """A written table's rows, streamed by a task in batches of a few rows; nothing of it is kept."""
    fs, at = store(path)
    found = [x.path for x in fs.get_file_info(pa.fs.FileSelector(at)) if x.path.rpartition("/")[2].startswith("part-")]
    for name in sorted(found):
        with fs.open_input_file(name) as file:
            yield from pq.ParquetFile(file).iter_batches(size, columns=columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """Rows of a table that is read by fewer tasks than the session runs at once are dealt anew; a larger table stays as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *beside: str) -> DataFrame:
    """All columns as one struct, whole, so that their names meet no others, and the named ones beside it."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("whole"), *[F.col(quoted(c)) for c in beside])


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, by one reading of that column."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def n_words(text):
    """Number of words of a text column, 0 for null; expression only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rows_in_slices(batches: Iterable[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices of the Arrow batches, so that what a task holds stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def by_slice(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | StructType, size: int = 512) -> DataFrame:
    """mapInArrow of a function from a slice of rows to columns.  make() runs once in each task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        f = make()
        for part in rows_in_slices(batches, size):
            cols = f(part)
            yield pa.RecordBatch.from_arrays([cols[x.name] if isinstance(cols[x.name], pa.Array) and cols[x.name].type == x.type else pa.array(cols[x.name], type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()
_C = 0x9E3779B97F4A7C15


def hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    """One 64-bit hash for each of n words."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word of a text."""
    words = (text or "").encode().split()
    return hashes(words, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_POWERS = (np.ones(1, np.uint64), np.ones(1, np.uint64))  # of _C and of its inverse
_LONGEST = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of a constant, and of its inverse."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        _POWERS = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_C, pow(_C, -1, 1 << 64)))
    return _POWERS


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of so many words; of the whole where it is shorter.

    A window's value is a polynomial of its words, which wide windows take from running sums."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    if 8 <= width and len(h) <= _LONGEST:
        up, down = powers(len(h))
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * down[: len(h)], out=sums[1:])
        return mixed((sums[width:] - sums[:n]) * up[width - 1 : len(h)] + np.uint64(width))
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc = acc * np.uint64(_C) + h[k : n + k]
    return mixed(acc + np.uint64(width))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct word shingles of a text, as 64-bit hashes."""
    return np.unique(window_hashes(word_hashes(text), width))
