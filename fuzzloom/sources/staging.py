"""Tables that several branches of a plan read, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Set the context's checkpoint folder from spark.checkpoint.dir; only a local session gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fuzzloom-")
    sc.setCheckpointDir(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    checkpoint_folder(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/fuzzloom-{uuid.uuid4().hex}"


def stored_batches(path: str, columns: list[str], size: int):
    """A staged table's rows, streamed by a task in batches of a few rows, so that a task meets all of a table without holding it."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    for name in sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.path.rpartition("/")[2].startswith("part-")):
        with store.open_input_file(name) as file:
            yield from pq.ParquetFile(file).iter_batches(size, columns=columns)


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table without its lineage: written once as Parquet, so that readers get the columns they use and Spark knows its size."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
