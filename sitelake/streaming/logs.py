"""Sinks and sources shared by the streaming jobs.

Results go to append-only logs: one folder per micro-batch, overwritten when a
batch is retried, so every row is there exactly once. A job that keeps the
newest of something appends what each batch changed and resolves versions when
the log is read; the cost of a batch then depends on the batch alone, never on
how much has been kept before.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructType

from sitelake.session import new_folder
from sitelake.streaming.folders import FolderStream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(
    spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet", per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; files added later are read next."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def stream_folder(
    spark: SparkSession,
    root: str,
    listing: str | None = None,
    skip: str | None = None,
    content: bool = True,
    per_trigger: int | None = None,
) -> DataFrame:
    """Files of a folder tree as they appear or are rewritten: ``rel, size, modified, content``.

    Every file counts, also below names that begin with ``_`` or ``.``; ``skip``, a
    regular expression on ``rel``, leaves others out. A file comes again when its
    size or time of change is another. ``listing`` is the folder that remembers what
    has come: name one beside the checkpoint if the stream is to be started again.
    ``per_trigger`` bounds the files of each trigger of a stream that goes on.
    """
    spark.dataSource.register(FolderStream)
    reader = spark.readStream.format("folderstream").option("listing", listing or new_folder(spark, "listing"))
    reader = reader.option("content", str(content).lower()).option("pertrigger", per_trigger or 0)
    return (reader.option("skip", skip) if skip else reader).load(root)


def write_log(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    each: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start writing a stream to a log, each batch passed through ``each``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(save)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of a log with the ``batch`` they came in."""
    full = StructType(schema.fields).add("batch", LongType())
    return spark.read.schema(full).parquet(path)


@contextmanager
def rocksdb(spark: SparkSession):
    """Start a query with the state store that custom state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drain(
    stream: DataFrame,
    schema: StructType | None = None,
    each: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    mode: str = "append",
) -> DataFrame:
    """Run a stream over everything there is and return its log."""
    spark = stream.sparkSession
    path, checkpoint = new_folder(spark, "log"), new_folder(spark, "offsets")
    query = write_log(stream, path, checkpoint, each, mode)
    query.awaitTermination()
    return read_log(spark, path, schema or stream.schema)
