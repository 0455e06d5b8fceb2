"""Assembled sites as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_ROWS = 1_000_000


def write_site(files: DataFrame, path: str, mode: str = "errorifexists", by_site: bool = True) -> None:
    """Persist site files: metadata and payloads in two tables under ``path``.

    Rows are ranged by site and path first: a huge site is written by many
    tasks, small ones share a task, and each folder gets few files. With very
    many sites leave out the folders (``by_site=False``); row-group statistics
    prune the sorted files just as well.
    """
    meta = files.select(
        *[c for c in files.columns if c != "payload"],
        F.octet_length("payload").cast("bigint").alias("size"),
    )
    for name, table in (("files", meta), ("payloads", files.select("site", "rel", "payload"))):
        writer = (
            table.repartitionByRange("site", "rel")
            .sortWithinPartitions("site", "rel")
            .write.mode(mode)
            .option("maxRecordsPerFile", FILE_ROWS)
        )
        (writer.partitionBy("site") if by_site else writer).parquet(f"{path}/{name}")


def read_site(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Site files; payloads are joined in only when asked for."""
    files = spark.read.parquet(f"{path}/files")
    if not payload:
        return files
    return files.join(spark.read.parquet(f"{path}/payloads"), ["site", "rel"])
