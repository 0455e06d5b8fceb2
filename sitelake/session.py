"""Shared-folder helpers and the Spark settings the jobs are tuned for."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, with its file system named.

    It is the checkpoint folder of the application, which Spark makes inside
    ``spark.checkpoint.dir``. Only a local session may name none and gets a folder
    of its own; on a cluster no machine's folder would do.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


_made: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    folder = f"{shared_dir(spark)}/sitelake-{label}-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


def drop_staged() -> None:
    """Delete the intermediate tables this program has made.

    Call it when no result built on them is needed any more.
    """
    while _made:
        _drop(_made.pop())


def _drop(folder: str) -> None:
    from pyarrow import fs

    from sitelake.sources.files import file_system

    system, path = file_system(folder)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back.

    Cuts the lineage for everything built on it, survives the loss of any
    executor, and lets later readers prune columns and push filters.
    """
    return _written(df, new_folder(df.sparkSession, label))


@contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """As ``stage``, for a table that nothing reads after the block, where it is deleted."""
    folder = new_folder(df.sparkSession, label)
    try:
        yield _written(df, folder)
    finally:
        _drop(folder)


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Steps:
    """The tables a loop writes, one per step, in the shared folder.

    Every step's plan starts from written files, so plans stay short and a lost
    executor costs no more than the step it was in. Every ``merge_every`` steps
    the tables are rewritten as one, so deep loops do not open ever more files.
    """

    def __init__(self, spark: SparkSession, label: str, schema: str | StructType, merge_every: int = 8):
        self.spark, self.schema, self.merge_every = spark, schema, merge_every
        self.folder = new_folder(spark, label)
        self.count = 0
        self.paths: list[str] = []

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, step: DataFrame) -> None:
        path = f"{self.folder}/step-{self.count:05d}"
        step.write.parquet(path)
        self.count += 1
        self.paths.append(path)

    def newest(self) -> DataFrame:
        return self._read(self.paths[-1:])

    def everything(self) -> DataFrame:
        if len(self.paths) > self.merge_every:
            merged = f"{self.folder}/merged-{self.count:05d}"
            self._read(self.paths[:-1]).write.parquet(merged)
            self.paths = [merged, self.paths[-1]]
        return self._read(self.paths)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Parsers and readers run inside tasks, where the package must be importable
    whatever folder the driver was started from.
    """
    context = spark.sparkContext
    if getattr(context, "_sitelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "sitelake.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    # Workers that prepare custom state run on the driver and get no such files;
    # there the package is found where the driver found it.
    paths = [context.environment.get("PYTHONPATH"), str(root.parent)]
    context.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    context._sitelake_shipped = True
