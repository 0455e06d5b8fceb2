"""``folder``: files of a folder tree, listed and read in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sitelake.constants import TEXT_LIMIT
from sitelake.functions.paths import doc_kind, is_visible_path
from sitelake.sources.files import file_system

SCHEMA = "rel string, size bigint, modified timestamp, content binary"
ARROW = pa.schema(
    [
        ("rel", pa.string()),
        ("size", pa.int64()),
        ("modified", pa.timestamp("us", "UTC")),
        ("content", pa.binary()),
    ]
)
NAMED = pa.schema([("site", pa.string()), ("rel", pa.string()), ("content", pa.binary())])
#: Folders that are listed on the driver before the rest is left to tasks.
LISTED = 1000
FILES_PER_TASK = 1000
#: Tasks that the folders below are dealt to; a task costs more than a small folder.
WALKS = 200
BATCH_BYTES = 4 * 1024 * 1024
BATCH_ROWS = 10_000


@dataclass
class FolderPart(InputPartition):
    """Files by name, and folders whose trees are walked in the task."""

    files: list[str]
    folders: list[str]


class FolderReader(DataSourceReader):
    """The driver lists the upper folders only; those below them are dealt to tasks.

    ``content`` "false" lists files without opening them.
    """

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.content = options.get("content", "true") == "true"

    def partitions(self) -> list[FolderPart]:
        system, root = file_system(self.root)
        waiting, files, listed = [root], [], 0
        while waiting and listed < LISTED and len(waiting) < LISTED:
            level, waiting = waiting, []
            for folder in level:
                found = system.get_file_info(fs.FileSelector(folder))
                files += [f.path for f in found if f.type == fs.FileType.File]
                waiting += [f.path for f in found if f.type == fs.FileType.Directory]
                listed += 1
        parts = [FolderPart(files[i : i + FILES_PER_TASK], []) for i in range(0, len(files), FILES_PER_TASK)]
        # In turn, so that neighbours, which are often alike in size, are not one task.
        parts += [FolderPart([], waiting[i::WALKS]) for i in range(min(WALKS, len(waiting)))]
        return parts or [FolderPart([], [])]

    def _found(self, system: fs.FileSystem, partition: FolderPart) -> Iterator[fs.FileInfo]:
        """What a task has to read, one folder's tree held at a time."""
        if partition.files:
            yield from system.get_file_info(partition.files)
        for folder in partition.folders:
            yield from system.get_file_info(fs.FileSelector(folder, recursive=True))

    def read(self, partition: FolderPart) -> Iterator[pa.RecordBatch]:
        system, root = file_system(self.root)
        rows, held = [], 0
        for info in self._found(system, partition):
            if info.type != fs.FileType.File:
                continue
            content = None
            if self.content:
                with system.open_input_stream(info.path, compression=None) as stream:
                    content = stream.read()
            rows.append(
                {
                    "rel": info.path[len(root) :].lstrip("/"),
                    "size": info.size,
                    "modified": info.mtime or datetime.fromtimestamp(0, UTC),
                    "content": content,
                }
            )
            held += len(content or b"")
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class FolderSource(DataSource):
    """Files of a folder tree, whatever their names begin with."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options))


def read_folder(
    spark: SparkSession,
    root: str,
    site: str | None = None,
    content: bool = True,
    visible: Column | None = None,
) -> DataFrame:
    """``(site, rel, size, modified, content)`` of a folder tree, contents whole.

    Every file is a row, also those below names that begin with ``_`` or ``.``:
    sites keep styles in ``_static`` and documents in ``.well-known``.
    ``visible``, a condition on ``rel``, leaves others out; ``visible_notes`` is
    the one for notes. ``content=False`` lists without opening the files.
    """
    spark.dataSource.register(FolderSource)
    files = spark.read.format("folder").option("content", str(content).lower()).load(root)
    name = site or root.rstrip("/").rsplit("/", 1)[-1]
    files = files.select(F.lit(name).alias("site"), "rel", "size", "modified", "content")
    return files if visible is None else files.filter(visible)


def read_named(wanted: DataFrame, root: str, by_site: bool = False) -> DataFrame:
    """``(site, rel, content)`` of the files ``(site, rel)`` below a folder, no others opened.

    ``by_site``: each site is a folder of its name in there. Files are dealt over tasks;
    one that is absent, no file, may not be read or climbs out has no content.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(root.rstrip("/"))
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                content = None
                path = f"{top}/{row['site']}/{row['rel']}" if by_site else f"{top}/{row['rel']}"
                inside = row["rel"] and ".." not in path.split("/")
                if inside and system.get_file_info(path).type == fs.FileType.File:
                    try:
                        with system.open_input_stream(path, compression=None) as stream:
                            content = stream.read()
                    except PermissionError:
                        pass  # A finding about the file; other failures are the task's.
                rows.append({**row, "content": content})
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=NAMED)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=NAMED)

    # By name, so that the files of one site or folder are not one task.
    return wanted.select("site", "rel").repartition("site", "rel").mapInArrow(read, "site string, rel string, content binary")


def visible_notes() -> Column:
    """No part of the path begins with a dot."""
    return is_visible_path(F.col("rel"))


def to_docs(files: DataFrame, limit: int | None = TEXT_LIMIT) -> DataFrame:
    """Files with contents as documents: invalid UTF-8 becomes U+FFFD.

    Texts longer than ``limit`` bytes are cut and marked; ``None`` cuts nothing.
    """
    content = F.col("content")
    long = F.lit(False) if limit is None else F.octet_length(content) > limit
    shown = content if limit is None else F.substring(content, 1, limit)
    return files.select(
        "site",
        "rel",
        doc_kind(F.col("rel")).alias("kind"),
        F.make_valid_utf8(shown.cast("string")).alias("text"),
        F.coalesce(long, F.lit(False)).alias("truncated"),
        content.isNotNull().alias("readable"),
    )
