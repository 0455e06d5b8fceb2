"""``zipcatalog`` and ``zipmembers``: zip files listed and read in place."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from sitelake.sources.files import list_files, open_random

ZIP_SUFFIXES = (".zip", ".wacz")
CATALOG_SCHEMA = "archive string, name string, size bigint, compressed bigint, is_dir boolean, ordinal bigint"
CATALOG_ARROW = pa.schema(
    [
        ("archive", pa.string()),
        ("name", pa.string()),
        ("size", pa.int64()),
        ("compressed", pa.int64()),
        ("is_dir", pa.bool_()),
        ("ordinal", pa.int64()),
    ]
)
MEMBERS_SCHEMA = "archive string, name string, size bigint, content binary, truncated boolean"
MEMBERS_ARROW = pa.schema(
    [
        ("archive", pa.string()),
        ("name", pa.string()),
        ("size", pa.int64()),
        ("content", pa.binary()),
        ("truncated", pa.bool_()),
    ]
)
ROWS = 10_000
BYTES_PER_TASK = 256 * 1024 * 1024
BATCH_BYTES = 32 * 1024 * 1024


@dataclass
class ZipPart(InputPartition):
    """Part ``index`` of ``count`` of the members of one archive."""

    path: str
    index: int
    count: int

    def slice(self, members: list) -> list:
        """The members that begin in this part's share of the archive's bytes."""
        if self.count == 1:
            return members
        end = max(m.header_offset + m.compress_size for m in members) if members else 0
        share = end // self.count + 1
        return [m for m in members if m.header_offset // share == self.index]


def zip_parts(path: str, size: int) -> list[ZipPart]:
    """Parts by file size alone: no archive is opened on the driver."""
    count = max(1, -(-size // BYTES_PER_TASK))
    return [ZipPart(path, index, count) for index in range(count)]


class CatalogReader(DataSourceReader):
    """One partition per archive; only its central directory is read."""

    def __init__(self, options: dict):
        self.pattern = options["path"]

    def partitions(self) -> list[ZipPart]:
        return [ZipPart(path, 0, 1) for path, _ in list_files(self.pattern, ZIP_SUFFIXES)]

    def read(self, partition: ZipPart) -> Iterator[pa.RecordBatch]:
        with open_random(self.pattern, partition.path) as file, zipfile.ZipFile(file) as archive:
            infos = archive.infolist()
        for start in range(0, len(infos), ROWS):
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "archive": partition.path,
                        "name": info.filename,
                        "size": info.file_size,
                        "compressed": info.compress_size,
                        "is_dir": info.is_dir(),
                        "ordinal": ordinal,
                    }
                    for ordinal, info in enumerate(infos[start : start + ROWS], start)
                ],
                schema=CATALOG_ARROW,
            )


class MembersReader(DataSourceReader):
    """Contents of members, whole unless ``limit`` (bytes) cuts them.

    Large archives are split into ranges of members, so that one archive does
    not mean one task. The ``names`` option (one name per line) reads only those
    members; with ``spark.sql.python.filterPushdown.enabled`` a filter on
    ``name`` does the same.
    """

    def __init__(self, options: dict):
        self.pattern = options["path"]
        listed = options.get("names")
        self.names = set(listed.split("\n")) if listed is not None else None
        self.limit = int(options["limit"]) if options.get("limit") else None

    def partitions(self) -> list[ZipPart]:
        found = list_files(self.pattern, ZIP_SUFFIXES)
        return [part for path, size in found for part in zip_parts(path, size)]

    def read(self, partition: ZipPart) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        with open_random(self.pattern, partition.path) as file, zipfile.ZipFile(file) as archive:
            for info in partition.slice(archive.infolist()):
                if info.is_dir() or (self.names is not None and info.filename not in self.names):
                    continue
                with archive.open(info) as member:
                    content = member.read() if self.limit is None else member.read(self.limit)
                rows.append(
                    {
                        "archive": partition.path,
                        "name": info.filename,
                        "size": info.file_size,
                        "content": content,
                        "truncated": self.limit is not None and info.file_size > self.limit,
                    }
                )
                held += len(content)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=MEMBERS_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=MEMBERS_ARROW)


class FilteredMembersReader(MembersReader):
    """Takes equality filters on ``name`` from the optimizer."""

    def pushFilters(self, filters):
        for item in filters:
            wanted = None
            if isinstance(item, EqualTo) and item.attribute == ("name",):
                wanted = {item.value}
            elif isinstance(item, In) and item.attribute == ("name",):
                wanted = set(item.value)
            if wanted is None:
                yield item
            else:
                self.names = wanted if self.names is None else self.names & wanted


class ZipCatalogSource(DataSource):
    """Members of zip and WACZ files, without their contents."""

    @classmethod
    def name(cls) -> str:
        return "zipcatalog"

    def schema(self) -> str:
        return CATALOG_SCHEMA

    def reader(self, schema: StructType) -> CatalogReader:
        return CatalogReader(dict(self.options))


class ZipMembersSource(DataSource):
    """Contents of zip members."""

    @classmethod
    def name(cls) -> str:
        return "zipmembers"

    def schema(self) -> str:
        return MEMBERS_SCHEMA

    def reader(self, schema: StructType) -> MembersReader:
        options = dict(self.options)
        pushes = options.get("pushdown") == "true"
        return FilteredMembersReader(options) if pushes else MembersReader(options)


def read_zip_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, name, size, compressed, is_dir, ordinal)`` of many archives."""
    spark.dataSource.register(ZipCatalogSource)
    return spark.read.format("zipcatalog").load(path)


def read_zip_members(
    spark: SparkSession, path: str, names: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Contents of the named members, or of all, of many archives.

    They are whole; ``limit`` cuts each at so many bytes and marks it.
    """
    spark.dataSource.register(ZipMembersSource)
    reader = spark.read.format("zipmembers")
    if names is not None:
        reader = reader.option("names", "\n".join(names))
    if limit is not None:
        reader = reader.option("limit", limit)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return reader.option("pushdown", pushes).load(path)
