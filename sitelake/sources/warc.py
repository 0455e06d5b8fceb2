"""``spark.read.format("warc")``: web-archive records, one row each."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sitelake.constants import MAX_WARC_RECORD
from sitelake.sources.files import file_stem, list_files, open_random, open_stream
from sitelake.sources.splits import Window, find_splits, large_files, read_splits, write_splits

SCHEMA = (
    "site string, file string, seq bigint, warc_type string, target_uri string,"
    " headers map<string,string>, content_length bigint, body binary, _error string"
)
ARROW = pa.schema(
    [
        ("site", pa.string()),
        ("file", pa.string()),
        ("seq", pa.int64()),
        ("warc_type", pa.string()),
        ("target_uri", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("content_length", pa.int64()),
        ("body", pa.binary()),
        ("_error", pa.string()),
    ]
)
WARC_SUFFIXES = (".warc", ".warc.gz")
BATCH_BYTES = 32 * 1024 * 1024
BATCH_ROWS = 10_000
BYTES_PER_TASK = 1024 * 1024 * 1024


SKIP_BYTES = 1 << 20


def wanted_suffixes(pattern: str) -> tuple[str, ...]:
    """A folder may hold indexes too; a pattern says itself what it names."""
    return () if re.search(r"[*?\[]", pattern) else (*WARC_SUFFIXES, ".wacz")


def skip(stream, size: int) -> int:
    """Read past ``size`` bytes; how many there were."""
    left = size
    while left and (block := stream.read(min(left, SKIP_BYTES))):
        left -= len(block)
    return size - left


def records(
    stream, wanted=lambda headers: True, largest: int = MAX_WARC_RECORD, places: list[int] | None = None
) -> Iterator[tuple[dict, bytes | None, str | None]]:
    """Headers (names lower-cased), body and error of each record of a stream.

    Bodies that are not ``wanted``, or are larger than ``largest``, are read past
    by their length. After a header that says no length, reading goes on at the
    next line that begins a record. ``places`` gets the place at which each of
    them begins, if the stream can tell.
    """
    lost = False
    while version := stream.readline(SKIP_BYTES):
        if not version.strip():
            continue
        if places is not None:
            places.append(stream.tell() - len(version))
        if not version.upper().startswith(b"WARC/"):
            if not lost:
                yield {}, None, f"unexpected WARC header: {version[:80]!r}"
            lost = True
            continue
        lost = False
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length")
        if length is None or not length.isascii() or not length.isdigit():
            yield headers, None, "record without Content-Length" if length is None else "invalid Content-Length"
            lost = True
            continue
        size = int(length)
        if size > largest:
            skip(stream, size)
            yield headers, None, f"record too large ({size} bytes, at most {largest})"
        elif wanted(headers):
            body = stream.read(size)
            if len(body) < size:
                yield headers, None, "record body cut short"
            else:
                yield headers, body, None
        elif skip(stream, size) < size:
            yield headers, None, "record body cut short"
        else:
            yield headers, None, None


@dataclass
class WarcFile(InputPartition):
    """A WARC file, or part ``index`` of ``count`` of the WARCs in a WACZ.

    With ``end``, only the records between two places of the file, the first of
    which has number ``seq``.
    """

    path: str
    site: str
    index: int = 0
    count: int = 1
    start: int = 0
    end: int | None = None
    seq: int = 0


class WarcReader(DataSourceReader):
    """One partition per WARC, or per split of it; gzip members are read as one stream.

    The driver only lists files. A large WACZ gets several partitions by its
    size, and each takes its share of the WARCs inside. ``splits`` names a list of
    places at which large files are cut (``read_warc`` makes it).

    ``mode`` is FAILFAST (a malformed record fails the job) or DROPMALFORMED (a
    row with ``_error`` stands for it and the records after it are read).
    ``types`` (names with commas between) leaves other records out before they
    reach Spark; ``body`` "false" leaves bodies out; ``largest`` is the size from
    which a record counts as malformed.
    """

    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.mode = options.get("mode", "FAILFAST").upper()
        self.types = set(options["types"].split(",")) if options.get("types") else None
        self.body = options.get("body", "true") == "true"
        self.largest = int(options.get("largest", MAX_WARC_RECORD))
        self.splits = options.get("splits")

    def _asked(self, headers: dict) -> bool:
        return self.types is None or headers.get("warc-type") in self.types

    def partitions(self) -> list[WarcFile]:
        parts = []
        cuts = read_splits(self.splits) if self.splits else {}
        for path, size in list_files(self.pattern, wanted_suffixes(self.pattern)):
            if path in cuts:
                parts += [WarcFile(path, file_stem(path), start=s.start, end=s.end, seq=s.seq) for s in cuts[path]]
                continue
            count = 1
            if path.lower().endswith(".wacz"):
                count = max(1, -(-size // BYTES_PER_TASK))
            parts += [WarcFile(path, file_stem(path), index, count) for index in range(count)]
        return parts

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        if not partition.path.lower().endswith(".wacz"):
            if partition.end is not None:
                raw = Window(open_random(self.pattern, partition.path), partition.start, partition.end)
            else:
                raw = _Raw(open_stream(self.pattern, partition.path))
            yield from self._read_stream(partition, partition.path, raw)
            return
        with open_random(self.pattern, partition.path) as file, zipfile.ZipFile(file) as archive:
            members = sorted(i.filename for i in archive.infolist() if i.filename.lower().endswith(WARC_SUFFIXES))
            if not members:
                raise ValueError(f"no WARC in {partition.path}")
            for member in members[partition.index :: partition.count]:
                yield from self._read_stream(partition, f"{partition.path}!{member}", archive.open(member))

    def _read_stream(self, partition: WarcFile, name: str, raw) -> Iterator[pa.RecordBatch]:
        with io.BufferedReader(raw, 1 << 20) as buffered:
            packed = buffered.peek(2)[:2] == b"\x1f\x8b"
            yield from self._batches(partition, name, gzip.open(buffered) if packed else buffered)

    def _batches(self, partition: WarcFile, name: str, stream) -> Iterator[pa.RecordBatch]:
        rows, held, seq = [], 0, partition.seq - 1

        def row(**values) -> dict:
            return {"site": partition.site, "file": name, "seq": seq, **values}

        def failed(error: str) -> dict:
            if self.mode == "FAILFAST":
                raise ValueError(f"{name}: {error}")
            return row(_error=error)

        try:
            found = records(stream, lambda headers: self.body and self._asked(headers), self.largest)
            for seq, (headers, body, error) in enumerate(found, partition.seq):
                if error is not None:
                    rows.append(failed(error))
                elif self._asked(headers):
                    rows.append(
                        row(
                            warc_type=headers.get("warc-type"),
                            target_uri=headers.get("warc-target-uri"),
                            headers=list(headers.items()),
                            content_length=int(headers["content-length"]),
                            body=body,
                        )
                    )
                    held += len(body or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        except (EOFError, gzip.BadGzipFile) as error:
            seq += 1
            rows.append(failed(str(error)))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class _Raw(io.RawIOBase):
    """An Arrow stream as a Python raw file."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.stream.close()
        super().close()


class WarcSource(DataSource):
    """Records of WARC, gzipped WARC and WACZ files."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(
    spark: SparkSession,
    path: str,
    mode: str = "FAILFAST",
    types: tuple[str, ...] = (),
    body: bool = True,
    largest: int = MAX_WARC_RECORD,
    split: int | None = BYTES_PER_TASK,
) -> DataFrame:
    """Records of all WARCs a glob or folder names; other files are passed over.

    ``types`` reads records of these types only, and ``body=False`` no bodies:
    what is not asked for never leaves the reader. Files larger than ``split``
    bytes, gzipped by records or not, are cut at records into about that many
    bytes each, which takes a first pass over them; ``None`` cuts nothing. Rows
    do not depend on the cuts. A file that is one gzip member stays whole.
    """
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("mode", mode).option("types", ",".join(types))
    if split and (large := large_files(path, split, wanted_suffixes(path))):
        reader = reader.option("splits", write_splits(spark, find_splits(spark, path, large, split)))
    return reader.option("body", str(body).lower()).option("largest", largest).load(path)


def read_wacz(spark: SparkSession, path: str, mode: str = "FAILFAST", **options) -> DataFrame:
    """Records of all WARCs inside each WACZ; a WACZ without one is an error."""
    return read_warc(spark, path, mode, **options)
