"""``spark.readStream.format("folderstream")``: files of a folder tree as they appear or change."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.types import StructType

from sitelake.sources.files import file_system
from sitelake.sources.folders import SCHEMA, FolderPart, FolderReader

#: Listing files that are merged into one.
MERGE = 32
_LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64())])


class Listings:
    """Which files each offset brought: path, size and time, in files of their own.

    A listing is written before its number becomes an offset, so a restarted stream
    finds what every offset stands for. Old listings are merged, so that what is
    read on a restart is one row per file and not one per change.
    """

    def __init__(self, folder: str):
        self.system, self.folder = file_system(folder.rstrip("/"))
        self.system.create_dir(self.folder, recursive=True)
        self.known: dict[str, tuple[int, int]] = {}
        self.last = 0
        names = sorted(f.base_name for f in self.system.get_file_info(fs.FileSelector(self.folder)))
        merged = [n for n in names if n.startswith("merged-")]
        for name in merged[-1:] + [n for n in names if n.startswith("listing-") and n[8:16] > (merged or [""])[-1][7:15]]:
            self._take(name)
            self.last = max(self.last, int(re.search(r"\d+", name)[0]))

    def _take(self, name: str) -> None:
        for row in pq.read_table(f"{self.folder}/{name}", filesystem=self.system).to_pylist():
            self.known[row["path"]] = (row["size"], row["modified"])

    def _write(self, name: str, rows: list[tuple[str, int, int]]) -> None:
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, _LISTED, strict=True)], schema=_LISTED)
        # Under its own name only when whole.
        pq.write_table(table, f"{self.folder}/.{name}", filesystem=self.system)
        self.system.move(f"{self.folder}/.{name}", f"{self.folder}/{name}")

    def add(self, rows: list[tuple[str, int, int]]) -> int:
        self.last += 1
        self._write(f"listing-{self.last:08d}.parquet", rows)
        self.known |= {path: (size, modified) for path, size, modified in rows}
        if self.last % MERGE == 0:
            self._write(f"merged-{self.last:08d}.parquet", [(p, *k) for p, k in self.known.items()])
        return self.last

    def files(self, after: int, upto: int) -> list[str]:
        """Paths that the listings behind ``after`` and up to ``upto`` brought."""
        out: dict[str, None] = {}
        for number in range(after + 1, upto + 1):
            table = pq.read_table(f"{self.folder}/listing-{number:08d}.parquet", columns=["path"], filesystem=self.system)
            out |= dict.fromkeys(table.column("path").to_pylist())
        return list(out)


class FolderStreamReader(DataSourceStreamReader):
    """New and rewritten files, by path, size and time of change.

    ``path`` is the folder, ``listing`` a folder for what has been listed, to be
    kept as long as the stream's checkpoint. ``skip`` is a regular expression on
    relative paths that are left out (none by default: names that begin with ``_``
    or ``.`` are files like others). ``content`` "false" does not open the files.
    ``pertrigger`` bounds the files of a trigger that comes again; without it, and
    with a trigger that ends the stream, an offset takes all there are.
    """

    def __init__(self, options: dict):
        self.folder = FolderReader(options)
        self.listing = options["listing"]
        self.skip = re.compile(options["skip"]) if options.get("skip") else None
        self.per_trigger = int(options.get("pertrigger", 0))
        self.per_task = int(options.get("pertask", 1000))
        self._listings: Listings | None = None

    def listings(self) -> Listings:
        if self._listings is None:
            self._listings = Listings(self.listing)
        return self._listings

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        listings = self.listings()
        system, root = file_system(self.folder.root)
        rows = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or self.skip and self.skip.search(info.path[len(root) :].lstrip("/")):
                continue
            state = (info.size, info.mtime_ns or 0)
            if listings.known.get(info.path) != state:
                rows.append((info.path, *state))
        rows.sort(key=lambda r: (r[2], r[0]))
        if self.per_trigger:
            rows = rows[: self.per_trigger]
        return {"listing": listings.add(rows) if rows else listings.last}

    def partitions(self, start: dict, end: dict) -> list[FolderPart]:
        files = self.listings().files(start["listing"], end["listing"])
        return [FolderPart(files[i : i + self.per_task], []) for i in range(0, len(files), self.per_task)]

    def read(self, partition: FolderPart) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        pass


class FolderStream(DataSource):
    """Files of a folder tree as a stream, whatever their names begin with."""

    @classmethod
    def name(cls) -> str:
        return "folderstream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> FolderStreamReader:
        return FolderStreamReader(dict(self.options))
