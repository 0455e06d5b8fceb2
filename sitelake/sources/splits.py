"""Where large WARC files can be cut: exact record starts, found in parallel."""

from __future__ import annotations

import io
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession

from sitelake.session import new_folder
from sitelake.sources.files import file_system, list_files, open_random

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
#: A record begins after an empty line.
LINE = re.compile(rb"(?:\r\n\r\n|\n\n)(?=WARC/)")


@dataclass
class Split:
    """Bytes ``start`` to ``end`` of a file, whole records, the first of which has number ``seq``."""

    path: str
    start: int
    end: int
    seq: int


class Window(io.RawIOBase):
    """Bytes ``start`` to ``end`` of a file as a file of its own."""

    def __init__(self, file, start: int, end: int | None = None):
        self.file, self.start, self.at = file, start, start
        self.end = file.size() if end is None else end

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        size = max(0, min(len(buffer), self.end - self.at))
        data = self.file.read_at(size, self.at) if size else b""
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        base = {0: self.start, 1: self.at, 2: self.end}[whence]
        self.at = base + offset
        return self.at - self.start

    def tell(self) -> int:
        return self.at - self.start

    def close(self) -> None:
        self.file.close()
        super().close()


class Member(io.RawIOBase):
    """The text of one gzip member; ``end`` is where it ends in the file, once read."""

    def __init__(self, file, start: int):
        self.file, self.at, self.end = file, start, None
        self.inflate = zlib.decompressobj(31)
        self.size = file.size()

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while self.end is None:
            tail = self.inflate.unconsumed_tail
            if not tail:
                tail = self.file.read_at(min(BLOCK, self.size - self.at), self.at)
                self.at += len(tail)
            if not tail:
                raise EOFError("gzip member cut short")
            data = self.inflate.decompress(tail, len(buffer))
            if self.inflate.eof:
                self.end = self.at - len(self.inflate.unused_data)
            if data:
                buffer[: len(data)] = data
                return len(data)
        return 0


class Unsplittable(Exception):
    """The file must be read front to back."""


def is_packed(file) -> bool:
    return file.read_at(2, 0) == MAGIC[:2]


def first_start(file, start: int, end: int, packed: bool) -> int | None:
    """The first place in ``start`` to ``end`` that looks like a record's start.

    What a body holds may look like one as well, so it is only a guess.
    """
    at, size = start, file.size()
    reach = 4
    while at < end:
        data = file.read_at(min(BLOCK, size - at), at)
        if packed:
            found = [m.start() for m in re.finditer(re.escape(MAGIC), data)]
        else:
            found = [m.end() for m in LINE.finditer(data)]
        for place in found:
            if at + place >= end:
                return None
            if not packed or _begins_record(file, at + place, size):
                return at + place
        if at + len(data) >= size:
            return None
        # What lies across two blocks is looked at again.
        at += len(data) - reach - len(b"WARC/")
    return None


def _begins_record(file, at: int, size: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(file.read_at(min(4096, size - at), at), 5).upper() == b"WARC/"
    except zlib.error:
        return False


def walk(file, start: int, end: int, packed: bool) -> tuple[int, int]:
    """From the record at ``start`` on: where the first one at or after ``end`` begins, and how many lie before it."""
    return _walk_members(file, start, end) if packed else _walk_records(file, start, end)


def _walk_records(file, start: int, end: int) -> tuple[int, int]:
    from sitelake.sources.warc import records

    size, count = file.size(), 0
    places: list[int] = []
    with io.BufferedReader(_Shared(file, start), 1 << 16) as stream:
        for _, _, error in records(stream, lambda headers: False, size, places):
            if error is not None:
                raise Unsplittable(error)
            if start + places[-1] >= end:
                return start + places[-1], count
            count += 1
    return size, count


def _walk_members(file, start: int, end: int) -> tuple[int, int]:
    from sitelake.sources.warc import records

    at, size, count = start, file.size(), 0
    while at < min(end, size):
        member = Member(file, at)
        try:
            with io.BufferedReader(member, 1 << 16) as stream:
                for _, _, error in records(stream, lambda headers: False, 1 << 62):
                    if error is not None:
                        raise Unsplittable(error)
                    count += 1
                while stream.read(BLOCK):
                    pass
        except (EOFError, zlib.error) as error:
            raise Unsplittable(str(error)) from error
        at = member.end
    return at, count


class _Shared(Window):
    """A window that leaves the file open."""

    def close(self) -> None:
        io.RawIOBase.close(self)


_RESULT = "path string, part long, first long, after long, n long, error string"


def _examined(spark: SparkSession, pattern: str, ranges: list[tuple[str, int, int, int, int]]) -> list:
    """For every ``(path, part, start, end, known)``: its first record, the one after and their number.

    ``known`` is where the first record begins, or -1 if that is to be guessed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, part, start, end, known in frame.itertuples(index=False):
                with open_random(pattern, path) as file:
                    packed = is_packed(file)
                    first = known if known >= 0 else first_start(file, start, end, packed)
                    row = {"path": path, "part": part, "first": first, "after": None, "n": 0, "error": None}
                    try:
                        if first is not None:
                            row["after"], row["n"] = walk(file, first, end, packed)
                    except Unsplittable as error:
                        row["error"] = str(error)
                yield pd.DataFrame([row]).astype({"first": "Int64", "after": "Int64"})

    asked = spark.createDataFrame(ranges, "path string, part long, start long, end long, known long")
    return asked.repartition(len(ranges)).mapInPandas(run, _RESULT).collect()


def find_splits(spark: SparkSession, pattern: str, files: list[tuple[str, int]], size: int) -> list[Split]:
    """Cuts of large files into about ``size`` bytes each, at record starts.

    Every range of a file guesses its first record and walks to the first one behind
    the range, by lengths alone (gzip members by inflating them), all at once. A
    range is right if the one before it ends where it begins; a range that guessed
    wrongly, as bodies may hold what looks like a record, walks again from there. A
    file with a malformed record is not cut, so that it is read as ever.
    """
    parts = {path: -(-total // size) for path, total in files}
    ranges = [
        (path, part, part * size, min((part + 1) * size, total), 0 if part == 0 else -1)
        for path, total in files
        for part in range(parts[path])
    ]
    known = {(r.path, r.part): r for r in _examined(spark, pattern, ranges)}
    bounds = {(path, part): (start, end) for path, part, start, end, _ in ranges}
    while True:
        again = []
        done: list[Split] = []
        for path, total in files:
            at, seq, splits, cut = 0, 0, [], True
            for part in range(parts[path]):
                start, end = bounds[path, part]
                if at >= end:  # a record reaches beyond this range
                    continue
                found = known[path, part]
                if found.first != at:
                    again.append((path, part, start, end, at))
                    break
                if found.error:
                    cut = False
                    break
                splits.append(Split(path, at, found.after, seq))
                at, seq = found.after, seq + found.n
            done += splits if cut else [Split(path, 0, total, 0)]
        if not again:
            return done
        known |= {(r.path, r.part): r for r in _examined(spark, pattern, again)}


def large_files(pattern: str, size: int, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    return [(path, n) for path, n in list_files(pattern, suffixes) if n > size and not path.lower().endswith(".wacz")]


def write_splits(spark: SparkSession, splits: list[Split]) -> str:
    """Keep splits where the reader's plan finds them; the path of the list."""
    folder = new_folder(spark, "splits")
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/splits.json") as out:
        out.write(json.dumps([vars(s) for s in splits]).encode())
    return f"{folder}/splits.json"


def read_splits(path: str) -> dict[str, list[Split]]:
    """Splits of each file, in order."""
    system, bare = file_system(path)
    with system.open_input_stream(bare) as source:
        splits = [Split(**s) for s in json.loads(source.read())]
    out: dict[str, list[Split]] = {}
    for s in splits:
        out.setdefault(s.path, []).append(s)
    return out
