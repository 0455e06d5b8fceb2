"""Opening files from tasks, on any file system Arrow knows."""

from __future__ import annotations

import fnmatch
import re

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and bare path of a URI or a local path."""
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:", path):
        # Spark writes file:/x and s3a://x where Arrow reads file:///x and s3://x.
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", path)))
    return fs.LocalFileSystem(), path


#: What Spark's writers leave beside their files.
COMMIT_NAMES = {"_temporary", "_SUCCESS"}


def list_files(pattern: str, suffixes: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """``(path, size)`` of the files a glob or folder names, in name order."""
    system, path = file_system(pattern)
    fixed = re.split(r"[*?\[]", path, maxsplit=1)[0]
    if fixed == path:
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        root, match = path, lambda p: True
    else:
        root, match = fixed.rsplit("/", 1)[0] or "/", lambda p: fnmatch.fnmatchcase(p, path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [
        (f.path, f.size)
        for f in found
        if f.type == fs.FileType.File
        and match(f.path)
        and not any(part in COMMIT_NAMES for part in f.path[len(root) :].split("/"))
        and (not suffixes or f.path.lower().endswith(suffixes))
    ]
    return sorted(names)


def open_stream(scheme_of: str, path: str):
    """Read a file front to back; ``scheme_of`` tells the file system."""
    system, _ = file_system(scheme_of)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)


def open_random(scheme_of: str, path: str):
    """Read a file at any offset."""
    system, _ = file_system(scheme_of)
    return system.open_input_file(path)


def file_stem(path: str) -> str:
    """Name of a site: the file name without its last extension."""
    name = path.rsplit("/", 1)[-1]
    head, dot, _ = name.rpartition(".")
    return head if dot and head else name
