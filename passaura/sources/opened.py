"""Files opened where a task runs, by their address: local ones and those of the stores that Arrow's file systems know."""

from __future__ import annotations

import os
import re
from typing import BinaryIO


def _system(path: str):
    from pyarrow import fs

    own = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(/*)", path)
    if own is None:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(f"file:///{path[own.end():]}" if own[1] == "file" else path)


def opened(path: str) -> BinaryIO:
    """A file by its path or URI, to be read from any place."""
    system, own = _system(path)
    return system.open_input_file(own)


def content(path: str) -> bytes:
    with opened(path) as f:
        return f.read()


def listed(path: str, extension: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's own files with an extension in any case, in order of name; paths are written as Spark's readers write them."""
    from pyarrow import fs

    system, own = _system(path)
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)", path)
    prefix = "file:"
    if scheme and scheme[1] != "file":
        prefix = f"{scheme[1]}://" + ("" if own.split("/")[0] == scheme[2] else scheme[2])  # some stores count the bucket into the path
    info = system.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(own))
    return sorted((prefix + x.path, x.size) for x in found if x.is_file and x.base_name.lower().endswith(f".{extension.lower()}"))
