"""Files that tasks write themselves: a draft that takes its name when complete, in any store pyarrow reaches."""

from __future__ import annotations

import contextlib
import sys
import urllib.parse
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle

# Helpers of this module travel with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# From an address to the file system behind it and the path there.
Store = Callable[[str], tuple[pafs.FileSystem, str]]


def open_store(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address: a mounted path, ``file:``, ``hdfs:``, ``s3:``, ``gs:`` or ``abfs:``."""
    parts = urllib.parse.urlsplit(address)
    if parts.scheme in ("", "file"):
        path = urllib.parse.unquote(parts.path) if parts.scheme else address
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(address)


def folder_of(path: str) -> str:
    return path.rpartition("/")[0] or "/"


@contextlib.contextmanager
def draft(system: pafs.FileSystem, drafts: str) -> Iterator[tuple[pa.NativeFile, str]]:
    """A new file in a folder of drafts and its path; it is removed if the block fails."""
    system.create_dir(drafts, recursive=True)
    path = f"{drafts}/{uuid.uuid4().hex}"
    out = system.open_output_stream(path)
    try:
        yield out, path
        out.close()
    except BaseException:
        with contextlib.suppress(OSError):
            out.close()
        with contextlib.suppress(OSError):
            system.delete_file(path)
        raise


def publish(system: pafs.FileSystem, path: str, target: str) -> None:
    """Give a complete draft its name. What stood there before is replaced, so a repeated task leaves one file."""
    system.create_dir(folder_of(target), recursive=True)
    system.move(path, target)


def copy_into(system: pafs.FileSystem, path: str, out: pa.NativeFile, piece: int = 4 << 20) -> int:
    """Append a file to an open one, piece by piece."""
    size = 0
    with system.open_input_stream(path) as source:
        while data := source.read(piece):
            out.write(data)
            size += len(data)
    return size
