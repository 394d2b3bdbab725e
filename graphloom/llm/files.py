"""Binary files below the shared folder, read and written by executors through pyarrow's file systems."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a uri such as file:/x, file:///x, hdfs://host/x or a plain path."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return pafs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9+.-]+://", uri) else (pafs.LocalFileSystem(), uri)


def list_files(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the folder's files with this suffix, by name."""
    fs, path = open_fs(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    names = sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(suffix))
    return [(f"{folder}/{name}", size) for name, size in names]


@contextlib.contextmanager
def published(folder: str, name: str) -> Iterator:
    """A stream whose file appears as folder/name only when the block ends well.

    A repeated or speculative attempt writes its own hidden file and replaces the finished one.
    """
    fs, path = open_fs(folder)
    hidden = f"{path}/_work"
    fs.create_dir(hidden, recursive=True)
    temporary = f"{hidden}/{uuid.uuid4().hex}"
    stream = fs.open_output_stream(temporary, compression=None, buffer_size=1 << 20)
    try:
        yield stream
    except BaseException:
        stream.close()
        fs.delete_file(temporary)
        raise
    stream.close()
    try:
        fs.move(temporary, f"{path}/{name}")
    except OSError:  # stores that don't rename over a file
        fs.delete_file(f"{path}/{name}")
        fs.move(temporary, f"{path}/{name}")
