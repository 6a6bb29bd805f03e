"""Files that tasks write to and range-read from the shared folder."""

from __future__ import annotations

import re
import uuid


def settle() -> None:
    """Give memory that a task has let go back to the system: Spark keeps its Python workers for the stages to come."""
    import ctypes
    import ctypes.util

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(ctypes.util.find_library("c") or None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def filesystem(uri: str):
    """File system and path of a URI of the shared folder (file, s3, s3a, gs, hdfs, viewfs)."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3a:", "s3:", uri))
    return fs.FileSystem.from_uri(uri)


def create(folder: str, name: str):
    """Open a new file under ``folder``; gives its URI and an output stream.

    The name holds a unique part, so that a second attempt of a task never meets the first one's file.
    What counts is the path that the successful attempt returns.
    """
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}"
    return f"{folder}/{file}", system.open_output_stream(f"{path}/{file}")


def open_range(uri: str):
    """Random-access file for range reads."""
    system, path = filesystem(uri)
    return system.open_input_file(path)
