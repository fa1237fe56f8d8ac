"""Files in a shared folder, opened from executors by URI.

URIs carry a scheme (:func:`codeatlas.shared.qualified` adds Spark's default one), so that every
task opens the file system that Spark itself writes to.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    if not parts.scheme:
        raise ValueError(f"a path needs a scheme: {uri}")
    return unquote(parts.path) if parts.scheme == "file" else None


@contextlib.contextmanager
def created(uri: str) -> Iterator[BinaryIO]:
    """A new file; names must differ between task attempts, as a late one may still write."""
    local = _local(uri)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as file:
            yield file
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path) as file:
        yield file


def opened(uri: str) -> BinaryIO:
    """A file to read from, with ``seek``."""
    local = _local(uri)
    if local is not None:
        return open(local, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
