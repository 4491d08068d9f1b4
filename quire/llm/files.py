"""Arrays as files in the shared folder, written by tasks and mapped by workers."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np

#: Schemes of Hadoop's connectors, and what the Arrow file systems call the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def _local(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path; None for another store."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _store(folder: str):
    """The Arrow file system of a URI, and the path in it."""
    from pyarrow import fs

    scheme, rest = folder.split(":", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def write_array(folder: str, name: str, array: np.ndarray) -> None:
    """Write ``array`` under ``name``; a repeated or concurrent attempt leaves one whole file."""
    own = f".{name}-{uuid.uuid4().hex}"
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        array.tofile(f"{path}/{own}")
        os.replace(f"{path}/{own}", f"{path}/{name}")
        return
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/{own}") as out:
        out.write(array.tobytes())
    store.move(f"{at}/{own}", f"{at}/{name}")


def map_array(folder: str, name: str, kind: np.dtype) -> np.ndarray:
    """Map an array that ``write_array`` wrote; empty where there is none.

    A file of a store that can't be mapped is read into the worker's memory; nothing is put on local disks.
    """
    if (path := _local(folder)) is not None:
        path = f"{path}/{name}"
        return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)
    from pyarrow import fs

    store, at = _store(folder)
    if store.get_file_info(f"{at}/{name}").type == fs.FileType.NotFound:
        return np.zeros(0, kind)
    with store.open_input_file(f"{at}/{name}") as source:
        return np.frombuffer(source.read(), kind)
