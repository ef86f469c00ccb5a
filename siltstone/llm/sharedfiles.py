"""Numpy arrays in the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import atexit
import contextlib
import fcntl
import hashlib
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_array(uri: str, array: np.ndarray) -> None:
    """Write atomically: a second attempt of a task replaces the file by an equal one."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        array.tofile(draft)
        os.replace(draft, path)
        return
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(array).data)
    store.move(draft, path)


def _copied(uri: str) -> str:
    """The path of this host's only copy of a file that isn't local, made by the first worker that needs it."""
    folder = os.path.join(tempfile.gettempdir(), "siltstone-maps")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, hashlib.sha256(uri.encode()).hexdigest())
    with open(f"{path}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(path):
            store, remote = fs.FileSystem.from_uri(uri)
            draft = f"{path}.{uuid.uuid4().hex}"
            with open(draft, "wb") as out, store.open_input_stream(remote) as source:
                while chunk := source.read(1 << 22):
                    out.write(chunk)
            os.replace(draft, path)
            atexit.register(_unlink, path)  # who has it mapped keeps it
    return path


def _unlink(path: str) -> None:
    with contextlib.suppress(OSError):
        os.unlink(path)


def map_array(uri: str, dtype: type) -> np.ndarray:
    """A read-only map of a file; workers of a host share one copy of a file that isn't local."""
    path = _local(uri)
    if path is not None:
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    for _ in range(3):  # the worker that made the copy may end, and unlink it, in between
        with contextlib.suppress(FileNotFoundError):
            path = _copied(uri)
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    raise FileNotFoundError(uri)
