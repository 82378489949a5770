"""Binary files in the shared folder, streamed from Python tasks.

Tasks write each file under a name of their own (one per attempt) and report it in
the rows they return; only files that a finished task reported are ever read, so a
retried or speculative task leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs) or of a plain local path."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def create(folder: str, name: str):
    """A new file ``name`` plus a random part in ``folder``: its path and the stream to write."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    system, inner = opened(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return path, system.open_output_stream(inner, buffer_size=1 << 20)


def stream(path: str, buffer_size: int = 1 << 20):
    system, inner = opened(path)
    return system.open_input_stream(inner, buffer_size=buffer_size)


def seekable(path: str):
    system, inner = opened(path)
    return system.open_input_file(inner)
