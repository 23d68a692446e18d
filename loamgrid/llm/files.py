"""Files that tasks write into the shared folder, whatever store it lies in."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """Writes under another name first, so that a task that is lost or run twice leaves whole files only."""
    store, p = _store(path)
    store.create_dir(posixpath.dirname(p), recursive=True)
    part = f"{posixpath.dirname(p)}/.{posixpath.basename(p)}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, p)


def get(path: str, start: int = 0, length: int | None = None) -> bytes:
    """A range of a file."""
    store, p = _store(path)
    with store.open_input_file(p) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()
