"""Files in the shared folder, read and written by tasks."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path."""
    return fs.FileSystem.from_uri(path)


def create(folder: str, stem: str, suffix: str):
    """A new file in `folder`; (path, output stream). Each attempt of a task
    gets a name of its own, so a repeated task never touches a file that a
    manifest names already."""
    system, root = resolve(folder)
    system.create_dir(root, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{root}/{name}", compression=None)


def open_read(path: str):
    """A stream over a file; a local file is memory-mapped."""
    system, at = resolve(path)
    if isinstance(system, fs.LocalFileSystem):
        return pa.memory_map(at) if system.get_file_info(at).size else pa.BufferReader(b"")
    return system.open_input_file(at)
