"""Files in the shared folder, opened by tasks through pyarrow's file systems."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def open_new(folder: str, suffix: str):
    """A new file of a name no other attempt uses, and its URI.  Only names that a task
    returns count, so files of failed or repeated attempts are never read."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return store.open_output_stream(posixpath.join(path, name), compression=None), f"{folder.rstrip('/')}/{name}"


def open_old(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
