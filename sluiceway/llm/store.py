"""Files that Python workers write and read in the shared folder."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse


def open_write(uri: str):
    """A new binary file; its folder is made where need be."""
    kind, path = _place(uri)
    if kind is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    kind.create_dir(os.path.dirname(path), recursive=True)
    return kind.open_output_stream(path)


def open_read(uri: str):
    """A binary file that can seek."""
    kind, path = _place(uri)
    return open(path, "rb") if kind is None else kind.open_input_file(path)


def _place(uri: str):
    kind = urlparse(uri).scheme
    if not kind:
        raise ValueError(f"{uri} has no scheme: the driver qualifies paths, lest each executor take them for its own disk")
    if kind == "file":
        return None, unquote(urlparse(uri).path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
