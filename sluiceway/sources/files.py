"""Files and folders by path or URI: local ones directly, others through pyarrow."""

from __future__ import annotations

import os
import shutil
from typing import Any
from urllib.parse import unquote, urlparse


def _place(uri: str) -> tuple[Any, str]:
    if urlparse(uri).scheme in ("", "file"):
        return None, unquote(urlparse(uri).path) if uri.startswith("file:") else os.path.abspath(uri)
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def absolute(uri: str) -> str:
    return _place(uri)[1] if urlparse(uri).scheme in ("", "file") else uri.rstrip("/")


def qualified(spark: Any, uri: str) -> str:
    """A path without scheme as Spark takes it: on the default file system, be that local or not."""
    if urlparse(uri).scheme:
        return absolute(uri)
    where = spark._jvm.org.apache.hadoop.fs.Path(uri)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return absolute(uri if found.startswith("file:") else found)


def moves_are_cheap(uri: str) -> bool:
    """Whether a file or folder is moved without being copied, as in file systems but not in object stores."""
    return urlparse(uri).scheme in ("", "file", "hdfs", "viewfs")


def names(uri: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    kind, path = _place(uri)
    if kind is None:
        return os.listdir(path) if os.path.isdir(path) else []
    from pyarrow import fs

    return [x.base_name for x in kind.get_file_info(fs.FileSelector(path, allow_not_found=True))]


def remove_file(uri: str) -> None:
    kind, path = _place(uri)
    os.remove(path) if kind is None else kind.delete_file(path)


def exists(uri: str) -> bool:
    kind, path = _place(uri)
    if kind is None:
        return os.path.exists(path)
    from pyarrow import fs

    return kind.get_file_info(path).type != fs.FileType.NotFound


def make_dir(uri: str) -> None:
    kind, path = _place(uri)
    os.makedirs(path, exist_ok=True) if kind is None else kind.create_dir(path, recursive=True)


def remove_dir(uri: str) -> None:
    kind, path = _place(uri)
    if kind is None:
        shutil.rmtree(path, ignore_errors=True)
    elif exists(uri):
        kind.delete_dir(path)


def move(a: str, b: str) -> None:
    kind, path = _place(a)
    os.rename(path, _place(b)[1]) if kind is None else kind.move(path, _place(b)[1])


def open_write(uri: str) -> Any:
    kind, path = _place(uri)
    return open(path, "wb") if kind is None else kind.open_output_stream(path)


def open_read(uri: str) -> Any:
    kind, path = _place(uri)
    return open(path, "rb") if kind is None else kind.open_input_file(path)
