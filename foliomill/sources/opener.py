"""Opening files inside tasks, on whatever filesystem the session's paths name."""

from __future__ import annotations

from collections.abc import Callable
from typing import BinaryIO
from urllib.parse import unquote

from pyarrow.fs import FileSystem, HadoopFileSystem, LocalFileSystem

# An opener gets a path as a scan lists it and returns a binary stream.
Opener = Callable[[str], BinaryIO]

# Schemes that Hadoop knows by a name of its own, and those only Hadoop's client opens.
SAME_AS = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}
HADOOP = ("hdfs", "viewfs")


def filesystem_of(path: str) -> tuple[FileSystem, str]:
    """The filesystem of a path, and the path within it.

    A path without a scheme is local, and ``dbfs:`` is where its mount is; ``hdfs`` and ``viewfs`` go through Hadoop's own
    client with the site's settings.
    """
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return LocalFileSystem(), path
    if scheme == "file":
        return LocalFileSystem(), "/" + unquote(rest).lstrip("/")
    if scheme == "dbfs":
        return LocalFileSystem(), "/dbfs/" + unquote(rest).lstrip("/")
    if scheme in HADOOP:
        host, _, inner = rest.removeprefix("//").partition("/")
        return HadoopFileSystem(f"{scheme}://{host}" if host else "default"), "/" + unquote(inner)
    return FileSystem.from_uri(f"{SAME_AS.get(scheme, scheme)}:{rest}")


def open_file(path: str) -> BinaryIO:
    filesystem, inner = filesystem_of(path)
    return filesystem.open_input_stream(inner)
