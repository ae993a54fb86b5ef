"""Files of the shared folder as executors and the driver open them outside Spark's readers."""

from __future__ import annotations

import re


def filesystem(path: str):
    """(pyarrow filesystem, path in it) of a folder or file."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)
