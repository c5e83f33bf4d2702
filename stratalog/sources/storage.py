"""Files on storage as tasks open them: by range, as a stream."""

from __future__ import annotations

import re

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as Spark writes it (nothing in it is escaped), and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    remote = re.match(r"(\w+://[^/]*)(.*)", path, re.DOTALL)
    if not remote:
        return fs.LocalFileSystem(), path
    system, root = fs.FileSystem.from_uri(remote[1] + "/")
    return system, root.rstrip("/") + remote[2]
