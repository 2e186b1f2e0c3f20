"""Files that tasks open by themselves, wherever Spark keeps them."""

from __future__ import annotations

import re

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (file:/x, s3a://…, hdfs://…, /x), and the path in it."""
    if re.match(r"file:/(?!//)", uri):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))
