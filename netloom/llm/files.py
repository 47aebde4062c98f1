"""Files that tasks write into a shared folder, named by a table that Spark commits.

A task writes under a name of its own attempt and returns that name; only rows of attempts that
succeeded reach the manifest, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import math
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame

#: Files that a task reads where there are more files than tasks at a time.
FILES_A_TASK = 4


def _place(url: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder; local folders come as /x, file:/x or file:///x."""
    if url.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + url.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(url)


def dealt(files: DataFrame, n_files: int) -> DataFrame:
    """The rows of a list of files over many tasks. Their number is given, as adaptive execution would put so few bytes into one task."""
    at_once = 2 * files.sparkSession.sparkContext.defaultParallelism
    return files.repartitionByRange(max(1, min(n_files, at_once), math.ceil(n_files / FILES_A_TASK)), "file")


def write_file(folder: str, suffix: str, data: bytes) -> str:
    """Write ``data`` as a new file of ``folder`` and return its name."""
    files, path = _place(folder)
    name = uuid.uuid4().hex + suffix
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return name


def read_file(folder: str, name: str) -> bytes:
    files, path = _place(folder)
    with files.open_input_stream(f"{path}/{name}", compression=None) as source:
        return source.read()
