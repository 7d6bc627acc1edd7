"""Writing binary files from tasks into the shared folder.

The folder is a URI (a shared mount, HDFS, an object store); pyarrow opens it by its scheme. A
file is written under a temporary name and moved to its place when it is whole, so a task that is
repeated on another executor replaces it by the same content. Files are read back by Spark's
binaryFile source.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


class WholeFile:
    """A binary file that appears under its name on a clean exit only."""

    def __init__(self, folder: str, name: str):
        self.fs, path = fs.FileSystem.from_uri(folder)
        self.path, self.draft = f"{path}/{name}", f"{path}/_{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(path, recursive=True)

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.draft)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.draft, self.path)
        else:
            self.fs.delete_file(self.draft)


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def made(folder: str) -> str:
    """The folder's URI; it is made at once, so that it can be read if no task has a row to write."""
    folder = as_uri(folder)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return folder


def read_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")
