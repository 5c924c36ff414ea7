"""Files that tasks write to and read from a folder all executors share."""

from __future__ import annotations

from uuid import uuid4

from pyarrow import fs
from pyspark.sql import SparkSession

from lexitag.operators.lasting import checkpoint_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's checkpoint folder, as a URI or path."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid4().hex}"


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (local, HDFS, S3 ..., by its scheme) and the path in it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class Rewritten:
    """A file that appears under its name only when complete, so that a task's retry can write it again."""

    def __init__(self, folder: str, name: str):
        self.system, self.path = open_folder(folder)
        self.system.create_dir(self.path, recursive=True)
        self.name = name
        self.own = f"{self.path}/.{name}.{uuid4().hex}"
        self.stream = self.system.open_output_stream(self.own, compression=None)

    def write(self, data) -> None:
        self.stream.write(data)

    def done(self) -> None:
        self.stream.close()
        self.system.move(self.own, f"{self.path}/{self.name}")
