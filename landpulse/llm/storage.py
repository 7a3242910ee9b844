"""Tables and binary files in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from landpulse.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: later uses neither
    recompute it nor depend on the executors that made it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(files: DataFrame, key: str) -> DataFrame:
    """Short rows that each stand for a large file, over as many tasks as a shuffle has: with a
    number given, adaptive execution does not put them together for being short."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def new_folder(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, label)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = re.sub("^file:/+", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


class whole_file:
    """Output stream whose file appears under its name only when complete, so that a task that
    is lost or runs twice leaves the same single file."""

    def __init__(self, path: str):
        self.fs, self.path = _place(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.part)
        return self.stream

    def __exit__(self, kind, *rest):
        self.stream.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def open_file(path: str):
    fs, place = _place(path)
    return fs.open_input_file(place)
