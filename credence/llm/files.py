"""Files written by tasks: temporary names, a manifest stored by Spark, then a commit by renaming."""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, temp string, n_records long, bytes long, sha256 string"


def place(uri: str):
    """(file system, path) of a folder that all executors see: file, hdfs, s3 and what else pyarrow opens."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class RollingFiles:
    """Writes byte strings under temporary names; a file ends when it is `roll` bytes long or on `end`."""

    def __init__(self, root: str, roll: int, suffix: str, opening: Callable[[str], bytes] = lambda name: b""):
        self.fs, self.path = place(root)
        self.roll, self.suffix, self.opening = roll, suffix, opening
        self.out = None
        self.done: list[tuple] = []

    def write(self, shard: int, data: bytes, records: int = 1) -> None:
        if self.out is None:
            if getattr(self, "shard", None) != shard:
                self.shard, self.number = shard, 0
            self.name = f"part-{shard:06d}-{self.number:05d}{self.suffix}"
            self.temp = f"_temporary/{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.path}/{self.temp}", compression=None)
            self.sha, self.size, self.records = hashlib.sha256(), 0, 0
            self._put(self.opening(self.name))
        self._put(data)
        self.records += records
        if self.size >= self.roll:
            self.end()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def end(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temp, self.records, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1

    def manifest(self) -> Iterator[pd.DataFrame]:
        rows, self.done = self.done, []
        if rows:
            yield pd.DataFrame(rows, columns=["name", "temp", "n_records", "bytes", "sha256"])


def commit(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """Run the writing tasks, store the manifest, then rename each file it lists.

    A retried or speculative writer leaves a temporary file that no manifest lists. Renaming is repeatable:
    a file whose final name is there already is left. Returns the stored manifest.
    """
    files.write.parquet(f"{root}/_manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")

    def rename(batches):
        fs, path = place(root)
        from pyarrow.fs import FileType
        for pdf in batches:
            for name, temp in zip(pdf["name"], pdf["temp"]):
                if fs.get_file_info(f"{path}/{name}").type == FileType.NotFound:
                    fs.move(f"{path}/{temp}", f"{path}/{name}")
            yield pdf[["name"]]

    spread(manifest).mapInPandas(rename, "name string").agg(F.count("*")).collect()
    return manifest


def spread(manifest: DataFrame) -> DataFrame:
    """A task for each few files."""
    return manifest.repartition(max(1, min(manifest.count(), 10_000)))


def read_files(manifest: DataFrame, root: str, schema: str, parse: Callable) -> DataFrame:
    """Rows that `parse(open file)` yields as pandas frames, a file at a time."""
    def run(batches):
        fs, path = place(root)
        for pdf in batches:
            for name in pdf["name"]:
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    yield from parse(f)

    return spread(manifest.select("name")).mapInPandas(run, schema)
