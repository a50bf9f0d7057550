"""Recordings as a data source: ``spark.read.format("recordings").load(folder)`` and ``df.write.format("recordings")``.

A partition of the reader is one .npz file.  A writing task puts its recordings
into a folder of its own attempt; the job's commit moves the files of the tasks
that succeeded into the folder, an abort removes them, so a lost task leaves
nothing behind.  Paths are any that pyarrow's file systems reach; for stores that
only Spark's own readers reach there is :func:`arterion.sources.files.read_recordings`.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from arterion.sources.files import RECORDING, recording_bytes, recording_of

FORMAT = "recordings"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class FilePart(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class RecordingReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[FilePart]:
        store, folder = store_of(self.folder)
        found = store.get_file_info(fs.FileSelector(folder, recursive=False))
        return [FilePart(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".npz")]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        if partition is None or partition.path is None:
            return
        store, _ = store_of(self.folder)
        with store.open_input_stream(partition.path) as f:
            yield recording_of(partition.path, f.read())


class RecordingWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def _temporary(self) -> tuple[fs.FileSystem, str, str]:
        store, folder = store_of(self.folder)
        return store, folder, f"{folder}/_temporary-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, _, temporary = self._temporary()
        own, paths = f"{temporary}/{uuid.uuid4().hex}", []
        store.create_dir(own, recursive=True)
        for row in iterator:
            name, content = recording_bytes(row)
            paths.append(f"{own}/{name}")
            with store.open_output_stream(paths[-1]) as f:
                f.write(content)
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder, temporary = self._temporary()
        names = [(p, p.rsplit("/", 1)[-1]) for m in messages if m for p in m.paths]
        if len({n for _, n in names}) < len(names):
            self.abort(messages)
            raise ValueError("recordings of one name were written twice")
        if self.overwrite:
            keep = {n for _, n in names}
            for f in store.get_file_info(fs.FileSelector(folder, recursive=False)):
                if f.is_file and f.path.endswith(".npz") and f.base_name not in keep:
                    store.delete_file(f.path)
        for path, name in names:
            store.move(path, f"{folder}/{name}")
        store.delete_dir(temporary) if names or store.get_file_info(temporary).type != fs.FileType.NotFound else None

    def abort(self, messages: list[Written | None]) -> None:
        store, _, temporary = self._temporary()
        if store.get_file_info(temporary).type != fs.FileType.NotFound:
            store.delete_dir(temporary)


class RecordingSource(DataSource):
    """Recordings (files.RECORDING), one .npz file each."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return RECORDING

    def reader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(RecordingSource)
