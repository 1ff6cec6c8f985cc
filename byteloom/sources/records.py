"""Files of fixed-width records as a data source and sink.

    spark.dataSource.register(RecordSource)
    spark.read.format("records").option("layout", "id:long,price:double,tags:short:4").load(folder)
    df.write.format("records").option("layout", ...).mode("append").save(folder)

A file is split at record boundaries, so that a large one is read by many tasks, each of which reads its own bytes in buffers. The last record of a file must be whole."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from byteloom._ship import by_value
from byteloom.operators.layout import END_OF_STREAM, Layout, from_arrow, to_arrow

by_value(__name__)

SPLIT_BYTES, BUFFER_BYTES = 64 << 20, 4 << 20


def local(path: str) -> str:
    """Paths are those of a file system that all executors have mounted."""
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def files(path: str) -> list[str]:
    """The file, or the folder's files; names that start with a dot or underscore are none."""
    path = local(path)
    if os.path.isfile(path):
        return [path]
    found = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f[0] not in "._"]
    return sorted(found)


@dataclass
class Split(InputPartition):
    path: str
    offset: int
    length: int


class ChunkedReader:
    """Reads a range of a file in buffers; what is in the buffer already isn't read again."""

    def __init__(self, load, size: int, buffer: int):
        self.load, self.size, self.start, self.data = load, size, 0, b""
        self.buffer = max(buffer, min(size, 128))
        self.loads = 0

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise IndexError(END_OF_STREAM)
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            have = self.data[at - self.start :] if self.start <= at < self.start + len(self.data) else b""
            want = min(max(n, self.buffer), self.size - at)
            self.data = have + self.load(at + len(have), want - len(have))
            self.start = at
            self.loads += 1
        return self.data[at - self.start : at - self.start + n]


class RecordReader(DataSourceReader):
    def __init__(self, layout: Layout, path: str, split: int):
        self.layout, self.path, self.split = layout, path, max(1, split // layout.width) * layout.width

    def partitions(self) -> list[Split]:
        out = []
        for p in files(self.path):
            size = os.path.getsize(p)
            if size % self.layout.width:
                raise ValueError(f"{END_OF_STREAM}: {p} has {size} bytes, records have {self.layout.width}")
            out += [Split(p, a, min(self.split, size - a)) for a in range(0, size, self.split)]
        return out or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.length:
            return
        with open(partition.path, "rb", buffering=0) as f:

            def load(at: int, n: int) -> bytes:
                f.seek(partition.offset + at)
                parts = []
                while n:
                    got = f.read(n)
                    if not got:
                        raise IndexError(END_OF_STREAM)
                    parts.append(got)
                    n -= len(got)
                return b"".join(parts)

            own = ChunkedReader(load, partition.length, BUFFER_BYTES)
            step = max(1, BUFFER_BYTES // self.layout.width) * self.layout.width
            for at in range(0, partition.length, step):
                yield to_arrow(np.frombuffer(own.read(at, min(step, partition.length - at)), self.layout.dtype), self.layout)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class RecordWriter(DataSourceArrowWriter):
    """Each task writes a file of its own under a hidden name; they get their names when all have ended, so that a task run twice counts once."""

    def __init__(self, layout: Layout, path: str, overwrite: bool):
        self.layout, self.path, self.overwrite, self.job = layout, local(path), overwrite, uuid.uuid4().hex
        self.old = files(self.path) if overwrite and os.path.isdir(self.path) else []
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        final = os.path.join(self.path, f"part-{task.partitionId():05d}-{self.job}.bin")
        temporary = os.path.join(self.path, f"._{self.job}-{task.partitionId()}-{task.taskAttemptId()}")
        with open(temporary, "wb", buffering=BUFFER_BYTES) as f:
            for b in iterator:
                f.write(from_arrow(b, self.layout).tobytes())
        return Written(temporary, final)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.final) if os.path.getsize(m.temporary) else os.remove(m.temporary)
        for p in self.old:
            os.remove(p)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class RecordSource(DataSource):
    """Options: ``layout`` (see Layout.parse), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def layout(self) -> Layout:
        return Layout.parse(self.options["layout"])

    def schema(self) -> StructType:
        return self.layout().schema

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.layout(), self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        missing = [f.name for f in self.layout().fields if f.kind != "skip" and f.name not in schema.names]
        if missing:
            raise ValueError(f"the layout's fields {missing} aren't among the columns")
        return RecordWriter(self.layout(), self.options["path"], overwrite)


def read_binary_files(spark, path: str):
    """(path, content) of whole files, of any size a cell can hold."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
