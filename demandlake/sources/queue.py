"""A durable message queue in a shared folder (A17): a Spark data source.

Writing (batch or stream, ``df.write.format("request_queue")``): every task
puts its messages, a JSON line each, into a file of its own; the commit names
all files of the write in one new log entry ``log/<number>``, and only that
makes them visible.  A failed write leaves files that no entry names.

Reading (``spark.readStream.format("request_queue")``): an offset is the number
of a log entry.  Spark keeps offsets in the query's checkpoint and commits
them after the sink has finished the micro-batch; the commit moves the queue's
``acked`` pointer.  A batch whose sink failed is delivered again, by the
checkpoint or, where that is lost, from the pointer on: delivery is at least
once, a sink that overwrites its epoch makes it once.  Entries are partitions,
a file is read line by line.

Options: ``path`` (local or any URI that pyarrow's file systems know), ``consumer``
(name of the pointer, default ``default``).  Rows have the schema given to the
reader; a line that is not JSON, or a field of another type, gives nulls.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceStreamReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage,
)

NAME = "request_queue"


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path


def _entries(path: str) -> list[int]:
    files, base = _open(path)
    found = files.get_file_info(arrow_fs.FileSelector(f"{base}/log", allow_not_found=True))
    return sorted(int(f.base_name) for f in found if f.base_name.isdigit())


def _put(files: arrow_fs.FileSystem, target: str, data: bytes) -> None:
    """The file appears whole or not at all."""
    part = f"{target}.{uuid.uuid4().hex[:8]}.part"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, target)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer:
    """Both writers: ``write`` runs in the tasks, ``commit`` on the driver."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator) -> Written:
        files, base = _open(self.path)
        name, out, empty = f"data/{uuid.uuid4().hex}.jsonl", None, True
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.create_dir(f"{base}/data", recursive=True)
                    out, empty = files.open_output_stream(f"{base}/{name}"), False
                out.write(json.dumps(row, default=str, ensure_ascii=False).encode() + b"\n")
        if out is not None:
            out.close()
        return Written([] if empty else [name])

    def _append(self, messages: list[Written | None], number: int | None) -> None:
        named = [f for m in messages if m is not None for f in m.files]
        files, base = _open(self.path)
        files.create_dir(f"{base}/log", recursive=True)
        entries = _entries(self.path)
        if named and (number is None or number not in entries):
            entry = max(entries, default=-1) + 1 if number is None else number
            _put(files, f"{base}/log/{entry}", "\n".join(named).encode())

    def _discard(self, messages: list[Written | None]) -> None:
        files, base = _open(self.path)
        for m in messages:
            for f in m.files if m is not None else ():
                files.delete_file(f"{base}/{f}")


class QueueWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        self._append(messages, None)

    def abort(self, messages) -> None:
        self._discard(messages)


class QueueStreamWriter(_Writer, DataSourceStreamArrowWriter):
    """A stream is the only writer of its queue: epoch N is entry N, so an
    epoch that is committed again adds nothing."""

    def commit(self, messages, batchId: int) -> None:
        self._append(messages, batchId)

    def abort(self, messages, batchId: int) -> None:
        self._discard(messages)


class Entry(InputPartition):
    def __init__(self, file: str):
        self.file = file


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.consumer, self.schema = options["path"], options.get("consumer", "default"), schema

    def _pointer(self) -> tuple[arrow_fs.FileSystem, str]:
        files, base = _open(self.path)
        return files, f"{base}/acked-{self.consumer}"

    def initialOffset(self) -> dict:
        files, pointer = self._pointer()
        if files.get_file_info(pointer).type == arrow_fs.FileType.NotFound:
            return {"next": 0}
        with files.open_input_stream(pointer) as held:
            return {"next": int(held.read())}

    def latestOffset(self) -> dict:
        return {"next": max(_entries(self.path), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Entry]:
        files, base = _open(self.path)
        out = []
        for n in _entries(self.path):
            if start["next"] <= n < end["next"]:
                with files.open_input_stream(f"{base}/log/{n}") as held:
                    out += [Entry(name) for name in held.read().decode().split("\n") if name]
        return out

    def read(self, partition: Entry) -> Iterator[tuple]:
        files, base = _open(self.path)
        with files.open_input_stream(f"{base}/{partition.file}") as held:
            rest = b""
            while chunk := held.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    yield _row(line, self.schema)
            if rest:
                yield _row(rest, self.schema)

    def commit(self, end: dict) -> None:
        files, pointer = self._pointer()
        if end["next"] > self.initialOffset()["next"]:
            _put(files, pointer, str(end["next"]).encode())


_KINDS = {T.LongType: int, T.IntegerType: int, T.DoubleType: (int, float), T.StringType: str, T.BooleanType: bool}


def _row(line: bytes, schema: T.StructType) -> tuple:
    try:
        held = json.loads(line)
    except ValueError:
        held = None
    held = held if isinstance(held, dict) else {}
    out = []
    for f in schema.fields:
        value, kind = held.get(f.name), _KINDS.get(type(f.dataType))
        if value is None or kind is None or not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
            out.append(None)
        else:
            out.append(float(value) if isinstance(f.dataType, T.DoubleType) else value)
    return tuple(out)


class RequestQueue(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        from demandlake.streaming.requests import MESSAGE_SCHEMA
        return MESSAGE_SCHEMA

    def streamReader(self, schema: T.StructType) -> QueueReader:
        return QueueReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> QueueWriter:
        if overwrite:
            raise ValueError("messages are appended to a queue")
        return QueueWriter(self.options)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> QueueStreamWriter:
        return QueueStreamWriter(self.options)


def register(spark: SparkSession) -> str:
    """Make the source known to ``spark``; returns its format name."""
    spark.dataSource.register(RequestQueue)
    return NAME
