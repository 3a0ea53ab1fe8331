"""Framed binary logs as a source and a sink.

Reading goes through Spark's binaryFile source, so any file system that Spark reads will do;
a segment is one file and is decoded by one task, record by record; segments are rotated long
before the 2 GB that this source reads of a file.  A record that is short, fails
its checksum or is malformed ends its segment: it appears once with ``crc_ok`` false, what
lies behind it doesn't appear.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lamina import schema

MAX_COMMAND = 64 << 20
#: Records of one Arrow batch.
ROWS = 10_000
# Magic and version of a replicated log file, then two numbers of a snapshot.
RAFT_HEADER = (0x5658524C, 1)


def records(data: bytes, at: int, least: int) -> Iterator[bytes | None]:
    """Payloads of the valid prefix; None once for what ends it early."""
    while at < len(data):
        if at + 8 > len(data):
            yield None
            return
        size, crc = struct.unpack_from(">II", data, at)
        payload = data[at + 8 : at + 8 + size]
        if size < least or len(payload) < size or zlib.crc32(payload) != crc:
            yield None
            return
        yield payload
        at += 8 + size


def mutation(payload: bytes) -> tuple[int, bytes, bool, bytes] | None:
    """(seq, key, deleted, value), or None if malformed; bytes after the value are ignored."""
    if len(payload) < 17 or payload[0] not in (1, 2):
        return None
    seq, n = struct.unpack_from(">QI", payload, 1)
    if 13 + n + 4 > len(payload):
        return None
    (m,) = struct.unpack_from(">I", payload, 13 + n)
    if 17 + n + m > len(payload):
        return None
    return seq, payload[13 : 13 + n], payload[0] == 2, payload[17 + n : 17 + n + m]


def _decoded(files: DataFrame, ddl: str, names: list[str], rows: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [f.type for f in arrow]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                decoded = rows(path, content.as_py())
                # records leave as they are decoded; only the segment's bytes are held
                while part := list(islice(decoded, ROWS)):
                    columns = zip(*part, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    return files.select("path", "content").mapInArrow(run, ddl)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ``*.wal`` segments below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").option("recursiveFileLookup", "true").load(path)
    return _decoded(files, schema.FRAMES, _WAL_COLUMNS, _wal_rows)


def tail_wal(spark: SparkSession, path: str, most_files: int = 64) -> DataFrame:
    """The same as a stream over the segments of a folder; segments are closed before they appear in it."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    files = reader.option("pathGlobFilter", "*.wal").option("maxFilesPerTrigger", most_files).load(path)
    return _decoded(files, schema.FRAMES, _WAL_COLUMNS, _wal_rows)


_WAL_COLUMNS = ["segment", "pos", "seq", "key", "deleted", "value", "crc_ok"]


def _wal_rows(name: str, data: bytes) -> Iterator[tuple]:
    segment = name.rsplit("/", 1)[-1]
    for pos, payload in enumerate(records(data, 0, 0)):
        m = mutation(payload) if payload is not None else None
        if m is None:
            yield segment, pos, None, None, None, None, False
            return
        yield segment, pos, *m, True


def read_raft_log(spark: SparkSession, path: str) -> DataFrame:
    """The valid prefix of replicated log files; a file of another kind or version has no entries."""

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        if len(data) < 24 or struct.unpack_from(">II", data) != RAFT_HEADER:
            return
        for pos, payload in enumerate(records(data, 24, 24)):
            if payload is None:
                return
            term, idx, size = struct.unpack_from(">QQQ", payload)
            if size > MAX_COMMAND or 24 + size != len(payload):
                return
            yield name, pos, idx, term, payload[24:]

    files = spark.read.format("binaryFile").load(path)
    return _decoded(files, schema.RAFT_FRAMES, ["path", "pos", "idx", "term", "command"], rows)


def raft_header(snapshot_index: int = 0, snapshot_term: int = 0) -> bytes:
    return struct.pack(">IIQQ", *RAFT_HEADER, snapshot_index, snapshot_term)


class FramedSink(DataSource):
    """``df.write.format("framed").mode("append").save(folder)``: a ``record`` binary column, one segment a task.

    Files are written aside, and renamed when the job commits; a failed job leaves none.
    """

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return "record binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FramedWriter(self.options["path"])


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _FramedWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith(("/", "file:")) else f"/{self.path}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        files, folder = self._files()
        c = TaskContext.get()
        path = f"{folder}/{c.partitionId():08d}-{c.taskAttemptId()}.wal"
        out = None
        for batch in batches:
            if batch.num_rows:
                if out is None:
                    files.create_dir(folder)
                    out = files.open_output_stream(f"{path}.tmp")
                for record in batch.column(0):
                    out.write(record.as_py())
        if out is None:
            return _Written(None)
        out.close()
        return _Written(path)

    def commit(self, messages: list) -> None:
        files, _ = self._files()
        for m in messages:
            if m is not None and m.path:
                files.move(f"{m.path}.tmp", m.path)

    def abort(self, messages: list) -> None:
        files, _ = self._files()
        for m in messages:
            if m is not None and m.path:
                files.delete_file(f"{m.path}.tmp")


def write_frames(rows: DataFrame, path: str) -> None:
    """Append the ``record`` column of ``rows`` as framed segments."""
    rows.sparkSession.dataSource.register(FramedSink)
    rows.select(F.col("record").cast("binary").alias("record")).write.format("framed").mode("append").save(path)
