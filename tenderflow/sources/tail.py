"""Files that grow, read on from where the last batch ended: a streaming source with an offset for each file."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Seconds without a change after which a file counts as ended, and most bytes of one row.
IDLE, CHUNK = 900, 1_048_576
SCHEMA = "path string, start long, next long, content binary, ended boolean"


class Part(InputPartition):
    """Bytes of a file from start on; ended without any bytes tells that the file went quiet."""

    def __init__(self, path: str, start: int, stop: int, ended: bool):
        self.path, self.start, self.stop, self.ended = path, start, stop, ended


class TailReader(DataSourceStreamReader):
    """The offset of a batch is the size of every file, negative once the file has been idle: -(size + 1)."""

    def __init__(self, uri: str, idle: float, chunk: int):
        self.uri, self.idle, self.chunk = uri, idle, chunk

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = fs.FileSystem.from_uri(self.uri)
        now, out = datetime.fromtimestamp(time.time(), timezone.utc), {}
        for f in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")):
                quiet = f.mtime is not None and (now - f.mtime).total_seconds() >= self.idle
                out[f.path] = -(f.size + 1) if quiet else f.size
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for path, new in sorted(end.items()):
            old = start.get(path, 0)
            size, before = (new if new >= 0 else -new - 1), (old if old >= 0 else -old - 1)
            # a file that is shorter than before began anew
            low = 0 if size < before else before
            out += [Part(path, at, min(at + self.chunk, size), False) for at in range(low, size, self.chunk)]
            if new < 0 and (old >= 0 or size != before or path not in start):
                out.append(Part(path, size, size, True))
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        content = b""
        if partition.stop > partition.start:
            files, _ = fs.FileSystem.from_uri(self.uri)
            with files.open_input_file(partition.path) as f:
                content = f.read_at(partition.stop - partition.start, partition.start)
        yield partition.path, partition.start, partition.start + len(content), content, partition.ended

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    """Format "tail"; options path (a folder as a URI that every executor can open), idle (seconds) and chunk (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TailReader(self.options["path"], float(self.options.get("idle", IDLE)), int(self.options.get("chunk", CHUNK)))


def tailed(spark: SparkSession, folder: str, idle: float = IDLE, chunk: int = CHUNK) -> DataFrame:
    """path, start, next, content and ended of a stream over the files of a folder: each batch has what is new in each file.

    What a file had when a batch was planned is its offset, kept in the checkpoint of the query, so a restarted query goes on
    where it stopped. A file that became shorter is read from its beginning. Long additions are dealt into chunks that tasks
    read by themselves; only names and sizes come to the driver. A file without a change for `idle` seconds gives one row
    with ended and no content; if it grows again it goes on. Files whose names begin with a dot or underscore are left out.
    """
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("path", folder).option("idle", str(idle)).option("chunk", str(chunk)).load()
