"""A streaming source that follows growing tab-separated logs.

The offset is, per file, the byte after the last complete line. Executors read byte ranges of the files themselves, so
a batch is never held on the driver, and a restart continues from the checkpointed bytes. The path must be visible to
driver and executors alike (a shared mount). For logs that are rotated into a folder and never change afterwards, the
built-in text source is enough.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "log_tail"


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def complete_size(path: str, block: int = 1 << 16) -> int:
    """Bytes up to and including the last newline."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            start = max(0, at - block)
            f.seek(start)
            cut = f.read(at - start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            at = start
    return 0


def lines_between(path: str, start: int, end: int) -> Iterator[bytes]:
    """Lines that begin in [start, end). A range that begins inside a line leaves that line to its predecessor."""
    with open(path, "rb") as f:
        if start > 0:
            f.seek(start - 1)
            if f.read(1) != b"\n":
                f.readline()
        while f.tell() < end:
            yield f.readline()


class LogTailReader(DataSourceStreamReader):
    def __init__(self, path: str, fields: int, split_bytes: int):
        self.path, self.fields, self.split_bytes = path, fields, split_bytes
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """A file that shrank keeps its offset: nothing is read until it has outgrown it."""
        for p in sorted(glob.glob(self.path)):
            if os.path.isfile(p):
                self.seen[p] = max(self.seen.get(p, 0), complete_size(p))
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        out = []
        for p, stop in end.items():
            at = start.get(p, 0)
            while at < stop:
                nxt = min(at + self.split_bytes, stop)
                out.append(ByteRange(p, at, nxt))
                at = nxt
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        if not partition.path:
            return
        for raw in lines_between(partition.path, partition.start, partition.end):
            line = raw.decode("utf-8", errors="ignore").rstrip("\r\n")
            if not line or line.startswith("#"):
                continue
            cells = line.split("\t")[: self.fields]
            yield tuple(cells + [None] * (self.fields - len(cells)))


class LogTailSource(DataSource):
    """Options: ``path`` (file or glob), ``split_bytes``. The schema names the log's fields, all strings."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema) -> LogTailReader:
        split = int(self.options.get("split_bytes", str(64 << 20)))
        return LogTailReader(self.options["path"], len(schema.fields), split)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTailSource)


def tail_log(spark: SparkSession, path: str, fields: list[str], split_bytes: int = 64 << 20):
    """Streaming table over growing logs; ``fields`` are the names of the ``#fields`` header."""
    register(spark)
    schema = ", ".join(f"`{f}` string" for f in fields)
    return spark.readStream.format(NAME).schema(schema).option("path", path).option("split_bytes", str(split_bytes)).load()
