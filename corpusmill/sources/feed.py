"""A streaming data source over files that grow: ``byte_feed``.

Offsets are the bytes read of every file, so a query that starts again from its checkpoint
reads each byte once.  Tasks read ranges of files, no file is read on the driver.  With
``idle`` or ``overall`` seconds the stream ends in an error when no file grew, or it ran, for longer.

Files only grow; one that shrank or went is an error, as bytes of the past could not be read again.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

# Seconds without a byte, and in all.
IDLE, OVERALL = 10.0, 120.0
PIECE, RANGE = 1 << 16, 64 << 20  # bytes of a row, and of a task


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files, self.root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.idle, self.overall = float(options.get("idle", IDLE)), float(options.get("overall", OVERALL))
        self.range = int(options.get("range", RANGE))
        self.began = self.grew = time.monotonic()
        self.sizes: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        now = time.monotonic()
        sizes = {f.path: f.size for f in self.files.get_file_info(fs.FileSelector(self.root)) if f.is_file and not f.base_name.startswith((".", "_"))}
        if sizes != self.sizes:
            self.sizes, self.grew = sizes, now
        if now - self.grew > self.idle:
            raise TimeoutError("no byte came within the idle deadline")
        if now - self.began > self.overall:
            raise TimeoutError("the stream ran longer than its deadline")
        return dict(sorted(sizes.items()))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lost = [p for p, n in start.items() if end.get(p, -1) < n]
        if lost:
            raise ValueError(f"{len(lost)} files shrank or went")
        out: list[InputPartition] = []
        for path, size in end.items():
            for at in range(start.get(path, 0), size, self.range):
                out.append(Range(path, at, min(at + self.range, size)))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:  # type: ignore[override]
        with self.files.open_input_file(partition.path) as file:
            at = partition.start
            while at < partition.end:
                raw = file.read_at(min(PIECE, partition.end - at), at)
                if not raw:
                    raise EOFError("a file is shorter than its offset")
                yield (partition.path.rsplit("/", 1)[-1], at, raw)
                at += len(raw)

    def commit(self, end: dict) -> None:
        pass


class ByteFeed(DataSource):
    """(file, offset, content) of files below ``path`` that grow."""

    @classmethod
    def name(cls) -> str:
        return "byte_feed"

    def schema(self) -> str:
        return "file string, offset long, content binary"

    def streamReader(self, schema: StructType) -> FeedReader:  # noqa: N802
        return FeedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ByteFeed)
