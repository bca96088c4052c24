"""Shared helpers: table access, staging in the shared folder, words and hashes.

Staged tables are plain Parquet in the folder named by ``spark.checkpoint.dir``,
so a lost executor only repeats the tasks that read them.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of one Arrow batch between Spark and Python: a batch lies in both at once, for every task of an executor.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 2048
ROW_GROUP_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep this session's buffers outside the heap small: Arrow batches, and whole column chunks read in one go.

    Vectored reads keep a direct buffer of a chunk's size for each reading thread.
    """
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int("".join(c for c in spark.conf.get(key) if c.isdigit()) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, as in tests of one JVM, a folder beside the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/corpusmill/{label}-{uuid.uuid4().hex}"
    # a task's open row group lies in its executor's heap, so it is kept small
    writer = df.write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP_BYTES))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, or the first like it that no column has."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


#: Most rows of a join's other side that are broadcast because their keys are hot.
HOT_KEYS = 10_000


def hot_join(left: DataFrame, right: DataFrame, key: str, uses: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, whose keys are unique and which tells in ``uses`` how many rows of ``left`` have each.

    A key with more than a ``HOT_KEYS``-th of the ``total`` rows is hot: there are fewer than ``HOT_KEYS`` of
    them, so they are broadcast and their rows stay where they are; the others are shuffled.
    """
    most = max(1, total // HOT_KEYS)
    hot = F.broadcast(right.filter(F.col(uses) > most).drop(uses))
    cold = right.filter(F.col(uses) <= most).drop(uses)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))


def id_and_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the UTF-8 bytes of ``text``; every other column is pruned before Python sees a row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))


def ascii_space_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; none for null."""
    return raw.split() if raw else []


_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def alnum_words(raw: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none for null."""
    return raw.translate(_ALNUM).split() if raw else []


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from columns of Python values or Arrow arrays."""
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in ((rows[f.name], f.type) for f in schema)],
        schema=schema,
    )


def raw_values(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a binary column, one at a time, so a batch is not copied whole into Python."""
    for i in range(len(column)):
        yield column[i].as_py()


def give_back() -> None:
    """Return memory that this process no longer uses to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_remembered: dict[str, Callable[[], None]] = {}


def begin(owner: str = "", forget: Callable[[], None] | None = None) -> None:
    """Start a task of one operator: what a reused worker remembers for other operators goes back to the machine."""
    others = [name for name in _remembered if name != owner]
    for name in others:
        _remembered.pop(name)()
    if forget:
        _remembered[owner] = forget
    if others:
        give_back()


def partition_number() -> int:
    """Number of the running task's partition."""
    context = TaskContext.get()
    return context.partitionId() if context else 0
