"""Responses, exports, manifests and all-or-nothing publication."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of one response: a larger one fails, it is never cut.
RESPONSE_BYTES = 64 * 1024


def json_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, response): every row as one compact JSON object, nulls left out."""
    return df.select(key, F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("response"))


def guarded(response: Column, most: int = RESPONSE_BYTES) -> Column:
    """The response, or an error if it is larger than a response may be, escapes counted."""
    return F.when(F.octet_length(response) > most, F.raise_error(F.lit("the response is too large"))).otherwise(response)


def rendered(df: DataFrame, group: str, score: str, name: str, *ties: str) -> DataFrame:
    """(group, rank, line): results as numbered lines with six decimals, best first."""
    order = Window.partitionBy(group).orderBy(F.desc(score), *ties)
    ranked = df.withColumn("rank", F.row_number().over(order))
    return ranked.select(group, F.col("rank").cast("long"), F.format_string("%d. %s  %.6f", "rank", F.col(name).cast("string"), score).alias("line"))


def allow_list(df: DataFrame, safe: dict[str, str]) -> DataFrame:
    """Only the named columns, each cast to its type: an export is built from safe fields, not by striking out others."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in safe.items()])


def checksums(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, line): ``sha256  path`` for each file."""
    return files.select(path, F.concat(F.sha2(F.col(content).cast("binary"), 256), F.lit("  "), F.col(path).cast("string")).alias("line"))


def set_digest(df: DataFrame, group: list[str], item: Column) -> DataFrame:
    """(group, digest): SHA-256 over a group's items in order, one to a line, however they were stored."""
    return df.groupBy(*group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "\n"), 256).alias("digest"))


def number_text(x: Column, places: int = 6) -> Column:
    """A number rounded for a report, ``unknown`` for null."""
    return F.coalesce(F.round(x, places).cast("string"), F.lit("unknown"))


def exit_status(code: Column, signal: Column, timed_out: Column) -> Column:
    """A command's status: 124 after a deadline, 128 and the signal, or its own code."""
    return F.when(timed_out, 124).when(signal.isNotNull(), signal + 128).otherwise(code)


def normalised(text: Column, patterns: dict[str, str]) -> Column:
    """Text with its volatile parts replaced by fixed words, so that equal requests compare equal."""
    for pattern, word in patterns.items():
        text = F.regexp_replace(text, pattern, word)
    return text


def blind_labels(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """(key, label): labels in an order that the seed alone gives, so that a label says nothing about its row."""
    hashed = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    return rows.select(key, F.concat(F.lit("r-"), F.substring(hashed, 1, 16)).alias("label"))


def unblinded(forms: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Forms under their real keys; a label that is unknown or used twice fails."""
    counted = forms.join(labels, "label", "left").withColumn("__n", F.count("*").over(Window.partitionBy("label")))
    checked = F.when(F.col(key).isNull() | (F.col("__n") != 1), F.raise_error(F.lit("a label is not used exactly once"))).otherwise(F.col(key))
    return counted.withColumn(key, checked).drop("__n")


def amended(tasks: DataFrame, amendments: DataFrame, key: str, text: str, extra: str) -> DataFrame:
    """Tasks with amended text where there is one, and with the amendments' alternatives added to their own."""
    new = amendments.select(key, F.col(text).alias("__text"), F.col(extra).alias("__extra"))
    out = tasks.join(new, key, "left")
    return out.withColumn(text, F.coalesce("__text", text)).withColumn(extra, F.concat(extra, F.coalesce("__extra", F.array().cast("array<string>")))).drop("__text", "__extra")


class VersionedTable:
    """A table whose versions are whole folders and whose pointer is written last.

    A publication that finds another version than the one it started from is given up, so
    readers see the version before or the version after and nothing between.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        """Number of the published version, 0 for none."""
        pointers = self.fs.globStatus(self.path(f"{self.root}/pointer-*"))
        return max([int(p.getPath().getName().rpartition("-")[2]) for p in pointers or []], default=0)

    def about(self, version: int | None = None) -> dict:
        """What the pointer of a version says; of none published, nothing."""
        version = self.current() if version is None else version
        if not version:
            return {}
        stream = self.fs.open(self.path(f"{self.root}/pointer-{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame:
        """The published version."""
        return self.spark.read.parquet(f"{self.root}/{self.about()['folder']}")

    def point(self, about: dict, expected: int) -> bool:
        """Publish what was written before, if the version is still the expected one; creating the pointer decides a race."""
        target = self.path(f"{self.root}/pointer-{expected + 1:012d}")
        if self.current() != expected or self.fs.exists(target):
            return False
        try:
            out = self.fs.create(target, False)
        except Exception as taken:  # another writer was first
            if "FileAlreadyExists" not in str(taken):
                raise
            return False
        out.write(json.dumps(about).encode())
        out.close()
        return True

    def remove(self, folder: str) -> None:
        """Take a folder that no version points at away."""
        self.fs.delete(self.path(f"{self.root}/{folder}"), True)

    def publish(self, df: DataFrame, expected: int) -> bool:
        """Write ``df`` and point at it if the version is still the expected one."""
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        if self.point({"folder": folder}, expected):
            return True
        self.remove(folder)
        return False
