"""Readers of file trees, archives, strict JSON and event logs as DataFrames."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions import text as T
from corpusmill.operators import policy

#: Rows of one tree scan, and bytes of one file that is read: beyond them a reader fails instead of cutting.
TREE_ROWS, FILE_BYTES = 20_000, 8 << 20


def file_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, bytes, content) of the files under a folder, paths relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    return found.select(F.substring_index("path", base, -1).alias("path"), F.col("length").alias("bytes"), "content")


def inventory(files: DataFrame, rules: list[tuple[str, bool]] = ()) -> DataFrame:
    """(path, bytes, lines, longest, sha256, skip) of every file."""
    text = F.col("content").cast("string")
    rows = T.lines(text)
    longest = F.coalesce(F.array_max(F.transform(rows, lambda r: F.octet_length(r))), F.lit(0))
    return files.select(
        "path", F.octet_length("content").alias("bytes"), F.size(rows).alias("lines"), longest.alias("longest"), F.sha2("content", 256).alias("sha256"),
        policy.inventory_reason(F.col("path"), F.lit("100644"), F.col("content"), rules).alias("skip"),
    )


def tree_listing(listing: DataFrame, column: str = "value") -> DataFrame:
    """(path, oid, mode) of ``mode type oid TAB path`` records ended by NUL; more than 20,000 a listing fail."""
    record = F.explode(F.filter(F.split(F.col(column), "\x00"), lambda r: r != "")).alias("r")
    count = F.size(F.filter(F.split(F.col(column), "\x00"), lambda r: r != ""))
    guarded = listing.withColumn(column, F.when(count > TREE_ROWS, F.raise_error(F.lit("the tree has too many entries"))).otherwise(F.col(column)))
    head, path = F.split_part("r", F.lit("\t"), F.lit(1)), F.regexp_replace("r", "(?s)^[^\t]*\t", "")
    rows = guarded.select(record)
    return rows.select(path.alias("path"), F.split_part(head, F.lit(" "), F.lit(3)).alias("oid"), F.split_part(head, F.lit(" "), F.lit(1)).alias("mode"))


def tar_members(archives: DataFrame, prefix: str = "") -> DataFrame:
    """(archive, path, bytes, content) of the regular files of tar archives ``(path, content)``; unsafe names fail."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for name, raw in zip(frame["path"], frame["content"]):
                out = []
                with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                    for m in tar:
                        pieces = m.name.removeprefix(prefix).split("/")
                        if not m.isfile() or not m.name.startswith(prefix):
                            continue
                        if m.name.startswith("/") or "\\" in m.name or {"", ".", "..", ".git"} & set(pieces) or m.size > FILE_BYTES:
                            raise ValueError(f"unsafe member {m.name!r}")
                        out.append((name, "/".join(pieces), m.size, tar.extractfile(m).read()))
                yield pd.DataFrame(out, columns=["archive", "path", "bytes", "content"])

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, bytes long, content binary")


def strict_json(spark: SparkSession, paths: str | list[str], schema: StructType) -> DataFrame:
    """JSON documents of a fixed schema: malformed ones fail, as do repeated keys and numbers that are not finite."""
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(F.from_json(checked_json("value"), schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


@F.pandas_udf("string")
def checked_json(text: pd.Series) -> pd.Series:
    """The text itself, if it is JSON without repeated keys and without numbers that are not finite."""

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key is repeated")
        return dict(pairs)

    def refuse(name):
        raise ValueError(f"{name} is not a number")

    for t in text:
        json.loads(t, object_pairs_hook=once, parse_constant=refuse)
    return text


def event_log(spark: SparkSession, path: str, schema: StructType, most: int = 1 << 20) -> DataFrame:
    """Events of JSON lines with ``complete``: false for a line that is cut off, broken or longer than a frame."""
    rows = spark.read.text(path).select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"))
    first = schema.fieldNames()[0]
    return rows.select("e.*", (F.col(f"e.{first}").isNotNull() & (F.octet_length("value") <= most)).alias("complete"))


def nested_declarations(docs: DataFrame, column: str, name: str = "name") -> DataFrame:
    """(path, name) of every object in a JSON document that declares a name, however deep."""
    parsed = docs.select(F.parse_json(F.col(column)).alias("v"))
    return docs.sparkSession.sql(f"""
        WITH RECURSIVE walk AS (
          SELECT '$' AS path, v FROM {{parsed}}
          UNION ALL
          SELECT path || coalesce('.' || e.key, '[' || e.pos || ']'), e.value FROM walk, LATERAL variant_explode(v) AS e
        )
        SELECT path, try_variant_get(v, '$.{name}', 'string') AS name FROM walk WHERE try_variant_get(v, '$.{name}', 'string') IS NOT NULL""", parsed=parsed)
