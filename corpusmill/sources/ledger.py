"""An append-only sink that is all or nothing, batch by batch: ``ledger``.

Tasks write JSON lines to files of their own and report name, rows, bytes and SHA-256.  Only when all
have done so is one entry written that names the files and carries the digest of the entry
before: a hash chain over batches.  Creating the entry decides; a batch that runs again finds
its entry and adds nothing.  Files of a batch that failed are taken away; if that cannot be done, or an entry was left
half written, the ledger is poisoned: it takes no more batches.
Readers see the files of complete entries alone, after the chain and the files' digests were checked.

``path`` is a folder that the driver and all executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType


class PoisonedLedger(RuntimeError):
    """A write broke off halfway; nothing may be appended."""


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    bytes: int
    sha256: str


def _digest(entry: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in entry.items() if k != "digest"}, sort_keys=True).encode()).hexdigest()


def entries(root: str) -> list[dict]:
    """The entries in order, their chain checked."""
    out: list[dict] = []
    for name in sorted(n for n in os.listdir(root) if n.startswith("entry-")) if os.path.isdir(root) else []:
        with open(f"{root}/{name}", encoding="utf-8") as file:
            try:
                entry = json.load(file)
            except ValueError:
                raise PoisonedLedger(f"{name} is half written") from None
        before = out[-1]["digest"] if out else ""
        if entry.get("before") != before or entry.get("digest") != _digest(entry):
            raise ValueError(f"the chain breaks at {name}")
        out.append(entry)
    return out


class LedgerWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.root, self.fail_after = options["path"].removeprefix("file://").rstrip("/"), int(options.get("fail_after", -1))

    def write(self, iterator: Iterator[Row]) -> Written:
        os.makedirs(self.root, exist_ok=True)
        name, digest, rows, size = f"part-{uuid.uuid4().hex}.jsonl", hashlib.sha256(), 0, 0
        with open(f"{self.root}/{name}", "wb") as file:
            for row in iterator:
                if rows == self.fail_after:
                    raise OSError("the disk is full")  # as a test asks for
                line = json.dumps(row.asDict(recursive=True), sort_keys=True, default=str).encode() + b"\n"
                file.write(line)
                digest.update(line)
                rows, size = rows + 1, size + len(line)
            file.flush()
            os.fsync(file.fileno())
        return Written(name, rows, size, digest.hexdigest())

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # type: ignore[override]  # noqa: N803
        if os.path.exists(f"{self.root}/poisoned"):
            raise PoisonedLedger(self.root)
        known = entries(self.root)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.file)
        if any(e["batch"] == batchId for e in known):
            return self._remove(parts)
        entry = {"batch": batchId, "files": [m.__dict__ for m in parts if m.rows], "before": known[-1]["digest"] if known else ""}
        entry["digest"] = _digest(entry)
        path = f"{self.root}/entry-{len(known):012d}.json"
        with open(path, "x", encoding="utf-8") as file:  # another writer of the same place is an error
            file.write(json.dumps(entry))
            file.flush()
            os.fsync(file.fileno())
        self._remove([m for m in parts if not m.rows])

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # type: ignore[override]  # noqa: N803
        self._remove([m for m in messages if m is not None])

    def _remove(self, parts: list[Written]) -> None:
        try:
            for m in parts:
                os.remove(f"{self.root}/{m.file}")
        except OSError:
            with open(f"{self.root}/poisoned", "w", encoding="utf-8"):
                raise


class Ledger(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger"

    def streamWriter(self, schema: StructType, overwrite: bool) -> LedgerWriter:  # noqa: N802
        return LedgerWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Ledger)


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all complete batches; an error if the chain breaks or a file is not what its entry says."""
    files = [f for e in entries(root) for f in e["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    told = spark.createDataFrame([(f["file"], f["sha256"]) for f in files], "name string, sha256 string")
    found = spark.read.format("binaryFile").load([f"{root}/{f['file']}" for f in files])
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("now"))
    if not told.join(named, "name", "left").filter(~F.col("sha256").eqNullSafe(F.col("now"))).isEmpty():
        raise ValueError("a file of the ledger is not what its entry says")
    return spark.read.schema(schema).json([f"{root}/{f['file']}" for f in files])
