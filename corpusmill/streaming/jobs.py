"""Structured Streaming forms of the session, deduplication, budget and refresh operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.operators import segments, versions


def idle_sessions(events: DataFrame, key: str, at: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, first, last, n) of sessions that a gap has closed; ``at`` is a timestamp."""
    windowed = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w"))
    return windowed.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).select(key, "first", "last", "n")


def first_events(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first event of equal keys within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def captured(parts: DataFrame, handle: str, ordinal: str, content: str, cap: int) -> DataFrame:
    """(handle, parts, bytes, lines, complete): running counts of captured streams; a stream over the cap stays incomplete.

    State is four numbers a stream, whatever its length, and stays; parts of a stream come in order.
    ``capture.captured`` keeps the bytes as well and ends streams by their last part or by a deadline.
    """
    kind = dict(parts.dtypes)[handle]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, size, ends, last = state.get if state.exists else (0, 0, 0, 10)
        for frame in frames:
            for text in frame.sort_values(ordinal)[content]:
                raw = (text or "").encode()
                n, size, ends = n + 1, size + len(raw), ends + raw.count(b"\n")
                last = raw[-1] if raw else last
        state.update((n, size, ends, last))
        yield pd.DataFrame({handle: [key[0]], "parts": [n], "bytes": [size], "lines": [ends + (last != 10)], "complete": [size <= cap]})

    return parts.select(handle, ordinal, content).groupBy(handle).applyInPandasWithState(
        step, f"{handle} {kind}, parts long, bytes long, lines long, complete boolean", "n long, size long, ends long, last long", "update", GroupStateTimeout.NoTimeout
    )


def refresh(base_path: str, key: str, regular: Column):
    """A ``foreachBatch`` step that applies change sets to a base table and publishes a new version of it.

    A version is a folder written whole; the highest committed number is the current one, so a
    batch that fails or runs again leaves readers at the version before.
    """

    def apply(changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        before = spark.read.parquet(f"{base_path}/{batch - 1 if batch else 'start'}")
        versions.apply_changes(before, changes, key, regular).write.mode("overwrite").parquet(f"{base_path}/{batch}")

    return apply


def refresh_index(root: str):
    """A ``foreachBatch`` step that brings batches of changes (path_id, path, text) into a segmented index and merges when due.

    A batch that runs again after a failure finds its number in the index and changes nothing.
    """

    def apply(changes: DataFrame, batch: int) -> None:
        held = segments.Segments(changes.sparkSession, root).refresh(changes, batch)
        if held is None:
            raise RuntimeError("another writer refreshed the index; the batch has to run again")
        held.merge()

    return apply


def started_and_completed(started: DataFrame, completed: DataFrame, key: str, at: str, wait: str, late: str = "10 minutes") -> DataFrame:
    """(key, started, completed, status) of two streams of events: a start with its completion within ``wait``, or without one once none can come.

    Both sides carry a watermark, so state of a start goes when its time is over; a completion without a start gives no row.
    """
    one = started.withWatermark(at, late).select(F.col(key), F.col(at).alias("started"))
    two = completed.withWatermark(at, late).select(F.col(key).alias("__key"), F.col(at).alias("completed"))
    met = one.join(two, F.expr(f"{key} = __key AND completed >= started AND completed <= started + INTERVAL {wait}"), "left_outer")
    return met.select(key, "started", "completed", F.when(F.col("completed").isNull(), "missing").otherwise("completed").alias("status"))
