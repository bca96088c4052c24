"""Event logs: order, correlation, deduplication and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(events: DataFrame, keys: list[str], sequence: str, step: int = 1) -> DataFrame:
    """Events whose number does not follow that of the event before."""
    before = F.lag(sequence).over(Window.partitionBy(*keys).orderBy(sequence))
    return events.withColumn("expected", before + step).filter(F.col("expected").isNotNull() & (F.col(sequence) != F.col("expected")))


def after_first_failure(events: DataFrame, keys: list[str], order: list[str], failed: Column, wanted: Column) -> DataFrame:
    """(keys, failures, first, later): events of a wanted kind after a key's first failure."""
    seen = F.max(F.when(failed, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumn("__after", F.coalesce(seen, F.lit(0)))
    return marked.groupBy(*keys).agg(F.count_if(failed).alias("failures"), F.count_if(wanted & (F.col("__after") == 1)).alias("later")).filter("failures > 0")


def first_of_each(events: DataFrame, keys: list[str], order: list[str], payload: Column) -> DataFrame:
    """(keys, copies, variants, first payload): the first of equal keys wins, differing payloads are a conflict."""
    first = F.min(F.struct(*order, payload.alias("__p")))
    return events.groupBy(*keys).agg(F.count("*").alias("copies"), F.count_distinct(payload).alias("variants"), first.alias("__f")).select(
        *keys, "copies", "variants", (F.col("variants") > 1).alias("conflict"), F.col("__f.__p").alias("payload")
    )


def correlate(events: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """(keys, a count for each kind, complete): complete if every kind occurs exactly once."""
    counts = [F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    out = events.groupBy(*keys).agg(*counts)
    complete = F.lit(True)
    for k in kinds:
        complete = complete & (F.col(k) == 1)
    return out.withColumn("complete", complete)


def sessions(events: DataFrame, key: str, seconds: Column, gap: int) -> DataFrame:
    """(key, first, last, n): runs of events with less than ``gap`` seconds between neighbours."""
    order = Window.partitionBy(key).orderBy("__t")
    timed = events.select(key, seconds.alias("__t"))
    opened = timed.withColumn("__new", F.when(F.col("__t") - F.lag("__t").over(order) < gap, 0).otherwise(1))
    numbered = opened.withColumn("__s", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__s").agg(F.min("__t").alias("first"), F.max("__t").alias("last"), F.count("*").alias("n")).drop("__s")


def within_budget(events: DataFrame, keys: list[str], order: list[str], size: str, cap: int) -> DataFrame:
    """Events with ``admitted``: the running total stays under the cap; the first over it ends the stream."""
    running = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("admitted", running <= cap)


# The states of an attempt and the events that lead on: fixed values of the ledger.
STEPS = {
    ("", "created"): "created",
    ("created", "planned"): "planned",
    ("planned", "started"): "started",
    ("started", "reserved"): "reserved",
    ("reserved", "completed"): "started",
    ("reserved", "failed"): "stopped",
    ("started", "stopped"): "stopped",
}


def replay(events: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """(key, state): the state that an attempt's ordered events lead to; ``invalid`` once a step is not allowed."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(kind).alias("__k")))), lambda e: e["__k"])
    steps = F.create_map(*[F.lit(x) for (s, e), t in STEPS.items() for x in (f"{s}>{e}", t)])
    step = lambda state, e: F.coalesce(F.element_at(steps, F.concat(state, F.lit(">"), e)), F.lit("invalid"))
    return events.groupBy(key).agg(ordered.alias("__e")).select(key, F.aggregate("__e", F.lit(""), step).alias("state"))
