"""Snapshots, overlays, change sets and retention of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import running

WEEK = 7 * 24 * 3600


def active_view(base: DataFrame, overlay: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Base rows that no overlay hides, and overlay rows that are not tombstones (null content)."""
    hidden = overlay.select(*keys)
    return base.join(hidden, keys, "left_anti").unionByName(overlay.filter(F.col(content).isNotNull()).select(*base.columns))


def changed_entries(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, status, values after): A added, D deleted with null values, M modified; equal rows left out."""
    a = before.select(key, F.struct(*values).alias("old"))
    b = after.select(key, F.struct(*values).alias("new"))
    both = a.join(b, key, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").otherwise("M")
    return both.select(key, status.alias("status"), *[F.col(f"new.{v}").alias(v) for v in values])


def apply_changes(base: DataFrame, changes: DataFrame, key: str, regular: Column) -> DataFrame:
    """A base with its changed rows taken out and the changed regular files put in."""
    kept = base.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.filter((F.col("status") != "D") & regular).select(*base.columns))


def refresh_action(previous_head: Column, head: Column, previous_signature: Column, signature: Column) -> Column:
    """What a refresh has to do: none, rescan on a new policy or no earlier snapshot, diff on a new head, overlay else."""
    policy = lambda s: F.split_part(s, F.lit(":"), F.lit(1))
    return (
        F.when(previous_head.eqNullSafe(head) & previous_signature.eqNullSafe(signature), "none")
        .when(previous_signature.isNull() | (policy(previous_signature) != policy(signature)), "rescan")
        .when(~previous_head.eqNullSafe(head), "diff")
        .otherwise("overlay")
    )


def refreshed_overlays(overlays: DataFrame, base: DataFrame, dirty: DataFrame, key: str, head_changed: bool = False) -> DataFrame:
    """(key, fingerprint, identity, action) of the overlays after a scan for changed files, and those taken out.

    ``dirty`` (key, fingerprint, identity; null identity: missing or unreadable) is the scan,
    ``base`` (key, identity) the committed files.  An overlay that is no longer dirty is ``stale``,
    one whose content is the committed one again ``reverted``; both go.  An equal fingerprint is
    ``kept`` unless the head changed, anything else is ``written``.
    """
    old = overlays.select(key, F.col("fingerprint").alias("__f"), F.col("identity").alias("__i"), F.lit(True).alias("__old"))
    new = dirty.select(key, "fingerprint", "identity", F.lit(True).alias("__new"))
    committed = base.select(key, F.col("identity").alias("__base"))
    rows = old.join(new, key, "full_outer").join(committed, key, "left")
    same = F.lit(not head_changed) & (F.col("__f") == F.col("fingerprint"))
    action = (
        F.when(F.col("__new").isNull(), "stale")
        .when(F.col("__old").isNotNull() & same, "kept")
        .when(F.col("identity") == F.col("__base"), "reverted")
        .otherwise("written")
    )
    kept = F.col("action") == "kept"
    out = rows.withColumn("action", action)
    return out.select(key, F.coalesce("fingerprint", "__f").alias("fingerprint"), F.when(kept, F.col("__i")).otherwise(F.col("identity")).alias("identity"), "action")


def distinct_contents(rows: DataFrame, content: str) -> DataFrame:
    """(identity, copies, bytes): contents stored once under their SHA-256."""
    hashed = rows.select(F.sha2(F.col(content), 256).alias("identity"), F.octet_length(content).alias("bytes"))
    return hashed.groupBy("identity").agg(F.count("*").alias("copies"), F.max("bytes").cast("long").alias("bytes"))


def missing_contents(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """(oid, parsers): tree entries without a cached content, with the parsers that want them."""
    wanted = entries.select("oid", "parser").distinct()
    return wanted.join(contents.select("oid", "parser"), ["oid", "parser"], "left_anti").groupBy("oid").agg(F.array_sort(F.collect_set("parser")).alias("parsers"))


def unreferenced(contents: DataFrame, base: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """Contents that neither a base nor an overlay refers to."""
    return contents.join(base.select(key).distinct(), key, "left_anti").join(overlay.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def collectable(rows: DataFrame, now: Column, pressure: bool = False, created: str = "created", dirty: str = "dirty") -> DataFrame:
    """Of unreferenced rows those to delete: dirty ones, ones older than a week, all under pressure."""
    return rows if pressure else rows.filter(F.col(dirty) | (F.col(created) < now - WEEK))


def evict_until(rows: DataFrame, size: str, order: list[str], budget: int, group: list[str] | None = None) -> DataFrame:
    """Rows marked ``evicted``: the oldest go until what is left fits the budget.

    The running total is per ``group``, which may be larger than a task.
    """
    totalled = running.ahead(rows, group or [], order, {"__size": F.col(size)})
    return totalled.select(*rows.columns, (F.col("__size_all") - F.col("__size_ahead") > budget).alias("evicted"))


def expired_runs(runs: DataFrame, created: str, name: str, now: int, seconds: int, most: int, group: list[str]) -> DataFrame:
    """Runs marked ``expired``: those as old as ``seconds``, and the oldest until fewer than ``most`` are left for the next."""
    totalled = running.ahead(runs, group, [created, name], {"__count": F.lit(1)})
    left = F.col("__count_all") - F.col("__count_ahead")
    return totalled.select(*runs.columns, ((F.lit(now) - F.col(created) >= seconds) | (left >= most)).alias("expired"))
