"""Corpus rules: references, uniqueness, tree digests and partition plans."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unknown_references(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that refer to nothing known."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; unknown counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def tree_digests(files: DataFrame, path: str, mode: str, oid: str) -> DataFrame:
    """(path, oid) of every directory's tree object, deepest first; the root is the empty path.

    One aggregation a depth; a directory's entries are ordered by their name's bytes, a directory's name counting a slash.
    """
    level = files.select(F.col(path).alias("p"), F.col(mode).alias("m"), F.col(oid).alias("o"))
    deepest = level.agg(F.max(F.size(F.split("p", "/")))).first()[0] or 0
    done = None
    for depth in range(deepest, 0, -1):
        here = level.filter(F.size(F.split("p", "/")) == depth)
        rest = level.filter(F.size(F.split("p", "/")) != depth)
        parts = F.split("p", "/")
        named = here.select(F.array_join(F.slice(parts, 1, depth - 1), "/").alias("up"), F.element_at(parts, -1).alias("name"), "m", "o")
        order = F.encode(F.concat("name", F.when(F.col("m") == "40000", "/").otherwise("")), "UTF-8")
        entry = F.concat(F.encode(F.concat("m", F.lit(" "), "name"), "UTF-8"), F.unhex(F.lit("00")), F.unhex("o"))
        rows = named.groupBy("up").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), entry.alias("e")))).alias("rows"))
        body = F.aggregate("rows", F.unhex(F.lit("")), lambda a, r: F.concat(a, r["e"]))
        framed = F.concat(F.encode(F.concat(F.lit("tree "), F.octet_length("body").cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.col("body"))
        trees = rows.withColumn("body", body).select(F.col("up").alias("p"), F.lit("40000").alias("m"), F.sha1(framed).alias("o"))
        done = trees if done is None else done.unionByName(trees)
        level = rest.unionByName(trees) if depth > 1 else trees
    return done.select(F.col("p").alias(path), F.col("o").alias(oid))


def canonical_json(value) -> str:
    """Compact ASCII JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def partition_plan(clusters: list[tuple[str, int]], quota: int, salt: str = "corpus-v1:") -> dict[str, str]:
    """Clusters to ``development`` or ``held_out``: in hash order, the first subset found whose size is the quota."""
    ordered = sorted(clusters, key=lambda c: hashlib.sha256((salt + c[0]).encode()).hexdigest())
    reached: dict[int, list[str]] = {0: []}
    for name, n in ordered:
        for total in sorted(reached, reverse=True):
            reached.setdefault(total + n, [*reached[total], name])
    if quota not in reached:
        raise ValueError("no subset reaches the quota")
    return {name: "development" if name in reached[quota] else "held_out" for name, _ in ordered}


def trial_plan(tasks: DataFrame, task: str, repetitions: int, configurations: list[str], seed: str) -> DataFrame:
    """Every task, repetition and configuration, with a fair repeatable coin for which goes first."""
    from corpusmill.functions.text import coin

    grid = tasks.select(task).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    tossed = grid.withColumn("coin", coin(F.concat_ws(":", F.lit(seed), F.col(task).cast("string"), F.col("repetition").cast("string"))))
    return tossed.select("*", F.posexplode(F.array(*[F.lit(c) for c in configurations])).alias("place", "configuration"))
