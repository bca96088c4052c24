"""Folds whose groups may be larger than a task: replay of logs, digests of sets, exact order statistics."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import audit, running
from corpusmill.operators.index import shared_folder

INVALID = "invalid"


def _same(left: str, right: str, names: list[str]) -> Column:
    """Equality of two aliased rows in some columns, null being equal to null."""
    match = F.lit(True)
    for n in names:
        match &= F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return match


def _compose(to, broken, sizes, run):
    """One map for each run of equal ``run``: neighbours are composed pairwise until one is left.

    ``to`` leads from each state to a state, ``broken`` to the place of the first step that is not
    allowed (-1: none), counted from the map's first event.
    """
    import numpy as np

    while len(run) > 1:
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        place = np.arange(len(run)) - np.repeat(starts, np.diff(np.r_[starts, len(run)]))
        right = np.flatnonzero(place % 2)
        if not len(right):
            break
        left, rows = right - 1, np.arange(len(right))[:, None]
        later = broken[right][rows, to[left]]
        later = np.where(later >= 0, later + sizes[left][:, None], -1)
        broken[left] = np.where(broken[left] >= 0, broken[left], later)
        to[left] = to[right][rows, to[left]]
        sizes[left] += sizes[right]
        keep = place % 2 == 0
        to, broken, sizes, run = to[keep], broken[keep], sizes[keep], run[keep]
    return to, broken, sizes, run


def replay_log(events: DataFrame, key: str, order: list[str], kind: str, steps: dict[tuple[str, str], str] = audit.STEPS) -> DataFrame:
    """(key, state, records, broken_at): where a log leads from the state ``""``, and the place of its first forbidden event.

    An event is a map of states to states and maps compose, so a log is dealt by ranges of its order, each
    range is folded to one map in a stream of batches, and what meets at a key is one map a range.
    ``broken_at`` counts from 0 and is null for a log without a forbidden event; after one the state
    stays ``invalid``.  Null and unknown kinds are forbidden everywhere, events of equal order are taken by
    kind, and a null key is a log of its own.
    """
    states = ["", *sorted({s for s, _ in steps} | set(steps.values()) - {""}), INVALID]
    states = list(dict.fromkeys(states))
    kinds = sorted({k for _, k in steps})
    bad = len(states) - 1
    table = [[states.index(steps[s, k]) if (s, k) in steps else bad for s in states] for k in kinds] + [[bad] * len(states)]
    number = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    coded = F.coalesce(F.element_at(number, F.col(kind)), F.lit(len(kinds))).cast("int")
    dealt = events.select(F.col(key).alias("k"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], coded.alias("code"))
    by = ["k", *[f"o{i}" for i in range(len(order))], "code"]
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by).select("k", "code")

    def fold(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        moves = np.array(table, dtype=np.int32)
        held = None

        def rows(keys, to, broken, sizes):
            arrays = [keys, pa.array([part] * len(keys), pa.int32()), pa.array(sizes), pa.array(to.tolist(), pa.list_(pa.int32())), pa.array(broken.tolist(), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["k", "part", "n", "to", "broken"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, to = batch.column(0), moves[batch.column(1).to_numpy(zero_copy_only=False)]
            broken = np.where((to == bad) & (np.arange(len(states)) != bad), 0, -1).astype(np.int64)
            code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            run = np.cumsum(np.r_[0, code[1:] != code[:-1]])
            firsts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            to, broken, sizes, _ = _compose(to, broken, np.ones(len(run), dtype=np.int64), run)
            keys = keys.take(pa.array(firsts))
            if held is not None:
                same = held[0][0].as_py() == keys[0].as_py()
                keys = pa.concat_arrays([held[0], keys])
                to, broken, sizes = np.concatenate([held[1], to]), np.concatenate([held[2], broken]), np.concatenate([held[3], sizes])
                if same:
                    to, broken, sizes, _ = _compose(to, broken, sizes, np.r_[0, 0, np.arange(1, len(keys) - 1)])
                    keys = keys.slice(1)
            if len(keys) > 1:
                yield rows(keys.slice(0, len(keys) - 1), to[:-1], broken[:-1], sizes[:-1])
            held = keys.slice(len(keys) - 1), to[-1:].copy(), broken[-1:].copy(), sizes[-1:].copy()
        if held is not None:
            yield rows(*held)

    kind_of_key = dealt.schema["k"].dataType.simpleString()
    maps = dealt.mapInArrow(fold, f"k {kind_of_key}, part int, n long, to array<int>, broken array<long>")
    ordered = maps.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "n", "to", "broken"))).alias("maps"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("broken"))

    def step(a: Column, m: Column) -> Column:
        here = F.element_at(m["broken"], a["at"] + 1)
        broken = F.when(a["broken"] >= 0, a["broken"]).when(here >= 0, here + a["n"]).otherwise(F.lit(-1).cast("long"))
        return F.struct(F.element_at(m["to"], a["at"] + 1).alias("at"), (a["n"] + m["n"]).alias("n"), broken.alias("broken"))

    done = ordered.select("k", F.aggregate("maps", start, step).alias("end"))
    named = F.element_at(F.array(*[F.lit(s) for s in states]), F.col("end.at") + 1)
    return done.select(F.col("k").alias(key), named.alias("state"), F.col("end.n").alias("records"), F.when(F.col("end.broken") >= 0, F.col("end.broken")).alias("broken_at"))


def against_summary(replayed: DataFrame, saved: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, mismatches): logs whose replay differs from the saved summary, by field; ``unsaved`` and ``unlogged`` ones say so."""
    a = replayed.select(F.col(key).alias("__a"), F.struct(*fields).alias("__got"))
    b = saved.select(F.col(key).alias("__b"), F.struct(*fields).alias("__want"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"__got.{f}").eqNullSafe(F.col(f"__want.{f}")), F.lit(f)) for f in fields]))
    found = F.when(F.col("__want").isNull(), F.array(F.lit("unsaved"))).when(F.col("__got").isNull(), F.array(F.lit("unlogged"))).otherwise(differs)
    both = a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full_outer")
    return both.select(F.coalesce("__a", "__b").alias(key), found.alias("mismatches")).filter(F.size("mismatches") > 0)


def merkle_digest(df: DataFrame, group: list[str], item: Column, width: int = 1024) -> DataFrame:
    """(group, items, digest): a digest of each group's items, with their numbers, however they were stored and dealt.

    A leaf is an item's SHA-256 (``null`` for null) and how often it occurs; leaves in their order are hashed in
    blocks of ``width`` lines, blocks in blocks, until one is left.  Copies are counted before the exchange, leaves
    are dealt by ranges of their hashes, and no task holds more of a group than its range and a block.
    """
    leaf = F.coalesce(F.sha2(item.cast("binary"), 256), F.lit("null"))
    leaves = df.select(*group, leaf.alias("__leaf")).groupBy(*group, "__leaf").agg(F.count("*").alias("__n"))
    placed = running.ahead(leaves, group, ["__leaf"], {"items": F.lit(1)})
    line = F.concat("__leaf", F.lit(" "), F.col("__n").cast("string"))
    level = placed.select(*group, F.col("items_all").cast("long").alias("items"), F.col("items_ahead").cast("long").alias("__at"), line.alias("__d"), F.col("items_all").cast("long").alias("__left"))
    path = shared_folder(df.sparkSession)
    level.write.parquet(path)
    level = df.sparkSession.read.schema(level.schema).parquet(path)
    most = level.agg(F.max("items")).first()[0] or 0
    deep = 0
    while deep == 0 or most > 1:
        blocks = level.groupBy(*group, "items", "__left", F.floor(F.col("__at") / width).alias("__at")).agg(F.array_sort(F.collect_list(F.struct("__at", "__d"))).alias("__rows"))
        hashed = F.sha2(F.array_join(F.transform("__rows", lambda r: r["__d"]), "\n"), 256)
        done = F.lit(deep > 0) & (F.col("__left") == 1)  # a group's own digest, which stays while larger ones go on
        left = F.ceil(F.col("__left") / width).cast("long")
        level = blocks.select(*group, "items", "__at", F.when(done, F.col("__rows")[0]["__d"]).otherwise(hashed).alias("__d"), left.alias("__left"))
        most, deep = -(-most // width), deep + 1
    return level.select(*group, "items", F.col("__d").alias("digest"))


def order_statistics(rows: DataFrame, group: list[str], value: str, fractions: dict[str, tuple[str, float]], most: int = 4096) -> DataFrame:
    """(group, n, a column for each fraction): exact quantiles, ``("disc", p)`` or ``("cont", p)`` as in SQL.

    Only counts and sketches are exchanged: a round takes, for every rank that is sought, a range from
    a mergeable sketch, counts what lies below, at and between its ends, and goes on with the range that holds the
    rank; ranges of at most ``most`` rows are sorted.  The sketch only steers, so its error costs rounds, not exactness.
    Null and NaN values take no part; groups without others have ``n`` 0 and nulls.
    """
    spark, x = rows.sparkSession, F.col("__x")
    names = {g: f"__g{i}" for i, g in enumerate(group)}
    slim = rows.select(*[F.col(g).alias(n) for g, n in names.items()], F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("__x"))
    own = list(names.values())

    def stored(df: DataFrame) -> DataFrame:
        path = shared_folder(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    counts = stored(slim.groupBy(*own).agg(F.count("__x").alias("n")))
    targets = []
    for name, (how, p) in fractions.items():
        if how == "disc":
            targets.append((f"{name}:a", F.greatest(F.ceil(F.lit(p) * F.col("n")) - 1, F.lit(0))))
        else:
            spot = F.lit(p) * (F.col("n") - 1)
            targets += [(f"{name}:a", F.floor(spot)), (f"{name}:b", F.ceil(spot))]
    sought = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), r.cast("long").alias("rank")) for t, r in targets]))
    null = F.lit(None).cast("double")
    left = counts.filter("n > 0").select(*own, sought.alias("s"), F.col("n").alias("size")).select(*own, F.col("s.t").alias("t"), F.col("s.rank").alias("rank"), "size", null.alias("lo"), null.alias("hi"))
    left, found = stored(left), []
    keys = [*own, "t"]

    def inside(state: DataFrame) -> DataFrame:
        match = _same("r", "s", own) & (F.col("lo").isNull() | (x > F.col("lo"))) & (F.col("hi").isNull() | (x < F.col("hi")))
        return slim.filter("__x IS NOT NULL").alias("r").join(state.alias("s"), match).select(*[F.col(f"s.{n}") for n in own], "t", "rank", "size", "lo", "hi", "__x")

    while True:
        picked = inside(left.filter(F.col("size") <= most)).groupBy(*keys, "rank").agg(F.array_sort(F.collect_list("__x")).alias("xs"))
        found.append(stored(picked.select(*keys, F.element_at("xs", (F.col("rank") + 1).cast("int")).alias("x"))))
        left = left.filter(F.col("size") > most)
        if left.isEmpty():
            break
        here = F.col("rank") / F.greatest(F.col("size") - 1, F.lit(1))
        ends = [F.greatest(here - 0.001, F.lit(0.0)), F.least(here + 0.001, F.lit(1.0))]
        # A sketch takes constant fractions only, so it gives a fixed ladder from which a rank's ends are read.
        ladder = [i / 1000 for i in range(1001)]
        sketch = inside(left).groupBy(*keys).agg(F.percentile_approx("__x", ladder, 10000).alias("steps"))
        rung = lambda e, up: F.element_at("steps", (F.ceil(e * 1000) if up else F.floor(e * 1000)).cast("int") + 1)
        bounds = left.alias("l").join(sketch.alias("k"), _same("l", "k", keys))
        bounds = stored(bounds.select(*[F.col(f"l.{n}") for n in keys], "rank", "size", "lo", "hi", rung(ends[0], False).alias("a"), rung(ends[1], True).alias("b")))
        rows_of = inside(left).select(*keys, "__x").alias("c").join(bounds.alias("b"), _same("c", "b", keys))
        tally = rows_of.groupBy(*[F.col(f"b.{n}") for n in keys], "rank", "size", "lo", "hi", "a", "b").agg(
            F.count_if(x < F.col("a")).alias("under"), F.count_if(x == F.col("a")).alias("at_a"),
            F.count_if((x > F.col("a")) & (x < F.col("b"))).alias("between"), F.count_if((x == F.col("b")) & (F.col("b") > F.col("a"))).alias("at_b"),
        )
        r, u = F.col("rank"), F.col("under")
        to_a, to_b = u + F.col("at_a"), u + F.col("at_a") + F.col("between")
        over = to_b + F.col("at_b")
        tally = stored(tally.withColumn("x", F.when((r >= u) & (r < to_a), F.col("a")).when((r >= to_b) & (r < over), F.col("b"))))
        found.append(tally.filter("x IS NOT NULL").select(*keys, "x"))
        below, mid = r < u, (r >= to_a) & (r < to_b)
        left = tally.filter("x IS NULL").select(
            *keys, F.when(below, r).when(mid, r - to_a).otherwise(r - over).alias("rank"), F.when(below, u).when(mid, F.col("between")).otherwise(F.col("size") - over).alias("size"),
            F.when(below, F.col("lo")).when(mid, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(below, F.col("a")).when(mid, F.col("b")).otherwise(F.col("hi")).alias("hi"),
        )
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    at = {t: F.max(F.when(F.col("t") == t, F.col("x"))) for t, _ in targets}
    wide = every.groupBy(*own).agg(*[c.alias(t) for t, c in at.items()])
    shown = []
    for name, (how, p) in fractions.items():
        a = F.col(f"`{name}:a`")
        if how == "cont":
            spot = F.lit(p) * (F.col("n") - 1)
            b = F.col(f"`{name}:b`")
            a = F.when(a == b, a).otherwise(a + (b - a) * (spot - F.floor(spot)))
        shown.append(a.alias(name))
    return counts.alias("c").join(wide.alias("w"), _same("c", "w", own), "left").select(*[F.col(f"c.{n}").alias(g) for g, n in names.items()], "n", *shown)
