"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily.

Equal vectors are one node of the graph.  Nodes are laid out along the signs of random
projections, twice; blocks of ``LEAF`` neighbours in either order are compared exactly and give the first lists of
``LIST`` neighbours.  Each round of NN-descent then joins, at every node, the lists of
its neighbours and of ``REVERSE`` drawn nodes that have it in theirs, compares each pair with a
new member, and offers every member the best it sees there; rounds end when few entries change.
A query starts from its node's list and opens the nearest nodes not yet opened until none is left among the best ``BEAM``.

Lists hold the largest inner products, so a query's own list is a first answer whatever the vectors'
lengths; where these differ, long vectors are in most lists, and a node meets them as neighbours of neighbours.
The graph compares half-precision vectors; whatever a query meets is measured on the original
components, in double precision from left to right.

Hubs of one block of nodes ask for the union of the vectors they need, once; no list, no block and no
query's state grows with the table.  All tables go through the shared folder.

Defined results: rows without ``vec_id`` and vectors that are null, zero, empty or hold null or
non-finite components take no part; of rows that repeat id and vector one counts; under one id a
query's other vectors are not its candidates; vectors of different lengths are compared as if the shorter
ended in zeros; ties go to the smaller ``vec_id``; a table of one vector or none gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import batches, begin, hot_join, partition_number, stage, table

NEAREST, LIST, REVERSE, LEAF, BEAM = 20, 60, 30, 2048, 24
OFFERS = 3  # best other members a hub offers to a member in one round
SETTLED, ROUNDS = 0.03, 12  # a round that changes a smaller share of all entries is the last
HUBS, QUERIES, TAKERS = 128, 16, 1024  # nodes, and queries, that share what they ask for; nodes whose lists are merged together
SIGNS, SEED = 24, 11


def usable(df: DataFrame) -> DataFrame:
    """``vec_id``, ``embedding`` and ``key``, 128 bits of hash by which equal vectors are told."""
    e, infinity = F.col("embedding"), F.lit(float("inf"))
    finite = F.forall(e, lambda x: F.coalesce((x > -infinity) & (x < infinity), F.lit(False)))
    kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL").filter(finite & F.exists(e, lambda x: x != 0))
    return kept.withColumn("key", F.concat(F.hex(F.xxhash64(e)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), F.reverse(e)))))


def _matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """Lists of numbers as rows, zeros behind the shorter ones."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1).astype(dtype)
    out = np.zeros((len(sizes), sizes.max(initial=0)), dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _halves(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Half-precision vectors, kept as bytes, as rows of single precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)) // 2
    flat = np.frombuffer(b"".join(x.as_buffer() for x in column), np.float16).astype(np.float32)
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.float32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _projected(largest: float, trees: int):
    """Adds the vector the graph compares, and for each tree the signs of its projections."""
    schema = pa.schema([("key", pa.string()), ("small", pa.binary())] + [(f"code{t}", pa.int64()) for t in range(trees)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        planes = np.zeros((0, trees * SIGNS))
        for b in parts:
            if not len(b):
                continue
            x = _matrix(b.column(1)) / largest
            while len(planes) < x.shape[1]:  # a component has the same planes whatever the length
                planes = np.concatenate([planes, np.random.default_rng([SEED, len(planes)]).standard_normal((64, trees * SIGNS))])
            signs = ((x @ planes[: x.shape[1]]) > 0).reshape(len(x), trees, SIGNS) @ (1 << np.arange(SIGNS))
            sizes = np.diff(b.column(1).offsets.to_numpy())
            small = [row[:n].tobytes() for row, n in zip(x.astype(np.float16), sizes.tolist())]
            yield batches({"key": b.column(0), "small": small} | {f"code{t}": pa.array(signs[:, t].astype(np.int64)) for t in range(trees)}, schema)

    return run


def _numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 along ``by``, whose values are unique together: sorted in ranges, each range starting where the ones before end."""
    columns = df.columns
    spark, total = df.sparkSession, df.count()
    ranges = max(1, min(total // 50_000, 10_000))
    schema = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by)

    def run(parts):
        place = 0
        for b in parts:
            n = len(b)
            at = pa.array(np.arange(place, place + n))
            place += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, partition_number(), np.int64)), at], names=[*b.schema.names, "range", name])

    ddl = ", ".join(f"{n} {t}" for n, t in df.dtypes) + f", range long, {name} long"
    placed = stage(schema.mapInArrow(run, ddl), "neighbours-order")
    sizes = sorted((r["range"], r["n"]) for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect())  # one row a range
    starts, start = [], 0
    for number, n in sizes:
        starts.append((number, start))
        start += n
    starts = F.broadcast(spark.createDataFrame(starts, "range long, start long"))
    return placed.join(starts, "range").select(*columns, (F.col(name) + F.col("start")).alias(name))


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, new: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The ``most`` nearest of each ``a``, nearest first, each ``b`` once; of an entry offered twice the known one stays."""
    order = np.lexsort((new, b, a))
    a, b, s, new = a[order], b[order], s[order], new[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s, new = a[once], b[once], s[once], new[once]
    order = np.lexsort((b, -s, a))
    a, b, s, new = a[order], b[order], s[order], new[order]
    start = np.searchsorted(a, a)
    top = np.arange(len(a)) - start < most
    return a[top], b[top], s[top], new[top]


_LISTS = pa.schema([("node", pa.int64()), ("ids", pa.list_(pa.int64())), ("near", pa.list_(pa.float32())), ("new", pa.list_(pa.bool_())), ("fresh", pa.int64())])
_LISTS_DDL = "node long, ids array<long>, near array<float>, new array<boolean>, fresh long"
_OFFERS = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("near", pa.float32())])
_OFFERS_DDL = "node long, other long, near float"


def _lists(a, b, s, new) -> pa.Table:
    nodes, first = np.unique(a, return_index=True)
    ends = np.append(first, len(a)).astype(np.int32)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), x)
    fresh = np.add.reduceat(new.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return pa.Table.from_arrays([pa.array(nodes), lists(pa.array(b)), lists(pa.array(s.astype(np.float32))), lists(pa.array(new)), pa.array(fresh)], schema=_LISTS)


def _offers(a, b, s) -> pa.Table:
    return pa.Table.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], schema=_OFFERS)


def _flat(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _sizes(t: pa.Table, name: str) -> np.ndarray:
    return np.diff(t[name].combine_chunks().offsets.to_numpy())


def _leaf(most: int):
    def run(t: pa.Table) -> pa.Table:
        """All pairs of one block of at most ``LEAF`` nodes; the nearest of each."""
        nodes, x = t["node"].to_numpy(), _halves(t["small"])
        keep = min(most, len(nodes) - 1)
        if keep <= 0:
            return _offers(nodes[:0], nodes[:0], np.zeros(0))
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        at = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
        return _offers(np.repeat(nodes, keep), nodes[at.ravel()], np.take_along_axis(near, at, axis=1).ravel())

    return run


def _merge(most: int):
    def run(known: pa.Table, offered: pa.Table) -> pa.Table:
        """Lists of one block of nodes after they took what is nearer."""
        a = np.concatenate([np.repeat(known["node"].to_numpy(), _sizes(known, "ids")), offered["node"].to_numpy()])
        b = np.concatenate([_flat(known, "ids"), offered["other"].to_numpy()]).astype(np.int64)
        s = np.concatenate([_flat(known, "near"), offered["near"].to_numpy()]).astype(np.float32)
        new = np.arange(len(a)) >= len(a) - len(offered)
        return _lists(*_best(a.astype(np.int64), b, s, new, most))

    return run


def _join_at_hubs(t: pa.Table, vectors: pa.Table) -> pa.Table:
    """One block of hubs: members of each are compared in pairs of which one is new, and offered their best."""
    nodes = vectors["node"].to_numpy()
    order = np.argsort(nodes)
    nodes, least, x = nodes[order], vectors["least"].to_numpy()[order], _halves(vectors["small"])[order]
    out: list[tuple[np.ndarray, ...]] = []
    hubs = zip(*(t[n].to_pylist() for n in ("ids", "new", "back", "backnew")))
    for ids, new, back, back_new in hubs:
        members = np.array([*ids, *(back or ())], np.int64)
        fresh = np.array([*new, *(back_new or ())], bool)
        if len(members) < 2 or not fresh.any():
            continue
        at = np.searchsorted(nodes, members)
        near = x[at] @ x[at].T
        good = (near > least[at][:, None]) & (fresh[:, None] | fresh) & (members[:, None] != members)
        near[~good] = -np.inf
        best = np.argpartition(-near, min(OFFERS, len(members)) - 1, axis=1)[:, :OFFERS]
        s = np.take_along_axis(near, best, axis=1)
        i, j = np.nonzero(s > -np.inf)
        out.append((at[i], at[best[i, j]], s[i, j]))
    if not out:
        return _offers(nodes[:0], nodes[:0], np.zeros(0))
    a, b, s = (np.concatenate(x) for x in zip(*out))
    a, b, s, _ = _best(a, b, s, np.zeros(len(a), bool), LIST)
    return _offers(nodes[a], nodes[b], s)


def _fetched(states: DataFrame, block: str, asked: DataFrame, source: DataFrame, visit: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """Blocks of ``states`` visited together with the rows of ``source`` that they asked for, (``block``, ``node``), each once a block."""
    got = asked.select(F.col(block).alias("asker"), "node").distinct().join(source, "node")
    return states.groupBy(block).cogroup(got.groupBy("asker")).applyInArrow(visit, ddl)


def graph(nodes: DataFrame, size: int = LIST, reverse: int = REVERSE, settled: float = SETTLED, rounds: int = ROUNDS, leaf: int = LEAF) -> DataFrame:
    """Neighbour lists (``node``, ``ids``, ``near``) of ``nodes`` (``node``, ``small``, ``code1``) by NN-descent."""
    shared, block = F.floor(F.col("node") / HUBS), F.floor(F.col("node") / TAKERS)
    vectors = nodes.select("node", "small")
    first = nodes.select(F.floor(F.col("node") / leaf).alias("leaf"), "node", "small").groupBy("leaf").applyInArrow(_leaf(size), _OFFERS_DDL)
    second = _numbered(nodes.select("node", "small", "code1"), ["code1", "node"], "place")
    second = second.select(F.floor(F.col("place") / leaf).alias("leaf"), "node", "small").groupBy("leaf").applyInArrow(_leaf(size), _OFFERS_DDL)
    none = nodes.select("node", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("near"), block.alias("block"))
    offered = first.union(second).withColumn("block", block)
    lists = stage(none.groupBy("block").cogroup(offered.groupBy("block")).applyInArrow(_merge(size), _LISTS_DDL), "neighbours-lists")
    for number in range(rounds):
        entries, fresh = lists.agg(F.sum(F.size("ids")), F.sum("fresh")).first()
        if not entries or number and fresh <= settled * entries:
            break
        edges = lists.select(F.col("node").alias("other"), F.explode(F.arrays_zip("ids", "new")).alias("e")).select(F.col("e.ids").alias("node"), "other", F.col("e.new").alias("new"))
        drawn = F.row_number().over(_window("node", [F.xxhash64("other", F.lit(number))]))
        back = edges.withColumn("n", drawn).filter(F.col("n") <= reverse).groupBy("node").agg(F.collect_list(F.struct("other", "new")).alias("b"))
        hubs = stage(lists.join(back, "node", "left").select("node", "ids", "near", "new", F.col("b.other").alias("back"), F.col("b.new").alias("backnew"), shared.alias("block")), "neighbours-hubs")
        asked = hubs.select("block", F.explode(F.array_union("ids", F.coalesce("back", F.array().cast("array<long>")))).alias("node"))
        least = F.when(F.size("near") >= size, F.element_at("near", -1)).otherwise(F.lit(float("-inf"))).cast("float").alias("least")
        source = vectors.join(lists.select("node", least), "node")
        offers = _fetched(hubs.select("block", "ids", "new", "back", "backnew"), "block", asked, source, _join_at_hubs, _OFFERS_DDL)
        known = lists.select("node", "ids", "near", block.alias("block"))
        lists = stage(known.groupBy("block").cogroup(offers.withColumn("block", block).groupBy("block")).applyInArrow(_merge(size), _LISTS_DDL), "neighbours-lists")
    return lists.select("node", "ids", "near")


def _window(by: str, order: list[Column]):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(*order)


_SEARCH = pa.schema(
    [("block", pa.int64()), ("query", pa.int64()), ("small", pa.binary()), ("seen", pa.list_(pa.int64())), ("best", pa.list_(pa.int64())), ("near", pa.list_(pa.float32())),
     ("opened", pa.list_(pa.int64())), ("ask", pa.list_(pa.int64()))]
)
_SEARCH_DDL = "block long, query long, small binary, seen array<long>, best array<long>, near array<float>, opened array<long>, ask array<long>"
_FOUND = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])


def _searches(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[] for _ in _SEARCH], _SEARCH)], schema=_SEARCH)


def _rows(t: pa.Table) -> Iterator[tuple]:
    return zip(*(t[n].to_pylist() for n in _SEARCH.names))


def _open(t: pa.Table, lists: pa.Table) -> pa.Table:
    """Queries read the lists of the nodes they open and ask for the vectors of nodes not seen before."""
    ids = dict(zip(lists["node"].to_pylist(), lists["ids"].to_pylist()))
    rows = []
    for block, query, small, seen, best, near, opened, ask in _rows(t):
        have, wanted = set(seen), {}
        for node in ask:
            wanted.update(dict.fromkeys(w for w in ids.get(node, ()) if w not in have))
        rows.append((block, query, small, seen, best, near, opened + ask, list(wanted)))
    return _searches(rows)


def _measure(beam: int):
    def run(t: pa.Table, vectors: pa.Table) -> pa.Table:
        """Queries measure the vectors they asked for, keep the best and choose what to open next."""
        nodes, x = vectors["node"].to_numpy(), _halves(vectors["small"])
        order, rows = np.argsort(nodes), []
        for block, query, small, seen, best, near, opened, ask in _rows(t):
            if ask:
                y = np.frombuffer(small, np.float16).astype(np.float32)
                n = min(len(y), x.shape[1])
                at = order[np.searchsorted(nodes, ask, sorter=order)]
                ids = np.concatenate([best, ask]).astype(np.int64)
                found = np.concatenate([near, x[at, :n] @ y[:n]])
                top = np.lexsort((ids, -found))[:beam]
                best, near = ids[top].tolist(), found[top].tolist()
            done = set(opened)
            rows.append((block, query, small, seen + ask, best, near, opened, [n for n in best if n not in done]))
        return _searches(rows)

    return run


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with ``y``, summed from left to right."""
    n = min(x.shape[1], len(y))
    return np.cumsum(x[:, :n] * y[:n], axis=1)[:, -1]


def _score(t: pa.Table, vectors: pa.Table) -> pa.Table:
    """The inner products of queries with the best they met, on the original components."""
    nodes, x = vectors["node"].to_numpy(), _matrix(vectors["embedding"].combine_chunks())
    order = np.argsort(nodes)
    at = lambda ids: order[np.searchsorted(nodes, ids, sorter=order)]
    query, best = t["query"].to_pylist(), t["best"].to_pylist()
    scores = [products(x[at(b)], x[at(q)]) for q, b in zip(query, best)]
    return pa.Table.from_arrays([pa.array(np.repeat(query, [len(b) for b in best])), pa.array(np.concatenate(best).astype(np.int64)), pa.array(np.concatenate(scores))], schema=_FOUND)


def search(lists: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(``query``, ``node``, ``score``) of greedy searches from the ``queries`` (``node``, ``small``), which are nodes of the graph.

    The ``beam`` nodes of largest inner product that each query meets, itself among them.
    """
    none = F.array().cast("array<long>")
    state = queries.select(
        F.floor(F.col("node") / F.lit(QUERIES * 20)).alias("block"), F.col("node").alias("query"), "small",
        none.alias("seen"), none.alias("best"), F.array().cast("array<float>").alias("near"), none.alias("opened"), F.array("node").alias("ask"),
    )
    vectors = nodes.select("node", "small")
    asks = lambda s: s.select("block", F.explode("ask").alias("node"))
    while True:
        state = stage(_fetched(state, "block", asks(state), vectors, _measure(beam), _SEARCH_DDL), "neighbours-measured")
        if state.filter(F.size("ask") > 0).isEmpty():
            best = state.select("block", F.explode(F.array_union("best", F.array("query"))).alias("node"))
            return _fetched(state.select("block", "query", "best"), "block", best, nodes.select("node", "embedding"), _score, "query long, node long, score double")
        state = stage(_fetched(state, "block", asks(state), lists, _open, _SEARCH_DDL), "neighbours-opened")


def nearest(vectors: DataFrame, every: int, k: int = NEAREST, beam: int = BEAM, leaf: int = LEAF) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found of each vector whose id ``every`` divides."""
    rows = usable(vectors)
    asks = F.col("vec_id") % every == 0
    ids = stage(rows.select("key", "vec_id").distinct(), "neighbours-ids")
    classes = rows.groupBy("key").agg(F.first("embedding").alias("embedding"))
    uses = ids.groupBy("key").agg(F.count("*").alias("uses"), F.count_if(asks).alias("queries"))
    classes = stage(classes.join(uses, "key"), "neighbours-classes")
    squares = classes.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if squares is None:
        return empty
    placed = classes.select("key", "embedding").mapInArrow(_projected(float(np.sqrt(squares)) or 1.0, 2), "key string, small binary, code0 long, code1 long")
    nodes = _numbered(placed, ["code0", "key"], "node")
    nodes = stage(nodes.join(classes, "key"), "neighbours-nodes")
    lists = graph(nodes, leaf=leaf)
    found = search(lists, nodes, nodes.filter("queries > 0").select("node", "small"), max(beam, k + 4))
    # the k + 1 best rows of each class that asks; a query leaves itself out
    first = ids.withColumn("n", F.row_number().over(_window("key", [F.col("vec_id")]))).filter(F.col("n") <= k + 1).select("key", "vec_id")
    members = first.join(nodes.select("key", "node"), "key").select("node", "vec_id")
    ranked = found.join(members, "node").withColumn("n", F.row_number().over(_window("query", [F.desc("score"), F.col("vec_id")]))).filter(F.col("n") <= k + 1)
    answers = ranked.groupBy(F.col("query").alias("node")).agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    answers = stage(nodes.select("node", "key", "queries").join(answers, "node").select("key", "queries", "best"), "neighbours-answers")
    total = ids.filter(asks).count()
    mine = hot_join(ids.filter(asks), answers, "key", "queries", total)
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    return mine.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every twentieth embedding, among all embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"), 20)
