"""Best-fit packing of token pieces into sequences by bin completion.

Only the lengths matter to a packing, and there are at most ``capacity``
different ones, so the plan is made on a histogram whose size does not depend
on the data.  The largest length still open is completed by its undominated
fillings, those that waste least first: no length on hand fits beside a filling,
and its items can't be laid into those of an earlier one.  A filling is
applied as many times at once as counts and waste allow, then fewer times, so the enumeration is whole.  Branch and bound
starts with best-fit decreasing as its incumbent; what a better packing may
waste in all is known from it, and a branch that wastes more is cut.  The
search is depth-first; it ends with the lower bound, with all branches tried, or
after ``nodes`` completions (``nodes=None``: never).  Pieces then take the places of their length by rank:
counts per task and length give each task its first rank of a length, so no
length's pieces ever meet in one task.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each by itself; an empty table gives no sequences; other columns are
ignored by the query.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import batches, id_and_bytes, partition_number, stage, table
from corpusmill.llm.tokens import END, encoder

CAPACITY = 1024
NODES = 10_000  # completions after which the search settles for its incumbent
STEPS = 100  # of comparing fillings, for each of these


def pieces_of(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, start, length) of the pieces of texts of so many ids; all but a text's first are full."""
    count = -(-lengths // capacity)
    text = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = (lengths - (count - 1) * capacity)[text]
    return text, number, np.where(number, first + (number - 1) * capacity, 0), np.where(number, capacity, first)


class Nodes:
    """Completions that a search may still look at, and steps it may compare them in; ``None``: any number."""

    def __init__(self, most: int | None):
        self.left, self.steps = most, None if most is None else most * STEPS

    def spend(self) -> bool:
        """Whether one more may be looked at."""
        if self.left is not None:
            self.left -= 1
        return self.left is None or self.left >= 0

    def step(self) -> bool:
        """Whether comparing may go on."""
        if self.steps is not None:
            self.steps -= 1
        return self.steps is None or self.steps >= 0


def fillings(room: int, counts: dict[int, int], waste: int, nodes: Nodes) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the lengths on hand that leave at most ``waste`` free, fullest first, then by larger items."""
    sizes = sorted((s for s in counts if s <= room), reverse=True)
    whole = (1 << room + 1) - 1
    reach = [1] * (len(sizes) + 1)  # bit t: the sizes from here on can add up to t
    for i in reversed(range(len(sizes))):
        bits, n, step = reach[i + 1], min(counts[sizes[i]], room // sizes[i]), 1
        while n:
            take = min(step, n)
            bits |= bits << take * sizes[i]
            n, step = n - take, step * 2
        reach[i] = bits & whole
    found: list[tuple[int, ...]] = []

    def add_up(i: int, rest: int, items: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield items
            return
        for j in range(i, len(sizes)):
            if not reach[j] >> rest & 1:
                return
            for k in range(min(counts[sizes[j]], rest // sizes[j]), 0, -1):
                if reach[j + 1] >> rest - k * sizes[j] & 1:
                    yield from add_up(j + 1, rest - k * sizes[j], items + (sizes[j],) * k)

    for free in range(min(waste, room) + 1):
        if reach[0] >> room - free & 1:
            for items in add_up(0, room - free, ()):
                if not nodes.spend():
                    return
                spent = Counter(items)
                fits = any(s <= free and n > spent[s] for s, n in counts.items()) if free else False
                if not fits and not any(_dominated(items, f, nodes) for f in found):
                    found.append(items)
                    yield items


def _dominated(a: tuple[int, ...], b: tuple[int, ...], nodes: Nodes | None = None) -> bool:
    """Whether the items of ``a`` can be laid into the items of ``b``, several into one where they fit.

    To find out may take steps without bound; a filling that none are left for counts as undominated and is tried like any other.
    """
    nodes = nodes or Nodes(None)
    if not nodes.step() or len(a) < len(b) or sum(a) > sum(b):
        return False

    def lay(k: int, free: tuple[int, ...]) -> bool:
        if k == len(a):
            return True
        if not nodes.step():
            return False
        return any(lay(k + 1, free[:j] + (f - a[k],) + free[j + 1 :]) for f, j in {f: j for j, f in enumerate(free)}.items() if f >= a[k])

    return lay(0, b)


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Fewest sequences that any packing needs: the volume, and the waste beside items too large to pair."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes], np.int64) if len(sizes) else sizes
    best = ceil(int((sizes * n).sum()) / capacity) if len(sizes) else 0
    for k in [0, *[int(s) for s in sizes if s <= capacity // 2]]:
        large, middle = sizes > capacity - k, (sizes <= capacity - k) & (sizes > capacity // 2)
        small = (sizes >= max(k, 1)) & (sizes <= capacity // 2)
        over = int((sizes * n)[small].sum()) - (int(n[middle].sum()) * capacity - int((sizes * n)[middle].sum()))
        best = max(best, int(n[large].sum() + n[middle].sum()) + max(0, ceil(over / capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: (lengths of one sequence, how many such sequences)."""
    left, plan = dict(counts), []
    while left:
        items, room = [], capacity
        while (fit := max((s for s in left if s <= room and left[s] > items.count(s)), default=0)) > 0:
            items.append(fit)
            room -= fit
        _apply(left, tuple(items), plan)
    return plan


def _apply(left: dict[int, int], items: tuple[int, ...], plan: list) -> None:
    use = Counter(items)
    times = min(left[s] // n for s, n in use.items())
    for s, n in use.items():
        left[s] -= n * times
        if not left[s]:
            del left[s]
    plan.append((items, times))


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> list[tuple[tuple[int, ...], int]]:
    """The packing of a histogram of lengths: (lengths of one sequence, how many such sequences)."""
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    volume, least, left = sum(s * n for s, n in counts.items()), sum(t for _, t in best), dict(counts)
    path: list[tuple[tuple[int, ...], int]] = []
    options: list[Iterator] = []  # what is still to be tried at each depth
    wasted, budget = 0, Nodes(nodes)

    def choices(largest: int, spare: int) -> Iterator[tuple[tuple[int, ...], int]]:
        rest = Counter(left)
        rest[largest] -= 1
        for items in fillings(capacity - largest, +rest, spare, budget):
            bin_ = (largest, *items)
            most = min(left[s] // n for s, n in Counter(bin_).items())
            free = capacity - sum(bin_)
            for times in range(min(most, spare // free) if free else most, 0, -1):
                yield bin_, times

    while least > bound:
        if left:
            options.append(choices(max(left), (least - 1) * capacity - volume - wasted))
        else:
            least = sum(t for _, t in path)
            best = list(path)
        while options:
            if len(path) == len(options):  # the last choice is undone
                items, times = path.pop()
                wasted -= (capacity - sum(items)) * times
                for s in items:
                    left[s] = left.get(s, 0) + times
            choice = next(options[-1], None) if budget.spend() else None
            if choice:
                break
            options.pop()
        else:
            return best
        items, times = choice
        wasted += (capacity - sum(items)) * times
        for s in items:
            left[s] -= times
            if not left[s]:
                del left[s]
        path.append(choice)
    return best


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, tuple[int, ...]]]]:
    """For each length its places in rank order: (first rank, first sequence, per sequence, offsets)."""
    out: dict[int, list] = {}
    ranks: Counter = Counter()
    sequence = 0
    for items, times in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for s in items:
            offsets.setdefault(s, []).append(at)
            at += s
        for s, o in offsets.items():
            out.setdefault(s, []).append((ranks[s], sequence, len(o), tuple(o)))
            ranks[s] += len(o) * times
        sequence += times
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece of every document: doc_id, piece, start, length, ids_crc32, part, nth.

    ``part`` is the task that cut it and ``nth`` its place among that task's
    pieces of its length, from which ranks follow without a sort.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())]
    schema = pa.schema(fields)

    def run(parts):
        part, seen, encode = partition_number(), np.zeros(capacity + 1, np.int64), encoder(path).encode
        for b in parts:
            ids, bounds = encode(b.column(1))
            wide = np.insert(ids, bounds[1:], np.uint16(END)).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            doc, piece, start, length = pieces_of(np.diff(bounds), capacity)
            begins = bounds[doc] + start
            order = np.argsort(length, kind="stable")
            sizes, first = np.unique(length[order], return_index=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(first, np.diff(first, append=len(length)))
            nth += seen[length]
            seen[sizes] += np.diff(first, append=len(length))
            crc = [zlib.crc32(wide[s:e]) for s, e in zip(begins.tolist(), (begins + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), *(pa.array(x, t) for x, (_, t) in zip((piece, start, length, crc, np.full(len(doc), part), nth), fields[1:]))],
                schema=schema,
            )

    return id_and_bytes(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and offset: as few sequences as the search finds."""
    cut = stage(pieces(docs, capacity, path), "packing-pieces")
    tasks = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    # ranks of a task's first piece of each length: at most `capacity` lengths per window
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = tasks.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    where = places(pack_plan(histogram, capacity))
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])
    by_length = {s: (np.array([r[0] for r in runs]), [r[1] for r in runs], [r[3] for r in runs]) for s, runs in where.items()}
    table_of = cut.sparkSession.sparkContext.broadcast(by_length)  # bounded: the plan has a few entries a length

    def run(parts):
        known = table_of.value
        for b in parts:
            length, rank = b.column(3).to_pylist(), b.column(5).to_pylist()
            sequence, offset = [], []
            for n, r in zip(length, rank):
                begins, firsts_, offsets = known[n]
                k = int(np.searchsorted(begins, r, side="right")) - 1
                turn, slot = divmod(r - int(begins[k]), len(offsets[k]))
                sequence.append(firsts_[k] + turn)
                offset.append(offsets[k][slot])
            yield batches({**{schema.names[i]: b.column(i).cast(pa.int64()) for i in range(5)}, "sequence_id": sequence, "offset": offset}, schema)

    ranked = cut.join(firsts, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank")
    )
    out = ranked.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("piece", F.col("piece").cast("int"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return pack(table(spark, sf_dir, "documents"))
