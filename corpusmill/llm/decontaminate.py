"""Benchmark decontamination with an FM-index per training shard.

A shard is a stretch of at most ``SHARD_BYTES`` of one task's documents; its index is
built once for each pass and answers all test windows of the pass.  Its symbols are the words that occur in the
test windows; a word that occurs in none can be in no occurrence, so it
ends a run, and runs shorter than the shortest window are left out.  What is
left is indexed: a suffix array gives the Burrows-Wheeler transform, a wavelet
tree of rank-counted bit vectors answers how often a symbol occurs before a
place, backward search narrows all test windows at once symbol by symbol, and
sampled suffix positions locate the occurrences by walking back to a sample.
The spans of a document's occurrences are merged before removal.

The test windows are a stated query set: they go to the tasks in passes of at
most ``PASS_BYTES``, so nothing broadcast grows with the benchmark; a worker turns a pass
into arrays once and keeps them for its later tasks; the result is
written after each pass but the last, and the spans of all passes are merged.

Defined results: null has no words; an item without words has no windows;
repeated items count once by ``item_id``, a null ``item_id`` marks words but is
not listed; repeated documents each get a row; an empty benchmark leaves all
documents clean; other columns are carried or ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import alnum_words, begin, free_name, raw_values, stage, table

WINDOW = 10
#: Text bytes of the benchmark items of one pass; a proven bound on what is broadcast.
PASS_BYTES = 16 << 20
SAMPLE = 8
#: Text bytes of the documents of one shard; one longer text is a shard of its own.
SHARD_BYTES = 16 << 20


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        self.before = np.zeros(len(bits) + 1, np.int32)
        np.cumsum(bits, out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        return self.before[at]


class WaveletTree:
    """Rank of any symbol before any place, by one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(largest).bit_length())
        for level in reversed(range(self.depth)):
            bits = symbols >> level & 1
            self.levels.append(Bits(bits))
            self.zeros.append(len(symbols) - int(bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``, for arrays of both."""
        low, high = np.zeros_like(at), at
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (self.depth - 1 - k) & 1) == 1
            low_ones, high_ones = bits.rank(low), bits.rank(high)
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the compared length."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, step = len(symbols), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        moved = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(moved[1:] != moved[:-1])])
        if step >= n or rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over one shard's symbols (each at least 1)."""

    def __init__(self, symbols: np.ndarray, largest: int, sample: int = SAMPLE):
        text = np.append(symbols.astype(np.int64), 0)  # the end sorts first
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.tree = WaveletTree(self.bwt, largest)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        self.sampled = order % sample == 0
        self.sample_rank = Bits(self.sampled)
        self.samples = order[self.sampled]
        self.rows = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each pattern; patterns are right-aligned."""
        return self.narrow(lambda live, k: patterns[live, patterns.shape[1] - 1 - k], lengths)

    def narrow(self, symbol: Callable[[np.ndarray, int], np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for patterns given by a function: the symbols of some of them, counted from the end."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.rows, np.int64)
        for k in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((k < lengths) & (low < high))
            if not len(live):
                break
            c = symbol(live, k)
            low[live] = self.starts[c] + self.tree.rank(c, low[live])
            high[live] = self.starts[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: step back until a sampled position."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[at[open_]]
            ready = open_[done]
            out[ready] = self.samples[self.sample_rank.rank(at[ready])] + steps[ready]
            open_ = open_[~done]
            c = self.bwt[at[open_]]
            at[open_] = self.starts[c] + self.tree.rank(c, at[open_])
            steps[open_] += 1
        return out


class TestWindows:
    """The distinct windows of some benchmark items: symbols of their words and which items have which window.

    Items are one array of symbols, each followed by zeros, so that a window is a place in it.  Windows are told
    apart by ranks of their halves, doubled from single symbols, so nothing is kept for a window but numbers.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.symbol: dict[bytes, int] = {}
        parts, sizes, self.names = [], [], []
        for name, raw in items:
            words = alnum_words(raw)
            if words:
                numbers = (self.symbol.setdefault(w, len(self.symbol) + 1) for w in words)
                parts += [np.fromiter(numbers, np.int32, len(words)), np.zeros(window, np.int32)]
                sizes.append(len(words))
                self.names.append(name)
        self.codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        n = np.array(sizes, np.int64)
        count = np.maximum(n - window + 1, 1)
        owner = np.repeat(np.arange(len(n)), count)
        begin_of = np.cumsum(n + window) - (n + window)
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin_of[owner]
        rank, width = self.codes.astype(np.int64), 1
        while 2 * width <= window:
            rank = np.unique(rank << 32 | np.append(rank[width:], np.zeros(min(width, len(rank)), np.int64)), return_inverse=True)[1].astype(np.int64)
            width *= 2
        _, first, which = np.unique(rank[starts] << 32 | rank[starts + window - width], return_index=True, return_inverse=True)
        self.lengths = np.minimum(n, window)[owner[first]]
        self.ends = starts[first] + self.lengths
        self.shortest = int(self.lengths.min()) if len(first) else 0
        listed = np.unique(which * max(len(n), 1) + owner)
        self.item = listed % max(len(n), 1)
        self.bounds = np.searchsorted(listed // max(len(n), 1), np.arange(len(first) + 1))

    def items_of(self, which: int) -> list[str]:
        """The named items that have a window."""
        found = (self.names[i] for i in self.item[self.bounds[which] : self.bounds[which + 1]])
        return [x for x in found if x is not None]


#: The windows of the pass that this worker is at, by the name of the pass.
_known: dict[str, TestWindows] = {}


def _windows(name: str, block: list, window: int) -> TestWindows:
    """The windows of a pass, made once in a worker."""
    if name not in _known:
        _known.clear()
        _known[name] = TestWindows(block, window)
    return _known[name]


def _runs(symbols: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(symbols > 0, prepend=False, append=False)).reshape(-1, 2)
    return edges[edges[:, 1] - edges[:, 0] >= shortest].tolist()


_FAR = 1 << 40  # more words than a text has


def _shard_hits(runs: list[tuple[int, int, np.ndarray]], tests: TestWindows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end, window) of every occurrence in the runs (document, first word, symbols)."""
    stop = len(tests.symbol) + 1
    text = np.concatenate([x for _, _, s in runs for x in (s, [stop])]).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum([len(s) + 1 for _, _, s in runs])[:-1]])
    index = FMIndex(text, stop)
    low, high = index.narrow(lambda live, k: tests.codes[tests.ends[live] - 1 - k], tests.lengths)
    hit = np.flatnonzero(high > low)
    n = (high - low)[hit]
    window = np.repeat(hit, n)
    rows = np.repeat(low[hit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    at = index.locate(rows)
    run = np.searchsorted(begins, at, side="right") - 1
    first = at - begins[run] + np.array([f for _, f, _ in runs], np.int64)[run]
    return np.array([d for d, _, _ in runs], np.int64)[run], first, first + tests.lengths[window], window


def find_spans(texts: Iterable[bytes | None], tests: TestWindows) -> list[tuple[int, list[list[int]], set[str]]]:
    """For each text of one shard: words, merged spans [start, end) of occurrences, and the items that occur."""
    counts: list[int] = []
    runs: list = []
    symbol = tests.symbol.get
    for doc, raw in enumerate(texts):
        words = alnum_words(raw)
        counts.append(len(words))
        if not words or not tests.shortest:
            continue
        symbols = np.fromiter((symbol(w, 0) for w in words), np.int32, len(words))
        for s, e in _runs(symbols, tests.shortest):
            runs.append((doc, s, symbols[s:e]))
    spans: list[list[list[int]]] = [[] for _ in counts]
    items: list[set[str]] = [set() for _ in counts]
    if runs:
        doc, first, end, window = _shard_hits(runs, tests)
        order = np.lexsort((first, doc))
        doc, first, reach = doc[order], first[order], np.maximum.accumulate(doc[order] * _FAR + end[order]) if len(doc) else end
        new = np.ones(len(doc), bool)  # an occurrence that begins past the end of all before it in its document
        new[1:] = (doc[1:] != doc[:-1]) | (doc[1:] * _FAR + first[1:] > reach[:-1])
        at = np.flatnonzero(new)
        for d, s, e in zip(doc[at].tolist(), first[at].tolist(), (reach[np.append(at[1:], len(doc))[: len(at)] - 1] - doc[at] * _FAR).tolist()):
            spans[d].append([s, e])
        for key in np.unique(doc * len(tests.lengths) + window[order]).tolist() if len(doc) else ():
            items[key // len(tests.lengths)].update(tests.items_of(key % len(tests.lengths)))
    return list(zip(counts, spans, items))


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = PASS_BYTES) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items in blocks of bounded size, one block at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("raw"))
    block: list = []
    size = 0
    for row in items.toLocalIterator():
        raw = bytes(row.raw) if row.raw is not None else None
        if block and size + len(raw or b"") > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item_id, raw))
        size += len(raw or b"")
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = PASS_BYTES, into: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """``docs`` with three columns added, named by ``into``: words, spans (merged, of word numbers) and items (sorted).

    Columns of ``docs`` with these names give way.  One pass over ``docs`` for each ``block_bytes`` of the benchmark; most benchmarks are one pass.
    """
    out = docs = docs.drop(*into)
    for name, form in zip(into, ("long", "array<array<long>>", "array<string>")):
        out = out.withColumn(name, F.lit(0).cast("long") if form == "long" else F.array().cast(form))
    given, schema = docs.columns, out.schema
    for k, block in enumerate(benchmark_blocks(benchmark, block_bytes)):
        if k:
            out = stage(out, "decontaminate")
        tests = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block, window))

        def run(parts, tests=tests):
            begin("decontaminate", _known.clear)
            known = _windows(*tests.value)
            for shard in _shards(parts):
                texts = [b.column(b.schema.get_field_index("text")).cast(pa.binary()) for b in shard]  # views of the same bytes
                found = iter(find_spans(chain.from_iterable(map(raw_values, texts)), known))
                for b in shard:
                    counts, spans, items = [], [], []
                    for old, listed, (n, new, names) in zip(b.column(into[1]).to_pylist(), b.column(into[2]).to_pylist(), found):
                        counts.append(n)
                        spans.append(merge(old + new) if old else new)
                        items.append(sorted(names.union(listed)))
                    added = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in given), *added], names=[*given, *into])

        out = out.mapInArrow(run, schema)
    return out


def _shards(parts: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The batches of one shard after another."""
    shard: list[pa.RecordBatch] = []
    size = 0
    for b in parts:
        if shard and size + b.nbytes > SHARD_BYTES:
            yield shard
            shard, size = [], 0
        shard.append(b)
        size += b.nbytes
    if shard:
        yield shard


def merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping or touching spans joined."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def remove_spans(raw: bytes, spans: list[list[int]]) -> bytes:
    """The text without the stretches of the spans' words; what lies outside them is unchanged."""
    lower = raw.translate(_WORD_MARK)
    a = np.frombuffer(lower, np.uint8) == 1
    edges = np.flatnonzero(np.diff(a, prepend=False, append=False)).reshape(-1, 2)
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : edges[s][0]])
        at = int(edges[e - 1][1])
    return b"".join([*out, raw[at:]])


_WORD_MARK = bytes(int(b >= 128 or chr(b).isalnum()) for b in range(256))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the contaminated stretches cut out of ``text``; clean rows and all other columns are unchanged."""
    given = docs.columns
    n, spans, items = into = tuple(free_name(given, x) for x in ("_n_words", "_spans", "_items"))
    found = find_contamination(docs, benchmark, window, into=into)

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        return pd.Series([t if t is None or not len(s) else remove_spans(t.encode(), [list(x) for x in s]).decode() for t, s in zip(text, spans)], dtype=object)

    return found.withColumn("text", F.when(F.size(spans) > 0, cut("text", spans)).otherwise(F.col("text"))).select(*given)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
