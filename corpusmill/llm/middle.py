"""Fill-in-middle: documents cut at lines and rearranged, with the cuts found by a parallel automaton scan.

One automaton reads bytes and knows two things: whether the next byte starts a
line, and how much of a marker ``<P>``, ``<S>`` or ``<M>`` stands just before it.
A chunk does not know the state it is entered in, so it emits for each of the
six states the state it leaves in, the lines it starts and the markers it
completes.  These functions compose associatively: within a chunk byte by byte in
a tree, across the chunks of a giant document in groups and then across groups.
Once entry states are known, every chunk finds for itself which cuts lie in it.
A document of at most ``CHUNK`` bytes is one chunk and stays in its task; a
longer one is dealt as chunks over all tasks and its text is put together once, as the row it becomes.

Defined results: null text is an empty text, whose form is plain with no lines;
without ``doc_id`` the numbers are drawn from ``7:``; repeated rows each get a row;
text already holding a marker is left plain, also where the marker lies across
chunks; a text may be as long as a row; an empty table gives an empty result;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import batches, begin, stage, table

SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
MARKERS = ("<P>", "<S>", "<M>")
CHUNK, GROUP = 1 << 18, 512  # bytes of a chunk; chunks composed in one group
SCAN = 1 << 20  # bytes of short texts that are scanned together

# The automaton.  Symbols: any other byte, line feed, "<", a marker's letter after "<", ">" after such a letter.
# State 3 * inside_a_line + (0 nothing, 1 "<", 2 "<" and a letter of a marker).
OTHER, FEED, OPEN, LETTER, CLOSE = range(5)
STATES = 6
_NEXT, _LINE, _MARK = (np.zeros((5, STATES), np.int64) for _ in range(3))
for _state in range(STATES):
    _inside, _seen = divmod(_state, 3)
    for _symbol in range(5):
        _progress = 1 if _symbol == OPEN else 2 if _symbol == LETTER and _seen == 1 else 0
        _NEXT[_symbol, _state] = (0 if _symbol == FEED else 3) + _progress
        _LINE[_symbol, _state] = not _inside
        _MARK[_symbol, _state] = _symbol == CLOSE and _seen == 2


def symbols(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of chunks that lie side by side in ``data``, a run of other bytes as one, and the chunks' bounds in them."""
    ends = np.append(starts[1:], len(data))
    before = np.empty_like(data)
    before[1:] = data[:-1]
    first = np.zeros(len(data), bool)
    first[starts[starts < ends]] = True  # what stands before a chunk is unknown
    letter = (data == ord("P")) | (data == ord("S")) | (data == ord("M"))
    was_letter = (before == ord("P")) | (before == ord("S")) | (before == ord("M"))
    kind = np.zeros(len(data), np.uint8)
    kind[data == 10] = FEED
    kind[data == ord("<")] = OPEN
    kind[letter & ((before == ord("<")) | first)] = LETTER
    kind[(data == ord(">")) & (was_letter | first)] = CLOSE
    at = np.flatnonzero(kind)
    chunk = np.searchsorted(starts, at, "right") - 1
    last = np.concatenate([[-1], at[:-1]]) if len(at) else at
    gap = at[at - np.maximum(last, starts[chunk] - 1) > 1]
    tail = starts - 1
    np.maximum.at(tail, chunk, at)
    rest = ends[tail < ends - 1]
    place = np.concatenate([2 * at, 2 * gap - 1, 2 * rest - 1])
    what = np.concatenate([kind[at], np.zeros(len(gap) + len(rest), np.uint8)])
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], 2 * starts)
    return what[order], np.append(bounds, len(place))


def compose(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Functions ``f`` followed by ``g``, both (functions, 3, states): next state, lines started, markers completed."""
    then = np.take_along_axis(g, np.broadcast_to(f[:, :1], g.shape), axis=2)
    then[:, 1:] += f[:, 1:]
    return then


IDENTITY = np.stack([np.arange(STATES), np.zeros(STATES, np.int64), np.zeros(STATES, np.int64)])


def functions(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The function of each chunk, (chunks, 3, states): pairs of neighbours in a chunk are composed until one is left."""
    what, bounds = symbols(data, starts)
    f = np.stack([_NEXT[what], _LINE[what], _MARK[what]], axis=1).astype(np.int32)
    count = np.diff(bounds)
    while len(count) and count.max() > 1:
        begins = np.repeat(np.cumsum(count) - count, count)
        place = np.arange(len(f)) - begins
        even = np.flatnonzero(place % 2 == 0)
        paired = place[even] + 1 < np.repeat(count, count)[even]
        merged = f[even]
        merged[paired] = compose(merged[paired], f[even[paired] + 1])
        f, count = merged, (count + 1) // 2
    out = np.repeat(IDENTITY[None].astype(np.int64), len(count), axis=0)
    out[count > 0] = f
    return out


def drawn(doc_id: int | None, n: int, marked: bool, empty: bool, seed: int, fim: int, spm: int) -> tuple[str, int, int]:
    """Form, and after how many lines prefix and middle end."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h = [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]
    if empty or marked or h[2] % 100 >= fim:
        return "plain", n, n
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return "spm" if h[3] % 100 < spm else "psm", low, high


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero(data & 0xC0 != 0x80))


_WHOLE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix", pa.string()), ("middle", pa.string()), ("suffix", pa.string())])
_WHOLE_DDL = "doc_id long, n long, form string, prefix string, middle string, suffix string"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value starts, the end last."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _whole(seed: int, fim: int, spm: int):
    """Texts of one chunk: scanned together, cut where they lie."""

    def some(ids: list, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        starts = offsets[:-1]
        found = functions(data, starts)[:, 1:, 0]
        feeds = np.flatnonzero(data == 10)
        first = np.searchsorted(feeds, starts)
        rows: list[list] = [[], [], [], [], []]
        for k, doc_id in enumerate(ids):
            a, z, n = int(offsets[k]), int(offsets[k + 1]), int(found[k, 0])
            form, low, high = drawn(doc_id, n, bool(found[k, 1]), a == z, seed, fim, spm)
            cut = [a if not x else z if x == n else int(feeds[first[k] + x - 1]) + 1 for x in (low, high)]
            parts = (data[s:e].tobytes() for s, e in ((a, cut[0]), (cut[0], cut[1]), (cut[1], z)))
            for out, value in zip(rows, (n, form, *parts)):
                out.append(value)
        texts = [pa.array(x, pa.binary()).cast(pa.string()) for x in rows[2:]]
        return batches({"doc_id": ids, "n": rows[0], "form": rows[1], "prefix": texts[0], "middle": texts[1], "suffix": texts[2]}, _WHOLE)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for b in parts:
            if not len(b):
                continue
            ids = b.column(0).to_pylist()
            data, offsets = _bytes(b.column(1))
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SCAN, "right")) - 1)
                yield some(ids[at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                at = to

    return run


_CHUNKS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("raw", pa.binary())])


def _split(chunk: int):
    def run(parts):
        begin()
        for b in parts:
            for k in range(len(b)):
                text, at, part = memoryview(b.column(2)[k].as_buffer()), 0, 0
                row, doc_id = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                while at < len(text):
                    to = min(at + chunk, len(text))
                    while to < len(text) and text[to] & 0xC0 == 0x80:
                        to += 1
                    yield batches({"row": [row], "doc_id": [doc_id], "part": [part], "raw": [bytes(text[at:to])]}, _CHUNKS)
                    at, part = to, part + 1

    return run


_SCANNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("f", pa.list_(pa.int64()))])
_SCANNED_DDL = "row long, doc_id long, part long, f array<long>"


def _table(found: np.ndarray) -> pa.Array:
    """Functions as lists of their 3 x states numbers."""
    flat = found.reshape(len(found), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * 3 * STATES), pa.array(flat.ravel()))


def _untable(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, STATES)


def _scan(parts):
    begin()
    for b in parts:
        if len(b):
            data, offsets = _bytes(b.column(3))
            for k in range(len(b)):  # one at a time: a chunk of line feeds only has as many symbols as bytes
                one = functions(data[offsets[k] : offsets[k + 1]], np.zeros(1, np.int64))
                yield batches({"row": b.column(0)[k : k + 1], "doc_id": b.column(1)[k : k + 1], "part": b.column(2)[k : k + 1], "f": _table(one)}, _SCANNED)


def _prefixes(found: np.ndarray) -> np.ndarray:
    """What holds before each function, when the first is entered in state 0: (functions + 1, 3)."""
    out = np.zeros((len(found) + 1, 3), np.int64)
    for k, f in enumerate(found):
        state = out[k, 0]
        out[k + 1] = (f[0, state], out[k, 1] + f[1, state], out[k, 2] + f[2, state])
    return out


def _composed(t: pa.Table) -> pa.Table:
    """The function of one group of neighbouring chunks."""
    t = t.sort_by("part")
    found, width = _untable(t["f"]), 1
    while len(found) > 1:
        width = len(found) // 2 * 2
        found = np.concatenate([compose(found[0:width:2], found[1:width:2]), found[width:]])
    return pa.Table.from_arrays([t["row"][:1], t["doc_id"][:1], t["part"][:1], _table(found)], schema=_SCANNED)


def _entered(seed: int, fim: int, spm: int):
    schema = pa.schema([(n, pa.int64()) for n in ("row", "part", "state", "lines", "n", "low", "high")] + [("form", pa.string())])

    def run(t: pa.Table) -> pa.Table:
        """Entry states of a giant document's groups, and its cuts, which its whole function decides."""
        t = t.sort_by("part")
        before = _prefixes(_untable(t["f"]))
        n = int(before[-1, 1])
        form, low, high = drawn(t["doc_id"][0].as_py(), n, bool(before[-1, 2]), False, seed, fim, spm)
        m = len(t)
        rest = {"n": [n] * m, "low": [low] * m, "high": [high] * m, "form": [form] * m}
        return pa.Table.from_batches([batches({"row": t["row"].combine_chunks(), "part": t["part"].combine_chunks(), "state": before[:-1, 0].tolist(), "lines": before[:-1, 1].tolist()} | rest, schema)])

    return run


def _resolved(t: pa.Table) -> pa.Table:
    """Entry states of the chunks of one group, from that of the group."""
    t = t.sort_by("part")
    state, lines = t["state"][0].as_py(), t["lines"][0].as_py()
    states, counts = [], []
    for f in _untable(t["f"]):
        states.append(state)
        counts.append(lines)
        state, lines = int(f[0, state]), lines + int(f[1, state])
    return t.drop_columns(["f", "state", "lines"]).append_column("state", pa.array(states, pa.int64())).append_column("lines", pa.array(counts, pa.int64()))


_PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix", pa.string()), ("middle", pa.string()), ("suffix", pa.string())])


def cut_at(data: np.ndarray, state: int, lines: int, k: int) -> int:
    """Bytes of a chunk, entered in ``state`` after ``lines`` lines began, that belong to the first ``k`` lines."""
    nth = k + 1 - lines  # of the lines that begin in this chunk
    if nth <= 0:
        return 0
    feeds = np.flatnonzero(data[:-1] == 10) + 1
    begins = np.concatenate([[0], feeds]) if state < 3 and len(data) else feeds
    return int(begins[nth - 1]) if nth <= len(begins) else len(data)


def _cut(parts):
    begin()
    for b in parts:
        for k in range(len(b)):
            row, doc_id, part, raw, state, lines, n, low, high, form = (b.column(i)[k].as_py() for i in range(10))
            data = np.frombuffer(raw, np.uint8)
            a, z = (cut_at(data, state, lines, x) for x in (low, high))
            texts = (raw[:a].decode(), raw[a:z].decode(), raw[z:].decode())
            yield batches(dict(zip(_PIECES.names, ([x] for x in (row, doc_id, part, n, form, *texts)))), _PIECES)


def _giants(docs: DataFrame, chunk: int, seed: int, fim: int, spm: int) -> DataFrame:
    """Documents that are dealt as chunks."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "raw")
    chunks = stage(numbered.mapInArrow(_split(chunk), "row long, doc_id long, part long, raw binary"), "middle-chunks")
    found = stage(chunks.repartition("row", "part").mapInArrow(_scan, _SCANNED_DDL), "middle-functions")
    grouped = found.withColumn("grp", F.floor(F.col("part") / GROUP))
    groups = grouped.groupBy("row", "grp").applyInArrow(_composed, _SCANNED_DDL)
    entered = groups.groupBy("row").applyInArrow(_entered(seed, fim, spm), "row long, part long, state long, lines long, n long, low long, high long, form string")
    entered = entered.select("row", F.floor(F.col("part") / GROUP).alias("grp"), "state", "lines", "n", "low", "high", "form")
    ddl = "row long, part long, n long, low long, high long, form string, state long, lines long"
    known = grouped.drop("doc_id").join(entered, ["row", "grp"]).select("row", "grp", "part", "f", "state", "lines", "n", "low", "high", "form")
    known = known.groupBy("row", "grp").applyInArrow(lambda t: _resolved(t.drop_columns(["grp"])), ddl)
    pieces = chunks.join(known, ["row", "part"]).select("row", "doc_id", "part", "raw", "state", "lines", "n", "low", "high", "form").mapInArrow(_cut, "row long, doc_id long, part long, n long, form string, prefix string, middle string, suffix string")
    one = pieces.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("form").alias("form"),
        F.array_sort(F.collect_list(F.struct("part", "prefix", "middle", "suffix"))).alias("all"),
    )
    text = lambda name: F.array_join(F.transform("all", lambda x: x[name]), "").alias(name)
    return one.select("doc_id", "n", "form", text("prefix"), text("middle"), text("suffix"))


def fill_in_middle(docs: DataFrame, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``n`` lines, ``form``, ``prefix_chars``, ``middle_chars`` and the rearranged ``output`` of every document.

    ``fim`` percent of the documents are rearranged, ``spm`` percent of those suffix first.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    small = raw.filter(F.octet_length("raw") <= chunk).mapInArrow(_whole(seed, fim, spm), _WHOLE_DDL)
    both = small.unionByName(_giants(raw.filter(F.octet_length("raw") > chunk), chunk, seed, fim, spm))
    p, s, m = (F.lit(x) for x in MARKERS)
    output = (
        F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle"))
        .when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
        .otherwise(F.col("prefix"))
    )
    chars = lambda name: F.when(F.col("form") != "plain", F.char_length(name).cast("long")).alias(f"{name}_chars")
    return both.select("doc_id", "n", "form", chars("prefix"), chars("middle"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of ``fill_in_middle`` was made from; a rearranged text holds no marker of its own."""
    p, s, m = MARKERS
    body = F.substr(F.col(output), F.lit(len(p) + 1))
    head, middle = F.substring_index(body, m, 1), F.substring_index(body, m, -1)
    psm = F.concat(F.substring_index(head, s, 1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(head, p, 1))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged for fill-in-middle training, every output turned back into its text."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
