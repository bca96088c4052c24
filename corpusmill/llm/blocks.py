"""Blocks of documents, and an exchange that answers one question per key for all blocks.

A block is a row that holds the texts of some consecutive documents.  A block
asks about its distinct keys; the keys are dealt to buckets by hash range, each
bucket sees every block's keys of its range in packed arrays, and the answers
travel back to the block in key order.  A key occurs once per block, so no key
is hot, and the number of buckets follows the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import batches, begin, partition_number, raw_values

#: Bytes of text after which a block is closed; one longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Keys that one bucket of an exchange receives on average.
BUCKET_KEYS = 1 << 20

BLOCK_SCHEMA = "block long, rows int, ids binary, known binary, lengths binary, body binary, carried binary"
_ARROW = pa.schema(
    [("block", pa.int64()), ("rows", pa.int32()), *((n, pa.binary()) for n in ("ids", "known", "lengths", "body", "carried"))]
)


class Block:
    """The documents of one block: ids (-1 and not known for null) and texts as bytes (None for null)."""

    def __init__(self, number: int, ids: np.ndarray, known: np.ndarray, texts: list):
        self.number, self.ids, self.known, self.texts = number, ids, known, texts


def _pack(values: list) -> tuple[bytes, bytes]:
    lengths = np.array([-1 if v is None else len(v) for v in values], np.int64)
    return lengths.tobytes(), b"".join(v for v in values if v)


def _unpack(lengths: bytes, body: bytes) -> list:
    out, at = [], 0
    for n in np.frombuffer(lengths, np.int64).tolist():
        out.append(None if n < 0 else body[at : at + n])
        at += max(n, 0)
    return out


def to_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, owner: str = "") -> DataFrame:
    """Blocks of ``docs(doc_id long, raw binary)``, with a third column, if any, carried along as Arrow data."""

    def run(parts):
        begin(owner)
        squeeze, first, count = zstandard.ZstdCompressor(3), partition_number() << 32, 0
        ids: list = []
        texts: list = []
        carried: list = []

        def close():
            lengths, body = _pack(texts)
            row = (
                first + count, len(ids), np.array([-1 if i is None else i for i in ids], np.int64).tobytes(),
                np.array([i is not None for i in ids]).tobytes(), lengths, squeeze.compress(body), squeeze.compress(_arrow_bytes(carried)),
            )
            return batches({f.name: [v] for f, v in zip(_ARROW, row)}, _ARROW)

        size = 0
        for b in parts:
            at = 0  # rows of the batch whose carried values are in closed blocks
            for n, (i, text) in enumerate(zip(b.column(0).to_pylist(), raw_values(b.column(1)))):
                if ids and size + len(text or b"") > block_bytes:
                    carried += [c.slice(at, n - at) for c in b.columns[2:3] if n > at]
                    at = n
                    yield close()
                    count, size, ids, texts, carried = count + 1, 0, [], [], []
                ids.append(i)
                texts.append(text)
                size += len(text or b"")
            carried += [c.slice(at) for c in b.columns[2:3] if b.num_rows > at]
        if ids:
            yield close()

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def _arrow_bytes(parts: list) -> bytes:
    if not parts:
        return b""
    column, sink = pa.concat_arrays(parts), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([pa.field("carried", column.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([column], names=["carried"]))
    return sink.getvalue().to_pybytes()


def open_block(row: dict) -> Block:
    """The block of a row with the columns of ``BLOCK_SCHEMA``."""
    body = zstandard.ZstdDecompressor().decompress(row["body"])
    return Block(row["block"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), _unpack(row["lengths"], body))


def carried_of(row: dict) -> pa.Array | None:
    """The carried values of a block's documents, as they were."""
    raw = zstandard.ZstdDecompressor().decompress(row["carried"])
    return pa.ipc.open_stream(raw).read_all().column(0).combine_chunks() if raw else None


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time."""
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def ask(blocks: DataFrame, keys: Callable[[dict], tuple[np.ndarray, bytes]], buckets: int, width: int) -> DataFrame:
    """Rows (block, bucket, n, keys, payload): each block's distinct sorted 64-bit keys and ``width`` bytes for each."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("payload", pa.binary())])

    def run(parts):
        begin()
        for b in parts:
            for row in rows_of(b):
                found, payload = keys(row)
                bucket = ((found >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                spans = [(int(cuts[k]), int(cuts[k + 1])) for k in full]
                for at in range(0, len(full), 256):
                    some, part = spans[at : at + 256], full[at : at + 256]
                    yield batches(
                        {
                            "block": [row["block"]] * len(part), "bucket": part.tolist(), "n": [e - s for s, e in some],
                            "keys": [found[s:e].tobytes() for s, e in some], "payload": [payload[s * width : e * width] for s, e in some],
                        },
                        schema,
                    )

    return blocks.mapInArrow(run, "block long, bucket long, n long, keys binary, payload binary")


def answer(
    asked: DataFrame,
    decide: Callable[[np.ndarray, np.ndarray, bytes], np.ndarray],
    per_key: int,
    total: Callable[[np.ndarray, np.ndarray], bytes] | None = None,
) -> DataFrame:
    """(block, answers): for each block the answers to its keys, in key order, ``per_key`` bytes each.

    With ``total(keys, found)`` block -1 gets a few bytes from each bucket.

    ``decide(keys, owner, payload)`` gets all keys of a bucket, the number of the
    asking row of each and the payloads, and returns an array of one answer per key.
    """
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("found", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        n = group["n"].to_numpy()
        keys = np.frombuffer(b"".join(group["keys"].to_pylist()), np.uint64)
        found = decide(keys, np.repeat(np.arange(len(n)), n), b"".join(group["payload"].to_pylist()))
        raw, ends = found.tobytes(), np.cumsum(n) * per_key
        block, bucket = group["block"].to_pylist(), group["bucket"].to_pylist()
        out = [raw[e - k * per_key : e] for e, k in zip(ends.tolist(), n.tolist())]
        if total and bucket:
            block, bucket, out = [*block, -1], [*bucket, bucket[0]], [*out, total(keys, found)]
        return pa.table([pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), pa.array(out, pa.binary())], schema=schema)

    found = asked.groupBy("bucket").applyInArrow(run, "block long, bucket long, found binary")
    parts = F.array_sort(F.collect_list(F.struct("bucket", "found")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["found"]))
    return found.groupBy("block").agg(joined.alias("answers"))


def bucket_count(total_keys: int) -> int:
    """Buckets for an exchange of so many keys."""
    return max(1, -(-total_keys // BUCKET_KEYS))


# Hashes of words and of windows of words.

_rng = np.random.default_rng(20240229)
_BYTE_AT = _rng.integers(0, 1 << 63, size=(64, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h ^= h >> np.uint64(29)
    h *= _LENGTH
    h ^= h >> np.uint64(32)
    return h


def word_hashes(raw: bytes | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, from its bytes at once."""
    if not raw:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(raw, np.uint8)  # eight bytes of temporaries a byte, for one text at a time
    inside = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    a, inside = a[starts[0] :], inside[starts[0] :]
    lengths, starts = ends - starts, starts - starts[0]
    place = np.arange(len(a)) - np.repeat(starts, np.diff(starts, append=len(a)))
    v = _BYTE_AT[place & 63, a]
    v += (place >> 6).astype(np.uint64) * _LENGTH  # a long word's later rounds differ
    v = mixed(v) if lengths.max() > 64 else v
    v[~inside] = 0
    return mixed(np.add.reduceat(v, starts) + lengths.astype(np.uint64) * _LENGTH)


def _power(step: int, n: int, inverse: bool) -> np.ndarray:
    have = _powers.get((step, inverse))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, pow(step, -1, 1 << 64) if inverse else step, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[step, inverse] = have
    return have[:n]


def window_hashes(words: np.ndarray, length: int, step: int = STEPS[0]) -> np.ndarray:
    """Hash of every window of ``length`` consecutive words."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _power(step, n, True), out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * _power(step, n - length + 1, False))


def sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every ``k`` consecutive values."""
    s = 1
    while s * 2 <= k:
        h = np.minimum(h[:-s], h[s:])
        s *= 2
    return np.minimum(h[: len(h) - (k - s)], h[k - s :]) if s < k else h
