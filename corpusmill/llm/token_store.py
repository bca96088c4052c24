"""A content-addressed store of token ids.

A rolling hash of the last ``REACH`` ids cuts every document's id stream into
chunks at content-given places; a chunk is named by its SHA-256 and stored once,
whoever shares it.  A document is a recipe: its chunk names in order.  Recipes
lie in ascending ``doc_id`` order in numbered shards; a Merkle tree over the
chunk names gives a document's root, over the roots a shard's, and over the
shards the store's, kept in the manifest.

Layout, all Parquet: ``chunks`` (name, n, ids as little-endian unsigned 16-bit
integers), ``recipes`` (place, doc_id, start, n_tokens, root, names, ends: the ids
up to each chunk's end), ``manifest`` (shard, documents, n_tokens, root).

Reading back hashes every stored chunk anew, compares names and roots, and puts
the checksum of a document together from the checksums of its chunks as read;
``restore`` returns the ids themselves.  Uses of one chunk are gathered in each
task before they meet it, so a chunk that a third of all documents share is met
once a task.

Defined results: null or empty text is the end id alone; rows with equal
``doc_id`` follow one another by content, a null ``doc_id`` comes first; an empty
table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.blocks import mixed, window_hashes
from corpusmill.llm.common import batches, id_and_bytes, partition_number, raw_values, shared_dir, stage, table
from corpusmill.llm.tokens import END, encoder

REACH, LEAST, MOST, MEAN = 8, 64, 2048, 256
_MIXED = mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))
#: Documents of one shard on average, and most shards: a bound on the offsets that are broadcast.
SHARD_DOCUMENTS, SHARDS = 1 << 16, 100_000
#: Uses of chunks that a task gathers before it sends them.
GATHERED = 200_000


def marks(ids: np.ndarray) -> np.ndarray:
    """Places where the ``REACH`` ids before ask for a cut."""
    return np.flatnonzero(window_hashes(_MIXED[ids], REACH) % np.uint64(MEAN) == 0) + REACH


def cut(n: int, wanted: list[int]) -> list[int]:
    """Ends of the chunks of ``n`` ids with wanted cuts."""
    ends, last = [], 0
    for m in wanted:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST and m < n:
            ends.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n] if n else ends


def merkle_root(names: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up unchanged; no leaves hash to that of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in names] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


class MerkleTree:
    """The root of leaves that come one at a time; holds one hash a level.

    The same tree as ``merkle_root``: a subtree is closed once it is full, and at the end those left over are paired from the right.
    """

    def __init__(self):
        self.open: list[tuple[int, bytes]] = []

    def add(self, name: bytes) -> None:
        level, node = 0, hashlib.sha256(b"\0" + name).digest()
        while self.open and self.open[-1][0] == level:
            level, node = level + 1, hashlib.sha256(b"\1" + self.open.pop()[1] + node).digest()
        self.open.append((level, node))

    def root(self) -> bytes:
        if not self.open:
            return merkle_root([])
        node = self.open[-1][1]
        for _, left in reversed(self.open[:-1]):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


# CRC-32 of joined parts: the checksum of a part, moved past the bytes that follow it, adds up by exclusive or.


def _zero_tables() -> list[np.ndarray]:
    """For each j, four tables of 256 that move a checksum past 2**j zero bytes."""
    step = np.array([zlib.crc32(b"\0", 1 << i ^ 0xFFFFFFFF) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for i in range(32)], np.uint64)

    def apply(columns: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), np.uint64)
        for i in range(32):
            out ^= np.where(v >> np.uint64(i) & np.uint64(1), columns[i], np.uint64(0))
        return out

    out, byte = [], np.arange(256, dtype=np.uint64)
    for _ in range(48):
        out.append(np.stack([apply(step, byte << np.uint64(8 * k)) for k in range(4)]))
        step = apply(step, step)
    return out


_zeros: list[np.ndarray] = []


def moved_past(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Checksums as they count in a text that goes on for ``after`` bytes."""
    if not _zeros:
        _zeros.extend(_zero_tables())
    crc, after = crc.astype(np.uint64), after.astype(np.int64)
    for j in range(int(after.max()).bit_length() if len(after) else 0):
        on = np.flatnonzero(after >> j & 1)
        c, t = crc[on], _zeros[j]
        crc[on] = t[0][c & np.uint64(255)] ^ t[1][c >> np.uint64(8) & np.uint64(255)] ^ t[2][c >> np.uint64(16) & np.uint64(255)] ^ t[3][c >> np.uint64(24)]
    return crc.astype(np.int64)


_PARTS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("names", pa.binary()), ("ends", pa.list_(pa.int64())),
          ("name", pa.binary()), ("ids", pa.binary())]


def _encoded(docs: DataFrame, path: str | None) -> DataFrame:
    """A row for each document (doc_id, n_tokens, root, names of 32 bytes a chunk, ends) and for each chunk that is new to its task (name, ids)."""
    schema = pa.schema(_PARTS)
    end = np.array([END], np.uint16)

    def run(parts):
        encode, sent = encoder(path).encode, set()
        for b in parts:
            ids, bounds = encode(b.column(1))
            ids = np.insert(ids, bounds[1:], end)
            bounds = bounds + np.arange(len(bounds))
            raw, wanted = ids.tobytes(), marks(ids)
            inner = np.searchsorted(wanted, bounds[:-1] + REACH), np.searchsorted(wanted, bounds[1:])
            rows: dict[str, list] = {n: [] for n, _ in _PARTS}
            fresh: list[tuple[bytes, bytes]] = []
            for doc, s, e, i, j in zip(b.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), inner[0].tolist(), inner[1].tolist()):
                ends = cut(e - s, (wanted[i:j] - s).tolist())
                names = []
                for at, to in zip([0, *ends[:-1]], ends):
                    chunk = raw[2 * (s + at) : 2 * (s + to)]
                    names.append(name := hashlib.sha256(chunk).digest())
                    if name not in sent:
                        fresh.append((name, chunk))
                        if len(sent) < GATHERED:  # beyond it a chunk may be sent again
                            sent.add(name)
                for column, v in zip(rows.values(), (doc, e - s, merkle_root(names), b"".join(names), ends, None, None)):
                    column.append(v)
            yield batches(rows, schema)
            none = [None] * len(fresh)
            yield batches({**{n: none for n, _ in _PARTS}, "name": [x for x, _ in fresh], "ids": [x for _, x in fresh]}, schema)

    return id_and_bytes(docs).mapInArrow(run, "doc_id long, n_tokens long, root binary, names binary, ends array<long>, name binary, ids binary")


def _once(chunks: DataFrame) -> DataFrame:
    """(name, n, ids): every distinct chunk once.  A task sends a chunk once, so a shared one is at most as hot as there are tasks."""

    def run(parts):
        kept: set[bytes] = set()
        for b in parts:
            fresh = []
            for i, name in enumerate(b.column(0).to_pylist()):
                if name not in kept:
                    kept.add(name)
                    fresh.append(i)
            yield b.take(pa.array(fresh, pa.int32()))

    return chunks.repartition("name").mapInArrow(run, "name binary, ids binary").select("name", (F.length("ids") / 2).cast("long").alias("n"), "ids")


def _numbered(listed: DataFrame) -> DataFrame:
    """The sorted recipes of each partition with their shard, place and the ids ahead of them there; then a row of the shard's sums."""
    fields = [*_PARTS[:5], ("shard", pa.int64()), ("place", pa.int64()), ("ahead", pa.int64()), ("documents", pa.int64())]
    schema = pa.schema(fields)

    def run(parts):
        shard, count, total, tree = partition_number(), 0, 0, MerkleTree()
        for b in parts:
            n = b.column(1).to_numpy()
            ahead = total + np.cumsum(n) - n
            for root in b.column(2).to_pylist():
                tree.add(root)
            place = (shard << 33) + count + np.arange(len(n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), shard)), pa.array(place), pa.array(ahead), pa.nulls(len(n), pa.int64())], schema=schema)
            count, total = count + len(n), total + int(n.sum())
        if count:
            last = {"n_tokens": total, "root": tree.root(), "shard": shard, "documents": count}
            yield batches({name: [last.get(name)] for name, _ in fields}, schema)

    return listed.mapInArrow(run, "doc_id long, n_tokens long, root binary, names binary, ends array<long>, shard long, place long, ahead long, documents long")


def write_store(docs: DataFrame, path: str | None = None, store: str | None = None) -> str:
    """Write the store of ``docs`` and return its folder."""
    spark = docs.sparkSession
    store = store or f"{shared_dir(spark)}/corpusmill/token-store-{uuid.uuid4().hex}"
    encoded = stage(_encoded(docs, path), "token-ids")
    _once(encoded.filter("name IS NOT NULL").select("name", "ids")).write.option("compression", "zstd").parquet(f"{store}/chunks")
    listed = encoded.filter("name IS NULL").select("doc_id", "n_tokens", "root", "names", "ends")
    shards = min(SHARDS, max(1, -(-listed.count() // SHARD_DOCUMENTS)))
    ordered = listed.repartitionByRange(shards, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    placed = stage(_numbered(ordered), "token-recipes")
    manifest = placed.filter("documents IS NOT NULL").select("shard", "documents", "n_tokens", "root")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))  # a row for each of at most SHARDS shards
    recipes = placed.filter("documents IS NULL").join(F.broadcast(offsets), "shard").select(
        "place", "doc_id", (F.col("offset") + F.col("ahead")).alias("start"), "n_tokens", "root", "names", "ends"
    )
    recipes.write.option("compression", "zstd").parquet(f"{store}/recipes")
    manifest.write.parquet(f"{store}/manifest")
    return store


def _uses(recipes: DataFrame) -> DataFrame:
    """(name, places, after): the documents that use a chunk and the ids that follow it there, gathered in each task, as packed 64-bit integers."""
    schema = pa.schema([("name", pa.binary()), ("places", pa.binary()), ("after", pa.binary())])

    def run(parts):
        met: dict[bytes, list[int]] = {}
        size = 0

        def send():
            both = {k: np.array(v, np.int64).reshape(-1, 2) for k, v in met.items()}
            for at in range(0, len(both), 4096):
                some = list(both.items())[at : at + 4096]
                yield batches({"name": [k for k, _ in some], "places": [v[:, 0].tobytes() for _, v in some], "after": [v[:, 1].tobytes() for _, v in some]}, schema)

        for b in parts:
            for place, names, ends in zip(b.column(0).to_pylist(), raw_values(b.column(1)), b.column(2).to_pylist()):
                for k, e in enumerate(ends):
                    met.setdefault(names[32 * k : 32 * k + 32], []).extend((place, ends[-1] - e))
                size += len(ends)
                if size >= GATHERED:
                    yield from send()
                    met, size = {}, 0
        yield from send()

    return recipes.select("place", "names", "ends").mapInArrow(run, "name binary, places binary, after binary")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and verified, for every document, from the store's files."""
    schema = pa.schema([("name", pa.binary()), ("n", pa.int64()), ("crc", pa.int64()), ("good", pa.bool_())])

    def check(parts):
        for b in parts:
            rows: dict[str, list] = {"name": [], "n": [], "crc": [], "good": []}
            for name, n, ids in zip(raw_values(b.column(0)), b.column(1).to_pylist(), raw_values(b.column(2))):
                rows["name"].append(name)
                rows["n"].append(n)
                rows["crc"].append(zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4")))
                rows["good"].append(hashlib.sha256(ids).digest() == name and len(ids) == 2 * n)
            yield batches(rows, schema)

    def move(parts):
        for b in parts:
            places, after = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.int64) for k in (0, 1))
            times = np.array([len(x) // 8 for x in b.column(0).to_pylist()], np.int64)
            crc, n, good = (np.repeat(b.column(k).to_numpy(zero_copy_only=False), times) for k in (2, 3, 4))
            # one row a document of the batch: checksums add up by exclusive or
            order = np.argsort(places, kind="stable")
            first = np.flatnonzero(np.diff(places[order], prepend=-1))
            if len(first):
                parts_ = moved_past(crc, after * 4)[order], n[order], good[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places[order][first]), *(pa.array(f.reduceat(x, first)) for f, x in zip((np.bitwise_xor, np.add, np.logical_and), parts_))],
                    names=["place", "crc", "n", "good"],
                )

    def roots(parts):
        for b in parts:
            same = [merkle_root([names[i : i + 32] for i in range(0, len(names), 32)]) == root for names, root in zip(raw_values(b.column(4)), raw_values(b.column(5)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(same, pa.bool_())], names=["place", "doc_id", "start", "n_tokens", "rooted"])

    recipes = spark.read.parquet(f"{store}/recipes")
    chunks = spark.read.parquet(f"{store}/chunks").mapInArrow(check, "name binary, n long, crc long, good boolean")
    met = _uses(recipes).join(chunks, "name", "left").select(
        "places", "after", F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(False)).alias("good")
    )
    whole = met.mapInArrow(move, "place long, crc long, n long, good boolean").groupBy("place").agg(
        F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"), F.bool_and("good").alias("good")
    )
    rooted = recipes.select("place", "doc_id", "start", "n_tokens", "names", "root").mapInArrow(roots, "place long, doc_id long, start long, n_tokens long, rooted boolean")
    return rooted.join(whole, "place").select(
        "doc_id", "start", "n_tokens", "ids_crc32", (F.col("good") & F.col("rooted") & (F.col("n") == F.col("n_tokens"))).alias("verified")
    )


def restore(spark: SparkSession, store: str) -> DataFrame:
    """doc_id and ids (array of int), put together from the stored chunks."""
    schema = pa.schema([("place", pa.int64()), ("after", pa.int64()), ("ids", pa.binary())])
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def deal(parts):
        for b in parts:
            for places, after, ids in zip(raw_values(b.column(0)), raw_values(b.column(1)), raw_values(b.column(2))):
                where = np.frombuffer(places, np.int64)
                for at in range(0, len(where), 4096):
                    some = where[at : at + 4096]
                    yield batches({"place": pa.array(some), "after": pa.array(np.frombuffer(after, np.int64)[at : at + 4096]), "ids": [ids] * len(some)}, schema)

    def join(parts):
        for b in parts:
            ids = [np.frombuffer(b"".join(x["ids"] for x in row), "<u2").astype(np.int32) for row in b.column(1).to_pylist()]
            yield batches({"doc_id": b.column(0), "ids": ids}, out)

    recipes = spark.read.parquet(f"{store}/recipes")
    parts = _uses(recipes).join(spark.read.parquet(f"{store}/chunks").select("name", "ids"), "name").select("places", "after", "ids")
    dealt = parts.mapInArrow(deal, "place long, after long, ids binary").groupBy("place")
    joined = dealt.agg(F.sort_array(F.collect_list(F.struct("after", "ids")), asc=False).alias("parts"))  # one document's chunks
    return recipes.select("place", "doc_id").join(joined, "place").select("doc_id", "parts").mapInArrow(join, "doc_id long, ids array<int>")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a store and read back."""
    return read_store(spark, write_store(table(spark, sf_dir, "documents")))
