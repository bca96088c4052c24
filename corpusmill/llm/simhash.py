"""SimHash near-duplicate groups through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most four bits agree in at least four
of their eight bytes.  The index posts every distinct fingerprint under the byte
values at three positions.  Its twenty position triples form a Turan system:
every choice of four of the eight positions contains one of them, so a pair
that can link always meets.  For each pair that meets, the shared positional
bytes are tallied, pairs with at least four are retained, and the Hamming
distance verifies them.  Copies share one fingerprint and so one posting.  A
posting list longer than ``HOT`` is parted by a fourth position, in one of which
every pair that belongs together agrees, so chance alone crowds no list before there are some 10^12 fingerprints.
What is still crowded is a dense cluster; its fingerprints are linked through all keys that
flip at most two of their bits, a fixed number of rows for each and never a pair, so no list is cut short.

Defined results: null or empty text has fingerprint zero and links like any
other; repeated rows each get a row; a null ``doc_id`` never names a group, and
a group without any id has a null ``component_id``; an empty table gives an
empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import ascii_space_words, batches, begin, hot_join, id_and_bytes, raw_values, stage, table

SHINGLE, BITS, SEED = 4, 4, 42
HOT = 2048  # fingerprints of one posting list that are compared with each other in one task


def position_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of byte positions, one inside every four positions: Turan's construction on three parts."""
    part = lambda i: i % 3
    chosen = []
    for t in combinations(range(8), 3):
        sizes = [sum(part(i) == p for i in t) for p in range(3)]
        if 3 in sizes or any(sizes[p] == 2 and sizes[(p + 1) % 3] == 1 for p in range(3)):
            chosen.append(t)
    assert all(any(set(t) <= set(q) for t in chosen) for q in combinations(range(8), 4))
    return chosen


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text: majority bits over the XXH64 of its word shingles."""
    words = ascii_space_words(raw.lower()) if raw else []
    if not words:
        return 0
    n, k = len(words), min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64
    )
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # a very long text keeps a small bit table
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(parts):
        begin()
        for b in parts:
            yield batches({"doc_id": b.column(0), "fp": [fingerprint(x, shingle) for x in raw_values(b.column(1))]}, schema)

    return id_and_bytes(docs).mapInArrow(run, "doc_id long, fp long")


def _postings(distinct: DataFrame) -> DataFrame:
    """Index rows: (key, fp, node, used); key holds the triple's number and its three byte values, used its positions."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = [
        F.lit(n << 24).cast("long") + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c)
        for n, (a, b, c) in enumerate(position_triples())
    ]
    used = [F.lit(1 << a | 1 << b | 1 << c).cast("long") for a, b, c in position_triples()]
    both = F.array(*[F.struct(k.alias("key"), u.alias("used")) for k, u in zip(keys, used)])
    return distinct.select(F.explode(both).alias("k"), "fp", "node").select("k.key", "fp", "node", "k.used")


def _links_of_list(fp: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links of one posting list: each member to the least of its local group."""
    label = np.arange(len(fp))
    order = np.argsort(node, kind="stable")
    fp, node = fp[order], node[order]
    left, right = [], []
    for i in range(len(fp) - 1):
        x = fp[i + 1 :] ^ fp[i]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        may = np.flatnonzero(shared >= 8 - bits)  # the count filter
        hit = may[np.bitwise_count(x[may]) <= bits]  # the verification
        if len(hit):
            left.append(np.full(len(hit), i))
            right.append(hit + i + 1)
    if not left:
        return node[:0], node[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(label)))
    return node[moved], node[label[moved]]


def _scan_lists(bits: int, hot: int):
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "hot", "key", "used")])

    def run(parts):
        """Posting lists arrive sorted by key; links go out, or the members of a list over ``hot``."""
        key, used, fps, nodes, over = None, 0, [], [], False

        def flush():
            if over or len(fps) < 2:
                return None
            a, b = _links_of_list(np.array(fps, np.int64).view(np.uint64), np.array(nodes, np.int64), bits)
            none = pa.nulls(len(a), pa.int64())
            return batches({"a": pa.array(a), "b": pa.array(b), "hot": none, "key": none, "used": none}, schema) if len(a) else None

        for part in parts:
            k = part.column(0).to_numpy(zero_copy_only=False)
            f, n, u = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            if not len(k):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
            single = (np.diff(cuts) == 1) & (np.arange(len(cuts) - 1) > 0) & (np.arange(len(cuts) - 1) < len(cuts) - 2)
            for s, e in zip(cuts[:-1][~single].tolist(), cuts[1:][~single].tolist()):
                if k[s] != key:
                    if (out := flush()) is not None:
                        yield out
                    key, used, fps, nodes, over = k[s], int(u[s]), [], [], False
                fps += f[s:e].tolist()
                nodes += n[s:e].tolist()
                if len(fps) > hot or over and fps:
                    over = True
                    whole = {"a": pa.nulls(len(fps), pa.int64()), "b": pa.array(nodes), "hot": pa.array(fps)}
                    yield batches({**whole, "key": [int(key)] * len(fps), "used": [used] * len(fps)}, schema)
                    fps, nodes = [], []
        if (out := flush()) is not None:
            yield out

    return run


def _parted(crowded: DataFrame) -> DataFrame:
    """(key, fp, node, used): members of crowded lists under each further position; ``used`` has a bit for each position."""
    keys = []
    for p in range(8):
        own = F.xxhash64("key", F.lit(p), F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        free = F.col("used").bitwiseAND(F.lit(1 << p)) == 0
        keys.append(F.when(free, F.struct(own.alias("key"), F.col("used").bitwiseOR(F.lit(1 << p)).alias("used"))))
    return crowded.select(F.explode(F.array_compact(F.array(*keys))).alias("k"), "fp", "node").select("k.key", "fp", "node", "k.used")


def _flips(bits: int) -> list[int]:
    """Signed masks of at most ``bits / 2`` set bits, rounded up."""
    masks = [0]
    for w in range(1, (bits + 1) // 2 + 1):
        masks += [sum(1 << i for i in c) for c in combinations(range(64), w)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints that differ in at most ``bits`` bits.

    A spanning set: two nodes are connected by its rows exactly if a chain of such links connects them.
    """
    if bits != 4:
        raise ValueError("the position triples guarantee a meeting for four bits")
    lists, plain = _postings(distinct), None
    for _ in range(2):
        scanned = lists.repartition("key").sortWithinPartitions("key").mapInArrow(_scan_lists(bits, hot), "a long, b long, hot long, key long, used long")
        found = stage(scanned, "simhash-links")
        own = found.filter("hot IS NULL").select("a", "b")
        plain = own if plain is None else plain.union(own)
        crowded = found.filter("hot IS NOT NULL").select("key", "used", F.col("hot").alias("fp"), F.col("b").alias("node"))
        if crowded.isEmpty():
            return plain.distinct()
        lists = _parted(crowded)
    masks = F.array(*[F.lit(m).cast("long") for m in _flips(bits)])
    met = crowded.select("fp", "node").distinct().select("node", "fp", F.explode(masks).alias("mask")).select("node", F.col("fp").bitwiseXOR(F.col("mask")).alias("key"))
    least = met.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b < most").select("key", "b")
    return plain.union(met.join(least, "key").filter("node > b").select(F.col("node").alias("a"), "b")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the least node reachable, for every node with a link.

    Alternates large-star and small-star steps until the links stop changing;
    each step is written to the shared folder, as a plan would hold it once for each of its uses.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), label)
    digest, total = None, edges.count()
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("uses")).select("a", F.least("a", "m").alias("m"), "uses")
        least = stage(least, f"{label}-least")
        large = hot_join(both, least, "a", "uses", 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stage(large, f"{label}-large")
        down = stage(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("uses")), f"{label}-down")
        small = hot_join(large, down, "a", "uses", total).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = stage(small.union(down.select("a", F.col("m").alias("b"))).distinct(), label)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == digest:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        digest, total = now, now[0]


def groups_of(fps: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """``fp``, ``component`` (its least fingerprint), ``component_id`` (its least id) and ``uses`` of the distinct fingerprints of ``fps``."""
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("uses")).withColumn("node", F.col("fp")), "simhash-distinct")
    groups = components(links(distinct.select("fp", "node"), bits, hot))
    placed = distinct.join(groups, "node", "left").select("fp", "least", "uses", F.coalesce("component", "node").alias("component"))
    placed = stage(placed, "simhash-placed")
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    ids = stage(ids, "simhash-ids")
    placed = hot_join(placed, ids, "component", "members", distinct.count())
    return stage(placed.select("fp", "component", "component_id", "uses"), "simhash-groups")


def near_duplicates(docs: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for every row of ``docs``."""
    fps = stage(fingerprints(docs), "simhash-fps")
    return hot_join(fps, groups_of(fps, bits, hot), "fp", "uses", fps.count()).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
