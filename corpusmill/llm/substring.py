"""Substring dedup by level-wise doubling.

The lengths of the levels double up to the window length that decides removal:
with ``SHORTEST`` 25 they are 25 and 50, with 12 they would be 13, 25 and 50.  At
each level only windows that repeat are extended to twice their length (two
windows that overlap where the length is odd), and the search ends as soon as no
candidate survives.  Beyond the window length nothing is left to find, since
every longer repeat is covered by repeats of that length.  Of each longer window
a level needs a single shorter window that all copies choose alike, the one of
least hash, so few of the shorter windows stand for all and no longer window is
lost.  Least hashes are small, so they are scrambled before they are dealt to
buckets by range.  Full windows are told apart by 96 bits.

A word goes if a window that covers it also starts in a document with a smaller
``doc_id``; windows are judged on the input.  Defined results: null or empty
text, or one of fewer words than a window, loses nothing; repeated rows share a ``doc_id`` and so keep what only they
repeat; a row with a null ``doc_id`` is never earlier than another and loses
nothing to rows with no id, but loses what any document with an id holds; other columns
are ignored or carried along unseen; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.llm import blocks as B
from corpusmill.llm.common import ascii_space_words, batches, stage, table

WINDOW, SHORTEST = 50, 25
_ORDER = np.dtype([("unknown", "u1"), ("id", "<i8")])  # rows without an id come last
_WIDE = np.dtype([("two", "<u4"), ("unknown", "u1"), ("id", "<i8")])


def level_lengths(window: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths of the levels: each at most twice the one before, the last is ``window``."""
    lengths = [window]
    while lengths[-1] > max(1, shortest):
        lengths.append(-(-lengths[-1] // 2))
    return lengths[::-1] if len(lengths) > 1 else [-(-window // 2), window]


class Search:
    """The windows of one block that are still candidates at each level."""

    def __init__(self, row: dict, lengths: list[int]):
        self.row, self.lengths, self.block = row, lengths, B.open_block(row)
        self.words = [B.word_hashes(t) for t in self.block.texts]
        self.order = np.zeros(len(self.words), _ORDER)
        self.order["unknown"], self.order["id"] = ~self.block.known, np.where(self.block.known, self.block.ids, 0)
        self.alive: list[np.ndarray | None] = [None] * len(self.words)
        self.level = 0
        while self.level + 1 < len(lengths) and f"level{self.level}" in row:
            self._extend(np.frombuffer(row[f"level{self.level}"] or b"", np.uint8))

    def _stands(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each document the next level's windows that may be candidates, and the hash that stands for each."""
        now, then = self.lengths[self.level : self.level + 2]
        out = []
        for words, alive in zip(self.words, self.alive):
            if len(words) < then:
                out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
                continue
            stand = B.sliding_min(B.window_hashes(words, now), then - now + 1)
            at = np.arange(len(stand)) if alive is None else np.flatnonzero(B.sliding_min(alive, then - now + 1))
            out.append((at, B.mixed(stand[at])))
        return out

    def ask(self) -> tuple[np.ndarray, bytes]:
        """This level's distinct standing windows; payload 1 where two documents of the block have it."""
        keys, payload, self.stands = self._asked()
        return keys, payload

    def _asked(self):
        stands = self._stands()
        found = [np.unique(h) for _, h in stands]
        key = np.concatenate(found) if found else np.zeros(0, np.uint64)
        if not len(key):
            return key, b"", stands
        doc = np.repeat(self.order, [len(k) for k in found])
        order = np.lexsort((doc["id"], doc["unknown"], key))
        key, doc = key[order], doc[order]
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        ends = np.append(starts[1:], len(key)) - 1
        return key[starts], (doc[starts] != doc[ends]).astype(np.uint8).tobytes(), stands

    def _extend(self, answers: np.ndarray) -> None:
        """Go one level on: only windows whose standing window repeats stay candidates."""
        keys, _, stands = self._asked()
        repeated = keys[answers == 1] if len(answers) else keys[:0]
        for k, (at, hashes) in enumerate(stands):
            n = max(0, len(self.words[k]) - self.lengths[self.level + 1] + 1)
            alive = np.zeros(n, bool)
            if len(repeated):
                spot = np.searchsorted(repeated, hashes)
                alive[at[repeated[np.minimum(spot, len(repeated) - 1)] == hashes]] = True
            self.alive[k] = alive
        self.level += 1

    def full(self):
        """Positions of each document's candidates of full length, where each finds its window among the block's
        distinct ones, and those: both hashes and the first document of each."""
        window = self.lengths[-1]
        at = [np.flatnonzero(x) for x in self.alive]
        one = [B.window_hashes(w, window)[x] if len(x) else np.zeros(0, np.uint64) for w, x in zip(self.words, at)]
        two = [(B.window_hashes(w, window, B.STEPS[1])[x] >> np.uint64(32)).astype(np.uint32) if len(x) else np.zeros(0, np.uint32) for w, x in zip(self.words, at)]
        docs = np.repeat(self.order, [len(x) for x in at])
        o, t = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((one, np.uint64), (two, np.uint32)))
        order = np.lexsort((docs["id"], docs["unknown"], t, o))
        o, t, docs = o[order], t[order], docs[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
        number = np.empty(len(o), np.int64)
        number[order] = np.cumsum(new) - 1
        return at, number, o[new], t[new], docs[new]


def _earlier(least: np.ndarray, than: np.ndarray) -> np.ndarray:
    """Whether documents have an id that comes before those of others."""
    return (least["unknown"] == 0) & ((than["unknown"] == 1) | (least["id"] < than["id"]))


def _repeats(keys: np.ndarray, owner: np.ndarray, payload: bytes) -> np.ndarray:
    """1 for each key that two blocks hold, or two documents of one."""
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = np.zeros(len(count), bool)
    twice[inverse[np.frombuffer(payload, np.uint8) == 1]] = True
    return ((count > 1) | twice)[inverse].astype(np.uint8)


def _survivors(keys: np.ndarray, found: np.ndarray) -> bytes:
    return np.array([int(found.sum())], np.int64).tobytes()


def _earliest(keys: np.ndarray, owner: np.ndarray, raw: bytes) -> np.ndarray:
    """For each key of each block whether another block holds it under a smaller id."""
    p = np.frombuffer(raw, _WIDE)
    order = np.lexsort((p["id"], p["unknown"], p["two"], keys))
    k, p = keys[order], p[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (p["two"][1:] != p["two"][:-1])
    out = np.empty(len(k), np.uint8)
    if len(k):
        out[order] = _earlier(p[new][np.cumsum(new) - 1], p)
    return out


def _full_keys(lengths: list[int]):
    def keys(row: dict) -> tuple[np.ndarray, bytes]:
        _, _, one, two, doc = Search(row, lengths).full()
        out = np.zeros(len(one), _WIDE)
        out["two"], out["unknown"], out["id"] = two, doc["unknown"], doc["id"]
        return one, out.tobytes()

    return keys


def substring_dedup(docs: DataFrame, window: int = WINDOW, as_written: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, n_removed, spans of removed words [start, end), kept text, and ``carried`` as given.

    ``docs`` has ``doc_id``, ``text`` and may have a column ``carried`` of any type.  With ``as_written`` a text that
    loses nothing is given back as it was, null included, and not as words joined by a space.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    own_columns = ["carried"] if "carried" in docs.columns else []
    level = stage(B.to_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), *own_columns)), "substring-blocks")
    words = level.agg(F.sum(F.length("lengths")), F.sum(F.length("body"))).first()
    # a text of b compressed bytes has fewer than b / 2 words, and a window of k halves keeps about two in k
    buckets = B.bucket_count(int((words[1] or 0) / window * 2))
    lengths = level_lengths(window, shortest)
    for k in range(len(lengths) - 1):
        asked = B.ask(level, lambda row: Search(row, lengths).ask(), buckets, 1)
        repeats = stage(B.answer(asked, _repeats, 1, _survivors), f"substring-level{lengths[k]}")
        alive = sum(int(np.frombuffer(bytes(r.answers), np.int64).sum()) for r in repeats.filter("block < 0").select("answers").collect())  # eight bytes a bucket
        level = level.join(repeats.filter("block >= 0").withColumnRenamed("answers", f"level{k}").hint("shuffle_merge"), "block", "left")
        if not alive:
            break
    if alive:
        second = B.ask(level, _full_keys(lengths), 8 * buckets, _WIDE.itemsize)
        earlier = stage(B.answer(second, _earliest, 1), f"substring-level{window}").withColumnRenamed("answers", "earlier")
        full = level.join(earlier.hint("shuffle_merge"), "block", "left")
    else:
        full = level.withColumn("earlier", F.lit(None).cast("binary"))
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])

    def run(parts):
        for b in parts:
            for row in B.rows_of(b):
                if alive:
                    search = Search(row, lengths)
                    block, (at, number, _, _, least) = search.block, search.full()
                    del search
                else:
                    block = B.open_block(row)
                    at, number = [np.zeros(0, np.int64)] * len(block.texts), np.zeros(0, np.int64)
                flags = np.frombuffer(row["earlier"] or b"", np.uint8)
                begin = 0
                rows: dict[str, list] = {f.name: [] for f in fields}
                for k, text in enumerate(block.texts):
                    words, own = ascii_space_words(text), number[begin : begin + len(at[k])]
                    begin += len(at[k])
                    gone = at[k]
                    if len(own):
                        mine = np.array((not block.known[k], block.ids[k] if block.known[k] else 0), _ORDER)
                        gone = gone[(flags[own] == 1) | _earlier(least[own], mine)]
                    edges = np.zeros((0, 2), np.int64)
                    if len(gone):
                        cover = np.zeros(len(words) + 1, np.int32)
                        cover[gone] += 1
                        cover[gone + window] -= 1
                        dead = np.cumsum(cover[:-1]) > 0
                        edges = np.flatnonzero(np.diff(dead, prepend=False, append=False)).reshape(-1, 2)
                    keep = words if not len(edges) else [w for w, x in zip(words, dead.tolist()) if not x]
                    rows["doc_id"].append(int(block.ids[k]) if block.known[k] else None)
                    rows["n_words"].append(len(words))
                    rows["n_removed"].append(len(words) - len(keep))
                    rows["spans"].append(edges.tolist())
                    rows["kept"].append(text if as_written and not len(edges) else b" ".join(keep))
                out = batches(rows, fields)
                for name in own_columns:
                    out = out.append_column(name, B.carried_of(row))
                yield out

    given = StructType.fromDDL("doc_id long, n_words long, n_removed long, spans array<array<long>>, kept binary")
    for name in own_columns:
        given = given.add(docs.schema[name])
    out = full.mapInArrow(run, given)
    return out.withColumn("kept", F.col("kept").cast("string"))


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-word passages removed from all documents."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
