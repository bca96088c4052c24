"""Search inside retained outputs: regions of one stream ranked by the stream's own statistics, the best of them with excerpts.

A stream is one row, so it is cut, counted, ranked and quoted in the task that reads it, and only the
``k`` best regions leave; excerpts are made for these alone.  Limits are checked on running sums while a
stream is counted and end the query in an error, never in a part of the result.

Defined results: null and empty streams, and those without a term, give no row; equal scores go by place;
bytes that are no text count as replacement signs; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import words
from corpusmill.operators import rank, streams

# Bytes of the tokens of a region, and of all regions of a stream.
REGION_TOKENS, STREAM_TOKENS = 64 << 10, 32 << 20
DIGITS = 9  # of a score that order goes by

RESULT = (
    "place long, position long, score double, start long, end long, first_line long, last_line long, clipped_before boolean, clipped_after boolean, excerpt string"
)


class LimitExceeded(ValueError):
    """The stream is too large to be ranked; its pages can be read."""


def occurrences(sequence: np.ndarray, phrase: list[int]) -> int:
    """How often the numbers of a phrase follow each other."""
    if len(sequence) < len(phrase) or -1 in phrase:
        return 0
    hit = sequence[: len(sequence) - len(phrase) + 1] == phrase[0]
    for i, term in enumerate(phrase[1:], 1):
        hit = hit & (sequence[i : len(sequence) - len(phrase) + 1 + i] == term)
    return int(hit.sum())


def scores(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BM25 of regions from their lengths and the counts (terms, regions); what a term in no region adds is nothing."""
    n, mean = len(lengths), lengths.sum() / max(len(lengths), 1)
    out = np.zeros(n)
    for f in counts:
        held = int((f > 0).sum())
        idf = math.log((n - held + 0.5) / (held + 0.5))
        weight = idf if idf > 0 else rank.FLOOR
        part = np.zeros(n)
        np.divide(weight * f * (rank.K1 + 1), f + rank.K1 * (1 - rank.B + rank.B * lengths / (mean or 1)), out=part, where=f > 0)
        out += part
    return out


def _best(raw: bytes, known: words.Vocabulary, phrases: list[list[str]], terms: list[str], k: int) -> list[tuple]:
    """The rows of one stream."""
    found = streams.regions(raw)
    if len(found) > streams.REGIONS:
        raise LimitExceeded("the stream has too many regions to rank")
    lengths, counts, total = np.zeros(len(found), np.int64), np.zeros((len(phrases), len(found))), 0
    for r, (start, end, _) in enumerate(found):
        sequence, size = known.measured(raw[start:end].decode("utf-8", "replace"))
        total += size
        if size > REGION_TOKENS or total > STREAM_TOKENS:
            raise LimitExceeded("the stream's tokens take too many bytes to rank")
        lengths[r] = len(sequence)
        for i, phrase in enumerate(phrases):
            counts[i, r] = occurrences(sequence, [known.numbers.get(t, -1) for t in phrase])
    held = np.flatnonzero(counts.sum(axis=0))
    score = np.round(scores(lengths, counts), DIGITS)[held]
    rows = []
    for place, at in enumerate(np.lexsort((held, -score))[:k], 1):
        start, end, line = found[held[at]]
        body = raw[start:end].decode("utf-8", "replace")
        a, z, before, after = streams.stream_excerpt(body, terms)
        whole = body.encode()
        first = line + whole.count(b"\n", 0, a)
        shown = whole[a:z]
        last = first + max(shown.count(b"\n") + (not shown.endswith(b"\n")) - 1, 0)
        rows.append((place, int(held[at]), float(score[at]), start + a, start + z, first, last, before, after, shown.decode("utf-8", "replace")))
    return rows


def searched(rows: DataFrame, handle: str, content: str, phrases: list[list[str]], terms: list[str], k: int = 5) -> DataFrame:
    """(``handle``, ``RESULT``): the ``k`` best regions of each stream for search ``phrases``, quoted around the query's ``terms``."""
    kind = dict(rows.dtypes)[handle]
    names = ["handle", *(c.split()[0] for c in RESULT.split(", "))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.Vocabulary(underscore=False)
        for b in parts:
            known.trim()
            at, out = [], []
            for i in range(len(b)):
                raw = b.column(1)[i].as_py()
                found = _best(raw, known, phrases, terms, k) if raw else []
                at += [i] * len(found)
                out += found
            types = [pa.int64()] * 2 + [pa.float64()] + [pa.int64()] * 4 + [pa.bool_()] * 2 + [pa.string()]
            columns = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[] for _ in types], types)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=names)

    ddl = f"handle {kind}, {RESULT}"
    return rows.select(F.col(handle).alias("handle"), F.col(content).cast("binary").alias("raw")).mapInArrow(run, ddl).withColumnRenamed("handle", handle)
