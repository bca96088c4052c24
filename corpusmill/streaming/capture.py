"""Capture of byte streams with state, deadlines and fallback.

Parts of a stream come in order, the last one marked.  A stream of at most ``streams.PAGE`` bytes is
passed on whole, a longer one leaves in chunks of ``streams.CHUNK`` bytes while it runs and
ends in one row with its totals.  NUL, invalid UTF-8 (also across parts), more than
``streams.RESERVED`` bytes, or no part in time make it fall back: from then on its parts go through as they are, and
the row that tells so names the error.  State is what a page holds at most, and ends with the stream.

The chain of a stream is SHA-256 over the chain so far and the SHA-256 of the next chunk, so it goes on from 64 digits of state.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators import streams

# Seconds without a part, and in all, after which a stream falls back.
IDLE, OVERALL = 10, 120

ROWS = "handle string, kind string, ordinal long, content binary, bytes long, lines long, chain string, capture_error string"
_ABOUT = "bytes long, lines long, last long, opened long, ordinal long, chain string, error string"


def unfinished(raw: bytes) -> int:
    """Bytes at the end of ``raw`` that may open a character which the next part ends."""
    for back in range(1, min(3, len(raw)) + 1):
        b = raw[-back]
        if b & 0xC0 != 0x80:
            need = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
            return back if need > back else 0
    return 0


def valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


class Capture(StatefulProcessor):
    """One stream a key."""

    def __init__(self, idle: float = IDLE, overall: float = OVERALL, cap: int = streams.RESERVED):
        self.idle, self.overall, self.cap = int(idle * 1000), int(overall * 1000), cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = 10 * self.overall  # a state that no timer ended goes by itself
        self.about = handle.getValueState("about", _ABOUT, kept)
        self.pending = handle.getValueState("pending", "raw binary, partial binary", kept)

    def _row(self, key: str, kind: str, content: bytes | None, a: list) -> tuple:
        return (key, kind, a[4], content, a[0], a[1] + (a[0] > 0 and a[2] != 10), a[5], a[6])

    def _fail(self, key: str, a: list, raw: bytes, error: str) -> list[tuple]:
        a[6] = error
        return [self._row(key, "fallback", raw, a)]

    def _take(self, key: str, a: list, raw: bytes, held: bytes, partial: bytes, last: bool) -> tuple[list[tuple], bytes, bytes]:
        """Rows for one more part; what is pending after it; the open character at its end."""
        if a[6] is not None:
            a[0] += len(raw)
            return [self._row(key, "through", raw, a)], b"", b""
        whole = partial + raw
        open_ = 0 if last else unfinished(whole)
        a[0], a[1], a[2] = a[0] + len(raw), a[1] + raw.count(b"\n"), raw[-1] if raw else a[2]
        held += raw
        if a[0] > self.cap:
            return self._fail(key, a, held, "too_large"), b"", b""
        if b"\0" in raw:
            return self._fail(key, a, held, "nul"), b"", b""
        if not valid(whole[: len(whole) - open_]):
            return self._fail(key, a, held, "invalid_utf8"), b"", b""
        rows = []
        if a[0] > streams.PAGE:
            while len(held) >= streams.CHUNK or last and held:
                chunk, held = held[: streams.CHUNK], held[streams.CHUNK :]
                a[5] = hashlib.sha256((a[5] + hashlib.sha256(chunk).hexdigest()).encode()).hexdigest()
                rows.append(self._row(key, "chunk", chunk, a))
                a[4] += 1
        return rows, held, whole[len(whole) - open_ :]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = int(time.time() * 1000)
        a = list(self.about.get()) if self.about.exists() else [0, 0, 10, now, 0, "", None]
        held, partial = self.pending.get() if self.pending.exists() else (b"", b"")
        out, ended = [], False
        frame = pd.concat(list(rows)).sort_values("part")
        for raw, last in zip(frame["content"], frame["last"]):
            made, held, partial = self._take(key[0], a, bytes(raw) if raw is not None else b"", bytes(held), bytes(partial), bool(last))
            out += made
            ended = ended or bool(last)
        if ended:
            if a[6] is None:
                out.append(self._row(key[0], "stored" if a[0] > streams.PAGE else "passed", None if a[0] > streams.PAGE else held, a))
            self._end()
        else:
            self.about.update(tuple(a))
            self.pending.update((held, partial))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(min(now + self.idle, a[3] + self.overall))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.about.exists():
            a, (held, _) = list(self.about.get()), self.pending.get()
            if a[6] is None:
                over = int(time.time() * 1000) >= a[3] + self.overall
                out = self._fail(key[0], a, bytes(held), "deadline" if over else "idle")
            self._end()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    def _end(self) -> None:
        self.about.clear()
        self.pending.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def captured(parts: DataFrame, idle: float = IDLE, overall: float = OVERALL, cap: int = streams.RESERVED) -> DataFrame:
    """Rows (``ROWS``) of the streams in ``parts`` (handle string, part long, content binary, last boolean).

    The session has to keep its state in RocksDB (``use_rocksdb``).
    """
    rows = parts.select("handle", "part", "content", "last").groupBy("handle")
    return rows.transformWithStateInPandas(Capture(idle, overall, cap), ROWS, "Append", "ProcessingTime")


def use_rocksdb(spark) -> None:
    """Keep streaming state of this session on disk, as state with timers has to be."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
