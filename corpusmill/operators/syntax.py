"""Chunks of scripts along their declarations, with symbols; other lines in windows as in every file.

No syntax tree: text in strings and comments is blanked, nesting depth is a prefix sum over the brackets
that are left, and a declaration is a line at depth nought that begins like one, up to where
its depth returns.  A class gives its head and one region for each member; ``export`` is unwrapped.  Lines that no region
covers are windowed in their runs, and all chunks go by their first line, regions before runs where they begin together.

An approximation, stated as such: regular expression literals are not told from division, and a template's inner code counts as text.

Defined results: a null text gives no row; one that is not eligible (``policy`` limits) or has ``chunking.MOST`` chunks or more gives one row that
says why in ``skipped``; blank windows are left out; a path without a script's extension is all fallback.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunking, policy

PLAIN = "lines-v1"  # the parser of files that are only windowed

_QUIET = re.compile(rb"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*(?:`|\Z)", re.S)
_MODIFIERS = rb"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
_DECLARED = re.compile(rb"\s*" + _MODIFIERS + rb"(class|function\*?|interface|type|enum|const|let|var|namespace)\b\s*\*?\s*([A-Za-z_$][\w$]*)?")
_MEMBER = re.compile(rb"\s*(?:(?:public|private|protected|static|async|readonly|get|set|override|abstract|declare|accessor)\s+)*\*?\s*([#A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*[(=:;?!]")
_GOES_ON = re.compile(rb"[=+\-*/%&|^?:,.<(\[{]\s*\Z|=>\s*\Z")
_CONTINUES = re.compile(rb"\s*[.?:&|+*/=,)\]}]")
_BODIED = (b"class", b"interface", b"enum", b"namespace", b"function", b"function*")
_STEP = np.zeros(256, np.int64)
_STEP[list(b"([{")], _STEP[list(b")]}")] = 1, -1


def quiet(raw: bytes) -> bytes:
    """The text with everything inside strings and comments blanked, lines kept."""
    return _QUIET.sub(lambda m: re.sub(rb"[^\n]", b" ", m[0]), raw)


class Script:
    """Lines of a script with the depth at which each begins and ends."""

    def __init__(self, text: str):
        code = quiet(text.encode())
        self.lines = code.split(b"\n")
        bytes_ = np.frombuffer(code, np.uint8)
        depth = np.cumsum(_STEP[bytes_]) if len(bytes_) else np.zeros(0, np.int64)
        ends = np.flatnonzero(bytes_ == 10)
        after = depth[np.maximum(ends - 1, 0)] * (ends > 0) if len(ends) else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], ends + 1])
        self.before = np.concatenate([[0], after]).astype(np.int64)
        self.after = np.append(after, depth[-1] if len(depth) else 0)
        # the lowest depth inside a line tells a body that closes and opens again from one that goes on
        self.code, self.depth = code, depth

    def closes(self, line: int, level: int, body: bool) -> int:
        """Last line of what begins in ``line`` at depth ``level``: where its body closes, or a statement ends."""
        at = int(self.starts[line])
        here = self.depth[at:]
        opened = np.flatnonzero((here > level) & (np.frombuffer(self.code, np.uint8)[at:] == ord("{"))) if body else np.zeros(0, np.int64)
        if body and len(opened):
            ends = np.flatnonzero(here[opened[0] :] <= level)
            semicolon = self.code.find(b";", at, at + int(opened[0]))
            if semicolon < 0 or self.depth[semicolon] > level:
                return self._line(at + int(opened[0]) + int(ends[0])) if len(ends) else len(self.lines) - 1
        k = line
        while k < len(self.lines) - 1:
            if self.after[k] <= level and not _GOES_ON.search(self.lines[k]):
                following = next((x for x in self.lines[k + 1 :] if x.strip()), b"")
                if self.lines[k].rstrip().endswith(b";") or not _CONTINUES.match(following) or self.after[k] < level:
                    return k
            k += 1
        return k

    def _line(self, place: int) -> int:
        return int(np.searchsorted(self.starts, place, "right")) - 1


def regions(text: str) -> list[tuple[int, int, str | None]]:
    """(first line, last line, symbol) of a script's declarations, in their order."""
    script, out, k = Script(text), [], 0
    while k < len(script.lines):
        found = _DECLARED.match(script.lines[k]) if script.before[k] == 0 else None
        kind = found[1] if found else b""
        if not found or not (found[2] or kind in (b"class", b"function", b"function*")):
            k += 1
            continue
        name, last = (found[2] or b"default").decode(), script.closes(k, 0, kind in _BODIED)
        if kind == b"class":
            head = next((i for i in range(k, last + 1) if b"{" in script.lines[i]), k)
            out.append((k + 1, head + 1, name))
            i = head + 1
            while i < last:
                member = _MEMBER.match(script.lines[i]) if script.before[i] == 1 else None
                if member:
                    end = min(script.closes(i, 1, b"(" in script.lines[i]), last - 1)
                    out.append((i + 1, end + 1, f"{name}.{member[1].decode()}"))
                    i = max(end, i)
                i += 1
        else:
            out.append((k + 1, last + 1, name))
        k = last + 1
    return out


def windows(first: int, last: int) -> list[tuple[int, int]]:
    """The windows of a region, as ``chunking.window_starts`` has them."""
    step = chunking.LINES - chunking.OVERLAP
    return [(s, min(s + chunking.LINES - 1, last)) for s in range(first, max(first, last - chunking.OVERLAP) + 1, step)]


def lines_of(text: str) -> list[str]:
    """Lines ended by LF or CRLF, as ``functions.text.lines`` has them."""
    return re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", text)) if text else []


def chunks(text: str, parser: str) -> list[tuple[int, int, str | None, str]]:
    """(first line, last line, symbol, content) of all chunks of a file."""
    rows = lines_of(text)
    found = [(a, min(z, len(rows)), s) for a, z, s in (regions(text) if parser != PLAIN else []) if a <= len(rows)]
    open_ = np.ones(len(rows) + 2, bool)
    open_[0] = open_[-1] = False
    for a, z, _ in found:
        open_[a : z + 1] = False
    edges = np.flatnonzero(np.diff(open_.astype(np.int8)))
    runs = [(int(a) + 1, int(z), None) for a, z in zip(edges[::2], edges[1::2])]
    out = [(a, z, s, "\n".join(rows[a - 1 : z])) for first, last, s in [*found, *runs] for a, z in windows(first, last)]
    return sorted((c for c in out if c[3].strip()), key=lambda c: c[0])


_CHUNKS = pa.schema([("key", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("symbol", pa.string()), ("content", pa.string()), ("skipped", pa.string())])


def syntax_chunks(files: DataFrame, key: str, text: str, parser: str, limited: bool = True) -> DataFrame:
    """(``key``, start_line, end_line, symbol, content, skipped) of files with a string ``key`` and the name of their parser.

    ``limited`` applies the limits of ``policy``, with one row that names the reason for a file that breaks one.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out: list[tuple] = []
            for name, body, how, why in zip(*(b.column(i).to_pylist() for i in range(4))):
                if why is None:
                    made = chunks(body, how)
                    if not limited or len(made) < chunking.MOST:
                        out += [(name, *c, None) for c in made]
                        continue
                    why = "too_many_chunks"
                out.append((name, None, None, None, None, why))
            columns = zip(*out) if out else [[] for _ in _CHUNKS]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHUNKS)], schema=_CHUNKS)

    reason = policy.skip_reason(F.col("text").cast("binary")) if limited else F.lit(None).cast("string")
    rows = files.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(parser).alias("parser")).filter("text IS NOT NULL").withColumn("why", reason)
    shown = rows.select("key", F.when(F.col("why").isNull(), F.col("text")).otherwise("").alias("text"), "parser", "why")
    return shown.mapInArrow(run, "key string, start_line int, end_line int, symbol string, content string, skipped string").withColumnRenamed("key", key)


def parsed_identity(identity, path):
    """A content's name with the parser its path asks for: the same bytes are other chunks under another parser."""
    parser = T.parser_for(path)
    return F.when(parser == PLAIN, identity).otherwise(F.concat_ws(":", identity, parser))
