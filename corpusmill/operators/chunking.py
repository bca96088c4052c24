"""Line windows and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Lines of a window, and how many it shares with the next; windows of one file.
LINES, OVERLAP, MOST = 60, 6, 256


def window_starts(start: Column, end: Column, size: int = LINES, overlap: int = OVERLAP) -> Column:
    """First lines of the windows of a region: the last window is the one that reaches its end."""
    return F.sequence(start, F.greatest(start, end - overlap), F.lit(size - overlap))


def line_windows(docs: DataFrame, key: str, text: str, size: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """(key, start_line, end_line, content): overlapping windows of a text's lines, blank ones left out."""
    split = docs.select(key, T.lines(F.col(text)).alias("lines")).filter(F.size("lines") > 0)
    first = split.withColumn("start_line", F.explode(window_starts(F.lit(1), F.size("lines"), size, overlap)))
    last = F.least(F.col("start_line") + size - 1, F.size("lines"))
    out = first.select(
        key, "start_line", last.alias("end_line"), F.array_join(F.slice("lines", F.col("start_line"), last - F.col("start_line") + 1), "\n").alias("content")
    )
    return out.filter(~F.col("content").rlike(r"^\s*\z"))


def uncovered_runs(lines: DataFrame, key: str, line: str, covered: Column) -> DataFrame:
    """(key, start_line, end_line): maximal runs of lines that nothing covers."""
    open_ = lines.filter(~covered)
    island = F.col(line) - F.row_number().over(Window.partitionBy(key).orderBy(line))
    return open_.withColumn("island", island).groupBy(key, "island").agg(F.min(line).alias("start_line"), F.max(line).alias("end_line")).drop("island")


def regions(text: str, suffix: str) -> list[tuple[int, int, str | None]]:
    """Top-level declarations of a script as (first line, last line, symbol), by a brace scanner.

    An approximation of a syntax tree: ``export`` is unwrapped, a class gives its header and one
    region for each member, other named declarations one region each; lines outside are left to
    the window fallback.
    """
    import re

    declared = re.compile(
        r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
        r"(?P<kind>class|function\*?|interface|type|enum|const|let|var|namespace)\s+(?P<name>[A-Za-z_$][\w$]*)?"
    )
    member = re.compile(r"^\s*(?:(?:public|private|protected|static|async|readonly|get|set|override|abstract)\s+)*(?P<name>[#A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*[(=:;?]")
    rows = re.split(r"\r?\n", text)
    out: list[tuple[int, int, str | None]] = []
    i = 0
    while i < len(rows):
        found = declared.match(rows[i])
        if not found:
            i += 1
            continue
        end, depths = _extent(rows, i)
        name = found["name"] or "default"
        if found["kind"] == "class":
            opens = next((k for k in range(i, end + 1) if "{" in rows[k]), i)
            out.append((i + 1, opens + 1, name))
            k = opens + 1
            while k < end:
                m = member.match(rows[k])
                if m and depths[k - i] == 1:
                    last = k
                    while last + 1 < end and depths[last + 1 - i] > 1:
                        last += 1
                    out.append((k + 1, min(last, end - 1) + 1, f"{name}.{m['name']}"))
                    k = last
                k += 1
        else:
            out.append((i + 1, end + 1, name))
        i = end + 1
    return out


def _extent(rows: list[str], first: int) -> tuple[int, list[int]]:
    """Last line of the declaration at ``first`` and the brace depth at the start of each of its lines."""
    depth, seen, depths = 0, False, []
    for k in range(first, len(rows)):
        depths.append(depth)
        quote = ""
        for at, c in enumerate(rows[k]):
            if quote:
                quote = "" if c == quote and rows[k][at - 1] != "\\" else quote
            elif c in "'\"`":
                quote = c
            elif rows[k].startswith("//", at):
                break
            elif c in "{([":
                depth, seen = depth + 1, True
            elif c in "})]":
                depth -= 1
        if depth <= 0 and (seen or rows[k].rstrip().endswith(";")):
            return k, depths
    return len(rows) - 1, depths
