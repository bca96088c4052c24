"""Which paths and contents are searched."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the default policy.
FILE_NAMES = ("pnpm-lock.yaml", "package-lock.json", "yarn.lock", "bun.lock", "Cargo.lock")
DIRECTORIES = ("node_modules", "vendor", "dist", "build", "coverage", "target", ".next", ".cache")
BYTES, LINES, LINE_BYTES = 512 * 1024, 12_000, 4_000
RULE_BYTES, RULE_LINES = 16 * 1024, 256


def compile_rules(text: str) -> list[tuple[str, bool]]:
    """Ignore rules as (regular expression over a path, whether it ignores), in order."""
    if len(text.encode()) > RULE_BYTES or len(text.splitlines()) > RULE_LINES:
        raise ValueError("the ignore file is too long")
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        ignores = not line.startswith("!")
        rule = line if ignores else line[1:]
        rule = rule[1:] if rule.startswith(("\\#", "\\!")) else rule
        only_dir, rule = rule.endswith("/"), rule.rstrip("/")
        anchored, rule = "/" in rule, rule.lstrip("/")
        body, i = "", 0
        while i < len(rule):
            if rule.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif rule.startswith("/**", i) and i + 3 == len(rule):
                body, i = body + "/.+", i + 3
            elif rule[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif rule[i] == "?":
                body, i = body + "[^/]", i + 1
            elif rule[i] == "[":
                end = rule.find("]", i + 2)
                if end < 0:
                    raise ValueError(f"no end of class in rule {line!r}")
                inside = rule[i + 1 : end]
                body, i = body + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
            else:
                i += rule[i] == "\\" and i + 1 < len(rule)
                body, i = body + re.escape(rule[i]), i + 1
        out.append((f"^{'' if anchored else '(?:.*/)?'}{body}{'/.+' if only_dir else '(?:/.+)?'}$", ignores))
    return out


def excluded(path: Column, rules: list[tuple[str, bool]] = (), ignore_file: str = ".searchignore") -> Column:
    """Whether the policy leaves a path out; the last rule that matches the path or a parent wins."""
    parts = F.split(path, "/")
    defaults = F.element_at(parts, -1).isin(*FILE_NAMES) | F.arrays_overlap(
        F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in DIRECTORIES])
    )
    chosen = defaults
    if rules:
        chosen = F.coalesce(*[F.when(path.rlike(pattern), F.lit(ignores)) for pattern, ignores in reversed(rules)], defaults)
    return (path == ignore_file) | F.array_contains(parts, ".git") | chosen


def regular(mode: Column) -> Column:
    """Whether a tree entry is a regular file."""
    return mode.isin("100644", "100755")


def skip_reason(content: Column, bytes_: int = BYTES, lines: int = LINES, line_bytes: int = LINE_BYTES) -> Column:
    """Why a binary content is not indexed, null if it is: size, NUL, UTF-8, lines, length of a line, in this order."""
    text = content.cast("string")
    rows = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    return (
        F.when(F.octet_length(content) > bytes_, "file_too_large")
        .when(F.contains(content, F.unhex(F.lit("00"))), "binary")
        .when(~F.is_valid_utf8(text), "invalid_utf8")
        .when(F.size(rows) > lines, "too_many_lines")
        .when(F.exists(rows, lambda r: F.octet_length(r) > line_bytes), "line_too_long")
    )


def inventory_reason(path: Column, mode: Column, content: Column, rules: list[tuple[str, bool]] = ()) -> Column:
    """The static inventory's order of checks: path, mode, then content."""
    return F.when(excluded(path, rules), "excluded_path").when(~regular(mode), "not_regular").otherwise(skip_reason(content))
