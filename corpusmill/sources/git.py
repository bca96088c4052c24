"""A Python data source over a local Git repository: ``spark.read.format("git_tree")``.

Options: ``path`` (a work tree), ``revision`` (default HEAD), ``deadline`` in seconds, ``pushdown`` (default false).
With ``pushdown`` filters on ``path`` (equal, in, starts with) narrow the tree scan to the subtree they allow, filters on ``bytes`` are answered
from object sizes.  Contents are read for the entries that are left, and only if the schema asks for them:
``spark.read.schema("path string, bytes long")`` reads none.  Spark hands filters to
Python sources only with ``spark.sql.python.filterPushdown.enabled``, and refuses ``pushdown`` without it.  Each partition reads the objects of some entries with one batch process.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
import tempfile
import threading
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith,
)

TREE_ROWS, BLOB_BYTES, BATCH = 20_000, 512 * 1024, 256
OUTPUT_BYTES = 16 << 20  # of a scan; contents may take what a batch of the largest blobs takes, twice over


def run(root: str, args: list[str], data: bytes = b"", deadline: float = 30, most: int = OUTPUT_BYTES, missing: bool = False) -> bytes:
    """Output of a read-only command; an error for a failure, after the deadline, or for more than ``most`` bytes.

    With ``missing`` a command that says nothing and fails gives nothing.
    """
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")}
    env |= {"GIT_TERMINAL_PROMPT": "0", "GIT_NO_LAZY_FETCH": "1", "GIT_NO_REPLACE_OBJECTS": "1", "LC_ALL": "C"}
    with tempfile.TemporaryFile() as given, tempfile.TemporaryFile() as said:
        given.write(data)
        given.seek(0)
        child = subprocess.Popen(["git", "-C", root, *args], stdin=given, stdout=subprocess.PIPE, stderr=said, env=env)
        late = threading.Event()
        timer = threading.Timer(deadline, lambda: (late.set(), child.kill()))
        timer.start()
        try:
            out = child.stdout.read(most + 1)
            if len(out) > most:
                child.kill()
            code = child.wait()
        finally:
            timer.cancel()
            child.stdout.close()
        if late.is_set():
            raise TimeoutError("the command took longer than its deadline")
        if len(out) > most:
            raise ValueError("the command says more than is allowed")
        said.seek(0)
        error = said.read(500).decode("utf-8", "replace")
    if code and not (missing and not out and not error):
        raise RuntimeError(error)
    return out


def _name_of(path: str) -> str:
    return hashlib.sha256(os.fsencode(path)).hexdigest()


def repository(folder: str, deadline: float = 30) -> dict[str, str | None]:
    """The checkout that holds an absolute ``folder``: its root, its names, and the commit it is at (null before the first).

    ``repo_id`` is the SHA-256 of the shared Git folder's real path, ``worktree_id`` that of the root's, so
    work trees of one repository share the first.
    """
    if not os.path.isabs(folder):
        raise ValueError("the folder must be absolute")
    said = lambda root, *args, **kw: os.fsdecode(run(root, ["rev-parse", *args], deadline=deadline, **kw).rstrip(b"\n"))
    root = os.path.realpath(said(folder, "--show-toplevel"))
    common = os.path.realpath(os.path.join(root, said(root, "--git-common-dir")))
    head = said(root, "--verify", "--quiet", "HEAD", missing=True)
    return {"root": root, "repo_id": _name_of(common), "worktree_id": _name_of(root), "head": head or None}


def entries(root: str, revision: str, deadline: float = 30, below: str = "") -> list[tuple[str, str, str]]:
    """(path, oid, mode) of a tree scan, of the path ``below`` alone if it is given."""
    found = []
    only = ["--", below] if below else []
    for record in run(root, ["ls-tree", "-r", "-z", "--full-tree", revision, *only], deadline=deadline).split(b"\0"):
        if record:
            head, path = record.split(b"\t", 1)
            mode, _, oid = head.split(b" ")
            found.append((path.decode(), oid.decode(), mode.decode()))
    if len(found) > TREE_ROWS:
        raise ValueError("the tree has too many entries")
    return found


def sizes(root: str, oids: list[str], deadline: float = 30) -> dict[str, int]:
    """Sizes of the objects that are there and are blobs; no content is read."""
    raw = run(root, ["cat-file", "--batch-check"], "".join(f"{x}\n" for x in oids).encode(), deadline) if oids else b""
    parts = (line.split() for line in raw.decode().splitlines())
    return {p[0]: int(p[2]) for p in parts if len(p) == 3 and p[1] == "blob"}


def contents(root: str, oids: list[str], deadline: float = 30) -> Iterator[bytes]:
    """The bytes of blobs that are there, in order."""
    raw = run(root, ["cat-file", "--batch"], "".join(f"{x}\n" for x in oids).encode(), deadline, 2 * BATCH * BLOB_BYTES) if oids else b""
    at = 0
    for _ in oids:
        end = raw.index(b"\n", at)
        size = int(raw[at:end].split()[2])
        yield raw[end + 1 : end + 1 + size]
        at = end + 2 + size


class Entries(InputPartition):
    def __init__(self, rows: list[tuple[str, str, str]]):
        self.rows = rows


class GitTree(DataSource):
    """(path, oid, mode, bytes, content); size and content of an entry that is no blob here, and contents over 512 KiB, are null."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "path string, oid string, mode string, bytes long, content binary"

    def reader(self, schema) -> Reader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (Pushing if pushing else Reader)(self.options, schema.fieldNames())


_SIZE_TESTS = {
    EqualTo: lambda n, v: n == v, GreaterThan: lambda n, v: n > v, GreaterThanOrEqual: lambda n, v: n >= v,
    LessThan: lambda n, v: n < v, LessThanOrEqual: lambda n, v: n <= v,
}


class Reader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.root, self.revision, self.fields = options["path"], options.get("revision", "HEAD"), fields
        self.deadline = float(options.get("deadline", 30))
        self.paths: list[Filter] = []
        self.sizes: list[Filter] = []

    def _below(self) -> str:
        """A path that holds every entry the filters allow."""
        for f in self.paths:
            if isinstance(f, EqualTo):
                return f.value
            if isinstance(f, StringStartsWith) and "/" in f.value:
                return f.value.rpartition("/")[0] + "/"
        return ""

    def _has_path(self, path: str) -> bool:
        for f in self.paths:
            if isinstance(f, EqualTo) and path != f.value or isinstance(f, In) and path not in f.value or isinstance(f, StringStartsWith) and not path.startswith(f.value):
                return False
        return True

    def _has_size(self, n: int | None) -> bool:
        return not self.sizes or n is not None and all(isinstance(f, IsNotNull) or _SIZE_TESTS[type(f)](n, f.value) for f in self.sizes)

    def partitions(self) -> list[InputPartition]:
        rows = [r for r in entries(self.root, self.revision, self.deadline, self._below()) if self._has_path(r[0])]
        return [Entries(rows[i : i + BATCH]) for i in range(0, len(rows), BATCH)] or [Entries([])]

    def read(self, partition: Entries):
        known = sizes(self.root, [oid for _, oid, _ in partition.rows], self.deadline) if self.sizes or {"bytes", "content"} & set(self.fields) else {}
        rows = [(path, oid, mode, known.get(oid)) for path, oid, mode in partition.rows if self._has_size(known.get(oid))]
        wanted = [oid for _, oid, _, n in rows if n is not None and n <= BLOB_BYTES] if "content" in self.fields else []
        bodies = contents(self.root, wanted, self.deadline)
        for path, oid, mode, n in rows:
            body = next(bodies) if wanted and n is not None and n <= BLOB_BYTES else None
            row = {"path": path, "oid": oid, "mode": mode, "bytes": n, "content": body}
            yield tuple(row[f] for f in self.fields)


class Pushing(Reader):
    """A reader that takes filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if column == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.paths.append(f)
            elif column == ("bytes",) and type(f) in _SIZE_TESTS or column == ("bytes",) and isinstance(f, IsNotNull):
                self.sizes.append(f)
            else:
                yield f
