import os
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith

from corpusmill.sources import git

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="no git")
FIELDS = ["path", "oid", "mode", "bytes", "content"]


def commit(root, files):
    call = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    call("init", "-q")
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    call("add", ".")
    call("commit", "-qm", "x")
    return call


@pytest.fixture
def tree(tmp_path):
    commit(tmp_path, {"a.txt": b"hello\n", "src/in/b": b"x" * 100, "src/inner": b"", "src/out": b"yy", "big": b"z" * (git.BLOB_BYTES + 1)})
    return str(tmp_path)


def read(monkeypatch, root, fields, filters):
    """Rows, filters that Spark has to apply, and the commands that were run."""
    ran = []
    real = git.run
    monkeypatch.setattr(git, "run", lambda root, args, data=b"", *a, **k: (ran.append((args, data)), real(root, args, data, *a, **k))[1])
    reader = git.Pushing({"path": root}, fields)
    left = list(reader.pushFilters(filters))
    return [r for p in reader.partitions() for r in reader.read(p)], left, ran


def test_all_entries(monkeypatch, tree):
    rows, left, _ = read(monkeypatch, tree, FIELDS, [])
    assert {(r[0], r[3], r[4] if r[4] is None else len(r[4])) for r in rows} == {
        ("a.txt", 6, 6), ("src/in/b", 100, 100), ("src/inner", 0, 0), ("src/out", 2, 2), ("big", git.BLOB_BYTES + 1, None),
    }
    assert left == []


def test_sizes_read_no_content(monkeypatch, tree):
    rows, left, ran = read(monkeypatch, tree, ["path", "bytes"], [GreaterThan(("bytes",), 5), EqualTo(("mode",), "100644")])
    assert sorted(rows) == [("a.txt", 6), ("big", git.BLOB_BYTES + 1), ("src/in/b", 100)] and left == [EqualTo(("mode",), "100644")]
    assert not any("--batch" in args for args, _ in ran)
    _, _, ran = read(monkeypatch, tree, ["path"], [])
    assert [args[0] for args, _ in ran] == ["ls-tree"]


def test_paths_narrow_the_scan(monkeypatch, tree):
    rows, left, ran = read(monkeypatch, tree, FIELDS, [StringStartsWith(("path",), "src/in"), LessThanOrEqual(("bytes",), 50)])
    assert [r[0] for r in rows] == ["src/inner"] and left == [] and ran[0][0][-1] == "src/"
    assert [data.count(b"\n") for args, data in ran if "--batch" in args] == [1]
    assert [r[0] for r in read(monkeypatch, tree, FIELDS, [EqualTo(("path",), "src/out")])[0]] == ["src/out"]
    assert read(monkeypatch, tree, FIELDS, [EqualTo(("path",), "src")])[0] == []
    assert sorted(r[0] for r in read(monkeypatch, tree, FIELDS, [In(("path",), ("a.txt", "src/out", "no"))])[0]) == ["a.txt", "src/out"]


def test_in_a_plan(spark, tree):
    spark.dataSource.register(git.GitTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("git_tree").schema("path string, bytes long").options(path=tree, pushdown=True).load()
        assert {tuple(r) for r in df.filter("path LIKE 'src/%' AND bytes >= 2").collect()} == {("src/in/b", 100), ("src/out", 2)}
        whole = spark.read.format("git_tree").options(path=tree, pushdown=True).load()
        assert [bytes(r.content) for r in whole.filter((F.col("path") == "a.txt") & (F.length("content") > 1)).collect()] == [b"hello\n"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_repository(tmp_path):
    with pytest.raises(ValueError):
        git.repository("relative")
    with pytest.raises(RuntimeError):
        git.repository(str(tmp_path))
    one = tmp_path / "one"
    one.mkdir()
    subprocess.run(["git", "-C", str(one), "init", "-q"], check=True)
    assert git.repository(str(one))["head"] is None
    call = commit(one, {"sub/a": b"a"})
    call("worktree", "add", "-q", str(tmp_path / "two"), "-b", "other")
    (tmp_path / "link").symlink_to(one)
    a, b, c = (git.repository(str(tmp_path / x)) for x in ("one/sub", "two", "link"))
    assert a == c and a["root"] == os.path.realpath(one) and a["repo_id"] == b["repo_id"] and a["worktree_id"] != b["worktree_id"] and a["head"] == b["head"]


def test_limits_of_a_command(tree):
    with pytest.raises(ValueError):
        git.run(tree, ["ls-tree", "-r", "HEAD"], most=10)
    with pytest.raises(TimeoutError):
        git.run(tree, ["-c", "alias.wait=!exec sleep 20", "wait"], deadline=0.3)
    with pytest.raises(RuntimeError):
        git.run(tree, ["ls-tree", "nothing"])
