"""Streams, versions, evaluation, audit and validation on small fixtures."""

import collections
import hashlib
import math
import subprocess

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import audit, evaluate, streams, validate, versions

TEXTS = ["", "a", "é" * 5000, "line\n" * 3000, "x" * 9000 + "\n" + "ü" * 100, "\n" * 600, "日本\n" * 900, "end without newline\nlast"]


@pytest.mark.parametrize("text", TEXTS)
def test_pages_join_to_the_stream(text):
    raw, at, parts = text.encode(), 0, []
    while at < len(raw):
        p = streams.page(raw, at)
        assert 0 < len(p) <= streams.PAGE and p.decode() is not None and p == streams.page(raw, at)
        parts.append(p)
        at += len(p)
    assert b"".join(parts) == raw


def test_pages_query(spark, small):
    from corpusmill.plans.records import stream_pages

    got = stream_pages(spark, small).groupBy("doc_id").agg(F.sum("bytes").alias("n"))
    want = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("n")).filter("n > 0")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_page_errors():
    for at in (-1, 4, 1):
        with pytest.raises(ValueError):
            streams.page("éa".encode(), at)


@pytest.mark.parametrize("text", TEXTS)
def test_regions_cover(text):
    raw = text.encode()
    found = streams.regions(raw)
    assert (not raw and not found) or found[0][0] == 0 and found[-1][1] == len(raw)
    for (s, e, line), (s2, _, _) in zip(found, [*found[1:], (len(raw), 0, 0)]):
        assert e - s <= streams.REGION_BYTES and raw[s:e].count(b"\n") <= streams.REGION_LINES
        assert line == raw[:s].count(b"\n") + 1 and s < s2 <= e and (e - s2 <= streams.BACK_BYTES)
        raw[s:e].decode()


def brute_rank(text, terms=("the", "license")):
    """The best five regions of one stream of plain lower-case words, by BM25 over its own regions."""
    raw = text.encode()
    counts = [collections.Counter(raw[s:e].decode().split()) for s, e, _ in streams.regions(raw)]
    mean, scores = sum(sum(c.values()) for c in counts) / max(1, len(counts)), []
    df = {t: sum(t in c for c in counts) for t in terms}
    for i, c in enumerate(counts):
        if any(t in c for t in terms):
            idf = {t: math.log((len(counts) - df[t] + 0.5) / (df[t] + 0.5)) for t in terms}
            scores.append((-round(sum((idf[t] if idf[t] > 0 else 1e-6) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in terms), 9), i))
    return [(i, r, -s) for r, (s, i) in enumerate(sorted(scores)[:5], 1)]


def test_output_rank_ranks_streams_of_all_languages(spark, tmp_path):
    from corpusmill.plans.records import output_rank

    lines = ["some words here", "the words of this line", "a license", "the license of the words"]
    texts = {i: "\n".join(lines[(k * k // (7 + i) + k // 90) % 4 if k // 60 % 3 or i == 3 else 0] for k in range(n)) + "\n" for i, n in enumerate([900, 700, 300, 40])}
    rows = [(i, texts[i], lang) for i, lang in enumerate(["en", "de", None, "fr"])] + [(4, None, "en"), (5, "", "de"), (6, "no such word", "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.position, r["rank"], r.score) for r in output_rank(spark, str(tmp_path)).collect())
    want = sorted((i, *x) for i, t, _ in rows for x in brute_rank(t or ""))
    assert {w[0] for w in want} == {0, 1, 2, 3} and max(w[2] for w in want) == 5
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want))


def test_excerpt():
    body = "".join(f"line {i}\n" for i in range(40)) + "the token is here\n" + "tail\n" * 20
    s, e, before, after = streams.stream_excerpt(body, ["token"])
    shown = body.encode()[s:e].decode()
    assert "token" in shown and shown.count("\n") <= 8 and before and after
    assert streams.stream_excerpt("", ["x"]) == (0, 0, False, False)


def test_cursor(spark):
    handle = "0" * 31 + "a"
    row = spark.range(1).select(streams.cursor(F.lit(handle), F.lit(4096)).alias("c")).select("c", streams.open_cursor(F.col("c")).alias("o"), streams.open_cursor(F.concat(F.substring("c", 1, 113), F.lit("z"))).alias("bad")).first()
    assert len(row.c) == 114 and row.o.handle == handle and row.o.offset == 4096 and row.bad is None


def test_versions(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, oid string")
    overlay = spark.createDataFrame([("a", None), ("b", "9"), ("d", "4")], "path string, oid string")
    assert sorted(map(tuple, versions.active_view(base, overlay, ["path"], "oid").collect())) == [("b", "9"), ("c", "3"), ("d", "4")]
    after = spark.createDataFrame([("a", "1"), ("b", "5"), ("d", "4")], "path string, oid string")
    changes = versions.changed_entries(base, after, "path", ["oid"])
    assert sorted(map(tuple, changes.collect()), key=str) == [("b", "M", "5"), ("c", "D", None), ("d", "A", "4")]
    assert sorted(map(tuple, versions.apply_changes(base, changes, "path", F.lit(True)).collect())) == sorted(map(tuple, after.collect()))
    assert versions.changed_entries(after, after, "path", ["oid"]).isEmpty()
    act = lambda *x: spark.range(1).select(versions.refresh_action(*map(F.lit, x)).alias("x")).first().x
    assert [act("h", "h", "p:1", "p:1"), act("h", "i", "p:1", "p:1"), act("h", "h", "p:1", "q:1"), act("h", "h", "p:1", "p:2")] == ["none", "diff", "rescan", "overlay"]


def test_collectable(spark):
    rows = spark.createDataFrame([(1, 0, False), (2, 10**6, False), (3, 10**6, True)], "id int, created long, dirty boolean")
    assert [r.id for r in versions.collectable(rows, F.lit(10**6)).orderBy("id").collect()] == [1, 3]
    assert versions.collectable(rows, F.lit(0), pressure=True).count() == 3


def test_intervals(spark):
    rows = spark.createDataFrame([("p", 1, 5), ("p", 6, 8), ("p", 10, 12), ("p", 2, 3), ("q", 1, 1)], "path string, start int, end int")
    merged = evaluate.merged_ranges(rows, ["path"])
    assert sorted(map(tuple, merged.collect())) == [("p", 1, 8), ("p", 10, 12), ("q", 1, 1)]
    alt = spark.createDataFrame([("g", "p", 5, 14), ("g", "q", 2, 4), ("h", "z", 1, 2)], "group_id string, path string, start int, end int")
    assert {r.group_id: round(r.share, 3) for r in evaluate.group_overlaps(merged, alt, ["path"], "group_id").collect()} == {"g": 0.7, "h": 0.0}


def test_unknown_beats_false(spark):
    rows = spark.createDataFrame([(1, True, False), (1, True, False), (2, False, False), (2, None, False), (3, True, True), (4, False, None)], "g int, j boolean, c boolean")
    got = {r.g: r.d for r in rows.groupBy("g").agg(evaluate.all_of(F.col("j"), F.col("c")).alias("d")).collect()}
    assert got == {1: "pass", 2: "unscored", 3: "fail", 4: "fail"}


def test_ledger(spark):
    logs = {"a": ["created", "planned", "started", "reserved", "completed", "reserved", "failed"], "b": ["created", "started"], "c": ["created", "planned"]}
    df = spark.createDataFrame([(k, i, e) for k, v in logs.items() for i, e in enumerate(v)], "k string, i int, e string")
    assert {r.k: r.state for r in audit.replay(df, "k", ["i"], "e").collect()} == {"a": "stopped", "b": "invalid", "c": "planned"}


def test_tree_digest_equals_git(spark, tmp_path):
    files = {"a/x.txt": b"1", "a-b": b"2", "a/b/c": b"3", "z": b""}
    for p, c in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(c)
    from corpusmill.functions.text import blob_id

    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary").select("path", F.lit("100644").alias("mode"), blob_id(F.col("content")).alias("oid"))
    got = {r.path: r.oid for r in validate.tree_digests(df, "path", "mode", "oid").collect()}

    def tree(prefix):
        names = sorted({p[len(prefix) :].split("/")[0] for p in files if p.startswith(prefix)}, key=lambda n: n + "/" * (prefix + n not in files))
        body = b""
        for n in names:
            file = prefix + n in files
            oid = hashlib.sha1(b"blob %d\0" % len(files[prefix + n]) + files[prefix + n]).digest() if file else tree(prefix + n + "/")
            body += (b"100644 " if file else b"40000 ") + n.encode() + b"\0" + oid
        return hashlib.sha1(b"tree %d\0" % len(body) + body).digest()

    assert got[""] == tree("").hex() and got["a"] == tree("a/").hex()


def test_partition_plan():
    plan = validate.partition_plan([("a", 2), ("b", 3), ("c", 4), ("d", 1)], 6)
    assert sum({"a": 2, "b": 3, "c": 4, "d": 1}[k] for k, v in plan.items() if v == "development") == 6
    with pytest.raises(ValueError):
        validate.partition_plan([("a", 5)], 3)


def test_sources(spark, tmp_path):
    import io
    import json
    import tarfile

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from corpusmill.sources import files

    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.ts").write_text("one\ntwo\n")
    (root / "bin").write_bytes(b"\0")
    found = {r.path: r for r in files.inventory(files.file_tree(spark, str(root))).collect()}
    assert found["src/a.ts"].lines == 2 and found["src/a.ts"].skip is None and found["bin"].skip == "binary"
    schema = StructType([StructField("a", LongType()), StructField("b", StringType())])
    (tmp_path / "good.json").write_text('{"a": 1,\n "b": "x"}')
    (tmp_path / "bad.json").write_text('{"a": 1, "a": 2}')
    assert files.strict_json(spark, str(tmp_path / "good.json"), schema).first().b == "x"
    with pytest.raises(Exception, match="repeated"):
        files.strict_json(spark, str(tmp_path / "bad.json"), schema).collect()
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b"')
    assert [r.complete for r in files.event_log(spark, str(tmp_path / "log.jsonl"), schema).orderBy(F.desc("complete")).collect()] == [True, False]
    listing = spark.createDataFrame([("100644 blob aa\tx y\x00120000 blob bb\tz\x00",)], "value string")
    assert sorted(map(tuple, files.tree_listing(listing).collect())) == [("x y", "aa", "100644"), ("z", "bb", "120000")]
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        info = tarfile.TarInfo("p/a")
        info.size = 2
        tar.addfile(info, io.BytesIO(b"hi"))
    df = spark.createDataFrame([("t", bytearray(raw.getvalue()))], "path string, content binary")
    assert [tuple(r)[:3] for r in files.tar_members(df, "p/").collect()] == [("t", "a", 2)]
    deep = spark.createDataFrame([(json.dumps({"tools": [{"name": "x", "inner": {"name": "y"}}]}),)], "j string")
    assert sorted(r.name for r in files.nested_declarations(deep, "j").collect()) == ["x", "y"]


def test_git_source(spark, tmp_path):
    import shutil

    if not shutil.which("git"):
        pytest.skip("no git")
    from corpusmill.sources.git import GitTree

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("hello\n")
    run("add", ".")
    run("commit", "-qm", "x")
    spark.dataSource.register(GitTree)
    row = spark.read.format("git_tree").option("path", str(tmp_path)).load().first()
    assert (row.path, row.mode, bytes(row.content)) == ("a.txt", "100644", b"hello\n")


def test_streaming(spark, small, tmp_path):
    from corpusmill.streaming import jobs

    events = spark.read.parquet(f"{small}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).select("user_id", "event_id", "at")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    sessions = jobs.idle_sessions(stream, "user_id", "at", "30 minutes")
    sessions.writeStream.format("memory").queryName("sessions_out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r.user_id, r["first"]): r.n for r in spark.table("sessions_out").collect()}
    batch = audit.sessions(events, "user_id", F.unix_micros("at"), 1800 * 10**6)
    want = {(r.user_id, r["first"]): r.n for r in batch.select("user_id", F.timestamp_micros("first").alias("first"), "n").collect()}
    assert got and all(want[k] == n for k, n in got.items())
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    turns.coalesce(1).write.parquet(str(tmp_path / "turns"))
    counted = jobs.captured(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns")), "conv_id", "turn", "text", 1500)
    counted.writeStream.format("memory").queryName("captured_out").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    sizes = {r.conv_id: r.n for r in turns.groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert {r.conv_id: r.bytes for r in spark.table("captured_out").collect()} == sizes
