"""Streaming capture, feed, ledger and correlation, each against its batch form and across a restart."""

import glob
import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import streams
from corpusmill.sources import feed, ledger
from corpusmill.streaming import capture, jobs

PARTS = "handle string, part long, content binary, last boolean"
BIG = ("line of a long output\n" * 700).encode()
SPLIT = "né日本".encode() * 900
STREAMS = {
    "small": [b"one\ntwo"], "empty": [b""], "large": [BIG[:5000], BIG[5000:5001], BIG[5001:]], "split": [SPLIT[i : i + 7] for i in range(0, len(SPLIT), 7)],
    "nul": [b"a" * 5000, b"b\0c", b"rest"], "broken": [b"ok \xe3\x81", b"oops"], "open": [b"ends in \xe3\x81"], "huge": [b"x" * 3000] * 5,
}


def stream_rows():
    return [(h, k, bytes(p), k == len(parts) - 1) for h, parts in STREAMS.items() for k, p in enumerate(parts)]


def chain(raw):
    out = ""
    for at in range(0, len(raw), streams.CHUNK):
        out = hashlib.sha256((out + hashlib.sha256(raw[at : at + streams.CHUNK]).hexdigest()).encode()).hexdigest()
    return out


def run(spark, source, where, step, **options):
    writer = step(spark.readStream.schema(PARTS).option("maxFilesPerTrigger", 1).parquet(source)).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/at")
    query = writer.trigger(**(options or {"availableNow": True})).start()
    return query


def test_capture_over_restarts_equals_its_batch_form(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "RESERVED", len(BIG))
    capture.use_rocksdb(spark)
    source, rows = str(tmp_path / "in"), stream_rows()
    cut = {h: (len(p) + 1) // 2 for h, p in STREAMS.items()}
    # streams go on in a second run from state
    for chosen in ([r for r in rows if r[1] < cut[r[0]]], [r for r in rows if r[1] >= cut[r[0]]]):
        spark.createDataFrame(chosen, PARTS).coalesce(1).write.mode("append").parquet(source)
        query = run(spark, source, tmp_path, lambda df: capture.captured(df, idle=600, overall=600, cap=len(BIG)))
        query.awaitTermination(120)
        query.stop()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    by = {h: sorted((r for r in got if r.handle == h), key=lambda r: r.ordinal) for h in STREAMS}
    want = {r.handle: r for r in streams.capture_outcomes(spark.createDataFrame(rows, PARTS), "handle", "part", "content").collect()}
    for h, parts in STREAMS.items():
        raw = b"".join(parts)
        assert want[h].bytes == len(raw) and want[h].parts == len(parts)
        last = [r for r in by[h] if r.kind in ("stored", "passed", "fallback")]
        assert [r.kind for r in last] == [want[h].outcome], h
        assert last[0].capture_error == want[h].capture_error
        if want[h].outcome == "stored":
            chunks = b"".join(bytes(r.content) for r in by[h] if r.kind == "chunk")
            assert chunks == raw and hashlib.sha256(chunks).hexdigest() == want[h].digest
            assert last[0].chain == chain(raw) and last[0].lines == want[h].lines and last[0].bytes == len(raw)
        elif want[h].outcome == "passed":
            assert bytes(last[0].content or b"") == raw and last[0].lines == want[h].lines
        else:
            kept = b"".join(bytes(r.content) for k in ("chunk", "fallback", "through") for r in sorted((r for r in by[h] if r.kind == k), key=lambda r: r.bytes))
            assert kept == raw, "a fallback forwards every byte"
    assert want["huge"].capture_error is None and {want[h].capture_error for h in ("nul", "broken", "open")} == {"nul", "invalid_utf8"}


def test_capture_deadline(spark, tmp_path):
    capture.use_rocksdb(spark)
    spark.createDataFrame([("idle", 0, b"abc", False)], PARTS).write.parquet(str(tmp_path / "in"))
    query = run(spark, str(tmp_path / "in"), tmp_path, lambda df: capture.captured(df, idle=1, overall=600), processingTime="500 milliseconds")
    try:
        for _ in range(120):
            time.sleep(0.5)
            rows = spark.read.schema(capture.ROWS).parquet(f"{tmp_path}/out").collect() if os.path.isdir(tmp_path / "out/_spark_metadata") else []
            if rows:
                break
    finally:
        query.stop()
    assert [(r.kind, bytes(r.content), r.capture_error) for r in rows] == [("fallback", b"abc", "idle")]


def test_feed_reads_no_byte_twice(spark, tmp_path):
    feed.register(spark)
    (tmp_path / "in").mkdir()
    data = {"a": os.urandom(200_000), "b": b"", "c": b"tail"}

    def run_feed():
        query = spark.readStream.format("byte_feed").option("path", str(tmp_path / "in")).option("range", 50_000).load().writeStream.format("parquet")
        query.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(60)

    for share in (0.4, 1.0):
        for name, raw in data.items():
            (tmp_path / "in" / name).write_bytes(raw[: int(len(raw) * share)])
        run_feed()
    run_feed()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("file", "offset").collect():
        assert r.offset == len(got.get(r.file, b"")), "ranges follow each other without overlap"
        got[r.file] = got.get(r.file, b"") + bytes(r.content)
    assert got == {k: v for k, v in data.items() if v}


def test_feed_deadlines(tmp_path):
    reader = feed.FeedReader({"path": str(tmp_path), "idle": "0"})
    with pytest.raises(TimeoutError, match="idle"):
        time.sleep(0.01)
        reader.latestOffset()
    (tmp_path / "x").write_bytes(b"1")
    with pytest.raises(TimeoutError, match="longer"):
        feed.FeedReader({"path": str(tmp_path), "overall": "0"}).latestOffset()
    with pytest.raises(ValueError, match="shrank"):
        reader.partitions({"x": 5}, {"x": 1})


def append(spark, root, where, batches, **options):
    """A stream of the rows of ``batches`` into the ledger."""
    for rows in batches:
        spark.createDataFrame(rows, "id long, kind string").repartition(2).write.mode("append").parquet(f"{where}/in")
        writer = spark.readStream.schema("id long, kind string").parquet(f"{where}/in").writeStream.format("ledger").options(path=root, **options)
        writer.option("checkpointLocation", f"{where}/at").trigger(availableNow=True).start().awaitTermination(60)


def test_ledger_is_all_or_nothing(spark, tmp_path):
    ledger.register(spark)
    root = str(tmp_path / "ledger")
    append(spark, root, tmp_path, [[(k, "a") for k in range(5)], [(k, "b") for k in range(5, 9)]])
    rows = lambda: sorted(r.id for r in ledger.read(spark, root, "id long, kind string").collect())
    assert rows() == list(range(9)) and len(ledger.entries(root)) == 2
    with pytest.raises(Exception, match="disk is full"):
        append(spark, root, tmp_path, [[(k, "c") for k in range(9, 30)]], fail_after=1)
    assert rows() == list(range(9)), "a failed batch leaves readers at the last entry"
    append(spark, root, tmp_path, [])
    writer = spark.readStream.schema("id long, kind string").parquet(f"{tmp_path}/in").writeStream.format("ledger").option("path", root)
    writer.option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(60)
    assert rows() == list(range(30)), "the same batch once more"
    entry = sorted(glob.glob(f"{root}/entry-*"))[1]
    told = json.load(open(entry))
    again = ledger.LedgerWriter({"path": root})
    before = len(ledger.entries(root))
    again.commit([], told["batch"])
    assert len(ledger.entries(root)) == before, "a batch has one entry"
    with open(f"{root}/{told['files'][0]['file']}", "ab") as file:
        file.write(b"{}\n")
    with pytest.raises(ValueError, match="not what its entry says"):
        rows()
    json.dump(told | {"batch": 7}, open(entry, "w"))
    with pytest.raises(ValueError, match="chain"):
        ledger.entries(root)
    open(f"{root}/entry-999999999999.json", "w").write('{"bat')
    json.dump(told, open(entry, "w"))
    with pytest.raises(ledger.PoisonedLedger):
        again.commit([], 99)


def test_started_and_completed_equal_the_batch_join(spark, tmp_path):
    events = [("a", "start", 0), ("a", "end", 30), ("b", "start", 10), ("c", "end", 12), ("d", "start", 20), ("d", "end", 4000), ("z", "start", 20000), ("y", "end", 20000)]
    rows = [(k, kind, s) for k, kind, s in events]
    spark.createDataFrame(rows, "id string, kind string, s long").select("id", "kind", F.timestamp_seconds(F.col("s") + 1_000_000).alias("at")).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id string, kind string, at timestamp").parquet(f"{tmp_path}/in")
    out = jobs.started_and_completed(source.filter("kind = 'start'"), source.filter("kind = 'end'"), "id", "at", "10 minutes", "1 minute")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.id, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", "completed"), ("b", "missing"), ("d", "missing")], "z may still complete"
