"""Responses, blinding, amendments and versioned publication."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import publish
from corpusmill.plans import catalog


def test_versions_are_published_once(spark, tmp_path):
    table = publish.VersionedTable(spark, str(tmp_path / "t"))
    assert table.current() == 0
    one, two = (spark.createDataFrame([(x,)], "x int") for x in (1, 2))
    assert table.publish(one, 0) and table.current() == 1
    assert not table.publish(two, 0)  # someone was first
    assert [r.x for r in table.read().collect()] == [1]
    assert table.publish(two, 1) and [r.x for r in table.read().collect()] == [2]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == 2


def test_guard_fails_instead_of_cutting(spark):
    rows = spark.createDataFrame([("x" * 70000,)], "t string").select(publish.guarded(F.col("t")).alias("t"))
    with pytest.raises(Exception, match="too large"):
        rows.collect()


def test_blind_round_trip(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "trial int")
    labels = publish.blind_labels(rows, "trial", "s")
    forms = labels.select("label", F.lit("good").alias("grade"))
    assert sorted(r.trial for r in publish.unblinded(forms, labels, "trial").collect()) == list(range(5))
    with pytest.raises(Exception, match="exactly once"):
        publish.unblinded(forms.union(forms), labels, "trial").collect()


def test_refresh_in_a_stream(spark, tmp_path):
    from corpusmill.streaming import jobs

    base = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, oid string")
    base.write.parquet(str(tmp_path / "base" / "start"))
    changes = spark.createDataFrame([("a", "D", None), ("b", "M", "3"), ("c", "A", "4")], "path string, status string, oid string")
    changes.coalesce(1).write.parquet(str(tmp_path / "changes"))
    stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "changes"))
    query = stream.writeStream.foreachBatch(jobs.refresh(str(tmp_path / "base"), "path", F.lit(True))).option("checkpointLocation", str(tmp_path / "state"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "base" / "0")).collect())) == [("b", "3"), ("c", "4")]


def test_first_events_in_a_stream(spark, tmp_path):
    from corpusmill.streaming import jobs

    events = spark.sql("SELECT id % 3 AS k, timestamp_seconds(1700000000 + id) AS at FROM range(30)")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    jobs.first_events(stream, ["k"], "at").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.table("firsts").collect()) == [0, 1, 2]


def test_listing(spark):
    rows = {r.name: r.oracle for r in catalog.listing(spark).collect()}
    assert rows.keys() == catalog.QUERIES.keys() and rows["bm25_topk"] and not rows["stream_pages"]
