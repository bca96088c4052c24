"""The segmented index: after any change sets it scores as an index built afresh, and a refresh stores only what is new."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import index, rank, segments
from corpusmill.streaming import jobs

WORDS = "alpha beta gamma cc-by license licensed getToken refreshToken delta".split()


def text(rng):
    return "\n".join(" ".join(rng.choices(WORDS, k=4)) for _ in range(rng.choice([0, 3, 70, 130])))


def frame(spark, rows):
    return spark.createDataFrame(rows, "path_id long, path string, text string")


def change_sets(seed=4, n=5):
    rng = random.Random(seed)
    sets = [[(i, f"src/getToken{i}.py", text(rng)) for i in range(12)]]
    for _ in range(n - 1):
        rows = [(i, f"src/getToken{i}.py", rng.choice([None, text(rng), sets[0][i % 12][2]])) for i in rng.sample(range(15), 5)]
        sets.append(rows)
    return sets


def scores(held, phrases):
    return sorted((r.path_id, r.start_line, round(r.score, 9)) for r in held.candidates(phrases).collect())


def sums(held):
    return held.statistics().first().asDict()


@pytest.fixture(scope="module")
def phrases(spark):
    return rank.query_phrases(spark, "refreshToken license cc-by getToken3")


def test_refreshes_and_merges_equal_a_fresh_index(spark, phrases):
    held, files = segments.Segments(spark, index.shared_folder(spark)), {}
    first, seen_paths = held, {}
    for k, rows in enumerate(change_sets()):
        held = held.refresh(frame(spark, rows))
        files.update({i: (i, p, t) for i, p, t in rows})
        seen_paths.update({i: p for i, p, t in rows if t is not None})
        fresh = segments.Segments(spark, index.shared_folder(spark)).refresh(frame(spark, [r for r in files.values() if r[2] is not None]))
        want = {(i, p, t) for i, p, t in files.values() if t is not None}
        assert {(r.path_id, r.path) for r in held.view().collect()} == {(i, p) for i, p, _ in want}
        assert {c: v for c, v in sums(held).items() if not c.startswith("path")} == {c: v for c, v in sums(fresh).items() if not c.startswith("path")}
        if k in (1, 4):
            # statistics of paths span every path ever stored, so only chunk scores are those of a fresh index
            mine, theirs = ({(r.chunk_id, round(r.score, 9)) for r in x.chunk_scores(phrases).collect()} for x in (held, fresh))
            assert mine == theirs
    assert sums(held)["paths"] == len(seen_paths)
    before = scores(held, phrases), sums(held)
    merged = held.merge(3)
    assert len(merged.segments) == 3 and (scores(merged, phrases), sums(merged)) == before
    merged = merged.merge(3)
    assert len(merged.segments) == 1 and (scores(merged, phrases), sums(merged)) == before
    assert merged.table("contents").count() == sums(merged)["contents"] and merged.dead().count() == 0
    back = merged.refresh(frame(spark, change_sets()[0]))
    assert back.view().count() >= 12 and sums(segments.Segments(spark, back.root)) == sums(back)
    assert not first.segments, "a version once opened stays as it was"


def test_a_refresh_stores_new_contents_only(spark):
    one = segments.Segments(spark, index.shared_folder(spark)).refresh(frame(spark, [(1, "a", "x y"), (2, "b", "x y"), (3, "c", ""), (None, "d", "z"), (4, "e", None)]))
    assert sums(one) == {"contents": 2, "chunks": 1, "tokens": 2, "paths": 3, "path_tokens": 3}
    two = one.refresh(frame(spark, [(5, "f", "x y"), (1, "a", None), (2, "b", None)]))
    added = two._of("chunks", two.segments[1:])
    assert added.count() == 0 and two.view().count() == 2
    three = two.refresh(frame(spark, [(5, "f", None)]))
    assert sums(three)["chunks"] == 0 and three.dead().count() == 1
    four = three.refresh(frame(spark, [(6, "g", "x y")]))
    assert sums(four)["chunks"] == 1 and four.dead().count() == 0
    stored = segments.Segments(spark, three.root, live=False, version=three.version)
    assert sums(stored)["chunks"] == 1, "without live, statistics span what is stored"
    merged = three.merge(3)
    assert merged is None, "another version was published meanwhile"


def test_one_of_two_writers_wins(spark):
    start = segments.Segments(spark, index.shared_folder(spark)).refresh(frame(spark, [(1, "a", "x")]))
    won, lost = start.refresh(frame(spark, [(2, "b", "y")])), start.refresh(frame(spark, [(3, "c", "z")]))
    assert won is not None and lost is None
    assert {r.path for r in segments.Segments(spark, start.root).view().collect()} == {"a", "b"}


def test_empty_change_set_and_empty_index(spark, phrases):
    none = segments.Segments(spark, index.shared_folder(spark))
    assert none.view().count() == 0 and sums(none)["chunks"] == 0
    held = none.refresh(frame(spark, []))
    assert scores(held, phrases) == [] and held.merge().version == held.version


def test_stream_of_changes_runs_a_batch_once(spark, tmp_path):
    root, source = index.shared_folder(spark), str(tmp_path / "changes")
    step = jobs.refresh_index(root)
    for k, rows in enumerate([[(1, "a", "x y z")], [(2, "b", "x"), (1, "a", None)]]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("path_id long, path string, text string").parquet(source)
        query = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
        step(frame(spark, rows), k)  # the same batch once more, as after a failure
    held = segments.Segments(spark, root)
    assert {r.path for r in held.view().collect()} == {"b"} and held.batch == 1
    assert held.view().agg(F.count("*")).first()[0] == 1
