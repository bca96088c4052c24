"""An index kept up to date by change sets: files deleted, rewritten and restored as the label and conversation tables say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import index, rank, segments
from corpusmill.plans import retrieval, search
from corpusmill.plans.search import table

QUERY = retrieval.QUERY


def change_sets(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The first snapshot, then: toxic files deleted; files of low quality rewritten as the opening of the conversation of their number; good toxic ones restored."""
    docs = rank.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    files = docs.select(F.col("doc_id").alias("path_id"), F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "text")
    labels = table(spark, sf_dir, "labels")
    named = lambda condition: files.join(labels.filter(condition).select(F.col("doc_id").alias("path_id")).distinct(), "path_id", "left_semi")
    opening = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("path_id")).agg(F.min_by(F.struct("text"), F.struct("turn", "text")).alias("opening"))
    rewritten = named("quality = 0 AND toxic = 0").join(opening, "path_id").select("path_id", "path", F.col("opening.text").alias("text"))
    return [files, named("toxic = 1").withColumn("text", F.lit(None).cast("string")), rewritten, named("toxic = 1 AND quality = 1")]


def _state(held: segments.Segments, batch: int) -> DataFrame:
    active = held.view().agg(F.count("*").alias("active"))
    return held.statistics().crossJoin(F.broadcast(active)).select(F.lit(batch).alias("batch"), "contents", "chunks", "tokens", "paths", "path_tokens", "active")


def refresh_index(spark, sf_dir):
    """Statistics of the index after each change set; segments are merged when that is due."""
    held, out = segments.Segments(spark, index.shared_folder(spark)), None
    for batch, changes in enumerate(change_sets(spark, sf_dir)):
        held = held.refresh(changes).merge()
        out = _state(held, batch) if out is None else out.unionByName(_state(held, batch))
    return out


def search_after_refresh(spark, sf_dir):
    """Scores of every chunk of an active file that has a term of the query, after all change sets, over what is live."""
    held = segments.Segments(spark, index.shared_folder(spark))
    for changes in change_sets(spark, sf_dir):
        held = held.refresh(changes)
    found = held.candidates(rank.query_phrases(spark, QUERY))
    return found.select("path_id", F.col("start_line").cast("long").alias("start_line"), F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (refresh_index, search_after_refresh)}

_VIEWS = """v0 AS (SELECT doc_id AS path_id, concat_ws('/', source, lang, doc_id) AS path, text FROM documents WHERE text IS NOT NULL),
v1 AS (SELECT * FROM v0 WHERE path_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
opening AS (SELECT conv_id, arg_min(text, (turn, text)) AS opening FROM conversations GROUP BY conv_id),
new2 AS (SELECT path_id, path, opening AS text FROM v0 JOIN opening ON conv_id = path_id WHERE path_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0)),
v2 AS (SELECT * FROM v1 WHERE path_id NOT IN (SELECT path_id FROM new2) UNION ALL SELECT * FROM new2),
v3 AS (SELECT * FROM v2 UNION ALL SELECT * FROM v0 WHERE path_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 1))"""


def _windows(source: str) -> str:
    contents = f"contents AS (SELECT DISTINCT sha256(text) AS identity, text FROM {source})"
    return contents + ", " + retrieval._CHUNKS


def _after(batch: int) -> str:
    return f"""SELECT {batch} AS batch, (SELECT count(DISTINCT sha256(text)) FROM v{batch}) AS contents, count(*) AS chunks, coalesce(sum(n), 0)::BIGINT AS tokens,
(SELECT count(*) FROM v0) AS paths, (SELECT coalesce(sum(len({retrieval._TOKENS.format('path')})), 0)::BIGINT FROM v0) AS path_tokens, (SELECT count(*) FROM v{batch}) AS active
FROM sized WHERE identity IN (SELECT sha256(text) FROM v{batch})"""


ORACLES = {
    "refresh_index": f"""WITH {_VIEWS}, every AS (SELECT text FROM v0 UNION ALL SELECT text FROM new2), {_windows('every')},
sized AS (SELECT identity, len({retrieval._TOKENS.format('content')}) AS n FROM kept)
{' UNION ALL '.join(_after(b) for b in range(4))}""",
    "search_after_refresh": f"""WITH {_VIEWS}, {_windows('v3')}, names AS (SELECT path_id, path FROM v0), act AS (SELECT path_id, path, sha256(text) AS identity FROM v3),
{retrieval._OF_CHUNKS}, {retrieval._OF_PATHS},
cand AS (SELECT path_id, chunk_id, start_line, score FROM act JOIN kept USING (identity) JOIN c_s ON c_s.id = chunk_id UNION ALL SELECT path_id, chunk_id, start_line, score FROM act JOIN p_s ON p_s.id = path_id JOIN kept USING (identity))
SELECT path_id, start_line::BIGINT AS start_line, round(sum(score), 6) AS score FROM cand GROUP BY path_id, chunk_id, start_line""",
}
