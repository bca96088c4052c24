"""Ranked search over a stored index: active view, chunk and path scores, phrases, and the upkeep of overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import index, rank, segments, versions
from corpusmill.plans import search
from corpusmill.plans.search import table

QUERY = "src1 licensed under the cc-by license"


def _path(source: str = "source"):
    return F.concat_ws("/", source, "lang", "doc_id")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rank.spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).filter("text IS NOT NULL")
    return docs.select(F.col("doc_id").alias("path_id"), _path().alias("path"), index.identity(F.col("text")).alias("identity"), "text")


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited and deleted files: a null text is a tombstone."""
    edits = search._overlay(spark, sf_dir)
    paths = table(spark, sf_dir, "documents").select("doc_id", _path().alias("path"))
    named = edits.join(paths, "doc_id").withColumnRenamed("doc_id", "path_id")
    return named.select("path_id", "path", index.identity(F.col("text")).alias("identity"), "text")


def stored_index(spark: SparkSession, sf_dir: str) -> segments.Segments:
    """The index of all contents, committed and edited; statistics span what is stored, whatever the view shows."""
    held = segments.Segments(spark, index.shared_folder(spark), live=False)
    return held.refresh(_base(spark, sf_dir).select("path_id", "path", "text")).refresh(_overlay(spark, sf_dir).select("path_id", "path", "text"))


def search_active(spark, sf_dir):
    """The twenty best chunks of the active view, with excerpts."""
    out = stored_index(spark, sf_dir).search(QUERY, 20)
    places = {c: F.col(c).cast("long") for c in ("place", "start_line", "end_line", "snippet_start_line", "snippet_end_line")}
    return out.withColumns(places).withColumn("content", F.sha2("content", 256))


def search_phrase(spark, sf_dir):
    """Scores of every stored chunk for terms of which some are phrases."""
    scored = stored_index(spark, sf_dir).chunk_scores(rank.query_phrases(spark, QUERY))
    return scored.select("chunk_id", F.round("score", 6).alias("score"))


def path_fanout(spark, sf_dir):
    """Path scores, one row for every chunk of each active file."""
    found = stored_index(spark, sf_dir).path_candidates(rank.query_phrases(spark, QUERY))
    return found.select("path_id", F.col("start_line").cast("long"), F.round("score", 6).alias("score"))


def indexed_counts(spark, sf_dir):
    """Chunks of every path of the inventory, unindexed ones with none."""
    chunks = stored_index(spark, sf_dir).table("contents").select("identity", "chunks")
    inventory = table(spark, sf_dir, "documents").select(_path().alias("path"), index.identity(F.col("text")).alias("identity"))
    return inventory.join(chunks, "identity", "left").groupBy("path").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def refresh_overlays(spark, sf_dir):
    """Overlays of the edited tree after a scan in which some edits were undone, kept, renewed or new."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    n = F.col("doc_id")
    old = labels.filter("quality = 0").select("doc_id", F.concat(F.lit("fp"), n).alias("fingerprint"), F.concat(F.lit("edit"), n).alias("identity"))
    fingerprint = F.concat(F.when(n % 3 == 0, "fp").otherwise("new"), n)
    identity = F.when(n % 5 == 0, index.identity(F.col("text"))).when(n % 7 != 0, F.concat(F.lit("again"), n))
    dirty = labels.filter((F.col("toxic") == 1) | (n % 2 == 0)).select("doc_id", fingerprint.alias("fingerprint"), identity.alias("identity"))
    base = table(spark, sf_dir, "documents").select("doc_id", index.identity(F.col("text")).alias("identity"))
    return versions.refreshed_overlays(old, base, dirty, "doc_id")


QUERIES = {f.__name__: f for f in (search_active, search_phrase, path_fanout, indexed_counts, refresh_overlays)}

_TOKENS = r"""flatten(list_transform(flatten(list_transform(list_filter(list_transform(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}_$\-/.]+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w <> ''),
 lambda w: list_prepend(lower(w), list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(w, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda p: lower(p)), lambda p: p <> '' AND p <> lower(w))))))),
 lambda t: list_filter(regexp_split_to_array(strip_accents(lower(t)), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')))"""
_PHRASES = "[['by'], ['cc'], ['cc', 'by'], ['license'], ['licensed'], ['src1'], ['the'], ['under']]"


def _scores(name: str, source: str, key: str, text: str, weight: float) -> str:
    return f"""{name}_e AS (SELECT {key} AS id, {_TOKENS.format(text)} AS st FROM {source}),
{name}_c AS (SELECT count(*) AS n_rows, avg(len(st)) AS avg_len FROM {name}_e),
{name}_f AS (SELECT id, len(st) AS n, ph, {weight} * len(list_filter(range(1, len(st) - len(ph) + 2), lambda i: st[i:i + len(ph) - 1] = ph)) AS f FROM {name}_e, (SELECT unnest({_PHRASES}) AS ph)),
{name}_d AS (SELECT ph, count(*) AS df FROM {name}_f WHERE f > 0 GROUP BY ph),
{name}_s AS (SELECT id, sum(CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_rows - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / avg_len))) AS score
 FROM {name}_f JOIN {name}_d USING (ph), {name}_c WHERE f > 0 GROUP BY id)"""


_FILES = """base AS (SELECT doc_id AS path_id, concat_ws('/', source, lang, doc_id) AS path, text FROM documents WHERE text IS NOT NULL),
over_ AS (SELECT d.doc_id AS path_id, concat_ws('/', source, lang, d.doc_id) AS path, CASE WHEN toxic = 1 THEN NULL ELSE 'edited ' || d.doc_id END AS text FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 1 OR quality = 0),
files AS (SELECT * FROM base UNION ALL SELECT * FROM over_ WHERE text IS NOT NULL),
contents AS (SELECT DISTINCT sha256(text) AS identity, text FROM files),
names AS (SELECT DISTINCT path_id, path FROM files),
act AS (SELECT path_id, path, sha256(text) AS identity FROM base b WHERE NOT EXISTS (SELECT 1 FROM over_ o WHERE o.path_id = b.path_id) UNION ALL SELECT path_id, path, sha256(text) FROM over_ WHERE text IS NOT NULL)"""
_CHUNKS = search._WIN.replace("FROM documents", "FROM contents").replace("doc_id", "identity").replace("identity || ':'", "left(identity, 32) || ':'")
_CUT = search._LINES.replace("text", "content")
_OF_CHUNKS, _OF_PATHS = _scores("c", "kept", "chunk_id", "content", 1.0), _scores("p", "names", "path_id", "path", 3.0)
_TERMS = ("by", "cc", "cc-by", "license", "licensed", "src1", "the", "under")

ORACLES = {
    "search_active": f"""WITH {_FILES}, {_CHUNKS}, {_OF_CHUNKS}, {_OF_PATHS},
cand AS (SELECT path_id, chunk_id, start_line, score FROM act JOIN kept USING (identity) JOIN c_s ON c_s.id = chunk_id UNION ALL SELECT path_id, chunk_id, start_line, score FROM act JOIN p_s ON p_s.id = path_id JOIN kept USING (identity)),
best AS (SELECT path_id, chunk_id, round(sum(score), 6) AS score FROM cand GROUP BY path_id, chunk_id, start_line ORDER BY round(sum(score), 6) DESC, path_id, start_line LIMIT 20),
hit AS (SELECT k.*, path, score, {_CUT} AS ls FROM best JOIN kept k USING (chunk_id) JOIN act USING (path_id)),
counted AS (SELECT *, list_transform(ls, lambda x: {' + '.join(f"contains(lower(x), '{t}')::INT" for t in _TERMS)}) AS cs FROM hit),
placed AS (SELECT *, least(greatest(len(ls) - list_position(list_reverse(cs), list_max(cs)) - 2, 0), greatest(len(ls) - 8, 0)) AS first FROM counted),
shown AS (SELECT *, left(array_to_string(list_transform(ls[first + 1:first + 8], lambda x: x[1:180]), chr(10)), 1000) AS excerpt FROM placed)
SELECT row_number() OVER (ORDER BY score DESC, path, start_line) AS place, path, start_line, end_line, NULL::VARCHAR AS symbol, sha256(excerpt) AS content, (start_line + first)::BIGINT AS snippet_start_line,
 (start_line + first + greatest(len({search._LINES.replace('text', 'excerpt')}), 1) - 1)::BIGINT AS snippet_end_line, excerpt <> content AS truncated, identity AS content_identity, score FROM shown""",
    "search_phrase": f"WITH {_FILES}, {_CHUNKS}, {_OF_CHUNKS} SELECT id AS chunk_id, round(score, 6) AS score FROM c_s",
    "path_fanout": f"WITH {_FILES}, {_CHUNKS}, {_OF_PATHS} SELECT path_id, start_line, round(score, 6) AS score FROM act JOIN p_s ON p_s.id = path_id JOIN kept USING (identity)",
    "indexed_counts": f"""WITH {_FILES}, {_CHUNKS}, n AS (SELECT identity, count(*) AS chunks FROM kept GROUP BY identity)
SELECT concat_ws('/', source, lang, doc_id) AS path, coalesce(sum(chunks), 0)::BIGINT AS chunks FROM documents LEFT JOIN n ON n.identity = sha256(text) GROUP BY 1""",
    "refresh_overlays": """WITH l AS (SELECT l.*, text FROM labels l JOIN documents USING (doc_id)),
o AS (SELECT doc_id, 'fp' || doc_id AS fp, 'edit' || doc_id AS id FROM l WHERE quality = 0),
d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fp' ELSE 'new' END || doc_id AS fp, CASE WHEN doc_id % 5 = 0 THEN sha256(text) WHEN doc_id % 7 <> 0 THEN 'again' || doc_id END AS id FROM l WHERE toxic = 1 OR doc_id % 2 = 0),
j AS (SELECT coalesce(o.doc_id, d.doc_id) AS doc_id, o.fp AS ofp, o.id AS oid, d.fp AS dfp, d.id AS did, CASE WHEN d.doc_id IS NULL THEN 'stale' WHEN o.fp = d.fp THEN 'kept'
 WHEN d.id = (SELECT sha256(text) FROM documents x WHERE x.doc_id = d.doc_id) THEN 'reverted' ELSE 'written' END AS action FROM o FULL JOIN d ON o.doc_id = d.doc_id)
SELECT doc_id, coalesce(dfp, ofp) AS fingerprint, CASE WHEN action = 'kept' THEN oid ELSE did END AS identity, action FROM j""",
}
