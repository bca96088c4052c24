"""Search queries over the corpus tables: tokens, windows, policy, ranking, views and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunking, policy, rank, syntax, versions

QUERY = "licensed under the public license"
PHRASE = "cc-by example.com 4.0"
LITERAL, REGEX, GLOB = "license", r"\b\d+\.\d+\b", "src1*/[ef]?/*5"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rank.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    w = chunking.line_windows(docs, "doc_id", "text")
    return w.withColumn("chunk_id", F.concat_ws(":", "doc_id", "start_line"))


def tokenize_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", T.BETWEEN_WORDS)).alias("word"))
    words = docs.select(F.regexp_replace("word", T.ENDS, "").alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    return words.select("n", F.explode(T.word_tokens(F.col("word"))).alias("term")).groupBy("term").agg(F.sum("n").alias("n"))


def line_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("doc_id", F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.sha2("content", 256).alias("content_sha256"))


def syntax_chunks(spark, sf_dir):
    """Chunks of all documents and pages as files of the parsers that their paths ask for: pages as scripts with markup, documents as plain lines."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), "doc_id").alias("path"), "text")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), "page_id", F.lit(".tsx")).alias("path"), F.col("html").alias("text"))
    files = rank.spread(docs).unionByName(rank.spread(pages)).withColumn("parser", T.parser_for(F.col("path")))
    out = syntax.syntax_chunks(files, "path", "text", "parser")
    return out.select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "symbol", F.sha2("content", 256).alias("content_sha256"), "skipped")


def _lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    return docs.withColumn("line_no", (F.col("line_no") + 1).cast("long"))


def gap_fill_regions(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return chunking.uncovered_runs(lines, "doc_id", "line_no", F.octet_length("line") % 2 == 0)


def content_skip_reasons(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("html").alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "text")
    rows = pages.unionByName(docs).withColumn("reason", F.coalesce(policy.skip_reason(F.col("text").cast("binary"), 8000, 40, 1000), F.lit("none")))
    return rows.groupBy("origin", "reason").agg(F.count("*").alias("n"))


def path_policy(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    rules = policy.compile_rules("fr/*5\n!fr/825\n/de/\n")
    shown = pages.select("page_id", path.alias("path"))
    return shown.select("page_id", "path", policy.excluded(F.col("path"), rules).alias("excluded"))


def bm25_topk(spark, sf_dir):
    w = _windows(spark, sf_dir)
    terms = [t for p in rank.query_phrases(spark, QUERY) for t in p]
    scored = rank.bm25_of(rank.term_counts(w, "chunk_id", {"body": "content"}, terms, {}), "chunk_id", len(terms))
    # equal texts tie exactly in SQL but not to the last bit here, so rank by the rounded score
    best = rank.top(scored.withColumn("score", F.round("score", 6)), 20, "chunk_id")
    return best.select("chunk_id", "score")


def bm25_two_field(spark, sf_dir):
    docs = rank.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).withColumn("symbol", F.concat_ws(" ", "source", "lang"))
    counted = rank.term_counts(docs, "doc_id", {"symbol": "symbol", "body": "text"}, ["en", "license", "the"], {"symbol": 8.0})
    return rank.bm25_of(counted, "doc_id", 3).select("doc_id", F.round("score", 6).alias("score"))


def bm25_path_fusion(spark, sf_dir):
    docs = rank.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    terms = ["src1", "license"]
    body = rank.bm25_of(rank.term_counts(docs, "doc_id", {"body": "text"}, terms, {}), "doc_id", 2)
    path = rank.bm25_of(rank.term_counts(docs, "doc_id", {"path": "path"}, terms, {"path": 3.0}), "doc_id", 2)
    return rank.fused(body, path, key="doc_id").select("doc_id", F.round("score", 6).alias("score"))


def phrase_match(spark, sf_dir):
    docs = rank.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rank.phrase_counts(docs, "doc_id", "text", rank.query_phrases(spark, PHRASE))


def excerpts(spark, sf_dir):
    w = _windows(spark, sf_dir).filter(F.contains(F.lower("content"), F.lit("license")))
    out = rank.excerpt(w, "content", ["license", "public", "under"], "start_line")
    return out.select("chunk_id", F.col("excerpt_start").cast("long"), F.col("excerpt_end").cast("long"), "truncated", F.sha2("excerpt", 256).alias("excerpt_sha256"))


def _overlay(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").filter("toxic = 1 OR quality = 0")
    return labels.select("doc_id", F.when(F.col("toxic") == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("edited "), "doc_id")).alias("text"))


def active_view(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", "text")
    view = versions.active_view(base, _overlay(spark, sf_dir), ["doc_id"], "text")
    return view.select("doc_id", F.sha2("text", 256).alias("identity"))


def snapshot_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    before = docs.filter("lang <> 'fr'").select("doc_id", F.sha2("text", 256).alias("oid"))
    after = docs.filter("lang <> 'de'").select("doc_id", F.sha2(F.when(F.col("lang") == "es", T.upper_by_letter(F.col("text"))).otherwise(F.col("text")), 256).alias("oid"))
    return versions.changed_entries(before, after, "doc_id", ["oid"])


def content_dedup(spark, sf_dir):
    return versions.distinct_contents(table(spark, sf_dir, "documents").filter("text IS NOT NULL"), "text")


def gc_unreferenced(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("identity"), "lang", "source")
    contents = docs.select("identity").distinct()
    base, overlay = docs.filter("lang = 'en'"), docs.filter("source = 'src3'")
    return versions.unreferenced(contents, base, overlay, "identity")


def cache_probe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    entries = docs.select(F.sha2("text", 256).alias("oid"), F.col("lang").alias("parser"))
    return versions.missing_contents(entries, entries.filter("parser = 'en'"))


def literal_search(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lines.filter(F.contains("line", F.lit(LITERAL))).select("doc_id", "line_no", "line")


def regex_search(spark, sf_dir):
    return _lines(spark, sf_dir).filter(F.col("line").rlike(REGEX)).select("doc_id", "line_no", "line")


def read_range(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("lines", T.lines(F.col("text"))).filter(F.size("lines") >= 2)
    shown = F.slice("lines", 2, 3)
    before = F.element_at("lines", 1)
    return docs.select("doc_id", F.octet_length(before).cast("long").alias("skipped_bytes"), F.least(F.size("lines"), F.lit(4)).cast("long").alias("end_line"), F.sha2(F.array_join(shown, "\n"), 256).alias("lines_sha256"))


def file_list(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"))
    return docs.filter(F.col("path").rlike(T.glob_pattern(GLOB)))


def blob_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", T.blob_id(F.col("text").cast("binary")).alias("sha1_id"), T.blob_id(F.col("text").cast("binary"), "sha256").alias("sha256_id"))


def parsers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("path", F.concat(F.lit("a.b/"), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".ts", ".tsx", ".mjs", ".TS", ".jsx", "", ".d.cts")]), (F.col("page_id") % 7 + 1).cast("int"))))
    return pages.select("page_id", T.parser_for(F.col("path")).alias("parser"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_documents, line_windows, syntax_chunks, gap_fill_regions, content_skip_reasons, path_policy, bm25_topk, bm25_two_field, bm25_path_fusion,
        phrase_match, excerpts, active_view, snapshot_diff, content_dedup, gc_unreferenced, cache_probe, literal_search, regex_search,
        read_range, file_list, blob_ids, parsers,
    )
}

# SQL pieces.  The fold covers the letters that the generated map covers.
_WORDS = r"""words AS (SELECT id, field, regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS w FROM (
  SELECT id, field, unnest(regexp_split_to_array(txt, '[^\p{{L}}\p{{N}}_$\-/.]+')) AS w FROM ({source})) WHERE w <> ''),
terms AS (SELECT id, field, lower(w) AS whole, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(w,
  '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda p: lower(p)), lambda p: p <> '' AND p <> lower(w)))) AS parts
  FROM words WHERE w <> ''),
tokens AS (SELECT id, field, unnest(list_prepend(whole, parts)) AS token FROM terms)"""
_SEARCH = _WORDS + r""",
posted AS (SELECT id, field, term, count(*) AS tf FROM (SELECT id, field, unnest(regexp_split_to_array(strip_accents(lower(token)), '[^\p{{L}}\p{{N}}_]+')) AS term FROM tokens) WHERE term <> '' GROUP BY ALL),
lens AS (SELECT s.id, coalesce(sum(tf), 0) AS len FROM (SELECT DISTINCT id FROM ({source})) s LEFT JOIN posted p ON p.id = s.id GROUP BY s.id),
corpus AS (SELECT count(*) AS n_rows, avg(len) AS avg_len FROM lens),
hits AS (SELECT id, term, sum(tf * CASE field {weights} ELSE 1.0 END) AS f FROM posted WHERE term IN ({terms}) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT id, sum(CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_rows - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
  * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM hits JOIN dfs USING (term) JOIN lens USING (id), corpus GROUP BY id)"""
_LINES = r"""CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n') END"""
_SPLIT = f"split AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text IS NOT NULL)"
_WIN = _SPLIT + r""",
starts AS (SELECT doc_id, ls, unnest(range(1, greatest(1, len(ls) - 6) + 1, 54)) AS start_line FROM split WHERE len(ls) > 0),
windows AS (SELECT doc_id, start_line, least(start_line + 59, len(ls)) AS end_line, array_to_string(ls[start_line:least(start_line + 59, len(ls))], chr(10)) AS content FROM starts),
kept AS (SELECT *, doc_id || ':' || start_line AS chunk_id FROM windows WHERE NOT regexp_full_match(content, '\s*'))"""
_ALL = f"alllines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM split)"


def _in(*terms: str) -> str:
    return ", ".join(f"'{t}'" for t in terms)


ORACLES = {
    "tokenize_documents": "WITH " + _WORDS.format(source="SELECT doc_id AS id, 'body' AS field, text AS txt FROM documents") + " SELECT token AS term, count(*) AS n FROM tokens GROUP BY token",
    "line_windows": f"WITH {_WIN} SELECT doc_id, start_line, end_line, sha256(content) AS content_sha256 FROM kept",
    "gap_fill_regions": f"""WITH {_SPLIT}, {_ALL}, opened AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM alllines WHERE strlen(line) % 2 <> 0)
SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line FROM opened GROUP BY doc_id, island""",
    "content_skip_reasons": f"""WITH rows_ AS (SELECT 'pages' AS origin, html AS text FROM pages UNION ALL SELECT 'documents', text FROM documents),
cut AS (SELECT origin, text, {_LINES} AS ls FROM rows_)
SELECT origin, CASE WHEN strlen(text) > 8000 THEN 'file_too_large' WHEN contains(text, chr(0)) THEN 'binary' WHEN greatest(len(ls), 1) > 40 THEN 'too_many_lines'
 WHEN len(list_filter(ls, lambda x: strlen(x) > 1000)) > 0 THEN 'line_too_long' ELSE 'none' END AS reason, count(*) AS n FROM cut GROUP BY ALL""",
    "path_policy": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, path = '.searchignore' OR list_contains(string_split(path, '/'), '.git') OR CASE WHEN regexp_matches(path, '^de/.+$') THEN true WHEN regexp_matches(path, '^fr/825(/.+)?$') THEN false
 WHEN regexp_matches(path, '^fr/[^/]*5(/.+)?$') THEN true ELSE list_last(string_split(path, '/')) IN ('pnpm-lock.yaml', 'package-lock.json', 'yarn.lock', 'bun.lock', 'Cargo.lock')
 OR list_has_any(string_split(path, '/')[1:-2], ['node_modules', 'vendor', 'dist', 'build', 'coverage', 'target', '.next', '.cache']) END AS excluded FROM p""",
    "bm25_topk": f"WITH {_WIN}, " + _SEARCH.format(source="SELECT chunk_id AS id, 'body' AS field, content AS txt FROM kept", weights="WHEN '' THEN 1.0", terms=_in("license", "licensed", "public", "the", "under"))
    + " SELECT id AS chunk_id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, id LIMIT 20",
    "bm25_two_field": "WITH " + _SEARCH.format(source="SELECT doc_id AS id, 'body' AS field, text AS txt FROM documents UNION ALL SELECT doc_id, 'symbol', source || ' ' || lang FROM documents", weights="WHEN 'symbol' THEN 8.0", terms=_in("en", "license", "the"))
    + " SELECT id AS doc_id, round(score, 6) AS score FROM scored",
    "bm25_path_fusion": "WITH a AS (WITH " + _SEARCH.format(source="SELECT doc_id AS id, 'body' AS field, text AS txt FROM documents", weights="WHEN '' THEN 1.0", terms=_in("src1", "license")) + " SELECT id, score FROM scored), b AS (WITH "
    + _SEARCH.format(source="SELECT doc_id AS id, 'path' AS field, source || '/' || lang || '/' || doc_id AS txt FROM documents", weights="WHEN 'path' THEN 3.0", terms=_in("src1", "license")) + " SELECT id, score FROM scored)"
    + " SELECT id AS doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id",
    "excerpts": f"""WITH {_WIN}, hit AS (SELECT *, {_LINES.replace('text', 'content')} AS ls FROM kept WHERE contains(lower(content), 'license')),
counted AS (SELECT *, list_transform(ls, lambda x: contains(lower(x), 'license')::INT + contains(lower(x), 'public')::INT + contains(lower(x), 'under')::INT) AS cs FROM hit),
best AS (SELECT *, len(ls) - list_position(list_reverse(cs), list_max(cs)) AS b FROM counted),
placed AS (SELECT *, least(greatest(b - 2, 0), greatest(len(ls) - 8, 0)) AS first FROM best),
shown AS (SELECT *, left(array_to_string(list_transform(ls[first + 1:first + 8], lambda x: x[1:180]), chr(10)), 1000) AS excerpt FROM placed)
SELECT chunk_id, (start_line + first)::BIGINT AS excerpt_start, (start_line + first + greatest(len({_LINES.replace('text', 'excerpt')}), 1) - 1)::BIGINT AS excerpt_end, excerpt <> content AS truncated, sha256(excerpt) AS excerpt_sha256 FROM shown""",
    "active_view": """WITH o AS (SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE 'edited ' || doc_id END AS text FROM labels WHERE toxic = 1 OR quality = 0)
SELECT doc_id, sha256(text) AS identity FROM documents d WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = d.doc_id) UNION ALL SELECT doc_id, sha256(text) FROM o WHERE text IS NOT NULL""",
    "snapshot_diff": """WITH a AS (SELECT doc_id, sha256(text) AS oid FROM documents WHERE lang <> 'fr'), b AS (SELECT doc_id, sha256(CASE WHEN lang = 'es' THEN upper(text) ELSE text END) AS oid FROM documents WHERE lang <> 'de')
SELECT doc_id, CASE WHEN a.doc_id IS NULL THEN 'A' WHEN b.doc_id IS NULL THEN 'D' ELSE 'M' END AS status, b.oid AS oid FROM (SELECT doc_id AS ka, * FROM a) a FULL JOIN b USING (doc_id) WHERE a.ka IS NULL OR b.oid IS NULL OR a.oid <> b.oid""".replace("a.doc_id IS NULL", "a.ka IS NULL").replace("WHEN b.doc_id IS NULL", "WHEN b.oid IS NULL"),
    "content_dedup": "SELECT sha256(text) AS identity, count(*) AS copies, max(strlen(text)) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "gc_unreferenced": """SELECT DISTINCT sha256(text) AS identity FROM documents d WHERE text IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.text = d.text AND b.lang = 'en') AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.source = 'src3')""",
    "cache_probe": "SELECT sha256(text) AS oid, list_sort(list(DISTINCT lang)) AS parsers FROM documents WHERE text IS NOT NULL AND lang <> 'en' GROUP BY 1",
    "literal_search": f"WITH {_SPLIT}, {_ALL} SELECT doc_id, line_no, line FROM alllines WHERE contains(line, '{LITERAL}')",
    "regex_search": f"WITH {_SPLIT}, {_ALL} SELECT doc_id, line_no, line FROM alllines WHERE regexp_matches(line, '{REGEX}')",
    "read_range": f"WITH {_SPLIT} SELECT doc_id, strlen(ls[1]) AS skipped_bytes, least(len(ls), 4) AS end_line, sha256(array_to_string(ls[2:4], chr(10))) AS lines_sha256 FROM split WHERE len(ls) >= 2",
    "file_list": "SELECT source || '/' || lang || '/' || doc_id AS path FROM documents WHERE regexp_matches(source || '/' || lang || '/' || doc_id, '^src1[^/]*/[ef][^/]/[^/]*5$')",
    "blob_ids": "SELECT doc_id, sha1(concat('blob '::BLOB, strlen(text)::VARCHAR::BLOB, '\\x00'::BLOB, encode(text))) AS sha1_id, sha256(concat('blob '::BLOB, strlen(text)::VARCHAR::BLOB, '\\x00'::BLOB, encode(text))) AS sha256_id FROM documents WHERE text IS NOT NULL".replace("concat(", "(").replace("::BLOB, ", "::BLOB || ").replace("::BLOB || encode", "::BLOB || encode"),
    "parsers": "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'typescript-v1' WHEN 1 THEN 'tsx-v1' WHEN 2 THEN 'typescript-v1' WHEN 4 THEN 'tsx-v1' WHEN 6 THEN 'typescript-v1' ELSE 'lines-v1' END AS parser FROM pages",
    "phrase_match": r"""WITH d AS (SELECT doc_id, flatten(list_transform(list_filter(list_transform(regexp_split_to_array(text, '[^\p{L}\p{N}_$\-/.]+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> ''),
 lambda w: list_prepend(lower(w), list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(w, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '[^\p{L}\p{N}]+'), lambda p: lower(p)), lambda p: p <> '' AND p <> lower(w))))))) AS toks FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, flatten(list_transform(toks, lambda t: list_filter(regexp_split_to_array(strip_accents(lower(t)), '[^\p{L}\p{N}_]+'), lambda x: x <> ''))) AS st FROM d),
p AS (SELECT unnest([['0'], ['4'], ['4', '0'], ['by'], ['cc'], ['cc', 'by'], ['com'], ['example'], ['example', 'com']]) AS ph),
c AS (SELECT doc_id, array_to_string(ph, ' ') AS phrase, len(list_filter(range(1, len(st) - len(ph) + 2), lambda i: st[i:i + len(ph) - 1] = ph)) AS n FROM e, p)
SELECT doc_id, phrase, n FROM c WHERE n > 0""",
}
