"""Replayed logs, digests of large sets, exact quantiles and instruction blocks over the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import folds, requests
from corpusmill.plans.search import table

MARKERS = {"fixture:asks": "?", "fixture:which": "wh"}

LANGS = ('de', 'en', 'es', 'fr')
#: A source's documents as a log: each language may follow each, but for en right after de.
STEPS = {(s, k): k for s in ("", *LANGS) for k in LANGS if (s, k) != ('de', 'en')}


def _log(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "doc_id", "lang")


def replayed_logs(spark, sf_dir):
    """Where every source's log of languages leads, and the first step that is not allowed; a hot source is one log."""
    return folds.replay_log(_log(spark, sf_dir), "source", ["doc_id"], "lang", STEPS)


def replay_mismatches(spark, sf_dir):
    """Logs whose replay differs from a summary saved without the toxic documents."""
    log = _log(spark, sf_dir)
    replayed = folds.replay_log(log, "source", ["doc_id"], "lang", STEPS)
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    saved = folds.replay_log(log.join(toxic, "doc_id", "left_anti"), "source", ["doc_id"], "lang", STEPS)
    out = folds.against_summary(replayed, saved, "source", ["state", "records", "broken_at"])
    return out.select("source", F.array_join("mismatches", ",").alias("mismatches"))


def merkle_digests(spark, sf_dir):
    """One digest for each source's texts, whatever their number."""
    return folds.merkle_digest(table(spark, sf_dir, "documents"), ["source"], F.col("text"), width=16)


def length_quantiles(spark, sf_dir):
    """Exact quantiles of the lengths of each source's texts, with no source held or sorted."""
    docs = table(spark, sf_dir, "documents").select("source", F.length("text").alias("chars"))
    found = folds.order_statistics(docs, ["source"], "chars", {"median": ("cont", 0.5), "p95": ("disc", 0.95), "p999": ("disc", 0.999)})
    return found.select("source", "n", "median", F.col("p95").cast("long").alias("p95"), F.col("p999").cast("long").alias("p999"))


def instruction_blocks(spark, sf_dir):
    """The instruction texts inside requests that are put together from conversations."""
    parts = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("text").alias("type"), x.alias("text")))
    item = F.when(F.contains("text", F.lit("\n")), F.to_json(F.struct("role", parts.alias("content")))).otherwise(F.to_json(F.struct("role", F.col("text").alias("content"))))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", item.alias("item"))
    asked = turns.groupBy("conv_id").agg(F.to_json(F.struct(F.min_by("text", "turn").alias("instructions"))).alias("head"), F.array_sort(F.collect_list(F.struct("turn", "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), ",")
    request = F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"input":['), body, F.lit("]}"))
    out = requests.instruction_blocks(asked.select("conv_id", request.alias("request")), "conv_id", "request", MARKERS)
    return out.select("conv_id", "location", "role", "bytes", "sha256", F.array_join("origins", ",").alias("origins"))


QUERIES = {f.__name__: f for f in (replayed_logs, replay_mismatches, merkle_digests, length_quantiles, instruction_blocks)}


_LANGS = ", ".join(f"'{x}'" for x in LANGS)


def _replay(name: str, where: str) -> str:
    """Common table expressions that replay the documents of ``where`` one step at a time."""
    return f"""{name}_e AS (SELECT source, lang AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE {where}),
{name}_s AS (SELECT DISTINCT source, 0::BIGINT AS i, '' AS state, NULL::BIGINT AS broken FROM {name}_e
 UNION ALL SELECT source, i, state, CASE WHEN broken IS NOT NULL THEN broken WHEN state = 'invalid' THEN i - 1 END FROM
 (SELECT s.source, e.i, broken, CASE WHEN state = 'invalid' OR (state = 'de' AND k = 'en') OR k IS NULL OR k NOT IN ({_LANGS}) THEN 'invalid' ELSE k END AS state
 FROM {name}_s s JOIN {name}_e e ON s.source = e.source AND e.i = s.i + 1)),
{name} AS (SELECT source, arg_max(state, i) AS state, max(i) AS records, max(broken) AS broken_at FROM {name}_s GROUP BY 1)"""


ORACLES = {
    "replayed_logs": f"WITH RECURSIVE {_replay('a', 'true')} SELECT * FROM a",
    "replay_mismatches": f"""WITH RECURSIVE {_replay('a', 'true')}, {_replay('b', 'doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)')},
j AS (SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.source IS NULL THEN 'unsaved' WHEN a.source IS NULL THEN 'unlogged' ELSE concat_ws(',', CASE WHEN a.state <> b.state THEN 'state' END,
 CASE WHEN a.records <> b.records THEN 'records' END, CASE WHEN a.broken_at IS DISTINCT FROM b.broken_at THEN 'broken_at' END) END AS mismatches FROM a FULL JOIN b ON a.source = b.source)
SELECT * FROM j WHERE mismatches <> ''""",
    "merkle_digests": """WITH RECURSIVE l AS (SELECT source, coalesce(sha256(text), 'null') AS h, count(*) AS n FROM documents GROUP BY ALL),
r(source, deep, nodes, i, d) AS (SELECT source, 0, count(*) OVER (PARTITION BY source), row_number() OVER (PARTITION BY source ORDER BY h) - 1, h || ' ' || n FROM l
 UNION ALL SELECT source, deep + 1, (nodes + 15) // 16, i // 16, sha256(string_agg(d, chr(10) ORDER BY i)) FROM r WHERE deep = 0 OR nodes > 1 GROUP BY source, deep, nodes, i // 16)
SELECT source, max(nodes) AS items, arg_max(d, deep) AS digest FROM r GROUP BY source""",
    "length_quantiles": "SELECT source, count(text) AS n, median(length(text)) AS median, quantile_disc(length(text), 0.95)::BIGINT AS p95, quantile_disc(length(text), 0.999)::BIGINT AS p999 FROM documents GROUP BY 1",
    "instruction_blocks": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, string_split(text, chr(10)) AS parts FROM conversations),
b AS (SELECT conv_id, '$.instructions' AS location, 'system' AS role, arg_min(text, turn) AS text FROM t GROUP BY 1
 UNION ALL SELECT conv_id, '$.input[' || i || '].content', role, text FROM t WHERE role <> 'assistant' AND len(parts) = 1
 UNION ALL SELECT conv_id, '$.input[' || i || '].content[' || (j - 1) || ']', role, parts[j] FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM t WHERE role <> 'assistant' AND len(parts) > 1))
SELECT conv_id, location, role, strlen(text) AS bytes, sha256(text) AS sha256,
 coalesce(nullif(concat_ws(',', CASE WHEN contains(text, '?') THEN 'fixture:asks' END, CASE WHEN contains(text, 'wh') THEN 'fixture:which' END), ''), 'client_generated_or_unattributed') AS origins FROM b""",
}
