"""Upkeep of the store and of reviews: refresh decisions, collection, appended chunks, run retention, returned ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import evaluate, publish, streams, versions
from corpusmill.plans.search import table


def refresh_actions(spark, sf_dir):
    """What a refresh does for each pair of snapshots."""
    n = F.col("event_id")
    text = lambda prefix, m: F.concat(F.lit(prefix), n % m)
    signature = lambda a, b: F.concat_ws(":", text("p", a), text("o", b))
    action = versions.refresh_action(F.when(n % 11 != 0, text("h", 3)), text("h", 4), F.when(n % 7 != 0, signature(2, 5)), signature(3, 2))
    return table(spark, sf_dir, "events").select("event_id", action.alias("action"))


def gc_collectable(spark, sf_dir):
    """Of the contents that nothing refers to, those whose time has come."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 1000).alias("created"), (F.col("doc_id") % 9 == 0).alias("dirty"))
    return versions.collectable(rows, F.lit(1000000)).select("doc_id")


def unblinded_reviews(spark, sf_dir):
    """Verdicts given under blind labels, back under their items."""
    items = table(spark, sf_dir, "benchmark")
    labels = publish.blind_labels(items, "item_id", "review")
    forms = labels.select("label", F.upper("label").alias("verdict"))
    return publish.unblinded(forms, labels, "item_id").select("item_id", "verdict")


def stream_chunks(spark, sf_dir):
    """Streams as the rows in which they are appended to the store."""
    long = table(spark, sf_dir, "documents").select("doc_id", F.repeat("text", F.lit(20)).alias("text"))
    return streams.chunks(long, "doc_id", "text").select("doc_id", "ordinal", F.octet_length("chunk").cast("long").alias("bytes"), F.sha2("chunk", 256).alias("sha256"))


def excerpt_digests(spark, sf_dir):
    """Digests of cited lines with their ends, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 3 + 1).cast("int").alias("start"))
    return docs.select("doc_id", evaluate.excerpt_digest(F.col("text"), F.col("start"), F.col("start") + 1).alias("digest"))


def run_retention(spark, sf_dir):
    """Runs that go before the next one starts: by age, then by number."""
    runs = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 4000).alias("created"))
    return versions.expired_runs(runs, "created", "event_id", 4100, 3000, 500, ["event_type"]).select("event_id", "expired")


def covered_claims(spark, sf_dir):
    """Whether a user's claims use exactly the event types that are required of that user."""
    events = table(spark, sf_dir, "events")
    sets = events.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 20, F.col("event_type"))).alias("required"), F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("used"))
    return sets.select("user_id", evaluate.same_set(F.col("required"), F.col("used")).alias("covered"))


def tool_ranges(spark, sf_dir):
    """Line ranges that the results of reading and searching tools show."""
    n = F.col("event_id")
    path, row = F.concat(F.lit("./d/"), F.col("user_id").cast("string")), lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    match = lambda kind, text: F.to_json(row(type=kind, data=row(path=row(text=path), lines=row(text=text), line_number=n, absolute_offset=n * 10)))
    lines = F.concat_ws("\n", match(F.lit("begin"), F.lit("x")), match(F.lit("match"), F.lit("é\r\nb\n")), match(F.lit("match"), F.lit(None).cast("string")))
    excerpts = F.to_json(row(results=F.array(row(path=path, snippet_start_line=n, snippet_end_line=n + 7))))
    content = F.when(n % 4 == 1, lines).otherwise(excerpts)
    result = row(path=path, start=n, end=n + 3, byte_start=n * 2, byte_end=n * 2 + 9, content=content, success=n % 3 != 0)
    tool = F.when(n % 4 == 0, "read").when(n % 4 == 1, "find").when(n % 4 == 2, "ranked").otherwise("other")
    calls = table(spark, sf_dir, "events").select("event_id", tool.alias("tool"), F.to_json(row(ok=n % 5 != 0, result=result)).alias("result"))
    shown = evaluate.returned_ranges(F.col("tool"), F.col("result"), "read", "find", "ranked")
    return calls.select("event_id", F.inline(shown))


def match_ranges(spark, sf_dir):
    """Line ranges of matches whose texts are the turns of conversations, with full stops and commas for line ends of strings."""
    turns = table(spark, sf_dir, "conversations")
    text = F.translate("text", ".,", "\u2028\f")
    data = F.struct(F.struct(F.concat(F.lit("./c/"), "conv_id").alias("text")).alias("path"), F.struct(text.alias("text")).alias("lines"), (F.col("turn") + 1).alias("line_number"), F.length("text").alias("absolute_offset"))
    event = F.to_json(F.struct(F.lit("match").alias("type"), data.alias("data")))
    result = F.to_json(F.struct(F.lit(True).alias("ok"), F.struct(event.alias("content")).alias("result")))
    shown = evaluate.returned_ranges(F.lit("find"), result, "read", "find", "ranked")
    return turns.select("conv_id", "turn", F.inline(shown)).select("conv_id", "turn", "path", "start", "end", "byte_start", "byte_end")


QUERIES = {f.__name__: f for f in (refresh_actions, gc_collectable, unblinded_reviews, stream_chunks, excerpt_digests, run_retention, covered_claims, tool_ranges, match_ranges)}

ORACLES = {
    "refresh_actions": """WITH s AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_id % 3 END AS h0, event_id % 4 AS h1,
 CASE WHEN event_id % 7 <> 0 THEN event_id % 2 END AS p0, event_id % 5 AS o0, event_id % 3 AS p1, event_id % 2 AS o1 FROM events)
SELECT event_id, CASE WHEN h0 = h1 AND p0 = p1 AND o0 = o1 THEN 'none' WHEN p0 IS DISTINCT FROM p1 THEN 'rescan' WHEN h0 IS DISTINCT FROM h1 THEN 'diff' ELSE 'overlay' END AS action FROM s""",
    "gc_collectable": "SELECT doc_id FROM documents WHERE doc_id % 9 = 0 OR doc_id * 1000 < 1000000 - 604800",
    "unblinded_reviews": "SELECT item_id, upper('r-' || sha256('review:' || item_id)[1:16]) AS verdict FROM benchmark",
    "stream_chunks": """WITH d AS (SELECT doc_id, encode(repeat(text, 20)) AS raw FROM documents WHERE text <> ''),
c AS (SELECT doc_id, raw, unnest(range((octet_length(raw) + 3583) // 3584)) AS ordinal FROM d)
SELECT doc_id, ordinal, octet_length(array_slice(raw, ordinal * 3584 + 1, ordinal * 3584 + 3584)) AS bytes, sha256(array_slice(raw, ordinal * 3584 + 1, ordinal * 3584 + 3584)) AS sha256 FROM c""",
    "excerpt_digests": r"""SELECT doc_id, sha256(array_to_string(list_slice(regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+'), doc_id % 3 + 1, doc_id % 3 + 2), '')) AS digest FROM documents""",
    "run_retention": """WITH r AS (SELECT event_id, event_id % 4000 AS created, count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY event_id % 4000, event_id) + 1 AS remaining FROM events)
SELECT event_id, 4100 - created >= 3000 OR remaining >= 500 AS expired FROM r""",
    "covered_claims": """WITH t AS (SELECT user_id, event_type, max(value > 20) AS needed, max(event_id % 3 = 0) AS used FROM events GROUP BY ALL)
SELECT user_id, bool_and(needed = used) AS covered FROM t GROUP BY user_id""",
    "match_ranges": rf"""WITH t AS (SELECT *, translate(text, '.,', chr(8232) || chr(12)) AS shown FROM conversations)
SELECT conv_id, turn, 'c/' || conv_id AS path, turn + 1 AS start, turn + greatest(len(regexp_extract_all(shown, '{evaluate.STRING_LINE}')), 1)::BIGINT AS "end", length(text) AS byte_start, length(text) + strlen(shown) AS byte_end
FROM t WHERE text IS NOT NULL""",
    "tool_ranges": """WITH e AS (SELECT event_id AS n, 'd/' || user_id AS p FROM events WHERE event_id % 5 <> 0)
SELECT n AS event_id, './' || p AS path, n AS start, n + 3 AS "end", n * 2 AS byte_start, n * 2 + 9 AS byte_end, false AS partial FROM e WHERE n % 4 = 0
UNION ALL SELECT n, p, n, n + 1, n * 10, n * 10 + 6, false FROM e WHERE n % 4 = 1
UNION ALL SELECT n, './' || p, n, n + 7, NULL, NULL, true FROM e WHERE n % 4 = 2 AND n % 3 <> 0""",
}
