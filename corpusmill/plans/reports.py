"""Response, export and report queries over the corpus tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import publish
from corpusmill.plans.search import table


def json_response(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return publish.json_rows(docs, "doc_id").select("doc_id", publish.guarded(F.col("response")).alias("response"))


def rendered_results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") / 8).alias("score"))
    return publish.rendered(docs, "source", "score", "doc_id", "doc_id")


def safe_export(spark, sf_dir):
    return publish.allow_list(table(spark, sf_dir, "events"), {"event_id": "long", "event_type": "string", "value": "double"})


def checksum_manifest(spark, sf_dir):
    return publish.checksums(table(spark, sf_dir, "pages"), "page_id", "html")


def set_digests(spark, sf_dir):
    return publish.set_digest(table(spark, sf_dir, "documents"), ["source"], F.concat_ws(" ", "lang", F.coalesce(F.sha2("text", 256), F.lit("none"))))


def number_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", publish.number_text(F.col("quality").cast("long")).alias("shown"))


def exit_statuses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    signal = F.when(F.col("event_type") == "error", (F.col("event_id") % 15 + 1).cast("long"))
    return e.select("event_id", publish.exit_status((F.col("event_id") % 3).cast("long"), signal, F.col("value") > 90).cast("long").alias("status"))


def normalised_requests(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    shown = publish.normalised(F.col("url"), {r"\d+": "N", r"^https?://": "scheme:"})
    return pages.groupBy(F.sha2(shown, 256).alias("digest")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


def blind_review(spark, sf_dir):
    return publish.blind_labels(table(spark, sf_dir, "benchmark"), "item_id", "review")


def amended_tasks(spark, sf_dir):
    tasks = table(spark, sf_dir, "benchmark").select("item_id", "text", F.array(F.lit("own")).alias("alternatives"))
    changes = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("item_id"), F.lit("amended").alias("text"), F.array(F.lit("added")).alias("alternatives"))
    out = publish.amended(tasks, changes, "item_id", "text", "alternatives")
    return out.select("item_id", F.sha2("text", 256).alias("text_sha256"), F.array_join("alternatives", ",").alias("alternatives"))


def printable_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.printable(F.col("html")), 256).alias("shown_sha256"))


def table_statistics(spark, sf_dir):
    """Counts that a status request reports."""
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("files"), F.count_distinct(F.sha2("text", 256)).alias("contents"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    return docs.crossJoin(table(spark, sf_dir, "labels").agg(F.count_if(F.col("toxic") == 1).alias("overlays")))


def running_offsets(spark, sf_dir):
    """Byte and turn at which each part of a stream starts."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.coalesce(F.sum(F.octet_length("text")).over(order), F.lit(0)).cast("long").alias("offset"))


def first_and_rest(spark, sf_dir):
    """The first call of a user beside the others' count and median."""
    events = table(spark, sf_dir, "events")
    first = F.min_by("value", "event_id")
    ranked = events.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return ranked.groupBy("user_id").agg(first.alias("first"), F.count_if(F.col("n") > 1).alias("later"), F.round(F.median(F.when(F.col("n") > 1, F.col("value"))), 6).alias("later_median"))


def peaks(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("peak"), F.max_by("event_id", F.struct("value", F.col("event_id"))).alias("at"))


def next_allowed(spark, sf_dir):
    """Of each conversation the first turn that is not the assistant's: the next to be taken."""
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.min(F.when(F.col("role") != "assistant", F.col("turn"))).alias("next_turn"))


def answer_status(spark, sf_dir):
    """Whether a JSON answer is missing, oversized, malformed or valid."""
    props = F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("event_type") == "click", F.substring("props", 1, 4)).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", props.alias("answer"))
    parsed = F.try_parse_json("answer")
    status = F.when(F.col("answer").isNull(), "missing").when(F.octet_length("answer") > 9, "oversized").when(parsed.isNull(), "malformed").otherwise("valid")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def bucket_reconcile(spark, sf_dir):
    """Usage of each bucket before and after: both there and never falling."""
    events = table(spark, sf_dir, "events").withColumn("half", F.col("event_id") < 5000)
    use = lambda side: events.filter(side).groupBy("user_id").agg(F.max("value").alias("used"))
    before, after = use(F.col("half")).withColumnRenamed("used", "before"), use(~F.col("half")).withColumnRenamed("used", "after")
    both = before.join(after, "user_id", "full_outer")
    state = F.when(F.col("before").isNull() | F.col("after").isNull(), "unmatched").when(F.col("after") < F.col("before"), "fell").otherwise("kept")
    return both.select("user_id", "before", "after", state.alias("state"))


QUERIES = {
    f.__name__: f
    for f in (
        json_response, rendered_results, safe_export, checksum_manifest, set_digests, number_texts, exit_statuses, normalised_requests, blind_review,
        amended_tasks, printable_texts, table_statistics, running_offsets, first_and_rest, peaks, next_allowed, answer_status, bucket_reconcile,
    )
}

ORACLES = {
    "json_response": """SELECT doc_id, '{"doc_id":' || doc_id || coalesce(',"lang":"' || lang || '"', '') || coalesce(',"source":"' || source || '"', '') || coalesce(',"n_chars":' || n_chars, '') || '}' AS response FROM documents""",
    "rendered_results": "SELECT source, r AS rank, printf('%d. %s  %.6f', r, doc_id::VARCHAR, s) AS line FROM (SELECT source, doc_id, n_chars / 8 AS s, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents)",
    "safe_export": "SELECT event_id, event_type, value FROM events",
    "checksum_manifest": "SELECT page_id, sha256(html) || '  ' || page_id AS line FROM pages",
    "set_digests": "SELECT source, sha256(string_agg(x, chr(10) ORDER BY x)) AS digest FROM (SELECT source, lang || ' ' || coalesce(sha256(text), 'none') AS x FROM documents) GROUP BY source",
    "number_texts": "SELECT d.doc_id, coalesce(quality::VARCHAR, 'unknown') AS shown FROM documents d LEFT JOIN labels l USING (doc_id)",
    "exit_statuses": "SELECT event_id, CASE WHEN value > 90 THEN 124 WHEN event_type = 'error' THEN event_id % 15 + 129 ELSE event_id % 3 END AS status FROM events",
    "normalised_requests": r"SELECT sha256(regexp_replace(regexp_replace(url, '\d+', 'N', 'g'), '^https?://', 'scheme:')) AS digest, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1",
    "blind_review": "SELECT item_id, 'r-' || sha256('review:' || item_id)[1:16] AS label FROM benchmark",
    "amended_tasks": "SELECT item_id, sha256(CASE WHEN l.doc_id IS NULL THEN b.text ELSE 'amended' END) AS text_sha256, CASE WHEN l.doc_id IS NULL THEN 'own' ELSE 'own,added' END AS alternatives FROM benchmark b LEFT JOIN (SELECT * FROM labels WHERE quality = 0) l ON l.doc_id = b.item_id",
    "printable_texts": r"SELECT page_id, sha256(replace(replace(html, chr(9), '\u{9}'), chr(13), '\u{d}')) AS shown_sha256 FROM pages",
    "table_statistics": "SELECT count(*) AS files, count(DISTINCT sha256(text)) AS contents, sum(strlen(text))::BIGINT AS bytes, (SELECT count(*) FILTER (toxic = 1) FROM labels) AS overlays FROM documents",
    "running_offsets": "SELECT conv_id, turn, coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM conversations",
    "first_and_rest": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, max(value) FILTER (n = 1) AS first, count(*) FILTER (n > 1) AS later, round(median(value) FILTER (n > 1), 6) AS later_median FROM r GROUP BY user_id""",
    "peaks": "SELECT user_id, event_type, max(value) AS peak, max(event_id) FILTER (value = m) AS at FROM (SELECT *, max(value) OVER (PARTITION BY user_id, event_type) AS m FROM events) GROUP BY ALL",
    "next_allowed": "SELECT conv_id, min(turn) FILTER (role <> 'assistant') AS next_turn FROM conversations GROUP BY conv_id",
    "answer_status": """WITH r AS (SELECT CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN props[1:4] ELSE props END AS a FROM events)
SELECT CASE WHEN a IS NULL THEN 'missing' WHEN strlen(a) > 9 THEN 'oversized' WHEN NOT json_valid(a) THEN 'malformed' ELSE 'valid' END AS status, count(*) AS n FROM r GROUP BY 1""",
    "bucket_reconcile": """WITH b AS (SELECT user_id, max(value) AS before FROM events WHERE event_id < 5000 GROUP BY 1), a AS (SELECT user_id, max(value) AS after FROM events WHERE event_id >= 5000 GROUP BY 1)
SELECT user_id, before, after, CASE WHEN before IS NULL OR after IS NULL THEN 'unmatched' WHEN after < before THEN 'fell' ELSE 'kept' END AS state FROM b FULL JOIN a USING (user_id)""",
}
