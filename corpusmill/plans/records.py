"""Retention, evaluation and audit queries over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import audit, evaluate, folds, rank, streams, validate, versions
from corpusmill.operators import output_search as searching
from corpusmill.plans.search import table

NOW = 1704200000  # a fixed clock for retention rules
GAP = 1800


def _seconds():
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", _seconds())


def lru_evict(spark, sf_dir):
    users = _events(spark, sf_dir).groupBy("user_id").agg(F.max("t").alias("last_seen"), F.sum(F.floor("value")).cast("long").alias("size"))
    users = users.withColumn("shard", F.col("user_id") % 16)
    out = versions.evict_until(users, "size", ["last_seen", "user_id"], 2000, ["shard"])
    return out.select("user_id", "shard", "last_seen", "size", "evicted")


def slot_evict(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("slot"), F.col("t").alias("created"), (F.floor("value") * 20000).cast("long").alias("bytes"))
    return streams.evicted_for_one_more(events, ["created", "event_id"], "slot").groupBy("slot", "evicted").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def reserved_budget(spark, sf_dir):
    events = _events(spark, sf_dir)
    return events.groupBy("user_id").agg(streams.reserved_bytes(F.floor("value").cast("long"), F.col("event_type") != "error").alias("bytes"))


def ttl_expire(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", streams.live(F.col("t"), F.lit(NOW)).alias("live"), F.greatest(F.col("t") + streams.LIVE - NOW, F.lit(0)).cast("long").alias("seconds_left"))


def stream_digest(spark, sf_dir):
    return streams.stream_digest(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def stream_pages(spark, sf_dir):
    return streams.pages(table(spark, sf_dir, "documents"), "doc_id", "text")


def captured_outputs(spark, sf_dir):
    """What capture makes of every conversation, its turns put together as the parts of one output."""
    return streams.capture_outcomes(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def head_tail_preview(spark, sf_dir):
    head, tail = streams.head_tail(F.col("raw"))
    return table(spark, sf_dir, "documents").withColumn("raw", F.col("text").cast("binary")).filter("raw IS NOT NULL").select("doc_id", F.sha2(head, 256).alias("head_sha256"), F.sha2(tail, 256).alias("tail_sha256"))


def page_cursors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 32).alias("handle"), F.col("n_chars").alias("offset"))
    made = docs.withColumn("cursor", streams.cursor(F.col("handle"), F.col("offset")))
    return made.select("doc_id", "cursor", streams.open_cursor(F.col("cursor"))["offset"].alias("offset"))


def output_regions(spark, sf_dir):
    return streams.stream_regions(table(spark, sf_dir, "documents"), "doc_id", "text").drop("body")


def _outputs(spark, sf_dir):
    return rank.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def output_rank(spark, sf_dir):
    """Ranked regions inside each stream: statistics are those of the stream alone."""
    found = searching.searched(_outputs(spark, sf_dir), "doc_id", "text", [["the"], ["license"]], ["license", "the"])
    return found.select("doc_id", "position", F.col("place").alias("rank"), "score")


def output_search(spark, sf_dir):
    """The best regions of each stream for a query with a phrase in it, quoted with exact ranges."""
    query = "cc-by license"
    found = searching.searched(_outputs(spark, sf_dir), "doc_id", "text", rank.query_phrases(spark, query, underscore=False), rank.query_terms(spark, query))
    return found.withColumn("excerpt_sha256", F.sha2("excerpt", 256)).drop("excerpt")


def idle_sessions(spark, sf_dir):
    return audit.sessions(_events(spark, sf_dir), "user_id", F.col("t"), GAP)


def _ranges(spark, sf_dir):
    start = (F.floor(F.col("value") * 10) + F.col("event_id") % 97).cast("long")
    return _events(spark, sf_dir).select("event_id", "user_id", start.alias("start"), (start + F.col("event_id") % 13).alias("end"))


def interval_merge(spark, sf_dir):
    return evaluate.merged_ranges(_ranges(spark, sf_dir), ["user_id"])


def overlap_metrics(spark, sf_dir):
    cited = evaluate.merged_ranges(_ranges(spark, sf_dir), ["user_id"])
    alternatives = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 400, 900)])).alias("start")).withColumn("end", F.col("start") + F.col("user_id") % 40)
    alternatives = alternatives.withColumn("group_id", F.concat_ws("-", F.lit("g"), "user_id"))
    shares = evaluate.group_overlaps(cited, alternatives, ["user_id"], "group_id")
    return shares.select("group_id", F.round("share", 6).alias("share"), (F.col("share") > 0).alias("hit"))


def region_recall(spark, sf_dir):
    return overlap_metrics(spark, sf_dir).agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("region_recall"), F.count("*").alias("groups"))


def file_metrics(spark, sf_dir):
    """Cited sources against accepted languages: precision over distinct cited names, invalid ones too."""
    docs = table(spark, sf_dir, "documents").withColumn("known", evaluate.valid_range(F.lit(1), F.col("n_chars") % 1000, F.col("n_chars")))
    per = docs.groupBy("lang").agg(F.count_distinct("source").alias("paths"), F.count_distinct(F.when(F.col("known") & F.col("source").isin("src1", "src2", "src3"), F.col("source"))).alias("matched"), F.count_if(~F.col("known")).alias("invalid_ranges"))
    return per.select("lang", "paths", "matched", "invalid_ranges", F.round(F.when(F.col("paths") == 0, 0.0).otherwise(F.col("matched") / F.col("paths")), 6).alias("file_precision"))


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def correctness_3vl(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("bucket", F.col("doc_id") % 500)
    return rows.groupBy("bucket").agg(evaluate.all_of(F.col("quality") == 1, F.col("toxic") == 1).alias("decision"))


def pair_deltas(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.count("*").alias("turns"))
    return evaluate.pair_rows(turns, ["conv_id"], "role", ["chars", "turns"], "assistant", "user")


def delta_extremes(spark, sf_dir):
    return pair_deltas(spark, sf_dir).groupBy((F.col("turns_delta")).alias("turns_delta")).agg(F.min("chars_delta").alias("least"), F.max("chars_delta").alias("most"), F.count("*").alias("n"))


def summary_grouping_sets(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("part", F.when(T.coin(F.col("doc_id").cast("string")) == 1, "development").otherwise("held_out")).withColumn("size", F.col("n_chars").cast("string"))
    return spark.sql("""SELECT part, lang, source, quality, count(*) AS n, count(DISTINCT doc_id) AS docs, count_if(toxic = 1) AS toxic, count_if(quality IS NULL) AS unlabelled
FROM {rows} GROUP BY GROUPING SETS ((part, lang), (part, source), (part, quality))""", rows=rows)


def null_poison_sum(spark, sf_dir):
    return _labelled(spark, sf_dir).withColumn("bucket", F.col("doc_id") % 300).groupBy("bucket").agg(T.null_poisoning_sum(F.col("quality")).alias("quality"), F.count("quality").alias("known"))


def seq_contiguity(spark, sf_dir):
    gaps = audit.gaps(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn").select(F.col("conv_id").alias("id"), "turn", "expected")
    events = audit.gaps(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id").select(F.col("user_id").alias("id"), F.col("event_id").alias("turn"), "expected")
    return gaps.withColumn("log", F.lit("conversations")).unionByName(events.withColumn("log", F.lit("events")))


def fallback_after_failure(spark, sf_dir):
    return audit.after_first_failure(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], F.col("event_type") == "error", F.col("event_type") == "click")


def dedup_conflict(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("props"))
    return audit.first_of_each(events, ["user_id", "event_type"], ["event_id"], F.col("props"))


def correlate_calls(spark, sf_dir):
    return audit.correlate(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["system", "user", "assistant"])


def ledger_replay(spark, sf_dir):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("created", "planned", "started", "reserved", "completed", "stopped")]), F.least(F.col("turn") + 1, F.lit(6)).cast("int"))
    return audit.replay(table(spark, sf_dir, "conversations").select("conv_id", "turn", kinds.alias("kind")), "conv_id", ["turn"], "kind")


def byte_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("bytes", F.octet_length("text"))
    return audit.within_budget(turns, ["conv_id"], ["turn"], "bytes", 1500).select("conv_id", "turn", F.coalesce("admitted", F.lit(False)).alias("admitted"))


def timings(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = folds.order_statistics(events, ["event_type"], "value", {"median": ("cont", 0.5), "p95": ("disc", 0.95), "most": ("disc", 1.0)})
    return found.select("event_type", F.round("median", 6).alias("median"), "p95", "most", "n")


def hash_coin(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", T.coin(F.concat_ws(":", F.lit("seed"), F.col("item_id").cast("string"), F.lit("1"))).alias("coin"))


def hash_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("doc_id", F.sha2(F.concat(F.lit("calibration-v1:"), F.col("doc_id").cast("string")), 256)).alias("chosen"))
    return docs.select("source", "chosen")


def plan_cross(spark, sf_dir):
    out = validate.trial_plan(table(spark, sf_dir, "benchmark"), "item_id", 2, ["control", "treatment"], "plan")
    return out.select("item_id", F.col("repetition").cast("long"), "configuration", F.when(F.col("place") == F.col("coin"), 1).otherwise(2).cast("long").alias("turn"))


def trial_rules(spark, sf_dir):
    rules = {
        "lang_known": F.col("lang").isin("en", "de", "fr"),
        "not_empty": F.col("n_chars") > 20,
        "labelled": F.col("quality").isNotNull(),
        "clean": F.col("toxic") == 0,
    }
    return _labelled(spark, sf_dir).select("doc_id", F.array_join(validate.violations(rules), ",").alias("broken"))


def unknown_references(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"))
    return validate.unknown_references(events, table(spark, sf_dir, "labels"), ["doc_id"]).select("event_id", "doc_id")


def repeated_contents(spark, sf_dir):
    return validate.repeated(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("identity")).filter("identity IS NOT NULL"), ["identity"])


def quota_changes(spark, sf_dir):
    rows = _labelled(spark, sf_dir).select("doc_id", evaluate.quota_change(F.col("quality"), F.col("toxic")).alias("q"))
    return rows.select("doc_id", F.col("q.change").alias("change"), F.array_join("q.reasons", ",").alias("reasons"))


def tree_digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    files = docs.select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), F.lit("100644").alias("mode"), T.blob_id(F.col("text").cast("binary")).alias("oid"))
    return validate.tree_digests(files, "path", "mode", "oid")


def skip_counts(spark, sf_dir):
    """Counts of a reason as one map, keys in order, beside their total."""
    rows = _labelled(spark, sf_dir).groupBy("source", F.coalesce(F.col("toxic").cast("string"), F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("reason", "n")))
    return rows.groupBy("source").agg(F.array_join(F.transform(entries, lambda e: F.concat(e["reason"], F.lit("="), e["n"])), ",").alias("reasons"), F.sum("n").alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        lru_evict, slot_evict, reserved_budget, ttl_expire, stream_digest, stream_pages, head_tail_preview, page_cursors, output_regions, output_rank, output_search,
        idle_sessions, interval_merge, overlap_metrics, region_recall, file_metrics, correctness_3vl, pair_deltas, delta_extremes, summary_grouping_sets,
        null_poison_sum, seq_contiguity, fallback_after_failure, dedup_conflict, captured_outputs, correlate_calls, ledger_replay, byte_budget, timings, hash_coin, hash_order,
        plan_cross, trial_rules, unknown_references, repeated_contents, quota_changes, tree_digest, skip_counts,
    )
}

_T = "epoch_us(ts) // 1000000"
_LABELLED = "SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)"
_RANGES = "ranges AS (SELECT event_id, user_id, (floor(value * 10) + event_id % 97)::BIGINT AS s, (floor(value * 10) + event_id % 97)::BIGINT + event_id % 13 AS e FROM events)"
_MERGED = f"""{_RANGES}, opened AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w + 1 THEN 1 ELSE 0 END AS new_ FROM ranges WINDOW w AS (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
islands AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM opened),
merged AS (SELECT user_id, min(s) AS s, max(e) AS e FROM islands GROUP BY user_id, island)"""
_OVERLAP = f"""{_MERGED}, alt AS (SELECT c_custkey AS user_id, unnest([0, 400, 900]) AS s FROM customer),
met AS (SELECT a.user_id, a.s, a.s + a.user_id % 40 AS e, sum(CASE WHEN m.s IS NULL THEN 0 ELSE greatest(0, least(m.e, a.s + a.user_id % 40) - greatest(m.s, a.s) + 1) END) AS n FROM alt a LEFT JOIN merged m USING (user_id) GROUP BY a.user_id, a.s),
shares AS (SELECT 'g-' || user_id AS group_id, max(n / (e - s + 1)) AS share FROM met GROUP BY user_id)"""
_PAIRS = """pairs AS (SELECT conv_id, max(chars) FILTER (role = 'assistant') - max(chars) FILTER (role = 'user') AS chars_delta, max(turns) FILTER (role = 'assistant') - max(turns) FILTER (role = 'user') AS turns_delta
FROM (SELECT conv_id, role, sum(length(text))::BIGINT AS chars, count(*) AS turns FROM conversations GROUP BY ALL) GROUP BY conv_id)"""
_COIN = "(('0x' || sha256({})[1:2])::INT % 2)"

ORACLES = {
    "lru_evict": f"""WITH u AS (SELECT user_id, user_id % 16 AS shard, max({_T}) AS last_seen, sum(floor(value))::BIGINT AS size FROM events GROUP BY user_id)
SELECT user_id, shard, last_seen, size, sum(size) OVER (PARTITION BY shard) - coalesce(sum(size) OVER (PARTITION BY shard ORDER BY last_seen, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 2000 AS evicted FROM u""",
    "slot_evict": f"""WITH e AS (SELECT event_id, event_type AS slot, {_T} AS created, (floor(value) * 20000)::BIGINT AS bytes FROM events),
r AS (SELECT *, NOT (count(*) OVER (PARTITION BY slot) - (row_number() OVER (PARTITION BY slot ORDER BY created, event_id) - 1) < 64
 AND sum(bytes) OVER (PARTITION BY slot) - coalesce(sum(bytes) OVER (PARTITION BY slot ORDER BY created, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 8388608 <= 33554432) AS evicted FROM e)
SELECT slot, evicted, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM r GROUP BY ALL""",
    "reserved_budget": "SELECT user_id, sum(CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT ELSE 8388608 END)::BIGINT AS bytes FROM events GROUP BY user_id",
    "ttl_expire": f"SELECT event_id, {_T} + 3600 > {NOW} AS live, greatest({_T} + 3600 - {NOW}, 0) AS seconds_left FROM events",
    "stream_digest": r"""WITH w AS (SELECT conv_id, count(*) AS parts, string_agg(coalesce(text, ''), '' ORDER BY turn) AS w, max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id)
SELECT conv_id, parts, strlen(w) AS bytes, CASE WHEN w = '' THEN 0 ELSE strlen(w) - strlen(replace(w, chr(10), '')) + CASE WHEN right(w, 1) = chr(10) THEN 0 ELSE 1 END END AS lines, sha256(w) AS digest, contiguous FROM w""",
    "head_tail_preview": "SELECT doc_id, sha256(unhex(hex(encode(text))[1:512])) AS head_sha256, sha256(unhex(right(hex(encode(text)), 512))) AS tail_sha256 FROM documents WHERE text IS NOT NULL",
    "page_cursors": "WITH c AS (SELECT doc_id, n_chars, '01' || sha256(doc_id::VARCHAR)[1:32] || lpad(lower(to_hex(n_chars)), 16, '0') AS b FROM documents) SELECT doc_id, b || sha256(b) AS cursor, n_chars AS offset FROM c",
    "idle_sessions": f"""WITH e AS (SELECT user_id, {_T} AS t FROM events), o AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < {GAP} THEN 0 ELSE 1 END AS n FROM e),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM o) SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM s GROUP BY user_id, s""",
    "interval_merge": f'WITH {_MERGED} SELECT user_id, s AS start, e AS "end" FROM merged',
    "overlap_metrics": f"WITH {_OVERLAP} SELECT group_id, round(share, 6) AS share, share > 0 AS hit FROM shares",
    "region_recall": f"WITH {_OVERLAP} SELECT round(avg(CASE WHEN share > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS region_recall, count(*) AS groups FROM shares",
    "file_metrics": """WITH d AS (SELECT *, coalesce(1 <= n_chars % 1000 AND n_chars % 1000 <= n_chars, false) AS known FROM documents)
SELECT lang, count(DISTINCT source) AS paths, count(DISTINCT source) FILTER (known AND source IN ('src1', 'src2', 'src3')) AS matched, count(*) FILTER (NOT known) AS invalid_ranges,
 round(count(DISTINCT source) FILTER (known AND source IN ('src1', 'src2', 'src3')) / count(DISTINCT source), 6) AS file_precision FROM d GROUP BY lang""",
    "correctness_3vl": f"SELECT doc_id % 500 AS bucket, CASE WHEN count(*) > count(quality) THEN 'unscored' WHEN bool_and(quality = 1) AND NOT coalesce(bool_or(toxic = 1), false) THEN 'pass' ELSE 'fail' END AS decision FROM ({_LABELLED}) GROUP BY 1",
    "pair_deltas": f"WITH {_PAIRS} SELECT * FROM pairs",
    "delta_extremes": f"WITH {_PAIRS} SELECT turns_delta, min(chars_delta) AS least, max(chars_delta) AS most, count(*) AS n FROM pairs GROUP BY 1",
    "summary_grouping_sets": f"""WITH r AS (SELECT *, CASE WHEN {_COIN.format('doc_id::VARCHAR')} = 1 THEN 'development' ELSE 'held_out' END AS part FROM ({_LABELLED}))
SELECT part, lang, source, quality, count(*) AS n, count(DISTINCT doc_id) AS docs, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality IS NULL) AS unlabelled FROM r GROUP BY GROUPING SETS ((part, lang), (part, source), (part, quality))""",
    "null_poison_sum": f"SELECT doc_id % 300 AS bucket, CASE WHEN count(*) = count(quality) THEN sum(quality)::BIGINT END AS quality, count(quality) AS known FROM ({_LABELLED}) GROUP BY 1",
    "seq_contiguity": """WITH r AS (SELECT 'conversations' AS log, conv_id AS id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS expected FROM conversations
UNION ALL SELECT 'events', user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) + 1 FROM events) SELECT log, id, turn, expected FROM r WHERE expected IS NOT NULL AND turn <> expected""",
    "fallback_after_failure": f"""WITH m AS (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY {_T}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events)
SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'click' AND seen = 1) AS later FROM m GROUP BY user_id HAVING failures > 0""",
    "dedup_conflict": "SELECT user_id, event_type, count(*) AS copies, count(DISTINCT props) AS variants, count(DISTINCT props) > 1 AS conflict, arg_min(props, event_id) AS payload FROM events GROUP BY ALL",
    "correlate_calls": """SELECT conv_id, count(*) FILTER (role = 'system') AS system, count(*) FILTER (role = 'user') AS user, count(*) FILTER (role = 'assistant') AS assistant,
 count(*) FILTER (role = 'system') = 1 AND count(*) FILTER (role = 'user') = 1 AND count(*) FILTER (role = 'assistant') = 1 AS complete FROM conversations GROUP BY conv_id""".replace(" AS user,", ' AS "user",'),
    "captured_outputs": """WITH w AS (SELECT conv_id, count(*) AS parts, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, coalesce(string_agg(text, '' ORDER BY turn, text), '') AS w FROM conversations GROUP BY conv_id),
o AS (SELECT *, CASE WHEN bytes > 8388608 THEN 'too_large' WHEN contains(w, chr(0)) THEN 'nul' END AS capture_error FROM w)
SELECT conv_id, parts, bytes, CASE WHEN capture_error IS NULL THEN length(w) - length(replace(w, chr(10), '')) + CASE WHEN w = '' OR ends_with(w, chr(10)) THEN 0 ELSE 1 END END AS lines,
 CASE WHEN capture_error IS NOT NULL THEN 'fallback' WHEN bytes > 4096 THEN 'stored' ELSE 'passed' END AS outcome, capture_error, CASE WHEN capture_error IS NULL THEN sha256(w) END AS digest FROM o""",
    "ledger_replay": """SELECT conv_id, CASE WHEN count(*) <> max(turn) + 1 OR min(turn) <> 0 OR count(DISTINCT turn) <> count(*) THEN 'invalid' WHEN max(turn) >= 6 THEN 'invalid'
 ELSE ['created', 'planned', 'started', 'reserved', 'started', 'stopped'][max(turn) + 1] END AS state FROM conversations GROUP BY conv_id""",
    "byte_budget": "SELECT conv_id, turn, coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 1500, false) AS admitted FROM conversations",
    "timings": "SELECT event_type, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most, count(*) AS n FROM events GROUP BY 1",
    "hash_coin": f"SELECT item_id, {_COIN.format(chr(39) + 'seed:' + chr(39) + ' || item_id || ' + chr(39) + ':1' + chr(39))} AS coin FROM benchmark",
    "hash_order": "SELECT source, arg_min(doc_id, sha256('calibration-v1:' || doc_id)) AS chosen FROM documents GROUP BY 1",
    "plan_cross": f"""WITH g AS (SELECT item_id, unnest([1, 2]) AS repetition FROM benchmark), t AS (SELECT *, {_COIN.format("'plan:' || item_id || ':' || repetition")} AS coin FROM g)
SELECT item_id, repetition::BIGINT AS repetition, c AS configuration, CASE WHEN (c = 'treatment')::INT = coin THEN 1 ELSE 2 END::BIGINT AS turn FROM t, (SELECT unnest(['control', 'treatment']) AS c)""",
    "trial_rules": f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN lang IN ('en', 'de', 'fr') THEN NULL ELSE 'lang_known' END, CASE WHEN n_chars > 20 THEN NULL ELSE 'not_empty' END, CASE WHEN quality IS NOT NULL THEN NULL ELSE 'labelled' END,
 CASE WHEN toxic = 0 THEN NULL ELSE 'clean' END], lambda x: x IS NOT NULL), ',') AS broken FROM ({_LABELLED})""",
    "unknown_references": "SELECT event_id, user_id AS doc_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.user_id)",
    "repeated_contents": "SELECT sha256(text) AS identity, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING n > 1",
    "quota_changes": f"""SELECT doc_id, quality - toxic AS change, array_to_string(list_filter([CASE WHEN quality IS NULL THEN 'before_unknown' END, CASE WHEN toxic IS NULL THEN 'after_unknown' END, CASE WHEN toxic > quality THEN 'increased' END],
 lambda x: x IS NOT NULL), ',') AS reasons FROM ({_LABELLED})""",
    "skip_counts": f"""WITH r AS (SELECT source, coalesce(toxic::VARCHAR, 'unknown') AS reason, count(*) AS n FROM ({_LABELLED}) GROUP BY ALL)
SELECT source, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons, sum(n)::BIGINT AS total FROM r GROUP BY source""",
    "tree_digest": """WITH f AS (SELECT source, lang, doc_id::VARCHAR AS name, sha1('blob '::BLOB || strlen(text)::VARCHAR::BLOB || '\x00'::BLOB || encode(text)) AS oid FROM documents WHERE text IS NOT NULL),
a AS (SELECT source, lang, string_agg(hex(encode('100644 ' || name)) || '00' || oid, '' ORDER BY encode(name)) AS h FROM f GROUP BY ALL),
la AS (SELECT source, lang, sha1(unhex(hex(encode('tree ' || strlen(h) // 2)) || '00' || h)) AS oid FROM a),
b AS (SELECT source, string_agg(hex(encode('40000 ' || lang)) || '00' || oid, '' ORDER BY encode(lang || '/')) AS h FROM la GROUP BY ALL),
lb AS (SELECT source, sha1(unhex(hex(encode('tree ' || strlen(h) // 2)) || '00' || h)) AS oid FROM b),
c AS (SELECT string_agg(hex(encode('40000 ' || source)) || '00' || oid, '' ORDER BY encode(source || '/')) AS h FROM lb)
SELECT source || '/' || lang AS path, oid FROM la UNION ALL SELECT source, oid FROM lb UNION ALL SELECT '', sha1(unhex(hex(encode('tree ' || strlen(h) // 2)) || '00' || h)) FROM c""",
}
