"""Trial scoring over the corpus tables: file recall, eligibility, quotas, evidence and plan identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import evaluate
from corpusmill.plans.search import table

FRESH, SLACK = 300, 5  # fixed values: seconds an observation stays fresh; seconds a full window may be off
FIELDS = ["lang", "source", "n_chars", "quality", "toxic"]


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type").withColumn("t", F.col("event_id") * 37)


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id") % 30).alias("path"), F.lit(45).alias("lines")).distinct()


def _alternatives(spark, sf_dir):
    n = F.col("doc_id")
    columns = ((n % 25).alias("task"), F.concat(F.lit("g"), n % 4).alias("group_id"), (F.col("quality") == 1).alias("required"), F.concat(F.lit("f"), n % 37).alias("path"))
    return table(spark, sf_dir, "labels").select(*columns)


def file_recall(spark, sf_dir):
    """Precision and group-based recall of cited files, per task."""
    n = F.col("event_id")
    start = n % 50
    cited = _events(spark, sf_dir).select((n % 20).alias("task"), F.concat(F.lit("f"), n % 41).alias("path"), start.alias("start"), (start + n % 7).alias("end"))
    out = evaluate.file_coverage(cited, _alternatives(spark, sf_dir), _files(spark, sf_dir), "task")
    return out.withColumns({c: F.round(c, 6) for c in ("file_precision", "file_recall")})


def eligible_trials(spark, sf_dir):
    """Which trials may be judged."""
    n = F.col("event_id")
    state = F.when(F.col("event_type") == "error", F.lit(None)).when(n % 4 == 0, "failed").otherwise("completed")
    answer = F.when(n % 5 != 0, "valid").otherwise("invalid")
    return _events(spark, sf_dir).select("event_id", evaluate.eligible(state, answer, n % 3, n % 7).alias("eligible"))


def quota_comparisons(spark, sf_dir):
    """Weekly quotas before and after a trial, and why a change says nothing."""
    n, t = F.col("event_id"), F.col("t")
    reset = t + n % 6 * 50
    before = F.struct((n % 101).alias("remaining"), t.alias("observed"), reset.alias("reset"))
    after = F.struct((n % 97).alias("remaining"), (t + n % 90).alias("observed"), (reset + F.when(n % 11 == 0, 1).otherwise(0)).alias("reset"))
    busy = F.when(n % 7 == 0, True).when(n % 8 != 0, False)
    compared = evaluate.quota_comparison(before, F.when(n % 9 != 0, after), busy, n % 10 == 0)
    rows = _events(spark, sf_dir).select("event_id", compared.alias("q"))
    return rows.select("event_id", "q.status", F.array_join("q.reasons", ",").alias("reasons"), "q.change", "q.interpretation")


def weekly_windows(spark, sf_dir):
    """The weekly windows of quota observations, with the reset that counts in a comparison."""
    n, t = F.col("event_id"), F.col("t")
    window = lambda minutes, used, resets: F.struct(F.lit(minutes).alias("minutes"), used.alias("used"), resets.alias("resets"))
    full = t + evaluate.WEEKLY * 60
    a = F.struct(window(evaluate.WEEKLY, n % 104, t + n % 13 * 60).alias("primary"), window(300, n % 100, t + 60).alias("secondary"))
    b = F.struct(F.when(n % 2 == 0, window(evaluate.WEEKLY, n % 3, full)).alias("primary"), window(evaluate.WEEKLY, n % 4, full + n % 12).alias("secondary"))
    rows = _events(spark, sf_dir).withColumn("buckets", F.create_map(F.lit("a"), a, F.lit("b"), b))
    return evaluate.weekly_buckets(rows, "event_id", "buckets", t, SLACK)


def fresh_observations(spark, sf_dir):
    """Which observations may still be used."""
    n = F.col("event_id")
    usable = evaluate.usable(F.when(n % 6 == 0, "failed"), F.when(n % 7 != 0, n), F.col("t"), F.col("t") + n % 450 - 50, FRESH)
    return _events(spark, sf_dir).select("event_id", usable.alias("usable"))


def indexed_evidence(spark, sf_dir):
    """Evidence groups of which an alternative is indexed."""
    return evaluate.evidence_available(_alternatives(spark, sf_dir), _files(spark, sf_dir), ["task", "group_id"])


def plan_identity(spark, sf_dir):
    """Records that differ from their plan, by field."""
    planned = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("doc_id")
    changed = {"lang": F.when(n % 10 == 0, "xx").otherwise(F.col("lang")), "toxic": F.when(n % 12 != 0, F.col("toxic")), "doc_id": F.when(n % 17 == 0, -n).otherwise(n)}
    recorded = planned.filter(n % 13 != 0).withColumns(changed)
    found = evaluate.identity_mismatches(planned, recorded, "doc_id", FIELDS)
    return found.select("doc_id", F.array_join("mismatches", ",").alias("mismatches"))


QUERIES = {f.__name__: f for f in (file_recall, eligible_trials, quota_comparisons, weekly_windows, fresh_observations, indexed_evidence, plan_identity)}

_ALT = "alt AS (SELECT doc_id % 25 AS task, 'g' || doc_id % 4 AS group_id, quality = 1 AS required, 'f' || doc_id % 37 AS path FROM labels), known AS (SELECT DISTINCT 'f' || doc_id % 30 AS path, 45 AS lines FROM documents)"

ORACLES = {
    "file_recall": f"""WITH {_ALT}, cited AS (SELECT event_id % 20 AS task, 'f' || event_id % 41 AS path, event_id % 50 AS s, event_id % 50 + event_id % 7 AS e FROM events),
c AS (SELECT task, path, coalesce(s >= 1 AND s <= e AND e <= lines, false) AS ok FROM cited LEFT JOIN known USING (path)),
good AS (SELECT DISTINCT task, path FROM c WHERE ok),
p AS (SELECT task, count(DISTINCT path) AS distinct_paths, count(DISTINCT CASE WHEN ok THEN path END) AS valid_files, count(*) FILTER (NOT ok) AS invalid_ranges,
 count(DISTINCT CASE WHEN ok AND (task, path) IN (SELECT (task, path) FROM alt) THEN path END) AS matched_files FROM c GROUP BY task),
g AS (SELECT task, avg(hit::INT) AS recall FROM (SELECT a.task, group_id, bool_or(good.path IS NOT NULL) AS hit FROM alt a LEFT JOIN good USING (task, path) WHERE required GROUP BY ALL) GROUP BY task)
SELECT task, coalesce(distinct_paths, 0) AS distinct_paths, coalesce(valid_files, 0) AS valid_files, coalesce(matched_files, 0) AS matched_files, coalesce(invalid_ranges, 0) AS invalid_ranges,
 round(coalesce(recall, 0), 6) AS file_recall, round(coalesce(matched_files / distinct_paths, 0), 6) AS file_precision
FROM (SELECT DISTINCT task FROM alt UNION SELECT task FROM cited) LEFT JOIN p USING (task) LEFT JOIN g USING (task)""",
    "eligible_trials": "SELECT event_id, event_type <> 'error' AND event_id % 4 <> 0 AND event_id % 5 <> 0 AND event_id % 3 = 0 AND event_id % 7 > 0 AS eligible FROM events",
    "quota_comparisons": """WITH q AS (SELECT event_id AS n, event_id * 37 AS t, event_id * 37 + event_id % 6 * 50 AS r, event_id % 101 - event_id % 97 AS ch, event_id % 9 <> 0 AS k FROM events),
s AS (SELECT *, concat_ws(',', CASE WHEN n % 10 = 0 THEN 'simulation_not_attributable' END, CASE WHEN n % 11 = 0 OR t >= r OR t + n % 90 >= r THEN 'reset_crossing' END,
 CASE WHEN n % 7 = 0 OR n % 8 = 0 THEN 'concurrent_or_unknown_account_activity' END, CASE WHEN ch < 0 THEN 'remaining_percentage_increased' END) AS why FROM q)
SELECT n AS event_id, CASE WHEN NOT k THEN 'unavailable' WHEN why <> '' THEN 'not_comparable' ELSE 'comparable' END AS status, CASE WHEN k THEN why END AS reasons, CASE WHEN k THEN ch END AS change,
 CASE WHEN k THEN CASE WHEN ch = 0 THEN 'no observable percentage-point change; not zero cost' ELSE 'observed change only; no token or price conversion' END END AS interpretation FROM s""",
    "weekly_windows": """WITH e AS (SELECT event_id AS n, event_id * 37 AS t FROM events),
w AS (SELECT n, t, 'a' AS bucket_id, 'primary' AS slot, n % 104 AS used, t + n % 13 * 60 AS resets FROM e UNION ALL SELECT n, t, 'b', 'primary', n % 3, t + 604800 FROM e WHERE n % 2 = 0 UNION ALL SELECT n, t, 'b', 'secondary', n % 4, t + 604800 + n % 12 FROM e)
SELECT n AS event_id, bucket_id, slot, used AS used_percent, resets AS resets_at, CASE WHEN used = 0 AND abs(resets - t - 604800) <= 5 THEN 'zero_usage_full_window' ELSE resets::VARCHAR END AS comparable_reset, used < 100 AND resets > t AS valid FROM w""",
    "fresh_observations": "SELECT event_id, event_id % 6 <> 0 AND event_id % 7 <> 0 AND event_id % 450 - 50 BETWEEN 0 AND 300 AS usable FROM events",
    "indexed_evidence": f"WITH {_ALT} SELECT task, group_id, bool_or(path IN (SELECT path FROM known)) AS available FROM alt GROUP BY ALL",
    "plan_identity": """WITH p AS (SELECT l.doc_id, lang, toxic FROM labels l JOIN documents USING (doc_id)),
r AS (SELECT CASE WHEN doc_id % 17 = 0 THEN -doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 12 <> 0 THEN toxic END AS toxic FROM p WHERE doc_id % 13 <> 0),
j AS (SELECT coalesce(p.doc_id, r.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'unplanned' WHEN r.doc_id IS NULL THEN 'missing'
 ELSE concat_ws(',', CASE WHEN p.lang IS DISTINCT FROM r.lang THEN 'lang' END, CASE WHEN p.toxic IS DISTINCT FROM r.toxic THEN 'toxic' END) END AS mismatches FROM p FULL JOIN r ON p.doc_id = r.doc_id)
SELECT * FROM j WHERE mismatches <> ''""",
}
