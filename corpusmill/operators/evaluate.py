"""Retrieval metrics, pair deltas and grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_ranges(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Ranges with both ends inclusive, joined where they overlap or touch."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def shared_lines(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Length of the intersection of two inclusive ranges, none of their ends null."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b) + 1)


def valid_range(start: Column, end: Column, lines: Column) -> Column:
    """Whether a cited range lies in a known file; null lines stand for an unknown file."""
    return F.coalesce((start >= 1) & (start <= end) & (end <= lines), F.lit(False))


def group_overlaps(cited: DataFrame, alternatives: DataFrame, keys: list[str], group: str) -> DataFrame:
    """For each group of alternatives the largest share of one that merged ``cited`` ranges cover; 0 without any.

    Ranges meet only within equal ``keys``, where merged ranges do not overlap.
    """
    alt = alternatives.select(*keys, group, F.col("start").alias("__s"), F.col("end").alias("__e"))
    met = alt.join(cited, keys, "left")
    part = F.when(F.col("start").isNull(), 0).otherwise(shared_lines(F.col("start"), F.col("end"), F.col("__s"), F.col("__e")))
    covered = met.groupBy(*keys, group, "__s", "__e").agg((F.sum(part) / (F.col("__e") - F.col("__s") + 1)).alias("share"))
    return covered.groupBy(group).agg(F.max("share").alias("share"))


def all_of(judged: Column, contradicted: Column) -> Column:
    """A decision over a group's rows: any unknown leaves it unscored, even beside a false one."""
    unknown = F.count("*") > F.count(judged)
    return F.when(unknown | (F.count("*") == 0), "unscored").when(F.bool_and(judged) & ~F.coalesce(F.bool_or(contradicted), F.lit(False)), "pass").otherwise("fail")


def delta(treatment: Column, control: Column) -> Column:
    """Treatment minus control, null unless both are known."""
    return treatment - control


def pair_rows(trials: DataFrame, pair: list[str], configuration: str, measures: list[str], treatment: str, control: str) -> DataFrame:
    """One row a pair with the deltas of its measures; a missing side leaves nulls."""
    side = lambda m, c: F.max(F.when(F.col(configuration) == c, F.col(m)))
    return trials.groupBy(*pair).agg(*[delta(side(m, treatment), side(m, control)).alias(f"{m}_delta") for m in measures])


def quota_change(before: Column, after: Column) -> Column:
    """(change, reasons): before minus after, and why the change says nothing."""
    reasons = F.array_compact(
        F.array(
            F.when(before.isNull(), F.lit("before_unknown")),
            F.when(after.isNull(), F.lit("after_unknown")),
            F.when(after > before, F.lit("increased")),
        )
    )
    return F.struct((before - after).alias("change"), reasons.alias("reasons"))


def file_coverage(cited: DataFrame, alternatives: DataFrame, files: DataFrame, task: str) -> DataFrame:
    """One row a task: cited files against the accepted ones of its groups.

    ``cited`` (task, path, start, end), ``alternatives`` (task, group_id, required, path), ``files``
    (path, lines).  Paths of invalid ranges count for the precision; a file is hit only by a valid
    range.  Recall is over required groups, each hit by any of its alternatives; without paths or
    groups the figure is 0.
    """
    known = cited.join(files.select("path", "lines"), "path", "left").withColumn("__ok", valid_range(F.col("start"), F.col("end"), F.col("lines")))
    per_path = known.groupBy(task, "path").agg(F.bool_or("__ok").alias("__hit"), F.count_if(~F.col("__ok")).alias("__bad"))
    accepted = alternatives.groupBy(task, "path").agg(F.lit(True).alias("__accepted"))
    matched = F.count_if(F.col("__hit") & F.col("__accepted").isNotNull())
    paths = per_path.join(accepted, [task, "path"], "left").groupBy(task).agg(
        F.count("*").alias("distinct_paths"), F.count_if("__hit").alias("valid_files"), matched.alias("matched_files"), F.sum("__bad").alias("invalid_ranges")
    )
    groups = alternatives.filter("required").join(per_path.filter("__hit").select(task, "path", "__hit"), [task, "path"], "left")
    groups = groups.groupBy(task, "group_id").agg(F.coalesce(F.bool_or("__hit"), F.lit(False)).alias("__found"))
    groups = groups.groupBy(task).agg((F.count_if("__found") / F.count("*")).alias("file_recall"))
    counts = ["distinct_paths", "valid_files", "matched_files", "invalid_ranges"]
    out = alternatives.select(task).union(cited.select(task)).distinct().join(paths, task, "left").join(groups, task, "left").fillna(0, [*counts, "file_recall"])
    return out.withColumn("file_precision", F.when(F.col("distinct_paths") == 0, 0.0).otherwise(F.col("matched_files") / F.col("distinct_paths")))


def eligible(state: Column, answer: Column, invalid_ranges: Column, valid_files: Column) -> Column:
    """Whether a trial may be judged: completed, a valid answer, no invalid range and a valid file; null counts as not."""
    return F.coalesce((state == "completed") & (answer == "valid") & (invalid_ranges == 0) & (valid_files > 0), F.lit(False))


# Fixed value: minutes of a weekly window.
WEEKLY = 7 * 24 * 60


def usable(error: Column, value: Column, observed: Column, now: Column, fresh: int) -> Column:
    """Whether an observation may be used: no error, a value, and an age from 0 to ``fresh`` seconds."""
    return F.coalesce((F.coalesce(error, F.lit("")) == "") & value.isNotNull() & (now - observed).between(0, fresh), F.lit(False))


def quota_comparison(before: Column, after: Column, concurrent: Column, simulated: Column) -> Column:
    """(status, reasons, change, interpretation) of two observations (remaining, observed, reset) of a weekly quota.

    Without either observation the status is unavailable and the rest null.
    """
    change = before["remaining"] - after["remaining"]
    reset = before["reset"]
    crossing = (reset != after["reset"]) | (before["observed"] >= reset) | (after["observed"] >= reset)
    reasons = F.array_compact(
        F.array(
            F.when(simulated, F.lit("simulation_not_attributable")),
            F.when(crossing, F.lit("reset_crossing")),
            F.when(~concurrent.eqNullSafe(F.lit(False)), F.lit("concurrent_or_unknown_account_activity")),
            F.when(change < 0, F.lit("remaining_percentage_increased")),
        )
    )
    known = before.isNotNull() & after.isNotNull()
    said = F.when(change == 0, "no observable percentage-point change; not zero cost").otherwise("observed change only; no token or price conversion")
    return F.struct(
        F.when(~known, "unavailable").when(F.size(reasons) > 0, "not_comparable").otherwise("comparable").alias("status"),
        F.when(known, reasons).alias("reasons"), F.when(known, change).alias("change"), F.when(known, said).alias("interpretation"),
    )


def weekly_buckets(observations: DataFrame, key: str, buckets: str, now: Column, slack: int) -> DataFrame:
    """(key, bucket_id, slot, used_percent, resets_at, comparable_reset, valid): the weekly windows of bucket maps.

    ``buckets`` maps an id to a struct of ``primary`` and ``secondary`` windows (minutes, used,
    resets).  A window is valid with 0 to below 100 percent used and a reset to come; an unused
    one that resets a full window ahead, give or take ``slack`` seconds, compares as such.
    """
    by_bucket = observations.select(key, now.alias("__now"), F.explode(buckets).alias("bucket_id", "__slots"))
    slots = F.create_map(F.lit("primary"), F.col("__slots.primary"), F.lit("secondary"), F.col("__slots.secondary"))
    rows = by_bucket.select(key, "__now", "bucket_id", F.explode(slots).alias("slot", "w")).filter(F.col("w.minutes") == WEEKLY)
    used, resets = F.col("w.used"), F.col("w.resets")
    full = (used == 0) & (F.abs(resets - F.col("__now") - WEEKLY * 60) <= slack)
    valid = F.coalesce((used >= 0) & (used < 100) & (resets > F.col("__now")), F.lit(False))
    comparable = F.when(full, "zero_usage_full_window").otherwise(resets.cast("string"))
    return rows.select(key, "bucket_id", "slot", used.alias("used_percent"), resets.alias("resets_at"), comparable.alias("comparable_reset"), valid.alias("valid"))


def evidence_available(alternatives: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, available): whether any alternative of a group lies in an indexed path."""
    known = indexed.select("path").distinct().withColumn("__in", F.lit(True))
    return alternatives.join(known, "path", "left").groupBy(*keys).agg(F.coalesce(F.bool_or("__in"), F.lit(False)).alias("available"))


def identity_mismatches(planned: DataFrame, recorded: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, mismatches): records whose identity differs from the plan's, by field; unplanned and missing ones say so."""
    a = planned.select(key, F.struct(*fields).alias("__a"))
    b = recorded.select(key, F.struct(*fields).alias("__b"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), F.lit(f)) for f in fields]))
    found = F.when(F.col("__a").isNull(), F.array(F.lit("unplanned"))).when(F.col("__b").isNull(), F.array(F.lit("missing"))).otherwise(differs)
    return a.join(b, key, "full_outer").select(key, found.alias("mismatches")).filter(F.size("mismatches") > 0)


#: A line with its end: the ends are those of bytes, so a form feed or a line separator is not one.
_WITH_END = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"


def lines_with_ends(text: Column) -> Column:
    """The lines of a text, each with its own end."""
    return F.regexp_extract_all(text, F.lit(_WITH_END), F.lit(0))


#: The line ends of a string: those of bytes, the separators of pages, files, groups and records, and those of Unicode.
_STRING_ENDS = r"\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}"
STRING_LINE = rf"[^{_STRING_ENDS}]*(?:\r\n|[{_STRING_ENDS}])|[^{_STRING_ENDS}]+"


def string_lines(text: Column) -> Column:
    """How many lines a string has; a last line needs no end, an empty string has none."""
    return F.regexp_count(text, F.lit(STRING_LINE))


def excerpt_digest(text: Column, start: Column, end: Column) -> Column:
    """SHA-256 of the lines from ``start`` to ``end``, both counted from 1 and both inside, with their ends."""
    length = F.greatest(end - start + 1, F.lit(0))
    return F.sha2(F.array_join(F.slice(lines_with_ends(text), start, length), "").cast("binary"), 256)


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, however often and in whatever order."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


_RANGE = "array<struct<path string, start long, end long, byte_start long, byte_end long, partial boolean>>"
_EVENT = "type string, data struct<path struct<text string>, lines struct<text string>, line_number long, absolute_offset long>"


def returned_ranges(tool: Column, result: Column, read: str, text: str, ranked: str) -> Column:
    """The line ranges that a tool's JSON result shows: ``read`` gives one, ``text`` one a match event, ``ranked`` one an excerpt.

    Results that are not ``ok``, other tools and null results give none; a match without text of its path or lines is passed over.
    """
    value = F.from_json(result, "ok boolean, result struct<path string, start long, end long, byte_start long, byte_end long, content string, success boolean>")
    found, ok = value["result"], value["ok"]
    null = F.lit(None).cast("long")
    one = F.array(F.struct(found["path"], found["start"], found["end"], found["byte_start"], found["byte_end"], F.lit(False))).cast(_RANGE)
    events = F.transform(F.split(found["content"], "\n"), lambda line: F.from_json(line, _EVENT))
    told = lambda e: (e["type"] == "match") & e["data"]["path"]["text"].isNotNull() & e["data"]["lines"]["text"].isNotNull()

    def matched(e):
        data, body = e["data"], e["data"]["lines"]["text"]
        last = data["line_number"] + F.greatest(string_lines(body), F.lit(1)) - 1
        place = data["absolute_offset"]
        return F.struct(F.regexp_replace(data["path"]["text"], r"^\./", ""), data["line_number"], last, place, place + F.octet_length(body), F.lit(False))

    shown = F.from_json(found["content"], "results array<struct<path string, snippet_start_line long, snippet_end_line long>>")["results"]
    excerpts = F.transform(shown, lambda r: F.struct(r["path"], r["snippet_start_line"], r["snippet_end_line"], null, null, F.lit(True))).cast(_RANGE)
    out = F.when(tool == read, one).when(tool == text, F.transform(F.filter(events, told), matched).cast(_RANGE)).when((tool == ranked) & found["success"], excerpts)
    return F.coalesce(F.when(ok, out), F.array().cast(_RANGE))
