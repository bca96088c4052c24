"""Retained output streams: digests, pages, previews, retention and ranked search inside one stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import running

# Fixed values of the store: bytes of a page and of a chunk, entries, bytes in all, one reservation, seconds to live.
PAGE, CHUNK, ENTRIES, TOTAL, RESERVED, LIVE = 4096, 3584, 64, 32 << 20, 8 << 20, 3600
REGION_BYTES, REGION_LINES, BACK_LINES, BACK_BYTES, BACK_BLIND = 8192, 60, 6, 1024, 256
REGIONS, EXCERPT_BYTES, EXCERPT_LINES, BEFORE = 8192, 1000, 8, 256


def stream_digest(parts: DataFrame, handle: str, ordinal: str, content: str) -> DataFrame:
    """(handle, parts, bytes, lines, digest, contiguous) of streams put together in order.  A stream is bounded (8 MiB)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.coalesce(F.col(content), F.lit("")).alias("c"))))
    whole = F.array_join(F.transform("__p", lambda p: p["c"]), "")
    ends = F.octet_length("__w") - F.octet_length(F.replace(F.col("__w"), F.lit("\n"), F.lit("")))
    lines = F.when(F.col("__w") == "", 0).otherwise(ends + F.when(F.right("__w", F.lit(1)) == "\n", 0).otherwise(1))
    places = F.transform("__p", lambda p: p["o"].cast("long"))
    step = F.forall(F.sequence(F.lit(0), F.size("__p") - 1), lambda i: F.get(places, i) == F.get(places, F.lit(0)) + i)
    return (
        parts.groupBy(handle)
        .agg(ordered.alias("__p"))
        .withColumn("__w", whole)
        .select(handle, F.size("__p").cast("long").alias("parts"), F.octet_length("__w").cast("long").alias("bytes"), lines.cast("long").alias("lines"), F.sha2("__w", 256).alias("digest"), step.alias("contiguous"))
    )


def capture_outcomes(parts: DataFrame, handle: str, ordinal: str, content: str) -> DataFrame:
    """(handle, parts, bytes, lines, outcome, capture_error, digest): what capture makes of whole streams of binary parts.

    ``passed`` up to a page, ``stored`` above, else ``fallback`` with the first of too_large, nul and invalid_utf8 that
    holds.  Sizes are summed first, so a stream over the cap is never put together and its digest and lines are null;
    digests are for what was kept.  A null part counts and has no bytes.
    """
    raw = parts.select(handle, F.col(ordinal).alias("__o"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("__c"))
    sized = raw.groupBy(handle).agg(F.count("*").alias("parts"), F.sum(F.octet_length("__c")).alias("bytes"))
    large = sized.filter(F.col("bytes") > RESERVED)
    whole = raw.join(large.select(handle), handle, "left_anti").groupBy(handle).agg(F.count("*").alias("parts"), F.array_sort(F.collect_list(F.struct(F.col("__o"), F.hex("__c").alias("__h")))).alias("__p"))
    whole = whole.withColumn("__w", F.unhex(F.array_join(F.transform("__p", lambda p: p["__h"]), ""))).withColumn("__t", F.expr("try_validate_utf8(CAST(__w AS STRING))"))
    feeds = F.octet_length("__t") - F.octet_length(F.replace(F.col("__t"), F.lit("\n"), F.lit("")))
    lines = F.when(F.octet_length("__w") == 0, 0).otherwise(feeds + F.when(F.right("__t", F.lit(1)) == "\n", 0).otherwise(1))
    error = F.when(F.locate("\0", F.col("__w").cast("string")) > 0, "nul").when(F.col("__t").isNull(), "invalid_utf8")
    kept = whole.select(
        handle, "parts", F.octet_length("__w").cast("long").alias("bytes"), F.when(error.isNull(), lines.cast("long")).alias("lines"),
        F.when(error.isNotNull(), "fallback").when(F.octet_length("__w") > PAGE, "stored").otherwise("passed").alias("outcome"),
        error.alias("capture_error"), F.when(error.isNull(), F.sha2("__w", 256)).alias("digest"),
    )
    none = F.lit(None)
    return kept.unionByName(large.select(handle, "parts", "bytes", none.cast("long").alias("lines"), F.lit("fallback").alias("outcome"), F.lit("too_large").alias("capture_error"), none.cast("string").alias("digest")))


def page(content: bytes, offset: int) -> bytes:
    """One exact page: up to 4096 bytes, whole characters, cut after its last line end if it has one."""
    if offset < 0 or offset >= len(content):
        raise ValueError("the offset is outside the stream")
    if content[offset] & 0xC0 == 0x80:
        raise ValueError("the offset is inside a character")
    end = min(len(content), offset + PAGE)
    while end < len(content) and content[end] & 0xC0 == 0x80:
        end -= 1
    cut = content.rfind(b"\n", offset, end)
    end = cut + 1 if cut >= 0 else end
    if end <= offset:
        raise ValueError("a page must advance")
    return content[offset:end]


def pages(streams: DataFrame, handle: str, content: str) -> DataFrame:
    """(handle, page, offset, bytes, sha256): every page of every stream, from the first to the last."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            out = []
            for h, raw in zip(frame[handle], frame["__raw"]):
                at, n = 0, 0
                while raw is not None and at < len(raw):
                    p = page(raw, at)
                    out.append((h, n, at, len(p), hashlib.sha256(p).hexdigest()))
                    at, n = at + len(p), n + 1
            yield pd.DataFrame(out, columns=[handle, "page", "offset", "bytes", "sha256"])

    kind = dict(streams.dtypes)[handle]
    return streams.select(handle, F.col(content).cast("binary").alias("__raw")).mapInPandas(run, f"{handle} {kind}, page long, offset long, bytes long, sha256 string")


def chunks(streams: DataFrame, handle: str, content: str) -> DataFrame:
    """(handle, ordinal, chunk): a stream as rows of 3584 bytes to append; null and empty streams have none."""
    raw = F.col(content).cast("binary")
    count = F.ceil(F.octet_length(raw) / CHUNK).cast("int")
    dealt = streams.filter(count > 0).select(handle, raw.alias("__raw"), F.explode(F.sequence(F.lit(0), count - 1)).alias("ordinal"))
    return dealt.select(handle, F.col("ordinal").cast("long"), F.substring("__raw", F.col("ordinal") * CHUNK + 1, F.lit(CHUNK)).alias("chunk"))


def cursor(handle: Column, offset: Column, version: str = "01") -> Column:
    """An opaque place: version, handle, offset in hex, and the SHA-256 of these."""
    body = F.concat(F.lit(version), handle, F.lpad(F.lower(F.hex(offset)), 16, "0"))
    return F.concat(body, F.sha2(body, 256))


def open_cursor(text: Column) -> Column:
    """(handle, offset) of a cursor, null if its form or checksum is wrong."""
    body = F.substring(text, 1, 50)
    good = text.rlike("^01[0-9a-f]{112}$") & (F.substring(text, 51, 64) == F.sha2(body, 256))
    return F.when(good, F.struct(F.substring(text, 3, 32).alias("handle"), F.conv(F.substring(text, 35, 16), 16, 10).cast("long").alias("offset")))


def head_tail(content: Column, n: int = 256) -> tuple[Column, Column]:
    """The first and the last bytes of a binary stream."""
    return F.substring(content, 1, n), F.when(F.octet_length(content) > n, F.substring(content, -n, n)).otherwise(content)


def live(created: Column, now: Column, seconds: int = LIVE) -> Column:
    """Whether an entry is still to be read; reading does not prolong it."""
    return created + seconds > now


def reserved_bytes(bytes_: Column, committed: Column) -> Column:
    """Budget in use: bytes of committed entries, a whole reservation for the others."""
    return F.coalesce(F.sum(F.when(committed, bytes_).otherwise(F.lit(RESERVED))), F.lit(0)).cast("long")


def evicted_for_one_more(entries: DataFrame, order: list[str], slot: str) -> DataFrame:
    """Committed entries marked ``evicted`` so that one more reservation fits, oldest first, per slot."""
    totalled = running.ahead(entries, [slot], order, {"__count": F.lit(1), "__size": F.col("bytes")})
    left = F.col("__count_all") - F.col("__count_ahead")
    fits = (left < ENTRIES) & (F.col("__size_all") - F.col("__size_ahead") + RESERVED <= TOTAL)
    return totalled.select(*entries.columns, (~fits).alias("evicted"))


def regions(content: bytes) -> list[tuple[int, int, int]]:
    """Overlapping regions of a stream: (start, end, first line)."""
    whole = lambda at: at < len(content) and content[at] & 0xC0 == 0x80
    out, start, line = [], 0, 1
    while start < len(content):
        end = min(start + REGION_BYTES, len(content))
        while whole(end):
            end -= 1
        at = start
        for _ in range(REGION_LINES):
            at = content.find(b"\n", at, end) + 1
            if not at:
                break
        end = at or end
        out.append((start, end, line))
        if end == len(content):
            return out
        low = max(end - BACK_BYTES, start + 1)
        places = [i + 1 for i in range(low - 1, end - 1) if content[i] == 10][::-1]
        if places:
            nxt = places[min(BACK_LINES, len(places)) - 1]
        else:
            nxt = max(end - BACK_BLIND, start + 1)
            while whole(nxt):
                nxt += 1
        line += content.count(b"\n", start, nxt)
        start = nxt
    return out


def stream_regions(streams: DataFrame, handle: str, content: str) -> DataFrame:
    """(handle, position, start, end, first_line, body) of every stream's regions; too many are an error, never a part."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            out = []
            for h, raw in zip(frame[handle], frame["__raw"]):
                found = regions(raw or b"")
                if len(found) > REGIONS:
                    raise ValueError("the stream has too many regions to rank")
                out += [(h, i, s, e, line, raw[s:e].decode("utf-8", "replace")) for i, (s, e, line) in enumerate(found)]
            yield pd.DataFrame(out, columns=[handle, "position", "start", "end", "first_line", "body"])

    kind = dict(streams.dtypes)[handle]
    return streams.select(handle, F.col(content).cast("binary").alias("__raw")).mapInPandas(
        run, f"{handle} {kind}, position long, start long, end long, first_line long, body string"
    )


def stream_excerpt(body: str, terms: list[str]) -> tuple[int, int, bool, bool]:
    """(start, end, clipped before, clipped after) in bytes: 1000 bytes and 8 lines around the first best line's first term."""
    lines = body.splitlines(keepends=True) if "\r" not in body and not any(c in body for c in "\x0b\x0c\x1c\x1d\x1e\x85  ") else [x for x in body.replace("\n", "\n\0").split("\0") if x]
    counts = [sum(t in line.lower() for t in terms) for line in lines] or [0]
    best = counts.index(max(counts))
    before = sum(len(x) for x in lines[:best])
    at = 0
    if lines:
        lower, places = "", []
        for i, c in enumerate(lines[best]):
            places += [i] * len(c.lower())
            lower += c.lower()
        hits = [lower.find(t) for t in terms if t in lower]
        at = places[min(hits)] if hits else 0
    raw = body.encode()
    anchor = len(body[: before + at].encode())
    start = max(anchor - BEFORE, 0)
    while start < len(raw) and raw[start] & 0xC0 == 0x80:
        start += 1
    start = max(start, raw.rfind(b"\n", start, anchor) + 1)
    end = min(start + EXCERPT_BYTES, len(raw))
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    cut = start
    for _ in range(EXCERPT_LINES):
        cut = raw.find(b"\n", cut, end) + 1
        if not cut:
            break
    end = cut or end
    return start, end, start > 0, end < len(raw)
