"""An index of immutable segments that a change set refreshes at the cost of what changed.

A segment holds the contents that came with one change set and were not stored before:
``chunks`` (doc, identity, chunk_id, start_line, end_line, symbol, body), ``contents`` (identity, chunks, tokens), new
``paths`` (doc, path_id, path), and the postings of chunks and of paths; further the change set's own rows of the view (``view``: path_id,
path, identity; null identity: deleted) and of what it left unreferenced or took up again (``dead``: identity, dead).
One small row of totals (``totals``) gives a segment's statistics; those of the index are their
sum, less what is dead, so no refresh reads a stored text.

Postings are blocks: a task that tokenizes a stretch of chunks writes one row a term
(field, term, docs, lens, places), so an index has a row for each term and stretch, not for each term and chunk; they lie
sorted by term with a Bloom filter for each row group, and a search reads the row groups of its terms.

Versions are pointers (``publish.VersionedTable``): a refresh that finds another version than it started from
publishes nothing, and readers keep the version they opened.  Neighbouring segments are merged when
the older is not much larger than all newer ones together, so a row is rewritten a logarithmic number of times;
merging unites stored blocks and drops what is dead without tokenizing anything again.

Defined results: changes without ``path_id`` are left out; of two changes of one path in a set the one of the larger
content identity counts, and a content beats a deletion; a null text deletes the path; an empty text is a content without chunks; an empty change set adds an empty segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import words
from corpusmill.operators import chunking, index, publish, rank, syntax

BLOCK = 4 << 20  # characters tokenized before a block is written
PIECES = 16  # tasks that the blocks of one term are dealt over, whatever their number
RATIO = 4  # an older segment this many times the newer ones together stays out of a merge

_POSTINGS = pa.schema(
    [("field", pa.string()), ("term", pa.string()), ("docs", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("places", pa.list_(pa.list_(pa.int32())))]
)
_POSTINGS_DDL = "field string, term string, docs array<long>, lens array<int>, places array<array<int>>"


def _block(fields: list[str], docs: list[int], texts: list[list[str | None]], known: words.Vocabulary) -> pa.RecordBatch:
    """The postings of one stretch of rows."""
    sequences = [[known.sequence(x) for x in column] for column in texts]
    lens = np.sum([[len(s) for s in column] for column in sequences], axis=0, dtype=np.int32)
    out: list[list] = [[], [], [], [], []]
    for name, column in zip(fields, sequences):
        sizes = np.fromiter(map(len, column), np.int64, len(column))
        terms = np.concatenate(column) if column else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(column), dtype=np.int32), sizes)
        place = (np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        order = np.argsort(terms, kind="stable")
        terms, row, place = terms[order], row[order], place[order]
        fresh_term = np.flatnonzero(np.diff(terms, prepend=-1))
        fresh_row = np.flatnonzero((np.diff(terms, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        rows_of_term = np.diff(np.searchsorted(fresh_row, np.append(fresh_term, len(terms))))
        hits = row[fresh_row]
        out[0].append(pa.array([name] * len(fresh_term), pa.string()))
        out[1].append(pa.array([known.terms[t] for t in terms[fresh_term]], pa.string()))
        out[2].append(words.nested(np.asarray(docs, np.int64)[hits], rows_of_term))
        out[3].append(words.nested(lens[hits], rows_of_term))
        out[4].append(words.nested(place, np.diff(np.append(fresh_row, len(terms))), rows_of_term))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in out], schema=_POSTINGS)


def block_postings(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, term, docs, lens, places): postings of ``rows`` (doc and text columns), block by block of each task."""
    names = list(fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.Vocabulary()
        docs: list[int] = []
        texts: list[list] = [[] for _ in names]
        size = 0
        for b in parts:
            for k in range(len(b)):
                docs.append(b.column(0)[k].as_py())
                for i in range(len(names)):
                    value = b.column(i + 1)[k].as_py()
                    texts[i].append(value)
                    size += len(value or "")
                if size >= BLOCK:
                    yield _block(names, docs, texts, known)
                    docs, texts, size = [], [[] for _ in names], 0
                    known.trim()
        if docs:
            yield _block(names, docs, texts, known)

    return rows.select("doc", *fields.values()).mapInArrow(run, _POSTINGS_DDL)


def _by_term(blocks: DataFrame) -> DataFrame:
    """Blocks in the order they are stored in: by hash, as ranges would tokenize everything once more to find their bounds."""
    return blocks.repartition(F.col("term"), F.pmod(F.xxhash64("docs"), F.lit(PIECES))).sortWithinPartitions("term")


def opened(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """(doc, field, term, places, len) of the stored blocks of ``terms``."""
    hit = blocks.filter(F.col("term").isin(terms)).select("field", "term", F.explode(F.arrays_zip("docs", "lens", "places")).alias("p"))
    return hit.select(F.col("p.docs").alias("doc"), "field", "term", F.col("p.places").alias("places"), F.col("p.lens").cast("long").alias("len"))


def _latest(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """The row of the newest segment for each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "segment").alias("x")).select(key, *[F.col(f"x.{v}").alias(v) for v in values])


class Segments:
    """One version of a segmented index; ``live`` leaves contents that no path has out of results and statistics."""

    TABLES = {
        "chunks": "doc long, identity string, chunk_id string, start_line int, end_line int, symbol string, body string",
        "contents": "identity string, chunks long, tokens long",
        "paths": "doc long, path_id long, path string",
        "view": "path_id long, path string, identity string",
        "dead": "identity string, dead boolean",
        "chunk_blocks": _POSTINGS_DDL,
        "path_blocks": _POSTINGS_DDL,
        "totals": "chunks long, tokens long, paths long, path_tokens long, contents long, entries long",
    }

    def __init__(self, spark: SparkSession, root: str, live: bool = True, version: int | None = None):
        self.spark, self.root, self.live = spark, root.rstrip("/"), live
        self.pointers = publish.VersionedTable(spark, root)
        self.version = self.pointers.current() if version is None else version
        about = self.pointers.about(self.version)
        self.segments, self.next, self.batch = about.get("segments", []), about.get("next", 0), about.get("batch", -1)

    def _of(self, name: str, segments: list[dict]) -> DataFrame:
        """A table of some segments, with the place of the segment in the index."""
        read = self.spark.read.schema(self.TABLES[name])
        parts = [read.parquet(f"{self.root}/{s['folder']}/{name}").withColumn("segment", F.lit(k)) for k, s in enumerate(segments)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.TABLES[name] + ", segment int")

    def table(self, name: str) -> DataFrame:
        return self._of(name, self.segments)

    def view(self) -> DataFrame:
        """(path_id, path, identity) of the active files: rows of the first segment that no later one touched, and the newest of the others."""
        if not self.segments:
            return self.table("view").drop("segment")
        later = self.table("view").filter("segment > 0")
        first = self.table("view").filter("segment = 0").drop("segment").join(later.select("path_id").distinct(), "path_id", "left_anti")
        return first.unionByName(_latest(later, "path_id", "path", "identity")).filter("identity IS NOT NULL")

    def dead(self) -> DataFrame:
        """Identities of stored contents that no active file has."""
        return _latest(self.table("dead"), "identity", "dead").filter("dead").select("identity")

    def _alive(self, chunks: DataFrame) -> DataFrame:
        return chunks.join(self.dead(), "identity", "left_anti") if self.live else chunks

    def statistics(self) -> DataFrame:
        """One row: (contents, chunks, tokens, paths, path_tokens), from one row a segment and the contents that are dead."""
        stored = self.table("totals").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("contents", "chunks", "tokens", "paths", "path_tokens")])
        if not self.live:
            return stored
        gone = self.table("contents").join(self.dead(), "identity", "left_semi")
        gone = gone.agg(F.count("*").alias("x"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"gone_{c}") for c in ("chunks", "tokens")])
        less = [(F.col("contents") - F.col("x")).alias("contents")] + [(F.col(c) - F.col(f"gone_{c}")).alias(c) for c in ("chunks", "tokens")]
        return stored.crossJoin(F.broadcast(gone)).select(*less, "paths", "path_tokens")

    # search

    def chunk_scores(self, phrases: list[list[str]]) -> DataFrame:
        """(doc, identity, chunk_id, start_line, score) of the chunks that hold a phrase."""
        terms = sorted({t for p in phrases for t in p})
        named = self._alive(self.table("chunks").select("doc", "identity", "chunk_id", "start_line"))
        hits = opened(self.table("chunk_blocks"), terms)
        hits = hits.join(named.select("doc"), "doc", "left_semi") if self.live else hits
        stats = self.statistics().select(F.col("chunks").alias("n_rows"), F.col("tokens").alias("total"))
        return index.phrase_bm25(hits, stats, "doc", phrases, index.CHUNK_WEIGHTS).join(named, "doc")

    def path_scores(self, phrases: list[list[str]]) -> DataFrame:
        """(path_id, path, score) of the stored paths that hold a phrase."""
        terms = sorted({t for p in phrases for t in p})
        stats = self.statistics().select(F.col("paths").alias("n_rows"), F.col("path_tokens").alias("total"))
        scored = index.phrase_bm25(opened(self.table("path_blocks"), terms), stats, "doc", phrases, index.PATH_WEIGHTS)
        return scored.join(self.table("paths").select("doc", "path_id", "path"), "doc").drop("doc")

    def candidates(self, phrases: list[list[str]]) -> DataFrame:
        """(path_id, path, doc, identity, start_line, score): chunk and path scores added up over the active files."""
        columns = ("path_id", "path", "doc", "identity", "start_line")
        by_chunk = self.chunk_scores(phrases).join(self.view(), "identity").select(*columns, "score")
        return by_chunk.unionByName(self.path_candidates(phrases)).groupBy(*columns).agg(F.sum("score").alias("score"))

    def path_candidates(self, phrases: list[list[str]]) -> DataFrame:
        """(path_id, path, doc, identity, start_line, score): a path's score goes to every chunk of its active content."""
        places = self.table("chunks").select("doc", "identity", "start_line")
        found = self.path_scores(phrases).drop("path").join(self.view(), "path_id").join(places, "identity")
        return found.select("path_id", "path", "doc", "identity", "start_line", "score")

    def search(self, query: str, k: int = 5) -> DataFrame:
        """The k best chunks of the active files, with excerpts, in their final places.

        The cut goes by score, then path number and line; the places go by score, then path and
        line.  Bodies are read for the k rows that are left only.
        """
        scored = self.candidates(rank.query_phrases(self.spark, query)).withColumn("score", F.round("score", 6))
        best = F.broadcast(rank.top(scored, k, "path_id", "start_line").select("path_id", "path", "doc", "score"))
        shown = rank.excerpt(self.table("chunks").join(best, "doc"), "body", rank.query_terms(self.spark, query), "start_line")
        placed = shown.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "path", "start_line")))
        return placed.select(
            "place", "path", "start_line", "end_line", "symbol", F.col("excerpt").alias("content"), F.col("excerpt_start").alias("snippet_start_line"),
            F.col("excerpt_end").alias("snippet_end_line"), "truncated", F.col("identity").alias("content_identity"), "score",
        )

    # upkeep

    def _write(self, name: str, df: DataFrame, folder: str) -> DataFrame:
        columns = [c.split()[0] for c in self.TABLES[name].split(", ")]
        writer = df.select(*columns).write
        if name.endswith("_blocks"):
            writer = writer.option("parquet.bloom.filter.enabled#term", "true")  # row groups without a term are skipped
        writer.parquet(f"{self.root}/{folder}/{name}")
        return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.root}/{folder}/{name}")

    def _finish(self, folder: str, contents: DataFrame, paths_tokens: DataFrame, entries: int) -> dict:
        """Totals of a segment whose tables are written, and its place in the next version."""
        sums = contents.agg(F.count("*").alias("contents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        self._write("totals", sums.crossJoin(F.broadcast(paths_tokens)).withColumn("entries", F.lit(entries).cast("long")), folder)
        return {"folder": folder, "entries": entries}

    def _commit(self, segments: list[dict], batch: int) -> Segments | None:
        about = {"segments": segments, "next": self.next + 1, "batch": batch}
        return Segments(self.spark, self.root, self.live) if self.pointers.point(about, self.version) else None

    def _numbered(self, df: DataFrame) -> DataFrame:
        """A number for every row that no other segment gives out: of the segment, the task, and the row in it; written at once, so it stays."""
        made = F.monotonically_increasing_id()
        task, row = F.shiftright(made, 33), made.bitwiseAND(F.lit((1 << 33) - 1))
        fits = (task < 1 << 20) & (row < 1 << 24)
        number = F.lit(self.next << 44) + F.shiftleft(task, 24) + row
        return df.withColumn("doc", F.when(fits, number).otherwise(F.raise_error(F.lit("too many rows for one task of a refresh"))))

    def refresh(self, changes: DataFrame, batch: int | None = None) -> Segments | None:
        """The next version, with ``changes`` (path_id, path, text; null text: deleted) in one more segment; none if another refresh came first.

        Reads the changes, and of the stored tables only names: of contents, of paths and of the view.
        A numbered ``batch`` that is in the index already, as when a stream runs it again, changes nothing.
        """
        if batch is not None and batch <= self.batch:
            return self
        folder = f"segment-{uuid.uuid4().hex}"
        rows = changes.filter("path_id IS NOT NULL").select(F.col("path_id").cast("long").alias("path_id"), "path", syntax.parsed_identity(index.identity(F.col("text")), F.col("path")).alias("identity"))
        rows = rows.groupBy("path_id").agg(F.max_by(F.struct("path", "identity"), F.coalesce("identity", F.lit(""))).alias("x")).select("path_id", "x.path", "x.identity")
        rows = self._write("view", rows, folder)
        named = rows.select("identity").filter("identity IS NOT NULL").distinct()
        known = self.table("contents").select("identity").join(named, "identity", "left_semi")
        missing = named.join(known, "identity", "left_anti")
        texts = changes.filter("text IS NOT NULL").select(syntax.parsed_identity(index.identity(F.col("text")), F.col("path")).alias("identity"), "text")
        texts = texts.join(missing, "identity", "left_semi").groupBy("identity").agg(F.any_value("text").alias("text")).withColumn("parser", F.get(F.split("identity", ":"), F.lit(1)))
        plain = chunking.line_windows(texts.filter("parser IS NULL"), "identity", "text").withColumn("symbol", F.lit(None).cast("string"))
        scripts = syntax.syntax_chunks(texts.filter("parser IS NOT NULL"), "identity", "text", "parser", limited=False).drop("skipped")
        cut = plain.unionByName(scripts).withColumnRenamed("content", "body")
        parser = F.get(F.split("identity", ":"), F.lit(1))
        # regions may begin in one line, so a script's chunks are told apart by symbol and end as well
        place = F.when(parser.isNull(), F.col("start_line").cast("string")).otherwise(F.concat_ws(":", parser, "start_line", "end_line", "symbol"))
        cut = cut.withColumn("chunk_id", F.concat_ws(":", F.left("identity", F.lit(32)), place))
        chunks = self._write("chunks", self._numbered(cut), folder)
        blocks = self._write("chunk_blocks", _by_term(block_postings(chunks, {"symbol": "symbol", "body": "body"})), folder)
        lens = blocks.select(F.explode(F.arrays_zip("docs", "places")).alias("p")).groupBy(F.col("p.docs").alias("doc")).agg(F.sum(F.size("p.places")).alias("n"))
        sizes = chunks.select("doc", "identity").join(lens, "doc", "left").groupBy("identity").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
        none = F.lit(0).cast("long")
        contents = self._write("contents", missing.join(sizes, "identity", "left").select("identity", F.coalesce("chunks", none).alias("chunks"), F.coalesce("tokens", none).alias("tokens")), folder)
        old_paths = self.table("paths").select("path_id").join(rows.select("path_id"), "path_id", "left_semi")
        paths = self._write("paths", self._numbered(rows.filter("identity IS NOT NULL").select("path_id", "path").join(old_paths, "path_id", "left_anti")), folder)
        path_blocks = self._write("path_blocks", _by_term(block_postings(paths, {"path": "path"})), folder)
        path_tokens = path_blocks.agg(F.coalesce(F.sum(F.aggregate("places", F.lit(0), lambda n, p: n + F.size(p))), none).alias("path_tokens"))
        self._write("dead", self._left(rows), folder)
        entries = rows.count()
        totals = path_tokens.crossJoin(F.broadcast(paths.agg(F.count("*").alias("paths"))))
        after = self._commit([*self.segments, self._finish(folder, contents, totals, entries)], self.batch if batch is None else batch)
        if after is None:
            self.pointers.remove(folder)
        return after

    def _left(self, rows: DataFrame) -> DataFrame:
        """(identity, dead): contents the changed paths had and no active file has any more, and dead ones that came back."""
        before = self.view()
        changed = rows.select("path_id")
        had = before.join(changed, "path_id", "left_semi").select("identity").distinct()
        now = rows.filter("identity IS NOT NULL").select("identity").distinct()
        held = before.join(had, "identity", "left_semi").join(changed, "path_id", "left_anti").select("identity").distinct()
        gone = had.join(held, "identity", "left_anti").join(now, "identity", "left_anti").withColumn("dead", F.lit(True))
        return gone.unionByName(self.dead().join(now, "identity", "left_semi").withColumn("dead", F.lit(False)))

    def due(self) -> int:
        """How many of the newest segments a merge should unite; 1 or 0: none."""
        total = n = 0
        for s in reversed(self.segments):
            if n and s["entries"] > RATIO * total:
                break
            total, n = total + s["entries"], n + 1
        return n

    def merge(self, newest: int | None = None) -> Segments | None:
        """The next version, with the ``newest`` segments united and what is dead in them taken out; none if another writer came first."""
        newest = self.due() if newest is None else newest
        kept, run = (self.segments[:-newest], self.segments[-newest:]) if newest else (self.segments, [])
        if len(run) < 2:
            return self
        folder, dead = f"segment-{uuid.uuid4().hex}", self.dead()
        contents = self._write("contents", self._of("contents", run).join(dead, "identity", "left_anti"), folder)
        chunks = self._write("chunks", self._of("chunks", run).join(dead, "identity", "left_anti"), folder)
        gone = self._of("chunks", run).select("doc", "identity").join(dead, "identity", "left_semi").select("doc")
        blocks = self._of("chunk_blocks", run).drop("segment")
        flat = blocks.select("field", "term", F.xxhash64("docs").alias("block"), F.explode(F.arrays_zip("docs", "lens", "places")).alias("p")).select("field", "term", "block", "p.docs", "p.lens", "p.places")
        kept_rows = flat.withColumnRenamed("docs", "doc").join(gone, "doc", "left_anti")
        again = kept_rows.groupBy("field", "term", "block").agg(F.array_sort(F.collect_list(F.struct("doc", "lens", "places"))).alias("x"))
        again = again.select("field", "term", F.col("x.doc").alias("docs"), F.col("x.lens").alias("lens"), F.col("x.places").alias("places"))
        self._write("chunk_blocks", _by_term(again), folder)
        paths = self._write("paths", self._of("paths", run), folder)
        path_blocks = self._write("path_blocks", _by_term(self._of("path_blocks", run)), folder)
        view = _latest(self._of("view", run), "path_id", "path", "identity")
        view = self._write("view", view if kept else view.filter("identity IS NOT NULL"), folder)
        told = _latest(self._of("dead", run), "identity", "dead")  # of older segments' contents it has to stay
        self._write("dead", told.join(self._of("contents", kept).select("identity"), "identity", "left_semi"), folder)
        totals = path_blocks.agg(F.coalesce(F.sum(F.aggregate("places", F.lit(0), lambda n, p: n + F.size(p))), F.lit(0)).alias("path_tokens"))
        after = self._commit([*kept, self._finish(folder, contents, totals.crossJoin(F.broadcast(paths.agg(F.count("*").alias("paths")))), view.count())], self.batch)
        if after is None:
            self.pointers.remove(folder)
        return after
