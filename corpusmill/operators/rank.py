"""Lexical ranking: postings, corpus statistics, BM25, fusion and excerpts.

Postings are counted word by word: a text is split into words, equal words of a
row are counted, and only distinct words are expanded into tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import words

# Fixed values of the ranking function and of query admission.
K1, B, FLOOR = 1.2, 0.75, 1e-6
QUERY_BYTES, QUERY_TERMS, LIMITS = 2000, 32, (1, 20)


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """Distinct tokens of a query in order, at most 32; an error for too long or empty ones."""
    if len(query.encode()) > QUERY_BYTES:
        raise ValueError("a query has at most 2000 bytes")
    row = spark.range(1).select(F.array_sort(F.array_distinct(T.tokens(F.lit(query)))).alias("t")).first()
    if not row.t:
        raise ValueError("a query needs a word")
    return row.t[:QUERY_TERMS]


def query_phrases(spark: SparkSession, query: str, underscore: bool = True) -> list[list[str]]:
    """The search tokens of each query term: a compound term is a phrase."""
    terms = query_terms(spark, query)
    row = spark.range(1).select(*[T.search_tokens(F.lit(t), underscore).alias(f"t{i}") for i, t in enumerate(terms)]).first()
    return [list(p) for p in row if p]


def postings(rows: DataFrame, key: str, fields: dict[str, str], underscore: bool = True) -> DataFrame:
    """(key, field, term, tf): how often a field of a row has a search token of its expanded text.

    Rows are dealt by ``key`` once; the counts, and any later grouping by ``key``, need no further exchange.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in fields.items()])
    dealt = rows.select(key, *fields.values()).repartition(key).select(key, F.explode(cells).alias("cell"))
    words = dealt.select(key, F.col("cell.field").alias("field"), F.explode(F.split("cell.value", T.BETWEEN_WORDS)).alias("word"))
    words = words.select(key, "field", F.regexp_replace("word", T.ENDS, "").alias("word")).filter("word <> ''")
    counted = words.groupBy(key, "field", "word").agg(F.count("*").alias("n"))
    terms = F.flatten(F.transform(T.word_tokens(F.col("word")), lambda t: T.search_tokens(t, underscore)))
    exploded = counted.select(key, "field", "n", F.explode(terms).alias("term"))
    return exploded.groupBy(key, "field", "term").agg(F.sum("n").alias("tf"))


def score_of(n: int) -> Column:
    """BM25 over columns f0.. (weighted counts, null for none), df0.., len, n_rows and total."""
    score = F.lit(0.0)
    for i in range(n):
        idf = F.log((F.col("n_rows") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(FLOOR))
        f = F.col(f"f{i}")
        part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") * F.col("n_rows") / F.col("total")))
        score = score + F.coalesce(part, F.lit(0.0))
    return score


def spread(rows: DataFrame) -> DataFrame:
    """A scanned table whose files make fewer tasks than there are cores, dealt to all of them; a larger one as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def term_counts(rows: DataFrame, key: str, fields: dict[str, str], terms: list[str], weights: dict[str, float], underscore: bool = True) -> DataFrame:
    """(key, len, f0, f1, ...): search tokens of each row in all fields, and the weighted count of each of ``terms``, null for none.

    One pass: nothing but the counts leaves the texts' tasks.  Null fields hold no token.
    """
    kind = dict(rows.dtypes)[key]
    names, weight = list(fields), [float(weights.get(f, 1.0)) for f in fields]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.Vocabulary(underscore)
        for b in parts:
            known.trim()
            length = np.zeros(len(b), np.int64)
            found = np.zeros((len(terms), len(b)))
            for f in range(len(names)):
                sequences = [known.sequence(x.as_py()) for x in b.column(f + 1)]
                sizes = np.fromiter(map(len, sequences), np.int64, len(b))
                length += sizes
                every = np.concatenate(sequences) if sequences else np.zeros(0, np.int32)
                row = np.repeat(np.arange(len(b)), sizes)
                for i, t in enumerate(terms):
                    found[i] += weight[f] * np.bincount(row[every == known.numbers.get(t, -1)], minlength=len(b))
            columns = [pa.array(np.where(f > 0, f, np.nan), from_pandas=True) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length), *columns], names=["key", "len", *(f"f{i}" for i in range(len(terms)))])

    ddl = f"key {kind}, len long" + "".join(f", f{i} double" for i in range(len(terms)))
    # dealt after the pass: statistics and scores then share one exchange of counts instead of reading the texts twice
    return rows.select(key, *fields.values()).mapInArrow(run, ddl).withColumnRenamed("key", key).repartition(key)


def bm25_of(counted: DataFrame, key: str, n: int) -> DataFrame:
    """(key, score) of the rows of ``term_counts`` that hold one of its ``n`` terms; statistics cover all of its rows."""
    corpus = counted.agg(F.count("*").alias("n_rows"), F.sum("len").alias("total"), *[F.count(f"f{i}").alias(f"df{i}") for i in range(n)])
    matched = counted.filter(F.coalesce(*[F.col(f"f{i}") for i in range(n)]).isNotNull())
    return matched.crossJoin(F.broadcast(corpus)).select(key, score_of(n).alias("score"))


def bm25(posted: DataFrame, rows: DataFrame, key: str, terms: list[str], weights: dict[str, float]) -> DataFrame:
    """(key, score) of the rows that hold a term; statistics cover every row of ``rows``, matched or not.

    Lengths and term counts of a row come from one aggregation of the postings, which the
    statistics and the scores share; the statistics are a single row.
    """
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(w))) for f, w in weights.items()], F.lit(1.0))
    found = [F.sum(F.when(F.col("term") == t, F.col("tf") * weight)).alias(f"f{i}") for i, t in enumerate(terms)]
    per_row = posted.groupBy(key).agg(F.sum("tf").alias("len"), *found)
    corpus = per_row.agg(F.sum("len").alias("total"), *[F.count(f"f{i}").alias(f"df{i}") for i in range(len(terms))])
    corpus = corpus.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n_rows"))))
    matched = per_row.filter(F.coalesce(*[F.col(f"f{i}") for i in range(len(terms))]).isNotNull())
    return matched.crossJoin(F.broadcast(corpus)).select(key, score_of(len(terms)).alias("score"))


def phrase_counts(rows: DataFrame, key: str, text: str, phrases: list[list[str]], underscore: bool = True) -> DataFrame:
    """(key, phrase, n): occurrences of token phrases in expanded texts, adjacent tokens only, overlaps counted.

    One pass for all phrases: a text's tokens are numbers, made once, and a phrase is looked for in a whole batch at a time.
    """
    kind = dict(rows.dtypes)[key]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.Vocabulary(underscore)
        for b in parts:
            known.trim()
            sequences = [known.sequence(x.as_py()) for x in b.column(1)]
            every = np.concatenate(sequences) if sequences else np.zeros(0, np.int32)
            row = np.repeat(np.arange(len(b)), np.fromiter(map(len, sequences), np.int64, len(b)))
            for p in phrases:
                size = max(len(every) - len(p) + 1, 0)
                hit = row[:size] == row[len(p) - 1 :][:size]
                for i, t in enumerate(p):
                    hit &= every[i:][:size] == known.numbers.get(t, -1)
                n = np.bincount(row[:size][hit], minlength=len(b))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([" ".join(p)] * len(at), pa.string()), pa.array(n[at].astype(np.int64))], names=["key", "phrase", "n"])

    return rows.select(key, text).mapInArrow(run, f"key {kind}, phrase string, n long").withColumnRenamed("key", key)


def fused(*scored: DataFrame, key: str) -> DataFrame:
    """Scores of several candidate lists added up."""
    all_ = scored[0].select(key, "score")
    for s in scored[1:]:
        all_ = all_.unionByName(s.select(key, "score"))
    return all_.groupBy(key).agg(F.sum("score").alias("score"))


def top(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best rows, ties by the given columns."""
    if not LIMITS[0] <= k <= LIMITS[1]:
        raise ValueError("a limit lies between 1 and 20")
    return scored.orderBy(F.desc("score"), *ties).limit(k)


def best_line(lines: Column, terms: Column, last: bool = True) -> Column:
    """Index from 0 of the line with the most terms; the last or the first of equals."""
    counts = F.transform(lines, lambda line: T.contains_count(line, terms))
    most = F.array_max(counts)
    if not last:
        return F.array_position(counts, most) - 1
    return F.size(lines) - F.array_position(F.reverse(counts), most)


def excerpt(rows: DataFrame, content: str, terms: list[str], first_line: str) -> DataFrame:
    """Adds the excerpt of each row: 8 lines from 2 above its best line, 180 characters a line, 1000 in all."""
    words = F.array(*[F.lit(t) for t in terms])
    rows = rows.withColumn("__lines", T.lines(F.col(content)))
    rows = rows.withColumn("__best", best_line(F.col("__lines"), words))
    start = F.least(F.greatest(F.col("__best") - 2, F.lit(0)), F.greatest(F.size("__lines") - 8, F.lit(0)))
    rows = rows.withColumn("__first", start.cast("int"))
    shown = F.transform(F.slice("__lines", F.col("__first") + 1, 8), lambda line: F.substring(line, 1, 180))
    rows = rows.withColumn("excerpt", F.left(F.array_join(shown, "\n"), F.lit(1000)))
    begin = F.col(first_line) + F.col("__first")
    rows = rows.withColumn("excerpt_start", begin).withColumn("excerpt_end", begin + F.greatest(F.size(T.lines(F.col("excerpt"))), F.lit(1)) - 1)
    return rows.withColumn("truncated", F.col("excerpt") != F.col(content)).drop("__lines", "__best", "__first")
