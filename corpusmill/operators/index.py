"""What searches of a stored index share: names of contents, field weights, folders, and phrase scores."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import rank

# Field weights of the two rankings.
CHUNK_WEIGHTS, PATH_WEIGHTS = {"symbol": 8.0, "body": 1.0}, {"path": 3.0}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one of the session; a local master may do without that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="index-")
    return f"{base.rstrip('/')}/index-{uuid.uuid4().hex}"


def identity(text: Column) -> Column:
    """The name of a content: its SHA-256."""
    return F.sha2(text, 256)


def phrase_bm25(posted: DataFrame, stats: DataFrame, key: str, phrases: list[list[str]], weights: dict[str, float]) -> DataFrame:
    """(key, score): BM25 where a compound term counts as the phrase of its tokens, adjacent in one field.

    Reads the postings of the phrases' tokens only; a phrase has its own document frequency.
    """
    terms = sorted({t for p in phrases for t in p})
    at = {t: F.col(f"p{i}") for i, t in enumerate(terms)}
    hits = posted.filter(F.col("term").isin(terms))
    cells = hits.groupBy(key, "field").agg(F.max("len").alias("len"), *[F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"p{i}") for i, t in enumerate(terms)])
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(w))) for f, w in weights.items()], F.lit(1.0))

    def count(phrase: list[str]) -> Column:
        first = at[phrase[0]]
        follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(at[t], p + i) for i, t in enumerate(phrase) if i], F.lit(True))
        return F.when(first.isNull(), 0).otherwise(F.size(F.filter(first, follows)))

    found = [F.nullif(F.sum(count(p) * weight), F.lit(0.0)).alias(f"f{i}") for i, p in enumerate(phrases)]
    rows = cells.groupBy(key).agg(F.max("len").alias("len"), *found)
    frequencies = rows.agg(*[F.count(f"f{i}").alias(f"df{i}") for i in range(len(phrases))])
    corpus = F.broadcast(frequencies.crossJoin(F.broadcast(stats)))
    matched = rows.filter(F.coalesce(*[F.col(f"f{i}") for i in range(len(phrases))]).isNotNull())
    return matched.crossJoin(corpus).select(key, rank.score_of(len(phrases)).alias("score"))
