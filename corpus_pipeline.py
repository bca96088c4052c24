"""The corpus pipeline: stages that each call one training-data operator.

Every stage reads all rows its predecessor kept.  Stages that filter or edit
return the columns of ``documents``, with ``n_chars`` counted anew where the
text has changed.  Null or empty texts are never edited; the near-duplicate stage
takes texts without words for copies of each other and keeps the one of least id.
Rows without ``doc_id`` pass that stage, as they can't be told apart by id; extra columns, of whatever name and
type, are carried along as they are (``n_chars`` is taken for the length of ``text``); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from corpusmill.llm import decontaminate, packing, simhash, substring, toxicity
from corpusmill.llm.common import free_name, hot_join, stage, table


REJECT = 0.5


def _shaped(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, lengths counted anew."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return docs.select(*like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under ``REJECT``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "_toxicity")
    return toxicity.score(docs, model, score).filter(F.col(score) < REJECT).select(*docs.columns)


def _orderable(docs: DataFrame, name: str) -> Column:
    """A column to sort by; JSON stands for types that have no order."""
    plain = isinstance(docs.schema[name].dataType, AtomicType) and docs.schema[name].dataType.typeName() != "variant"
    return F.col(name) if plain else F.to_json(F.struct(name))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one row of the least id: of least fingerprint and then the first by its columns.

    Near means op7's rule: shingles of 4 words and at most 4 of 64 bits.
    """
    own, least, row = (free_name(docs.columns, x) for x in ("_fp", "_least", "_row"))
    fps = stage(simhash.fingerprints(docs), "simhash-fps")
    first = hot_join(fps, simhash.groups_of(fps), "fp", "uses", fps.count()).filter("doc_id = component_id")
    first = first.groupBy("doc_id", "component").agg(F.min("fp").alias(least)).select("doc_id", least)

    @F.pandas_udf("long")
    def fp(raw):
        import pandas as pd

        return pd.Series([simhash.fingerprint(x) for x in raw], dtype="int64")

    known = docs.join(first, "doc_id").withColumn(own, fp(F.col("text").cast("binary"))).filter(F.col(own) == F.col(least))
    order = Window.partitionBy("doc_id", own).orderBy("text", *[_orderable(docs, c) for c in docs.columns if c not in ("doc_id", "text")])
    named = known.withColumn(row, F.row_number().over(order)).filter(F.col(row) == 1).select(*docs.columns)
    return named.unionByName(docs.filter("doc_id IS NULL"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; texts that lose nothing stay as written."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = [F.struct(*rest).alias("carried")] if rest else []
    out = substring.substring_dedup(docs.select("doc_id", "text", *carried), as_written=True)
    return _shaped(out.select("doc_id", F.col("kept").alias("text"), *[F.col("carried")[c].alias(c) for c in rest]), docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the stretches that a benchmark item has."""
    return _shaped(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring", drop_repeats),
    ("decontaminate", drop_benchmark),
    ("packing", pack_sequences),
]

#: A trained classifier, tokenizers and a search for few sequences are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
