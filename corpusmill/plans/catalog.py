"""Registry of the retrieval, retention and evaluation queries, with DuckDB statements for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import ledgers, records, refresh, reports, retrieval, search, trials, upkeep

QUERIES: dict = {**search.QUERIES, **ledgers.QUERIES, **records.QUERIES, **refresh.QUERIES, **reports.QUERIES, **retrieval.QUERIES, **trials.QUERIES, **upkeep.QUERIES}
ORACLES: dict[str, str] = {**search.ORACLES, **ledgers.ORACLES, **records.ORACLES, **refresh.ORACLES, **reports.ORACLES, **retrieval.ORACLES, **trials.ORACLES, **upkeep.ORACLES}


def listing(spark: SparkSession) -> DataFrame:
    """(name, oracle, about): the queries as a table that programs can read."""
    rows = [(n, n in ORACLES, (f.__doc__ or "").strip().split("\n")[0]) for n, f in sorted(QUERIES.items())]
    return spark.createDataFrame(rows, "name string, oracle boolean, about string")
