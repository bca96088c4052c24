"""Running totals whose groups may be larger than one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.index import shared_folder


def ahead(rows: DataFrame, group: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Rows with ``<name>_ahead``, the total over the rows before them in their group, and ``<name>_all``, the group's own.

    Rows are dealt by ranges of (group, order) and written once to the shared folder, so a group is spread
    over as many tasks as it fills; each range adds the totals of the ranges before it, of which there
    are at most one more for each group than there are partitions.  Null groups are a group, null totals count as 0.
    """
    values = {f"__{n}": F.coalesce(c, F.lit(0)) for n, c in totals.items()}
    path = shared_folder(rows.sparkSession)
    dealt = rows.withColumns(values).repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    names = {g: f"__g{i}" for i, g in enumerate(group)}
    parts = dealt.groupBy(*[F.col(g).alias(names[g]) for g in group], F.col("__part").alias("__p")).agg(*[F.sum(v).alias(f"{v}_s") for v in values])
    whole = Window.partitionBy(*names.values())
    before = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{v}_b": F.coalesce(F.sum(f"{v}_s").over(before), F.lit(0)) for v in values}
    parts = parts.withColumns(sums | {f"{v}_w": F.sum(f"{v}_s").over(whole) for v in values}).drop(*[f"{v}_s" for v in values])
    match = F.col("__part") == F.col("__p")
    for g, name in names.items():
        match &= F.col(g).eqNullSafe(F.col(name))
    here = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(parts, match)
    sums = {f"{n}_ahead": F.col(f"__{n}_b") + F.coalesce(F.sum(f"__{n}").over(here), F.lit(0)) for n in totals}
    return out.withColumns(sums | {f"{n}_all": F.col(f"__{n}_w") for n in totals}).select(*rows.columns, *[f"{n}_{x}" for n in totals for x in ("ahead", "all")])
