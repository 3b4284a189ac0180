"""Gapless places in an order of all rows, without one task that sees them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from .shared import saved


def numbered(df: DataFrame, order: list, name: str, first: int = 1) -> DataFrame:
    """df with each row's place, from ``first``, in ``order`` (columns or sort orders); rows that are equal there get places in any order, but each its own.

    Rows are range-partitioned, sorted and written to the shared folder, so that a row keeps its place in its partition; the counts of the partitions,
    one number each, are added up. Equal rows of one sort key share a partition, so the order should end with something that tells rows apart.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(x) if not isinstance(x, Column) else x for x in order]
    local = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    kept = saved(local.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = sorted(kept.groupBy("_part").count().collect())  # one number for each partition
    before = [(p, total - k) for (p, k), total in zip(counts, accumulate(k for _, k in counts), strict=True)]
    table = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))
    return kept.join(table, "_part").withColumn(name, F.col("_before") + F.col("_at") + first).drop("_at", "_part", "_before")
