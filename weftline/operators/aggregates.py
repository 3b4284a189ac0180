"""Counts, histograms and sums over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def histogram(df: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """(metric, value, n) of several columns in one pass."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).cast("string").alias("value")) for m, c in metrics.items()))
    return df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("metric", "value").agg(F.count("*").alias("n"))


def ranked_histogram(counts: DataFrame, n: str = "n") -> DataFrame:
    """The counts, largest first; equal ones in the order of the other columns."""
    return counts.orderBy(F.desc(n), *(x for x in counts.columns if x != n))


def cumulative_size(df: DataFrame, levels: list[str], size: Column, name: str = "bytes") -> DataFrame:
    """The sum of sizes at every level of a path, outermost first, and of all."""
    return df.rollup(*levels).agg(F.sum(size).alias(name))


def two_sided_status(df: DataFrame, key: str, ahead: Column, behind: Column, names: tuple[str, str] = ("ahead", "behind")) -> DataFrame:
    """(key, the two counts, status, percent): = if they are equal, > if the first is larger, else <; percent is the first's share of all rows."""
    counts = df.groupBy(key).agg(F.count_if(ahead).alias(names[0]), F.count_if(behind).alias(names[1]), F.count("*").alias("_n"))
    a, b = map(F.col, names)
    return counts.select(key, *names, F.when(a == b, "=").when(a > b, ">").otherwise("<").alias("status"), F.round(100 * a / F.col("_n")).cast("long").alias("percent"))


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key, the smallest of several."""
    c = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return c.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value), F.max("n").alias("n"))


def bounded_count(df: DataFrame, condition: Column, most: int = 2, name: str = "n") -> DataFrame:
    """One row: how many rows meet the condition, up to ``most``; no more are looked for."""
    return df.where(condition).select(F.lit(1)).limit(most).agg(F.count("*").alias(name))


def changed_count(df: DataFrame, old: str, new: str, name: str = "n_changed") -> DataFrame:
    """One row: how many rows have another value now."""
    return df.agg(F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias(name))


def joined_values(df: DataFrame, key: str, value: str, order: str, name: str = "values", separator: str = "\n") -> DataFrame:
    """(key, name): the values of a selection in order, joined. The selection is what a user picked, so a group fits a row; ``lines.joined_blocks`` is for keys that no row can hold."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_p")).select(key, F.array_join(F.col(f"_p.{value}"), separator).alias(name))
