"""Prefix scans: what the rows before or after each row of its key amount to, whatever share of all rows a key has.

A key with more rows than a task should sort is cut into stretches of its order. Every stretch is folded to one small state, the states of a key's stretches are
folded in their order, and each row takes what its stretch brings and what came before its stretch. Where no key is that large nothing is
cut and a scan is a plain window. Where the cuts lie has no part in the result.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a key that one task sorts at most, unless that is less than a thousandth of all rows.
MOST_ROWS = 1 << 20
_SAMPLES = 64  # order values looked at for each stretch


@dataclass(frozen=True)
class Fold:
    """An associative fold of ``value``: over a window, over a whole stretch given its order and whether that is gone through backward, and of an earlier and a later part."""

    value: Column
    over: Callable[[Column], Column]
    whole: Callable[[Column, Column, bool], Column]
    combine: Callable[[Column, Column], Column]


def _end(v: Column, at: Column, last: bool) -> Column:
    return (F.max_by if last else F.min_by)(v, F.when(v.isNotNull(), at))


def total(value) -> Fold:
    """The sum; null counts for nothing and no rows for 0."""
    return Fold(F.coalesce(value, F.lit(0)), F.sum, lambda v, at, back: F.sum(v), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def count(condition=None) -> Fold:
    """How many rows meet the condition."""
    return total(F.lit(1).cast("long") if condition is None else F.coalesce(condition, F.lit(False)).cast("long"))


def least(value) -> Fold:
    return Fold(value, F.min, lambda v, at, back: F.min(v), F.least)


def greatest(value) -> Fold:
    return Fold(value, F.max, lambda v, at, back: F.max(v), F.greatest)


def latest(value) -> Fold:
    """The last value that is not null: the nearest, as a backward scan goes through the rows in reverse order."""
    return Fold(value, lambda v: F.last(v, True), lambda v, at, back: _end(v, at, not back), lambda a, b: F.coalesce(b, a))


def earliest(value) -> Fold:
    """The first value that is not null: the farthest, in a backward scan."""
    return Fold(value, lambda v: F.first(v, True), lambda v, at, back: _end(v, at, back), lambda a, b: F.coalesce(a, b))


def stretches(df: DataFrame, key: str, order: list[str], most_rows: int | None = None, name: str = "_stretch") -> tuple[DataFrame, bool]:
    """df with the stretch of each row, 0 for keys that are not cut, and whether any is. Rows that are equal in ``order`` are in one stretch.

    Keys with more than ``most_rows`` rows and more than a thousandth of all, so fewer than a thousand, are cut at values seen in a sample by hash.
    """
    most = MOST_ROWS if most_rows is None else most_rows
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    top = counts.where(F.col("_n") > most).orderBy(F.desc("_n")).limit(1000).collect()
    if not top:
        return df.withColumn(name, F.lit(0)), False
    every = counts.agg(F.sum("_n")).first()[0]
    limit = max(most, every // 1000)
    hot = [r for r in top if r["_n"] > limit]
    if not hot:
        return df.withColumn(name, F.lit(0)), False
    kind = dict(df.dtypes)[key]
    at = F.struct(*(F.col(x).alias(f"o{i}") for i, x in enumerate(order)))
    wanted = {r["_key"]: -(-r["_n"] // limit) for r in hot}
    rate = max(1, limit // _SAMPLES)
    table = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in wanted], f"_key {kind}"))
    rows = df.join(table, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    seen = rows.where(F.pmod(F.xxhash64(*order), F.lit(rate)) == 0).select(F.col(key).alias("_key"), at.alias("_at")).distinct()
    places = seen.withColumn("_place", F.percent_rank().over(Window.partitionBy("_key").orderBy("_at")))  # some _SAMPLES for each stretch
    cuts = places.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_place", "_at"))).alias("_c")).collect()
    at_type = dict(df.select(at.alias("_at")).dtypes)["_at"]
    chosen = []
    for r in cuts:
        found, n = [x["_place"] for x in r["_c"]], wanted[r["_key"]]
        spots = sorted({bisect.bisect_left(found, i / n) for i in range(1, n)} - {len(found)})
        chosen.append((r["_key"], [r["_c"][i]["_at"] for i in spots]))
    table = F.broadcast(df.sparkSession.createDataFrame(chosen, f"_key {kind}, _cuts array<{at_type}>"))  # a value for each stretch
    cut = df.join(table, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(name, F.coalesce(F.size(F.filter("_cuts", lambda x: x <= at)), F.lit(0)))
    return cut.withColumn(name, F.greatest(name, F.lit(0))).drop("_key", "_cuts"), True


def scan(df: DataFrame, key: str, order: str | list[str], folds: dict[str, Fold], backward: bool = False, inclusive: bool = False, most_rows: int | None = None) -> DataFrame:
    """df with a column for each fold: of the rows of the same key before each row in ``order`` (null first), or after it with ``backward``, nearest last.

    With ``inclusive`` the row itself counts too. Rows that are equal in ``order`` come in any order. A null key is a key; an empty table gives an empty table.
    """
    order = [order] if isinstance(order, str) else order
    values = {f"_v{i}": f.value for i, f in enumerate(folds.values())}
    rows, cut = stretches(df.withColumns(values), key, order, most_rows)
    by = [F.desc_nulls_last(x) if backward else F.asc_nulls_first(x) for x in order]
    w = Window.partitionBy(key, "_stretch").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.withColumns({f"_w{i}": f.over(F.col(f"_v{i}")).over(w) for i, f in enumerate(folds.values())})
    if cut:
        own = (f.whole(F.col(f"_v{i}"), F.struct(*order), backward).alias(f"_s{i}") for i, f in enumerate(folds.values()))
        states = rows.groupBy(F.col(key).alias("_k"), F.col("_stretch").alias("_t")).agg(*own)
        before = Window.partitionBy("_k").orderBy(F.desc("_t") if backward else F.asc("_t")).rowsBetween(Window.unboundedPreceding, -1)
        carried = states.select("_k", "_t", *(f.over(F.col(f"_s{i}")).over(before).alias(f"_c{i}") for i, f in enumerate(folds.values())), F.count("*").over(Window.partitionBy("_k")).alias("_all")).where("_all > 1")
        out = out.join(F.broadcast(carried), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_stretch") == F.col("_t")), "left")  # as many as stretches
    else:
        kinds = dict(out.dtypes)
        out = out.withColumns({f"_c{i}": F.lit(None).cast(kinds[f"_w{i}"]) for i in range(len(folds))})
    result = {n: f.combine(F.col(f"_c{i}"), F.col(f"_w{i}")) for i, (n, f) in enumerate(folds.items())}
    drop = [x for i in range(len(folds)) for x in (f"_v{i}", f"_w{i}", f"_c{i}")]
    return out.withColumns(result).drop(*drop, "_stretch", "_k", "_t", "_all")

