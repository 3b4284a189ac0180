"""Scopes: intervals of the positions of a key, that may nest or cross, and the rows between their ends.

``around`` is for scopes that are given and lie in any way. ``tree`` finds the scopes of rows that open and close them, and what follows from their nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import scans
from .rules import depths, inside_nested

#: Children of a bin, and the largest bin as a power of that: 32,768 positions.
FAN, TOP = 8, 5


def _cover(lo: Column, hi: Column) -> Column:
    """array<(level, bin)>: the bins of FAN to the power of level positions that make up lo to hi - 1, without overlap: 14 at most of each level but the top one."""
    found = []
    for level in range(TOP + 1):
        width = FAN**level
        a, b = F.ceil(lo / width).cast("long"), F.floor(hi / width).cast("long")
        bins = lambda x, y, level=level: F.when(x < y, F.transform(F.sequence(x, y - 1), _placed(level)))
        if level == TOP:
            found.append(bins(a, b))
            continue
        up, down = F.ceil(lo / (FAN * width)).cast("long") * FAN, F.floor(hi / (FAN * width)).cast("long") * FAN
        # what larger bins do not take: all of it, or what lies before and after them
        found += [F.when(up >= down, bins(a, b)).otherwise(bins(a, up)), F.when(up < down, bins(down, b))]
    none = F.array().cast("array<struct<level:int,bin:bigint>>")
    return F.concat(*(F.coalesce(x, none) for x in found))


def _placed(level: int):
    return lambda bin_: F.struct(F.lit(level).alias("level"), bin_.alias("bin"))


def around(rows: DataFrame, scopes: DataFrame, key: str, order: str, opener: str = "opener", closer: str = "closer") -> DataFrame:
    """Each row once for every scope (key, opener, closer, other columns) of its key that it lies strictly between, with the scope's columns; positions are whole numbers.

    A scope is cut into bins of 1, 8, 64 and so on positions, a row looks at the one bin of each size that it lies in, and a row and a scope have one bin in common
    or none: an equality join, whose pairs are the result. A bin has at most 32,768 positions, so a scope around a third of all rows is many keys. Scopes may nest, cross and repeat. Null ends and
    positions lie nowhere; a null key is a key; rows that repeat stay.
    """
    other = [x for x in scopes.columns if x != key]
    cut = scopes.where(F.col(closer) > F.col(opener) + 1).select(F.col(key).alias("_key"), *other, F.explode(_cover(F.col(opener) + 1, F.col(closer))).alias("_bin"))
    places = F.array(*(F.struct(F.lit(n).alias("level"), F.floor(F.col(order) / FAN**n).cast("long").alias("bin")) for n in range(TOP + 1)))
    looked = rows.where(F.col(order).isNotNull()).withColumn("_bin", F.explode(places))
    return looked.join(cut, F.col(key).eqNullSafe(F.col("_key")) & (looked["_bin"] == cut["_bin"])).drop("_key", "_bin")


def has_scope(rows: DataFrame, scopes: DataFrame, key: str, order: str, kinds: list[str] | None = None, name: str = "in_scope") -> DataFrame:
    """Does a row lie in a scope (key, opener, closer, kind) of one of the kinds; without kinds, of any. Rows are taken to differ in key and order."""
    wanted = scopes if kinds is None else scopes.where(F.col("kind").isin(kinds))
    inside = around(rows.select(key, order), wanted.select(key, "opener", "closer"), key, order).select(F.col(key).alias("_k"), F.col(order).alias("_o")).distinct().withColumn("_in", F.lit(True))
    return rows.join(inside, F.col(key).eqNullSafe(F.col("_k")) & (F.col(order) == F.col("_o")), "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_k", "_o", "_in")


def matched(rows: DataFrame, key: str, order: str, opens: Column, closes: Column, carry: Column) -> DataFrame:
    """rows with ``_opener``, of rows that close a scope the (at, carried) of the row that opened it, null for others: by depth, as brackets match."""
    placed = depths(rows, key, order, opens, closes)
    closing = F.coalesce(closes, F.lit(False))
    level = F.struct(F.col(key).alias("key"), F.when(closing, F.col("_depth") + 1).otherwise(F.col("_depth")).alias("level"))
    state = F.when(F.col("_opens"), F.struct(F.lit(True).alias("open"), F.col(order).alias("at"), carry.alias("carried"))).when(closing, F.struct(F.lit(False).alias("open"), F.col(order).alias("at"), F.lit(None).alias("carried")))
    # a closing row without an open scope finds a closed one, or none, before it
    found = scans.scan(placed.withColumn("_level", level), "_level", order, {"_last": scans.latest(state)})
    return found.withColumn("_opener", F.when(closing & F.col("_last.open"), F.struct("_last.at", "_last.carried"))).drop("_opens", "_depth", "_level", "_last")


def tree(rows: DataFrame, key: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """(key, opener, closer, level, parent): the scopes of rows that open and close them; the outermost have level 1 and no parent, one that is never closed has no closer."""
    around_ = inside_nested(depths(rows.select(key, order, opens.alias("_o"), closes.alias("_c")), key, order, F.col("_o"), F.col("_c")).withColumnRenamed("_depth", "level").withColumnRenamed("_opens", "_start"), key, order, F.col("_o"), F.col("_c"), "parent")
    starts = around_.where("_start").select(key, F.col(order).alias("opener"), F.col("level").cast("long").alias("level"), "parent")
    ends = matched(rows, key, order, opens, closes, F.lit(1)).where("_opener is not null").select(F.col(key).alias("_k"), F.col("_opener.at").alias("_at"), F.col(order).alias("closer"))
    return starts.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("opener") == F.col("_at")), "left").select(key, "opener", "closer", "level", "parent")


def closed_scope(rows: DataFrame, key: str, order: str, opens: Column, closes: Column, closed: Column, name: str = "scope") -> DataFrame:
    """rows with the opener of the innermost closed scope around each, null outside: of the opening rows those count that are ``closed``, whatever other scopes lie between."""
    shut = matched(rows.withColumn("_x", F.coalesce(opens & closed, F.lit(False))).withColumn("_y", F.coalesce(closes, F.lit(False))), key, order, opens, closes, F.col("_x"))
    shut = shut.withColumn("_y", F.coalesce(F.col("_opener.carried"), F.lit(False))).drop("_opener")
    return inside_nested(shut, key, order, F.col("_x") & ~F.col("_y"), F.col("_y"), name).drop("_x", "_y")


def verified(rows: DataFrame, key: str, order: str, opens: Column, closes: Column, closed: Column, check: Column, mode: Column) -> DataFrame:
    """rows with ``scope`` and ``verified``: has the row's closed scope a checking row of its own, before the row, or anywhere if the row's mode is ``after``.

    Closed scopes within it are skipped, other scopes within it are looked into. Outside all closed scopes the key's other rows are one scope.
    """
    own = closed_scope(rows.withColumn("_check", F.coalesce(check, F.lit(False))).withColumn("_mode", mode), key, order, opens, closes, closed)
    first = own.where("_check").groupBy(F.col(key).alias("_k"), F.col("scope").alias("_s")).agg(F.min(order).alias("_first"))
    found = own.join(first, F.col(key).eqNullSafe(F.col("_k")) & F.col("scope").eqNullSafe(F.col("_s")), "left")
    said = F.when(F.col("_mode") == "after", F.col("_first").isNotNull()).otherwise(F.coalesce(F.col("_first") < F.col(order), F.lit(False)))
    return found.withColumn("verified", said).drop("_check", "_mode", "_k", "_s", "_first")


def repeated(rows: DataFrame, key: str, order: str, opens: Column, closes: Column, condition: Column, least: int = 2) -> DataFrame:
    """(key, scope, n): the scopes with ``least`` or more rows of their own level that meet the condition; null is the outermost level."""
    own = inside_nested(rows.withColumn("_hit", F.coalesce(condition, F.lit(False))), key, order, opens, closes, "scope").where("_hit")
    return own.groupBy(key, "scope").agg(F.count("*").alias("n")).where(F.col("n") >= least)
