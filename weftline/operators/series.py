"""Ordered rows: neighbours, numbering, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import natural_key
from . import scans
from .numbering import numbered


def previous_entry(df: DataFrame, key: str, at: str) -> DataFrame:
    """(key, at, previous): the greatest entry before each, whatever the gap; a key of any length is scanned in stretches."""
    return scans.scan(df.select(key, at).distinct(), key, at, {"previous": scans.latest(F.col(at))})


def latest_before(df: DataFrame, key: str, at: str, bound) -> DataFrame:
    return df.where(F.col(at) < F.lit(bound)).groupBy(key).agg(F.max(at).alias("latest"))


def next_opposite(df: DataFrame, key: str, order: str, kind: Column, name: str = "next_opposite", wrap: bool = True, reverse: bool = False) -> DataFrame:
    """The place of the first later row of another kind; with ``wrap`` else of the first earlier row of another kind, else null.

    ``reverse`` goes through the rows from the last to the first. Null is a kind of its own. A row whose next one is of another kind knows where that run begins, so
    scans of next rows, nearest and first run ends are enough, and keys of any length do.
    """
    here = F.struct(F.col(order).alias("at"), F.col("_kind").alias("kind"))
    rows = scans.scan(df.withColumn("_kind", kind), key, order, {"_next": scans.latest(here)}, backward=not reverse)
    rows = rows.withColumn("_step", F.when(F.col("_next").isNotNull() & ~F.col("_next.kind").eqNullSafe(F.col("_kind")), F.col("_next.at")))
    rows = scans.scan(rows, key, order, {"_ahead": scans.latest(F.col("_step"))}, backward=not reverse, inclusive=True)
    found = F.col("_ahead")
    if wrap:
        rows = scans.scan(rows, key, order, {"_first": scans.earliest(here), "_change": scans.earliest(F.col("_step"))}, backward=reverse)
        other = F.col("_first").isNotNull() & ~F.col("_first.kind").eqNullSafe(F.col("_kind"))
        found = F.coalesce(found, F.when(other, F.col("_first.at")).otherwise(F.col("_change")))
    return rows.withColumn(name, found).drop("_kind", "_next", "_step", "_ahead", "_first", "_change")


def previous_where(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value before each row that is not null."""
    return scans.scan(df, key, order, {name: scans.latest(value)})


def next_where(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """The first value after each row that is not null."""
    return scans.scan(df, key, order, {name: scans.latest(value)}, backward=True)


def free_names(wanted: DataFrame, name: str, order: str) -> DataFrame:
    """Names made unique: the first keeps its own, later ones get those of _, _0, _1 and so on that make no name that is there already."""
    rows = scans.scan(wanted, name, order, {"_n": scans.count()}).withColumn("_n", F.col("_n") - 1).withColumn("_taken", F.lit(False))
    # names that a suffix makes of another; only one base and one suffix make a given name, so new names never meet
    number = F.regexp_extract(name, r"(?s)_(0|[1-9][0-9]{0,17})?\z", 1)
    taken = wanted.select(name).distinct().where(F.col(name).rlike(r"(?s)_(0|[1-9][0-9]{0,17})?\z"))
    taken = taken.select(F.regexp_extract(name, r"(?s)\A(.*)_[0-9]*\z", 1).alias(name), F.when(number == "", F.lit(0).cast("long")).otherwise(number.try_cast("long") + 1).alias("_at"))
    # so many free suffixes come before a taken one
    taken = scans.scan(taken, name, "_at", {"_before": scans.count()}).select(name, (F.col("_at") - F.col("_before")).alias("_n"), F.lit(True).alias("_taken"))
    # of one number the taken suffix goes before the name that wants it
    both = rows.unionByName(taken, allowMissingColumns=True).withColumn("_turn", F.struct("_n", (~F.col("_taken")).alias("_late")))
    all_ = scans.scan(both, name, "_turn", {"_skipped": scans.count(F.col("_taken"))}, inclusive=True).where("not _taken")
    all_ = all_.withColumn("_n", F.when(F.col("_n") < 0, F.col("_n")).otherwise(F.col("_n") + F.col("_skipped"))).drop("_taken", "_turn", "_skipped")
    return all_.withColumn("free_name", F.when(F.col("_n") < 0, F.col(name)).when(F.col("_n") == 0, F.concat(name, F.lit("_"))).otherwise(F.concat(F.col(name), F.lit("_"), (F.col("_n") - 1).cast("string")))).drop("_n")


def rotated(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """``turn``: the place of each row in its group when the order starts at the k-th."""
    rows = scans.scan(scans.scan(df, key, order, {"_before": scans.count()}), key, order, {"_after": scans.count()}, backward=True)
    return rows.withColumn("turn", F.pmod(F.col("_before") - k, F.col("_before") + F.col("_after") + 1).cast("long")).drop("_before", "_after")


def seeded_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement, the same for a seed: those whose keys hash lowest."""
    return df.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("_draw", key).limit(k).drop("_draw")


def exact_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``seeded_sample`` of exactly k rows, or none at all if there are fewer."""
    some = seeded_sample(df, key, k, seed)
    return some.where(some.agg(F.count("*")).scalar() == k)


#: What files can be sorted by: expressions over their listing.
SORT_KEYS = {"size": "length", "basename": "name", "mtime": "mtime", "ctime": "ctime", "atime": "atime", "type": "type", "extension": "extension"}


def file_order(by: str = "natural", reverse: bool = False, folders_first: bool = True, ignore_case: bool = True, seed: int = 0, name: str = "name", folder: str = "is_dir") -> list[Column]:
    """The order of files by natural name, size, basename, mtime, ctime, atime, type, extension or random (the same for a seed).

    Folders go first whatever the direction; sizes and times are largest and latest first; equal keys go by name, then as they are in bytes.
    """
    plain = F.lower(name) if ignore_case else F.col(name)
    if by == "natural":
        key = natural_key(plain)
    elif by == "random":
        key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(name)))
    else:
        key = plain if by == "basename" else F.col(SORT_KEYS[by])
    down = (by in ("size", "mtime", "ctime", "atime")) != reverse
    first = [F.desc(folder)] if folders_first else []
    ties = [plain, F.col(name)]
    return [*first, key.desc() if down else key.asc(), *(x.desc() if reverse else x.asc() for x in ties)]


def sorted_files(files: DataFrame, **how) -> DataFrame:
    """Files in their ``file_order``."""
    return files.orderBy(*file_order(**how))


def human_size(n: Column, units: str = "KMGTP") -> Column:
    """Bytes as du -h shows them: up to one digit after the point, rounded up, in powers of 1024; the last of the units is for all that is larger."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for i, unit in enumerate(units, 1):
        x = n / float(1024**i)
        shown = F.when(x < 10, F.format_string("%.1f", F.ceil(x * 10) / 10)).otherwise(F.ceil(x).cast("string"))
        out = F.when(n >= 1024**i, F.concat(shown, F.lit(unit))).otherwise(out)
    return out


def completions(paths: DataFrame, bookmarks: DataFrame, path: str = "path") -> DataFrame:
    """(path, place) in order: the bookmarks that lie below one of the paths first, then the paths, each by name, numbered from 1."""
    step = F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.length(path)), lambda i: F.when(F.substring(path, i, 1) == "/", F.left(path, i - 1))), lambda x: x.isNotNull()))
    above = bookmarks.select(path, step.alias("_above")).join(paths.select(F.col(path).alias("_above")), "_above", "left_semi").select(path).distinct()
    both = above.withColumn("_rank", F.lit(0)).union(paths.select(path).withColumn("_rank", F.lit(1)))
    return numbered(both, ["_rank", path], "place").orderBy("place").select(path, "place")


def natural_array(a: Column) -> Column:
    """The strings of an array in natural order."""
    keyed = F.transform(a, lambda x: F.struct(natural_key(x).alias("key"), x.alias("value")))
    return F.transform(F.array_sort(keyed), lambda x: x["value"])


def next_number(df: DataFrame, key: str, name: Column) -> DataFrame:
    """One more than the largest number at the end of a group's names, 0 if there is none."""
    number = F.regexp_extract(name, r"(\d+)$", 1)
    return df.groupBy(key).agg(F.coalesce(F.max(F.when(number != "", number.cast("long"))) + 1, F.lit(0)).alias("next_number"))
