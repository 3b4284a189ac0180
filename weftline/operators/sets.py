"""Set operations and seen-logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unseen(items: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Items whose key is not in the log. Keys are compared as a whole: one that begins another is not the same."""
    return items.join(log.select(key), key, "left_anti")


def merge_log(log: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The log with the new keys, each once. Write it to another path than the one it was read from."""
    return log.select(key).union(fresh.select(key)).distinct()


def sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are only in a, only in b, and in both."""
    both = a.select(key).distinct().withColumn("in_a", F.lit(True)).join(b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full")
    return both.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("common"))


def zip_changes(old: DataFrame, new: DataFrame, order: str, name: str) -> DataFrame:
    """(order, old, new) where the rows of the same place differ; what the shorter list lacks is left out."""
    return old.select(order, F.col(name).alias("old")).join(new.select(order, F.col(name).alias("new")), order).where("old <> new")


def new_parents(changes: DataFrame, folders: DataFrame, new: str = "new", folder: str = "folder") -> DataFrame:
    """(folder): the folders of changed names that do not exist yet, each once; a name without a folder has none."""
    base = F.regexp_extract(new, r"^(.*[^/])/+[^/]*$", 1)
    return changes.select(base.alias(folder)).where(F.col(folder) != "").distinct().join(folders.select(folder), folder, "left_anti")


def retagged(tags: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """tags under the new keys of changes (old, new); the tag of a renamed key goes before one that the new key had."""
    moves = changes.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    moved = tags.join(moves, F.col(key) == F.col("_old"), "left").withColumn("_moved", F.col("_new").isNotNull()).withColumn(key, F.coalesce("_new", key))
    others = [x for x in tags.columns if x != key]
    last = moved.groupBy(key).agg(F.max_by(F.struct(*others), "_moved").alias("_x"))
    return last.select(*(F.col(key) if x == key else F.col(f"_x.{x}").alias(x) for x in tags.columns))


def appended(*lists: DataFrame) -> DataFrame:
    """All rows of all lists, in any order, repeated ones too; columns by name."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


def overlaid(base: DataFrame, *custom: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value): of each key the value of the last table that has the key with a value."""
    ranked = appended(*(x.select(key, value, F.lit(i).alias("_rank")) for i, x in enumerate((base, *custom)))).where(F.col(value).isNotNull())
    return ranked.groupBy(key).agg(F.max_by(value, "_rank").alias(value))


def merged_lists(custom: Column, base: Column) -> Column:
    """A map of names to false of a custom list and those of a base map whose value is not false; the base goes first, and a name counts once."""
    kept = F.map_filter(F.coalesce(base, F.create_map().cast("map<string,boolean>")), lambda k, v: v)
    new = F.array_except(F.array_distinct(F.coalesce(custom, F.array().cast("array<string>"))), F.map_keys(kept))
    return F.map_concat(F.transform_values(kept, lambda k, v: v & ~F.array_contains(F.coalesce(custom, F.array().cast("array<string>")), k)), F.map_from_arrays(new, F.transform(new, lambda k: F.lit(False))))


def begins_with(found: Column, bare: Column) -> Column:
    """Does a list begin with another."""
    return F.slice(found, 1, F.size(bare)) == bare


def pattern_union(*lists: Column) -> Column:
    """One regex of all patterns of lists, each once, in order of first mention."""
    return F.array_join(F.array_distinct(F.concat(*lists)), "|")


def saved_set(df: DataFrame, key: str, path: str) -> None:
    """Write a set as text, one entry per line."""
    df.select(F.col(key).cast("string").alias("value")).distinct().write.mode("overwrite").text(path)


def loaded_set(spark, path: str, existing: DataFrame, key: str) -> DataFrame:
    """(key): the entries of a saved set that still exist."""
    return spark.read.text(path).select(F.col("value").alias(key)).distinct().join(existing.select(key), key, "left_semi")


def changed_content(fresh: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """(key, hash): the keys whose content has another hash than the one stored (key, hash), or none."""
    now = fresh.select(key, F.sha2(F.col(content), 256).alias("hash"))
    old = stored.select(F.col(key).alias("_key"), F.col("hash").alias("_hash"))
    return now.join(old, F.col(key) == F.col("_key"), "left").where(~F.col("hash").eqNullSafe(F.col("_hash"))).select(key, "hash")


def selected(df: DataFrame, picked: DataFrame, key: str) -> DataFrame:
    """Rows whose key is picked; if nothing is picked, all rows."""
    return df.join(picked.select(key), key, "left_semi") if picked.limit(1).count() else df


def tagged(df: DataFrame, tags: DataFrame, key: str, tag: str, wanted: list | None = None) -> DataFrame:
    """Rows with their tag, of the wanted tags only; no list is any tag."""
    some = tags.select(key, tag).where(F.col(tag).isin(wanted)) if wanted else tags.select(key, tag)
    return df.join(some.distinct(), key)

