"""Tables of patterns joined to names: wildcards, prefixes, spellings.

Patterns are rows, as many as there may be: none becomes part of the plan. Each pattern is known by one piece of its plain text, the *anchor*: all of it if it has no wildcard,
else the beginning of its head or the end of its tail, whichever is longer, else the first characters of its longest plain part. Names give the keys of the
lengths that occur, names and patterns meet by equality of key, and the pairs that meet are confirmed in full. Different names are matched once, however many rows have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ENDS, MIDDLE = 12, 3  # characters of an anchor at an end and in the middle


def _quoted(glob: Column) -> Column:
    """A whole-string regex of globs with * and ?."""
    plain = F.replace(glob, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("^\\Q"), F.replace(F.replace(plain, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("?"), F.lit("\\E.\\Q")), F.lit("\\E$"))


def anchored(patterns: DataFrame, column: str) -> DataFrame:
    """patterns with ``_anchor``: kind (whole, head, tail, middle, any), len and key."""
    g = F.col(column)
    head, tail = F.regexp_extract(g, r"^[^*?]*", 0), F.regexp_extract(g, r"[^*?]*\z", 0)
    inner = F.array_max(F.transform(F.split(g, r"[*?]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    as_ = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.length(key).alias("len"), key.alias("key"))
    whole = F.struct(F.lit("whole").alias("kind"), F.lit(0).alias("len"), g.alias("key"))
    anchor = F.when(~g.rlike(r"[*?]"), whole).when((F.length(head) > 0) & (F.length(head) >= F.length(tail)), as_("head", F.left(head, F.lit(ENDS)))).when(F.length(tail) > 0, as_("tail", F.right(tail, F.lit(ENDS))))
    return patterns.withColumn("_anchor", anchor.when(F.length(inner) > 0, as_("middle", F.left(inner, F.lit(MIDDLE)))).otherwise(as_("any", F.lit(""))))


def _keys(name: Column, shapes: list) -> Column:
    """The keys of a name for the kinds and lengths that anchors have: some thirty at most, and one for each place of a name in the middle."""
    found = []
    for kind, n in sorted(shapes):
        at = {
            "whole": lambda n: F.array(name), "any": lambda n: F.array(F.lit("")), "head": lambda n: F.array(F.left(name, F.lit(n))), "tail": lambda n: F.array(F.right(name, F.lit(n))),
            "middle": lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(n)))),
        }[kind](n)
        keyed = F.arrays_zip(F.transform(at, lambda _: F.lit(kind)).alias("kind"), F.transform(at, lambda _: F.lit(n)).alias("len"), at.alias("key"))  # noqa: B023
        found.append(F.when(F.length(name) >= n, keyed).otherwise(F.slice(keyed, 1, 0)))
    return F.concat(*found)


def meet(names: DataFrame, name: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(name, the columns of patterns): every name that a pattern matches in full, both as they are; nulls match nothing, rows of ``names`` are taken to differ."""
    rules = anchored(patterns.where(F.col(pattern).isNotNull()), pattern).withColumn("_regex", _quoted(F.col(pattern)))
    shapes = [tuple(r) for r in rules.select("_anchor.kind", "_anchor.len").distinct().collect()]  # some thirty
    if not shapes:
        return names.select(name).join(patterns, F.lit(False))
    keyed = names.where(F.col(name).isNotNull()).select(name, F.explode(_keys(F.col(name), shapes)).alias("_anchor"))
    return keyed.join(rules, "_anchor").where(F.rlike(F.col(name), F.col("_regex"))).drop("_anchor", "_regex")


def wildcard_matches(tokens: DataFrame, column: str, rules: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """(row, group): rows whose column matches a wildcard of rules (group, pattern) and is not in allow (group, name); case is ignored.

    A row gets a group once. A group without patterns and an empty table match nothing, nor does a null.
    """
    names = tokens.select(F.lower(column).alias("_name")).where("_name is not null").distinct()
    hits = meet(names, "_name", rules.select("group", F.lower("pattern").alias("_pattern")), "_pattern").select("_name", "group").distinct()
    if allow is not None:
        hits = hits.join(allow.select("group", F.lower("name").alias("_name")).distinct(), ["_name", "group"], "left_anti")
    found = hits.groupBy("_name").agg(F.collect_set("group").alias("_groups"))  # the groups of one name
    return tokens.withColumn("_name", F.lower(column)).join(found, "_name").withColumn("group", F.explode("_groups")).drop("_name", "_groups")


def first_prefix(df: DataFrame, column: str, rules: DataFrame, name: str = "prefix") -> DataFrame:
    """The prefix of least ``rank`` among rules (prefix, rank) that the column begins with, case ignored; null if there is none, as in an empty table."""
    names = df.select(F.lower(column).alias("_name")).where("_name is not null").distinct()
    keyed = rules.where("prefix is not null").select("prefix", "rank", F.lower("prefix").alias("_low")).withColumn("_key", F.left("_low", F.lit(ENDS))).withColumn("_len", F.length("_key"))
    lengths = [r[0] for r in keyed.select("_len").distinct().collect()]  # ENDS and one
    begins = F.transform(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: F.when(F.length("_name") >= n, F.struct(n.alias("_len"), F.substr(F.col("_name"), F.lit(1), n).alias("_key"))))
    met = names.select("_name", F.explode(F.array_compact(begins)).alias("x")).select("_name", "x.*").join(keyed, ["_len", "_key"]).where(F.startswith("_name", "_low"))
    best = met.groupBy("_name").agg(F.min_by("prefix", F.struct("rank", "prefix")).alias(name))
    return df.withColumn("_name", F.lower(column)).join(best, "_name", "left").drop("_name")


def wrong_case(df: DataFrame, column: str, spellings: DataFrame) -> DataFrame:
    """Rows whose column is a spelling but for its case, with that of least rank of spellings (canonical, rank)."""
    known = spellings.where("canonical is not null").groupBy(F.lower("canonical").alias("_low")).agg(F.min_by("canonical", F.struct("rank", "canonical")).alias("canonical"))
    return df.join(known, F.lower(df[column]) == F.col("_low")).where(F.col("canonical") != F.col(column)).drop("_low")
