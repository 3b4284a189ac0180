"""Rule tables joined to rows: versions, arguments, scopes and suppressions; ``matching`` has wildcards, prefixes and spellings.

Rule tables are joined as data, and Spark chooses how by their size in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scans


def new_features(tokens: DataFrame, rules: DataFrame, low: Column) -> DataFrame:
    """Tokens (name) whose rule (name, versions array<struct<ver, flag>>) lacks the feature in a version from ``low`` on: the first such version."""
    joined = tokens.join(rules.withColumn("_key", F.lower("name")).drop("name"), F.lower(tokens["name"]) == F.col("_key")).drop("_key")
    missing = F.filter("versions", lambda v: ~v["flag"] & (v["ver"] >= low))
    return joined.withColumn("missing_until", F.try_element_at(missing, F.lit(1))["ver"]).where("missing_until is not null").drop("versions")


def removed_features(tokens: DataFrame, rules: DataFrame, high: Column) -> DataFrame:
    """Tokens whose rule has a version up to ``high``: deprecated (flag false) and removed (flag true), the first of each."""
    joined = tokens.join(rules.withColumn("_key", F.lower("name")).drop("name"), F.lower(tokens["name"]) == F.col("_key")).drop("_key")
    first = lambda flag: F.try_element_at(F.filter("versions", lambda v: (v["flag"] == flag) & (v["ver"] <= high)), F.lit(1))["ver"]
    return joined.withColumn("deprecated", first(False)).withColumn("removed", first(True)).where("deprecated is not null or removed is not null").drop("versions")


def unsuppressed(df: DataFrame, key: str, order: str, off: Column, on: Column) -> DataFrame:
    """Rows outside suppression: an off row suppresses what follows it in its group until the next on row, or to the end."""
    rows = scans.scan(df, key, order, {"_off": scans.latest(F.when(off, F.lit(True)).when(on, F.lit(False)))})
    return rows.where(~F.coalesce("_off", F.lit(False))).drop("_off")


def has_repeats(a: Column) -> Column:
    return F.size(a) != F.size(F.array_distinct(a))


def argument_rules(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls (name, args) that a rule (name, position from 1, value) forbids: the argument there is the value, or is given at all if the value is null."""
    joined = calls.join(rules.withColumn("_key", F.lower("name")).drop("name"), F.lower(calls["name"]) == F.col("_key")).drop("_key")
    given = F.size("args") >= F.col("position")
    return joined.where(given & (F.col("value").isNull() | (F.try_element_at("args", F.col("position")) == F.col("value"))))


def inside_spans(rows: DataFrame, key: str, order: str, opens: Column, closes: Column, name: str = "opened_at") -> DataFrame:
    """The place of the row that opened the span a row lies in, null outside; a span goes from an opening row to the next closing one (``inside_nested`` is for spans that nest).

    The last opening or closing row so far decides, so no row is paired with the spans of its group.
    """
    state = lambda open_: F.struct(F.lit(open_).alias("open"), F.col(order).alias("at"))
    found = scans.scan(rows, key, order, {"_last": scans.latest(F.when(closes, state(False)).when(opens, state(True)))})
    return found.withColumn(name, F.when(F.col("_last.open") & ~closes, F.col("_last.at"))).drop("_last")


def inside_nested(rows: DataFrame, key: str, order: str, opens: Column, closes: Column, name: str = "opened_at") -> DataFrame:
    """The place of the row that opened the innermost span around each row, null outside; spans may nest.

    A closing row ends the innermost open span, if there is one. Opening and closing rows lie in the span around their own. Rows get their depth by a
    running sum; the last opening row of that depth decides, so no row is paired with the spans of its group.
    """
    placed = depths(rows, key, order, opens, closes)
    # an opening row stands at its own depth as an opener and one further out as a row
    both = F.when(F.col("_opens"), F.array(F.struct((F.col("_depth") - 1).alias("level"), F.lit(False).alias("opener")), F.struct(F.col("_depth").alias("level"), F.lit(True).alias("opener"))))
    split = placed.withColumn("_at", F.explode(F.coalesce(both, F.array(F.struct(F.col("_depth").alias("level"), F.lit(False).alias("opener"))))))
    # key and level in one column, as a scan has one key
    split = split.withColumn("_level", F.struct(F.col(key).alias("key"), F.col("_at.level").alias("level")))
    found = scans.scan(split, "_level", order, {"_last": scans.latest(F.when(F.col("_at.opener"), F.col(order)))})
    return found.withColumn(name, F.when(F.col("_at.level") > 0, F.col("_last"))).where(~F.col("_at.opener")).drop("_opens", "_depth", "_at", "_level", "_last")


def depths(rows: DataFrame, key: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """rows with ``_opens``, whether a row opens a span, and ``_depth``, how many spans are open after it; closing rows without an open span count for nothing."""
    closing = F.coalesce(closes, F.lit(False))
    opening = F.coalesce(opens, F.lit(False)) & ~closing
    placed = scans.scan(rows.withColumn("_opens", opening), key, order, {"_sum": scans.total(F.when(closing, -1).when(opening, 1).otherwise(0))}, inclusive=True)
    placed = scans.scan(placed, key, order, {"_low": scans.least(F.col("_sum"))}, inclusive=True)
    return placed.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.col("_low"))).drop("_sum", "_low")


def inside_scopes(rows: DataFrame, scopes: DataFrame, key: str, order: str, name: str = "opened_at") -> DataFrame:
    """The opener of the innermost of the given scopes (key, opener, closer), properly nested, that each row lies strictly between; null outside."""
    some = scopes.where("opener < closer")
    edge = lambda at, turn: some.select(F.col(key), F.struct(F.col(at).alias("at"), F.lit(turn).alias("turn")).alias("_place"))
    # at one place scopes end before and begin after the row there
    all_ = rows.withColumn("_place", F.struct(F.col(order).alias("at"), F.lit(1).alias("turn"))).unionByName(edge("closer", 0).unionByName(edge("opener", 2)), allowMissingColumns=True)
    found = inside_nested(all_, key, "_place", F.col("_place.turn") == 2, F.col("_place.turn") == 0, name)
    return found.where("_place.turn = 1").withColumn(name, F.col(name)["at"]).drop("_place")


def balanced(text: Column, regex: str, args: Column) -> Column:
    """Are there as many placeholders in the text as arguments; a doubled sign is none."""
    return F.regexp_count(F.regexp_replace(text, "%%", ""), F.lit(regex)) == F.size(args)


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def suppressed_files(markers: DataFrame, file: str, order: str, kind: str, codes: str, wanted: list[str]) -> DataFrame:
    """(file): files with a disable marker for one of the wanted codes and no later enable marker for them.

    A marker without codes is for all. Only what follows the last matching disable marker of a file decides, in one aggregate.
    """
    ours = F.coalesce(F.size(codes) == 0, F.lit(True)) | F.arrays_overlap(codes, F.array(*map(F.lit, wanted)))
    last = lambda k: F.max(F.when((F.col(kind) == k) & ours, F.col(order)))
    return markers.groupBy(file).agg(last("disable").alias("_off"), last("enable").alias("_on")).where("_off is not null and (_on is null or _on < _off)").select(file)


def verified_in_scope(rows: DataFrame, scope: str, order: str, check: Column, closed: Column, mode: Column) -> DataFrame:
    """``verified``: has a row's scope a checking row outside closed scopes within it: before the row, or anywhere if the row's mode is ``after``.

    The first such row of each scope is found in one aggregate and joined back, so no window holds a scope.
    """
    first = rows.where(check & ~closed).groupBy(F.col(scope).alias("_scope")).agg(F.min(order).alias("_first"))
    found = F.when(mode == "after", F.col("_first").isNotNull()).otherwise(F.coalesce(F.col("_first") < F.col(order), F.lit(False)))
    return rows.join(first, F.col(scope).eqNullSafe(F.col("_scope")), "left").withColumn("verified", found).drop("_scope", "_first")


def repeated_in_scope(rows: DataFrame, key: list[str], condition: Column, least: int = 2) -> DataFrame:
    """The scopes (columns ``key``, the level among them) with ``least`` or more rows that meet the condition."""
    return rows.where(condition).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*key)


def findings(df: DataFrame, checks: list[tuple[str, Column]], stop: tuple[str, ...] = ()) -> DataFrame:
    """A row with ``finding`` for each check that holds; after one of ``stop`` no later check counts."""
    found, open_ = [], F.lit(True)
    for name, condition in checks:
        holds = F.coalesce(condition, F.lit(False)) & open_
        found.append(F.when(holds, F.lit(name)))
        if name in stop:
            open_ = open_ & ~holds
    return df.withColumn("finding", F.explode(F.array_compact(F.array(*found))))


def slug_findings(df: DataFrame, column: str, reserved: list[str], prefix: str, most: int = 20) -> DataFrame:
    """What is wrong with slugs: characters other than small letters, digits, - and _; a reserved name, or else a reserved prefix in any case; more than ``most`` bytes."""
    s = F.col(column)
    taken = s.isin(reserved) if reserved else F.lit(False)
    return findings(df, [("InvalidCharacters", ~s.rlike(r"^[a-z0-9_-]+$")), ("Reserved", taken), ("ReservedPrefix", F.lower(s).startswith(prefix.lower()) & ~taken), ("TooLong", F.octet_length(s) > most)])


def prefix_findings(df: DataFrame, column: str, blocked: list[str], least: int = 4) -> DataFrame:
    """What is wrong with prefixes: blocked in any case, else fewer than ``least`` characters, else not the beginning of a name."""
    s = F.col(column)
    checks = [("ForbiddenPrefixPassed", F.lower(s).isin([x.lower() for x in blocked]) if blocked else F.lit(False)), ("ShortPrefixPassed", F.length(s) < least), ("InvalidPrefixPassed", ~s.rlike(r"^[a-zA-Z_\x80-\x{10FFFF}][a-zA-Z0-9_\x80-\x{10FFFF}\\]*$"))]
    return findings(df, checks, ("ForbiddenPrefixPassed", "ShortPrefixPassed"))


def least_of(a: Column) -> Column:
    """The least of a list, null if it is empty."""
    return F.array_min(a)


def keys_if_any(df: DataFrame, entries: Column, restricted: list[str]) -> DataFrame:
    """(row, key) for every key of the map of rows that have one of the restricted keys."""
    keys = F.map_keys(entries)
    return df.where(F.arrays_overlap(keys, F.array(*map(F.lit, restricted)))).withColumn("key", F.explode(keys))
