"""Row predicates: pattern modes, a filter stack, first-match rules, fields and line classes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import glob_body


def pattern(column: Column, text: str, mode: str = "literal", case: str = "sensitive", invert: bool = False) -> Column:
    """Is the pattern found in the column: mode literal, regex, glob or letters (its letters in order with anything between).

    case is sensitive, ignore or smart (ignored if the pattern has letters and no capital). A leading ^ and a trailing $ are anchors in every mode and nothing else
    is anchored, globs neither. ``.`` alone and a regex that does not compile match everything, inverted too.
    """
    if text == ".":
        return column.isNotNull()
    flags = "(?i)" if case == "ignore" or case == "smart" and text.islower() else ""
    start, end = text.startswith("^"), len(text) > 1 and text.endswith("$") or text == "$"
    core = text[start : len(text) - end]
    if mode == "regex":
        try:
            re.compile(core)
        except re.error:
            return column.isNotNull()
        body = core
    elif mode == "glob":
        body = glob_body(core)
    else:
        body = (".*" if mode == "letters" else "").join(map(re.escape, core))
    if mode == "literal" and not flags and not start and not end:
        match = column.contains(core)  # reaches the scan
    else:
        match = column.rlike(flags + ("^" if start else "") + body + (r"\Z" if end else ""))
    return ~match if invert else match


class FilterStack:
    """Predicates in postfix order, as one Column for the optimiser. An entry is (name, condition, the entries that it joins)."""

    def __init__(self, *entries: tuple):
        self.entries = list(entries)

    def push(self, condition: Column, name: str = "filter") -> FilterStack:
        return FilterStack(*self.entries, (name, condition, ()))

    def add(self, kind: str, *args) -> FilterStack:
        """One of the simple filters of ``simple_filter``."""
        return self.push(simple_filter(kind, *args), " ".join(map(str, [kind, *args])))

    def pop(self) -> FilterStack:
        return FilterStack(*self.entries[:-1])

    def clear(self) -> FilterStack:
        return FilterStack()

    def decompose(self) -> FilterStack:
        """The top one's own parts in its place; a simple filter has none and goes."""
        return FilterStack(*self.entries[:-1], *self.entries[-1][2])

    def rotate(self, n: int = 1) -> FilterStack:
        k = n % len(self.entries) if self.entries else 0
        return FilterStack(*self.entries[len(self.entries) - k :], *self.entries[: len(self.entries) - k])

    def combine(self, how: str) -> FilterStack:
        """``and`` and ``or`` join the two on top, ``not`` turns the top one round."""
        if how == "not":
            top = self.entries[-1]
            return FilterStack(*self.entries[:-1], (f"not ({top[0]})", ~top[1], (top,)))
        a, b = self.entries[-2:]
        return FilterStack(*self.entries[:-2], (f"({a[0]}) {how} ({b[0]})", a[1] & b[1] if how == "and" else a[1] | b[1], (a, b)))

    def show(self) -> list[str]:
        return [name for name, _, _ in self.entries]

    def column(self) -> Column:
        out = F.lit(True)
        for _, condition, _ in self.entries:
            out = out & condition
        return out


def simple_filter(kind: str, value: str = "", name: str = "name", type_: str = "type", mime: str = "mime", digest: str = "hash", count: str = "copies") -> Column:
    """name (regex), mime (regex), type (one of d, f, l), hash (equality), and duplicate and unique, which read the number of rows of a hash (``counted_copies``)."""
    return {
        "name": lambda: F.col(name).rlike(value), "mime": lambda: F.col(mime).rlike(value), "type": lambda: inode_type(F.col(type_), value), "hash": lambda: F.col(digest) == value,
        "duplicate": lambda: F.col(count) > 1, "unique": lambda: F.col(count) == 1,
    }[kind]()


def counted_copies(df: DataFrame, digest: str, count: str = "copies") -> DataFrame:
    """How many rows have each row's hash; counted before they are joined, so that no window holds a hash's rows."""
    n = df.groupBy(F.col(digest).alias("_digest")).agg(F.count("*").alias(count))
    return df.join(n, F.col(digest).eqNullSafe(F.col("_digest"))).drop("_digest")


def inode_type(kind: Column, letters: str) -> Column:
    """Is the type among the letters d, f and l."""
    return kind.isin(list(letters))


def other_kind(kind: Column, current) -> Column:
    """Rows of the other kind than the current one."""
    return kind != F.lit(current)


def not_named(name: Column, current: str) -> Column:
    return name != F.lit(current)


def visible(name: Column, hidden: list[str]) -> Column:
    """Does no hidden-file regex match."""
    return ~name.rlike("|".join(f"(?:{x})" for x in hidden)) if hidden else name.isNotNull()


def field(line: Column, n: int, separator: str | None = None) -> Column:
    """The n-th field of a line, from 1, between separators or else runs of blanks; empty if there is none."""
    parts = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ") if separator is None else F.split(line, re.escape(separator))
    return F.coalesce(F.get(parts, F.lit(n - 1)), F.lit(""))


def flagged_fields(df: DataFrame, line: str, mark: str = "?", n: int = 2) -> DataFrame:
    """(field): the n-th field of the lines that begin with a mark."""
    return df.where(F.col(line).startswith(mark)).select(field(F.col(line), n).alias("field"))


def threshold_format(value: Column, bound, low: str, high: str) -> Column:
    """The format for values below a bound, or the other."""
    return F.when(value < bound, low).when(value.isNotNull(), high)


def first_state(states: list[tuple[Column, Column | str]], default: Column | str) -> Column:
    """The label of the first state that holds."""
    label = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.coalesce(*(F.when(c, label(x)) for c, x in states), label(default))


def typed_rules(df: DataFrame, rules: DataFrame, columns: dict[str, str], name: str = "action", known: dict[str, list[str]] | None = None) -> DataFrame:
    """The action of the first rule, by number, all of whose conditions hold for a row; null if none does.

    ``rules`` has rule_no, conditions array<struct<kind, pattern, negate>> and action. Kinds in ``columns`` (match, ext, mime, name, path and so
    on) are regexes on that column, ``file`` and ``directory`` read the column ``type``, kinds in ``known`` (has, env) ask if the pattern is in a list, ``else`` always holds
    and number, label, flag are no conditions. Rules are joined as data; a row meets the rules in order of their number in one array.
    """
    r = F.struct("rule_no", "conditions", "action")
    every = rules.agg(F.sort_array(F.collect_list(r))).scalar()  # a rule table is small by its nature
    kind_is = lambda c, k: c["kind"] == F.lit(k)

    def holds(c):
        tests = [F.when(kind_is(c, k), F.regexp_like(F.coalesce(F.col(v), F.lit("")), c["pattern"])) for k, v in columns.items()]
        tests += [F.when(kind_is(c, k), F.coalesce(F.col("type") == F.lit(k[0]), F.lit(False))) for k in ("file", "directory") if "type" in df.columns]
        tests += [F.when(kind_is(c, k), c["pattern"].isin(v) if v else F.lit(False)) for k, v in (known or {}).items()]
        true = F.when(c["kind"].isin("else", "number", "label", "flag"), F.lit(True))
        found = F.coalesce(true, *tests, F.lit(False))
        return F.when(c["negate"], ~found).otherwise(found)

    rows = df.withColumn("_rules", every)
    first = F.get(F.filter("_rules", lambda x: F.forall(x["conditions"], holds)), F.lit(0))
    return rows.withColumn(name, first["action"]).drop("_rules")


def first_match(df: DataFrame, rules: list[tuple[Column, str]], name: str, default: str | None = None) -> DataFrame:
    """The action of the first rule whose condition holds, in order."""
    out = F.lit(default)
    for condition, action in reversed(rules):
        out = F.when(condition, action).otherwise(out)
    return df.withColumn(name, out)


def line_class(line: Column) -> Column:
    """header, list, link, bold or content: the first pattern that fits."""
    return (
        F.when(line.rlike(r"^#+\s"), "header").when(line.rlike(r"^\s*[-*]\s") | line.rlike(r"^\s*\d+\.\s"), "list").when(line.rlike(r"\[\[.+\]\]") | line.rlike(r"\[.+\]\("), "link")
        .when(line.rlike(r"\*\*.+\*\*") | line.rlike("__.+__"), "bold").otherwise("content")
    )
