"""Texts as numbered lines, and what follows from their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import cut_bytes, trimmed
from . import scans


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).select(key, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def search(df: DataFrame, key: str, text: str, regex: str) -> DataFrame:
    """The lines that match, with their numbers; texts without a match are left out before they are split."""
    return lines(df.where(F.col(text).rlike(regex)), key, text).where(F.col("line").rlike(regex))


def running_count(numbered: DataFrame, key: str, condition: Column, name: str) -> DataFrame:
    """How many lines so far, this one included, meet the condition."""
    return scans.scan(numbered, key, "line_no", {name: scans.count(condition)}, inclusive=True)


def first_content(numbered: DataFrame, key: str, n: int = 80) -> DataFrame:
    """(key, preview): the first line, trimmed, with text outside front matter, which every line that begins with --- opens or closes.

    Headings and lines that begin with [[ and end with ]] are passed over; a longer line is cut after ``n`` bytes, but within no character.
    """
    marked = running_count(numbered, key, F.col("line").startswith("---"), "marks").withColumn("line", trimmed(F.col("line")))
    body = marked.where((F.col("marks") % 2 == 0) & ~F.col("line").startswith("---") & (F.col("line") != "") & ~F.col("line").rlike(r"^#|^\[\[.*\]\]$"))
    return body.groupBy(key).agg(F.min_by("line", "line_no").alias("line")).select(key, cut_bytes(F.col("line"), n).alias("preview"))


def body_lines(numbered: DataFrame, key: str) -> DataFrame:
    """Lines without front matter, which only a --- on line 1 opens and the next --- closes."""
    fence = F.col("line").startswith("---")
    # a text that line 1 does not open has no front matter; the first line is that of the smallest number
    marked = scans.scan(numbered, key, "line_no", {"_opens": scans.earliest(fence), "_marks": scans.count(fence)}, inclusive=True)
    inside = F.coalesce(F.col("_opens"), F.lit(False)) & ((F.col("_marks") < 2) | (F.col("_marks") == 2) & fence)
    return marked.where(~inside).drop("_opens", "_marks")


def in_fence(numbered: DataFrame, key: str) -> DataFrame:
    """Is an odd number of lines before this one a code fence."""
    before = scans.scan(numbered, key, "line_no", {"in_fence": scans.count(F.col("line").startswith("```"))})
    return before.withColumn("in_fence", F.col("in_fence") % 2 == 1)


def wrap(df: DataFrame, key: str, text: str, width: int = 80) -> DataFrame:
    """(key, wrapped): words put on lines of at most width characters as they come; a longer word has a line of its own."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("rows"), F.lit("").alias("row"))

    def step(acc, word):
        full = (acc["row"] != "") & (F.length(acc["row"]) + 1 + F.length(word) > width)
        longer = F.when(acc["row"] == "", word).otherwise(F.concat(acc["row"], F.lit(" "), word))
        return F.struct(F.when(full, F.concat(acc["rows"], F.array(acc["row"]))).otherwise(acc["rows"]).alias("rows"), F.when(full, word).otherwise(longer).alias("row"))

    return df.select(key, F.aggregate(words, start, step, lambda acc: F.array_join(F.concat(acc["rows"], F.array(acc["row"])), "\n")).alias("wrapped"))


def joined_blocks(df: DataFrame, key: str, order: str, ties: list[str], line: Column, name: str, block: int = 64, stretch: int = 1024) -> DataFrame:
    """(key, block, n_lines, name): the lines of each key in order (null last, then ``ties``), joined by line feeds in blocks of ``block`` rows by position.

    Blocks joined in order by a line feed are the whole, so no row or task holds a key of any length. Positions are counted within stretches
    of ``stretch`` values of the whole number ``order`` and added up over the stretches; only rows that share one value have to be sorted together.
    """
    at = F.coalesce(F.floor(F.col(order) / stretch).cast("long"), F.lit((1 << 63) - 1))
    rows = df.select(F.col(key).alias("_key"), at.alias("_stretch"), F.col(order).alias("_order"), *(F.col(x).alias(f"_tie{i}") for i, x in enumerate(ties)), line.alias("_line"))
    w = Window.partitionBy("_key", "_stretch").orderBy(F.asc_nulls_last("_order"), *(f"_tie{i}" for i in range(len(ties))))
    placed = rows.withColumn("_at", F.row_number().over(w) - 1)
    counts = rows.groupBy(F.col("_key").alias("_key2"), F.col("_stretch").alias("_stretch2")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_key2").orderBy("_stretch2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = placed.join(before, F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("_stretch") == F.col("_stretch2"))).withColumn("_at", F.col("_at") + F.col("_before"))
    parts = whole.groupBy(F.col("_key").alias(key), F.floor(F.col("_at") / block).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct("_at", "_line"))).alias("_p"))  # block at most
    return parts.select(key, "block", F.size("_p").cast("long").alias("n_lines"), F.array_join(F.col("_p._line"), "\n").alias(name))
