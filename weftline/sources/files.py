"""Readers for folders of notes, listings, feeds, lists and configuration, all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import glob_regex, stem
from .toml import TomlSource


def notes(spark, folder: str, glob: str = "*.md", deep: bool = True) -> DataFrame:
    """(path, name, content) of the text files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(deep).lower()).load(folder)
    return files.select("path", F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "").alias("name"), F.decode("content", "UTF-8").alias("content"))


def daily_notes(spark, folder: str) -> DataFrame:
    """Notes of one folder whose name is ten characters like a date; the pattern asks for no digits."""
    return notes(spark, folder, "????-??-??.md", deep=False)


def listing(spark, folder: str, glob: str = "*") -> DataFrame:
    """(path, relative, depth, name, extension, length, modified) of all files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    root = folder.rstrip("/").removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + "/*" + root.lstrip("/") + "/", "")
    return files.select("path", relative.alias("relative"), (F.size(F.split(relative, "/")) - 1).alias("depth"), stem(F.col("path")).alias("name"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension"), "length", F.col("modificationTime").alias("modified"))


def flat(files: DataFrame, level: int) -> DataFrame:
    """Files down to a depth; -1 is all."""
    return files if level < 0 else files.where(F.col("depth") <= level)


def lines_of(spark, path: str) -> DataFrame:
    """(value) of a list with one entry per line, blank ones left out."""
    return spark.read.text(path).where(F.trim("value") != "")


def feed_urls(spark, path: str) -> DataFrame:
    """(url) of the enclosures of a feed; items without one are left out."""
    items = spark.read.format("xml").option("rowTag", "item").schema("enclosure struct<_url string>").load(path)
    return items.select(F.col("enclosure._url").alias("url")).where("url is not null")


def scraped_urls(spark, path: str) -> DataFrame:
    """(url) from lines that hold url="...": the last of a line; apostrophes count as quotes."""
    line = F.translate("value", "\r'", '\n"')
    return spark.read.text(path).select(F.regexp_extract(line, 'url="([^"]*)"(?!.*url=")', 1).alias("url")).where("url <> ''")


def themes(spark, folder: str, glob: str = "*.toml") -> DataFrame:
    """(name, key, value) of every leaf of the TOML files of a folder: sparse blocks just have no rows."""
    spark.dataSource.register(TomlSource)
    return spark.read.format("toml").option("pathGlobFilter", glob).load(folder).select(stem(F.col("path")).alias("name"), "key", "value")


def excluded(files: DataFrame, column: str, globs: list[str]) -> DataFrame:
    """Files that no exclusion glob matches."""
    return files.where(~F.col(column).rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))) if globs else files


def metadata(spark, path: str, files: DataFrame, schema: str, key: str) -> DataFrame:
    """files with what a JSON store knows of them; null where it knows nothing."""
    return files.join(spark.read.schema(schema).json(path), key, "left")


def nearest_metadata(files: DataFrame, stores: DataFrame, path: str, fields: list[str], deep: bool = True) -> DataFrame:
    """files with the fields that stores (folder, entry, fields) have for them: a store's entry is a path relative to its folder.

    Only the store of a file's own folder is looked at, or with ``deep`` those of all folders above it; each field comes from the nearest store that has a value for it. Folders have
    no slash at their end, the root is an empty string. A file gives a key for each folder above it, and keys meet by equality; a null path has no metadata.
    """
    steps = F.split(F.col(path), "/")
    n = F.size(steps)
    depth = F.sequence(F.lit(1), n - 1) if deep else F.array(n - 1)
    above = files.where(F.instr(path, "/") > 0).select(path, F.explode(depth).alias("_depth"), steps.alias("_steps")).distinct()
    keyed = above.select(path, "_depth", F.array_join(F.slice("_steps", 1, F.col("_depth")), "/").alias("folder"), F.array_join(F.slice("_steps", F.col("_depth") + 1, F.size("_steps")), "/").alias("entry"))
    met = keyed.join(stores.select("folder", "entry", *fields), ["folder", "entry"])
    best = met.groupBy(path).agg(*(F.max_by(x, F.when(F.col(x).isNotNull(), F.col("_depth"))).alias(x) for x in fields))
    return files.join(best, path, "left")


def lint_config(spark, path: str) -> DataFrame:
    """(kind, value) of an XML rule configuration, each once: its exclude patterns, the rules that it refers to (rule), and their properties (property, as rule:name=value)."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    globs = read("exclude-pattern", "_VALUE string").select(F.lit("exclude").alias("kind"), F.trim("_VALUE").alias("value"))
    rules = read("rule", "_ref string, properties struct<property array<struct<_name string, _value string>>>")
    refs = rules.select(F.lit("rule").alias("kind"), F.col("_ref").alias("value"))
    entries = rules.select("_ref", F.explode("properties.property").alias("p"))
    properties = entries.select(F.lit("property").alias("kind"), F.concat("_ref", F.lit(":"), F.col("p._name"), F.lit("="), F.col("p._value")).alias("value"))
    return globs.union(refs).union(properties).where("value <> ''").distinct()


def without_excluded(files: DataFrame, column: str, config: DataFrame) -> DataFrame:
    """Files that no exclusion of a configuration matches, as a whole."""
    globs = [r["value"] for r in config.where("kind = 'exclude'").select("value").collect()]  # a configuration is a short list
    return excluded(files, column, globs)
