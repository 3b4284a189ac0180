"""What the query modules share: the two tables of queries, and tables and scratch folders of a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.shared import scratch  # noqa: F401

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query (spark, sf_dir) under its name, with its SQL counterpart."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_links(pages):
    """(path, name, content) of pages: their links as [[name]], each tag on a line of its own, and the first word of the title as name."""
    content = F.regexp_replace(F.regexp_replace("html", 'href="/([^"]*)"', "[[$1]]"), "<", "\n<")
    return pages.select(F.col("page_id").alias("path"), F.regexp_extract("html", "<title>([^ <]*)", 1).alias("name"), content.alias("content"))


#: The same in SQL.
NOTES = """notes AS (SELECT page_id AS path, regexp_extract(html, '<title>([^ <]*)', 1) AS name, replace(regexp_replace(html, 'href="/([^"]*)"', '[[\\1]]', 'g'), '<', chr(10) || '<') AS content FROM pages)"""


def sql_cut(x: str, n: int) -> str:
    """SQL that cuts at n bytes, between characters, with an ellipsis."""
    return f"CASE WHEN strlen({x}) > {n} THEN left({x}, list_max(list_filter(range(0, {n} + 1), lambda n: strlen(left({x}, n)) <= {n}))) || '…' ELSE {x} END"
