"""License scans by diagonal voting, on DataFrame functions alone.

Templates are phrases and notices. Every run of k words of a text (2 for phrases, 4 for notices) is looked
up among the templates' runs by a 64-bit hash, and the words themselves are compared. A hit at word ``at`` of the text and word ``t`` of
a template votes for the diagonal ``at - t``. Words that were put in or left out move what follows to a neighbouring diagonal, so
diagonals at most ``shift`` apart become one span, and a span is verified by the share of its template's words that it covers.

Votes belong to texts, not to rows: copies of a text vote for the same diagonals, and votes are sets of template words, so a group of
copies is one entry per task before anything is exchanged. Texts are read twice and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as c

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed values: (label, text) of the phrases; each place of a phrase counts.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
#: Fixed values: (label, text) of notices that are found although some of their words differ.
NOTICES = [
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4", "Licensed under CC BY-NC 4.0"),
]
#: Words in a run of a phrase and of a notice; each is twice the one before.
SIZES = (2, 4)


def _parts(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")


def words(text: Column) -> Column:
    """The words of a text, A to Z lower-cased; null has none."""
    ascii_ = lambda w: F.octet_length(w) == F.length(w)
    return F.transform(_parts(text), lambda w: F.when(ascii_(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def _with_runs(rows: DataFrame, tokens: str) -> DataFrame:
    """``runs``: for each of SIZES, one size after the other, the hash of the run of so many words that begins at each word; runs that end beyond the last word have one too, which no template has."""
    rows = rows.withColumn("_1", F.transform(tokens, lambda w: F.xxhash64(w)))
    for k in SIZES:  # a run is two runs of half its size
        half = F.col(f"_{k // 2}")
        rows = rows.withColumn(f"_{k}", F.zip_with(half, F.slice(half, k // 2 + 1, F.greatest(F.size(half), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    return rows.withColumn("runs", F.concat(*(F.col(f"_{k}") for k in SIZES))).drop("_1", *(f"_{k}" for k in SIZES))


def templates(spark, phrases=None, notices=None) -> DataFrame:
    """(template, label, phrase, k, n_words, tokens) of (label, text) lists; k is the size of its runs, that of its kind or the largest that it has words for. With one word or none it is no template."""
    rows = [(label, text, True, SIZES[0]) for label, text in (PHRASES if phrases is None else phrases)] + [(label, text, False, SIZES[-1]) for label, text in (NOTICES if notices is None else notices)]
    lists = [F.struct(*(F.lit(x).alias(n) for x, n in zip((i, *r), ("template", "label", "text", "phrase", "k"), strict=True))) for i, r in enumerate(rows)]
    none = F.array().cast("array<struct<template:int,label:string,text:string,phrase:boolean,k:int>>")
    table = spark.range(1).select(F.inline(F.array(*lists) if lists else none)).withColumn("tokens", words(F.col("text")))
    table = table.withColumn("n_words", F.size("tokens")).where(F.col("n_words") >= SIZES[0])
    return table.withColumn("k", F.greatest(*(F.when(F.least("k", "n_words") >= k, k) for k in SIZES))).select("template", "label", "phrase", "k", "n_words", "tokens")


def _place(i: Column, n: Column, k: Column) -> Column:
    """The word at which entry i of ``runs`` begins, of a text of n words, if its size is k; outside 0 to n - 1 if it is not."""
    return i - n * F.coalesce(*(F.when(k == x, j) for j, x in enumerate(SIZES)))


def votes(docs: DataFrame, table: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_md5, template, diagonal, places): for each text and diagonal the template words at which runs agree, word for word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _with_runs(docs.select(F.md5(F.encode(text, "UTF-8")).alias("text_md5"), words(text).alias("words")), "words")
    known = _with_runs(table, "tokens").select("template", "k", "n_words", "tokens", F.posexplode("runs").alias("i", "hash")).withColumn("t", _place(F.col("i"), F.col("n_words"), F.col("k")))
    known = known.where((F.col("t") >= 0) & (F.col("t") + F.col("k") <= F.col("n_words"))).select("hash", "k", "template", "t", F.slice("tokens", F.col("t") + 1, F.col("k")).alias("run"))
    # the templates are a parameter, and their runs are as many as their words; outer, as Spark would else make all runs twice to see whether there are some
    hits = rows.select("text_md5", "words", F.posexplode_outer("runs").alias("i", "hash")).join(F.broadcast(known), "hash")
    hits = hits.withColumn("at", _place(F.col("i"), F.size("words"), F.col("k"))).where((F.col("at") >= 0) & (F.slice("words", F.col("at") + 1, F.col("k")) == F.col("run")))
    return hits.groupBy("text_md5", "template", (F.col("at") - F.col("t")).cast("long").alias("diagonal")).agg(F.sort_array(F.collect_set("t")).alias("places"))  # a template's words at most


def spans(found: DataFrame, table: DataFrame, shift: int = 3) -> DataFrame:
    """(text_md5, template, label, phrase, start, end, coverage): votes on neighbouring diagonals merged.

    A phrase's span is one diagonal with all of its runs. A notice's span joins diagonals at most ``shift`` apart; its coverage is the share of the
    notice's words that the agreeing runs cover, or of the span's own words if that is less, so words strewn over a long stretch do not count.
    """
    known = found.join(F.broadcast(table.drop("tokens")), "template")
    by_text = Window.partitionBy("text_md5", "template").orderBy("diagonal")  # no more diagonals than one text has words
    islands = known.where("not phrase").withColumn("fresh", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_text) > shift, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(by_text))
    covered = lambda x, k: F.array_distinct(F.flatten(F.transform(x, lambda t: F.sequence(t, t + k - 1))))
    merged = islands.select("*", F.explode("places").alias("t")).groupBy("text_md5", "template", "label", "phrase", "n_words", "k", "island").agg(
        F.collect_set("t").alias("places"), F.min(F.col("diagonal") + F.col("t")).alias("start"), F.max(F.col("diagonal") + F.col("t") + F.col("k")).alias("end")
    )
    share = F.size(covered(F.col("places"), F.col("k"))) / F.greatest(F.col("n_words"), F.col("end") - F.col("start"))
    notices = merged.select("text_md5", "template", "label", "phrase", "start", "end", share.alias("coverage"))
    whole = known.where((F.col("phrase")) & (F.size("places") == F.col("n_words") - F.col("k") + 1))
    return whole.select("text_md5", "template", "label", "phrase", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_words")).alias("end"), F.lit(1.0).alias("coverage")).union(notices)


def scan(docs: DataFrame, table: DataFrame | None = None, least: float = 0.75, shift: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of rows (id, text), one row each.

    n_base counts the places where a phrase's words stand consecutively, first_word and last_word are the smallest and largest start of one (words from 0,
    null without a place), base_labels their labels. labels has those too and the labels of notices with a span of coverage ``least`` or more; both are
    distinct, sorted and joined by commas. score is the largest coverage of any span, 1 with a phrase, 0 without a run in common. Null and empty
    texts have no words; equal texts get equal results whatever their ids; null and repeated ids stay rows of their own; other columns
    are not read; an empty table gives an empty table. Without templates every text is clean.
    """
    spark = docs.sparkSession
    table = templates(spark) if table is None else table
    found = spans(votes(docs, table, text_col), table, shift)
    base = F.col("phrase")
    per_text = found.groupBy("text_md5").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("coverage") >= least, F.col("label")))), ",").alias("labels"), F.max("coverage").alias("score"),
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = c.saved(docs.select(F.col(id_col).alias("doc_id"), F.md5(F.encode(text, "UTF-8")).alias("text_md5"), F.size(_parts(text)).cast("long").alias("n_words")), "license-rows")
    counts = rows.groupBy("text_md5").agg(F.count("*").alias("n"))
    total = rows.count()
    done = c.skew_join(rows, per_text, ["text_md5"], counts, total, ["doc_id", "n_words"], "left") if total else rows.join(per_text, "text_md5", "left")
    return done.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
