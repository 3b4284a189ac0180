"""Chat formatting by perspective rotation.

For every participant of a dialogue the dialogue is rendered with that speaker as assistant and the others as named users; the loss
mask covers what the assistant says. Turns are first rendered in blocks of ``block_turns`` turns (``rotate_blocks``), wherever a dialogue is long, and then
the blocks of a dialogue are put together in order (``rotate``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common as c
from .hilbert_shards import positions

#: Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _plain(x):
    """Text that cannot begin or end a turn of the template."""
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def rotate_blocks(conversations: DataFrame, block_turns: int = 64, system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row per conversation, participant and block: conv_id, perspective, block, n_turns, n_assistant_turns, n_chars, text, spans.

    The texts of a dialogue's blocks, one after the other, are its rendering; spans are the assistant's stretches in code points of the block's
    text. No task holds more than a block. Further statements at ``rotate``.
    """
    role = F.translate(_plain(F.coalesce("role", F.lit("unknown"))), "\r\n", "  ")
    turns = conversations.select("conv_id", F.coalesce("turn", F.lit((1 << 63) - 1)).alias("turn"), role.alias("role"), _plain(F.coalesce("text", F.lit(""))).alias("text"))
    turns = turns.withColumn("_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))  # no number is an empty string
    placed = positions(turns, ["_key", "turn", "role", "text"], "turns").drop("n_rows")
    said = F.when(~F.col("role").isin(*system_roles), F.col("role"))
    views = placed.groupBy("_key").agg(F.min("position").alias("first"), F.count("*").alias("n"), F.collect_set(said).alias("speakers"))
    counts = views.select("_key", "n")
    total = placed.count()
    rows = c.skew_join(placed, views.drop("n"), ["_key"], counts, total, ["position"])
    rows = rows.withColumn("perspective", F.explode("speakers"))
    own = F.col("role") == F.col("perspective")
    head = F.when(own, f"{OPEN}assistant\n").when(F.col("role").isin(*system_roles), F.concat(F.lit(f"{OPEN}system\n"))).otherwise(F.concat(F.lit(f"{OPEN}user name="), F.col("role"), F.lit("\n")))
    place = F.col("position") - F.col("first")
    rows = rows.select("conv_id", "perspective", F.floor(place / block_turns).cast("long").alias("block"), place.alias("at"), head.alias("head"), F.concat("text", F.lit(CLOSE)).alias("body"), own.alias("own"))
    parts = rows.groupBy("conv_id", "perspective", "block").agg(F.sort_array(F.collect_list(F.struct("at", "head", "body", "own"))).alias("p"))  # block_turns at most
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<lo:long,hi:long>>").alias("spans"))

    def step(acc, x):
        lo = acc["n"] + F.length(x["head"])
        hi = lo + F.length(x["body"])
        span = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
        return F.struct(hi.cast("long").alias("n"), F.when(x["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"])), "")
    done = parts.select(
        "conv_id", "perspective", "block", F.size("p").cast("long").alias("n_turns"), F.size(F.filter("p", lambda x: x["own"])).cast("long").alias("n_assistant_turns"), text.alias("text"), F.aggregate("p", start, step).alias("x"),
    )
    return done.select("conv_id", "perspective", "block", "n_turns", "n_assistant_turns", F.col("x.n").alias("n_chars"), "text", F.col("x.spans").alias("spans"))


def rotate(conversations: DataFrame, block_turns: int = 64, system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row per conversation and participant: conv_id, perspective, n_turns, n_assistant_turns, text, mask.

    mask lists the assistant's stretches as start-end in code points of text, joined by commas. Turns are ordered by turn (null
    last), role and text; rows that repeat are turns of their own. A null role is the speaker ``unknown``, a null text is empty, rows without
    conv_id form one dialogue. System turns keep their place in every rendering but are no participant: a dialogue of them alone gives no
    row. ``<|`` in texts and roles becomes ``< |`` and line ends in roles blanks, so that no turn can pose as another. An empty table gives an empty table.
    A row holds a whole rendering, so a dialogue of more than about 1 GB can only be had as ``rotate_blocks``.
    """
    blocks = rotate_blocks(conversations, block_turns, system_roles)
    parts = blocks.groupBy("conv_id", "perspective").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("n_assistant_turns").alias("n_assistant_turns"), F.sort_array(F.collect_list(F.struct("block", "n_chars", "text", "spans"))).alias("p")
    )
    none = F.array().cast("array<long>")
    begins = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("n"), none.alias("at")), lambda acc, x: F.struct((acc["n"] + x["n_chars"]).alias("n"), F.concat(acc["at"], F.array(acc["n"])).alias("at")))["at"]
    shown = lambda at, x: F.transform(x["spans"], lambda s: F.concat((at + s["lo"]).cast("string"), F.lit("-"), (at + s["hi"]).cast("string")))
    spans = F.flatten(F.zip_with(begins, "p", shown))
    return parts.select("conv_id", "perspective", "n_turns", "n_assistant_turns", F.array_join("p.text", "").alias("text"), F.array_join(spans, ",").alias("mask"))


ROTATE_SQL = """
WITH t AS (SELECT conv_id, coalesce(turn, 9223372036854775807) AS turn, translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(13) || chr(10), '  ') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM t),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (SELECT p.conv_id, perspective, place, role = perspective AS own,
        CASE WHEN role = perspective THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10) ELSE '<|im_start|>user name=' || role || chr(10) END AS head,
        text || '<|im_end|>' || chr(10) AS body
      FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY place) AS hi FROM r)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_assistant_turns,
  string_agg(head || body, '' ORDER BY place) AS text,
  coalesce(string_agg(CAST(CAST(hi - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(hi AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective
"""
