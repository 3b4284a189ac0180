"""The prefix trie of conversations, rolled up in depth bands.

A node is known by its depth and the sums of four 32-bit lanes of a digest of each of its turns with their places, so the names of a
conversation's prefixes are running sums: within blocks of turns first, then over the blocks' totals, and no task holds a long conversation. Each
node is sent to its ancestors in its own band of ``height`` depths only. What the roots of bands have so far is then a trie again, of one level
for each band, and is rolled up in the same way: a trie of depth D takes as many rounds as D has digits to the base ``height``. The completed
totals of the roots are added to the band above each, at the root's parent and the parent's ancestors in its band. Two different prefixes get
one name with a probability of 2 to the power -128 a pair.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common as c
from .hilbert_shards import positions

BLOCK, PIECE, MOST = 1024, 512, 9  # turns of a block, ids of a piece, the number of possible lengths of a head
_LANES = [f"s{i}" for i in range(4)]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, role, text, n_rebuilt) of all turns, (conv_id, n_rebuilt)): each conversation with the head of the one whose id is the multiple of five before its own."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = positions(turns, ["conv_id", "turn", "role", "text"], "trie-turns").drop("n_rows")
    found = c.saved(placed.groupBy("conv_id").agg(F.min("position").alias("first"), F.count("*").alias("n")), "trie-conversations")
    head = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(MOST))
    known = found.withColumn("head", head).withColumn("donor", F.expr("conv_id - conv_id % 5"))
    lead = F.least("head", F.coalesce("donor_n", F.lit(0)))
    known = known.join(found.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n")), "donor", "left").withColumn("lead", lead).withColumn("n_rebuilt", F.col("lead") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    known = c.saved(known.select("conv_id", "donor", "first", "n", "head", "lead", "n_rebuilt"), "trie-known")
    own = c.skew_join(placed, known, ["conv_id"], known.select("conv_id", "n"), placed.count(), ["position"]).withColumn("place", F.col("position") - F.col("first"))
    after = own.where("place >= head").select("conv_id", (F.col("place") - F.col("head") + F.col("lead") + 1).alias("depth"), "role", "text", "n_rebuilt")
    heads = own.where(F.col("place") < MOST - 1).select(F.col("conv_id").alias("donor"), "place", "role", "text")
    before = heads.join(known.select("conv_id", "donor", "head", "n_rebuilt"), "donor").where("place < head").select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text", "n_rebuilt")  # at most nine conversations a donor
    return before.union(after), known.select("conv_id", "n_rebuilt")


def _name(depth, lanes):
    return F.unhex(F.md5(F.encode(F.concat_ws(",", depth.cast("string"), *(x.cast("string") for x in lanes)), "UTF-8")))


def prefixes(turns: DataFrame, known: DataFrame) -> DataFrame:
    """(conv_id, depth, id, parent, bytes, last): the node of every prefix of every conversation, from the root, whose parent is null."""
    digest = F.md5(F.encode(F.concat_ws(" ", F.col("depth").cast("string"), F.length("role").cast("string"), F.concat("role", "text")), "UTF-8"))
    lanes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(_LANES)]
    rows = turns.select("conv_id", "depth", F.expr(f"(depth - 1) div {BLOCK}").alias("block"), F.octet_length("text").cast("long").alias("bytes"), (F.col("depth") == F.col("n_rebuilt")).alias("last"), *lanes)
    totals = rows.groupBy("conv_id", "block").agg(*(F.sum(x).alias(x) for x in _LANES))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each BLOCK turns
    offsets = totals.select("conv_id", "block", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_0") for x in _LANES)).where("block > 0")
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(offsets, ["conv_id", "block"], "left").withColumns({f"{x}_1": F.coalesce(f"{x}_0", F.lit(0)) + F.sum(x).over(within) for x in _LANES})
    here, there = _name(F.col("depth"), [F.col(f"{x}_1") for x in _LANES]), _name(F.col("depth") - 1, [F.col(f"{x}_1") - F.col(x) for x in _LANES])
    root = known.select("conv_id", F.lit(0).cast("long"), _name(F.lit(0), [F.lit(0)] * 4), F.lit(None).cast("binary"), F.lit(0).cast("long"), F.col("n_rebuilt") == 0)
    return rows.select("conv_id", "depth", here.alias("id"), there.alias("parent"), "bytes", "last").union(root)


def _bands(paths: DataFrame, height: int) -> DataFrame:
    """(id, depth, parent, line): of each node of (conv_id, depth, id) its parent and the nodes of its band above it, itself included; height at most."""
    band = F.expr(f"depth div {height}")
    # the last of a band goes to the next one too, as the parent of its root
    both = F.when((F.col("depth") + 1) % height == 0, F.array(band, band + 1)).otherwise(F.array(band))
    rows = paths.select("conv_id", "depth", "id", F.explode(both).alias("band"))
    line = Window.partitionBy("conv_id", "band").orderBy("depth")
    lines = rows.select("id", "depth", (band == F.col("band")).alias("own"), F.lag("id").over(line).alias("parent"), F.collect_list(F.when(band == F.col("band"), F.col("id"))).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("line"))
    return lines.where("own").groupBy("id").agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("line").alias("line"))  # all members of a node agree


def rolled_up(paths: DataFrame, values: DataFrame, names: list[str], height: int = 16) -> DataFrame:
    """(id, names): the sums over each node's subtree, itself included, of the columns ``names`` of values (id, names).

    paths has (conv_id, depth, id) for every prefix, from depth 0 on without gaps.
    """
    sums = lambda x, key: x.groupBy(key).agg(*(F.sum(n).alias(n) for n in names))
    up = lambda x: sums(x.select(F.explode("line").alias("above"), *names), "above").withColumnRenamed("above", "id")
    bands = c.saved(_bands(paths, height), "trie-bands")
    inside = c.saved(up(bands.join(values, "id")), "trie-inside")
    if (bands.agg(F.max("depth")).first()[0] or 0) < height:
        return inside
    roots = bands.where(F.col("depth") % height == 0)
    top = paths.where(F.col("depth") % height == 0).withColumn("depth", F.expr(f"depth div {height}"))
    whole = rolled_up(top, inside.join(roots.select("id"), "id"), names, height)
    handed = sums(roots.where("depth > 0").select("id", "parent").join(whole, "id"), "parent").withColumnRenamed("parent", "id")
    carried = up(bands.select("id", "line").join(handed, "id"))
    return sums(inside.union(carried.select(inside.columns)), "id")


def _pieces(batches):
    """(id, first, ids): runs of the ascending conversations of a node, joined by commas."""
    for b in batches:
        found = []
        for node, rows in groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), key=lambda x: x[0]):
            ids = [i for _, i in rows]
            found += [(node, ids[lo], ",".join(map(str, ids[lo : lo + PIECE]))) for lo in range(0, len(ids), PIECE)]
        node, first, text = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["id", "first", "ids"])


def _digests(batches):
    """The digest of each node's pieces, one piece in memory at a time."""
    now, state = None, hashlib.sha256()
    for b in batches:
        done = []
        for node, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if node == now:
                state.update(b",")
            else:
                done += [(now, state.hexdigest())] if now is not None else []
                now, state = node, hashlib.sha256()
            state.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["id", "ends_sha256"])
    yield pa.RecordBatch.from_arrays([pa.array([now] if now is not None else [], pa.binary()), pa.array([state.hexdigest()] if now is not None else [], pa.string())], ["id", "ends_sha256"])


def trie(conversations: DataFrame, height: int = 16) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, all long but the digest.

    Turns are ordered by turn (null first), then role and text; rows that repeat are turns of their own; a null role or text is empty. Rows
    without conv_id are left out. Conversations that are turnless once rebuilt are members of the root. An empty table gives no node. Other columns
    are not read.
    """
    n = c.partitions(conversations.sparkSession)
    paths = c.saved(prefixes(*rebuilt(conversations)), "trie-paths")
    nodes = c.saved(paths.groupBy("id").agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes")), "trie-nodes")
    children = c.saved(nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n")), "trie-children")
    with_children = nodes.join(children.select(F.col("parent").alias("id"), F.col("n").alias("n_children")), "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    values = with_children.select("id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = rolled_up(paths.select("conv_id", "depth", "id"), values, ["n_leaves", "saved_tokens"], height)
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = c.skew_join(with_children.where("parent is not null"), parents, ["parent"], children, nodes.count(), ["id"]).unionByName(with_children.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    pieces = paths.where("last").select("id", "conv_id").repartitionByRange(n, "id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(_pieces, "id binary, first long, ids string")
    ends = pieces.repartition(n, "id").sortWithinPartitions("id", "first").mapInArrow(_digests, "id binary, ends_sha256 string")
    done = below.join(totals, "id").join(ends, "id", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
