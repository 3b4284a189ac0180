"""Sharding by Hilbert-curve order.

Several metadata columns are quantised at their quantiles, the cell's place on a Hilbert curve orders the rows, and
runs of that order of equal length become the shards, so that a filter on any of the columns meets few shards
(``prune``). Only ids, sizes and checksums are sorted; the texts are read once and not shuffled.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of cells (n rows, one column per dimension, each below 2**bits), by Skilling's transform."""
    x = cells.T.astype(np.uint64).copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        p = q - one
        for i in range(n):
            flip = (x[i] & q) > 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t ^= np.where((x[n - 1] & q) > 0, q - one, np.uint64(0))
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def _text_cuts(rows: DataFrame, names: list[str], cells: int) -> dict[str, list[str]]:
    """For each text column the values at which its rows, in order, are cut into ``cells`` parts about alike.

    The distinct values are put in order and counted over all rows; what comes to the driver are sums over ``16 * cells`` ranges of them and the
    values at the cuts.
    """
    if not names:
        return {}
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("dim"), F.col(n).alias("value")) for n in names))).alias("x")).select("x.*").where("value is not null")
    ordered = positions(pairs.groupBy("dim", "value").agg(F.count("*").alias("n")), ["dim", "value"], "values").drop("n_rows")
    ends = {r["dim"]: (r["lo"], r["hi"]) for r in ordered.groupBy("dim").agg(F.min("position").alias("lo"), F.max("position").alias("hi")).collect()}
    wanted: set[int] = set()
    if ends:
        low = F.coalesce(*(F.when(F.col("dim") == d, F.lit(lo)) for d, (lo, _) in ends.items()))
        width = F.coalesce(*(F.when(F.col("dim") == d, F.lit((hi - lo) // (16 * cells) + 1)) for d, (lo, hi) in ends.items()))
        sums = ordered.groupBy("dim", F.floor((F.col("position") - low) / width).alias("part")).agg(F.sum("n").alias("n"), F.min("position").alias("first")).collect()
        for d in ends:
            parts = sorted((r["part"], r["n"], r["first"]) for r in sums if r["dim"] == d)
            total, seen = sum(n for _, n, _ in parts), 0
            for i, (_, n, _) in enumerate(parts[:-1]):
                if (seen + n) * cells // total > seen * cells // total:
                    wanted.add(parts[i + 1][2])
                seen += n
    found: dict[str, list[str]] = {n: [] for n in names}
    at = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in sorted(wanted)], "position long"))
    for r in ordered.join(at, "position").select("dim", "value").collect():  # fewer than cells values of each column
        found[r["dim"]].append(r["value"])
    return {n: sorted(x) for n, x in found.items()}


def curve_order(docs: DataFrame, dims: list[str], keep: list, bits: int = 8, tie: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with ``curve`` and ``position``, gapless from 0 in curve order (ties by the columns ``tie``, which keep has).

    Numbers are cut into cells at their quantiles, texts at theirs in the order of their code points.
    """
    kinds = dict(docs.dtypes)
    names = [f"_d{i}" for i in range(len(dims))]
    rows = docs.select(*keep, *((F.col(d) if kinds[d] == "string" else F.col(d).cast("double")).alias(n) for d, n in zip(dims, names, strict=True)))
    texts = [n for d, n in zip(dims, names, strict=True) if kinds[d] == "string"]
    numbers = [n for n in names if n not in texts]
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(*(F.percentile_approx(n, steps, 10000).alias(n) for n in numbers)).first() if numbers else {}
    edges = {n: np.unique(np.array(cuts[n] or [], float)) for n in numbers} | {n: np.array(x, object) for n, x in _text_cuts(rows.select(*texts), texts, 1 << bits).items()}

    def cell(column, edge, text: bool):
        """How many cuts are not above each value (below it for numbers); null is below every cut, so it shares the lowest cell."""
        if text:
            known = column.dictionary_encode()
            at = np.searchsorted(edge, np.array(known.dictionary.to_pylist(), object), "right") if len(edge) else np.zeros(len(known.dictionary), np.int64)
            return np.append(at, 0)[known.indices.fill_null(len(at)).to_numpy(zero_copy_only=False).astype(np.int64)]
        return np.searchsorted(edge, column.fill_null(-np.inf).to_numpy(zero_copy_only=False), "left")

    def place(batches):
        for b in batches:
            # few distinct values are spread over the whole range, so that every dimension weighs alike
            cells = np.stack([(cell(b.column(n), edges[n], n in texts) << bits) // (len(edges[n]) + 1) for n in names], 1) if b.num_rows else np.zeros((0, len(names)), np.int64)
            kept = [x for x in b.schema.names if x not in names]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), pa.array(hilbert_index(cells, bits), pa.int64())], [*kept, "curve"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(*names).schema) + ", curve long"
    return positions(rows.mapInArrow(place, schema), ["curve", *(tie or [])], "hilbert")


def positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``position``: the place of each row in the order of these columns, from 0, without one task that sees them all.

    The rows are range-partitioned, sorted and written to the shared folder, so that a row keeps its place in its partition; then the
    partitions' counts are added up.
    """
    n = c.partitions(rows.sparkSession)
    local = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = c.saved(local.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), name)
    counts = sorted(kept.groupBy("_part").count().collect())  # one number for each of n partitions
    total = sum(k for _, k in counts)
    before = [(p, sum_ - k) for (p, k), sum_ in zip(counts, itertools.accumulate(k for _, k in counts), strict=True)]
    table = F.broadcast(rows.sparkSession.createDataFrame(before, "_part long, _before long"))
    return kept.join(table, "_part").withColumn("position", F.col("_before") + F.col("_at")).withColumn("n_rows", F.lit(total).cast("long")).drop("_at", "_part", "_before")


def shard(docs: DataFrame, n_shards: int = 16, dims: list[str] | None = None, bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows to shards 0 to n_shards - 1 under the law ``rows``: counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32 (0 for null or empty), law, shard, slot (gapless
    from 0 in each shard), grown_shard (null under this law), curve, and the columns ``dims``. Nulls in a dimension share its lowest cell,
    rows that repeat get slots of their own, fewer rows than shards leave some shards empty, and an empty table gives an empty table.
    """
    dims = dims or ["lang", "source", "n_chars"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *(F.col(d) for d in dims)]
    rows = curve_order(docs, dims, keep, bits, ["doc_id", "text_crc32", "size"])
    at, n, k = F.col("position"), F.col("n_rows"), F.lit(n_shards)
    whole, more = F.expr(f"n_rows div {n_shards}"), F.expr(f"n_rows % {n_shards}")
    wide = more * (whole + 1)  # rows of the first shards, which have one more
    first = at < wide
    shard_ = F.when(first, F.expr(f"position div (n_rows div {n_shards} + 1)")).otherwise(more + (at - wide) / F.greatest(whole, F.lit(1)))
    rows = rows.withColumn("shard", F.floor(shard_).cast("int"))
    slot = at - F.when(first, F.col("shard") * (whole + 1)).otherwise(wide + (F.col("shard") - more) * whole)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *dims)


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows of docs as Parquet files by shard, in slot order; ids must be unique. Large shards are cut by slot into ranges, not gathered in one task."""
    placed = docs.join(shards.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    placed.repartitionByRange(c.partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def zones(shards: DataFrame, dims: list[str]) -> DataFrame:
    """Least and greatest value of every dimension in each shard: a manifest of n_shards rows."""
    return shards.groupBy("shard").agg(F.count("*").alias("n_rows"), *(f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)))


def prune(manifest: DataFrame, dim: str, low, high) -> list[int]:
    """The shards that can hold a value of dim from low to high."""
    return [r["shard"] for r in manifest.where((F.col(f"{dim}_max") >= F.lit(low)) & (F.col(f"{dim}_min") <= F.lit(high))).select("shard").orderBy("shard").collect()]
