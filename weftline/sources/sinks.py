"""Writers: logs, playlists, notes, and what is current. None overwrites a path that it reads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import date_name
from ..operators.numbering import numbered
from . import snapshots


def append_log(rows: DataFrame, key: str, path: str) -> None:
    """Add entries to a log of one entry per line."""
    rows.select(F.col(key).cast("string").alias("value")).write.mode("append").text(path)


def replace_log(log: DataFrame, fresh: DataFrame, key: str, path: str) -> None:
    """Write the log and the new keys, each once and in order, to another path than the log's."""
    log.select(key).union(fresh.select(key)).distinct().orderBy(key).select(F.col(key).alias("value")).write.mode("overwrite").text(path)


def playlist(files: DataFrame, name: str, without: str, path: str) -> None:
    """Write a listing without the names that hold a word anywhere."""
    files.where(~F.col(name).contains(without)).select(F.col(name).alias("value")).write.mode("overwrite").text(path)


def write_absent(rows: DataFrame, path: str, key: str) -> None:
    """Add the rows whose key the Parquet table at path does not have yet; of several with one key, the least stays."""
    known = rows.sparkSession.read.parquet(path).select(key)
    others = [x for x in rows.columns if x != key]
    one = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_x")).select(key, *(F.col(f"_x.{x}").alias(x) for x in others)).select(*rows.columns)
    one.join(known, key, "left_anti").select(*rows.columns).write.mode("append").parquet(path)


def numbered_notes(rows: DataFrame, order: str, date: Column, first: int) -> DataFrame:
    """rows with the text and the file of a new note each, numbered from ``first`` in order, through range partitions."""
    text = F.concat(F.lit("DATE: "), date_name(date), F.lit("\nTITLE:\nTAGS:\n---"))
    placed = numbered(rows, [order], "_number", first)
    return placed.withColumn("text", text).withColumn("file", F.concat(date_name(date, "numbered"), F.lit("-"), F.col("_number").cast("string"), F.lit(".md"))).drop("_number")


def write_texts(rows: DataFrame, file: str, text: str, folder: str) -> None:
    """Write each row's text to the file of that name in a folder that all executors see, named as a URI: one file per row, whole, and the same again if a task is repeated.

    Names hold no slash; a null text is an empty file; a row without a name writes nothing. Folders above are made.
    """
    import pyarrow as pa

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write((value or "").encode())
                system.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    named = rows.where(F.col(file).isNotNull() & ~F.contains(file, F.lit("/"))).select(file, text)
    named.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def set_current(named: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """Make the named row that is wanted (key) the current one and return it: each choice is a version under path, and the last committed one counts, whatever the clocks say.

    An unknown key changes nothing and returns no row; a choice that fails leaves the one before.
    """
    row = named.join(wanted, "key", "left_semi")
    if not row.limit(1).count():
        return named.limit(0)
    snapshots.write(row, path)
    return snapshots.read(named.sparkSession, path)
