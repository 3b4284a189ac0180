"""Tables that are replaced while they are read: versions of a table under one path, of which the last committed one counts.

A version's rows are written to a folder of their own; then a marker with the version's number is created, which names the folder. A write that fails has no marker and
changes nothing, and of two writers that want the same number one fails. Readers take the folder that the highest marker names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame


def _fs(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _markers(spark, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/commits")
    return sorted(int(n) for n in (x.getPath().getName() for x in fs.listStatus(p)) if n.isdigit()) if fs.exists(p) else []


def committed(spark, path: str, version: int | None = None) -> dict | None:
    """version, folder, schema and label of the last committed version, or of a given one; null if there is none."""
    found = [v for v in _markers(spark, path) if version is None or v == version]
    if not found:
        return None
    fs, p = _fs(spark, f"{path}/commits/{found[-1]:020d}")
    stream = fs.open(p)
    try:
        return {"version": found[-1]} | json.loads(bytes(b & 255 for b in stream.readAllBytes()).decode())
    finally:
        stream.close()


def read(spark, path: str, schema: str | None = None, version: int | None = None) -> DataFrame:
    """The rows of the last committed version; without one an empty table of ``schema``."""
    last = committed(spark, path, version)
    if last is None:
        if schema is None:
            raise FileNotFoundError(f"no committed version under {path}")
        return spark.createDataFrame([], schema)
    return spark.read.schema(last["schema"]).parquet(last["folder"])


def write(df: DataFrame, path: str, label: str | None = None) -> int:
    """Write df, which may read the version before, as the next version, and return its number; ``label`` is kept with it."""
    spark = df.sparkSession
    number = (_markers(spark, path) or [0])[-1] + 1
    folder = f"{path}/data/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    fs, p = _fs(spark, f"{path}/commits/.{uuid.uuid4().hex}")
    out = fs.create(p, False)
    out.write(json.dumps({"folder": folder, "schema": schema, "label": label}).encode())
    out.close()
    # a rename onto a marker that is there fails, so a number is taken once, and no marker is seen half written
    _, marker = _fs(spark, f"{path}/commits/{number:020d}")
    if fs.exists(marker) or not fs.rename(p, marker):
        fs.delete(p, False)
        raise RuntimeError(f"version {number} of {path} was committed by another writer")
    return number


def expire(spark, path: str, keep: int = 2) -> None:
    """Remove all but the last ``keep`` versions; readers of older ones fail."""
    for v in _markers(spark, path)[:-keep]:
        old = committed(spark, path, v)
        for gone in (f"{path}/commits/{v:020d}", old["folder"]):
            fs, p = _fs(spark, gone)
            fs.delete(p, True)


def merge_keys(fresh: DataFrame, key: str, path: str) -> int:
    """Add the keys of fresh to the log under path, each once: the log is read and replaced."""
    rows = fresh.select(key).where(f"`{key}` is not null")
    known = read(fresh.sparkSession, path, f"`{key}` {dict(rows.dtypes)[key]}")
    return write(known.union(rows).distinct(), path)
