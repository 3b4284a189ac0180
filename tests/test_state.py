"""Snapshots, streams whose memory ends, templates, nearest metadata and the TOML source."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import templates as tp
from weftline.sources import files as so, sinks as si, snapshots
from weftline.sources.toml import TomlSource
from weftline.streaming import ingest


def test_snapshots(spark, tmp_path):
    path, df = f"file://{tmp_path}/t", lambda *x: spark.createDataFrame([(i,) for i in x], "a long")
    assert snapshots.read(spark, path, "a long").count() == 0 and snapshots.committed(spark, path) is None
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    assert snapshots.write(df(1, 2), path, "x") == 1 and snapshots.write(snapshots.read(spark, path).where("a > 1").union(df(7)), path) == 2
    assert sorted(r.a for r in snapshots.read(spark, path).collect()) == [2, 7] and snapshots.read(spark, path, version=1).count() == 2 and snapshots.committed(spark, path, 1)["label"] == "x"
    # a write that fails leaves what was there
    broken = df(1).select(F.raise_error(F.lit("broken")).cast("long").alias("a"))
    with pytest.raises(Exception, match="broken"):
        snapshots.write(broken, path)
    assert sorted(r.a for r in snapshots.read(spark, path).collect()) == [2, 7]
    snapshots.write(df(), path)
    snapshots.expire(spark, path, 1)
    assert snapshots.read(spark, path).count() == 0 and snapshots.committed(spark, path)["version"] == 3 and snapshots.committed(spark, path, 2) is None
    log = f"{path}-log"
    for keys in ((1, 2), (2, 3), (None, 1)):
        snapshots.merge_keys(df(*keys), "a", log)
    assert sorted(r.a for r in snapshots.read(spark, log).collect()) == [1, 2, 3]
    named = spark.createDataFrame([("dark", "1"), ("light", "2")], "key string, value string")
    for k in ("light", "dark", "none"):  # in one tick of the clock, too
        si.set_current(named, spark.createDataFrame([(k,)], "key string"), f"{path}-now")
    assert [r.key for r in snapshots.read(spark, f"{path}-now").collect()] == ["dark"]


def test_changes_over_restarts(spark, tmp_path):
    rng = random.Random(3)
    day = lambda x: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=x)
    rows = sorted(((day(rng.random() * 60), rng.choice(["a", "b", None, "hot", "hot"]), rng.choice(["x", "y", None])) for _ in range(300)), key=lambda r: r[0])
    rows = [(k, t, c) for t, k, c in rows]
    schema, source = "k string, t timestamp, c string", f"{tmp_path}/in"
    out, store = f"{tmp_path}/out", f"file://{tmp_path}/store"
    run = lambda: ingest.run_changes(spark.readStream.schema(schema).parquet(source), "k", "t", F.col("c"), "2 days", store, out, f"{tmp_path}/state")
    for i, part in enumerate((rows[:90], rows[90:100], rows[100:250], rows[250:])):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        if i == 2:  # it ends before the state is committed
            write, snapshots.write = snapshots.write, None
            with pytest.raises(Exception):
                run()
            snapshots.write = write
        run()
        run()  # nothing new
    last, want = {}, []
    for k, t, c in rows:
        before = last.get(k)
        if before is None or before[1] != c or t - before[0] > datetime.timedelta(days=2):
            want.append((k, t, c))
        last[k] = (t, c)
    assert sorted(map(str, map(tuple, spark.read.parquet(out).select("k", "t", "c").collect()))) == sorted(map(str, want))
    clock = rows[-1][1]
    assert {r.key for r in snapshots.read(spark, store).collect()} == {k for k, (t, _) in last.items() if clock - t <= datetime.timedelta(days=2)}


def test_templates(spark):
    df = spark.createDataFrame([("N", [("a", 1), ("b", None)], ["t"]), (None, [], None)], "n string, xs array<struct<k string, v long>>, ts array<string>")
    shown = tp.render("{{{n}}} {#xs}<{k}={v}>{/xs}|{#ts}{.}{/ts}", {"n": F.col("n"), "xs": F.col("xs"), "ts": F.col("ts")})
    assert [r.s for r in df.select(shown.alias("s")).collect()] == ["{N} <a=1><b=>|t", "{} |"]
    assert df.select(tp.doc_block("function", F.col("n")).alias("s")).first().s.split("\n")[5:] == ["function N(/* args */) {", "\t// body", "}", ""]
    for bad in ("{#a}", "{/a}", "{#a}{/b}", "{missing}"):
        with pytest.raises((ValueError, KeyError)):
            tp.render(bad, {"a": F.lit("x")})


def test_nearest_metadata(spark):
    files = spark.createDataFrame([("a/b/c/f",), ("a/g",), ("/top",), ("bare",), (None,)], "path string").withColumn("folder", F.lit("clash"))
    stores = spark.createDataFrame([("a", "b/c/f", "far", "keep"), ("a/b", "c/f", "near", None), ("a/b/c", "f", None, None), ("a", "g", "own", None), ("", "top", "root", None), ("a", "c/f", "no", "no")], "folder string, entry string, title string, author string")
    got = {r.path: (r.title, r.author) for r in so.nearest_metadata(files, stores, "path", ["title", "author"]).collect()}
    assert got == {"a/b/c/f": ("near", "keep"), "a/g": ("own", None), "/top": ("root", None), "bare": (None, None), None: (None, None)}
    assert {r.path: r.title for r in so.nearest_metadata(files, stores, "path", ["title"], deep=False).collect()}["a/b/c/f"] is None


def test_toml_source(spark, tmp_path):
    (tmp_path / "dark.toml").write_text("[colors.primary]\nbackground = '#000'\n[[colors.indexed]]\nindex = 16\n")
    (tmp_path / "light.toml").write_text("[colors.primary]\nbackground = '#fff'\n")
    (tmp_path / "other.txt").write_text("= not toml")
    got = {(r.name, r.key, r.value) for r in so.themes(spark, f"file://{tmp_path}").collect()}
    assert got == {("dark", "colors.primary.background", "#000"), ("dark", "colors.indexed.0.index", "16"), ("light", "colors.primary.background", "#fff")}
    spark.dataSource.register(TomlSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("toml").option("filesPerTask", 1).option("pushKeys", "true").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 2 and rows.where("key = 'colors.primary.background'").count() == 2 and rows.where("key like 'colors.in%'").count() == 1
    assert rows.where("key in ('colors.indexed.0.index', 'x') and value = '16'").count() == 1
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
