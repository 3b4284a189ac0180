"""Scopes that cross, the tree of scopes, and numbering, against plain lists."""

import random

from pyspark.sql import functions as F

from weftline.operators import scans, scopes as sc
from weftline.operators.numbering import numbered


def test_crossing_scopes_by_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(-50, 900)]), i) for i in range(900)] + [("far", p, p) for p in (0, 40_000, 100_000, 10**6)]
    scopes = [(rng.choice(["hot", "a", None]), a, a + rng.choice([-3, 0, 1, 2, 9, 63, 64, 65, 500, 1000]), f"s{i}") for i, a in enumerate(rng.choices(range(-60, 900), k=300))] * 2 + [("far", -1, 10**6, "long"), ("a", None, 5, "x"), ("a", 5, None, "x")]
    r, s = spark.createDataFrame(rows, "k string, i long, n long"), spark.createDataFrame(scopes, "k string, opener long, closer long, kind string")
    out = sc.around(r, s, "k", "i")
    want = sorted(str((k, i, n, o, c, t)) for k, i, n in rows for k2, o, c, t in scopes if k == k2 and None not in (i, o, c) and o < i < c)
    assert sorted(str(tuple(x)) for x in out.collect()) == want and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    # a scope around everything is no single key
    wide = spark.range(0, 200_000).selectExpr("'k' AS k", "id AS i")
    cut = sc.around(wide, spark.createDataFrame([("k", -1, 200_000, "all")], "k string, opener long, closer long, kind string"), "k", "i")
    assert cut.count() == 200_000
    bins = spark.range(1).select(F.explode(sc._cover(F.lit(0).cast("long"), F.lit(200_000).cast("long"))).alias("b")).select("b.*").collect()
    assert sum(8**b.level for b in bins) == 200_000 and max(8**b.level for b in bins) == 32_768 and len(bins) < 80
    got = {(x.k, x.i): x.in_scope for x in sc.has_scope(r.where("i is not null").select("k", "i").distinct(), s, "k", "i", ["s1", "s2", "s3"]).collect()}
    assert all(v == any(k == k2 and None not in (o, c) and o < i < c and t in ("s1", "s2", "s3") for k2, o, c, t in scopes) for (k, i), v in got.items())
    assert sc.around(r, s.limit(0), "k", "i").count() == 0


def test_scope_tree_by_force(spark, monkeypatch):
    monkeypatch.setattr(scans, "MOST_ROWS", 40)
    rng = random.Random(9)
    rows, at = [], {}
    for _ in range(900):
        k = rng.choice(["hot", "hot", "a", "b", None])
        at[k] = at.get(k, 0) + rng.randint(1, 3)
        kind = rng.choice(["open", "close", "check", "other", "function"])
        rows.append((k, at[k], kind, rng.choice(["before", "after"])))
    df = spark.createDataFrame(rows, "k string, i long, kind string, mode string").repartition(4)
    opens, closes, closed, check = F.col("kind").isin("open", "function"), F.col("kind") == "close", F.col("kind") == "function", F.col("kind") == "check"
    tree, scope, level, hits = [], {}, {}, {}
    for k in at:
        stack, own = [], [r for r in rows if r[0] == k]
        for r in sorted(own, key=lambda r: r[1]):
            if r[2] == "close" and stack:
                tree.append((k, stack[-1][0], r[1], len(stack), stack[-2][0] if len(stack) > 1 else None))
                stack.pop()
            scope[k, r[1]] = next((o for o, f in reversed(stack) if f), None)
            level[k, r[1]] = stack[-1][0] if stack else None
            if r[2] in ("open", "function"):
                stack.append((r[1], r[2] == "function"))
            if r[2] == "check":
                hits.setdefault((k, scope[k, r[1]]), []).append(r[1])
        tree += [(k, o, None, n, stack[n - 2][0] if n > 1 else None) for n, (o, _) in enumerate(stack, 1)]
    assert sorted(map(str, tree)) == sorted(str(tuple(r)) for r in sc.tree(df, "k", "i", opens, closes).collect())
    got = {(r.k, r.i): (r.scope, r.verified) for r in sc.verified(df, "k", "i", opens, closes, closed, check, F.col("mode")).collect()}
    for k, i, _, mode in rows:
        found = hits.get((k, scope[k, i]), [])
        assert got[k, i] == (scope[k, i], bool(found) if mode == "after" else any(x < i for x in found))
    count: dict = {}
    for k, i, kind, _ in rows:
        if kind == "check":
            count[k, level[k, i]] = count.get((k, level[k, i]), 0) + 1
    assert {(r.k, r.scope): r.n for r in sc.repeated(df, "k", "i", opens, closes, check).collect()} == {x: n for x, n in count.items() if n >= 2}


def test_numbering(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "x", "y"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, i long").repartition(7)
    got = numbered(df, [F.desc_nulls_last("s"), "i"], "place", 5)
    want = sorted(rows, key=lambda r: (r[0] is None, -ord(r[0] or "0"), r[1]))
    assert {(r.s, r.i): r.place for r in got.collect()} == {r: n for n, r in enumerate(want, 5)} and numbered(df.limit(0), ["i"], "p").count() == 0
