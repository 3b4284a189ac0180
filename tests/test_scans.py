"""Prefix scans against plain lists, with keys that are cut into stretches."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import lines as ln, rules as ru, scans, series as se


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(scans, "MOST_ROWS", 20)


def _rows(n=600):
    rng = random.Random(7)
    # one key has a third of all rows
    keys = ["hot" if i % 3 == 0 else rng.choice([None, "a", "b", *map(str, range(60))]) for i in range(n)]
    order = rng.sample(range(10 * n), n)
    return [(k, o if i else None, rng.choice([None, 1, 2, 3]), rng.random() < 0.3, rng.random() < 0.3) for i, (k, o) in enumerate(zip(keys, order, strict=True))]


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        out.setdefault(r[0], []).append(r)
    return out


SCHEMA = "k string, i long, v long, x boolean, y boolean"


def test_stretches_are_short(spark, short):
    rows = _rows()
    df, cut = scans.stretches(spark.createDataFrame(rows, SCHEMA), "k", ["i"])
    sizes = {(r.k, r._stretch): r["count"] for r in df.groupBy("k", "_stretch").count().collect()}
    assert cut and sum(sizes.values()) == 600 and max(sizes.values()) <= 60 and len([k for k in sizes if k[0] == "hot"]) >= 5
    assert not scans.stretches(spark.createDataFrame(rows, SCHEMA), "k", ["i"], 1000)[1]


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("most", [20, 100_000])
def test_scan_by_force(spark, backward, inclusive, most):
    rows = _rows()
    v = F.col("v")
    folds = {"total": scans.total(v), "n": scans.count(F.col("x")), "low": scans.least(v), "high": scans.greatest(v), "near": scans.latest(v), "far": scans.earliest(v)}
    got = {(r.k, r.i): r for r in scans.scan(spark.createDataFrame(rows, SCHEMA).repartition(5), "k", "i", folds, backward, inclusive, most).collect()}
    assert len(got) == len(rows)
    for k, own in _by_key(rows).items():
        own = own[::-1] if backward else own
        for j, r in enumerate(own):
            seen = own[: j + inclusive]
            known = [s[2] for s in seen if s[2] is not None]
            want = (sum(known), sum(s[3] for s in seen), min(known, default=None), max(known, default=None), known[-1] if known else None, known[0] if known else None)
            assert tuple(got[k, r[1]])[5:] == want
    assert scans.scan(spark.createDataFrame([], SCHEMA), "k", "i", folds).count() == 0


def test_operators_on_long_keys(spark, short):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    groups = _by_key(rows)
    x, y = F.col("x"), F.col("y")
    for wrap in (False, True):
        for reverse in (False, True):
            got = {(r.k, r.i): r.o for r in se.next_opposite(df.where("i is not null"), "k", "i", x, "o", wrap, reverse).collect()}
            for k, own in groups.items():
                own = [r for r in own if r[1] is not None][:: -1 if reverse else 1]
                for j, r in enumerate(own):
                    ahead = [s[1] for s in own[j + 1 :] if s[3] != r[3]]
                    behind = [s[1] for s in own[:j] if s[3] != r[3]]
                    assert got[k, r[1]] == (ahead + behind * wrap + [None])[0]
    turn = {(r.k, r.i): r.turn for r in se.rotated(df, "k", "i", 4).collect()}
    assert all(turn[k, r[1]] == (j - 4) % len(own) for k, own in groups.items() for j, r in enumerate(own))
    after = {(r.k, r.i): r.a for r in se.next_where(df, "k", "i", F.col("v"), "a").collect()}
    assert all(after[k, r[1]] == next((s[2] for s in own[j + 1 :] if s[2] is not None), None) for k, own in groups.items() for j, r in enumerate(own))
    inner = {(r.k, r.i): r.opened_at for r in ru.inside_nested(df.where("i is not null"), "k", "i", x, y).collect()}
    flat = {(r.k, r.i): r.opened_at for r in ru.inside_spans(df.where("i is not null"), "k", "i", x & ~y, y).collect()}
    for k, own in groups.items():
        open_, last = [], None
        for r in (r for r in own if r[1] is not None):
            if r[4]:
                open_ = open_[:-1]
            assert inner[k, r[1]] == (open_[-1] if open_ else None) and flat[k, r[1]] == (None if r[4] else last)
            if r[3] and not r[4]:
                open_.append(r[1])
            last = None if r[4] else r[1] if r[3] else last


def test_lines_of_a_long_text(spark, short):
    text = "---\ntitle\n---\n" + "\n".join("```" if i % 7 == 0 else "---" if i % 50 == 49 else f"line {i}" for i in range(300))
    df = spark.createDataFrame([("long", text), ("none", None), ("short", "a\n---\nb"), ("open", "---\nx")], "k string, t string")
    numbered = ln.lines(df, "k", "t")
    body = {k: [r.line for r in ln.body_lines(numbered, "k").orderBy("line_no").collect() if r.k == k] for k in ("long", "short", "open")}
    assert body == {"long": text.split("\n")[3:], "short": ["a", "---", "b"], "open": []}
    fenced = {r.line_no for r in ln.in_fence(numbered, "k").where("in_fence and k = 'long'").collect()}
    assert fenced == {i + 1 for i in range(303) if text.split("\n")[:i].count("```") % 2}
    assert {r.k: r.preview for r in ln.first_content(numbered, "k").collect()}["long"] == "```"


def test_free_names_of_one_long_key(spark, short):
    names = ["a"] * 90 + ["a_", "a_3", "a_4", "a_10", "b", "b", "b_", "c_0", "a_3"]
    got = {r.i: r.free_name for r in se.free_names(spark.createDataFrame(list(enumerate(names)), "i long, s string").repartition(3), "s", "i").collect()}
    there, used = set(names), {}
    for i, n in enumerate(names):
        k = used.setdefault(n, [0, False])
        if not k[1]:
            k[1] = True
            assert got[i] == n
            continue
        free = (n + ("_" if j == 0 else f"_{j - 1}") for j in range(k[0], 1000))
        chosen = next(x for x in free if x not in there)
        k[0] = (0 if chosen == n + "_" else int(chosen.rsplit("_", 1)[1]) + 1) + 1
        assert got[i] == chosen
    assert len(set(got.values())) == len(names)
