"""License scans, prefix tries and ranked search."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest


def _brute_scan(text, phrases, notices, least=0.75, shift=3):
    """The contract and the docstring of ``scan``, from words and positions."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    ws = split(text)
    places = [(label, i) for label, p in phrases for i in range(len(ws)) if len(split(p)) > 1 and ws[i : i + len(split(p))] == split(p)]
    labels, score = {x for x, _ in places}, 1.0 if places else 0.0
    for label, t in notices:
        tw = split(t)
        k = 4 if len(tw) >= 4 else 2
        if len(tw) < 2:
            continue
        by: dict = {}
        for i in range(len(ws) - k + 1):
            for j in range(len(tw) - k + 1):
                if ws[i : i + k] == tw[j : j + k]:
                    by.setdefault(i - j, set()).add(j)
        groups: list = []
        for d in sorted(by):
            if not groups or d - groups[-1][-1] > shift:
                groups.append([])
            groups[-1].append(d)
        for g in groups:
            at = [(d + j, j) for d in g for j in by[d]]
            covered = {x for _, j in at for x in range(j, j + k)}
            share = len(covered) / max(len(tw), max(i for i, _ in at) + k - min(i for i, _ in at))
            score = max(score, share)
            labels |= {label} if share >= least else set()
    at = [i for _, i in places]
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in places})), ",".join(sorted(labels)), score


def test_license_votes_by_force(spark):
    from weftline.llm import license_votes as lv

    mit = lv.NOTICES[0][1]
    texts = [
        None, "", "MIT License", "mit-license MIT LICENSE, mit\nlicense", "KIT license mit licence", "General  Public License x general public y license", mit, "a b " + mit.replace("charge, to", "charge whatsoever, and to").upper() + " c",
        mit.replace("software", "programme"), mit[:60], f"{mit} and {mit}", " ".join(w for i, w in enumerate(mit.split()) if i != 9), "x " * 5000 + lv.NOTICES[3][1] + " y" * 5000, "ÉMIT License", "mit license " * 300, mit[:80] + " z" * 40 + mit[80:],
        "licensed under cc by nc 4.0", "licensed under cc by sa 4.0",
    ]
    docs = spark.createDataFrame([(i // 2 if i % 5 else None, t, "clash", 1) for i, t in enumerate(texts * 2)], "doc_id long, text string, words string, n_base int").repartition(3)
    for args, table in (((lv.PHRASES, lv.NOTICES), None), (([("a", "x x x"), ("one", "x")], [("short", "of charge")]), "own"), (([], []), "own")):
        got = lv.scan(docs, None if table is None else lv.templates(spark, *args)).collect()
        want = [(i // 2 if i % 5 else None, *_brute_scan(t, *args)) for i, t in enumerate(texts * 2)]
        key = lambda r: str([str(x) for x in r])
        assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    assert lv.scan(docs.limit(0)).count() == 0


def test_license_scan_is_native(spark, sf):
    from weftline.llm import license_votes as lv

    votes = lv.votes(spark.read.parquet(f"{sf}/documents.parquet"), lv.templates(spark))
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan) and "BroadcastHashJoin" in plan


def _brute_rank(docs, items, k):
    """The contract, term by term over all documents."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(split(t))) for i, t in docs]
    N, L, df = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for i, text in set(items):
        score = lambda b: sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * (25 + 75 * b.total() * N // L))) for t in split(text) if b[t])  # noqa: E731, B023
        found = sorted(((score(b), d) for d, b in bags), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, n, d, s) for n, (s, d) in enumerate(found[:k], 1) if s > 0]
    return sorted(map(str, out))


def test_dual_tree_by_force(spark):
    from weftline.llm import dual_tree as dt

    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Über", "naïve", "X1"]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(700)] + [(i, docs_) for i, docs_ in enumerate([None, "", "...", "w5 " * 30000, "only here"], 1000)]
    docs += [(9000 - i, "w1 w2 W3-w4") for i in range(40)] + [(None, "w1 w2 w3 w4")] * 3 + [(3, "w1 w2 w3 w4"), (3, "w1 w2 w3 w4")]
    items = [(i, text(rng.randint(1, 30))) for i in range(330)] + [(500, None), (501, ""), (502, "w1 w2 w3 w4"), (502, "w1 w2 w3 w4"), (503, "nowhere"), (504, "w7 " * 500), (1, "Only HERE"), (None, "w9 w10")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS term", "1 AS score").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "2 AS doc_id", "3 AS n")
    want = _brute_rank(docs, [x for x in items if x[1] is not None], 10)
    for args in ({}, {"block_bytes": 3000, "run": 100}):
        assert sorted(str(tuple(r)) for r in dt.rank(d, q, **args).collect()) == want
    assert dt.rank(d.limit(0), q).count() == dt.rank(d, q.limit(0)).count() == 0 and dt.rank(d, q.where("item_id = 503")).count() == 0


def test_dual_tree_prunes_and_bounds():
    """Bounds are never below a score beneath them, and pairs of nodes that cannot reach an item's weakest score are not opened."""
    from weftline.llm import dual_tree as dt

    rng = np.random.default_rng(1)
    n, terms = 2000, 400
    row = np.repeat(np.arange(n), 20)
    term = (rng.integers(0, 20, len(row)) + 20 * (row // 100)).astype(np.int64)  # documents of one kind side by side
    at, term, value = dt._csr(row, term, rng.integers(1, 1000, len(row)), n)
    q_row = np.repeat(np.arange(64), 5)
    q_at, q_term, q_value = dt._csr(q_row, rng.integers(0, 20, len(q_row)) + 20 * (q_row // 4), rng.integers(1, 100, len(q_row)), 64)
    full = np.zeros((n, terms), np.int64)
    full[np.repeat(np.arange(n), np.diff(at)), term] = value
    other = np.zeros((terms, 64), np.int64)
    other[q_term, np.repeat(np.arange(64), np.diff(q_at))] = q_value
    scores = full @ other
    weakest = np.sort(scores, axis=0)[-10]
    d, q, s, compared = dt.Group(q_at, q_term, q_value, terms).search(at, term, value, weakest)
    assert {(a, b): x for a, b, x in zip(d.tolist(), q.tolist(), s.tolist(), strict=True)} == {(a, b): scores[a, b] for a, b in np.argwhere((scores >= weakest) & (scores > 0)).tolist()}
    assert compared < n * 64 / 8
    x = rng.integers(1, 1_000_000, 5000)
    assert all(dt.least_of(k) <= v < dt.least_of(k + 1) or dt.least_of(k) == dt.least_of(k + 1) for v, k in zip(x.tolist(), dt._class(x).tolist(), strict=True))


def _brute_trie(rows):
    """The contract over dictionaries of whole prefixes."""
    turns: dict = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(conv, []).append((role or "", text or ""))
    head = {k: zlib.crc32(str(k).encode()) % 9 for k in turns}
    whole = {k: turns.get(k - k % 5, [])[: head[k]] + x[head[k] :] for k, x in turns.items()}
    members: dict = {}
    for k in sorted(whole):
        for d in range(len(whole[k]) + 1):
            members.setdefault(tuple(whole[k][:d]), []).append(k)
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        own = children.get(node, [])
        totals[node] = (sum(totals[x][0] for x in own) if own else 1, (len(members[node]) - 1) * len(node[-1][1].encode()) * bool(node) + sum(totals[x][1] for x in own) if node else sum(totals[x][1] for x in own))
    ends = lambda node: hashlib.sha256(",".join(str(k) for k in members[node] if len(whole[k]) == len(node)).encode()).hexdigest()
    return sorted(str((m[0], len(x), members[x[:-1]][0] if x else None, len(m), len(children.get(x, ())), *totals[x], ends(x))) for x, m in members.items())


def test_prefix_trie_by_force(spark, monkeypatch):
    from weftline.llm import prefix_trie as pt

    rng = random.Random(5)
    rows = [(k, i if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None])) for k in range(0, 90) for i in range(rng.randint(1, 12)) if k % 7]
    rows += [(k, i, "user", f"same {i}") for k in (1000, 1005, 1010, 1011, 1013) for i in range(70)] + [(1010, 70, "user", "more"), (2003, 0, "u", "x"), (2003, 0, "u", "x"), (None, 0, "u", "x")]
    rows += [(k, 0, "user", "hot first turn") for k in range(3000, 3400, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "'x' AS id").repartition(3)
    want = _brute_trie(rows)
    assert sorted(str(tuple(r)) for r in pt.trie(df).collect()) == want
    monkeypatch.setattr(pt, "BLOCK", 8), monkeypatch.setattr(pt, "PIECE", 3)
    assert sorted(str(tuple(r)) for r in pt.trie(df, height=3).collect()) == want  # four rounds
    assert pt.trie(df.limit(0)).count() == 0 and [r.depth for r in pt.trie(df.where("conv_id = 2003")).collect()].count(0) == 1


@pytest.mark.parametrize("name", ["op11_license_votes", "op12_prefix_trie", "op13_dual_tree"])
def test_against_sql(spark, name):
    """Rows of the query and of its SQL over the whole small tables."""
    import duckdb

    from weftline.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert len(got) == len(want) and sorted(map(str, got)) == sorted(map(str, want))


def test_toxic_sample_is_bounded(spark):
    """Repeated ids, copies and long texts stay within the limits, and two runs see the same rows."""
    from weftline.llm import toxic_crf as tc

    docs = [(1, f"same id, text {i} " + "w " * 20) for i in range(3000)] + [(i, "copy") for i in range(2, 500)] + [(i, f"own {i}") for i in range(500, 700)] + [(700, "long " * 200_000), (701, None), (None, "no id")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS toxic", "1 AS at").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 702)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows, sizes = tc.sample(d, labels, None, 400, 100, 5000)
    got = rows.collect()
    assert sizes == {0: 350, 1: 351} and len({r.text for r in got if r.toxic}) == len([r for r in got if r.toxic]) <= 400 and len([r for r in got if not r.toxic]) <= 100
    assert all(sum(len(r.text) for r in got if r.toxic == x) <= 5000 for x in (True, False)) and sorted(got) == sorted(tc.sample(d.repartition(3), labels, None, 400, 100, 5000)[0].collect())
    assert tc.score(d.limit(0), tc.fit(d.limit(0), labels)).count() == 0


def test_toxic_field_by_force():
    """The trained weights are the maximum of the penalised likelihood over all label sequences."""
    from itertools import product

    from weftline.llm import toxic_crf as tc

    rng = np.random.default_rng(2)
    gain, docs = np.array([1.0, 2.0]), []
    for _ in range(12):
        n = int(rng.integers(2, 7))
        places = np.flatnonzero(rng.random(n) < 0.6)
        docs.append((n, places, rng.integers(0, 2, len(places)), rng.integers(0, 2, len(places)).astype(np.int8)))
    field = tc._train_field(docs, 2, gain, length=8, steps=6000)
    start = np.array([1.0, 2.0, -4.0, 0.0, -3.0, 0.0, -1.0])

    def loss(x):
        w, b, a = x[:2], x[2], x[3:].reshape(2, 2)
        total = 0.005 * ((x - start) ** 2).sum()
        for n, places, which, y in docs:
            at, label = dict(zip(places.tolist(), which.tolist(), strict=True)), np.zeros(n, int)
            label[places] = y
            energy = lambda s: sum(s[i] * (b + (w[at[i]] if i in at else 0)) for i in range(n)) + sum(a[s[i], s[i + 1]] for i in range(n - 1))  # noqa: E731, B023
            total += np.log(sum(np.exp(energy(s)) for s in product((0, 1), repeat=n))) - energy(label)
        return total

    best = np.concatenate((field["weight"], [field["bias"]], np.ravel(field["step"])))
    now = loss(best)
    assert now < loss(start) and all(loss(best + e * v) > now - 1e-4 for v in np.eye(7) for e in (-0.2, 0.2))


def test_benchmark_blocks_are_small_and_absent_windows_cheap():
    """What is sent is bounded by the items' words, and windows with a word that a shard lacks are not searched."""
    import pickle

    from weftline.llm import decontaminate as dc

    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(60))) for i in range(2000)]
    block = dc._block(items, 10)
    words = sum(len(t.split()) for _, t in items)
    assert len(pickle.dumps(block)) < 21 * words + 8 * len(block[0]) + 40 * len(items)
    vocabulary, symbols, sets, shortest, _ = block
    seen = {tuple(t.split()[j : j + 10]) for _, t in items for j in range(51)}
    assert [k for k, *_ in sets] == [10] == [shortest] and len(sets[0][1]) == len(seen)
    searched = []
    search, dc.FmIndex.search = dc.FmIndex.search, lambda self, p: searched.append(len(p)) or search(self, p)
    try:
        text = np.concatenate((symbols[:30], [0], symbols[100:130], [0])).astype(np.int64)
        found = list(dc._hits(text, np.zeros(len(text), np.int64), np.arange(len(text)), len(vocabulary), symbols, sets))
    finally:
        dc.FmIndex.search = search
    assert {p for x in found for p in x[0].tolist()} == {*range(21), *range(31, 42), 51} and sum(searched) < 60  # items end at every sixtieth word


def test_symbols_alike():
    from weftline.llm import decontaminate as dc

    rng = np.random.default_rng(0)
    symbol = rng.integers(1, 4, 500).astype(np.int32)
    for k in (1, 2, 3, 5, 10):
        begin = np.arange(500 - k)
        which = dc._alike(symbol, begin, k)
        same: dict = {}
        for b, w in zip(begin.tolist(), which.tolist(), strict=True):
            assert same.setdefault(w, symbol[b : b + k].tolist()) == symbol[b : b + k].tolist()
        assert len(same) == len({tuple(symbol[b : b + k]) for b in begin})
