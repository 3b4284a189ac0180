"""Tables of patterns against one regex a pattern, and links that meet by prefix or glob."""

import random
import re

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import links as lk, matching as ma


def _glob(g):
    return re.compile("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g) + "$", re.I)


def test_ten_thousand_wildcards(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeE_\\Qé.", k=rng.randint(1, 7)))
    tokens = [(i, word() + rng.choice(["", "_"]) + word()) for i in range(300)] * 2 + [(900, None), (901, ""), (902, "very_long_name_" + "x" * 300)]
    globs = [("g%d" % (i % 50), rng.choice(["{}*", "*{}", "*{}*", "{}?", "?{}*", "{}*{}", "{}", "*{}?{}*"]).replace("{}", "%s")) for i in range(10_000)]
    rules = [(g, p.replace("%s", word(), 1).replace("%s", word(), 1)) for g, p in globs] + [("all", "*"), ("one", "?"), ("two", "??*"), ("none", None), ("empty", ""), ("tail", "*" + "x" * 20), ("head", "VERY_LONG_NAME_*")]
    allow = [("all", tokens[0][1].upper()), ("all", None), ("g1", tokens[1][1])]
    df = spark.createDataFrame(tokens, "i long, s string").selectExpr("*", "1 AS key", "'x' AS name")
    table, free = spark.createDataFrame(rules, "group string, pattern string"), spark.createDataFrame(allow, "group string, name string")
    out = ma.wildcard_matches(df, "s", table, free)
    got = sorted((r.i, r.group) for r in out.collect())
    patterns = [(g, _glob(p)) for g, p in rules if p is not None]
    free_ = {(g, (n or "").lower()) for g, n in allow if n}
    want = sorted((i, g) for i, s in tokens if s is not None for g in {g for g, p in patterns if p.match(s)} if (g, s.lower()) not in free_)
    assert got == want
    size = lambda t: len(ma.wildcard_matches(df, "s", t)._jdf.queryExecution().optimizedPlan().toString())
    assert size(table) < 1.2 * size(table.limit(300)) and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert ma.wildcard_matches(df, "s", table.limit(0)).count() == 0 and ma.wildcard_matches(df.limit(0), "s", table).count() == 0


def test_prefixes_and_spellings_as_tables(spark):
    names = [(1, "Wp_query"), (2, "wp_"), (3, "w"), (4, None), (5, ""), (6, "a_name_longer_than_an_anchor_1"), (7, "ÉTAT"), (8, "WP_QUERY")]
    df = spark.createDataFrame(names, "i long, s string").withColumn("rank", F.lit(0))
    rules = spark.createDataFrame([("WP_", 3), ("wp_q", 5), ("a_name_longer_than_an_anchor_2", 1), ("A_name_longer_than", 2), ("é", 1), (None, 0)], "prefix string, rank long")
    assert {r.i: r.prefix for r in ma.first_prefix(df, "s", rules).collect()} == {1: "WP_", 2: "WP_", 3: None, 4: None, 5: None, 6: "A_name_longer_than", 7: "é", 8: "WP_"}
    assert {r.prefix for r in ma.first_prefix(df, "s", rules.limit(0)).collect()} == {None}
    assert {r.prefix for r in ma.first_prefix(df, "s", rules.union(spark.createDataFrame([("", 9)], rules.schema))).where("i in (3, 5)").collect()} == {""}
    spellings = spark.createDataFrame([("WP_Query", 2), ("Wp_query", 7), ("état", 1), (None, 0)], "canonical string, rank long")
    assert {r.i: r.canonical for r in ma.wrong_case(df, "s", spellings).collect()} == {1: "WP_Query", 7: "état", 8: "WP_Query"} and ma.wrong_case(df, "s", spellings.limit(0)).count() == 0


def test_links_by_prefix_and_glob(spark):
    rng = random.Random(2)
    names = ["a", "ab", "a very long name", "a very long one", "", "[x", "z" * 40, None, "x.y", "ab"]
    notes = [(f"p{i}", n, " ".join(rng.choice(["[[", "[[[", "[", "x "]) + str(rng.choice(names))[: rng.randint(0, 30)] + rng.choice(["]]", "|c]]", "\n", ""]) for _ in range(rng.randint(0, 6)))) for i, n in enumerate(names * 6)] + [("null", "n", None)]
    df = spark.createDataFrame(notes, "path string, name string, content string")
    out = lk.prefix_backlinks(df)
    want = sorted((d, s) for d, n, _ in notes for s, _, c in notes if n is not None and c is not None and "[[" + n in c and d != s)
    assert sorted(map(tuple, out.collect())) == want and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    links = [(1, "A*"), (2, "*ONG*"), (3, "x?y"), (4, "nowhere*"), (5, None), (6, "*")]
    got = {r.src: r.path for r in lk.glob_links(spark.createDataFrame(links, "src long, name string"), df).collect()}
    assert got == {i: min((p for p, n, _ in notes if n is not None and g is not None and _glob(g).match(n)), default=None) for i, g in links}


def test_links_by_prefix_make_pairs_where_they_are_returned(spark, monkeypatch):
    monkeypatch.setattr(lk, "BLOCK", 3, raising=False)
    monkeypatch.setattr(lk, "SEEN", 20, raising=False)
    rng = random.Random(5)
    names = ["hot", "h", "a name of twelve+", "a name of twelve-", "a name of tw", "a name of twelve+ and many more", "a name of twelve+ and many less", "é\U0001f600", "unheld", "", None]
    links = ["[[hot]]", "[[hot]] [[hotter]]", "[[a name of twelve+ and many more]] [[a name of twelve+ and many", "[[[é\U0001f600]] [[a name of tw", "[[", "no link", None]
    notes = [(i, rng.choice(names[:3] + names), rng.choice(links[:2] + links)) for i in range(120)]
    notes += [(7, "hot", "[[a name of twelve+ and many more]]"), (7, "hot", "[[a name of twelve+ and many more]]"), (7, "a name of twelve+", "[[hot"), (None, "hot", "[[hot")]
    df = spark.createDataFrame(notes, "path long, name string, content string")
    out = lk.prefix_backlinks(df)
    want = sorted((d, s) for d, n, _ in notes for s, _, c in notes if None not in (d, s, n, c) and "[[" + n in c and d != s)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 2_000
    # above the join that makes the pairs nothing gathers or moves them
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in above and "Repartition" not in above and "Sort" not in above
    assert lk.prefix_backlinks(df.where("name is null")).count() == 0 and lk.prefix_backlinks(df.limit(0)).count() == 0


def test_definitions(spark):
    cases = {
        '  pub extern "C" unsafe fn f1(': ("function", "f1"), "#[inline] #[cfg(x)] pub(crate) async fn go<T>": ("function", "go"), "const unsafe fn k": ("function", "k"), "\tstruct S;": ("struct", "S"), "pub enum E {": ("enum", "E"),
        "static mut COUNT: u8": ("const", "COUNT"), "pub const MAX_1: u8": ("const", "MAX_1"), "mod tests {": ("module", "tests"), "unsafe trait T: U": ("trait", "T"), "impl Plain {": ("impl", "Plain"), "type A<T> = B": ("type", "A"),
        "unsafe impl<T: Into<U>> a::B<T> for C<T> {": ("impl", "a::B for C"), "impl<T> Vec<T> {": ("impl", "Vec"), "macro_rules! m {": ("macro", "m"), "// fn x": None, "fnx y": None, "unsafe struct S": None, "let x = fn": None, "": None, "pub": None, "published fn": None,
    }
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "line string")
    got = {r.line: [tuple(x) for x in r.s] for r in df.select("line", tx.symbols(F.col("line")).alias("s")).collect()}
    assert got == {c: [x] if x else [] for c, x in cases.items()} | {None: []}
