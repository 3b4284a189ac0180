"""Functions and operators on small rows whose answers are known."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.functions.versions import version, version_range
from weftline.operators import lines as ln, links as lk, predicates as pr, rules as ru, series as se


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


CASES = [
    (tx.slug, "It's A -- Test!", "its-a-test"), (tx.url_file, "http://h/p/f.mp3?x=1", "1"), (tx.url_file, "http://h/p/f.mp3?x", "f.mp3"), (tx.snake, "getHTMLName_Of", "get_h_t_m_l_name_of"),
    (tx.stem, "/a/b.c/d.tar.gz", "d.tar"), (tx.stem, "/a/.rc", ".rc"), (tx.extension, "/a.b/X.MD", "md"), (tx.unquote, "'a\"'", "a\""), (tx.unquote, "'a\"", "'a\""), (tx.error_code, "A-b c", "a_b_c"),
    (tx.link_names, "[[a]] x [[b|c]] ![[a]] [[A]]", ["a", "b", "A"]), (tx.without_links, " [[a]] see [[b|c]] ", "see"), (tx.squeeze, " a \n\t b ", "a b"), (tx.split_trim, "a; b ;c", ["a", "b", "c"]),
    (tx.integer_kind, "0b101", "binary"), (tx.integer_kind, "089", "bad octal"), (tx.integer_kind, "017", "octal"), (tx.integer_kind, "0xFf", "hex"), (tx.integer_kind, "12", "decimal"), (tx.integer_kind, "1.2", None),
    (tx.record_map, "a-b-c: x'y\nno colon\nd: 1:2", {"a_b-c": "x_y", "d": "1:2"}), (tx.query_map, "http://h/?a=1&b=2=3&a=4&c#d?e=5", {"a": "1", "b": "2=3", "c": ""}), (tx.capitalise, "it's a-b éA", "It'S A-B Éa"),
]


@pytest.mark.parametrize("f,given,wanted", CASES)
def test_text(spark, f, given, wanted):
    assert one(spark, f(F.col("s")), s=given) == wanted


@pytest.mark.parametrize("n", range(1, 14))
def test_cut_bytes(spark, n):
    for s in ("aé漢😀bé", "", "abc", "漢漢漢漢", "éé"):
        raw = s.encode()
        want = s if len(raw) <= n else raw[:n].decode("utf-8", "ignore") + "…"
        assert one(spark, tx.cut_bytes(F.col("s"), n), s=s) == want


def test_natural_key(spark):
    names = ["f10", "f2", "f1b", "f1", "10", "9x"]
    d = spark.createDataFrame([(x,) for x in names], "s string")
    assert [r.s for r in d.orderBy(tx.natural_key(F.col("s"))).collect()] == ["9x", "10", "f1", "f1b", "f2", "f10"]


def test_versions(spark):
    less = lambda a, b: one(spark, version(F.lit(a)) < version(F.lit(b)), x=1)
    assert less("5.9", "5.10") and less("5.3", "5.3.0") and not less("5.10", "5.9")
    for s, want in {"5.3": ([5, 3], [5, 3]), "5.3-7.0": ([5, 3], [7, 0]), "-7": ([4, 0], [7]), "5-": ([5], [99, 9]), "x": None, "-": None}.items():
        assert one(spark, version_range(F.col("s")), s=s) == want


def test_patterns(spark):
    d = spark.createDataFrame([("Alpha.md",), ("alpine",), ("a.md",), ("xaxlx",)], "s string")
    found = lambda *a, **k: {r.s for r in d.where(pr.pattern(F.col("s"), *a, **k)).collect()}
    assert found(".md") == {"Alpha.md", "a.md"} and found("^al", case="smart") == {"Alpha.md", "alpine"} and found("^Al", case="smart") == {"Alpha.md"}
    assert found("al", "letters") == {"alpine", "xaxlx"} and found("?.md", "glob") == {"Alpha.md", "a.md"} and found("^?.md$", "glob") == {"a.md"} and found(".") == found("(", "regex", invert=True) == {r.s for r in d.collect()} and found("(", "regex") == {r.s for r in d.collect()} and found("p", invert=True) == {"a.md", "xaxlx"}


@pytest.fixture(scope="module")
def notes(spark):
    rows = [("/v/a.md", "a", "---\ntitle: x\n---\n# head\n\nSee [[b|Bee]] and [[B]].\n---\nhidden\n---\nrest"), ("/v/b.md", "b", "[[a]]\n![[c]] tail\nline ![[A]]"), ("/v/c.md", "c", "---\nk: v\n---\none\n---\ntwo"), ("/v/d.md", "foobar", "[[foobar]] [[nowhere]] [[foo]]"), ("/v/e.md", "A", "other a")]
    return spark.createDataFrame(rows, "path string, name string, content string")


def test_links(notes):
    got = {(r.src, r.name): r.path for r in lk.resolve(lk.edges(notes), notes).collect()}
    assert got[("/v/a.md", "b")] == got[("/v/a.md", "B")] == "/v/b.md" and got[("/v/b.md", "a")] == "/v/a.md" and got[("/v/d.md", "foo")] is None and len(got) == 8
    back = {(r.dst, r.src) for r in lk.backlinks(lk.resolve(lk.edges(notes), notes)).collect()}
    assert back == {("/v/b.md", "/v/a.md"), ("/v/a.md", "/v/b.md"), ("/v/c.md", "/v/b.md")}
    assert {(r.src, r.context) for r in lk.contexts(notes, "a").collect()} == {("/v/b.md", "(link only)")}
    assert [(r.at, r.line) for r in lk.transclude(notes).where("line_no = 2").orderBy("at").collect()] == [(4, "one"), (5, "---"), (6, "two")]
    moved = {r.path: (r.changed, r.content) for r in lk.rename(notes, "b", "n$w").collect()}
    assert moved["/v/a.md"][0] and "[[n$w|Bee]] and [[n$w]]" in moved["/v/a.md"][1] and not moved["/v/d.md"][0]


def test_lines(spark, notes):
    rows = ln.lines(notes, "path", "content")
    assert {r.path: r.preview for r in ln.first_content(rows, "path").collect()} == {"/v/a.md": "See [[b|Bee]] and [[B]].", "/v/b.md": "![[c]] tail", "/v/c.md": "one", "/v/e.md": "other a"}
    fences = spark.createDataFrame([(1, "x\n```py\ny\n```\nz")], "k int, t string")
    assert [r.line for r in ln.in_fence(ln.lines(fences, "k", "t"), "k").where("in_fence").orderBy("line_no").collect()] == ["y", "```"]
    text = spark.createDataFrame([(1, "aa bb  ccc\ndddddddd e"), (2, None), (3, "")], "k int, t string")
    assert {r.k: r.wrapped for r in ln.wrap(text, "k", "t", 6).collect()} == {1: "aa bb\nccc\ndddddddd\ne", 2: "", 3: ""}


def test_series(spark):
    d = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabba")], "k int, i int, kind string")
    assert [r.next_opposite for r in se.next_opposite(d, "k", "i", F.col("kind")).orderBy("i").collect()] == [2, 2, 4, 4, 2]
    names = spark.createDataFrame([(i, "x") for i in range(4)] + [(9, "y")], "i int, name string")
    assert [r.free_name for r in se.free_names(names, "name", "i").orderBy("i").collect()] == ["x", "x_", "x_0", "x_1", "y"]
    assert [r.i for r in se.rotated(d, "k", "i", 2).orderBy("turn").collect()] == [2, 3, 4, 0, 1]
    assert se.seeded_sample(d, "i", 3, 1).count() == 3 and se.seeded_sample(d, "i", 99).count() == 5


def test_suppression(spark):
    d = spark.createDataFrame([(1, i, k) for i, k in enumerate(["x", "off", "x", "on", "x", "off", "x"])], "k int, i int, kind string")
    got = ru.unsuppressed(d, "k", "i", F.col("kind") == "off", F.col("kind") == "on")
    assert [r.i for r in got.orderBy("i").collect()] == [0, 1, 4, 5]


def test_sources(spark, tmp_path):
    from weftline.sources import files as so

    (tmp_path / "deep").mkdir()
    for name, content in {"2024-01-02.md": "day", "abcd-ef-gh.md": "no date", "deep/n.md": "né", "t.toml": "[colors.primary]\nbackground = '#000'\n[[colors.indexed_colors]]\nindex = 16\n", "list.txt": "u1\n\nu2\n", "scrape.txt": "a url='x' url=\"y\"\nnone\n"}.items():
        (tmp_path / name).write_text(content)
    (tmp_path / "feed.rss").write_text('<rss><channel><item><enclosure url="e1"/></item><item><title>t</title></item></channel></rss>')
    root = str(tmp_path)
    assert {r.name: r.content for r in so.notes(spark, root).collect()} == {"2024-01-02": "day", "abcd-ef-gh": "no date", "n": "né"}
    assert {r.name for r in so.daily_notes(spark, root).collect()} == {"2024-01-02", "abcd-ef-gh"}
    listing = so.listing(spark, root, "*.md")
    assert {(r.relative, r.depth) for r in listing.collect()} == {("2024-01-02.md", 0), ("abcd-ef-gh.md", 0), ("deep/n.md", 1)}
    assert so.flat(listing, 0).count() == 2 and so.flat(listing, -1).count() == 3 and so.excluded(listing, "relative", ["deep/*"]).count() == 2
    assert {(r.name, r.key, r.value) for r in so.themes(spark, root).collect()} == {("t", "colors.primary.background", "#000"), ("t", "colors.indexed_colors.0.index", "16")}
    assert [r.value for r in so.lines_of(spark, f"{root}/list.txt").collect()] == ["u1", "u2"]
    assert [r.url for r in so.feed_urls(spark, f"{root}/feed.rss").collect()] == ["e1"] and [r.url for r in so.scraped_urls(spark, f"{root}/scrape.txt").collect()] == ["y"]


def test_stream(spark, tmp_path):
    from weftline.streaming.ingest import first_seen, run_once

    (tmp_path / "in").mkdir()
    for n, urls in enumerate((["a", "b", "a"], ["b", "c"])):
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(urls))
        stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "url")
        run_once(first_seen(stream, "url"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_more_rules(spark):
    from weftline.operators import sets as st

    calls = spark.createDataFrame([(1, "F", ["a", "b"]), (2, "f", ["x"]), (3, "g", ["a"])], "i int, name string, args array<string>")
    rules = spark.createDataFrame([("f", 1, "a"), ("F", 2, None)], "name string, position int, value string")
    assert sorted((r.i, r.position) for r in ru.argument_rules(calls, rules).collect()) == [(1, 1), (1, 2)]
    d = spark.createDataFrame([(1, i, k) for i, k in enumerate(["x", "on", "x", "off", "x", "on", "on", "x"])], "k int, i int, kind string")
    spans = ru.inside_spans(d, "k", "i", F.col("kind") == "on", F.col("kind") == "off")
    assert [r.opened_at for r in spans.orderBy("i").collect()] == [None, None, 1, None, None, None, 5, 6]
    assert one(spark, ru.balanced(F.col("s"), "%[ds]", F.array(F.lit(1))), s="a %s 100%%s") and not one(spark, ru.same_multiset(F.split("s", ""), F.array(F.lit("b"), F.lit("a"))), s="bb")
    none = d.limit(0).select("i")
    assert st.selected(d, none, "i").count() == 8 and st.selected(d, d.where("i < 3"), "i").count() == 3
    assert st.tagged(d, d.select("i", F.col("kind").alias("tag")), "i", "tag", ["on"]).count() == 3


def test_joined_blocks(spark):
    rows = [("a", i, "r", "long text " * 5 + str(i)) for i in range(150)] + [("a", 3, "r", "again"), ("a", None, "r", "last"), (None, 1, "s", "x"), (None, 0, "s", "y"), ("b", -5, "r", "")]
    d = spark.createDataFrame(rows, "k string, i long, role string, text string")
    got = ln.joined_blocks(d, "k", "i", ["role", "text"], F.concat("role", F.lit(": "), "text"), "t", 64, 10).orderBy("k", "block").collect()
    for k in ("a", "b", None):
        want = [f"{r}: {t}" for x, i, r, t in sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[2], x[3])) if x == k]
        own = [r for r in got if r.k == k]
        assert "\n".join(r.t for r in own) == "\n".join(want) and [r.block for r in own] == list(range(len(own))) and all(r.n_lines == 64 for r in own[:-1])


def test_previews_cut_whole_characters(spark):
    rows = [(1, "# head\n\n" + "é漢" * 20), (2, "---x\n" + "a" * 60), (3, " \t" + "a" * 61 + "\nb"), (4, "short "), (5, "\n  \n#"), (6, "b" * 59 + "é"), (7, "--- a\nno\n---\n[[x]] and [[y]]\n[[x]] z")]
    want = {}
    for i, text in rows:
        shown, inside = None, False
        for x in text.split("\n"):
            if x.startswith("---"):
                inside = not inside
            elif not inside and x.strip() and not x.strip().startswith("#") and not (x.strip().startswith("[[") and x.strip().endswith("]]")):
                shown = x.strip()
                break
        if shown is not None:
            raw = shown.encode()
            want[i] = shown if len(raw) <= 60 else raw[:60].decode("utf-8", "ignore") + "…"
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.preview for r in ln.first_content(ln.lines(d, "doc_id", "text"), "doc_id", 60).collect()} == want and want[7] == "[[x]] z"


def test_odd_values_end_no_job(spark):
    from weftline.operators import sets as st

    d = spark.createDataFrame([("a1",), ("b",)], "s string")
    assert st.tagged(d, spark.createDataFrame([("b", 1), ("b", 1), ("b", 2)], "s string, tag int"), "s", "tag", [1]).count() == 1
    assert [one(spark, version(F.col("s")), s=x) for x in ("", "7.4RC1", "5.10")] == [None, None, [5, 10]] and one(spark, version(F.col("s"), 3), s="5.3") == [5, 3, 0]
    assert one(spark, tx.record_map(F.col("s")), s="a: 1\nb: 2\na: 3") == {"a": "3", "b": "2"}
    long = ["x" + "9" * 25, "x1" + "0" * 25, "x" + "0" * 30 + "7", "x8"]
    assert [r.s for r in spark.createDataFrame([(x,) for x in long], "s string").orderBy(tx.natural_key(F.col("s"))).collect()] == [long[2], long[3], long[0], long[1]]
    assert one(spark, tx.show_links(tx.hide_links(F.col("s"))["text"], tx.hide_links(F.col("s"))["links"]), s="[[a]][[b c]] d [[e]]") == "[[a]][[b c]] d [[e]]"


def test_filter_stack_taken_apart():
    s = pr.FilterStack().add("name", "x").add("type", "d").combine("or").combine("not")
    assert s.show() == ["not ((name x) or (type d))"] and s.decompose().show() == ["(name x) or (type d)"] and s.decompose().decompose().show() == ["name x", "type d"]
    assert s.decompose().decompose().rotate().show() == ["type d", "name x"] and s.add("hash", "1").decompose().show() == s.show() and s.clear().show() == []


def test_current_and_samples(spark, tmp_path):
    from weftline.sources import sinks as si

    named = spark.createDataFrame([("dark", "1"), ("light", "2")], "key string, value string")
    want = lambda k: spark.createDataFrame([(k,)], "key string")
    for k in ("dark", "light", "dark"):
        assert [tuple(r) for r in si.set_current(named, want(k), str(tmp_path / "t")).collect()] == [(k, {"dark": "1", "light": "2"}[k])]
    assert si.set_current(named, want("none"), str(tmp_path / "t")).count() == 0
    d = spark.range(5)
    assert se.exact_sample(d, "id", 5).count() == 5 and se.exact_sample(d, "id", 6).count() == 0


def test_nested_spans(spark):
    import random

    random.seed(5)
    kinds = ["open", "open", "x", "close", "y", "close", "z", "close", "w"] + random.choices(["open", "close", "x"], k=400)
    d = spark.createDataFrame([(k, i, x) for k in (1, None) for i, x in enumerate(kinds)], "k int, i int, kind string")
    stack, want = [], []
    for i, x in enumerate(kinds):
        if x == "close" and stack:
            stack.pop()
        want.append(stack[-1] if stack else None)
        if x == "open":
            stack.append(i)
    assert want[:9] == [None, 0, 1, 0, 0, None, None, None, None]
    got = ru.inside_nested(d, "k", "i", F.col("kind") == "open", F.col("kind") == "close")
    assert got.columns == ["k", "i", "kind", "opened_at"] and {(r.k, r.i): r.opened_at for r in got.collect()} == {(k, i): x for k in (1, None) for i, x in enumerate(want)}
    scopes = spark.createDataFrame([(1, 2, 9), (1, 4, 6), (1, 9, 12), (2, 0, 3)], "k int, opener int, closer int")
    tokens = spark.createDataFrame([(k, i) for k in (1, 2, 3) for i in range(14)], "k int, i int")
    span = {(r.k, r.i): r.opened_at for r in ru.inside_scopes(tokens, scopes, "k", "i").collect()}
    assert span == {(k, i): max((o for s, o, c in [(1, 2, 9), (1, 4, 6), (1, 9, 12), (2, 0, 3)] if s == k and o < i < c), default=None) for k in (1, 2, 3) for i in range(14)}


def test_free_names_avoid_existing(spark):
    for names, want in (
        (["x", "x", "x_"], ["x", "x_0", "x_"]), (["x", "x_", "x", "x_0", "x", "x_2", "x"], ["x", "x_", "x_1", "x_0", "x_3", "x_2", "x_4"]), (["x_", "x_", "x", "x", "x__"], ["x_", "x__0", "x", "x_0", "x__"]),
        (["_", "", "", ""], ["_", "", "_0", "_1"]), (["a_01", "a", "a", "a_99999999999999999999", "a\n_", "a\n", "a\n"], ["a_01", "a", "a_", "a_99999999999999999999", "a\n_", "a\n", "a\n_0"]),
    ):
        d = spark.createDataFrame(list(enumerate(names)), "i int, name string")
        got = [r.free_name for r in se.free_names(d, "name", "i").orderBy("i").collect()]
        assert got == want and len(set(got)) == len(got)
