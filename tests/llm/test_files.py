"""Sharding, archives, pages and dialogues."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest


def test_hilbert_index():
    from weftline.llm.hilbert_shards import hilbert_index

    for n, b in ((1, 3), (2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << b)] * n, indexing="ij"), -1).reshape(-1, n)
        h = hilbert_index(cells, b)
        assert sorted(h) == list(range(1 << (b * n)))
        assert (np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("rows", [0, 3, 16, 45])
def test_shards_of_few_rows(spark, rows):
    from weftline.llm.hilbert_shards import shard

    d = spark.createDataFrame([(i // 2 or None, ["x", None, "", "ü"][i % 4], "en" if i % 3 else None, "s", i) for i in range(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = shard(d).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == rows and all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(16))
    sizes = [len(slots.get(s, ())) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_shards(spark, sf, tmp_path):
    from weftline.llm import hilbert_shards as hs

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    got = hs.shard(docs)
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all(r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got.collect())
    order = [r.curve for r in got.orderBy("shard", "slot").collect()]
    assert order == sorted(order)
    manifest = hs.zones(got, ["lang", "source", "n_chars"])
    few = hs.prune(manifest, "lang", "es", "es")
    assert set(few) >= {r.shard for r in got.where("lang = 'es'").collect()} and len(few) < 16
    hs.write_shards(docs, got, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 16


def test_warc(spark, sf):
    from weftline.llm import common, warc

    p = spark.read.parquet(f"{sf}/pages.parquet")
    odd = [(None, None, None), (7777777, "u\r\nx: y", "a\r\n\r\nb" * 300), (7777778, "u", None), (7777779, "v", "a\r\n\r\nb" * 300), (None, "w", "a\r\n\r\nb" * 300), (7777780, "é", "short"), (7777781, "z", "short"), (5555, "r", "R" * 1000), (5555, "r", "R" * 1000), (5554, "q", "R" * 1000)]
    p = p.union(p.limit(3).selectExpr("page_id + 100000", "url", "html")).union(spark.createDataFrame(odd, p.schema))
    rows, ids = p.collect(), defaultdict(list)
    for r in rows:
        ids[r.html or ""].append(r.page_id)
    want = Counter()
    for r in rows:
        t = r.html or ""
        top = max((i for i in ids[t] if i is not None), default=None)
        again = len(t.encode()) >= 1000 and len(ids[t]) > 1 and top is not None and r.page_id != top
        want[r.page_id, len(t.encode()), hashlib.sha1(t.encode()).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    assert Counter(map(tuple, warc.pages_through_warc(p).collect())) == want
    path = common.place(spark, "warc-test")
    warc.archive_pages(p, path)
    whole = warc.follow_revisits(warc.read_warc(spark, path))
    assert Counter(r.payload for r in whole.collect()) == Counter(r.html or "" for r in rows)
    assert warc.pages_through_warc(p.limit(0)).count() == 0


def test_archives_are_bounded_by_bytes(spark):
    import gzip

    from weftline.llm import common, warc

    most = 20_000
    rows = [(i, f"http://h/{i}", chr(97 + i % 26) * (50_000 if i % 40 == 7 else 100 + 97 * (i % 50)) + str(i)) for i in range(300)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = common.place(spark, "warc-bytes")
    warc.archive_pages(p, path, archive_bytes=most)
    found = [len(gzip.decompress(r.content)) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    counts = [sum(1 for _ in warc._records(r.content)) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert len(found) > 20 and sum(counts) == 300 and all(size <= most or n == 1 for size, n in zip(found, counts, strict=True))
    assert sum(size > most for size in found) == sum(len(t) > most for _, _, t in rows)
    whole = warc.follow_revisits(warc.read_warc(spark, path))
    assert {(r.page_id, r.url, r.payload) for r in whole.collect()} == set(rows)
    sizes = {r.page_id: r.payload_bytes for r in warc.pages_through_warc(p, archive_bytes=most).collect()}
    assert sizes == {i: len(t) for i, _, t in rows}


def test_host_paths(spark, sf):
    from weftline.llm import host_paths as hp

    p = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(1000000, None, None), (1000001, "x", ""), (1000002, "http://h/", "plain a < b &amp; c"), (1000003, "http://h/", "<p>" * 300)], p.schema)
    for broadcast in (1 << 20, 0):
        got = {r.page_id: r for r in hp.extract_pages(p.union(odd), broadcast_bytes=broadcast).collect()}
        for r in p.collect():
            article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1).replace("<b>", "")
            blocks = [" ".join(html.unescape(x.replace("<br>", " ")).split()) for x in re.split(r"</?(?:h1|p)>", article)]
            assert got[r.page_id].text == "\n\n".join(x for x in blocks if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
        assert [got[1000000 + i].text for i in range(4)] == ["", "", "plain a < b & c", ""]


def test_blocks():
    from weftline.llm import host_paths as hp

    page = '<!DOCTYPE html><html><body><header><h1>Site</h1></header><nav><a href=x>m</a></nav><div class="content post-12"><article class="post"><header><h2>T &amp; U</h2></header><p>One &lt;b&gt; two<br>three <a href=y>link</a> more.<p>Four <i>f</i>ive.<ul><li>a<li>b</ul><aside>no</aside><div class="ad">no</div><div id="comments"><p>comments longer than the article, which they are not part of at all</p></div><form>x<input></form></article></div><footer>no</footer><script>if(a<b){"</p>"}</script>'
    assert hp.extract(hp.read_blocks(page), []) == "T & U\n\nOne <b> two three link more.\n\nFour five.\n\na\n\nb"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='single has-sidebar'><article>{}</article><div class='sidebar'><p>side</p></div></body>",
        "<body><main class='content-with-sidebar'>{}<div id='comments'><p>said</p></div></main></body>",
        "<body class='sidebar'><main id='search'><article class='post no-ads comments-open ad' role='alert'>{}</article></main><nav>go</nav></body>",
        "<body><div class='wrap widget'><article>{}</article><div class='ad-12'><p>buy</p></div></div></body>",
        "<body><div class='widget'>{}</div></body>",
    ],
)
def test_hints_do_not_hide_the_article(spark, page):
    from weftline.llm import host_paths as hp

    html_ = page.format("<h1>Title here</h1><p>" + "The first paragraph of a text. " * 9 + "</p><p>And the last one.</p>")
    want = "\n\n".join(["Title here", ("The first paragraph of a text. " * 9).strip(), "And the last one."])
    blocks = hp.read_blocks(html_)
    assert hp.best_path(blocks) is not None and hp.extract(blocks, []) == want
    d = spark.createDataFrame([(1, "http://h/a", html_), (2, "http://h/b", html_)], "page_id long, url string, html string")
    assert [r.text for r in hp.extract_pages(d).collect()] == [want] * 2


BODY = "<p>" + "The first paragraph of a text. " * 9 + "</p><p>And the last one.</p>"
TEXT = ["Title here", ("The first paragraph of a text. " * 9).strip(), "And the last one."]


@pytest.mark.parametrize(
    "page,heading",
    [
        ("<body class='nav-open'><div class='layout right-sidebar'><h1>Title here</h1>{}</div></body>", True),
        ("<body><form id='aspnetForm'><nav>go there</nav><div><h1>Title here</h1>{}</div><form><label>Mail</label></form></form></body>", True),
        ("<body><article class='post tag-search'><header><h1>Title here</h1></header>{}</article></body>", True),
        ("<body><div class='post'><header><h1>Title here</h1></header>{}</div></body>", True),
        ("<body><header>Site name tagline</header>{}</body>", False),
        ("<div><header><h1>Site</h1></header>{}<footer>end</footer></div>", False),
        ("<body><header><h1>Site</h1></header><main><h1>Title here</h1>{}<aside>see also</aside></main></body>", True),
        ("<body><article><h1>Title here</h1>{}</article><div id='c1'>" + "<p>What a reader had to say about this. </p>" * 40 + "</div></body>", True),
        ("<body><div id='x'><h1>Title here</h1>{}</div><div id='c1'>" + "<p>What a reader had to say about this. </p>" * 40 + "</div></body>", True),
        ("<body><div id='top'><h1>Site</h1></div><div id='text'>{}</div></body>", False),
        ("<body><div class='site-header'><h1>Site</h1><p>tagline</p></div><div class='cookie-banner'><p>We use cookies.</p></div><div class='entry'>{}<div class='share-buttons'>Tell others</div></div><div class='comments-area'><p>said one</p></div></body>", False),
        ("<body><div class='page has-comments no-ads'><h1>Title here</h1>{}<p class='no-share'></p></div><div class='widget-area'><p>side</p></div></body>", True),
        ("<body><div class='menu-wrap'><div class='text related-style'>{}</div></div></body>", False),
        ("<body><div id='fb' class='promo'><h1>Title here</h1>{}</div></body>", True),
        ("<body><main>{}</main><div class='comments'><article>" + "<p>What a reader had to say about this. </p>" * 90 + "</article></div></body>", False),
    ],
)
def test_ordinary_layouts(page, heading):
    from weftline.llm import host_paths as hp

    assert hp.extract(hp.read_blocks(page.format(BODY)), []) == "\n\n".join(TEXT if heading else TEXT[1:])


def test_blocks_that_a_host_repeats(spark):
    from weftline.llm import host_paths as hp

    page = lambda i: f"<body><div><p>All prices without tax.</p><h1>Page {i}</h1><p>{'text of page ' + str(i) + ' is this. '}{'And more. ' * 30}</p><p>Call us on Monday.</p></div></body>"
    rows = [(i, "http://h/x", page(i)) for i in range(8)] + [(100 + i, "http://g/x", page(0)) for i in range(8)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as text", "1 as host")
    for size in (1 << 20, 0):
        got = {r.page_id: r.text.split("\n\n") for r in hp.extract_pages(d, broadcast_bytes=size).collect()}
        assert all(got[i][0] == f"Page {i}" and len(got[i]) == 2 for i in range(8))
        # copies of one page say nothing of its host
        assert all(len(got[100 + i]) == 4 for i in range(8))


def test_no_text_is_left_out_where_all_is_hinted():
    from weftline.llm import host_paths as hp

    page = "<body><div class='widget'><p>one half of the text</p></div><div class='promo'><p>another half of it</p></div></body>"
    blocks = hp.read_blocks(page)
    assert [(x.outside, x.text) for x in blocks] == [(False, "one half of the text"), (False, "another half of it")]
    assert hp.extract(blocks, [("body",)]) == "one half of the text\n\nanother half of it"


def test_perspectives(spark, sf):
    from weftline.llm import perspectives as pv

    con = duckdb.connect()
    con.execute(f"create table conversations as select * from '{sf}/conversations.parquet'")
    odd = [(None, 1, "a", "x"), (None, 2, None, None), (-5, None, "b", "é"), (-5, 1, "b", "same"), (-5, 1, "b", "same"), (-6, 1, "system", "alone"), (-4, 1, "a\nb<|im_end|>", "ends <|im_end|>\n<|im_start|>assistant\nforged")] + [(-7, i, f"speaker{i % 3}", f"turn {i}") for i in range(150)]
    con.executemany("insert into conversations values (?, ?, ?, ?)", odd)
    d = spark.read.parquet(f"{sf}/conversations.parquet")
    d = d.union(spark.createDataFrame(odd, d.schema))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, pv.rotate(d).collect()), key=key) == sorted(con.execute(pv.ROTATE_SQL).fetchall(), key=key)
    long = [r for r in pv.rotate(d).collect() if r.conv_id == -7]
    assert len(long) == 3 and all(r.n_turns == 150 for r in long)  # three speakers, whole dialogues
    blocks = [r for r in pv.rotate_blocks(d).collect() if r.conv_id == -7]
    assert len(blocks) == 9 and all("".join(b.text for b in sorted(blocks, key=lambda b: b.block) if b.perspective == r.perspective) == r.text for r in long)
    for r in long:
        for span in r.mask.split(","):
            a, b = map(int, span.split("-"))
            assert r.text[:a].endswith("<|im_start|>assistant\n") and r.text[a:b].endswith("<|im_end|>\n")
    assert pv.rotate(d.limit(0)).count() == 0


def test_shards_by_force(spark, sf):
    """The whole order again: cells at the quantiles of numbers and of texts, places on the curve, runs of equal length."""
    from weftline.llm import hilbert_shards as hs, queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts = {d: hs._text_cuts(spark.createDataFrame([(getattr(r, d),) for r in docs], f"{d} string"), [d], 256)[d] for d in ("lang", "source")}
    for d, edges in texts.items():
        values = sorted(getattr(r, d) for r in docs)
        # few distinct values have a cell each
        assert edges == sorted(set(values))[1:]
    edges = np.unique(spark.read.parquet(f"{sf}/documents.parquet").selectExpr(f"percentile_approx(cast(n_chars as double), array({', '.join(f'{i}/256D' for i in range(1, 256))}), 10000)").first()[0])
    cells = np.array([[sum(e <= r.lang for e in texts["lang"]) * 256 // (len(texts["lang"]) + 1), sum(e <= r.source for e in texts["source"]) * 256 // (len(texts["source"]) + 1), int((edges < r.n_chars).sum()) * 256 // (len(edges) + 1)] for r in docs])
    curve = hs.hilbert_index(cells, 8)
    order = sorted((int(k), r.doc_id, zlib.crc32(r.text.encode()), len(r.text.encode()) + 1) for k, r in zip(curve, docs, strict=True))
    want, n = {}, len(order)
    for at, (k, i, crc, size) in enumerate(order):
        wide = n % 16 * (n // 16 + 1)
        shard, slot = divmod(at, n // 16 + 1) if at < wide else (n % 16 + (at - wide) // (n // 16), (at - wide) % (n // 16))
        want[i] = (size, crc, "rows", shard, slot, None, k)
    got = queries.op1_hilbert_shards(spark, sf).collect()
    assert len(got) == n and {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard, r.curve) for r in got} == want


def test_text_cuts_tell_long_texts_apart(spark):
    from weftline.llm import hilbert_shards as hs

    urls = [f"http://h/{'x' * 40}/{i:05d}" for i in range(3000)] + ["a", None]
    cuts = hs._text_cuts(spark.createDataFrame([(u,) for u in urls * 2], "u string"), ["u"], 16)["u"]
    known = sorted(u for u in urls if u)
    sizes = np.diff([0, *(known.index(c) for c in cuts), len(known)])
    assert len(cuts) == 15 and sizes.max() < 1.3 * sizes.min()
    # one value with half of all rows
    cuts = hs._text_cuts(spark.createDataFrame([("m",)] * 500 + [(f"n{i:03d}",) for i in range(500)], "u string"), ["u"], 8)["u"]
    assert len(cuts) == 4 and all(c >= "n" for c in cuts)


CLASH = ["id", "host", "path", "winners", "position", "_part", "n_rows", "curve", "_d0", "shard", "payload", "_key", "first", "score", "toxic", "h", "n", "archive", "value"]


def with_clash(d):
    return d.selectExpr("*", *(f"'{x}' as {x}" for x in CLASH if x not in d.columns))


def test_clashing_columns_and_long_texts(spark, sf):
    from pyspark.sql import functions as F

    from weftline.llm import hilbert_shards as hs, host_paths as hp, perspectives as pv, toxic_crf as tc, warc

    long = " ".join(f"word{i % 991}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, None, None, None, None), (3, "", "de", "t", 0), (None, "x", "", "", 5)], "doc_id int, text string, lang string, source string, n_chars int")
    got = {r.doc_id: r for r in hs.shard(with_clash(docs)).collect()}
    assert len(got) == 4 and got[1]["size"] == len(long) + 1 and got[2]["size"] == 1 and got[2].text_crc32 == 0
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1)], "doc_id int, toxic int")
    scored = tc.score(with_clash(docs), tc.fit(with_clash(docs), labels)).collect()
    assert {r.doc_id for r in scored} == {1, 2, 3, None} and all(0 <= r.score <= 1 for r in scored)
    empty = docs.limit(0)
    assert tc.score(empty, tc.fit(empty, labels.limit(0))).count() == 0 and tc.score(docs, tc.fit(empty, labels)).count() == 4
    pages = spark.createDataFrame([(1, "http://h/", f"<body><article><p>{long}</p></article></body>"), (2, None, None), (3, "http://h/", "")], "page_id int, url string, html string")
    text = {r.page_id: r.text for r in hp.extract_pages(with_clash(pages)).collect()}
    assert text == {1: long, 2: "", 3: ""} and hp.extract_pages(pages.limit(0)).count() == 0
    twice = pages.union(pages.where("page_id = 1").withColumn("page_id", F.lit(9)))
    back = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.pages_through_warc(with_clash(twice)).collect()}
    assert back == {1: (len(long) + 39, "revisit", 9), 9: (len(long) + 39, "response", None), 2: (0, "response", None), 3: (0, "response", None)}
    talk = spark.createDataFrame([(1, 1, "a", long), (1, 2, "b", "short"), (1, 2, "b", "short")], "conv_id int, turn int, role string, text string")
    views = {r.perspective: r for r in pv.rotate(with_clash(talk)).collect()}
    assert set(views) == {"a", "b"} and views["a"].n_turns == 3 and long in views["b"].text and views["b"].n_assistant_turns == 2


def test_hot_keys_are_split(spark):
    """A key with most of the rows is dealt to many pieces, and no row is lost or repeated."""
    from pyspark.sql import functions as F

    from weftline.llm import common

    left = spark.range(20_000).selectExpr("id", "case when id % 3 < 2 then 7 else id end as k")
    right = left.groupBy("k").agg(F.max("id").alias("top")).where("k % 2 = 1")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for how in ("inner", "left", "left_semi"):
            got = common.skew_join(left, right, ["k"], counts, 20_000, ["id"], how)
            want = left.join(right, "k", how)
            assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
        hot = counts.where(F.col("n") * 1000 > 20_000)
        assert [r.k for r in hot.collect()] == [7]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pairs_of_one_head_are_split(spark):
    """Two thirds of all pairs have the same head: no task gets more than a fraction of them, and none is lost."""
    from pyspark.sql import functions as F

    from weftline.llm import common, minhash_dedup

    pairs = common.saved(spark.range(1, 9001).selectExpr("id as a", "case when id % 3 < 2 then 0L else id - 1 end as b"), "pairs")
    told = spark.range(9001).selectExpr("id as node", "cast(id as string) as word")
    for x, y in (("spark.sql.shuffle.partitions", "16"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(x, y)
    try:
        got = minhash_dedup._with_both(pairs, 9000, told, ["word"])
        assert {(r.a, r.b) for r in got.where("a_word = cast(a as string) and b_word = cast(b as string)").collect()} == {(r.a, r.b) for r in pairs.collect()}
        most = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        assert got.count() == 9000 and most < 2500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_relays_change_no_result(spark, sf, monkeypatch):
    """Messages that go by way of relays, as they do beyond 512 chunks, give the rows that direct ones give."""
    from weftline.llm import common, distinct_bpe, minhash_dedup, queries, substring_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")

    def results():
        yield substring_dedup.remove_repeats(docs, texts=False, chunk_bytes=60_000)
        yield distinct_bpe.encode_decode(docs, queries.tokenizer_file(), texts=False, chunk_bytes=60_000)
        yield minhash_dedup.near_duplicates(docs, chunk_bytes=20_000)

    direct = [sorted(map(tuple, x.collect())) for x in results()]
    monkeypatch.setattr(common, "DIRECT", 0)
    assert [sorted(map(tuple, x.collect())) for x in results()] == direct


@pytest.mark.parametrize("n", [1, 5, 37, 100])
def test_relays_bound_messages(spark, n, monkeypatch):
    """Every message arrives whole, and no sender, relay or receiver has more than the root of n messages."""
    from pyspark.sql import functions as F

    from weftline.llm import common

    rows = spark.range(n).selectExpr("cast(id as int) as chunk").repartitionById(n, F.col("chunk")).selectExpr("chunk", f"explode(sequence(0, {n - 1})) as bucket").selectExpr("cast(bucket as int) as bucket", "chunk", "encode(concat(bucket, '-', chunk), 'UTF-8') as keys")
    monkeypatch.setattr(common, "DIRECT", 0)
    side = int(np.ceil(np.sqrt(n)))
    assert common._relayed(rows, n, "bucket", "chunk").groupBy("bucket").count().where(f"count > {side}").count() == 0

    def told(key, table):
        assert table.num_rows == n and table.column("keys").to_pylist() == [f"{key[0]}-{x}".encode() for x in table.column("chunk").to_pylist()]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(set(table.column("chunk").to_pylist()))], pa.int64())})

    got = common.at_buckets(rows, n, told, "bucket int, n long").collect()
    assert sorted(map(tuple, got)) == [(i, n) for i in range(n)]


def test_messages_hold_distinct_keys_only():
    """What a chunk sends depends on its distinct keys, not on how many rows have them or how many other rows it has."""
    from weftline.llm import common as c

    rng = np.random.default_rng(1)
    few, size = rng.integers(0, 1 << 62, 500).astype(np.uint64), []
    for times in (1, 100):
        _, _, keys = c.distinct(np.repeat(few, times))
        size.append([sum(len(x) for x in c.ask(0, keys, np.ones(len(keys), np.int64), n).column("keys").to_pylist()) for n in (8, 128)])
    assert size[0] == size[1] and size[0][0] == size[0][1] == 4000


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from weftline.llm import common

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        common.shared(cluster)


@pytest.mark.parametrize(
    "inner",
    ["<p class='share-price'>{}</p>", "<h2 id='comment-on-law'>{}</h2>", "<h2 class='notice-of-meeting'>{}</h2>", "<div class='cookie-recipe'><p>{}</p></div>", "<div class='tab-menu-recipes'>{}</div>", "<p class='notice'>{}</p>", "<ul><li class='share'>{}</li></ul>"],
)
def test_names_within_an_article(inner):
    """Names of headings and paragraphs of an article are no hints, and parts of names only where links prevail."""
    from weftline.llm import host_paths as hp

    page = f"<body><nav>go</nav><article><h1>Title here</h1>{BODY}{inner.format('This is a part of it.')}</article></body>"
    assert hp.extract(hp.read_blocks(page), []) == "\n\n".join([*TEXT, "This is a part of it."])
    linked = f"<body><article><h1>Title here</h1>{BODY}<div class='share-buttons'><a href=x>Here</a> <a href=y>There</a></div><p class='ad'>buy</p><div class='social'>tell</div></article></body>"
    assert hp.extract(hp.read_blocks(linked), []) == "\n\n".join(TEXT)


def test_an_entry_is_no_widget():
    from weftline.llm import host_paths as hp

    page = f"<body><div class='entry social'>{BODY}</div><div class='entry social'><p>{'More of it. ' * 30}</p></div><div class='social'>tell</div></body>"
    assert hp.extract(hp.read_blocks(page), []) == "\n\n".join([*TEXT[1:], ("More of it. " * 30).strip()])


@pytest.mark.parametrize("n", [1, 2, 4, 6, 20])
def test_what_stands_within_a_text_stays(spark, n):
    """Headings and paragraphs that all pages of a host share are left out at the ends of a text only, and a page's middle is the same whatever the number of pages."""
    from weftline.llm import host_paths as hp

    page = lambda i: f"<body><div><p>All prices without tax.</p><h1>Page {i}</h1><p>{f'text of page {i} is this. ' * 20}</p><h2>Conclusion</h2><p>{'So it goes. ' * 40}</p><p>End of {i}.</p><p>Call us.</p></div></body>"
    rows = [(i, "http://h/x", page(i)) for i in range(n)] + [(100 + i, "http://h/y", page(0).replace("<body>", f"<body><nav>{i}</nav>")) for i in range(3)]
    got = {r.page_id: r.text.split("\n\n") for r in hp.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(n):
        middle = [f"Page {i}", (f"text of page {i} is this. " * 20).strip(), "Conclusion", ("So it goes. " * 40).strip(), f"End of {i}."]
        assert got[i] == (middle if n > 2 else ["All prices without tax.", *middle, "Call us."])


def test_votes_and_repeats_by_force(spark):
    """Votes, winners and repeated blocks against counts over plain lists."""
    from weftline.llm import host_paths as hp

    kinds = ["<div class='a{1}'><p>same</p><p>{0} {2}</p></div>", "<main><p>{0} {2}</p></main>", "<div><section><p>{0} {2}</p></section><p>tail</p></div>"]
    rows = [(f"h{i % 3}", kinds[(i * i) % 3 if i % 5 else 0].format(f"text {i // 2} of it", i, "and more " * 20)) for i in range(60)] + [("h0", None), ("h1", "")]
    votes = hp._votes(spark.createDataFrame(rows, "host string, html string")).persist()
    paths, seen = defaultdict(Counter), defaultdict(lambda: defaultdict(set))
    pages = defaultdict(set)
    for host, page in rows:
        blocks = hp.read_blocks(page or "")
        path = hp.best_path(blocks)
        if path is None:
            continue
        paths[host][" ".join(path)] += 1
        chosen = [x for x in blocks if not x.outside and x.path[: len(path)] == path]
        longest = max((x.text for x in chosen), key=lambda t: (len(t), t))
        pages[host].add(longest)
        for x in chosen:
            if not x.own:
                seen[host][hp._mark(x)].add(longest)
    cast = hp.host_votes(spark.createDataFrame(rows, "host string, html string"))
    assert {(r.host, r.path): r.votes for r in cast.collect()} == {(h, p): n for h, c in paths.items() for p, n in c.items()}
    winners = {r.host: list(r.winners) for r in hp.winning_paths(cast).collect()}
    assert winners == {h: [p for p, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if 10 * n >= c.total()] for h, c in paths.items()}
    repeated = {r.host: set(r.repeated) for r in hp.repeated_blocks(votes).collect()}
    assert repeated == {h: x for h, m in seen.items() if (x := {k for k, p in m.items() if len(p) >= 3 and 2 * len(p) >= len(pages[h])})} and repeated
