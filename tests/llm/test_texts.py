"""The text operators against brute force, on the small documents and on rows that are odd in every way."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
LONG = " ".join(f"long{i % 997}" for i in range(400_000))  # over 3 MB


def odd_rows():
    random.seed(1)
    chain = [f"w{i}" for i in range(60)]
    rows = [(100001, "a b c"), (100002, "A  b C"), (100003, ""), (100004, None), (100005, " \n\t "), (100006, "a b c d"), (100007, "x"), (100008, "x"), (100009, "é ü ß \x1c 漢字"), (100010, LONG), (100011, LONG + " more"), (None, "nobody has this"), (100012, "same row"), (100012, "same row")]
    for i in range(10):
        chain = list(chain)
        chain[random.randrange(60)] = f"z{i}"
        rows.append((200000 + i, " ".join(chain)))
    return rows


@pytest.fixture(scope="module")
def docs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(i, t, None) for i, t in odd_rows()], "doc_id long, text string, lang string")
    # columns whose names the operators use themselves
    return d.union(odd).selectExpr("*", "'x' as chunk", "1 as n_words", "false as kept", "'y' as node", "2 as score").repartition(5).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(docs):
    return docs.limit(0)


def test_substring_dedup(docs, texts):
    from weftline.llm.substring_dedup import remove_repeats

    rows = sorted((i, t or "") for i, t in texts if i is not None)
    words, first = {}, {}
    for i, t in rows:
        words.setdefault((i, t), WORD.findall(t))
        for p in range(len(words[i, t]) - 12):
            first.setdefault(tuple(words[i, t][p : p + 13]), i)
    got = {(r.doc_id, r.original or ""): r for r in remove_repeats(docs.withColumnRenamed("text", "t").selectExpr("*", "t as original"), text_col="t", carry=("original",)).collect()}
    removed = 0
    for (i, t), w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        kept, x = [a for a, b in zip(w, gone, strict=True) if not b], got[i, t]
        removed += sum(gone)
        assert (x.n_words, x.n_removed, x.kept_sha256) == (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        assert WORD.findall(x.kept_text or "") == kept and (gone.count(True) or x.kept_text == x.original)
    assert removed > 400_000 and got[None, "nobody has this"].n_removed == 0
    assert remove_repeats(docs).count() == len(texts) and remove_repeats(empty(docs), texts=False).count() == 0


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2000, "shard_words": 5000}])
def test_decontaminate(spark, sf, docs, texts, options):
    from weftline.llm.decontaminate import decontaminate

    items = [(900, "The"), (901, "und der"), (902, None), (903, "..."), (904, "the and attion to"), (None, "is of"), (905, "A b C"), (905, "A b C")]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").union(spark.createDataFrame(items, "item_id long, text string"))
    windows = defaultdict(set)
    for r in bench.collect():
        w = ALNUM.findall((r.text or "").translate(LOW))
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k and r.item_id is not None else 0):
            windows[tuple(w[j : j + k])].add(str(r.item_id))
    got = {(r.doc_id, r.original or ""): r for r in decontaminate(docs.withColumnRenamed("text", "t").selectExpr("*", "t as original"), bench, text_col="t", carry=("original",), **options).collect()}
    total = 0
    for i, t in texts:
        w = ALNUM.findall((t or "").translate(LOW))
        hit, items = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if found := windows.get(tuple(w[p : p + k])):
                    items |= found
                    hit[p : p + k] = [True] * k
        x = got[i, t or ""]
        total += sum(hit)
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (len(w), sum(hit), len(items), any(hit))
        assert x.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert ALNUM.findall((x.clean_text or "").translate(LOW)) == [a for a, b in zip(w, hit, strict=True) if not b]
    assert total > 100
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0 and decontaminate(empty(docs), bench).count() == 0


def test_near_duplicates(docs, texts):
    from weftline.llm.minhash_dedup import near_duplicates

    sets, inverted = [], defaultdict(list)
    for n, (_, t) in enumerate(texts):
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        for x in sets[n]:
            inverted[x].append(n)
    shared, root = Counter(), list(range(len(texts)))
    for x in inverted.values():
        for i in range(len(x)):
            for j in range(i):
                shared[x[i], x[j]] += 1

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in shared.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            root[find(a)] = find(b)
    least = defaultdict(list)
    for n, (i, _) in enumerate(texts):
        if i is not None:
            least[find(n)].append(i)
    expected = Counter((i, len(sets[n]), (min(least[find(n)]) if least[find(n)] else None) if sets[n] else i) for n, (i, _) in enumerate(texts))
    rows = near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == expected
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in rows)
    assert len({r.component_id for r in rows if r.doc_id and 200000 <= r.doc_id < 200010}) == 1  # a chain
    assert near_duplicates(empty(docs)).count() == 0


def test_residual_lists_lose_no_link(spark):
    """Links that only the comparison across components finds, in blocks smaller than the lists."""
    from weftline.llm.minhash_dedup import near_duplicates

    random.seed(3)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(80)]
        for j in range(12):
            w = list(base)
            for _ in range(random.randrange(0, 6)):
                w[random.randrange(80)] = f"x{random.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, block=3).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_quality_rules(docs, texts):
    from weftline.llm.quality_rules import quality_rules

    got = {(r.doc_id, r.original or ""): r for r in quality_rules(docs.withColumnRenamed("text", "t").selectExpr("*", "t as original"), text_col="t", carry=("original",)).collect()}
    for i, t in texts:
        t = t or ""
        w = WORD.findall(t)
        n, repeats, seen, dup = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7)), [False] * len(w), set(), 0
        for j in range(len(w) - 7):
            if n[tuple(w[j : j + 8])] > 1:
                repeats[j : j + 8] = [True] * 8
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        x = got[i, t]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(repeats))
        assert x.base_failed == (len(w) < 20 or 100 * sum(repeats) > 30 * len(w)) and not (x.kept and x.base_failed)
    assert quality_rules(empty(docs)).count() == 0


def test_quality_rules_take_any_kind_of_language(spark):
    from weftline.llm.quality_rules import quality_rules

    rows = [(i, " ".join(f"w{(i + j) % 70}" for j in range(60)), i % 2) for i in range(6)] + [(6, None, None)]
    numbers = spark.createDataFrame(rows, "doc_id long, text string, lang int")
    verdicts = lambda d: {r.doc_id: (r.kept, r.word_distance) for r in quality_rules(d).collect()}
    assert verdicts(numbers) == verdicts(numbers.selectExpr("doc_id", "text", "cast(lang as string) as lang")) and len(verdicts(numbers)) == 7


def test_quality_keeps_clean_and_rejects_junk(spark):
    from pyspark.sql import functions as F

    from weftline.llm.quality_rules import quality_rules

    d = "/root/testdata/sf0.01"
    q = quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    kept = dict(q.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert kept[1] > 0.98 and kept[0] < 0.3


def test_distance():
    import numpy as np

    from weftline.llm.quality_rules import distance

    assert distance(np.array([[1, 0], [0, 3], [2, 2], [0, 0]]), np.array([4, 0])).round(3).tolist() == [0.0, 1.0, round(0.3112781**0.5, 3), 0.0]


def test_bpe(spark, docs, texts):
    from tokenizers import Tokenizer

    from weftline.llm.distinct_bpe import encode_decode
    from weftline.llm.queries import tokenizer_file

    hard = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>  y", " \n\n  tab\t\tz  ", "I'll we've 'S don’t", " nbsp  em　id\x1c\x1d\x85q", "emoji 👩‍👩‍👧 ½ ² Ⅷ ٣", "\x00\x01 \x7f", "a" * 5000, "\r\n\r\n \r", "ᚠ x ᠎ y​", " 's", " ́a é", "中文字符，测试。"]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(300000 + i, x) for i, x in enumerate(hard)], "doc_id long, text string"))
    t = Tokenizer.from_file(tokenizer_file())
    rows = encode_decode(d, tokenizer_file()).collect()
    want = Counter()
    for r in d.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in rows) == want
    assert all(len(r.ids) == r.n_tokens for r in rows)
    assert encode_decode(empty(docs), tokenizer_file(), texts=False).count() == 0


def windows13(rows):
    first = {}
    for i, w in rows:
        for p in range(len(w) - 12):
            first[tuple(w[p : p + 13])] = min(first.get(tuple(w[p : p + 13]), i), i)
    return first


def groups_by_force(texts):
    """The smallest place that each text reaches through links of 0.75 or more."""
    sets, inverted, shared, root = [], defaultdict(list), Counter(), list(range(len(texts)))
    for n, t in enumerate(texts):
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        for x in sets[n]:
            inverted[x].append(n)
    for x in inverted.values():
        shared.update((x[i], x[j]) for i in range(len(x)) for j in range(i))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in shared.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(n) for n in range(len(texts))]


def test_pipeline(spark, sf):
    """Every stage by brute force on what the one before kept; only the verdict on divergence is taken from the operator, which its SQL holds."""
    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from weftline.llm.common import saved
    from weftline.llm.quality_rules import quality_rules
    from weftline.llm.queries import tokenizer_file

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES[:-1]:
        seen.append(saved(stage(spark, seen[-1], sf), name))
        assert seen[-1].columns == docs.columns and seen[-1].schema == docs.schema
    rows = [{r.doc_id: r for r in x.collect()} for x in seen]
    assert all(r.n_chars == len(r.text) for x in rows[3:] for r in x.values())
    judged = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    assert 0 < len(judged) < len(rows[0]) and {i: tuple(r) for i, r in rows[1].items()} == {i: tuple(r) for i, r in rows[0].items() if i in judged}
    ids = sorted(rows[1])
    stay = {ids[n] for n, x in enumerate(groups_by_force([rows[1][i].text for i in ids])) if n == x}
    assert {i: tuple(r) for i, r in rows[2].items()} == {i: tuple(r) for i, r in rows[1].items() if i in stay}
    words = {i: WORD.findall(r.text) for i, r in rows[2].items()}
    first = windows13(words.items())
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        assert WORD.findall(rows[3][i].text) == [a for a, b in zip(w, gone, strict=True) if not b]
        assert any(gone) or rows[3][i].text == rows[2][i].text
    items = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = ALNUM.findall(r.text.translate(LOW))
        k = min(10, len(w))
        items |= {tuple(w[j : j + k]) for j in range(len(w) - k + 1 if k else 0)}
    for i, r in rows[3].items():
        w = ALNUM.findall(r.text.translate(LOW))
        hit = [False] * len(w)
        for k in {len(x) for x in items}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in items:
                    hit[p : p + k] = [True] * k
        assert ALNUM.findall(rows[4][i].text.translate(LOW)) == [a for a, b in zip(w, hit, strict=True) if not b]
    t = Tokenizer.from_file(tokenizer_file())
    after = dict(rows[4])
    for r in cp.run(spark, sf).collect():
        ids = t.encode(after.pop(r.doc_id).text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert not after


def test_pipeline_stages_on_odd_rows(spark, sf, docs):
    """Null ids and texts, very long and repeated ones, no rows at all, and columns with the operators' own names."""
    import corpus_pipeline as cp

    clash = ["id", "n_words", "items", "spans", "kept_text", "clean_text", "n_hit", "kept", "_id", "sha", "component", "c0", "own"]
    d = docs.select("doc_id", "text", "lang").selectExpr("*", "'s' as source", "length(text) as n_chars", *(f"{i} as {x}" for i, x in enumerate(clash)))
    for x in (d, d.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, x, sf)
            got = out.collect()
            assert out.columns == d.columns and out.schema.simpleString() == d.schema.simpleString()
            assert all(r[y] == i for r in got for i, y in enumerate(clash))
        assert cp.STAGES[-1][1](spark, x, sf).count() == x.count()


def test_near_dedup_stage_with_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(900)) for _ in range(60)) for _ in range(9)]
    near = [t + " more" for t in texts]
    # (id, text), and of each group the row that stays
    groups = [
        ([(None, texts[0])], None), ([(None, texts[1]), (None, near[1]), (None, texts[1])], None), ([(None, texts[2]), (4, near[2])], (4, near[2])),
        ([(5, texts[3]), (5, texts[3]), (6, near[3])], (5, texts[3])), ([(5, texts[4])], (5, texts[4])), ([(5, texts[5]), (3, near[5])], (3, near[5])), ([(7, texts[6]), (7, near[6])], None), ([(8, texts[7].upper()), (8, texts[7])], None),
    ]
    blank = [(None, ""), (None, ""), (None, None), (9, " "), (9, " ")]
    rows = [x for g, _ in groups for x in g] + blank
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, None).collect())
    for g, want in groups:
        stay = {x: got.pop(x) for x in set(g) & set(got)}
        assert sum(stay.values()) == 1 and (want is None or want in stay), g
    assert got == {(None, ""): 2, (None, None): 1, (9, " "): 1}


def test_full_sets_have_one_text_per_class(spark):
    from pyspark.sql import functions as F

    from weftline.llm import minhash_dedup as md

    texts = [f"w{i} " * 3 + " ".join(f"x{j}" for j in range(i, i + 20)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for n, t in enumerate(texts) for i in ((None, None, 1, 1) if n % 2 else (None, None))], "doc_id long, text string").withColumn("text_sha", md.text_sha(F.col("text")))
    classes = docs.groupBy("text_sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    sets = md._full_sets(docs, classes, 5)
    assert sets.count() == 40 == sets.select("node").distinct().count()


def test_near_dedup_stage_leaves_no_large_tables(spark, sf):
    """What the stage has written on the way would count against the disk of all later stages."""
    import os

    import corpus_pipeline as cp
    from weftline.llm import common

    folder = common.shared(spark).removeprefix("file://")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = set(os.listdir(folder))
    out = cp.near_dedup(spark, docs, sf)
    left = {x.split("-")[1] for x in set(os.listdir(folder)) - before if x.startswith("weftline-")}
    assert left <= {"groups", "mixed", "pairs"} and "groups" in left
    ids = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert {r.doc_id for r in out.collect()} == {ids[n][0] for n, x in enumerate(groups_by_force([t for _, t in ids])) if n == x}


def test_repeats_stage_exchanges_texts_once(spark, sf, monkeypatch):
    import corpus_pipeline as cp
    from weftline.llm import common

    sent, chunks = [], common.chunks
    monkeypatch.setattr(common, "chunks", lambda docs, n: (sent.append(docs), chunks(docs, n))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert cp.repeats(spark, docs, sf).columns == docs.columns
    texts = {r.text for r in docs.collect()} - {None, ""}
    assert {sum(x in texts for x in r if isinstance(x, str)) for r in sent[0].collect() if r.text} == {1}


def test_full_sets_exchange_few_other_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from weftline.llm import common, minhash_dedup as md

    docs = spark.range(4000).selectExpr("id as doc_id", "concat('some text of five words and ', id) as text").withColumn("text_sha", md.text_sha(F.col("text")))
    wanted = docs.where("doc_id % 40 = 7").selectExpr("doc_id as node", "text_sha", "doc_id as first_id", "1L as n")
    sent, join = [], common.skew_join
    monkeypatch.setattr(common, "skew_join", lambda left, *a, **b: (sent.append(left), join(left, *a, **b))[1])
    assert {r.node for r in md._full_sets(docs, wanted, 5).collect()} == set(range(7, 4000, 40))
    assert 100 <= sent[0].count() < 800


def test_likely_loses_no_wanted_row(spark):
    from weftline.llm.common import likely

    rows = spark.range(20_000).selectExpr("id", "unhex(sha2(cast(id as string), 256)) as sha", "id % 3 = 0 as none", "cast(id as string) as other")
    for share, most, few in ((40, 1 << 19, 3000), (2, 1 << 19, 12_000), (40, 1, 20_000)):
        wanted = rows.where(f"id % {share} = 1").select("none", "sha", "id")
        got = likely(rows, wanted, ["sha", "id", "none"], most)
        ids = [r.id for r in got.collect()]
        assert got.columns == rows.columns and len(ids) == len(set(ids)) <= few and set(range(1, 20_000, share)) <= set(ids)
    assert likely(rows, wanted.limit(0), ["sha", "id", "none"]).count() == 0


def test_links_near_the_threshold_are_found(spark):
    """Of links of 0.75 to 0.80 none may be missed: so many pairs of their own, with nothing else to lead to them."""
    from weftline.llm.minhash_dedup import near_duplicates

    rng, rows, linked = random.Random(8), [], 0
    for n in range(1500):
        size = rng.randrange(40, 400)
        w = [f"p{n}w{i}" for i in range(size)]
        v = list(w)
        # a run of k changed words changes k + 4 shingles
        lost = int((size - 4) * rng.uniform(0.111, 0.143))
        at = rng.randrange(4, size - lost - 4) if size - lost > 9 else 4
        for i in range(at, at + max(1, lost - 4)):
            v[i] = f"q{n}w{i}"
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(v))]
        a, b = ({tuple(x[i : i + 5]) for i in range(size - 4)} for x in (w, v))
        linked += 100 * len(a & b) >= 75 * len(a | b)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).where("not kept").collect()
    assert linked > 1200 and len(got) == linked and all(r.component_id == r.doc_id - 1 for r in got)


def test_toxic_crf(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from weftline.llm import toxic_crf as tc

    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 30))
        k = int(rng.integers(0, n + 1))
        places, w, step = np.sort(rng.choice(n, k, replace=False)), rng.normal(0, 2, k), rng.normal(0, 1, (2, 2))
        e = np.full(n, np.exp(-1.0))
        e[places] *= np.exp(w)
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        a[0] = [1, e[0]]
        for i in range(1, n):
            a[i] = a[i - 1] @ np.exp(step) * [1, e[i]]
        for i in range(n - 2, -1, -1):
            b[i] = np.exp(step) @ (b[i + 1] * [1, e[i + 1]])
        assert np.allclose(((a * b)[:, 1] / (a * b).sum(1))[places], tc.marginals(np.array([n]), np.zeros(k, int), places, w, -1.0, step))
    rows = [(i, " ".join(rng.choice(["the", "and", "tree", "house", "of", "in", "green"], 40))) for i in range(400)]
    rows = [(i, t + (f" blorg{i % 7} tree" if i % 8 == 0 else "")) for i, t in rows]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "blorg99 unseen ending"), (None, "tree")], "doc_id long, text string")
    model = tc.fit(docs, labels, ~tc.held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in tc.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 8 == 0) for i, _ in rows) and got[9000].predicted == got[9001].predicted == 0 and got[9002].predicted == 1
    text = dict(rows)[8].encode()
    assert [text[s.start : s.end].decode() for s in got[8].spans] == ["blorg1"]
    none = tc.score(docs, tc.fit(docs, labels.limit(0)))
    assert none.count() == len(rows) + 4 and none.where("score > 0.01").count() == 0


def test_toxic_crf_on_held_out_labels(spark):
    """The query's own verdicts on labels that it may not learn from."""
    from weftline.llm import queries

    d = "/root/testdata/sf0.1"  # few documents are toxic
    rows = queries.op5_toxic_crf(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(toxic) > 50 and len(clean) > 500
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_every_language_has_a_reference(spark):
    """More languages than go to every task: those of small ones are joined, and the verdicts are those of one rule."""
    from weftline.llm.quality_rules import distance, language_references, quality_rules

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), lang) for i, (lang, words) in enumerate((f"l{k}", [f"k{k}w{j}" for j in range(30)]) for k in range(700) for _ in range(2))]
    rows += [(10_000 + i, " ".join(rng.choice([f"big{j}" for j in range(30)]) for _ in range(60)), "big") for i in range(400)]
    rows += [(20_000, rows[0][1], "l1"), (20_001, rows[-1][1], None), (20_002, rows[-1][1], "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert language_references(docs).count() == 702
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert len(got) == len(rows) and got[20_002].kept and got[20_001].word_distance == min(got[20_001].word_distance, got[20_002].word_distance)
    for i, text, lang in rows[:2] + rows[1400:1402] + rows[-3:-2]:
        count = Counter(w for _, t, x in rows if x == lang for w in t.split())
        top = dict(sorted(count.items(), key=lambda x: -x[1])[:64])
        own = Counter(w if w in top else None for w in text.split())
        far = distance(np.array([[*(own[w] for w in top), own[None]]]), np.array([*top.values(), sum(count.values()) - sum(top.values())]))[0]
        assert abs(got[i].word_distance - far) < 1e-9 and got[i].kept == (far <= 0.5 and got[i].char_distance <= 0.3)
