"""Every query of the library outside llm over the driver's tables, with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.versions import version, version_range
from ..operators import aggregates as ag, lines as ln, links as lk, matching as ma, predicates as pr, rules as ru, series as se, sets as st
from .base import NOTES, ORACLE_SQL, QUERIES, query as _query, sql_cut, table as _t, with_links  # noqa: F401

# ------------------------------------------------------------ link graph

_LINKS = """links AS (SELECT DISTINCT page_id AS src, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS name FROM pages),
targets AS (SELECT page_id AS path, regexp_extract(html, '<title>([^ <]*)', 1) AS name FROM pages),
firsts AS (SELECT lower(name) AS k, min(path) AS path FROM targets GROUP BY 1),
resolved AS (SELECT src, name, path FROM links LEFT JOIN firsts ON lower(name) = k)"""


def _resolved(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    names = F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))
    links = pages.select(F.col("page_id").alias("src"), F.explode(names).alias("name"))
    return lk.resolve(links, pages.select(F.col("page_id").alias("path"), F.regexp_extract("html", "<title>([^ <]*)", 1).alias("name")))


@_query("""SELECT page_id, count(DISTINCT t) AS n_links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS t FROM pages) GROUP BY page_id""")
def link_out_degree(spark, sf_dir):
    """Distinct link targets of each page."""
    return lk.out_degree(_t(spark, sf_dir, "pages"), "page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), "n_links")


@_query(f"WITH {_LINKS} SELECT src, name, path FROM resolved")
def forward_links(spark, sf_dir):
    """Links of each page and the first page whose title begins with the link's name, without regard to case."""
    return _resolved(spark, sf_dir)


@_query(f"WITH {_LINKS} SELECT path AS dst, count(DISTINCT src) AS n_sources FROM resolved WHERE path IS NOT NULL AND path <> src GROUP BY 1")
def backlink_counts(spark, sf_dir):
    return lk.backlinks(_resolved(spark, sf_dir)).groupBy("dst").agg(F.count("*").alias("n_sources"))


@_query(f"""WITH {NOTES} SELECT path, regexp_matches(content, '(?i)\\[\\[the(\\]\\]|\\|)') AS changed, md5(regexp_replace(content, '(?i)\\[\\[the(\\]\\]|\\|)', '[[re$named\\1', 'g')) AS digest FROM notes""")
def renamed_links(spark, sf_dir):
    """Pages after one target got another name."""
    return lk.rename(with_links(_t(spark, sf_dir, "pages")), "the", "re$named").select("path", "changed", F.md5(F.encode("content", "UTF-8")).alias("digest"))


# ------------------------------------------------------------ sets


@_query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf_dir):
    return st.unseen(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@_query("SELECT user_id AS id FROM events UNION SELECT c_custkey FROM customer")
def merged_ids(spark, sf_dir):
    return st.merge_log(_t(spark, sf_dir, "events").select(F.col("user_id").alias("id")), _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")


@_query("SELECT count(*) FILTER (WHERE b IS NULL) AS only_a, count(*) FILTER (WHERE a IS NULL) AS only_b, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS common FROM (SELECT DISTINCT o_custkey AS a FROM orders) FULL JOIN (SELECT c_custkey AS b FROM customer) ON a = b")
def ordering_customers(spark, sf_dir):
    """How many customers are only in orders, only in customer, and in both."""
    return st.sides(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@_query("""WITH o AS (SELECT l_linenumber AS line, l_orderkey, l_partkey, l_suppkey FROM lineitem),
a AS (SELECT l_orderkey, line, min(l_partkey) AS old, max(l_suppkey) AS new FROM o GROUP BY 1, 2) SELECT l_orderkey, line, old, new FROM a WHERE old <> new""")
def zipped_changes(spark, sf_dir):
    """Two lists put side by side by place, and where they differ."""
    li = _t(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_orderkey", F.col("l_linenumber").alias("line")))
    old, new = li.groupBy("at").agg(F.min("l_partkey").alias("x")), li.groupBy("at").agg(F.max("l_suppkey").alias("x"))
    return st.zip_changes(old, new, "at", "x").select("at.l_orderkey", "at.line", "old", "new")


# ------------------------------------------------------------ predicates


@_query("""SELECT p_partkey, p_name LIKE '%ring%' AS literal, regexp_matches(p_name, 'r.d$') AS regex, regexp_matches(p_name, 'm.l.* b') AS glob, regexp_matches(p_name, '^s.*t$') AS whole_glob,
regexp_matches(p_name, 'b.*l.*t') AS letters, regexp_matches(p_name, '(?i)^red') AS smart, NOT regexp_matches(p_name, '(?i)GREEN') AS inverted, p_name LIKE '%a.b%' AS dotted, p_name IS NOT NULL AS dot, p_name IS NOT NULL AS broken FROM part""")
def pattern_modes(spark, sf_dir):
    n = F.col("p_name")
    return _t(spark, sf_dir, "part").select(
        "p_partkey", pr.pattern(n, "ring").alias("literal"), pr.pattern(n, "r.d$", "regex").alias("regex"), pr.pattern(n, "m?l* b", "glob").alias("glob"), pr.pattern(n, "^s*t$", "glob").alias("whole_glob"),
        pr.pattern(n, "blt", "letters").alias("letters"), pr.pattern(n, "^red", case="smart").alias("smart"), pr.pattern(n, "GREEN", case="ignore", invert=True).alias("inverted"),
        pr.pattern(n, "a.b").alias("dotted"), pr.pattern(n, ".").alias("dot"), pr.pattern(n, "(", "regex").alias("broken"),
    )


@_query("SELECT p_partkey, p_name FROM (SELECT *, count(*) OVER (PARTITION BY p_name) AS copies FROM part) WHERE (p_name LIKE '%bolt%' OR p_type = 'PROMO') AND NOT p_size < 10 AND copies > 1")
def filter_stack(spark, sf_dir):
    """A stack that is built, taken apart and put together again."""
    s = pr.FilterStack().push(F.col("p_size") < 10).combine("not").add("name", "bolt").push(F.col("p_type") == "PROMO", "promo").combine("or").decompose().combine("or").add("duplicate").rotate(2)
    rows = pr.counted_copies(_t(spark, sf_dir, "part").withColumn("name", F.col("p_name")), "p_name")
    return rows.where(s.column()).select("p_partkey", "p_name")


@_query("""SELECT event_id, CASE WHEN event_type = 'error' AND value > 10 THEN 'alarm' WHEN event_type IN ('error', 'signup') THEN 'log' WHEN NOT event_type = 'view' AND value < 1 THEN 'drop' ELSE 'keep' END AS action FROM events""")
def first_match_rules(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    rules = [((kind == "error") & (value > 10), "alarm"), (kind.isin("error", "signup"), "log"), (~(kind == "view") & (value < 1), "drop")]
    return pr.first_match(_t(spark, sf_dir, "events"), rules, "action", "keep").select("event_id", "action")


@_query("""WITH l AS (SELECT unnest(string_split(CASE doc_id % 8 WHEN 0 THEN '## ' WHEN 1 THEN '  12. ' WHEN 2 THEN '[a](b) ' WHEN 3 THEN '__x__ ' WHEN 4 THEN 'see [[a]] ' WHEN 5 THEN '[[a ' WHEN 6 THEN '+ **b** ' ELSE ' * ' END || text, chr(10))) AS line FROM documents)
SELECT class, count(*) AS n_lines FROM (SELECT CASE WHEN regexp_matches(line, '^#+[ \\t\\n\\x0B\\f\\r]') THEN 'header' WHEN regexp_matches(line, '^[ \\t\\n\\x0B\\f\\r]*([-*]|[0-9]+\\.)[ \\t\\n\\x0B\\f\\r]') THEN 'list' WHEN regexp_matches(line, '\\[\\[.+\\]\\]|\\[.+\\]\\(') THEN 'link'
WHEN regexp_matches(line, '\\*\\*.+\\*\\*|__.+__') THEN 'bold' ELSE 'content' END AS class FROM l) GROUP BY 1""")
def line_classes(spark, sf_dir):
    """Classes of the lines of documents, which get a mark of some kind in front."""
    marks = ["## ", "  12. ", "[a](b) ", "__x__ ", "see [[a]] ", "[[a ", "+ **b** ", " * "]
    marked = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.get(F.array(*map(F.lit, marks)), (F.col("doc_id") % 8).cast("int")), "text").alias("text"))
    return ln.lines(marked, "doc_id", "text").groupBy(pr.line_class(F.col("line")).alias("class")).agg(F.count("*").alias("n_lines"))


# ------------------------------------------------------------ lines

_DOC_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"


@_query(f"WITH {_DOC_LINES} SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, 'Licen[sc]ed?')")
def content_search(spark, sf_dir):
    return ln.search(_t(spark, sf_dir, "documents"), "doc_id", "text", "Licen[sc]ed?")


@_query(f"WITH {_DOC_LINES}, m AS (SELECT *, count(*) FILTER (WHERE line LIKE '%|%') OVER (PARTITION BY doc_id ORDER BY line_no) AS marks FROM l) SELECT doc_id, line_no FROM m WHERE marks % 2 = 1")
def running_toggle(spark, sf_dir):
    """Lines after an odd number of lines with a bar."""
    rows = ln.lines(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return ln.running_count(rows, "doc_id", F.col("line").contains("|"), "marks").where("marks % 2 = 1").select("doc_id", "line_no")


_FRONT = "CASE doc_id % 4 WHEN 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || '# head' || chr(10) || '[[only]]' || chr(10) || '  ' WHEN 1 THEN '--- rule' || chr(10) WHEN 2 THEN '[[a]] b' || chr(10) ELSE '' END || text"


@_query(f"""WITH d AS (SELECT doc_id, {_FRONT} AS t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM d),
m AS (SELECT doc_id, line_no, regexp_replace(line, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS line, starts_with(line, '---') AS rule, count(*) FILTER (WHERE starts_with(line, '---')) OVER (PARTITION BY doc_id ORDER BY line_no) AS marks FROM l),
b AS (SELECT doc_id, arg_min(line, line_no) AS line FROM m WHERE marks % 2 = 0 AND NOT rule AND line <> '' AND NOT starts_with(line, '#') AND NOT (starts_with(line, '[[') AND ends_with(line, ']]')) GROUP BY 1)
SELECT doc_id, {sql_cut("line", 60)} AS preview FROM b""")
def previews(spark, sf_dir):
    """The first line of documents with text, cut at 60 bytes; they get front matter, rules and lines of links in front."""
    front = F.expr("CASE doc_id % 4 WHEN 0 THEN '---\\ntitle: x\\n---\\n# head\\n[[only]]\\n  ' WHEN 1 THEN '--- rule\\n' WHEN 2 THEN '[[a]] b\\n' ELSE '' END")
    rows = ln.lines(_t(spark, sf_dir, "documents").select("doc_id", F.concat(front, "text").alias("text")), "doc_id", "text")
    return ln.first_content(rows, "doc_id", 60)


@_query("SELECT doc_id, sum(n - 1)::BIGINT AS extra_lines FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1, 2) GROUP BY 1 HAVING sum(n - 1) > 0")
def repeated_lines(spark, sf_dir):
    rows = F.split("text", "\n")
    d = _t(spark, sf_dir, "documents").where(ru.has_repeats(rows))
    return d.select("doc_id", (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("extra_lines"))


@_query("""WITH w AS (SELECT concat_ws(':', conv_id, turn) AS id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM conversations),
f AS (SELECT id, CASE WHEN len(ws) = 0 THEN '' ELSE list_reduce(ws, lambda acc, x: CASE WHEN length(string_split(acc, chr(10))[-1]) + 1 + length(x) > 72 THEN acc || chr(10) || x ELSE acc || ' ' || x END) END AS wrapped FROM w)
SELECT id, wrapped, len(string_split(wrapped, chr(10))) AS n_lines FROM f""")
def wrapped_turns(spark, sf_dir):
    """Turns wrapped to 72 characters, and how many lines that takes."""
    turns = _t(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return ln.wrap(turns, "id", "text", 72).withColumn("n_lines", F.size(F.split("wrapped", "\\n")).cast("long"))


# ------------------------------------------------------------ scalars


@_query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' -- ' || p_brand), '[^-a-z0-9]+', '-', 'g'), '-') AS s0, regexp_replace(trim(regexp_replace(lower(p_name || ' -- ' || p_brand), '[^-a-z0-9]+', '-', 'g'), '-'), '-+', '-', 'g') AS slug,
upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS title, printf('%02d:%02d', p_size * 7 // 60, p_size * 7 % 60) AS clock, regexp_replace(lower(p_brand), '[^a-z0-9_]', '_', 'g') AS code FROM part""")
def part_names(spark, sf_dir):
    raw = F.concat_ws(" -- ", "p_name", "p_brand")
    return _t(spark, sf_dir, "part").select("p_partkey", F.expr("trim(BOTH '-' FROM regexp_replace(lower(concat_ws(' -- ', p_name, p_brand)), '[^-a-z0-9]+', '-'))").alias("s0"), tx.slug(raw).alias("slug"), tx.capitalise(F.col("p_type")).alias("title"), tx.minutes_seconds(F.col("p_size") * 7).alias("clock"), tx.error_code(F.col("p_brand")).alias("code"))


@_query("""SELECT page_id, string_split(string_split(string_split(url, '/')[-1], '=')[-1], '?')[1] AS file, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '') AS page, coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), '') AS ref FROM pages""")
def url_parts(spark, sf_dir):
    q = tx.query_map(F.col("url"))
    get = lambda k: F.coalesce(F.try_element_at(q, F.lit(k)), F.lit(""))
    return _t(spark, sf_dir, "pages").select("page_id", tx.url_file(F.col("url")).alias("file"), get("page").alias("page"), get("ref").alias("ref"))


@_query("SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS squeezed, sha256(text) AS sha FROM conversations")
def squeezed_turns(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", tx.squeeze(F.col("text")).alias("squeezed"), F.sha2("text", 256).alias("sha"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y%m%d%H%M%S') AS stamp, CAST(ts AS DATE) + 1 AS next_day FROM events")
def event_fields(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, sf_dir, "events").select("event_id", k.alias("k"), F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"), F.date_add(F.to_date("ts"), 1).alias("next_day"))


@_query("""WITH p AS (SELECT p_partkey, p_type, 'v' || p_size || repeat('0', p_partkey % 25) || CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE '' END AS name, p_size || repeat('0', p_partkey % 25) AS digits FROM part)
SELECT p_partkey, name, row_number() OVER (PARTITION BY p_type ORDER BY length(digits), digits, right(name, 1) = 'b', p_partkey) AS place FROM p""")
def natural_order(spark, sf_dir):
    """Names with numbers of up to 27 digits in natural order within their type."""
    from pyspark.sql import Window

    name = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.repeat(F.lit("0"), (F.col("p_partkey") % 25).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "b").otherwise(""))
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_type", name.alias("name"))
    return rows.select("p_partkey", "name", F.row_number().over(Window.partitionBy("p_type").orderBy(tx.natural_key(F.col("name")), "p_partkey")).cast("long").alias("place"))


# ------------------------------------------------------------ aggregates


@_query("SELECT metric, value, count(*) AS n FROM (SELECT unnest(['flag', 'status', 'line']) AS metric, unnest([l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)]) AS value FROM lineitem) GROUP BY 1, 2")
def metric_histogram(spark, sf_dir):
    return ag.histogram(_t(spark, sf_dir, "lineitem"), {"flag": "l_returnflag", "status": "l_linestatus", "line": "l_linenumber"})


@_query("SELECT lang, source, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ROLLUP (lang, source)")
def size_rollup(spark, sf_dir):
    return ag.cumulative_size(_t(spark, sf_dir, "documents"), ["lang", "source"], F.octet_length("text"), "bytes")


@_query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors, CASE WHEN count(*) FILTER (WHERE event_type = 'click') = count(*) FILTER (WHERE event_type = 'error') THEN '=' WHEN count(*) FILTER (WHERE event_type = 'click') > count(*) FILTER (WHERE event_type = 'error') THEN '>' ELSE '<' END AS status, CAST(round(100.0 * count(*) FILTER (WHERE event_type = 'click') / count(*)) AS BIGINT) AS percent FROM events GROUP BY 1")
def user_status(spark, sf_dir):
    return ag.two_sided_status(_t(spark, sf_dir, "events"), "user_id", F.col("event_type") == "click", F.col("event_type") == "error", ("clicks", "errors"))


@_query("WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 40 GROUP BY 1, 2) SELECT l_suppkey, arg_min(l_quantity, (-n, l_quantity)) AS quantity, max(n) AS n FROM c GROUP BY 1")
def usual_quantity(spark, sf_dir):
    """The most frequent quantity of each supplier between two bounds, the smallest of several."""
    return ag.most_frequent(_t(spark, sf_dir, "lineitem").where("l_quantity > 10 and l_quantity <= 40"), "l_suppkey", "l_quantity").withColumnRenamed("l_quantity", "quantity")


@_query("""WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, turn FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS place FROM t)
SELECT conv_id, place // 64 AS block, count(*) AS n_lines, string_agg(role || ': ' || text, chr(10) ORDER BY place) AS transcript FROM p GROUP BY 1, 2""")
def whole_transcripts(spark, sf_dir):
    """The turns of each conversation, in blocks of 64 by position."""
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return ln.joined_blocks(turns, "conv_id", "turn", ["role", "text"], F.concat("role", F.lit(": "), "text"), "transcript")


@_query("SELECT c_mktsegment, coalesce(max(CAST(nullif(regexp_extract(c_name, '([0-9]+)$', 1), '') AS BIGINT)) + 1, 0) AS next_number FROM customer GROUP BY 1")
def next_numbers(spark, sf_dir):
    return se.next_number(_t(spark, sf_dir, "customer"), "c_mktsegment", F.col("c_name"))


# ------------------------------------------------------------ series


@_query("SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS previous FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)")
def previous_active_day(spark, sf_dir):
    return se.previous_entry(_t(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "user_id", "day")


@_query("SELECT o_custkey, max(o_orderdate) AS latest FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' GROUP BY 1")
def latest_order_before(spark, sf_dir):
    import datetime

    return se.latest_before(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", datetime.datetime(1998, 6, 1))


@_query("""SELECT conv_id, turn, coalesce((SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND (b.role = 'user') <> (a.role = 'user')),
(SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND (b.role = 'user') <> (a.role = 'user'))) AS next_opposite FROM conversations a""")
def next_other_speaker(spark, sf_dir):
    return se.next_opposite(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "next_opposite")


@_query("SELECT conv_id, turn, last_value(CASE WHEN role <> 'system' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations")
def previous_speaker(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return se.previous_where(c, "conv_id", "turn", F.when(F.col("role") != "system", F.col("role")), "before").select("conv_id", "turn", "before")


def _other(back: bool, wrap: bool) -> str:
    """SQL for the place of the nearest row of the other kind on one side, and with wrap else the farthest on the other."""
    side = lambda f, op: f"(SELECT {f}(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn {op} a.turn AND (b.role = 'user') <> (a.role = 'user'))"
    near, far = (side("max", "<"), side("max", ">")) if back else (side("min", ">"), side("min", "<"))
    return f"coalesce({near}, {far})" if wrap else near


@_query(f"SELECT conv_id, turn, {_other(False, False)} AS ahead, {_other(True, False)} AS back, {_other(True, True)} AS back_wrapped FROM conversations a")
def other_speakers(spark, sf_dir):
    """The nearest turn of the other side, forward without wrapping and in reverse order with and without."""
    c, user = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), F.col("role") == "user"
    rows = se.next_opposite(c, "conv_id", "turn", user, "ahead", wrap=False)
    rows = se.next_opposite(rows, "conv_id", "turn", user, "back", wrap=False, reverse=True)
    return se.next_opposite(rows, "conv_id", "turn", user, "back_wrapped", reverse=True).drop("role")


@_query("SELECT conv_id, turn, first_value(CASE WHEN role <> 'system' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM conversations")
def next_speaker(spark, sf_dir):
    """The next turn's role that is not system's."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return se.next_where(c, "conv_id", "turn", F.when(F.col("role") != "system", F.col("role")), "after").select("conv_id", "turn", "after")


@_query("""WITH p AS (SELECT p_partkey, p_brand || CASE p_partkey % 7 WHEN 0 THEN '_' WHEN 1 THEN '_0' WHEN 2 THEN '_3' ELSE '' END AS name FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) - 1 AS n FROM p),
s AS (SELECT name, k, name || CASE k WHEN 0 THEN '_' ELSE '_' || (k - 1) END AS free FROM (SELECT name, unnest(range(0, max(n) + 5)) AS k FROM n GROUP BY name)),
f AS (SELECT name, free, row_number() OVER (PARTITION BY name ORDER BY k) AS n FROM s WHERE free NOT IN (SELECT name FROM p))
SELECT p_partkey, coalesce(free, n.name) AS free_name FROM n LEFT JOIN f ON f.name = n.name AND f.n = n.n""")
def free_part_names(spark, sf_dir):
    """Brands made unique where some names already have the suffixes that others would get."""
    name = F.concat("p_brand", F.coalesce(F.get(F.array(F.lit("_"), F.lit("_0"), F.lit("_3")), (F.col("p_partkey") % 7).cast("int")), F.lit("")))
    return se.free_names(_t(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "name", "p_partkey").select("p_partkey", "free_name")


@_query("SELECT p_partkey, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 - 3) % n + n) % n AS turn FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM part)")
def rotated_parts(spark, sf_dir):
    return se.rotated(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 3).select("p_partkey", "turn")


@_query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 50")
def sampled_orders(spark, sf_dir):
    return se.seeded_sample(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 50, 7)


# ------------------------------------------------------------ rules


_VERSIONS = "string_split(ver, '.')::INT[]"


@_query(f"""WITH r(name, i, ver, flag) AS (VALUES ('promo', 1, '5.1', false), ('promo', 2, '5.3', false), ('promo', 3, '5.4', true), ('economy', 1, '7.10', false), ('economy', 2, '7.9', true), ('small', 1, '5.0', false), ('small', 2, '5.1', true)),
m AS (SELECT name, arg_min(ver, i) AS ver FROM r WHERE NOT flag AND {_VERSIONS} >= [5, 2] GROUP BY 1) SELECT p_partkey, ver AS missing_until FROM part JOIN m ON lower(p_type) = name""")
def new_feature_rules(spark, sf_dir):
    """Types as names of features with versions that lack them; the target is 5.2."""
    rules = spark.createDataFrame([("Promo", [("5.1", False), ("5.3", False), ("5.4", True)]), ("economy", [("7.10", False), ("7.9", True)]), ("SMALL", [("5.0", False), ("5.1", True)])], "name string, versions array<struct<ver string, flag boolean>>")
    rules = rules.withColumn("versions", F.transform("versions", lambda v: F.struct(version(v["ver"]).alias("ver"), v["flag"].alias("flag"))))
    tokens = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("name"))
    found = ru.new_features(tokens, rules, version(F.lit("5.2")))
    return found.select("p_partkey", F.array_join(F.col("missing_until").cast("array<string>"), ".").alias("missing_until"))


@_query(f"""WITH r(name, i, ver, flag) AS (VALUES ('promo', 1, '5.3', false), ('promo', 2, '7.0', true), ('large', 1, '5.3', false), ('large', 2, '7.10', true), ('small', 1, '8.0', false)),
m AS (SELECT name, arg_min(ver, i) FILTER (WHERE NOT flag) AS deprecated, arg_min(ver, i) FILTER (WHERE flag) AS removed FROM r WHERE {_VERSIONS} <= [7, 9] GROUP BY 1) SELECT p_partkey, deprecated, removed FROM part JOIN m ON lower(p_type) = name""")
def removed_feature_rules(spark, sf_dir):
    rules = spark.createDataFrame([("promo", [("5.3", False), ("7.0", True)]), ("Large", [("5.3", False), ("7.10", True)]), ("small", [("8.0", False)])], "name string, versions array<struct<ver string, flag boolean>>")
    rules = rules.withColumn("versions", F.transform("versions", lambda v: F.struct(version(v["ver"]).alias("ver"), v["flag"].alias("flag"))))
    tokens = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("name"))
    show = lambda c: F.array_join(F.col(c).cast("array<string>"), ".").alias(c)
    return ru.removed_features(tokens, rules, version_range(F.lit("-7.9"))["high"]).select("p_partkey", show("deprecated"), show("removed"))


#: Wildcards made of the names of parts: heads, tails, middles, single characters and whole names, and names that a group allows.
_WILDCARDS = """rules AS (SELECT 'g' || (p_partkey % 5) AS "group", CASE p_partkey % 5 WHEN 0 THEN upper(string_split(p_name, ' ')[1]) || ' *' WHEN 1 THEN '*' || string_split(p_name, ' ')[2] WHEN 2 THEN '*' || substr(p_name, 2, 4) || '*'
  WHEN 3 THEN '?' || substr(p_name, 2, 3) || '*' ELSE p_name END AS pattern FROM part WHERE p_size < 12), allow AS (SELECT DISTINCT 'g' || (p_partkey % 5) AS "group", upper(p_name) AS name FROM part WHERE p_size = 1)"""


@_query(f"""WITH {_WILDCARDS} SELECT DISTINCT p_partkey, "group" FROM part JOIN rules ON lower(p_name) LIKE replace(replace(lower(pattern), '*', '%'), '?', '_') WHERE NOT EXISTS (SELECT 1 FROM allow WHERE allow."group" = rules."group" AND lower(name) = lower(p_name))""")
def wildcard_rules(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    group, words = F.concat(F.lit("g"), (F.col("p_partkey") % 5).cast("string")).alias("group"), F.split("p_name", " ")
    any_, one, k = F.lit("*"), F.lit("?"), F.col("p_partkey") % 5
    pattern = F.when(k == 0, F.concat(F.upper(words[0]), F.lit(" *"))).when(k == 1, F.concat(any_, words[1])).when(k == 2, F.concat(any_, F.substring("p_name", 2, 4), any_)).when(k == 3, F.concat(one, F.substring("p_name", 2, 3), any_)).otherwise(F.col("p_name"))
    rules, allow = part.where("p_size < 12").select(group, pattern.alias("pattern")), part.where("p_size = 1").select(group, F.upper("p_name").alias("name"))
    return ma.wildcard_matches(part.drop("p_size"), "p_name", rules, allow).select("p_partkey", "group")


_PREFIXES = "rules AS (SELECT upper(left(p_name, 1 + p_partkey % 9)) AS prefix, p_partkey AS rank FROM part WHERE p_size > 30 AND p_partkey % 3 = 0)"


@_query(f"WITH {_PREFIXES} SELECT p_partkey, arg_min(prefix, rank) AS prefix FROM part LEFT JOIN rules ON starts_with(lower(p_name), lower(prefix)) GROUP BY 1")
def prefix_rules(spark, sf_dir):
    """The first of a table of prefixes, taken from names of parts, that each name begins with."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    rules = part.where("p_size > 30 and p_partkey % 3 = 0").select(F.upper(F.left("p_name", (1 + F.col("p_partkey") % 9).cast("int"))).alias("prefix"), F.col("p_partkey").alias("rank"))
    return ma.first_prefix(part.drop("p_size"), "p_name", rules).select("p_partkey", "prefix")


_SPELLINGS = "s AS (SELECT lower(p_type) AS low, arg_min(CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN upper(p_type) ELSE upper(left(p_type, 1)) || lower(substr(p_type, 2)) END, p_size * 1000000 + p_partkey) AS canonical FROM part GROUP BY 1)"


@_query(f"WITH {_SPELLINGS} SELECT p_partkey, canonical FROM part JOIN s ON low = lower(p_type) WHERE canonical <> p_type")
def wrong_case_types(spark, sf_dir):
    """Types spelled otherwise than the first entry of a table of spellings."""
    part, k = _t(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), F.col("p_partkey") % 3
    other = F.concat(F.upper(F.left("p_type", F.lit(1))), F.lower(F.substr("p_type", F.lit(2))))
    table = part.select(F.when(k == 0, F.lower("p_type")).when(k == 1, F.upper("p_type")).otherwise(other).alias("canonical"), (F.col("p_size") * F.lit(1000000) + F.col("p_partkey")).alias("rank"))
    return ma.wrong_case(part, "p_type", table).select("p_partkey", "canonical")


@_query("SELECT event_id, coalesce(min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) < event_id, false) AS before, min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) IS NOT NULL AS anywhere FROM events")
def signed_up(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    check = F.col("event_type") == "signup"
    found = ru.verified_in_scope(e, "user_id", "event_id", check, F.lit(False), F.lit("before")).withColumnRenamed("verified", "before")
    return ru.verified_in_scope(found, "user_id", "event_id", check, F.lit(False), F.lit("after")).select("event_id", "before", F.col("verified").alias("anywhere"))


@_query("SELECT event_id FROM (SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM events) WHERE coalesce(off, 0) = 0")
def outside_errors(spark, sf_dir):
    """Events that no error of the same user suppresses until the next signup."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ru.unsuppressed(e, "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "signup").select("event_id")


@_query("SELECT page_id, unnest(list_distinct(regexp_extract_all(url, '[?&]([^=&#]*)=', 1))) AS key FROM pages WHERE regexp_matches(url, '[?&](utm_source|ref)=')")
def restricted_keys(spark, sf_dir):
    """All parameters of urls that have one of a list of keys."""
    return ru.keys_if_any(_t(spark, sf_dir, "pages"), tx.query_map(F.col("url")), ["utm_source", "ref"]).select("page_id", "key")


@_query("SELECT event_id, CASE WHEN opened AND event_type <> 'purchase' THEN since END AS opened_at FROM (SELECT *, last_value(CASE event_type WHEN 'purchase' THEN false WHEN 'signup' THEN true END IGNORE NULLS) OVER w AS opened, last_value(CASE WHEN event_type IN ('purchase', 'signup') THEN event_id END IGNORE NULLS) OVER w AS since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
def inside_signups(spark, sf_dir):
    """The signup whose span, up to the next purchase, each event lies in."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ru.inside_spans(e, "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id", "opened_at")


@_query("""WITH s AS (SELECT *, sum(CASE event_type WHEN 'purchase' THEN -1 WHEN 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM events),
d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY user_id ORDER BY event_id)) AS depth FROM s),
l AS (SELECT *, depth - CASE event_type WHEN 'signup' THEN 1 ELSE 0 END AS level FROM d)
SELECT a.event_id, max(b.event_id) AS opened_at FROM l a LEFT JOIN d b ON b.event_type = 'signup' AND b.user_id IS NOT DISTINCT FROM a.user_id AND b.event_id < a.event_id AND b.depth = a.level AND a.level > 0 GROUP BY 1""")
def nested_signups(spark, sf_dir):
    """The innermost signup around each event that no purchase has closed; a purchase closes one signup."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ru.inside_nested(e, "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id", "opened_at")


@_query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45) GROUP BY 1")
def selected_lines(spark, sf_dir):
    """Lines of the parts that are picked."""
    picked = _t(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return st.selected(_t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey"), picked, "l_partkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@_query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def tagged_documents(spark, sf_dir):
    tags = _t(spark, sf_dir, "labels")
    return st.tagged(_t(spark, sf_dir, "documents").select("doc_id", "lang"), tags.union(tags), "doc_id", "quality", [0])


@_query("SELECT p_partkey, position, value FROM (SELECT p_partkey, string_split(p_name, ' ') AS args, unnest([1, 2, 3]) AS position, unnest(['small', NULL, NULL]) AS value FROM part WHERE lower(p_type) = 'promo') WHERE len(args) >= position AND (value IS NULL OR args[position] = value)")
def argument_rule_hits(spark, sf_dir):
    """Words of a part's name as arguments of its type."""
    calls = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("name"), F.split("p_name", " ").alias("args"))
    rules = spark.createDataFrame([("Promo", 1, "small"), ("promo", 2, None), ("promo", 3, None)], "name string, position int, value string")
    return ru.argument_rules(calls, rules).select("p_partkey", "position", "value")


@_query("SELECT p_partkey, list_sort(string_split(p_name, ' ')) = list_sort(string_split(lower(p_type) || ' ' || string_split(p_name, ' ')[2], ' ')) AS same, len(regexp_extract_all(p_brand, '[0-9]')) = len(string_split(p_name, ' ')) AS balanced FROM part")
def part_words(spark, sf_dir):
    """Does the type stand for the first word of a name; has the brand as many digits as the name has words."""
    words = F.split("p_name", " ")
    other = F.array(F.lower("p_type"), F.try_element_at(words, F.lit(2)))
    return _t(spark, sf_dir, "part").select("p_partkey", ru.same_multiset(words, other).alias("same"), ru.balanced(F.col("p_brand"), "[0-9]", words).alias("balanced"))


from . import catalog  # noqa: E402, F401  (adds its queries to the same tables)
