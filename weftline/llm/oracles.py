"""DuckDB SQL for the queries that SQL can express."""

from .license_votes import NOTICES, PHRASES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, blank: str = r"[\x20\x09-\x0D]+") -> str:
    return f"[x for x in string_split_regex(coalesce({text}, ''), '{blank}') if x <> '']"


def _fold(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def _runs(table: str, key: str, k: int) -> str:
    """(key, p, w): the windows of k words of table (key, ws)."""
    return f"SELECT {key}, p, array_to_string(ws[p:p + {k - 1}], ' ') AS w FROM (SELECT {key}, ws, unnest(generate_series(1, len(ws) - {k - 1})) AS p FROM {table} WHERE len(ws) >= {k})"


OP3 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS ws FROM documents),
r AS ({_runs("d", "doc_id", 13)}),
f AS (SELECT w, min(doc_id) AS first_id FROM r GROUP BY w),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS pos FROM r JOIN f USING (w) WHERE first_id < doc_id),
ws AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
k AS (SELECT ws.doc_id, string_agg(word, ' ' ORDER BY ws.pos) AS kept, count(*) AS n FROM ws ANTI JOIN gone ON ws.doc_id = gone.doc_id AND ws.pos = gone.pos GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, strlen(body) AS n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to FROM g
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_fold("text"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, w FROM ({_runs("d", "doc_id", 5)}) UNION SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.w = b.w AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.size + y.size - shared)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
least AS (SELECT a, min(b) AS other FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(size, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id, d.doc_id <= coalesce(other, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
"""

_COUNT = lambda expression, pattern: f"length(regexp_replace({expression}, '[^{pattern}]', '', 'g'))"

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, chr(0)) AS lang, coalesce(text, '') AS t, {_words("text")} AS ws, {_words(_fold("text"))} AS fs FROM documents),
classes AS (SELECT doc_id, lang, {_COUNT("t", "a-z")} AS c0, {_COUNT("t", "A-Z")} AS c1, {_COUNT("t", "0-9")} AS c2, {_COUNT("t", chr(92) + "x20" + chr(92) + "x09-" + chr(92) + "x0D")} AS c3, {_COUNT("t", "#*$%&|<>")} AS c4,
  strlen(t) AS n, strlen(t) - strlen(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) AS c6 FROM d),
counts AS (SELECT doc_id, lang, unnest([0, 1, 2, 3, 4, 5, 6]) AS bin, unnest([c0, c1, c2, c3, c4, n - c0 - c1 - c2 - c3 - c4 - c6, c6]) AS x FROM classes),
ref_chars AS (SELECT lang, bin, sum(x) / sum(sum(x)) OVER (PARTITION BY lang) AS q FROM counts GROUP BY lang, bin),
own_chars AS (SELECT doc_id, lang, bin, x / greatest(sum(x) OVER (PARTITION BY doc_id), 1) AS p FROM counts),
char_far AS (SELECT doc_id, sqrt(greatest(sum(coalesce(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) END, 0) + coalesce(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) END, 0)) / 2, 0)) AS far FROM own_chars JOIN ref_chars USING (lang, bin) GROUP BY 1),
w AS (SELECT doc_id, lang, unnest(fs) AS word FROM d),
per_lang AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2),
common AS (SELECT lang, word, n FROM per_lang QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 64),
totals AS (SELECT lang, sum(n) AS n FROM per_lang GROUP BY 1),
ref_words AS (SELECT lang, word, common.n / totals.n AS q FROM common JOIN totals USING (lang) UNION ALL SELECT lang, NULL, 1 - sum(common.n) / any_value(totals.n) FROM common JOIN totals USING (lang) GROUP BY lang),
own_words AS (SELECT doc_id, w.lang, common.word, count(*) AS x FROM w LEFT JOIN common ON w.lang = common.lang AND w.word = common.word GROUP BY 1, 2, 3),
own_total AS (SELECT doc_id, lang, sum(x) AS n FROM own_words GROUP BY 1, 2),
both_words AS (SELECT o.doc_id, coalesce(x / o.n, 0) AS p, q FROM own_total o JOIN ref_words r ON r.lang = o.lang LEFT JOIN own_words y ON y.doc_id = o.doc_id AND y.word IS NOT DISTINCT FROM r.word),
word_far AS (SELECT doc_id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS far FROM both_words GROUP BY 1),
r AS ({_runs("d", "doc_id", 8)}),
again AS (SELECT doc_id, w FROM r GROUP BY 1, 2 HAVING count(*) > 1),
repeats AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + 7)) AS pos FROM r JOIN again USING (doc_id, w)) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2) GROUP BY 1),
base AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST({_COUNT("t", "#*$%&|<>")} AS BIGINT) AS n_symbols, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN dups ON dups.doc_id = d.doc_id LEFT JOIN repeats ON repeats.doc_id = d.doc_id),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT j.*, NOT base_failed AND NOT (n_words >= 50 AND (coalesce(c.far, 0) > 0.3 OR coalesce(wf.far, 0) > 0.5)) AS kept FROM judged j LEFT JOIN char_far c ON c.doc_id = j.doc_id LEFT JOIN word_far wf ON wf.doc_id = j.doc_id
"""

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP10 = f"""
WITH d AS (SELECT doc_id, {_words(_fold("text"), _SPLIT)} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS id, {_words(_fold("text"), _SPLIT)} AS ws FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT id, w, 10 AS k FROM ({_runs("b", "id", 10)}) UNION SELECT id, array_to_string(ws, ' '), len(ws) FROM b WHERE len(ws) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT k FROM v),
r AS (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS w FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM d CROSS JOIN sizes WHERE len(ws) >= k)),
h AS (SELECT DISTINCT doc_id, p, r.k, id FROM r JOIN v ON r.w = v.w AND r.k = v.k),
words AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS pos FROM h) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

_TEMPLATES = ", ".join(f"({i}, '{label}', {str(phrase).lower()}, '{text}')" for i, (label, text, phrase) in enumerate([*((*x, True) for x in PHRASES), *((*x, False) for x in NOTICES)]))
OP11 = f"""
WITH d AS (SELECT doc_id, {_words(_fold("text"), _SPLIT)} AS ws FROM documents),
m AS (SELECT id, label, phrase, {_words(_fold("body"), _SPLIT)} AS ws, CASE WHEN phrase THEN 2 ELSE 4 END AS k FROM (VALUES {_TEMPLATES}) AS x(id, label, phrase, body)),
g AS (SELECT id, k, t, ws[t + 1:t + k] AS run FROM (SELECT *, unnest(range(len(ws) - k + 1)) AS t FROM m)),
r AS (SELECT doc_id, k, i, ws[i + 1:i + k] AS run FROM (SELECT doc_id, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM d CROSS JOIN (VALUES (2), (4)) AS sizes(k) WHERE len(ws) >= k)),
v AS (SELECT DISTINCT doc_id, id, r.k, i - t AS diagonal, t FROM r JOIN g ON r.k = g.k AND r.run = g.run),
p AS (SELECT doc_id, label, diagonal FROM v JOIN m USING (id) WHERE phrase GROUP BY doc_id, id, label, diagonal, ws HAVING count(*) = len(any_value(m.ws)) - 1),
n AS (SELECT DISTINCT doc_id, id, k, diagonal FROM v WHERE k = 4),
j AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, id ORDER BY diagonal) <= 3 THEN 0 ELSE 1 END AS fresh FROM n),
i AS (SELECT doc_id, id, diagonal, sum(fresh) OVER (PARTITION BY doc_id, id ORDER BY diagonal) AS island FROM j),
w AS (SELECT doc_id, id, island, min(diagonal + t) AS lo, max(diagonal + t) + 4 AS hi, len(list_distinct(flatten(list(range(t, t + 4))))) AS covered FROM i JOIN v USING (doc_id, id, diagonal) GROUP BY ALL),
s AS (SELECT doc_id, label, covered / greatest(len(ws), hi - lo) AS coverage FROM w JOIN m USING (id)),
b AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY 1),
a AS (SELECT doc_id, max(coverage) AS score, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE coverage >= 0.75) AS labels
      FROM (SELECT doc_id, label, coverage FROM s UNION ALL SELECT doc_id, label, 1.0 FROM p) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id
"""

OP13 = f"""
WITH d AS (SELECT doc_id, {_words(_fold("text"), _SPLIT)} AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS term, len(ws) AS n FROM d),
x AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS nn, CAST(coalesce(sum(len(ws)), 0) AS BIGINT) AS ll FROM d),
f AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM t GROUP BY 1, 2),
g AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM g CROSS JOIN x),
q AS (SELECT item_id, text, unnest({_words(_fold("text"), _SPLIT)}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
s AS (SELECT item_id, text, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) CROSS JOIN x GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) <= 10
"""

OP12 = """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END)) AS tab),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS donor,
        xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))), lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1])), 4294967295) % 9 AS h
      FROM (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY 1) CROSS JOIN crc),
k AS (SELECT c.*, least(c.h, coalesce(o.n, 0)) AS lead FROM c LEFT JOIN c o ON o.conv_id = c.donor),
r AS (SELECT k.conv_id, t.p AS d, role, text FROM k JOIN t ON t.conv_id = k.donor AND t.p < k.h UNION ALL SELECT k.conv_id, t.p - h + lead, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.p >= k.h),
w AS (SELECT k.conv_id, coalesce(turns, []) AS turns FROM k LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY d) AS turns FROM r GROUP BY 1) x ON x.conv_id = k.conv_id),
p AS (SELECT conv_id, d, CAST(turns[:d] AS VARCHAR) || len(turns[:d]) AS node, CASE WHEN d > 0 THEN CAST(turns[:d - 1] AS VARCHAR) || (d - 1) END AS parent, coalesce(strlen(turns[d].text), 0) AS bytes, d = len(turns) AS last
      FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM w)),
n AS (SELECT node, any_value(d) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM p GROUP BY 1),
g AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN g ON g.parent = n.node),
s AS (SELECT p.node, CAST(count(*) FILTER (WHERE v.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((v.n_convs - 1) * v.bytes) AS BIGINT) AS saved_tokens FROM v JOIN p ON p.conv_id = v.conv_id AND p.d <= v.depth GROUP BY 1)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s ON s.node = v.node LEFT JOIN n u ON u.node = v.parent
"""
