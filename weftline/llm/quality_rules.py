"""Quality rules by distribution divergence.

Two histograms describe a text: its characters by class, and its words by the commonest words of a language (all
other words are one more bin). The references are the same histograms over all documents of a language, and every language has one. A
document of enough words whose Jensen-Shannon distance to the reference is too large fails; short ones are judged by the base rules only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common as c

#: The classes of bytes, by their order; what is left are the bytes from 0x80.
CLASSES = ("lower", "upper", "digit", "blank", "symbol", "point", "other")
_CLASS = np.full(256, 6, np.uint8)
_CLASS[:0x80] = 5
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
#: The symbols of the base rule.
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_CLASS[_SYMBOLS] = 4
_NULL = "\0"


def _runs(batch, column: int):
    data, at = c.strings(batch.column(column))
    for lo, hi in c.parts(at):
        d, o = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        starts, ends, first = c.find_words(d, o)
        yield lo, hi, d, o, starts, ends, first


def _class_counts(d, o) -> np.ndarray:
    row = np.repeat(np.arange(len(o) - 1), np.diff(o))
    return np.bincount(row * len(CLASSES) + _CLASS[d], minlength=(len(o) - 1) * len(CLASSES)).reshape(-1, len(CLASSES))


_HELD = 1 << 20  # counts that a task holds before it passes them on


def language_references(docs: DataFrame, common: int = 64, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, n_docs, chars, n_words, keys, counts): class counts and the ``common`` commonest words (as hashes, A-Z folded) of each language, over all documents.

    A null language has a reference of its own, over the documents without one.
    """

    def count(batches):
        held: dict = {}
        size = 0
        for batch in batches:
            langs, which = np.unique(np.array(batch.column(0).fill_null(_NULL).to_pylist(), object).astype(str), return_inverse=True) if batch.num_rows else (np.zeros(0, str), np.zeros(0, int))
            for lo, hi, d, o, starts, ends, first in _runs(batch, 1):
                keys, chars, own = c.hash_spans(c.FOLD[d], starts, ends), _class_counts(d, o), which[lo:hi]
                owner = np.repeat(own, np.diff(first))
                for i in np.unique(own):
                    # what is counted of a language besides its words: its classes, words and documents
                    fixed = np.append(chars[own == i].sum(0), [(owner == i).sum(), (own == i).sum()])
                    found, n = np.unique(keys[owner == i], return_counts=True)
                    held.setdefault(langs[i], []).append((np.concatenate((np.arange(len(fixed)), found.view(np.int64))), np.concatenate((fixed, n)), np.arange(len(fixed) + len(n)) < len(fixed)))
                    size += len(n)
                if size > 2 * _HELD:
                    held, size = _merged(held)
                if size > _HELD:
                    yield from _counted(held)
                    held, size = {}, 0
        yield from _counted(_merged(held)[0])

    counts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, fixed boolean, key long, n long")
    totals = counts.groupBy("lang", "fixed", "key").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("place", F.row_number().over(Window.partitionBy("lang", "fixed").orderBy(F.desc("n"), "key")))
    bins = ranked.where(F.col("place") <= max(common, len(CLASSES) + 2)).groupBy("lang").agg(
        F.sort_array(F.collect_list(F.when(F.col("fixed"), F.struct("key", "n")))).alias("fixed"),
        F.sort_array(F.collect_list(F.when(~F.col("fixed") & (F.col("place") <= common), F.struct("key", "n")))).alias("words"),
    )
    n = F.col("fixed.n")
    return bins.select("lang", F.element_at(n, len(CLASSES) + 2).alias("n_docs"), F.slice(n, 1, len(CLASSES)).alias("chars"), F.element_at(n, len(CLASSES) + 1).alias("n_words"), F.col("words.key").alias("keys"), F.col("words.n").alias("counts"))


def _merged(held: dict) -> tuple[dict, int]:
    """The counts of a task with each key of a language once, and how many there are."""
    out = {}
    for lang, parts in held.items():
        key, n, fixed = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((key, ~fixed))
        key, n, fixed = key[order], n[order], fixed[order]
        head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (fixed[1:] != fixed[:-1]))))
        out[lang] = [(key[head], np.add.reduceat(n, head), fixed[head])]
    return out, sum(len(x[0][0]) for x in out.values())


def _counted(held: dict):
    for lang, parts in held.items():
        for key, n, fixed in parts:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(fixed), pa.array(key), pa.array(n)], ["lang", "fixed", "key", "n"])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (0 to 1) of rows of counts to the rows of q; a row without counts is at distance 0."""
    total = p.sum(-1, keepdims=True)
    p, q = p / np.maximum(total, 1), q / np.maximum(q.sum(-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)).sum(-1) / 2
    return np.where(total[..., 0] > 0, np.sqrt(np.maximum(d, 0)), 0)


_RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def quality_rules(docs: DataFrame, references: DataFrame | None = None, least_words: int = 50, most_char_distance: float = 0.3, most_word_distance: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """Base counts and the divergence verdict of every row.

    ``kept`` is false if the base rules fail or if a text of at least ``least_words`` words is further than ``most_char_distance`` or
    ``most_word_distance`` from the reference of its language. Returns
    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance and word_distance, then
    the columns ``carry`` of ``docs`` as they are; give those whose names these columns have other names first.
    A null or empty text has no words, so it fails the base rules. A text without a language is compared with the reference of the texts
    without one and with those of the large languages (at least a 500th of all documents each, so 500 at most), and the nearest counts; a
    language that ``references`` lacks has distance 0. Rows that repeat give equal results; an empty table gives an empty table.
    References of large languages go to every task; texts of other languages are joined to theirs.
    """
    if references is None:
        references = c.saved(language_references(docs, lang_col=lang_col, text_col=text_col), "references")
    total = references.agg(F.sum("n_docs"), F.count("*")).first()
    large = (F.col("n_docs") * 500 >= (total[0] or 0)) | (F.col("lang") == _NULL)
    known = {r["lang"]: _Reference(r) for r in references.where(large).collect()}  # 501 rows of a fixed number of bins at most
    names = [f"_{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), *(F.col(x).alias(n) for x, n in zip(carry, names, strict=True)))
    schema = _RESULT + c.typed(docs, carry)

    def judge(joined: bool):
        def work(batches):
            for batch in batches:
                langs = batch.column(1).to_pylist()
                refs = {x: _Reference(r) for x, r in zip(langs, batch.column(batch.num_columns - 1).to_pylist(), strict=True) if r is not None} if joined else known
                own = np.array([_NULL if x is None else x for x in langs], object)
                done = [_measure(d, o, starts, ends, first, own[lo:hi], refs) for lo, hi, d, o, starts, ends, first in _runs(batch, 2)]
                base = np.concatenate([x for x, _, _ in done]) if done else np.zeros((0, 5), np.int64)
                far = np.concatenate([np.stack(x[1:], 1) for x in done]) if done else np.zeros((0, 2))
                failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
                odd = (base[:, 0] >= least_words) & ((far[:, 0] > most_char_distance) | (far[:, 1] > most_word_distance))
                out = [batch.column(0), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & ~odd), pa.array(far[:, 0]), pa.array(far[:, 1])]
                yield pa.RecordBatch.from_arrays([*out, *batch.columns[3 : 3 + len(carry)]], [*(x.split()[0] for x in _RESULT.split(", ")), *carry])

        return work

    if total[1] <= len(known):
        return rows.mapInArrow(judge(False), schema)
    here = F.coalesce(F.col("lang").isin([x for x in known if x != _NULL]), F.lit(True))
    rest = references.where(~large).select("lang", F.struct("chars", "n_words", "keys", "counts").alias("_reference"))
    return rows.where(here).mapInArrow(judge(False), schema).union(rows.where(~here).join(rest, "lang", "left").select(*rows.columns, "_reference").mapInArrow(judge(True), schema))


class _Reference:
    """The histograms of a language: class counts, the ascending hashes of its commonest words, their counts and that of all others."""

    def __init__(self, row):
        keys = np.array(row["keys"], np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.chars, self.keys = np.array(row["chars"], float), keys[order]
        self.words = np.append(np.array(row["counts"], float)[order], row["n_words"] - sum(row["counts"]))


def _measure(d, o, starts, ends, first, lang, refs: dict):
    n, size = np.diff(first), len(o) - 1
    row = np.repeat(np.arange(size), n)
    lead = np.concatenate(([0], np.cumsum((d & 0xC0) != 0x80)))
    word_chars = np.bincount(row, lead[ends] - lead[starts], size).astype(np.int64)
    symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[d])))
    base = np.stack([n, word_chars, symbols[o[1:]] - symbols[o[:-1]], _dup_lines(d, o, starts), _repeat_words(c.hash_spans(d, starts, ends), first, 8)], 1)
    h, own = c.hash_spans(c.FOLD[d], starts, ends), _class_counts(d, o)
    char_far, word_far = np.full(size, np.inf), np.full(size, np.inf)
    for x in set(lang.tolist()):
        use = np.flatnonzero(lang == x)
        place = np.full(size, -1)
        place[use] = np.arange(len(use))
        word = np.flatnonzero(place[row] >= 0)
        for r in refs.values() if x == _NULL else [refs[x]] if x in refs else []:
            k = len(r.keys)
            at = np.minimum(np.searchsorted(r.keys, h[word]), max(k - 1, 0))
            at = np.where(r.keys[at] == h[word], at, k) if k else np.zeros(len(word), np.int64)
            hist = np.bincount(place[row[word]] * (k + 1) + at, minlength=len(use) * (k + 1)).reshape(len(use), k + 1)
            w, far = distance(hist, r.words), distance(own[use], r.chars)
            better = w < word_far[use]
            word_far[use], char_far[use] = np.where(better, w, word_far[use]), np.where(better, far, char_far[use])
    return base, np.where(np.isinf(char_far), 0.0, char_far), np.where(np.isinf(word_far), 0.0, word_far)


def _repeat_words(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Words of each row in windows of k words that its text has twice or more."""
    size = len(first) - 1
    w = c.windows(h, k, 3)
    ok = np.flatnonzero(c.inside_rows(first, k))
    row = np.searchsorted(first, ok, "right") - 1
    key = w[ok] ^ c.mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(s), bool)
    again[order] = np.concatenate((same, [False]))[: len(s)] | np.concatenate(([False], same))[: len(s)]
    covered = c.cover(len(h), ok[again], k)
    total = np.concatenate(([0], np.cumsum(covered)))
    return (total[first[1:]] - total[first[:-1]]).reshape(size)


def _dup_lines(d: np.ndarray, o: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    size = len(o) - 1
    feeds = np.flatnonzero(d == 10)
    row_feed = np.searchsorted(o, feeds, "right") - 1
    lo = np.concatenate((o[:-1], feeds + 1))
    row = np.concatenate((np.arange(size), row_feed))
    order = np.lexsort((lo, row))
    lo, row = lo[order], row[order]
    hi = np.concatenate((lo[1:] - 1, o[-1:]))  # before the line feed
    last = np.concatenate((row[1:] != row[:-1], [True]))
    hi = np.where(last, o[row + 1], hi)
    words = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi, row = lo[words], hi[words], row[words]
    key = c.hash_spans(d, lo, hi) ^ c.mix(row.astype(np.uint64) + np.uint64(1))
    seen, place = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[place] = False
    return np.bincount(row, again, size).astype(np.int64)
