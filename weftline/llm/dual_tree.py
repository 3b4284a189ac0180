"""Ranked lexical search by dual trees, exact.

Documents are reduced to the terms that some item has, then ordered by their most telling terms, so that neighbours are alike. Each
task builds a tree over runs of its documents and one over groups of items; a node holds, for each term, the largest impact of its
documents or the largest weight of its items. The sum of products of two nodes bounds the score of every pair below them: a pair of nodes
whose bound is below the weakest kth score of the node's items is dropped with all that lies under it.

Weakest scores are known before the search: a count of impacts by size class gives for each term an impact that k documents reach, and its product with an
item's weight is reached by k documents. They rise with the best scores that a task has found. Tasks give their best k documents of
each item at most, and these meet in Spark. All sums are of 64-bit integers. Terms are compared by 64-bit hashes: of 10^9 different words and 10^5
terms of items, one pair agrees by chance with a probability of 5 in a million.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import common as c

FAN, LEAF, GROUP = 8, 16, 256
_STEP = 1 << 20  # products made at once


def _csr(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int):
    """(offsets of n rows, terms, values): the largest value of each row and term, rows and terms ascending."""
    if not len(row):
        return np.zeros(n + 1, np.int64), term, value
    order = np.lexsort((term, row))
    row, term, value = row[order], term[order], value[order]
    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (term[1:] != term[:-1]))))
    row, term, value = row[head], term[head], np.maximum.reduceat(value, head)
    return np.searchsorted(row, np.arange(n + 1)), term, value


def _tree(at: np.ndarray, term: np.ndarray, value: np.ndarray, first: int, least: int):
    """The levels of a tree, rows first, each with the coordinate maxima of ``first`` rows, then of FAN nodes, down to ``least`` nodes or fewer."""
    levels, fan = [(at, term, value, 1)], first
    while len(levels[-1][0]) - 1 > least:
        at, term, value, _ = levels[-1]
        n = len(at) - 1
        row = np.repeat(np.arange(n), np.diff(at)) // fan
        levels.append((*_csr(row, term, value, -(-n // fan)), fan))
        fan = FAN
    return levels


def bounds(docs, items: np.ndarray, dn: np.ndarray, qn: np.ndarray) -> np.ndarray:
    """The sum of products of each pair of a row of docs (offsets, terms, values) and a column of items (terms x nodes)."""
    at, term, value = docs[:3]
    size = at[dn + 1] - at[dn]
    total = np.zeros(len(dn), np.int64)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(dn):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _STEP, "right")))
        n = size[lo:hi]
        some = np.flatnonzero(n)
        if len(some):
            begin = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(begin - at[dn[lo:hi]], n)
            product = value[place] * items[term[place], np.repeat(qn[lo:hi], n)]
            total[lo + some] = np.add.reduceat(product, begin[some])
        lo = hi
    return total


def _children(fan: int, nodes: np.ndarray, n_below: int):
    """(which, child) of nodes that hold ``fan`` children each."""
    lo = nodes * fan
    n = np.minimum(lo + fan, n_below) - lo
    return np.repeat(np.arange(len(nodes)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)


class Group:
    """A tree over at most GROUP items: ``levels`` are (terms x nodes, fan), items first; terms are numbers of the group's own."""

    def __init__(self, at, term, weight, n_terms: int):
        n = len(at) - 1
        terms = np.unique(term)
        self.own = np.full(n_terms, -1)
        self.own[terms] = np.arange(len(terms))
        full = np.zeros((len(terms), n), np.int64)
        full[self.own[term], np.repeat(np.arange(n), np.diff(at))] = weight
        self.levels, self.n = [(full, 1)], n
        while self.levels[-1][0].shape[1] > FAN // 2:
            x = self.levels[-1][0]
            self.levels.append((np.maximum.reduceat(x, np.arange(0, x.shape[1], FAN), axis=1), FAN))

    def search(self, at, term, value, weakest: np.ndarray):
        """(document, item, score) of all pairs of a run of documents that reach the item's weakest score, and how many pairs of rows were compared."""
        term = self.own[term]
        known = term >= 0
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))[known]
        docs = _tree(*_csr(row, term[known], value[known], len(at) - 1), LEAF, FAN // 2)
        least = [weakest]  # of the items below each node
        for full, _ in self.levels[1:]:
            least.append(np.minimum.reduceat(least[-1], np.arange(0, len(least[-1]), FAN)))
            assert len(least[-1]) == full.shape[1]
        d, q = len(docs) - 1, len(self.levels) - 1
        dn, qn = (x.ravel() for x in np.meshgrid(np.arange(len(docs[d][0]) - 1), np.arange(self.levels[q][0].shape[1]), indexing="ij"))
        while True:
            score = bounds(docs[d], self.levels[q][0], dn, qn)
            good = score >= np.maximum(least[q][qn], 1)
            if d == q == 0:
                return dn[good], qn[good], score[good], len(dn)
            dn, qn = dn[good], qn[good]
            if d and d >= q:
                which, dn = _children(docs[d][3], dn, len(docs[d - 1][0]) - 1)
                qn, d = qn[which], d - 1
            else:
                which, qn = _children(self.levels[q][1], qn, self.levels[q - 1][0].shape[1])
                dn, q = dn[which], q - 1


def _best(item, score, doc, k: int):
    """Which k entries of each item are best: highest score, then smallest document, null last."""
    none = np.array([x is None for x in doc], bool)
    order = np.lexsort((np.array([0 if x is None else x for x in doc], np.int64), none, -score, item))
    item = item[order]
    head = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(head, np.diff(np.append(head, len(item))))
    return order[rank < k]


def impacts(n: np.ndarray, tf: np.ndarray, total: tuple[int, int]) -> np.ndarray:
    """Of tf occurrences in a document of n terms, where ``total`` is (documents with terms, all their terms)."""
    m = 25 + (75 * n * total[0]) // max(total[1], 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _class(impact: np.ndarray) -> np.ndarray:
    """The size class of impacts from 1 on, eight to a doubling."""
    e = np.frexp(impact.astype(float))[1] - 1
    return 8 * e + ((impact.astype(float) / np.exp2(e) - 1) * 8).astype(np.int64)


def least_of(which: int) -> int:
    """The smallest impact of a class."""
    return math.ceil(2.0 ** (which // 8) * (1 + which % 8 / 8))


_FEATURES = "doc_id long, n long, terms array<int>, tfs array<int>"


def _features(vocabulary):
    """For each document: how many terms it has, and the numbers and occurrences of those in the sorted hashes ``vocabulary``."""

    def work(batches):
        known = vocabulary.value
        for b in batches:
            data, at = c.strings(b.column(1))
            for lo, hi in c.parts(at):
                d, o = c.FOLD[data[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
                starts, ends, first = c.find_words(d, o, c.SPLIT_ALNUM)
                h = c.hash_spans(d, starts, ends)
                where = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                found = np.flatnonzero(known[where] == h) if len(known) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(hi - lo), np.diff(first))[found]
                key, tf = np.unique(row * len(known) + where[found], return_counts=True)
                cuts = np.searchsorted(key, np.arange(hi - lo + 1) * max(len(known), 1)).astype(np.int32)
                term = (key % max(len(known), 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.ListArray.from_arrays(cuts, term), pa.ListArray.from_arrays(cuts, tf.astype(np.int32))], ["doc_id", "n", "terms", "tfs"]
                )

    return work


def _flat(b, *names):
    """(offsets, the values of the list columns)."""
    column = b.column(names[0])
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return at, *(b.column(x).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in names)


def _histogram(total):
    def work(batches):
        for b in batches:
            at, term, tf = _flat(b, "terms", "tfs")
            n = np.repeat(b.column("n").to_numpy(zero_copy_only=False), np.diff(at))
            key, count = np.unique(term * 1024 + _class(impacts(n, tf, total)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key // 1024).astype(np.int32)), pa.array((key % 1024).astype(np.int32)), pa.array(count)], ["term", "class", "n"])

    return work


def _ordered(total, weights):
    """Documents with the impacts of their terms and their two most telling terms; those without a term of an item go."""

    def work(batches):
        w = weights.value
        for b in batches:
            at, term, tf = _flat(b, "terms", "tfs")
            size = np.diff(at)
            keep = np.flatnonzero(size)
            row = np.repeat(np.arange(len(size)), size)
            value = impacts(b.column("n").to_numpy(zero_copy_only=False)[row], tf, total)
            order = np.lexsort((term, -(value * w[term]), row))
            top = [term[order[at[keep] + np.minimum(j, size[keep] - 1)]].astype(np.int32) for j in (0, 1)]
            some = pa.array(keep)
            cuts = np.concatenate(([0], np.cumsum(size[keep]))).astype(np.int32)
            # rows that go have no entries, so the values stay as they are
            lists = [pa.ListArray.from_arrays(cuts, x.astype(np.int32)) for x in (term, value)]
            yield pa.RecordBatch.from_arrays([pa.array(top[0]), pa.array(top[1]), b.column("doc_id").take(some), *lists], ["top", "next", "doc_id", "terms", "impacts"])

    return work


def _search(sent, k: int, run: int, id_type):
    def work(batches):
        groups, n_terms, weakest, ids = sent.value
        weakest = weakest.copy()
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object))
        built = Group(*groups[0][1:], n_terms) if len(groups) == 1 else None
        for batch in batches:
            for lo in range(0, batch.num_rows, run):
                b = batch.slice(lo, run)
                at, term, value = _flat(b, "terms", "impacts")
                doc = np.array(b.column("doc_id").to_pylist(), object)
                found = [best]
                for first, *rest in groups:
                    group = built or Group(*rest, n_terms)
                    own = weakest[first : first + group.n]
                    d, q, score, _ = group.search(at, term, value, own)
                    found.append((q + first, score, doc[d]))
                item, score, doc = (np.concatenate(x) for x in zip(*found, strict=True))
                keep = _best(item, score, doc, k)
                best = item, score, doc = item[keep], score[keep], doc[keep]
                head, last = np.flatnonzero(np.diff(item, prepend=-1)), np.flatnonzero(np.diff(item, append=-1))
                full = last - head + 1 == k  # the kth score of these items is known here
                weakest[item[last[full]]] = np.maximum(weakest[item[last[full]]], score[last[full]])
        item, score, doc = best
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array([ids[i] for i in item.tolist()], id_type), pa.array(doc.tolist(), pa.int64()), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    return work


def _read_items(rows):
    """(sorted hashes of the terms, offsets, terms, counts) of item texts."""
    data, at = c.strings(pa.array([r.text for r in rows], pa.string()))
    data = c.FOLD[data]
    starts, ends, first = c.find_words(data, at, c.SPLIT_ALNUM)
    vocabulary, term = np.unique(c.hash_spans(data, starts, ends), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), np.diff(first))
    key, count = np.unique(row * max(len(vocabulary), 1) + term, return_counts=True)
    return vocabulary, np.searchsorted(key, np.arange(len(rows) + 1) * max(len(vocabulary), 1)), key % max(len(vocabulary), 1), count


def rank(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 8 << 20, run: int = 2048, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for each item, ties by ascending doc_id, null last.

    Terms are runs of digits, letters and bytes from 0x80, A to Z lower-cased; null and empty texts have none, and an item without terms, or whose
    terms no document has, gets no row. Rows of documents that repeat are ranked each; rows of items that repeat are one item, rows that share
    an id but not the text are items of their own. Other columns are not read; an empty table on either side gives an empty table.
    Items are taken in blocks of about ``block_bytes`` of text, each of which reads the documents once; a block is sent to all tasks.
    """
    spark = docs.sparkSession
    query = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    kind = dict(query.dtypes)["item_id"]
    schema = f"item int, item_id {kind}, doc_id long, score long"
    size, blocks = query.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0, 1
    block = lambda: F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    while size > blocks * block_bytes and query.groupBy(block().alias("b")).agg(F.sum(F.octet_length("text") + 16).alias("s"), F.count("*").alias("n")).where((F.col("s") > block_bytes) & (F.col("n") > 1)).limit(1).count():
        blocks *= 2
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    done = None
    for b in range(blocks):
        rows = sorted(query.where(block() == b).collect(), key=lambda r: (str(r.item_id), r.text))  # a block
        if rows:
            part = _ranked(spark, source, rows, k, run, schema).withColumn("block", F.lit(b))
            done = part if done is None else done.union(part)
    if done is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return done.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _ranked(spark, source: DataFrame, rows: list, k: int, run: int, schema: str) -> DataFrame:
    """The best k documents, or more, of each item of a block."""
    vocabulary, at, term, count = _read_items(rows)
    known = spark.sparkContext.broadcast(vocabulary)  # as large as the block
    features = c.saved(source.mapInArrow(_features(known), _FEATURES), "search-features")
    seen = features.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    total = (seen[0] or 0, seen[1] or 0)
    classes = features.mapInArrow(_histogram(total), "term int, class int, n long").groupBy("term", "class").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("class")))  # some 160 classes at most
    by_term = classes.withColumn("above", above).groupBy("term").agg(F.max("above").alias("df"), F.max(F.when(F.col("above") >= k, F.col("class"))).alias("class"))
    w, floor = np.zeros(max(len(vocabulary), 1), np.int64), np.zeros(max(len(vocabulary), 1), np.int64)
    for r in by_term.collect():  # the block's terms
        w[r.term], floor[r.term] = weight(total[0], r.df), 0 if r["class"] is None else least_of(r["class"])
    value = w[term] * count
    # alike items side by side: by their weightiest terms
    row = np.repeat(np.arange(len(rows)), np.diff(at))
    top = np.lexsort((term, -value, row))
    first = [term[top[np.minimum(at[:-1] + j, np.maximum(at[1:] - 1, 0))]] if len(top) else np.zeros(len(rows), np.int64) for j in (0, 1)]
    order = np.lexsort((first[1], first[0]))
    weakest = np.zeros(len(rows), np.int64)
    np.maximum.at(weakest, row, value * floor[term])
    groups = []
    for lo in range(0, len(rows), GROUP):
        own = order[lo : lo + GROUP]
        n = (at[1:] - at[:-1])[own]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - at[own], n)
        groups.append((lo, np.concatenate(([0], np.cumsum(n))), term[place], value[place]))
    sent = spark.sparkContext.broadcast((groups, len(w), weakest[order], [rows[i].item_id for i in order.tolist()]))  # as large as the block
    weights = spark.sparkContext.broadcast(w)
    near = features.mapInArrow(_ordered(total, weights), "top int, next int, doc_id long, terms array<int>, impacts array<int>")
    near = near.repartitionByRange(c.partitions(spark), "top", "next", "doc_id").sortWithinPartitions("top", "next", "doc_id")
    id_type = pa.array([r.item_id for r in rows]).type
    return near.mapInArrow(_search(sent, k, run, id_type), schema)
