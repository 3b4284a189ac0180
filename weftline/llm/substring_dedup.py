"""Substring dedup by fixed-block anchors.

Any run of ``window`` words holds a whole block of ``(window + 1) // 2`` words that begins at a
multiple of the block length in its own document. So the aligned blocks of every document are
the index, every rolling block is a probe, and a repeat cannot hide from them:

1. each chunk of documents sends the marks of its distinct rolling blocks to their buckets, with two bits: is the block aligned
   somewhere in the chunk, and do several of its documents have it;
2. a bucket answers with the marks that are aligned somewhere and lie in several documents: the hits;
3. hits are extended: every window around a hit is hashed in full (64 bits), each chunk sends its distinct windows with the smallest doc_id
   that has them, and a bucket answers with the smallest of all. Windows that also begin in a smaller doc_id are repeats; those that
   follow each other merge to maximal repeats, which are removed.

Extension goes through the windows' own keys and not through pairs of documents, and a passage that thousands of a chunk's documents
share is one entry of the chunk. Marks only choose candidates: a false hit costs one window and changes nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c

_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:long,end:long>>"


_NONE = np.iinfo(np.int64).max


def _chunk_words(table: pa.Table):
    """(lo, hi, data, at, starts, ends, first, hashes, number of earlier words) by runs of rows."""
    data, at = c.strings(table.column(1))
    seen = 0
    for lo, hi in c.parts(at):
        d, o = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        starts, ends, first = c.find_words(d, o)
        yield lo, hi, d, o, starts, ends, first, c.hash_spans(d, starts, ends), seen
        seen += len(starts)


def _ids(table: pa.Table) -> np.ndarray:
    """doc_ids in order; null, which sort_by puts last, is above all of them and matches nothing."""
    return table.column(0).combine_chunks().fill_null(_NONE).to_numpy().astype(np.int64)


def _rank(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The row of each word, and so, as ids ascend, the order of its doc_id."""
    return np.repeat(np.arange(len(ids)), np.diff(first))


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = True, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), chunk_bytes: int = 16 << 20) -> DataFrame:
    """Remove each word that a window of ``window`` words covers whose words also begin in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space); with ``texts``
    also kept_text (the text without the removed stretches; unchanged if none is) and spans (byte offsets of what was
    removed), then the columns ``carry`` of ``docs`` as they are; give those whose names these columns have other names first. A null text has no words and stays null. A null
    doc_id is smaller than none and none is smaller than it, so such a row is kept whole. Rows that repeat a doc_id don't remove
    each other's words. An empty table gives an empty table. A task holds a chunk of about ``chunk_bytes`` of text, or one longer text.
    """
    spark = docs.sparkSession
    named = [f"_{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(x).alias(n) for x, n in zip(carry, named, strict=True)))
    size = c.text_bytes(rows, "text")
    n = c.chunk_count(spark, size, chunk_bytes)
    block = (window + 1) // 2
    # sixteen marks or more for each word of a bucket, a word being six bytes, so that few agree by chance
    drop = max(0, 64 - max(26, (size // n // 6).bit_length() + 4) - n.bit_length())
    whole = c.chunks(rows, n)
    schema = (_RESULT if texts else _RESULT.split(", kept_text")[0]) + c.typed(docs, carry)
    empty = pa.schema([(f"_{i}", pa.null()) for i in range(len(carry))])

    none = c.ask(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), n)
    none = none.append_column("low", pa.array([], pa.int64())).append_column("ids", pa.array([], pa.binary()))

    def marks_of(table):
        """(place of every rolling block, its mark, its row, is it aligned, number of words) of a chunk."""
        ids, places, marks, rows, aligned, seen_rows, total = _ids(table), [], [], [], [], 0, 0
        for _, _, _, _, _, _, first, h, seen in _chunk_words(table):
            own = ids[seen_rows : seen_rows + len(first) - 1]
            ok = np.flatnonzero(c.inside_rows(first, block))
            row = _rank(own, first)[ok]
            ok, row = ok[own[row] < _NONE], row[own[row] < _NONE]
            marks.append((c.windows(h, block, 1)[ok] >> np.uint64(drop)) << np.uint64(drop))
            places.append(ok + seen)
            aligned.append((ok - first[row]) % block == 0)
            rows.append(row + seen_rows)
            seen_rows += len(own)
            total = seen + len(h)
        return np.concatenate(places), np.concatenate(marks), np.concatenate(rows), np.concatenate(aligned), total

    def blocks(key, table):
        table = c.thaw(table.column("packed").to_pylist())
        _, marks, row, aligned, _ = marks_of(table)
        order, head, keys = c.distinct(marks)
        if not len(keys):
            return c.ask(0, keys, keys.astype(np.int64), n, drop)
        doc = _ids(table)[row[order]]
        several = np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head)
        return c.ask(int(key[0].as_py()), keys, np.logical_or.reduceat(aligned[order], head) + 2 * several, n, drop)

    def match(key, table):
        chunk, sizes, keys, flags = c.asked(table, drop)
        flags, times = c.by_key(keys, flags, np.bitwise_or)
        return _answers(int(key[0].as_py()), chunk, sizes, (flags & 1 > 0) & ((flags & 2 > 0) | (times > 1)), keys)

    def extend(key, left, right):
        if left.num_rows == 0 or right.num_rows == 0:
            return none
        table = c.thaw(left.column("packed").to_pylist())
        places, marks, _, _, total = marks_of(table)
        _, found = _found(right)
        near, ids = c.cover(total, np.maximum(places[_member(marks >> np.uint64(drop), found)] - (window - block), 0), window - block + 1), _ids(table)
        keys, docs_ = [], []
        for lo, hi, _, _, _, _, first, h, seen in _chunk_words(table):
            w = c.windows(h, window, 2)
            ok = np.flatnonzero(near[seen : seen + len(w)] & c.inside_rows(first, window))
            doc = np.repeat(ids[lo:hi], np.diff(first))[ok]
            keys.append(w[ok][doc < _NONE]), docs_.append(doc[doc < _NONE])
        keys, docs_ = np.concatenate(keys), np.concatenate(docs_)
        order, head, keys = c.distinct(keys)
        if not len(keys):
            return none
        least, most = np.minimum.reduceat(docs_[order], head), np.maximum.reduceat(docs_[order], head)
        out, low = c.ask(int(key[0].as_py()), keys, most > least, n), docs_.min()
        return out.append_column("low", pa.array([int(low)] * out.num_rows, pa.int64())).append_column("ids", pa.array([c.pack(least[lo:hi] - low) for _, lo, hi in c.bucket_cuts(keys, n)], pa.binary()))

    def decide(key, table):
        chunk, sizes, keys, several = c.asked(table)
        least = np.concatenate([np.zeros(0, np.int64), *(c.unpack(x) + low for x, low in zip(table.column("ids").to_pylist(), table.column("low").to_pylist(), strict=True))])
        first, _ = c.by_key(keys, least, np.minimum)
        return _answers(int(key[0].as_py()), chunk, sizes, (first < least) | (several > 0), keys, first)

    def finish(key, left, right):
        if left.num_rows == 0:
            return _rows([], [], [], [], [], [], texts, empty.empty_table(), carry)
        table = c.thaw(left.column("packed").to_pylist())
        ids = table.column(0).to_pylist()
        null = table.column(1).is_null().to_pylist()
        firsts, found = _found(right)
        known = _ids(table)
        words, removed, shas, kept_texts, spans = [], [], [], [], []
        for lo, hi, d, o, starts, ends, first, h, _ in _chunk_words(table):
            w = c.windows(h, window, 2)
            own = np.flatnonzero(_member(w, found) & c.inside_rows(first, window))
            doc = np.repeat(known[lo:hi], np.diff(first))[own]
            own = own[(firsts[np.searchsorted(found, w[own])] < doc) & (doc < _NONE)]
            gone = c.cover(len(starts), own, window)
            raw, total = d.tobytes(), np.concatenate(([0], np.cumsum(gone)))
            for r in range(hi - lo):
                f, g = first[r], first[r + 1]
                lost = int(total[g] - total[f])
                words.append(int(g - f))
                removed.append(lost)
                text = raw[o[r] : o[r + 1]]
                cut = []
                if lost:
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[f:g], [False])).astype(np.int8)))
                    cut = [(int(starts[f + x] - o[r]), int((starts[f + y] if f + y < g else o[r + 1]) - o[r])) for x, y in edge.reshape(-1, 2)]
                    kept = b"".join(text[x:y] for x, y in zip([0, *(y for _, y in cut)], [*(x for x, _ in cut), len(text)], strict=True))
                else:
                    kept = text
                shas.append(hashlib.sha256(b" ".join(kept.split())).hexdigest())
                if texts:
                    kept_texts.append(None if null[lo + r] else kept.decode("utf-8", "replace"))
                    spans.append([{"start": x, "end": y} for x, y in cut])
        return _rows(ids, words, removed, shas, kept_texts, spans, texts, table, carry)

    hits = c.at_buckets(whole.groupBy("chunk").applyInArrow(blocks, c.ASKED), n, match, _FOUND)
    near = c.with_answers(whole, hits, n, extend, c.ASKED + ", low long, ids binary")
    gone = c.at_buckets(near, n, decide, _FOUND)
    return c.with_answers(whole, gone, n, finish, schema)


_FOUND = "chunk int, bucket int, keys binary, firsts binary"


def _answers(bucket: int, chunk: list, sizes: list, hit: np.ndarray, keys: np.ndarray, firsts: np.ndarray | None = None) -> pa.Table:
    """The keys of each chunk that were hit, with their smallest doc_ids if there are such."""
    rows, packed, ids, lo = [], [], [], 0
    for i, size in zip(chunk, sizes, strict=True):
        own = np.flatnonzero(hit[lo : lo + size]) + lo
        lo += size
        if len(own):
            rows.append(i)
            packed.append(keys[own].tobytes())
            ids.append(b"" if firsts is None else firsts[own].tobytes())
    return pa.table({"chunk": pa.array(rows, pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "keys": pa.array(packed, pa.binary()), "firsts": pa.array(ids, pa.binary())})


def _found(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(smallest doc_ids, keys), by ascending keys."""
    keys = np.frombuffer(b"".join(answers.column("keys").to_pylist()), np.uint64)
    firsts = np.frombuffer(b"".join(answers.column("firsts").to_pylist()), np.int64)
    order = np.argsort(keys)
    return firsts[order] if len(firsts) else firsts, keys[order]


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the ascending keys ``known``; a table of bits of the keys leaves few to be looked up."""
    bits = min(24, max(10, len(known).bit_length() + 4))
    sieve = np.zeros(1 << bits, bool)
    mask = np.uint64((1 << bits) - 1)
    sieve[(known & mask).astype(np.int64)] = True
    out = sieve[(x & mask).astype(np.int64)]
    some = np.flatnonzero(out)
    if len(known):
        out[some] = known[np.minimum(np.searchsorted(known, x[some]), len(known) - 1)] == x[some]
    return out


def _rows(ids, words, removed, shas, kept_texts, spans, texts: bool, table: pa.Table, carry) -> pa.Table:
    out = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
    if texts:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out |= {"kept_text": pa.array(kept_texts, pa.string()), "spans": pa.array(spans, span)}
    return pa.Table.from_arrays([*out.values(), *(c.plain(table.column(f"_{i}")) for i in range(len(carry)))], [*out, *carry])
