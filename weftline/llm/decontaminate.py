"""Benchmark decontamination with an FM-index per training shard.

A shard is what a task holds of the documents at a time, an Arrow batch, in parts of up to ``shard_words`` indexed words. Its words become symbols of the
benchmark's own vocabulary; a word that no item has ends a run, and runs shorter than the shortest window cannot hold
one, so the index keeps exactly the stretches that can match. The index has the Burrows-Wheeler transform in a
wavelet matrix, symbol counts and sampled suffix positions. Distinct windows of the benchmark whose words all occur in the shard are searched
backward, all at once, each until nothing is left of its range; occurrences are located by walking to the next sample, and the hit words merge to spans.

The benchmark is a stated query set. One of up to ``block_bytes`` is sent to every task as a whole, and nothing is shuffled. What is sent is a number for each word, and for each distinct
window where it begins and whose it is: at most 20 bytes a word of the items, so some four times ``block_bytes``. A larger one is taken in
blocks of that size, one after the other, each in a pass of its own that writes what it has found of every row; a block is dropped before the next
is read, so no more than one is held anywhere. An item that is longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c


class FmIndex:
    """Whole numbers from 1 in runs that 0 ends; the last entry is 0. Patterns have no 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16):
        self.n, self.breaks = len(text), text == 0
        suffixes = _suffix_array(text)
        before = np.concatenate((text[-1:], text[:-1]))
        bwt = before[suffixes]
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1)))).astype(np.int64)
        # a run's first place is always sampled, so that a walk never has to cross a break
        taken = (np.arange(self.n) % sample == 0) | (before == 0)
        self.marked = taken[suffixes]
        self.samples = suffixes[self.marked]
        self.marks = np.concatenate(([0], np.cumsum(self.marked)))
        self.levels = []
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            ones = ((bwt >> bit) & 1).astype(bool)
            self.levels.append((bit, np.concatenate(([0], np.cumsum(ones))).astype(np.int64), int((~ones).sum()), ones))
            bwt = np.concatenate((bwt[~ones], bwt[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        lo = np.zeros_like(at)
        for bit, ones, zeros, _ in self.levels:
            up = ((symbol >> bit) & 1).astype(bool)
            at = np.where(up, zeros + ones[at], at - ones[at])
            lo = np.where(up, zeros + ones[lo], lo - ones[lo])
        return at - lo

    def back(self, at: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one place earlier."""
        symbol, lo = np.zeros_like(at), np.zeros_like(at)
        for bit, ones, zeros, bits in self.levels:
            up = bits[at]
            symbol |= up.astype(at.dtype) << bit
            at = np.where(up, zeros + ones[at], at - ones[at])
            lo = np.where(up, zeros + ones[lo], lo - ones[lo])
        return self.below[symbol] + at - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows of each pattern (a row of the array); patterns whose range is empty are not followed further."""
        low, high = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        left = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[left, j]
            lo, hi = self.below[symbol] + self.rank(symbol, lo), self.below[symbol] + self.rank(symbol, hi)
            some = lo < hi
            left, lo, hi = left[some], lo[some], hi[some]
        low[left], high[left] = lo, hi
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these rows begin."""
        found, which, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(which):
            done = self.marked[rows]
            found[which[done]] = self.samples[self.marks[rows[done]]] + steps
            which, rows, steps = which[~done], rows[~done], steps + 1
            rows = self.back(rows)
        return found


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling over what is not in order yet; breaks count as different, by place."""
    n = len(text)
    first = text + int((text == 0).sum())
    first[text == 0] = np.arange(int((text == 0).sum()))
    order = np.argsort(first, kind="stable")
    s = first[order]
    head = np.concatenate(([True], s[1:] != s[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    alone = head & np.concatenate((head[1:], [True]))
    open_, k = order[~alone], 1
    while len(open_):
        second = rank[np.minimum(open_ + k, n - 1)]  # the last entry is a break, which no tie goes beyond
        order = np.lexsort((second, rank[open_]))
        open_, second = open_[order], second[order]
        old = rank[open_]
        i = np.arange(len(open_))
        fresh = np.concatenate(([True], old[1:] != old[:-1]))
        head = fresh | np.concatenate(([True], second[1:] != second[:-1]))
        rank[open_] = old + np.maximum.accumulate(np.where(head, i, 0)) - np.maximum.accumulate(np.where(fresh, i, 0))
        open_ = open_[~(head & np.concatenate((head[1:], [True])))]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _block(rows, window: int):
    """(sorted vocabulary, symbols of all words, [(length, where each distinct window begins, item offsets, items)], shortest length, item ids) of some items."""
    ids = [str(r[0]) for r in rows]
    data, at = c.strings(pa.array([r[1] for r in rows], pa.string()))
    data = c.FOLD[data]
    starts, ends, first = c.find_words(data, at, c.SPLIT_ALNUM)
    vocabulary, symbol = np.unique(c.hash_spans(data, starts, ends), return_inverse=True)
    symbol = (symbol + 1).astype(np.int32)
    size, sets = np.diff(first), []
    for k in sorted({int(x) for x in np.minimum(size, window)} - {0}):
        own = np.flatnonzero(size >= k if k == window else size == k)
        n = size[own] - k + 1
        item = np.repeat(own, n).astype(np.int32)
        begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[own], n)
        which = _alike(symbol, begin, k)
        pair = np.unique(which * len(ids) + item)
        owner, item = pair // len(ids), (pair % len(ids)).astype(np.int32)
        chosen = np.zeros(int(which.max()) + 1, np.int32)
        chosen[which] = begin
        sets.append((k, chosen, np.searchsorted(owner, np.arange(len(chosen) + 1)).astype(np.int32), item))
    return vocabulary, symbol, sets, min((x[0] for x in sets), default=1), ids


def _alike(symbol: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """A number for each window, the same for windows of the same symbols: found step by step, by the numbers of their halves."""
    if k == 1:
        return np.unique(symbol[begin], return_inverse=True)[1].astype(np.int64)
    half = k // 2
    a, b = _alike(symbol, begin, half), _alike(symbol, begin + half, k - half)
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


def _hits(symbols, rows, places, sigma, words, sets):
    """(places, lengths, row of each, pattern set, pattern) of all occurrences in one shard; windows with a word that the shard does not have are not searched."""
    index, present = FmIndex(symbols, sigma), np.zeros(sigma + 1, bool)
    present[symbols] = True
    for which, (k, begin, _, _) in enumerate(sets):
        left = np.arange(len(begin))
        for j in range(k):
            left = left[present[words[begin[left] + j]]]
        if not len(left):
            continue
        lo, hi = index.search(words[begin[left][:, None] + np.arange(k)].astype(np.int64))
        n = hi - lo
        if not n.sum():
            continue
        pattern = np.repeat(left, n)
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = index.locate(at)
        yield places[found], k, rows[found], which, pattern


_STATE = "doc_id long, text string, hits binary, items array<string>"
_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_TEXTS = ", items array<string>, spans array<struct<start:long,end:long>>, clean_text string"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, texts: bool = True, block_bytes: int = 32 << 20, shard_words: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Find the words of every document that lie in an occurrence of a benchmark window.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Returns doc_id,
    n_words, n_hit, n_items, items_sha256 (ids of the items with an occurring window, sorted as strings, joined by commas)
    and contaminated, one row per row of ``docs``; with ``texts`` also items, spans (byte offsets of the hit words, neighbours merged)
    and clean_text (the text without them, unchanged if there are none), then the columns ``carry`` of ``docs`` as they are. A null text has no words; a null item_id or item
    text is no item; rows that repeat give equal results; an empty benchmark hits nothing and an empty table gives an empty table. Columns to
    carry whose names the result has need other names first.
    """
    query = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text")).where("id is not null and text is not null")
    total = query.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    named = [f"_{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(x).alias(n) for x, n in zip(carry, named, strict=True)))
    state = _STATE + c.typed(rows, named)
    schema = _RESULT + (_TEXTS if texts else "") + c.typed(docs, carry)
    for b in range(n):
        part = query if n == 1 else query.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b)
        block = docs.sparkSession.sparkContext.broadcast(_block([tuple(r) for r in part.collect()], window))
        done = rows.mapInArrow(_scan(block, b == 0, b == n - 1, texts, shard_words, carry), schema if b == n - 1 else state)
        if b == n - 1:
            return done
        last, rows = rows, c.saved(done, "hits")
        block.destroy()
        if b:
            c.forget(last)


def _scan(block, opening: bool, closing: bool, texts: bool, shard_words: int, carry):
    def scan(batches):
        known = block.value
        for batch in batches:
            yield _scan_batch(batch, known, opening, closing, texts, shard_words, carry)

    return scan


def _scan_batch(batch, known_items, opening, closing, texts, shard_words, carry):
    vocabulary, words, sets, shortest, names = known_items
    others = batch.columns[2 if opening else 4 :]
    data, at = c.strings(batch.column(1))
    symbols, rows, places, held, first_word, seen = [], [], [], 0, [], 0
    hits: dict[int, list] = {}
    items: dict[int, set] = {}

    def flush():
        nonlocal held
        if held:
            for p, k, r, which, pattern in _hits(np.concatenate(symbols), np.concatenate(rows), np.concatenate(places), len(vocabulary), words, sets):
                order = np.argsort(r, kind="stable")
                cuts = np.flatnonzero(np.diff(np.concatenate(([-1], r[order], [-1]))))
                _, _, offsets, owners = sets[which]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    own, row = order[x:y], int(r[order[x]])
                    hits.setdefault(row, []).append((np.unique(p[own]), k))
                    got = items.setdefault(row, set())
                    for q in np.unique(pattern[own]):
                        got.update(owners[offsets[q] : offsets[q + 1]].tolist())
        symbols.clear(), rows.clear(), places.clear()
        held = 0

    for lo, hi in c.parts(at):
        d, o = c.FOLD[data[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
        starts, ends, first = c.find_words(d, o, c.SPLIT_ALNUM)
        first_word.append(first[:-1] + seen)
        if sets and len(starts):
            h = c.hash_spans(d, starts, ends)
            i = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            known = vocabulary[i] == h
            row = np.repeat(np.arange(lo, hi), np.diff(first))
            cut = np.flatnonzero(np.concatenate(([True], (known[1:] != known[:-1]) | (row[1:] != row[:-1]))))
            size = np.diff(np.append(cut, len(known)))
            keep = np.repeat(known[cut] & (size >= shortest), size)
            if keep.any():
                # every kept run is followed by a break
                k = np.flatnonzero(keep)
                last = np.concatenate(((np.diff(k) > 1) | (np.diff(np.repeat(np.arange(len(cut)), size)[k]) > 0), [True]))
                spot = np.arange(len(k)) + np.concatenate(([0], np.cumsum(last)[:-1]))
                s = np.zeros(len(k) + int(last.sum()), np.int64)
                p, r = s.copy(), s.copy()
                s[spot], p[spot], r[spot] = i[k] + 1, k - first[row[k] - lo], row[k]
                symbols.append(s), rows.append(r), places.append(p)
                held += len(s)
        seen += len(starts)
        if held >= shard_words:
            flush()
    flush()
    first_word = np.append(np.concatenate(first_word) if first_word else np.zeros(0, np.int64), seen)
    counts = np.diff(first_word)
    old_hits = [None] * batch.num_rows if opening else batch.column(2).to_pylist()
    old_items = [None] * batch.num_rows if opening else batch.column(3).to_pylist()
    hit_words, named = [], []
    for r in range(batch.num_rows):
        got = hits.get(r)
        place = np.zeros(0, np.int64) if old_hits[r] is None else c.unpack_ascending(old_hits[r])
        if got:
            mask = np.zeros(int(counts[r]), bool)
            mask[place] = True
            for p, k in got:
                mask |= c.cover(len(mask), p, k)
            place = np.flatnonzero(mask)
        hit_words.append(place)
        named.append(sorted({*(old_items[r] or ()), *(names[x] for x in items.get(r, ()))}))
    if not closing:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.pack_ascending(x) for x in hit_words], pa.binary()), pa.array(named, pa.list_(pa.string())), *others], ["doc_id", "text", "hits", "items", *(f"_{i}" for i in range(len(carry)))])
    n_hit = [len(x) for x in hit_words]
    shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]
    out = {"doc_id": batch.column(0), "n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in named], pa.int64()), "items_sha256": pa.array(shas, pa.string()), "contaminated": pa.array([x > 0 for x in n_hit], pa.bool_())}
    if texts:
        spans, clean, raw = [], batch.column(1).to_pylist(), data.tobytes()
        for r, place in enumerate(hit_words):
            spans.append([])
            if len(place):
                text = raw[at[r] : at[r + 1]]
                d = np.frombuffer(text, np.uint8)
                starts, ends, _ = c.find_words(c.FOLD[d], np.array([0, len(d)]), c.SPLIT_ALNUM)
                edge = np.flatnonzero(np.diff(place) > 1)
                cut = [(int(starts[x]), int(ends[y])) for x, y in zip(place[np.concatenate(([0], edge + 1))], place[np.concatenate((edge, [len(place) - 1]))], strict=True)]
                spans[-1] = [{"start": x, "end": y} for x, y in cut]
                clean[r] = b"".join(text[x:y] for x, y in zip([0, *(y for _, y in cut)], [*(x for x, _ in cut), len(text)], strict=True)).decode("utf-8", "replace")
        out |= {"items": pa.array(named, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "clean_text": pa.array(clean, pa.string())}
    return pa.RecordBatch.from_arrays([*out.values(), *others], [*out, *carry])
