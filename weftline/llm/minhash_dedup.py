"""Near-duplicate groups by an inverted join of MinHash signatures.

1. Every distinct set of word shingles (a *class*; its copies are only members) gets a signature of ``m`` coordinates. Sets that share
   three quarters of their union agree in at least ``t`` of them but for one pair in millions.
2. Classes are posted under their (coordinate, value) pairs: a token is 58 bits of the value's hash and the coordinate. Each chunk of classes
   sends its distinct tokens with their counts, and is told how many classes have them in all. Tokens are ranked by that, rarest first; of ``t`` or
   more agreements at least one lies in the first m - t + 1 tokens of either side, so only this prefix is posted, and a class with less than ``t``
   tokens that another has is skipped as a whole. What thousands share comes last and is hardly ever posted.
3. In each list every class is paired with the list's first class only. Pairs that agree in t coordinates are confirmed on the full
   sets; components of the confirmed links follow.
4. Only lists that still hold more than one component can miss a link. In these each class is first paired with the few of other
   components that agree most, which joins nearly all that belongs together. Then classes that are still in different components are
   compared once, in the list of their first common token, by signature and by the smallest ``low`` numbers of
   their sets. Where those are the whole sets the answer is exact and one link per component is enough; else what may be a link is
   confirmed on the full sets. Lists are cut by the size of sets, as sets of very different sizes are no link, and then into blocks of bounded
   size. Each possible link is in some list, so none is lost, and a group of copies or near copies never makes all its pairs.

Sets are compared by 64-bit numbers of their shingles. Joins on keys that a large share of the rows may have (a text's copies, a
component's classes, a list's members, the pairs of a list's head) split such keys among tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as c
from .components import components


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each row, and where each row's begin."""
    d = c.FOLD[data]
    starts, ends, first = c.find_words(d, at)
    h = c.hash_spans(d, starts, ends)
    w, n = c.windows(h, k, 5), np.diff(first)
    out, size = [], np.zeros(len(n), np.int64)
    for r in np.flatnonzero(n):
        lo, hi = first[r], first[r + 1]
        own = np.unique(w[lo : hi - k + 1]) if hi - lo >= k else c.windows(h[lo:hi], int(hi - lo), 5 + int(hi - lo) + 100)
        out.append(own)
        size[r] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(size)))


def _set_marks(u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, as two numbers per row."""
    out = []
    for x in (u, c.mix(u ^ np.uint64(0x5851F42D4C957F2D))):
        total = np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64)))
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, k: int = 5, m: int = 64) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig) of rows (doc_id, text), then their further columns; sig has m 64-bit values, none for an empty set."""
    carry = docs.columns[2:]
    odd, other = c.constants(m, 6), c.constants(m, 7)

    def sign(batches):
        for b in batches:
            data, at = c.strings(b.column(1))
            size, h1, h2, sigs = [], [], [], []
            for lo, hi in c.parts(at):
                u, begin = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k)
                n = np.diff(begin)
                sig = np.zeros((len(n), m), np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    for j in range(m):
                        sig[some, j] = np.minimum.reduceat((u ^ other[j]) * odd[j], begin[some])
                x, y = _set_marks(u, begin)
                size.append(n), h1.append(x), h2.append(y)
                sigs += [s.tobytes() if z else b"" for s, z in zip(sig, n, strict=True)]
            cat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), cat(size), cat(h1), cat(h2), pa.array(sigs, pa.binary()), *b.columns[2:]], ["doc_id", "n_shingles", "h1", "h2", "sig", *carry])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, h1 long, h2 long, sig binary" + c.typed(docs, carry))


def _band(n: np.ndarray, percent: int) -> np.ndarray:
    """A coarse size: sets that may be linked are in the same or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(101 / percent)).astype(np.int32)


def _marks(classes: DataFrame, m: int, t: int, percent: int, chunk_bytes: int) -> DataFrame:
    """(node, n_shingles, band, tokens, sig, turn, short) of the classes (node, sig, n_shingles) with ``t`` or more tokens that another class has.

    tokens are the rarest of them, less t - 1; turn has the place in tokens of every coordinate, 255 if it is not there; sig and short have
    32 and 8 bits of each value.
    """
    spark = classes.sparkSession
    n = c.chunk_count(spark, classes.count() * (8 * m + 64), chunk_bytes)
    drop = max(6, 64 - 32 - n.bit_length())
    whole = c.chunks(classes.select("node", "sig", "n_shingles"), n)
    salt, coord = c.constants(m, 8), np.arange(m, dtype=np.uint64)

    def tokens_of(packed):
        table = c.thaw(packed.to_pylist())
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(-1, m)
        return table, sig, (c.mix(sig ^ salt) & ~np.uint64(63)) | coord

    def post(key, table):
        _, _, token = tokens_of(table.column("packed"))
        _, head, keys = c.distinct((token.ravel() >> np.uint64(drop)) << np.uint64(drop))
        return c.ask(int(key[0].as_py()), keys, np.diff(np.append(head, token.size)), n, drop)

    def count(key, table):
        chunk, sizes, keys, counts = c.asked(table, drop)
        total, _ = c.by_key(keys, counts, np.add)
        cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        several = [np.flatnonzero(total[lo:hi] > 1) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "bucket": table.column("bucket"), "places": pa.array([c.pack_ascending(x) for x in several], pa.binary()), "times": pa.array([c.pack(total[lo + x]) for lo, x in zip(cuts[:-1], several, strict=True)], pa.binary())})

    def order(key, left, right):
        if left.num_rows == 0:
            return _marked([], [], [], [], [], [], [], [])
        table, sig, token = tokens_of(left.column("packed"))
        by, head, keys = c.distinct((token.ravel() >> np.uint64(drop)) << np.uint64(drop))
        begins = {b: lo for b, lo, _ in c.bucket_cuts(keys, n)}
        times = np.ones(len(keys), np.int64)
        for b, places, counts in zip(*(right.column(x).to_pylist() for x in ("bucket", "places", "times")), strict=True):
            times[begins[b] + c.unpack_ascending(places)] = c.unpack(counts)
        each = np.empty(token.size, np.int64)
        each[by] = np.repeat(times, np.diff(np.append(head, token.size)))
        each = each.reshape(token.shape)
        size = (each > 1).sum(1)
        some = np.flatnonzero(size >= t)
        token, each, size, sig = token[some], each[some], size[some], sig[some]
        # by (shared, times, token)
        first = np.argsort(token, axis=1, kind="stable")
        ranked = np.take_along_axis(np.where(each > 1, each, np.iinfo(np.int64).max), first, 1)
        first = np.take_along_axis(first, np.argsort(ranked, axis=1, kind="stable"), 1)
        inside = np.arange(m)[None] < (size - t + 1)[:, None]
        turn = np.full(token.shape, 255, np.uint8)
        np.put_along_axis(turn, first, np.where(inside, np.arange(m), 255).astype(np.uint8), 1)
        n_shingles = table.column("n_shingles").to_numpy()[some]
        low = sig.astype(np.uint32)
        return _marked(table.column("node").to_numpy()[some], n_shingles, _band(n_shingles, percent), size - t + 1, np.take_along_axis(token, first, 1)[inside].view(np.int64), low, turn, low.astype(np.uint8))

    counted = c.at_buckets(whole.groupBy("chunk").applyInArrow(post, c.ASKED), n, count, "chunk int, bucket int, places binary, times binary")
    return c.with_answers(whole, counted, n, order, "node long, n_shingles long, band int, tokens array<long>, sig binary, turn binary, short binary")


def _marked(node, n_shingles, band, sizes, tokens, *rows) -> pa.Table:
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(tokens, pa.int64()))
    return pa.table({"node": pa.array(node, pa.int64()), "n_shingles": pa.array(n_shingles, pa.int64()), "band": pa.array(band, pa.int32()), "tokens": lists} | {name: pa.array([x.tobytes() for x in r], pa.binary()) for name, r in zip(("sig", "turn", "short"), rows, strict=True)})


def _agree(a: list, b: list) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(z), np.uint8).reshape(len(z), -1) for z in (a, b))
    return (x == y).sum(1)


def _compatible(n: np.ndarray, k: np.ndarray | int, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, k) >= percent * np.maximum(n, k)


def _with_both(pairs: DataFrame, total: int, told: DataFrame, columns: list[str]) -> DataFrame:
    """The saved pairs (a, b), ``total`` of them, with a_x and b_x for each of the columns x of both classes.

    A class in a large share of the pairs, as the head of a group of near copies is, is repeated for the tasks that its pairs are dealt to.
    """
    out = pairs
    for side, other in (("a", "b"), ("b", "a")):
        counts = pairs.groupBy(side).agg(F.count("*").alias("n"))
        out = c.skew_join(out, told.select(F.col("node").alias(side), *(F.col(x).alias(f"{side}_{x}") for x in columns)), [side], counts, total, [other])
    return out.select("a", "b", *(f"{side}_{x}" for x in columns for side in ("a", "b")))


def _likely(pairs: DataFrame, marks: DataFrame, t: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sizes allow a link and whose signatures agree in t places."""

    def keep(batches):
        for x in batches:
            ok = _compatible(x.column("a_n_shingles").to_numpy(), x.column("b_n_shingles").to_numpy(), percent)
            if x.num_rows:
                ok &= _agree(x.column("a_short").to_pylist(), x.column("b_short").to_pylist()) >= t
            yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(ok)), x.column("b").filter(pa.array(ok))], ["a", "b"])

    pairs, total = c.saved_and_counted(pairs, "pairs")
    return _with_both(pairs, total, marks, ["n_shingles", "short"]).mapInArrow(keep, "a long, b long")


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links on their full sets."""

    def check(batches):
        for x in batches:
            (one, i), (two, j) = c.strings(x.column("a_shingles")), c.strings(x.column("b_shingles"))
            ok = np.zeros(x.num_rows, bool)
            for r in range(x.num_rows):  # sets are read where they are: a batch may hold many large ones
                u, v = _unpack(one[i[r] : i[r + 1]]), _unpack(two[j[r] : j[r + 1]])
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok[r] = 100 * both >= percent * (len(u) + len(v) - both)
            yield pa.RecordBatch.from_arrays([x.column(k).filter(pa.array(ok)) for k in ("a", "b")], ["a", "b"])

    pairs, total = c.saved_and_counted(pairs, "pairs")
    return _with_both(pairs, total, sets, ["shingles"]).mapInArrow(check, "a long, b long")


def _may_link(u: np.ndarray, flat: np.ndarray, at: np.ndarray, low: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(may it be a link, is that sure) of one set with each of several (ascending, one after the other, from ``at`` on).

    Sets are given by their smallest ``low`` numbers, all of them if there are fewer.
    """
    size = np.diff(at)
    top = np.uint64(np.iinfo(np.uint64).max)
    cut = np.where(size == low, flat[at[1:] - 1], top)
    if len(u) == low:
        cut = np.minimum(cut, u[-1])
    below = flat <= np.repeat(cut, size)
    spot = np.minimum(np.searchsorted(u, flat), len(u) - 1)
    both = np.add.reduceat((below & (u[spot] == flat)).astype(np.int64), at[:-1])
    union = np.add.reduceat(below.astype(np.int64), at[:-1]) + np.searchsorted(u, cut, "right") - both
    sure = cut == top
    share = percent / 100  # five and a half deviations below, so that one link in many millions would be missed
    return np.where(sure, 100 * both >= percent * union, both >= union * (share - 5.5 * np.sqrt(share * (1 - share) / np.maximum(union, 1)))), sure


def _lists(posted: DataFrame, found: DataFrame, marks: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (token, group, size, node, band, comp, *columns of marks) of the lists with more than one component; a group has the sets of a size band and of the next."""
    member = posted.join(found, "node", "left").select("token", "band", "node", F.coalesce("label", "node").alias("comp"), F.explode(F.array(F.col("band") - 1, F.col("band"))).alias("group"))
    mixed = member.groupBy("token", "group").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size"), F.min("band").alias("z")).where("x < y and z = group")
    mixed = c.saved(mixed.select("token", "group", "size"), "mixed")
    total = mixed.agg(F.sum("size")).first()[0] or 0
    member = c.skew_join(member, mixed, ["token", "group"], mixed.select("token", "group", F.col("size").alias("n")), total, ["node"])
    return member.join(marks.select("node", *columns), "node")


def _compare(lists: DataFrame, t: int, percent: int, block: int, nearest: int, low: int) -> DataFrame:
    """Pairs of different components in the same list: with ``nearest`` the few that agree most with each class, else all that may be links."""
    columns = [x for x in lists.columns if x not in ("token", "group", "size")]
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = lists.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", "group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", *columns)
    # comparing is more work than the bytes tell, so partitions stay apart
    key = ["token", "group", "lo", "hi"]
    rows = rows.repartition(c.partitions(lists.sparkSession), *key).sortWithinPartitions(*key)

    def pairs(batches):
        for table in _whole_lists(batches, key):
            for i, j in _candidates(table, t, percent, nearest, low):
                node = table.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    return rows.mapInArrow(pairs, "a long, b long").distinct()


def _whole_lists(batches, key: list[str]):
    """The rows, sorted by key, in tables that end where a list ends; a table holds a batch and a list's rows at most."""
    held = None
    for b in batches:
        table = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
        if table.num_rows:
            last = np.ones(table.num_rows, bool)
            for x in key:
                column = table.column(x).to_numpy()
                last &= column == column[-1]
            cut = int(np.argmax(last))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut)
    if held is not None:
        yield held


def _candidates(table: pa.Table, t: int, percent: int, nearest: int, low: int, most: int = 1 << 15):
    """(i, j) of the rows of each list that may be links or, with ``nearest``, agree most; ``most`` pairs at a time, or those of one row.

    In every list the rows outside its largest component are paired with all others.
    """
    token, group, lo, hi, node, comp, n, own, band = (table.column(x).to_numpy() for x in ("token", "group", "lo", "hi", "node", "comp", "n_shingles", "own", "band"))
    change = np.concatenate(([True], (token[1:] != token[:-1]) | (group[1:] != group[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    of, start = np.cumsum(change) - 1, np.flatnonzero(change)
    size = np.diff(np.append(start, len(token)))
    # how many rows of its list are in each row's component, and is that the largest one (of equal ones the least)
    order = np.lexsort((comp, of))
    head = np.flatnonzero(np.concatenate(([True], (of[order][1:] != of[order][:-1]) | (comp[order][1:] != comp[order][:-1]))))
    count = np.diff(np.append(head, len(order)))
    by = np.lexsort((comp[order][head], -count, of[order][head]))
    first = by[np.concatenate(([True], of[order][head][by][1:] != of[order][head][by][:-1]))]
    large = comp == comp[order][head[first]][of]
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(node), -1)
    turn = np.frombuffer(b"".join(table.column("turn").to_pylist()), np.uint8).reshape(len(node), -1)
    short, within, here = sig.astype(np.uint8), lo == hi, token & 63
    sets = None if nearest else table.column("low").to_pylist()
    wanted = np.flatnonzero(~large)
    cuts = np.concatenate(([0], np.cumsum(size[of[wanted]])))
    for x, y in c.parts(cuts, most):
        r = wanted[x:y]
        k = size[of[r]]
        i = np.repeat(r, k)
        j = np.repeat(start[of[r]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        # two sets of the next size band meet in its own list, rows of one block where the block meets itself
        ok = (comp[i] != comp[j]) & ((band[i] == group[i]) | (band[j] == group[i])) & _compatible(n[i], n[j], percent) & (within[i] | (own[i] != own[j]))
        if not nearest:
            ok &= large[j] | (node[j] > node[i])
        i, j = i[ok], j[ok]
        # eight bits of each coordinate rule out most; eight comparisons are added at once
        same = (short[i] == short[j]).view(np.uint64).sum(1, dtype=np.uint64)
        ok = (same * np.uint64(0x0101010101010101)) >> np.uint64(56) >= t
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        same = sig[i] == sig[j]
        agree = same.sum(1)
        # a pair is met only in the list of its first common token
        earlier = same & (turn[i] < turn[i, here[i]][:, None]) & (turn[j] < 255)
        ok = (agree >= t) & ~earlier.any(1)
        i, j, agree = i[ok], j[ok], agree[ok]
        if nearest:
            order = np.lexsort((-agree, i))
            i, j = i[order], j[order]
            begins = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
            ok = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i)))) < nearest
            yield i[ok], j[ok]
            continue
        kept = []
        for lo_, hi_ in _runs(i):
            some = j[lo_:hi_]
            others = [_unpack(sets[x]) for x in some]
            likely, sure = _may_link(_unpack(sets[i[lo_]]), np.concatenate(others), np.concatenate(([0], np.cumsum([len(x) for x in others]))), low, percent)
            one = np.unique(comp[some[likely & sure]], return_index=True)[1]  # one sure link to a component is enough
            kept += [lo_ + np.flatnonzero(likely & ~sure), lo_ + np.flatnonzero(likely & sure)[one]]
        if kept:
            kept = np.concatenate(kept)
            yield i[kept], j[kept]


def _runs(x: np.ndarray):
    """(lo, hi) of the runs of equal numbers."""
    cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, m: int = 64, t: int = 28, block: int = 1024, nearest: int = 1, low: int = 256, chunk_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of k-word shingles (A-Z folded) share at least ``percent`` of their union, through any chain of such links.

    Returns doc_id, n_shingles, component_id (smallest doc_id of the group) and kept (it is its own component_id), one row per row of
    ``docs``. ``m`` is a multiple of 8 up to 64. A text of fewer than k words, but not none, is one shingle; null, empty and blank texts have no set and are linked
    with nothing. A row without a doc_id takes part, but is never a component_id unless the group has no other (then null). Rows that
    repeat a doc_id get the same answer if they have the same text. An empty table gives an empty table.
    """
    out = grouped(docs, k, percent, m, t, block, nearest, low, chunk_bytes, id_col, text_col)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def grouped(docs: DataFrame, k: int = 5, percent: int = 75, m: int = 64, t: int = 28, block: int = 1024, nearest: int = 1, low: int = 256, chunk_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha, n_shingles, component_id, component): the groups of ``near_duplicates``, one row per row of ``docs``.

    ``component`` tells groups apart that have no doc_id, or the same one; it is null for a text without a set. ``text_sha`` is the text's digest (``text_sha``).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_sha(F.col(text_col)).alias("text_sha"))
    signed = c.saved(signatures(rows, k, m), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha")).alias("first")
    classes = signed.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(first, F.first("sig").alias("sig"), F.count("*").alias("n"))
    classes = c.saved(classes.select("h1", "h2", "n_shingles", F.col("first.doc_id").alias("first_id"), F.col("first.text_sha").alias("text_sha"), "sig", "n", F.monotonically_increasing_id().alias("node")), "classes")
    marks = c.saved(_marks(classes, m, t, percent, chunk_bytes), "marks")
    posted = marks.select("node", "band", F.explode("tokens").alias("token"))
    wanted = c.saved(classes.select("node", "text_sha", "first_id", "n").join(marks.select("node"), "node", "left_semi"), "wanted")
    sets = c.saved(_full_sets(rows, wanted, k), "sets")

    heads = c.saved(posted.groupBy("token").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1"), "heads")
    stars = c.skew_join(posted, heads.drop("n"), ["token"], heads.select("token", "n"), heads.agg(F.sum("n")).first()[0] or 0, ["node"])
    stars = stars.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    links = c.saved(_confirm(_likely(stars, marks, t, percent), sets, percent), "links")
    found = components(links)
    passing = [classes, marks, wanted, sets, heads, links, found]

    near = _compare(_lists(posted, found, marks, ["n_shingles", "sig", "turn"]), t, percent, block, nearest, low)
    more, n_more = c.saved_and_counted(_confirm(near, sets, percent), "links")
    if n_more:
        links = links.union(more)
        found = components(links)
        passing.append(found)
    lowest = marks.join(sets.select("node", F.substring("shingles", 1, 8 * low).alias("low")), "node")
    rest = _compare(_lists(posted, found, lowest, ["n_shingles", "sig", "turn", "low"]), t, percent, block, 0, low)
    last, n_last = c.saved_and_counted(_confirm(rest, sets, percent), "links")
    if n_last:
        found = components(links.union(last))
        passing.append(found)

    groups = c.saved(classes.join(found, "node", "left").select("h1", "h2", "n_shingles", "first_id", "n", F.coalesce("label", "node").alias("label")), "groups")
    for table in (*passing, more, last):  # what follows reads only groups and signed
        c.forget(table)
    totals = groups.agg(F.count("*"), F.sum("n")).first()
    least = groups.groupBy("label").agg(F.min("first_id").alias("least_id"), F.count("*").alias("n"))
    named = c.skew_join(groups.drop("n"), least.drop("n"), ["label"], least.select("label", "n"), totals[0], ["h1"]).select("h1", "h2", "n_shingles", "least_id", F.col("label").alias("component"))
    key = ["h1", "h2", "n_shingles"]
    out = c.skew_join(signed.select("doc_id", "text_sha", *key), named, key, groups.select(*key, "n"), totals[1] or 0, ["doc_id", "text_sha"], "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "text_sha", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"), "component")


def text_sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _full_sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the set of each wanted class as ascending 64-bit numbers, from one of its texts, that of its first_id."""
    with_key = lambda x, i: x.withColumn("_id", F.coalesce(i, F.lit(0))).withColumn("_none", F.col(i).isNull())
    wanted = with_key(wanted.select("node", "text_sha", "first_id", "n"), "first_id")
    key = ["text_sha", "_id", "_none"]
    rows = c.likely(with_key(rows.where("text_sha is not null"), "doc_id").select(*key, "text"), wanted, key)
    # only rows without an id can be many of one key, or those that repeat an id and its text
    total = wanted.agg(F.sum("n")).first()[0] or 0
    joined = c.skew_join(rows, wanted.select(*key, "node"), key, wanted.where("_none").select(*key, "n"), total, ["text_sha", "_id"])
    joined = joined.groupBy("node").agg(F.first("text").alias("text"))

    def make(batches):
        for b in batches:
            data, at = c.strings(b.column(1))
            for lo, hi in c.parts(at):  # a batch's sets are larger than its texts, so they leave part by part
                u, begin = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k)
                packed = [u[begin[r] : begin[r + 1]].tobytes() for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], ["node", "shingles"])

    return joined.mapInArrow(make, "node long, shingles binary")
