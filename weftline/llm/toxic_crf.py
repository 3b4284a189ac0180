"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so tokens are labelled from them first: a *trait* of a word (the word itself or its first three to eight
bytes) that toxic documents have far more often than others marks its words in toxic documents. The field has two states (clean,
toxic), a weight for each trait, a bias and transition weights, and is trained on these tokens by the gradient of its
likelihood. A document's marginals, by the forward-backward recursion over its whole text, give the offending offsets, and a
logistic regression on them the score. Between words with a trait the chain is homogeneous, so the recursion goes from one to
the next by powers of the transition matrix: exact, whatever the length of the text.

The field is fitted on a bounded sample of labelled rows (``most_toxic`` and ``most_clean`` different texts of at most ``most_bytes`` of either class, those
that hash lowest); everything else runs over all rows. Scores see nothing but the text.

Traits that one half of the sample shows are tried on the other: the score is fitted on marginals of documents that their field has not seen, so weak
traits, which few toxic documents have, count for as much as they are worth, and several of them together for more.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c

_LENGTHS = (3, 4, 5, 6, 7, 8)


def traits(d: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, traits) hashes; 0 where a word is too short. The last one is of the whole word."""
    size = ends - starts
    out = np.zeros((len(starts), len(_LENGTHS) + 1), np.uint64)
    for i, k in enumerate(_LENGTHS):
        some = np.flatnonzero(size > k)
        out[some, i] = c.hash_spans(d, starts[some], starts[some] + k)
    out[:, -1] = c.mix(c.hash_spans(d, starts, ends))  # a whole word is not a prefix
    return out


def _runs(column):
    data, at = c.strings(column)
    for lo, hi in c.parts(at):
        d, o = c.FOLD[data[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
        starts, ends, first = c.find_words(d, o, c.SPLIT_ALNUM)
        yield lo, hi, d, o, starts, ends, first


def sample(docs: DataFrame, labels: DataFrame, usable, most_toxic: int, most_clean: int, most_bytes: int) -> tuple[DataFrame, dict]:
    """(doc_id, text, toxic, fold) of at most ``most_toxic`` and ``most_clean`` different labelled texts, and how many labels there are of each.

    Bounded in rows and bytes whatever the ids: the texts of a class are ordered by a hash of themselves, and those up to the limits are taken. Of equal texts one row
    counts, with the smallest doc_id, as copies would make a text's own words look like a trait. The same input gives the same sample on every run.
    """
    docs, labels = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.lit(True) if usable is None else usable)).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {int(r[0]): r[1] for r in known.groupBy("toxic").count().collect()}
    ranked = [known.where(x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for x, n in (("toxic", most_toxic), ("not toxic", most_clean))]
    rows = docs.join(F.broadcast(ranked[0].union(ranked[1])), "doc_id").where("text is not null").withColumn("at", F.sha1(F.encode("text", "UTF-8")))  # most_toxic + most_clean ids
    some = c.saved(rows.groupBy("at", "toxic").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first(F.octet_length("text")).alias("size")), "toxic-sample")
    found = []
    for toxic, n in ((True, most_toxic), (False, most_clean)):
        own, total = [], 0
        for r in some.where(F.col("toxic") == toxic).select("at", "size").orderBy("at").limit(n).collect():  # n short rows
            if total + r.size > most_bytes:
                break
            own, total = [*own[-1:], r.at], total + r.size
        found.append((F.col("toxic") == toxic) & (F.col("at") <= (own[-1] if own else "")))
    return some.where(found[0] | found[1]).select("doc_id", "text", "toxic", F.pmod(F.crc32("at"), F.lit(2)).cast("int").alias("fold")), sizes


def _counts(rows: DataFrame) -> DataFrame:
    """(trait, t0, c0, t1, c1): in how many toxic and clean documents of either fold each trait is."""

    def count(batches):
        for b in batches:
            kind = b.column(3).to_numpy(zero_copy_only=False) * 2 + 1 - b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for lo, hi, d, _, starts, ends, first in _runs(b.column(1)):
                t = traits(d, starts, ends)
                for r in range(hi - lo):
                    own = np.unique(t[first[r] : first[r + 1]])
                    own = own[own != 0]
                    keys.append(own), kinds.append(np.full(len(own), kind[lo + r]))
            own, which = np.unique(np.concatenate(keys), return_inverse=True)
            n = [pa.array(np.bincount(which, np.concatenate(kinds) == k, len(own)).astype(np.int64)) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *n], ["trait", "t0", "c0", "t1", "c1"])

    return rows.mapInArrow(count, "trait long, t0 long, c0 long, t1 long, c1 long").groupBy("trait").agg(*(F.sum(x).alias(x) for x in ("t0", "c0", "t1", "c1")))


def _lexicon(counts: DataFrame, T: int, C: int, t, c_, most_traits: int, least_gain: float, least_ratio: float) -> dict:
    """The traits (at most ``most_traits``) whose counts t and c_ of T toxic and C clean documents tell toxic from clean, with their log-odds."""
    if not T or not C:
        return {"keys": np.zeros(0, np.uint64), "gain": np.zeros(0)}
    share = T / (T + C)
    n = F.col("t") + F.col("c")
    # log-likelihood ratio against the same rate in both
    ratio = 2 * (F.col("t") * F.log(F.col("t") / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0))
    gain = F.log((F.col("t") + 0.5) / (T + 1)) - F.log((F.col("c") + 0.5) / (C + 1))
    best = counts.select("trait", t.alias("t"), c_.alias("c")).where("t >= 3").select("trait", gain.alias("gain"), ratio.alias("ratio")).where((F.col("gain") >= least_gain) & (F.col("ratio") >= least_ratio)).orderBy(F.desc("ratio"), "trait").limit(most_traits).collect()
    keys = np.array([r["trait"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return {"keys": keys[order], "gain": np.array([r["gain"] for r in best])[order]}


class Finder:
    """The words of a run that have a trait of the model: place, and the trait that tells most."""

    def __init__(self, model: dict):
        self.keys, self.gain = model["keys"], model["gain"]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, d, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        t = traits(d, starts, ends)
        word, kind = np.nonzero(self.sieve[(t & np.uint64((1 << 20) - 1)).astype(np.int64)])
        key = t[word, kind]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        real = self.keys[at] == key
        word, at = word[real], at[real]
        order = np.lexsort((-self.gain[at], word))
        word, at = word[order], at[order]
        top = np.concatenate(([True], word[1:] != word[:-1])) if len(word) else np.zeros(0, bool)
        return word[top], at[top]


def _train_field(sequences: list, n_traits: int, gain: np.ndarray, length: int = 256, steps: int = 40) -> dict:
    """Weights from (words, places, traits, labels at the places) of whole documents, cut into runs of ``length`` words."""
    trait, label, mask = [], [], []
    for n, places, which, y in sequences:
        rows = -(-n // length)
        t, l, m = np.full(rows * length, n_traits), np.zeros(rows * length, np.int8), np.zeros(rows * length, bool)
        t[places], l[places], m[:n] = which, y, True
        trait.append(t.reshape(-1, length)), label.append(l.reshape(-1, length)), mask.append(m.reshape(-1, length))
    weight, bias, step = np.append(gain, 0.0), -4.0, np.array([[0.0, -3.0], [0.0, -1.0]])
    if not trait:
        return {"weight": weight[:-1], "bias": bias, "step": step}
    trait, label, mask = np.concatenate(trait), np.concatenate(label), np.concatenate(mask)
    total = float(mask.sum())
    both = mask[:, 1:] & mask[:, :-1]
    seen_pairs = np.array([[((label[:, :-1] == i) & (label[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
    seen_trait = np.bincount(trait[mask & (label == 1)], minlength=n_traits + 1).astype(float)
    # second moments of the gradients, so that every weight gets steps of its own size
    params = np.concatenate((weight[:-1], [bias], step.ravel()))
    start, m1, m2 = params.copy(), np.zeros_like(params), np.zeros_like(params)
    for k in range(1, steps + 1):
        w, b, a = np.append(params[:n_traits], 0.0), params[n_traits], params[n_traits + 1 :].reshape(2, 2)
        e = np.exp(np.clip(w[trait] + b, -30, 30))
        M = np.exp(a)
        alpha, beta = np.ones((2, *trait.shape)), np.ones((2, *trait.shape))
        for s in range(trait.shape[1]):
            x, y = (1.0, 1.0) if s == 0 else (alpha[0, :, s - 1] * M[0, 0] + alpha[1, :, s - 1] * M[1, 0], alpha[0, :, s - 1] * M[0, 1] + alpha[1, :, s - 1] * M[1, 1])
            y = y * e[:, s]
            z = x + y
            alpha[0, :, s], alpha[1, :, s] = x / z, y / z
        pairs = np.zeros((2, 2))
        for s in range(trait.shape[1] - 2, -1, -1):
            on = mask[:, s + 1]
            p, q = beta[0, :, s + 1], beta[1, :, s + 1] * e[:, s + 1]
            x, y = M[0, 0] * p + M[0, 1] * q, M[1, 0] * p + M[1, 1] * q
            z = x + y
            beta[0, :, s], beta[1, :, s] = np.where(on, x / z, 1.0), np.where(on, y / z, 1.0)
            joint = np.stack([alpha[0, :, s] * M[0, 0] * p, alpha[0, :, s] * M[0, 1] * q, alpha[1, :, s] * M[1, 0] * p, alpha[1, :, s] * M[1, 1] * q])
            joint = joint / joint.sum(0)
            pairs += joint[:, both[:, s]].sum(1).reshape(2, 2)
        p1 = alpha[1] * beta[1] / (alpha[0] * beta[0] + alpha[1] * beta[1])
        expect = np.bincount(trait[mask], p1[mask], n_traits + 1)
        g = np.concatenate((seen_trait[:-1] - expect[:-1], [seen_trait.sum() - expect.sum()], (seen_pairs - pairs).ravel()))
        g = g - 0.01 * (params - start)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        params = params + 0.2 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-6 * total)
    return {"weight": params[:n_traits], "bias": float(params[n_traits]), "step": params[n_traits + 1 :].reshape(2, 2)}


def marginals(n: np.ndarray, row: np.ndarray, place: np.ndarray, weight: np.ndarray, bias: float, step: np.ndarray) -> np.ndarray:
    """The probability of the toxic state at each place (ascending in rows of n words), by forward and backward recursion."""
    if not len(row):
        return np.zeros(0)
    M = np.exp(step) * np.array([1.0, np.exp(bias)])
    value, left = np.linalg.eig(M)
    value, left = value.real, left.real
    right = np.linalg.inv(left)
    top = int(np.argmax(value))
    ratio = value[1 - top] / value[top]

    def power(g):
        """M to the power g, up to a factor."""
        x = np.outer(left[:, top], right[top])
        return x[None] + (np.sign(ratio) ** g * np.abs(ratio) ** g)[:, None, None] * np.outer(left[:, 1 - top], right[1 - top])[None]

    e = np.exp(np.clip(weight, -30, 30))
    begins = np.concatenate(([True], row[1:] != row[:-1]))
    head = np.flatnonzero(begins)
    counts = np.diff(np.append(head, len(row)))
    rank = np.arange(len(row)) - np.repeat(head, counts)
    alpha, beta = np.ones((len(row), 2)), np.ones((len(row), 2))
    for r in range(int(counts.max())):
        i = head[counts > r] + r
        if r == 0:
            start = np.array([1.0, np.exp(bias)])
            a = np.einsum("j,njk->nk", start, power(place[i]))
        else:
            a = np.einsum("nj,njk->nk", alpha[i - 1], power(place[i] - place[i - 1]))
        a[:, 1] *= e[i]
        alpha[i] = a / a.sum(1, keepdims=True)
    last = np.flatnonzero(np.concatenate((begins[1:], [True])))
    for r in range(int(counts.max())):
        i = last[counts > r] - r
        if r == 0:
            b = power(n[row[i]] - 1 - place[i]).sum(2)
        else:
            after = beta[i + 1] * np.stack([np.ones(len(i)), e[i + 1]], 1)
            b = np.einsum("njk,nk->nj", power(place[i + 1] - place[i]), after)
        beta[i] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1)


def _summary(n: np.ndarray, row: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What the score sees of each document: nothing, its surest word, how many toxic words are expected, and how many of a thousand words."""
    top, total = np.zeros(len(n)), np.bincount(row, p, len(n))
    np.maximum.at(top, row, p)
    return np.stack([np.ones(len(n)), top, np.log1p(total), np.log1p(1000 * total / np.maximum(n, 1))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method with halved steps; a penalty of one document keeps separable classes finite."""
    penalty = np.array([0.01, *np.ones(x.shape[1] - 1)])

    def loss(b):
        z = x @ b
        return (w * (np.logaddexp(0, z) - y * z)).sum() + (penalty * b * b).sum() / 2

    beta, now = np.zeros(x.shape[1]), loss(np.zeros(x.shape[1]))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * beta)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > now:
            size /= 2
        if size <= 1e-6 or now - loss(beta + size * step) < 1e-9 * now:
            break
        beta, now = beta + size * step, loss(beta + size * step)
    return beta


def _marked(models: list):
    """(model, tried, doc_id, toxic, packed): each document with the traits that a model finds in it, for every model that it helps to train and for the one that is tried on it."""

    def work(batches):
        finders = [Finder(m) for m in models]
        for b in batches:
            for lo, hi, d, _, starts, ends, first in _runs(b.column(1)):
                ids, toxic, folds = (b.column(i).slice(lo, hi - lo).to_pylist() for i in (0, 2, 3))
                n, out = np.diff(first), []
                for m, find in enumerate(finders):
                    word, which = find(d, starts, ends)
                    cuts = np.searchsorted(word, first)
                    out += [(m, folds[r] == m, ids[r], toxic[r], pickle.dumps((int(n[r]), word[cuts[r] : cuts[r + 1]] - first[r], which[cuts[r] : cuts[r + 1]]))) for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary())], ["model", "tried", "doc_id", "toxic", "packed"])

    return work


def _sequence_marginals(docs: list, field: dict) -> tuple:
    n = np.array([x[1] for x in docs], np.int64)
    row = np.repeat(np.arange(len(docs)), [len(x[2]) for x in docs])
    place = np.concatenate([np.zeros(0, np.int64), *(x[2] for x in docs)])
    which = np.concatenate([np.zeros(0, np.int64), *(x[3] for x in docs)]).astype(np.int64)
    return n, row, marginals(n, row, place, field["weight"][which], field["bias"], field["step"])


def _fields(models: list, most_words: int):
    """(model, field, toxic, summary): each model's field, trained on at most ``most_words`` words of either class, and what it sees of the documents that it is tried on."""

    def work(batches):
        rows = sorted((m, i, t, tried, x) for b in batches for m, tried, i, t, x in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True))
        for m in sorted({r[0] for r in rows}):
            learn = [(t, *pickle.loads(x)) for k, _, t, tried, x in rows if k == m and not tried]
            seen = [(t, *pickle.loads(x)) for k, _, t, tried, x in rows if k == m and tried]
            used, sequences = {True: 0, False: 0}, []
            for t, n, places, which in learn:
                if n and used[t] + n <= most_words:
                    used[t] += n
                    sequences.append((n, places, which, np.full(len(places), int(t), np.int8)))
            field = _train_field(sequences, len(models[m]["keys"]), models[m]["gain"])
            summary = _summary(*_sequence_marginals(seen, field))
            yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([pickle.dumps((field, np.array([x[0] for x in seen], float), summary))], pa.binary())], ["model", "packed"])

    return work


def fit(docs: DataFrame, labels: DataFrame, usable=None, most_toxic: int = 3000, most_clean: int = 9000, most_bytes: int = 24 << 20, most_traits: int = 20000, least_gain: float = 2.0, least_ratio: float = 14.0, most_words: int = 400_000) -> dict:
    """The model from rows (doc_id, text) and (doc_id, toxic): a dict of arrays whose size the limits bound.

    ``usable`` is the condition on doc_id for labels that may be learned from. Traits and score are fitted on the rows of ``sample``, the weights of a field in
    one task on ``most_words`` of their words of either class. Other columns are not read. Without labels of both classes every score is the share of toxic labels; null texts teach nothing.
    """
    rows, sizes = sample(docs, labels, usable, most_toxic, most_clean, most_bytes)
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    share = n_toxic / max(n_toxic + n_clean, 1)
    bare = {"weight": np.zeros(0), "bias": -4.0, "step": np.zeros((2, 2)), "score": np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0, 0.0])}
    found = {(r.fold, r.toxic): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    T, C = ([found.get((k, x), 0) for k in (0, 1)] for x in (True, False))
    if not sum(T) or not sum(C):
        return {"keys": np.zeros(0, np.uint64), "gain": np.zeros(0)} | bare
    counts = c.saved(_counts(rows).where("t0 + t1 >= 3"), "toxic-traits")
    limits = (most_traits, least_gain, least_ratio)
    # a fold's model is made of the other fold
    models = [_lexicon(counts, T[1 - k], C[1 - k], F.col(f"t{1 - k}"), F.col(f"c{1 - k}"), *limits) for k in (0, 1)]
    models.append(_lexicon(counts, sum(T), sum(C), F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), *limits))
    marked = rows.mapInArrow(_marked(models), "model long, tried boolean, doc_id long, toxic boolean, packed binary").repartitionById(3, F.col("model").cast("int"))
    got = {r.model: pickle.loads(r.packed) for r in marked.mapInArrow(_fields(models, most_words), "model long, packed binary").collect()}  # three, bounded by the sample
    y, x = np.concatenate([got[k][1] for k in (0, 1) if k in got]), np.concatenate([got[k][2] for k in (0, 1) if k in got])
    w = np.where(y > 0, n_toxic / max(y.sum(), 1), n_clean / max((1 - y).sum(), 1))
    return models[2] | got[2][0] | {"score": _logistic(x, y, w)}


_SPANS = ", spans array<struct<start:long,end:long,p:double>>"


def score(docs: DataFrame, model: dict, spans: bool = True, least: float = 0.5, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from ``threshold`` on) of rows (doc_id, text), one row each; with ``spans`` the byte offsets of the words whose marginal is at least ``least``.

    Null and empty texts have no words and get the score of a text without any trait. Rows that repeat give equal results; an empty
    table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # most_traits entries at most

    def work(batches):
        m = sent.value
        find = Finder(m)
        for b in batches:
            scores, found = [], []
            for lo, hi, d, o, starts, ends, first in _runs(b.column(1)):
                word, which = find(d, starts, ends)
                row = np.searchsorted(first, word, "right") - 1
                n = np.diff(first)
                p = marginals(n, row, word - first[row], m["weight"][which], m["bias"], m["step"])
                scores.append(1 / (1 + np.exp(-np.clip(_summary(n, row, p) @ m["score"], -30, 30))))
                if spans:
                    own = [[] for _ in range(hi - lo)]
                    for r, w, q in zip(row.tolist(), word.tolist(), p.tolist(), strict=True):
                        if q >= least:
                            own[r].append({"start": int(starts[w] - o[r]), "end": int(ends[w] - o[r]), "p": q})
                    found += own
            s = np.concatenate([np.zeros(0), *scores])
            out = [b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            if spans:
                out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "predicted", "spans"][: len(out)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double, predicted int" + (_SPANS if spans else ""))


def held_out(doc_id):
    """Whether a document's label may not be learned from."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2
