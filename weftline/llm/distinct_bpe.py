"""Byte-level BPE through a table of distinct words.

Texts are split into words by the tokenizer's own pattern, chunk by chunk. Each chunk sends its distinct words, once each, to
the bucket of their hash; a bucket encodes every distinct word once, whatever number of chunks has it, and sends the ids back to the chunks
that asked. There they are joined to the words' positions by place, and to decode, to the table of pieces by id. What moves besides the
compressed texts are distinct words per chunk and never a row per position, so the commonest word weighs as much as any other.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common as c

#: Fixed value: the pattern of byte-level BPE, with the white space that Unicode names.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(4)
def _splitter(path: str):
    """(compiled pattern, ids of the special tokens by text)."""
    import regex

    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    odd = [x["content"] for x in tokens if any(x.get(k) for k in ("lstrip", "rstrip", "single_word"))]
    if odd:
        raise ValueError(f"special tokens that take blanks or ask for word ends are not supported: {odd}")
    added = {x["content"]: x["id"] for x in tokens}
    body = PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
    special = "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))
    # a special token ends the piece before it, as if the texts on both sides stood alone
    return regex.compile(body), regex.compile(f"({special})") if added else None, added


def split_words(text: str, path: str) -> list[str]:
    pattern, special, added = _splitter(path)
    if special is None or not any(x in text for x in added):
        return pattern.findall(text)
    out = []
    for part in special.split(text):
        out += [part] if part in added else pattern.findall(part)
    return out


@lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(4)
def pieces(path: str) -> list[bytes]:
    """The bytes of every id, by the byte-level alphabet: printable Latin-1 stands for itself, other bytes for what follows U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    t = _tokenizer(path)
    vocabulary = t.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    special = _splitter(path)[2]
    for piece, i in vocabulary.items():
        out[i] = piece.encode() if piece in special else bytes(of[x] for x in piece)
    return out


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_TEXTS = ", ids array<int>, decoded string"


def _by_bucket(words: list[str], n: int):
    """(bucket, words) by the hash of distinct words, in an order that depends on nothing else."""
    column = pa.array(sorted(words), pa.large_string())
    data, at = c.strings(column)
    h = np.concatenate([np.zeros(0, np.uint64), *(c.hash_spans(data[at[lo] : at[hi]], at[lo:hi] - at[lo], at[lo + 1 : hi + 1] - at[lo]) for lo, hi in c.parts(at))])
    for i, which in c.deal(h, n):
        yield i, column.take(pa.array(which))


def _send(words) -> bytes:
    data, at = c.strings(words)
    sizes = c.pack(np.diff(at))
    return c.squeeze(np.int64(len(sizes)).tobytes() + sizes + data.tobytes())


def _receive(raw: bytes) -> pa.Array:
    raw = c.stretch(raw)
    split = 8 + int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = c.unpack(raw[8:split])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64).tobytes()), pa.py_buffer(raw[split:]))


def encode_decode(docs: DataFrame, tokenizer: str, texts: bool = True, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16 << 20) -> DataFrame:
    """Encode and decode every text with the byte-level BPE in the file ``tokenizer``, which every executor must have.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (decoded text in UTF-8), with ``texts`` also
    ids and decoded, one row per row of ``docs``. Null and empty texts have no ids and decode to nothing; rows that repeat give equal
    results, also without a doc_id; an empty table gives an empty table. A task holds a chunk of about ``chunk_bytes`` of text, or one longer text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = c.chunk_count(docs.sparkSession, c.text_bytes(rows, "text"), chunk_bytes)
    whole = c.chunks(rows, n)

    def ask(key, table):
        words: set[str] = set()
        for text in c.thaw(table.column("packed").to_pylist()).column(1):
            if text.is_valid:
                words.update(split_words(text.as_py(), tokenizer))
        sent = [(i, _send(x)) for i, x in _by_bucket(list(words), n)]
        return pa.table({"bucket": pa.array([i for i, _ in sent], pa.int32()), "chunk": pa.array([int(key[0].as_py())] * len(sent), pa.int32()), "words": pa.array([x for _, x in sent], pa.binary())})

    def encode(key, table):
        asked = [_receive(x) for x in table.column("words").to_pylist()]
        every = pa.chunked_array(asked).dictionary_encode().combine_chunks()
        words = every.dictionary.to_pylist()
        t, special = _tokenizer(tokenizer), _splitter(tokenizer)[2]
        ids, counts = [], np.zeros(len(words), np.int64)
        for lo in range(0, len(words), 20000):
            part = words[lo : lo + 20000]
            for i, (word, e) in enumerate(zip(part, t.encode_batch(part, add_special_tokens=False), strict=True)):
                own = [special[word]] if word in special else e.ids
                ids += own
                counts[lo + i] = len(own)
        ids = np.array(ids, np.int64)
        at = np.concatenate(([0], np.cumsum(counts)))
        which, out, lo = every.indices.to_numpy(), [], 0
        for a in asked:
            own = which[lo : lo + len(a)]
            lo += len(a)
            sizes = c.pack(counts[own])
            out.append(c.squeeze(np.int64(len(sizes)).tobytes() + sizes + c.pack(ids[_spots(at[own], counts[own])])))
        # the words go back by their order in the request, which the chunk makes again
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "answer": pa.array(out, pa.binary())})

    def join(key, left, right):
        if left.num_rows == 0:
            return _rows([], [], [], [], [], [], texts)
        table = c.thaw(left.column("packed").to_pylist())
        index: dict[str, int] = {}
        words, ends = [np.zeros(0, np.int32)], [0]
        for text in table.column(1):
            own = [index.setdefault(w, len(index)) for w in split_words(text.as_py(), tokenizer)] if text.is_valid else []
            words.append(np.array(own, np.int32))
            ends.append(ends[-1] + len(own))
        words, ends, ids_of_docs = np.concatenate(words), np.array(ends), table.column(0).to_pylist()
        del table  # the texts are not needed any more
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist(), strict=True))
        # a table of the chunk's distinct words: how many ids each has, and where they begin
        order, sizes, ids = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, own in _by_bucket(list(index), n):
            raw = c.stretch(answers.pop(i))
            split = 8 + int(np.frombuffer(raw, np.int64, 1)[0])
            order += [index[w] for w in own.to_pylist()]
            sizes.append(c.unpack(raw[8:split])), ids.append(c.unpack(raw[split:]))
        del index
        sizes, ids = np.concatenate(sizes), np.concatenate(ids)
        counts, begins = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        counts[order], begins[order] = sizes, np.cumsum(sizes) - sizes
        n_tokens = np.zeros(len(ends) - 1, np.int64)
        shas, text_shas, all_ids, decoded = [], [], [], []
        names, piece = _id_names(tokenizer), pa.array(pieces(tokenizer), pa.large_binary())
        for lo, hi in c.parts(ends, 1 << 18):  # places at once, or one longer text's
            own = words[ends[lo] : ends[hi]]
            # ids to the positions of their words
            own_ids = ids[_spots(begins[own], counts[own])]
            at = np.concatenate(([0], np.cumsum(counts[own])))[ends[lo : hi + 1] - ends[lo]]
            n_tokens[lo:hi] = np.diff(at)
            offsets, taken = pa.array(at, pa.int64()), pa.array(own_ids)
            joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, names.take(taken)), pa.scalar(",", pa.large_string()))
            shas += [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]
            # pieces to ids
            raw = pc.binary_join(pa.LargeListArray.from_arrays(offsets, piece.take(taken)), pa.scalar(b"", pa.large_binary()))
            back = [x.as_py().decode("utf-8", "replace") for x in raw]
            text_shas += [hashlib.sha256(x.encode()).hexdigest() for x in back]
            if texts:
                all_ids += [own_ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)]
                decoded += back
        return _rows(ids_of_docs, n_tokens, shas, text_shas, all_ids, decoded, texts)

    asked = whole.groupBy("chunk").applyInArrow(ask, "bucket int, chunk int, words binary")
    answers = c.at_buckets(asked, n, encode, "chunk int, bucket int, answer binary")
    return c.with_answers(whole, answers, n, join, _RESULT + (_TEXTS if texts else ""))


@lru_cache(4)
def _id_names(path: str) -> pa.Array:
    return pa.array([str(i) for i in range(len(pieces(path)))], pa.large_string())


def _spots(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[i], begins[i] + 1 and so on, sizes[i] of them, for each i."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _rows(ids, counts, id_shas, text_shas, all_ids, decoded, texts: bool) -> pa.Table:
    out = {"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_shas, pa.string()), "decoded_sha256": pa.array(text_shas, pa.string())}
    if texts:
        out |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
    return pa.table(out)
