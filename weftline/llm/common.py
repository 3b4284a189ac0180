"""What the text operators share: words found and hashed on whole Arrow batches,
packed rows dealt out between chunks and buckets, joins with hot keys, and tables in the shared folder.

A *chunk* is a fixed set of rows of a bounded size in bytes, a *bucket* a fixed range of 64-bit keys, and there are as many of
one as of the other. Operators that compare rows send each distinct key of a chunk once to its bucket, whatever number of
the chunk's rows has it, and get an answer for it: a key that a third of all rows share is one entry per chunk. A message holds its keys
and a small number for each, and nothing of the chunk's other rows, so what moves depends on the distinct keys alone.
"""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# --------------------------------------------------------------- words

#: The bytes between words, 0x20 and 0x09 to 0x0D.
_BLANKS = [0x20, *range(0x09, 0x0E)]
SPLIT_BLANK = np.ones(256, bool)
SPLIT_BLANK[_BLANKS] = False
#: Words of digits, a to z and bytes from 0x80.
SPLIT_ALNUM = np.zeros(256, bool)
SPLIT_ALNUM[0x30:0x3A] = SPLIT_ALNUM[0x61:0x7B] = SPLIT_ALNUM[0x80:] = True
#: A to Z to a to z, other bytes unchanged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

STEP = 1 << 20  # bytes handled at once; a longer text is handled alone
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x.astype(_U)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _INV)):
            p = np.full(n, base, _U)
            p[0] = 1
            _POWERS[key] = np.cumprod(p)
    up, down = _POWERS["up"], _POWERS["down"]
    if len(up) > 2 * STEP:  # made for one very long text
        _POWERS.clear()
    return up, down


def constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) | _U(1)


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes (UTF-8) of a column of strings or binaries and where each row begins; null is empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())  # first, as all together may be more than 2 GiB
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if binary else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def parts(at: np.ndarray, step: int = STEP):
    """Runs of rows [lo, hi) of about ``step`` bytes."""
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + step, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def find_words(data: np.ndarray, at: np.ndarray, table: np.ndarray = SPLIT_BLANK):
    """starts, ends (bytes) of the words, and each row's first word (one entry more)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if len(data) == 0:
        return np.zeros(len(starts), _U)
    up, down = _powers(max(len(data) + 1, STEP + 1))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def windows(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of each run of k word hashes; the last k-1 entries do not exist."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j, c in enumerate(constants(k, seed)):
        out += h[j : j + n] * c
    return mix(out)


def inside_rows(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows over all words lie within one row."""
    total = int(first[-1])
    ok = np.ones(max(0, total - k + 1), bool)
    for j in range(1, k):  # a window may not span a row's end
        bad = first[1:-1] - j
        bad = bad[(bad >= 0) & (bad < len(ok))]
        ok[bad] = False
    return ok


def cover(n: int, starts: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in [start, start + k) for some start."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + k, n), -1)
    return np.cumsum(d[:-1]) > 0


# ------------------------------------------------------------- packing


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, most of them small and not below 0: one, two or four bytes each, whichever is least, and others apart."""
    x = x.astype(np.int64).view(np.uint64)
    width = min((1, 2, 4), key=lambda w: w * len(x) + 8 * int((x >= (1 << 8 * w) - 1).sum()))
    top = (1 << 8 * width) - 1
    big = x >= top
    return np.uint32(len(x)).tobytes() + bytes([width]) + np.where(big, _U(top), x).astype(f"<u{width}").tobytes() + x[big].tobytes()


def unpack(b: bytes) -> np.ndarray:
    n, width = int(np.frombuffer(b, np.uint32, 1)[0]), b[4]
    x = np.frombuffer(b, f"<u{width}", n, 5).astype(np.int64)
    x[x == (1 << 8 * width) - 1] = np.frombuffer(b, np.int64, -1, 5 + n * width)
    return x


def pack_ascending(x: np.ndarray) -> bytes:
    """Ascending whole numbers from 0 by their gaps."""
    return pack(np.diff(x.astype(np.int64), prepend=0))


def unpack_ascending(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b))


def squeeze(b: bytes) -> bytes:
    return np.int64(len(b)).tobytes() + pa.Codec("zstd").compress(b, asbytes=True)


def stretch(b: bytes) -> bytes:
    return pa.Codec("zstd").decompress(b[8:], decompressed_size=int(np.frombuffer(b, np.int64, 1)[0]), asbytes=True)


def distinct(key: np.ndarray):
    """(order, where each distinct key begins in it, the distinct keys, ascending)."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return order, head, s[head]


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """The range of each 64-bit key, of n equal ones: larger keys have no smaller bucket."""
    return (((key >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def bucket_cuts(key: np.ndarray, n: int):
    """(bucket, lo, hi) of ascending keys, for every bucket that has some."""
    b = bucket_of(key, n)
    cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))) if len(b) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(b[lo]), lo, hi


def deal(key: np.ndarray, n: int):
    """(bucket, which) for every bucket that gets some of the keys; which is ascending."""
    b = bucket_of(key, n)
    order = np.argsort(b, kind="stable")
    for i, lo, hi in bucket_cuts(key[order], n):
        yield i, order[lo:hi]


def ask(chunk: int, key: np.ndarray, value: np.ndarray, n: int, drop: int = 0) -> pa.Table:
    """(bucket, chunk, keys, values): the ascending distinct keys of a chunk with a small number each; the ``drop`` lowest bits of keys do not travel."""
    rows, keys, values = [], [], []
    for i, lo, hi in bucket_cuts(key, n):
        own = key[lo:hi] >> _U(drop)
        rows.append(i)
        keys.append(pack_ascending((own - own[:1]).astype(np.int64)) + own[:1].tobytes() if drop else own.tobytes())
        values.append(pack(value[lo:hi]))
    return pa.table({"bucket": pa.array(rows, pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "keys": pa.array(keys, pa.binary()), "values": pa.array(values, pa.binary())})


ASKED = "bucket int, chunk int, keys binary, values binary"


def asked(table: pa.Table, drop: int = 0):
    """All that was sent to a bucket: (chunks, sizes, keys, values), chunk after chunk."""
    chunks_, keys, values, sizes = table.column("chunk").to_pylist(), [np.zeros(0, _U)], [np.zeros(0, np.int64)], []
    for a, b in zip(table.column("keys").to_pylist(), table.column("values").to_pylist(), strict=True):
        keys.append(unpack_ascending(a[:-8]).astype(_U) + np.frombuffer(a[-8:], _U) if drop else np.frombuffer(a, _U))
        values.append(unpack(b))
        sizes.append(len(keys[-1]))
    return chunks_, sizes, np.concatenate(keys), np.concatenate(values)


def by_key(key: np.ndarray, value: np.ndarray, reduce: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """For every entry: the reduced value of its key, and in how many entries the key is."""
    if not len(key):
        return value, value
    order, head, _ = distinct(key)
    times = np.diff(np.append(head, len(key)))
    total, count = np.empty(len(key), value.dtype), np.empty(len(key), np.int64)
    total[order] = np.repeat(reduce.reduceat(value[order], head), times)
    count[order] = np.repeat(times, times)
    return total, count


def typed(df, names) -> str:
    """The columns ``names`` of df as the end of a schema string."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return "".join(f", `{x}` {kinds[x]}" for x in names)


# -------------------------------------------------------------- chunks


def partitions(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunk_count(spark, n_bytes: int, chunk_bytes: int) -> int:
    """So many chunks that none is much above ``chunk_bytes``; small data is dealt to all partitions as long as that leaves a MB each."""
    return max(1, -(-n_bytes // chunk_bytes), min(partitions(spark), -(-n_bytes >> 20)))


def text_bytes(df, column: str) -> int:
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(column) + 64)).first()[0] or 0)


def chunks(docs, n: int):
    """(chunk, packed): the rows (id, text, ...) of each batch by chunk as compressed Arrow streams, each chunk in a partition of its own.

    The id and the text's length decide, so copies of one text or of one id spread, and a lost task gives the same chunks again.
    """
    from pyspark.sql import functions as F

    def split(batches):
        for b in batches:
            ids = b.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            sizes = pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(_U)
            rows, blobs = [], []
            for i, which in deal(mix(ids ^ mix(sizes)), n):
                rows.append(i)
                blobs.append(freeze(pa.Table.from_batches([b.take(pa.array(which))])))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "packed"])

    return docs.mapInArrow(split, "chunk int, packed binary").repartitionById(n, F.col("chunk"))


#: Above so many chunks messages go by way of relays.
DIRECT = 512


def _relayed(messages, n: int, to: str, by: str):
    """(to, packed): messages at their receivers by way of relays.

    Chunks and buckets are taken in groups of about the root of n. A sender packs what goes to a group of receivers into one message, and the relay of
    a group of senders and a group of receivers packs what goes to one receiver into one: 2 * n * sqrt(n) messages and shuffle blocks instead
    of n * n, for twice the bytes. A relay holds as much as a bucket.
    """
    from pyspark.sql import functions as F

    side = math.isqrt(n - 1) + 1

    def by_groups(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if tables:  # all that one chunk or bucket sends
            rows = pa.concat_tables(tables)
            yield from _packed(rows, rows.column(by).to_numpy() // side * side + rows.column(to).to_numpy() // side, "relay")

    def on(batches):
        tables = [unpacked(b.column(1)) for b in batches if b.num_rows]
        if tables:
            rows = pa.concat_tables(tables)
            yield from _packed(rows, rows.column(to).to_numpy(), to)

    grouped = messages.mapInArrow(by_groups, "relay int, packed binary").repartitionById(side * side, F.col("relay"))
    return grouped.mapInArrow(on, f"{to} int, packed binary")


def _packed(rows: pa.Table, key: np.ndarray, name: str):
    """(key, the rows that have it as one Arrow stream), a batch for each."""
    order = np.argsort(key, kind="stable")
    rows, key = rows.take(pa.array(order)), key[order]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 1], pa.int32()), pa.array([freeze(rows.slice(lo, hi - lo))], pa.binary())], [name, "packed"])


def unpacked(blobs) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in blobs.to_pylist()])


def _received(messages, n: int, to: str, by: str):
    """(messages grouped by receiver, each in a partition of its own; a function that gives the rows of such a group)."""
    from pyspark.sql import functions as F

    if n <= DIRECT:
        return messages.repartitionById(n, F.col(to)).groupBy(to), lambda table: table
    names = messages.columns
    none = pa.schema([(x, pa.binary()) for x in names]).empty_table()
    return _relayed(messages, n, to, by).repartitionById(n, F.col(to)).groupBy(to), lambda table: unpacked(table.column("packed")).select(names) if table.num_rows else none


def at_buckets(messages, n: int, work, schema: str):
    """work(key, messages) at every bucket that got some."""
    grouped, rows = _received(messages, n, "bucket", "chunk")
    return grouped.applyInArrow(lambda key, table: work(key, rows(table)), schema)


def with_answers(whole, answers, n: int, work, schema: str):
    """work(key, rows, answers) with the rows of each chunk and the answers to it."""
    grouped, rows = _received(answers, n, "chunk", "bucket")
    return whole.groupBy("chunk").cogroup(grouped).applyInArrow(lambda key, left, right: work(key, left, rows(right)), schema)


def freeze(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def thaw(blobs) -> pa.Table:
    """The rows of a chunk, by doc_id and text: the same order whenever it is read."""
    table = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in blobs])
    # a chunk may hold more than 2 GiB of text
    table = table.cast(pa.schema([f.with_type(pa.large_string()) if f.type == pa.string() else f.with_type(pa.large_binary()) if f.type == pa.binary() else f for f in table.schema])).combine_chunks()
    return table.sort_by([(table.column_names[0], "ascending"), (table.column_names[1], "ascending")])


def plain(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """A column of ``thaw`` with the type that it had before, in pieces of less than 2 GiB."""
    kind = {pa.large_string(): pa.string(), pa.large_binary(): pa.binary()}.get(column.type)
    if kind is None:
        return column
    step = max(1, len(column) * (1 << 29) // max(column.nbytes, 1))
    return pa.chunked_array([x.slice(lo, step).cast(kind) for x in column.chunks for lo in range(0, len(x), step)], kind)


# ------------------------------------------------------- shared tables


def shared(spark) -> str:
    """The folder that all executors see. Where none is set, a local master gets one of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_PLACES: dict[str, list[str]] = {}


def place(spark, name: str) -> str:
    """A new path in the shared folder, which ``clear`` removes."""
    path = f"{shared(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    _PLACES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def saved(df, name: str):
    """The rows of df as a Parquet table in the shared folder: later reads do not depend on any executor."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(counts, keys: list[str], total: int) -> tuple[list, str]:
    """(rows, schema) of the keys with more than a thousandth of ``total`` rows, fewer than a thousand, and into how many pieces each is to be cut."""
    from pyspark.sql import functions as F

    n = partitions(counts.sparkSession)
    few = counts.where(F.col("n") * 1000 > total).select(*keys, F.ceil(F.col("n") * n / max(total, 1)).cast("int").alias("_pieces")).where("_pieces > 1")
    return few.collect(), few.schema


def skew_join(left, right, keys: list[str], counts, total: int, spread: list[str], how: str = "inner", found: tuple | None = None):
    """left joined to right on ``keys`` where some keys have a large share of left's rows.

    ``counts`` has the keys and ``n``, how many of left's ``total`` rows each has. Keys with more than a thousandth of them, of which there are less
    than a thousand, are looked up first; without such keys this is a plain join. Their rows are dealt by the columns ``spread`` to as many pieces as
    their share of the partitions, and right's rows of these keys are repeated once per piece: all pieces together are no more than partitions and hot keys.
    ``found`` is what ``hot_keys`` gave, if that is known already.
    """
    from pyspark.sql import functions as F

    rows, schema = found or hot_keys(counts, keys, total)
    if not rows:
        return left.join(right, keys, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, schema))
    one, two = left.join(hot, keys, "left"), right.join(hot, keys, "left")
    one = one.withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_pieces")).cast("int"), F.lit(0))).drop("_pieces")
    two = two.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1))).drop("_pieces")
    return one.join(two, [*keys, "_piece"], how).drop("_piece")


def likely(rows, wanted, keys: list[str], most_words: int = 1 << 19):
    """All of rows whose keys are in ``wanted``, and few others, so that a join with wanted need not exchange what it will not keep.

    Every key of wanted sets one of some 16 bits for each, by its hash; the bits go to all tasks in words of 64, ``most_words`` at most, which is some 25 MB.
    With more than two million keys there are less than 16 bits for each and more of the other rows pass.
    """
    from pyspark.sql import functions as F

    words = min(most_words, 1 << (wanted.count() // 4).bit_length())
    place = F.xxhash64(*keys)
    bit = F.pmod(place, F.lit(64)).cast("int")
    word = F.pmod(F.shiftright(place, 6), F.lit(words)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = F.broadcast(wanted.select(word.alias("_word"), one.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    return rows.withColumn("_word", word).join(bits, "_word").where(F.col("_bits").bitwiseAND(one) != 0).select(*rows.columns)


def clear(spark) -> None:
    """Remove all intermediate tables that this session's operators have written; results that still read from them are lost."""
    for path in _PLACES.pop(spark.sparkContext.applicationId, []):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def saved_and_counted(df, name: str, condition=None):
    """(``saved`` rows, how many there are or meet a condition), counted as they are written; lost executors may make it more, never less."""
    from pyspark.sql import Observation, functions as F

    seen = Observation(uuid.uuid4().hex)
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("n") if condition is None else F.count_if(condition).alias("n")), name)
    return out, seen.get["n"]


def forget(df) -> None:
    """Remove the files of tables that ``saved`` made."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/weftline-" in f:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
