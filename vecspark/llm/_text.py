"""Batches of texts, and hashes of their words, in numpy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._tokenize import forget

with contextlib.suppress(AttributeError, OSError):
    # a reused worker gives large arrays back to the system: they are mapped one by one, and 16 MB
    # of what is free is kept (M_MMAP_THRESHOLD, M_TRIM_THRESHOLD)
    ctypes.CDLL(None).mallopt(-3, 8 << 20)
    ctypes.CDLL(None).mallopt(-1, 16 << 20)

U64 = np.uint64
#: The bytes that part words where an operator's words are [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes that are worked on at once; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
_BLOCK = 1 << 17
_TABLE = np.random.default_rng(20_240_501).integers(1, 2**63, (2, 256), dtype=np.uint64) * U64(2) + U64(1)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEP = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text at most, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word buf[start:end]; which: one of two independent hashes."""
    out, table, base = np.empty(len(starts), U64), _TABLE[which], _BASE[which]
    back, i = inverse(base), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(table[buf[lo:hi]] * powers(base, hi - lo), out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * powers(back, hi - lo)[s] + (ends[i:j] - starts[i:j]).astype(U64) * U64(_STEP[which])
        i = j
    return mix(out)


class Sequences:
    """Hashes of any run of consecutive words, from the hashes of the words."""

    def __init__(self, words: np.ndarray, which: int = 0):
        self.step, self.back, self.n = _STEP[which], inverse(_STEP[which]), len(words)
        self.total = np.zeros(self.n + 1, U64)
        np.cumsum(words * powers(self.step, max(self.n, 1))[: self.n], out=self.total[1:])

    def windows(self, size: int) -> np.ndarray:
        """Of the windows of size words that start at words 0 .. n - size."""
        if self.n < size:
            return np.empty(0, U64)
        return mix((self.total[size:] - self.total[: self.n - size + 1]) * powers(self.back, self.n)[: self.n - size + 1] + U64(size))

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the words start .. end - 1 each."""
        return mix((self.total[ends] - self.total[starts]) * powers(self.back, self.n + 1)[starts] + (ends - starts).astype(U64))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each size consecutive values."""
    have, out = 1, x
    while have * 2 <= size:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(x) - size + 1], out[size - have : size - have + len(x) - size + 1]) if have < size else out


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words the windows of size words from these distinct starts cover."""
    delta = np.zeros(n + 1, np.int32)
    delta[starts] += 1
    delta[starts + size] -= 1
    return np.cumsum(delta[:-1]) > 0


def pick(docs, **kinds: str):
    """The named columns, cast; found by their exact names, whatever other columns there are."""
    from pyspark.sql import functions as F

    names = docs.columns
    for name in kinds:
        if name not in names:
            raise ValueError(f"no column {name} in {names}")
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    return inner.select(*[F.col(f"_c{names.index(name)}").cast(kind).alias(name) for name, kind in kinds.items()])


#: Keys that are chosen, at most; more are so many for each partition that they need no choice.
EVEN_KEYS = 1 << 17


def even_keys(spark, n: int) -> np.ndarray:
    """n keys, or up to the next multiple of the shuffle's partitions if there are more of them, that a shuffle by key
    deals evenly: equally many come to each partition. Of keys 0 .. n - 1 some partitions would get several times the
    mean."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n > parts:
        n = -(-n // parts) * parts
    if n > EVEN_KEYS or parts > EVEN_KEYS:
        return np.arange(n)
    wanted, size = -(-n // parts), 2 * n + 64 * parts
    while True:
        keys = np.arange(size)
        part = spark_hash(keys).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        count = np.bincount(part, minlength=parts)
        if count.min() >= wanted:
            place = np.concatenate([[0], np.cumsum(count)[:-1]])
            index = np.arange(n)
            return keys[order][place[index % parts] + index // parts]
        size *= 2


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash() of a long each, by which it partitions: Murmur3 (32 bits) of two words, seed 42."""
    c1, c2, five, plus = (np.uint32(v) for v in (0xCC9E2D51, 0x1B873593, 5, 0xE6546B64))
    turn = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    words, h = np.asarray(x, np.int64).view(np.uint64), np.full(len(x), 42, np.uint32)
    for k in ((words & U64(0xFFFFFFFF)).astype(np.uint32), (words >> U64(32)).astype(np.uint32)):
        h = turn(h ^ (turn(k * c1, 15) * c2), 13) * five + plus
    h ^= np.uint32(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return h.view(np.int32)


def key_of(index, keys: np.ndarray):
    """The key at a column's place in keys."""
    from pyspark.sql import functions as F

    if (keys == np.arange(len(keys))).all():
        return index.cast("long")
    return F.element_at(F.split(F.lit(",".join(map(str, keys.tolist()))), ",").cast("array<bigint>"), (index + 1).cast("int"))


def appended(docs, text: str, run, fields: dict[str, str]):
    """docs with columns appended by run(texts, own columns of the batch) -> arrays in the order of fields.

    Columns of docs are passed on by position, so that their names may be anything; the new ones stand last.
    """
    from pyspark.sql import types as T

    names, at = docs.columns, docs.columns.index(text)
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    new = T.StructType.fromDDL(", ".join(f"_n{i} {kind}" for i, kind in enumerate(fields.values())))
    schema = T.StructType([*inner.schema.fields, *new.fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches, f"_c{at}"):
            yield pa.RecordBatch.from_arrays([*batch.columns, *run(as_bytes(batch.column(at)), batch)], names=[f.name for f in schema])

    return inner.mapInArrow(each, schema).toDF(*names, *fields)
