"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows of words, by number of words: windows of 10, and shorter whole items. For each
such length m, a shift table gives for each block of two words how far the end of any occurrence is at least; all
documents of a batch, cut into segments, step through it at once. Where the shift is 0, the block's bucket of patterns
with that suffix is looked up, the hash of the whole window selects the patterns to test, and the words themselves are
compared.

Patterns are arrays over one buffer of the benchmark's words, under 16 bytes for each byte of the benchmark's text in
all, so that a block of the benchmark has a bound by its texts' size. A larger benchmark is searched for block by block:
each has a pass of its own over the documents, whose output is stored, and only one block is compiled, broadcast and
held by workers at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored
from ._text import U64, Sequences, appended, bounds, mix, pick, word_hashes

WINDOW = 10
#: Bytes of benchmark texts that are searched for in one pass; a larger benchmark takes more passes.
BLOCK_BYTES = 16 << 20
#: End positions of a segment; more segments step at once where it is smaller.
_SEGMENT = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Words:
    """The words of some texts, as spans of one lower-cased buffer."""

    def __init__(self, texts: list[bytes | None]):
        self.buf = _LOWER[np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)]
        begin = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])]).astype(np.int64)
        self.starts, self.ends = bounds(_INSIDE[self.buf])
        at = np.searchsorted(self.starts, begin)
        self.first, self.last = at[:-1], at[1:]
        self.hashes = word_hashes(self.buf, self.starts, self.ends)
        self.windows = Sequences(self.hashes)
        self._bytes = self.buf.tobytes()

    def text(self, i: int, n: int) -> bytes:
        """Words i .. i + n - 1, joined by one blank."""
        return b" ".join(self._bytes[s:e] for s, e in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist(), strict=True))

    def blocks(self, size: int) -> np.ndarray:
        """For each word, a hash of the size words that end there (of no use for the first size - 1)."""
        if size == 1:
            return self.hashes
        return np.concatenate([self.hashes[:1], mix(self.hashes[:-1] * U64(0x9E3779B97F4A7C15) + self.hashes[1:])])


@dataclass
class Patterns:
    """Shift table and suffix buckets of the patterns of m words.

    shift: by the low bits of a block's hash. suffixes: the different hashes of the patterns' last blocks, in order;
    bucket k has the patterns edge[k] .. edge[k + 1] - 1, in order of whole, the hash of the whole window. low, high:
    where a pattern's words are in text, joined by a blank. items[own[p]:own[p + 1]]: the items that have pattern p.
    """

    m: int
    size: int
    shift: np.ndarray
    suffixes: np.ndarray
    edge: np.ndarray
    whole: np.ndarray
    low: np.ndarray
    high: np.ndarray
    own: np.ndarray
    items: np.ndarray
    text: bytes
    names: list

    @classmethod
    def of(cls, m: int, words: Words, at: np.ndarray, item: np.ndarray, text: bytes, low: np.ndarray, high: np.ndarray, names: list) -> Patterns:
        """at: the first words of all windows, item: whose they are; text, low and high: the words, joined."""
        size = min(2, m)
        blocks = words.blocks(size)
        suffix, whole = blocks[at + m - 1], words.windows.windows(m)[at]
        order = np.lexsort((item, whole, suffix))
        at, item, suffix, whole = at[order], item[order], suffix[order], whole[order]
        # windows of equal words are one pattern; those of equal hashes alone stay apart
        same = np.zeros(len(at), bool)
        same[1:] = (suffix[1:] == suffix[:-1]) & (whole[1:] == whole[:-1])
        start, end, head = low[at], high[at + m - 1], 0
        for k in range(len(at)) if same.any() else ():
            if not same[k]:
                head = k
            elif text[start[k] : end[k]] != text[start[head] : end[head]]:
                same[k] = False
                head = k
        heads = np.flatnonzero(~same)
        n_bits = max(12, min(24, (4 * len(np.unique(blocks[at])) * (m - size + 1 if len(heads) < 1000 else 1)).bit_length()))
        mask = U64((1 << n_bits) - 1)
        shift = np.full(1 << n_bits, m - size + 1, np.uint8)
        for q in range(size - 1, m):
            np.minimum.at(shift, (blocks[at[heads] + q] & mask).astype(np.int64), np.uint8(m - 1 - q))
        suffix = suffix[heads]
        edge = np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1], [True]])).astype(np.int32)
        own = np.concatenate([heads, [len(at)]]).astype(np.int32)
        return cls(m, size, shift, suffix[edge[:-1]], edge, whole[heads], start[heads], end[heads], own, item.astype(np.int32), text, names)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of each occurrence inside one text."""
        m, none = self.m, np.empty(0, np.int64)
        lengths = words.last - words.first
        texts = np.flatnonzero(lengths >= m)
        if not len(texts):
            return none, none
        parts = -(-(lengths[texts] - m + 1) // _SEGMENT)
        low = np.repeat(words.first[texts] + m - 1, parts) + _SEGMENT * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        high = np.minimum(low + _SEGMENT, np.repeat(words.last[texts], parts))
        blocks, stops = words.blocks(self.size), []
        slots = (blocks & U64(len(self.shift) - 1)).astype(np.int64)
        while len(low):
            by = self.shift[slots[low]].astype(np.int64)
            stops.append(low[by == 0])
            low = low + np.maximum(by, 1)
            on = low < high
            low, high = low[on], high[on]
        stop = np.concatenate(stops)
        place = np.minimum(np.searchsorted(self.suffixes, blocks[stop]), len(self.suffixes) - 1)
        hit = self.suffixes[place] == blocks[stop]
        stop, place = stop[hit], place[hit]
        # within each bucket by the whole window's hash
        key = words.windows.windows(m)[stop - m + 1] if len(stop) else np.empty(0, U64)
        lo, hi = self.edge[place].astype(np.int64), self.edge[place + 1].astype(np.int64)
        last = hi.copy()
        while (open_ := lo < hi).any():
            middle = (lo + hi) // 2
            less = open_ & (self.whole[np.minimum(middle, len(self.whole) - 1)] < key)
            lo, hi = np.where(less, middle + 1, lo), np.where(open_ & ~less, middle, hi)
        found: list[tuple[int, int]] = []
        on = lo < last
        on[on] = self.whole[lo[on]] == key[on]
        for end, k, to, own in zip(stop[on].tolist(), lo[on].tolist(), last[on].tolist(), key[on], strict=True):
            text = words.text(end - m + 1, m)
            while k < to and self.whole[k] == own:
                if text == self.text[self.low[k] : self.high[k]]:
                    found.append((end - m + 1, k))
                k += 1
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def met(self, pattern: int) -> list:
        return [self.names[i] for i in self.items[self.own[pattern] : self.own[pattern + 1]].tolist()]


def compile_patterns(items: list[tuple[object, bytes | None]], window: int = WINDOW) -> list[Patterns]:
    """The patterns of (item_id, text) rows; an item of fewer than window words, but not none, is one pattern."""
    words, names = Words([t for _, t in items]), [i for i, _ in items]
    lengths = words.ends - words.starts
    high = np.cumsum(lengths + 1) - 1
    low = high - lengths
    text = words.text(0, len(words.starts))
    count = words.last - words.first
    out = []
    for m in sorted({min(window, n) for n in count.tolist()} - {0}):
        own = np.flatnonzero(np.minimum(count, window) == m)
        windows = count[own] - m + 1
        at = np.repeat(words.first[own], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        out.append(Patterns.of(m, words, at, np.repeat(own, windows), text, low, high, names))
    return out


def find(patterns: list[Patterns], texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray], list[set]]:
    """The number of words of each text, which of them are hit, and the items met."""
    words = Words(texts)
    delta, met = np.zeros(len(words.starts) + 1, np.int32), [set() for _ in texts]
    for own in patterns:
        starts, found = own.search(words)
        np.add.at(delta, starts, 1)
        np.add.at(delta, starts + own.m, -1)
        for text, pattern in zip((np.searchsorted(words.first, starts, "right") - 1).tolist(), found.tolist(), strict=True):
            met[text].update(own.met(pattern))
    hit = np.cumsum(delta[:-1]) > 0
    return words.last - words.first, [hit[s:e] for s, e in zip(words.first.tolist(), words.last.tolist(), strict=True)], met


def _blocks(benchmark: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Rows with a text, their block, and the number of blocks of about half of limit bytes at most."""
    rows = pick(benchmark, item_id="string", text="string").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(64)).alias("n")).first()["n"] or 0
    n = 1 if size <= limit else -(-2 * size // limit)
    return rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with three columns appended: _n_words; _hit, the positions of hit words, ascending; _items, the ids of the
    items whose windows occur, as sorted strings. No column of docs may have these names.

    benchmark (item_id, text) is searched for in blocks of block_bytes at most, one pass over docs for each; only one
    block is on the driver and broadcast at a time, and what a pass but the last gives is stored. A null or empty text has
    no words; an item without words has no window; the windows of an item without an id hit words, but it is in no list.
    Repeated items and documents, and empty tables, are allowed.
    """
    rows, n = _blocks(benchmark, block_bytes)
    if n > 1:
        rows = stored(rows, "benchmark")
    out = docs
    for k in range(n):
        own = rows if n == 1 else rows.where(F.col("block") == k)
        items = [(r["item_id"], r["text"].encode()) for r in own.select("item_id", "text").toLocalIterator()]
        sent = docs.sparkSession.sparkContext.broadcast(compile_patterns(items, window))
        del items
        out = _pass(out, sent, text, first=k == 0)
        if k + 1 < n:
            out = stored(out, "decontamination")
            sent.unpersist()
    return out


def _pass(docs: DataFrame, patterns, text: str, first: bool) -> DataFrame:
    def run(texts: list[bytes | None], batch: pa.RecordBatch) -> list[pa.Array]:
        counts, hits, met = find(patterns.value, texts)
        hits, met = [np.flatnonzero(h) for h in hits], [{str(i) for i in m if i is not None} for m in met]
        if not first:  # what earlier blocks found
            hits = [np.union1d(h, old) for h, old in zip(hits, batch.column(batch.num_columns - 2).to_pylist(), strict=True)]
            met = [m | set(old) for m, old in zip(met, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
        return [pa.array(counts, pa.int64()), pa.array([h.astype(np.int32) for h in hits], pa.list_(pa.int32())), pa.array([sorted(m) for m in met], pa.list_(pa.string()))]

    out = appended(docs, text, run, {"_n_words": "long", "_hit": "array<int>", "_items": "array<string>"})
    if first:
        return out
    n, names = len(docs.columns) - 3, docs.columns
    return out.toDF(*[f"_{i}" for i in range(n + 6)]).select(*[f"_{i}" for i in (*range(n), n + 3, n + 4, n + 5)]).toDF(*names)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs (doc_id, text)."""
    found = search(pick(docs, doc_id="long", text="string"), benchmark, **options)
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.size("_hit").cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any occurrence, with their own columns."""
    names, n = docs.columns, len(docs.columns)
    found = search(docs.toDF(*[f"c{i}" for i in range(n)]), benchmark, text=f"c{names.index(text)}", **options)
    return found.where(F.size("_hit") == 0).select(*[f"c{i}" for i in range(n)]).toDF(*names)
