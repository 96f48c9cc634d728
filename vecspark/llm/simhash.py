"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

Fingerprints of 64 bits are 8 positional bytes. Two that differ in at most 3 bits share at least 5 of them: the
guaranteed minimum of matches. A list for each single byte would hold a 256th of all fingerprints, so that tallies would
grow with their square. Lists are kept for triples of positions instead: any 5 of 8 positions hold one of 8 stated
triples, so that each linked pair meets in a list of 3 bytes. Pairs that meet tally the positional bytes that they
share; those with 5 or more are verified by their bits.

Lists longer than LIST are split: their fingerprints meet again in lists of those 3 bytes and any 2 of the other 5
positions. Such a list leaves 3 bytes open, so it holds 2^24 different fingerprints at most whatever the corpus; a long
one is probed in a bitmap with all 2,324 differences of 1 to 3 bits instead of by pairs.

Lists hold different fingerprints once, each with its least doc_id, and a task gives links that span what it finds, not
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored
from ._text import as_bytes, pick, pieces
from .components import components

SHINGLE, BITS, MATCHES = 3, 3, 5
#: Any 5 of the 8 positions hold one of these: 8 is the Turan number T(8, 5, 3). Each half's 4 triples settle 3 or more
#: positions in it.
TRIPLES = tuple(combinations(range(4), 3)) + tuple(combinations(range(4, 8), 3))
#: Fingerprints of a list that is searched by pairs.
LIST = 512
#: List entries of a task, about.
TASK = 25_000
_BLOCK = 1 << 16
SEED = 42
#: Rows of a fingerprint from which on they aren't shuffled: of N rows N / HOT_ROWS fingerprints at most have so many.
HOT_ROWS = 100_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is in over half of the XXH64 of the text's shingles, repeats included. A-Z are lower-cased;
    words are [^\\x20\\x09-\\x0D]+; fewer words than a shingle are one; without words it is 0."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n, digest = b" ".join(words), max(1, len(words) - shingle + 1), xxhash.xxh64_digest
    ends = np.concatenate([np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20), [len(joined)]])
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    ends, counts = ends[-n:], np.zeros(64, np.int64)
    for k in range(0, n, _BLOCK):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + _BLOCK].tolist(), ends[k : k + _BLOCK].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp long")


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs share enough positional bytes, and then differ in bits at most."""
    other = a ^ b
    shared = (other.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    out = shared >= 8 - bits
    out[out] = np.bitwise_count(other[out]) <= bits
    return out


class _Forest:
    """Least reachable index of each of n, as links come in blocks."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> bool:
        changed = False
        while len(a):
            ra, rb = self.least[a], self.least[b]
            on = ra != rb
            if not on.any():
                break
            a, b, ra, rb = a[on], b[on], ra[on], rb[on]
            np.minimum.at(self.least, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := self.least[self.least]).tobytes() != self.least.tobytes():
                self.least = up
            changed = True
        return changed


def linked(keys: np.ndarray, fps: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each entry of some lists the least index that links reach within them. keys tell the list; entries are in
    order of keys, fingerprints differ within a list."""
    n = len(fps)
    forest = _Forest(n)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edge)
    left = np.repeat(edge[1:], sizes)
    short = np.repeat(sizes <= 4 * LIST, sizes)
    active, by = np.flatnonzero(short), 1
    while len(active := active[active + by < left[active]]):
        ok = _near(fps[active], fps[active + by], bits)
        forest.link(active[ok], active[ok] + by)
        by += 1
    for lo, hi in zip(edge[:-1][sizes > 4 * LIST].tolist(), edge[1:][sizes > 4 * LIST].tolist(), strict=True):
        _probe(forest, fps[lo:hi], lo, bits)
    return forest.least


def _probe(forest: _Forest, fps: np.ndarray, lo: int, bits: int) -> None:
    """Links a long list, whose fingerprints differ in 3 bytes at most, by looking up all differences."""
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    places = [8 * k for k in range(8) if differ >> (8 * k) & 0xFF]
    if len(places) > 3:
        raise AssertionError("a long list leaves more than 3 bytes open")
    low = np.zeros(len(fps), np.int64)
    for k, place in enumerate(places):
        low |= ((fps >> np.uint64(place)) & np.uint64(0xFF)).astype(np.int64) << (8 * k)
    width = 8 * len(places)
    index = np.full(1 << width, -1, np.int32)
    index[low] = np.arange(len(fps), dtype=np.int32)
    for count in range(1, bits + 1):
        for chosen in combinations(range(width), count):
            other = index[low ^ sum(1 << c for c in chosen)]
            on = np.flatnonzero(other > np.arange(len(fps)))
            if len(on):
                forest.link(lo + on, lo + other[on].astype(np.int64))


def _link_task(bits: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("fp", "ascending")])
        keys, fps, nodes = table["key"].to_numpy(), table["fp"].to_numpy().view(np.uint64), table["node"].to_numpy()
        least = linked(keys, fps, bits)
        on = np.flatnonzero(least != np.arange(len(least)))
        return pa.table({"a": nodes[on], "b": nodes[least[on]]})

    return run


def _byte(k: int):
    return F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(0xFF))


def _key(tag: int, positions: tuple[int, ...]):
    out = F.lit(tag).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(p))
    return out


def _link(lists: DataFrame, rows: int, bits: int) -> DataFrame:
    tasks = max(1, -(-rows // TASK))
    return lists.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks))).groupBy("task").applyInArrow(_link_task(bits), "a long, b long")


def links(groups: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) of nodes that span what fingerprints within bits (3 at most) link; groups: node and fp, both unique."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"bits must be from 0 to {BITS}")
    n = groups.count()
    entries = groups.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _key(t, p).alias("key")) for t, p in enumerate(TRIPLES)])).alias("e")).select("node", "fp", "e.t", "e.key")
    long_ = stored(entries.groupBy("key").count().where(F.col("count") > LIST).select("key"), "long-lists")
    if long_.isEmpty():
        return _link(entries.drop("t"), len(TRIPLES) * n, bits)
    short = _link(entries.join(long_, "key", "left_anti").drop("t"), len(TRIPLES) * n, bits)
    again = entries.join(long_, "key", "left_semi")
    deeper = F.array(*[F.when(F.col("t") == t, F.array(*[_key(100 + 10 * t + k, p + two) for k, two in enumerate(combinations([x for x in range(8) if x not in p], 2))])) for t, p in enumerate(TRIPLES)])
    again = again.select("node", "fp", F.explode(F.flatten(F.filter(deeper, lambda x: x.isNotNull()))).alias("key"))
    return short.unionAll(_link(again, 10 * len(TRIPLES) * n, bits))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable, of each row of docs (doc_id, text). Documents are
    linked where their fingerprints differ in bits at most: all such pairs.

    A null text is an empty one. Rows that share a doc_id are one node each by their text; a null doc_id is no one's
    smallest, and gets null unless it reaches another.
    """
    own = stored(fingerprints(docs, shingle), "fingerprints")
    groups = own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    groups = stored(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    found = components(links(groups.select("node", "fp"), bits))
    joined = groups.join(found, "node", "left").select("fp", "least", "rows", F.coalesce("component", "node").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    known = joined.join(smallest, "root").select("fp", "component_id", "rows")
    # rows of a fingerprint that very many documents share stay where they are; there are few such fingerprints
    hot, cold = known.where(F.col("rows") > HOT_ROWS).drop("rows"), known.where(F.col("rows") <= HOT_ROWS).drop("rows")
    if groups.where(F.col("rows") > HOT_ROWS).isEmpty():
        out = own.join(cold, "fp")
    else:
        hot = F.broadcast(hot)
        out = own.join(hot, "fp").unionByName(own.join(hot, "fp", "left_anti").join(cold, "fp"))
    return out.select("doc_id", "fp", "component_id")
