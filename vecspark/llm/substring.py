"""Exact substring dedup by super-k-mer partitioning.

Documents are dealt to chunks by a hash of doc_id and text. In a chunk every window of 50 words gets a minimiser, the
least hash of the runs of 8 words in it, where runs that a sample shows to be in very many documents come after all
others: a window that a common passage fills in part goes by what else is in it, so that the bucket of a run of the
passage gets the windows inside the passage alone, which are few different ones. Consecutive windows that share it travel as one packed string, a super-k-mer, to the
minimiser's bucket. Equal windows have equal minimisers, so that they meet in one bucket, where sorting counts them; the
words of those that meet are compared. A chunk sends each different super-k-mer once, with its smallest doc_id, so that
a passage that many documents share reaches its bucket once for each chunk. The bucket answers each chunk with the
smallest doc_id of the windows that occur elsewhere; the chunk, whose documents are read once more from the same
exchange, removes the words of windows that start in a document with a smaller doc_id.

The sample decides which bucket a window goes to, and nothing else: equal windows have the same runs.

Packed strings travel in one compressed row for each pair of chunk and bucket. The numbers of chunks and buckets follow
the size of the texts. Of more than GROUP chunks, strings travel in two steps, so that neither a passage in every chunk
nor the number of rows outgrows a task: a bucket is as many times wider as there are groups of chunks, and its strings
from one group meet first, each once, with its smallest doc_id; those of all groups meet in the bucket's parts, and the
answers go back the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import SPACE, U64, Sequences, as_bytes, bounds, covered, even_keys, key_of, pick, pieces, sliding_min, word_hashes

WINDOW, RUN = 50, 8
#: Bytes of text of a chunk, and of packed strings of a bucket, about.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 12 << 20
#: Bytes of packed strings for each byte of text, about; it only sets the number of buckets.
GROWTH = 3
#: Chunks of a group, about.
GROUP = 4096
#: The sample that shows which runs are common: one of SHARE documents, and of a larger corpus about SAMPLE_BYTES of
#: text. A run is common from LEAST documents on whose strings would be a quarter of a bucket; MOST are kept.
SHARE, SAMPLE_BYTES, LEAST, MOST = 32, 4 << 30, 3, 1_000_000
_NONE = np.iinfo(np.int64).max


class Common:
    """Hashes of common runs."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.mask = U64((1 << max(10, (8 * len(hashes)).bit_length())) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[(self.hashes & self.mask).astype(np.int64)] = True

    def last(self, hashes: np.ndarray) -> np.ndarray:
        """The same, so changed that common ones are larger than all others."""
        out = hashes >> U64(1)
        on = np.flatnonzero(self.maybe[(hashes & self.mask).astype(np.int64)])
        if len(on):
            place = np.minimum(np.searchsorted(self.hashes, hashes[on]), len(self.hashes) - 1)
            on = on[self.hashes[place] == hashes[on]]
            out[on] |= U64(1 << 63)
        return out


def _squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _message(docs, strings: list[bytes], level: int = 1) -> bytes:
    return _squeeze(len(docs).to_bytes(8, "little") + np.array(docs, "<i8").tobytes() + b"\n".join(strings), level)


def _read(message: bytes) -> tuple[np.ndarray, bytes]:
    """doc_ids and strings of a message."""
    raw = _open(message)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, "<i8", n, 8), raw[8 + 8 * n :]


class _Chunk:
    """Words of a chunk's documents, in order of doc_id and text, as spans of one buffer of words joined by a blank."""

    def __init__(self, table: pa.Table, window: int, run: int, buckets: np.ndarray, common: Common, parts: int = 1):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_ids = table["doc_id"].to_pylist()
        self.texts = [b" ".join(t.split()) if t else b"" for t in as_bytes(table["text"].combine_chunks())]
        self.data = b"\n".join(self.texts)
        buf = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends = bounds(~SPACE[buf])
        at = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.texts])]).astype(np.int64))
        self.first, self.last = at[:-1], at[1:]
        self.owner = np.repeat(np.arange(len(self.texts)), self.last - self.first)
        self.window, self.common = window, common
        self._super_kmers(word_hashes(buf, self.starts, self.ends), run, buckets, parts)

    def _super_kmers(self, hashes: np.ndarray, run: int, buckets: np.ndarray, parts: int) -> None:
        """First window, number of windows, bucket, entry and lead of each; entry: of its bucket's different strings;
        lead: the smallest doc_id here that has the string."""
        n, window = len(self.starts), self.window
        self.at = self.count = self.bucket = self.entry = self.lead = np.empty(0, np.int64)
        self.sent: dict[int, list[tuple[bytes, int]]] = {}
        self.part: dict[int, list[int]] = {}  # of each string sent
        known = np.array([d is not None for d in self.doc_ids], bool)
        if n < window:
            return
        least = sliding_min(self.common.last(Sequences(hashes).windows(run)), window - run + 1)
        inside = (self.owner[: n - window + 1] == self.owner[window - 1 :]) & known[self.owner[: n - window + 1]]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | ~inside[:-1]])  # between documents no window is inside
        heads = np.flatnonzero(new & inside)
        stops = np.flatnonzero(np.concatenate([new[1:] | ~inside[1:], [True]]) & inside)
        self.at, self.count = heads, stops - heads + 1
        place = (least[heads] % U64(len(buckets) * parts)).astype(np.int64)
        self.bucket, part = buckets[place % len(buckets)], place // len(buckets)
        entry, lead = np.empty(len(heads), np.int64), np.empty(len(heads), np.int64)
        seen: dict[int, dict[bytes, int]] = {}
        low, high = self.starts[heads].tolist(), self.ends[stops + window - 1].tolist()
        for k, (b, c, s, e, d) in enumerate(zip(self.bucket.tolist(), part.tolist(), low, high, self.owner[heads].tolist(), strict=True)):
            text, own = self.data[s:e], seen.setdefault(b, {})
            if (i := own.get(text)) is None:
                i = own[text] = len(own)
                self.sent.setdefault(b, []).append((text, self.doc_ids[d]))  # the smallest comes first
                self.part.setdefault(b, []).append(c)
            entry[k], lead[k] = i, self.sent[b][i][1]
        self.entry, self.lead = entry, lead

    def message(self, bucket: int) -> bytes:
        strings, docs = zip(*self.sent[bucket], strict=True)
        return _message(docs, strings, level=5)

    def removed(self, answers: dict[int, np.ndarray]) -> np.ndarray:
        """Which words go; answers: rows (entry, window, smallest doc_id) of each bucket."""
        own = np.array([_NONE if d is None else d for d in self.doc_ids], np.int64)
        starts = [np.empty(0, np.int64)]
        if len(self.at):
            again = self.lead < own[self.owner[self.at]]  # strings that an earlier document of this chunk has
            count = self.count[again]
            starts.append(np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.at[again], count))
            order = np.lexsort((self.entry, self.bucket))
            code = self.bucket[order]
            for bucket, rows in answers.items():
                lo, hi = np.searchsorted(code, bucket), np.searchsorted(code, bucket, "right")
                mine = order[lo:hi]
                entries = self.entry[mine]
                # each occurrence of an entry takes the rows of that entry
                a, b = np.searchsorted(rows["entry"], entries), np.searchsorted(rows["entry"], entries, "right")
                take = b - a
                index = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(a, take)
                word = np.repeat(self.at[mine], take) + rows["window"][index]
                starts.append(word[rows["doc"][index] < own[self.owner[word]]])
        at = np.unique(np.concatenate(starts))
        return covered(at, self.window, len(self.starts))


_ROW = np.dtype([("entry", "<i4"), ("window", "<i4"), ("doc", "<i8")])


def common_runs(rows: DataFrame, window: int, run: int, size: int, bucket_bytes: int) -> Common:
    """The common runs of rows (doc_id, text), which have size bytes of text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [np.empty(0, U64)]
            for text in as_bytes(batch.column(0)):
                buf = np.frombuffer(text or b"", np.uint8)
                starts, ends = bounds(~SPACE[buf])
                if len(starts) >= window:  # fewer words have no window
                    found.append(np.unique(Sequences(word_hashes(buf, starts, ends)).windows(run)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["run"])

    one_of = max(SHARE, -(-size // SAMPLE_BYTES))
    least = max(LEAST, bucket_bytes // (4 * 8 * window) // one_of)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(one_of)) == 0).select("text")
    counts = sample.mapInArrow(each, "run long").groupBy("run").count().where(F.col("count") >= least)
    return Common(counts.orderBy(F.desc("count"), "run").limit(MOST).toArrow()["run"].to_numpy().view(np.uint64))


def _send(window: int, run: int, buckets: np.ndarray, common, parts: int):
    def each(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window, run, buckets, common.value, parts)
        names = sorted(chunk.sent)
        part = [_squeeze(np.array(chunk.part[b], "<i4").tobytes()) if parts > 1 else None for b in names]
        return pa.table({"bucket": pa.array(names, pa.int64()), "chunk": pa.array([table["chunk"][0].as_py()] * len(names), pa.int64()), "data": pa.array([chunk.message(b) for b in names], pa.binary()), "parts": pa.array(part, pa.binary())})

    return each


def count_windows(messages: list[bytes], window: int) -> list[np.ndarray]:
    """For each message the rows (entry, window, smallest doc_id) of windows that occur elsewhere with a smaller doc_id,
    in any message of the bucket, or again in one of a larger."""
    docs, origin, entries, parts = [], [], [], []
    for k, message in enumerate(messages):
        own, strings = _read(message)
        docs.append(own)
        origin.append(np.full(len(own), k))
        entries.append(np.arange(len(own)))
        parts.append(strings)
    data = b"\n".join(parts)
    del parts
    doc, origin_, entry = np.concatenate(docs), np.concatenate(origin), np.concatenate(entries)
    buf = np.frombuffer(data, np.uint8)
    starts, ends = bounds(~SPACE[buf])
    begin = np.concatenate([[0], np.flatnonzero(buf == 0x0A) + 1])
    first = np.searchsorted(starts, begin)
    owner = np.repeat(np.arange(len(begin)), np.diff(np.concatenate([first, [len(starts)]])))
    keys = Sequences(word_hashes(buf, starts, ends)).windows(window)
    at = np.flatnonzero(owner[: len(keys)] == owner[window - 1 :])
    order = at[np.argsort(keys[at], kind="stable")]
    ranked = keys[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.concatenate([head, [len(order)]]))
    many = np.repeat(size > 1, size)
    order, group = order[many], np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
    own = doc[owner[order]]
    best = np.lexsort((order, own, group))
    leader = order[best[np.searchsorted(group, np.arange(group[-1] + 1))]] if len(group) else order
    peer = leader[group] if len(group) else order
    # the words themselves: windows that follow one another in both places are compared as one stretch
    place = np.argsort(order)
    order, peer, own = order[place], peer[place], own[place]
    if len(order):
        cut = np.flatnonzero(np.concatenate([[True], (order[1:] != order[:-1] + 1) | (peer[1:] != peer[:-1] + 1)]))
        stop = np.concatenate([cut[1:], [len(order)]]) - 1
        a0, a1, b0, b1 = starts[order[cut]], ends[order[stop] + window - 1], starts[peer[cut]], ends[peer[stop] + window - 1]
        if any(data[s:e] != data[t:f] for s, e, t, f in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist(), strict=True) if s != t):
            order, own, leader_doc = _by_words(data, starts, ends, order, own, window)
        else:
            leader_doc = doc[owner[peer]]
    else:
        leader_doc = own
    rows = np.empty(len(order), _ROW)
    rows["entry"], rows["window"], rows["doc"] = entry[owner[order]], order - first[owner[order]], leader_doc
    source = origin_[owner[order]]
    return [rows[np.searchsorted(source, k) : np.searchsorted(source, k, "right")] for k in range(len(messages))]


def _by_words(data, starts, ends, order, own, window):
    """The same from the words alone, where hashes of different windows are equal."""
    least: dict[bytes, int] = {}
    texts = [data[s:e] for s, e in zip(starts[order].tolist(), ends[order + window - 1].tolist(), strict=True)]
    for text, d in zip(texts, own.tolist(), strict=True):
        least[text] = min(d, least.get(text, d))
    return order, own, np.array([least[t] for t in texts], np.int64)


def _answers(found: list[np.ndarray], senders: list[int], sender: str, **key: int) -> pa.Table:
    on = [k for k, rows in enumerate(found) if len(rows)]
    same = {name: pa.array([value] * len(on), pa.int64()) for name, value in key.items()}
    return pa.table({sender: pa.array([senders[k] for k in on], pa.int64()), **same, "rows": pa.array([_squeeze(found[k].tobytes()) for k in on], pa.binary())})


def _count(window: int, sender: str, *key: str):
    """Answers to the messages of a bucket, or of a part of one."""

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by(sender)
        found = count_windows(table["data"].to_pylist(), window)
        return _answers(found, table[sender].to_pylist(), sender, **{k: table[k][0].as_py() for k in key})

    return each


class _Group:
    """The different strings of a bucket's messages from a group of chunks, each with its part, its smallest doc_id and
    the number of messages that have it."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("chunk")
        self.chunks, self.bucket, self.number = table["chunk"].to_pylist(), table["bucket"][0].as_py(), table["group"][0].as_py()
        seen: dict[bytes, int] = {}
        self.own, docs, parts = [], [], []
        for data, part in zip(table["data"].to_pylist(), table["parts"].to_pylist(), strict=True):
            doc, strings = _read(data)
            self.own.append(np.array([seen.setdefault(x, len(seen)) for x in strings.split(b"\n")], np.int64))
            docs.append(doc)
            parts.append(np.frombuffer(_open(part), "<i4"))
        self.strings, every = list(seen), np.concatenate(self.own)
        self.times, self.least, self.part = np.bincount(every), np.full(len(seen), _NONE), np.empty(len(seen), np.int64)
        np.minimum.at(self.least, every, np.concatenate(docs))
        self.part[every] = np.concatenate(parts)
        self.order = np.argsort(self.part, kind="stable")  # a part's strings, as they are sent
        self.parts, self.at = np.unique(self.part[self.order], return_index=True)
        self.upto = np.append(self.at[1:], len(seen))

    def messages(self) -> pa.Table:
        rows = [(self.bucket, int(p), self.number, _message(self.least[mine], [self.strings[i] for i in mine.tolist()], level=5)) for p, mine in ((p, self.order[a:b]) for p, a, b in zip(self.parts, self.at, self.upto, strict=True))]
        bucket, part, group, data = zip(*rows, strict=True)
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "part": pa.array(part, pa.int64()), "group": pa.array(group, pa.int64()), "data": pa.array(data, pa.binary())})

    def spread(self, answers: dict[int, np.ndarray], window: int) -> list[np.ndarray]:
        """For each message the rows of its windows; answers: those to the messages of each part. All windows of a string
        in several messages are found at least at its smallest doc_id."""
        count = np.array([x.count(b" ") + 2 - window for x in self.strings], np.int64)
        begin = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.where(self.times > 1, self.least, _NONE), count)
        for part, rows in answers.items():
            at = begin[self.order[self.at[np.searchsorted(self.parts, part)] + rows["entry"]]] + rows["window"]
            doc[at] = np.minimum(doc[at], rows["doc"])
        on = np.flatnonzero(doc != _NONE)
        lo, hi = np.searchsorted(on, begin[:-1]), np.searchsorted(on, begin[1:])
        out = []
        for own in self.own:
            take = hi[own] - lo[own]
            index = on[np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(lo[own], take)]
            rows = np.empty(len(index), _ROW)
            rows["entry"], rows["window"], rows["doc"] = np.repeat(np.arange(len(own)), take), index - np.repeat(begin[own], take), doc[index]
            out.append(rows)
        return out


def _gather(table: pa.Table) -> pa.Table:
    return _Group(table).messages()


def _spread(window: int):
    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _answers([], [], "chunk", bucket=0)
        group = _Group(left)
        answers = {p: np.frombuffer(_open(r), _ROW) for p, r in zip(right["part"].to_pylist(), right["rows"].to_pylist(), strict=True)}
        return _answers(group.spread(answers, window), group.chunks, "chunk", bucket=group.bucket)

    return each


def answered(sent: DataFrame, window: int, groups: int) -> DataFrame:
    """chunk, bucket and rows of the windows of sent (bucket, chunk, data, parts) that occur elsewhere."""
    if groups == 1:
        return sent.groupBy("bucket").applyInArrow(_count(window, "chunk", "bucket"), "chunk long, bucket long, rows binary")
    sent = sent.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    met = sent.groupBy("bucket", "group").applyInArrow(_gather, "bucket long, part long, group long, data binary")
    found = met.groupBy("bucket", "part").applyInArrow(_count(window, "group", "bucket", "part"), "group long, bucket long, part long, rows binary")
    return sent.groupBy("bucket", "group").cogroup(found.groupBy("bucket", "group")).applyInArrow(_spread(window), "chunk long, bucket long, rows binary")


def _whole(keep_text: bool):
    """Rows without a doc_id, as they are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [b" ".join(t.split()) if t else b"" for t in as_bytes(batch.column(1))]
            counts = [t.count(b" ") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode() if keep_text else None for t in texts], pa.string())], schema=_OUT)

    return each


def _remove(window: int, run: int, buckets: np.ndarray, keep_text: bool, common, parts: int):
    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _OUT.empty_table()
        chunk = _Chunk(left, window, run, buckets, common.value, parts)
        gone = chunk.removed({b: np.frombuffer(_open(r), _ROW) for b, r in zip(right["bucket"].to_pylist(), right["rows"].to_pylist(), strict=True)})
        words, removed, digests, texts = [], [], [], []
        total = np.concatenate([[0], np.cumsum(gone)])
        for text, s, e in zip(chunk.texts, chunk.first.tolist(), chunk.last.tolist(), strict=True):
            n = int(total[e] - total[s])
            if n:
                text = b" ".join([w for w, g in zip(text.split(b" "), gone[s:e].tolist(), strict=True) if not g])
            words.append(e - s)
            removed.append(n)
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode() if keep_text else None)
        return pa.table([pa.array(chunk.doc_ids, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(texts, pa.string())], schema=_OUT)

    return each


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def dedup(docs: DataFrame, window: int = WINDOW, run: int = RUN, keep_text: bool = True, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null unless keep_text) of each row of docs (doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+ of the whole text. Each word covered by a window whose words also start in a document
    with a smaller doc_id is removed; windows are judged on the input. Kept words are joined by one blank. A null text
    has no words. A row without a doc_id keeps all and removes nothing elsewhere; rows that share a doc_id don't remove
    one another's words.
    """
    if not 1 <= run <= window:
        raise ValueError("run must be from 1 to window")
    rows = pick(docs, doc_id="long", text="string")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = rows.sparkSession
    chunks = even_keys(spark, max(8, -(-size // chunk_bytes)))
    groups = -(-len(chunks) // group)
    buckets = even_keys(spark, -(-max(16, -(-GROWTH * size // bucket_bytes)) // groups))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    unnamed, rows = rows.where("doc_id is null"), rows.where("doc_id is not null")
    common = spark.sparkContext.broadcast(common_runs(rows, window, run, size, bucket_bytes))
    rows = rows.withColumn("chunk", key_of(F.pmod(F.xxhash64("doc_id", "text"), F.lit(len(chunks))), chunks))
    sent = rows.groupBy("chunk").applyInArrow(_send(window, run, buckets, common, groups), "bucket long, chunk long, data binary, parts binary")
    answers = answered(sent, window, groups)
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(window, run, buckets, keep_text, common, groups), schema)
    return out.unionByName(unnamed.mapInArrow(_whole(keep_text), schema))
