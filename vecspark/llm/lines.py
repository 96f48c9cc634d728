"""Line dedup by a deletion-neighbourhood join.

A line is its words. One that equals an earlier line of the corpus, or is within one word's insertion, deletion or
replacement of an earlier line, is removed; earlier is by (doc_id, place). Two lines within one edit agree in what is
left when a word is deleted from either or both, so each line emits the hashes of all its one-word deletions, and its
own, as keys; equal keys join. Lines that replace a word at the same place share one key with it, so that the earliest of
them stands for all: no pairs within a key are made. The earliest partner of each line is then verified on the words
themselves.

Only lines that can have a partner emit keys: within one edit, either the first or the second half of the shorter line
is a half of the other as well, so lines whose half hashes no other line has are passed over. That check leaves out
nothing.

Documents are dealt to chunks by a hash of doc_id; keys travel in one compressed row for each pair of chunk and bucket,
each key once for each chunk, with its earliest line. A chunk asks for the text of each partner once, and keeps the places
of its own lines that it asks for, so that a line that very many are near costs a row for each chunk. All passes read the
documents from one exchange.

Of more than GROUP chunks, keys and questions travel in two steps, so that neither a line in every chunk nor the number
of rows outgrows a task: a bucket is as many times wider as there are groups of chunks; its keys from one group meet
first, each once, with the earliest line; those of all groups meet in the bucket's parts, and answers go back the same
way. A line's text is asked for once by each group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored
from ._text import SPACE, U64, Sequences, as_bytes, bounds, even_keys, key_of, mix, powers, word_hashes

#: Words of a line that can be removed, and of one that is compared within one edit, at least.
LINE_WORDS, NEAR_WORDS = 5, 8
#: Bytes of text of a chunk, and for each bucket, about.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Chunks of a group, about.
GROUP = 4096
_EXACT = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("line", "<i4")])
_HALF = np.dtype([("key", "<u8"), ("tag", "<u8"), ("many", "u1")])
_VARIANT = np.dtype([("a", "<u8"), ("b", "<u8"), ("at", "<i4"), ("doc", "<i8"), ("line", "<i4")])
_NEAR = np.dtype([("doc", "<i8"), ("line", "<i4"), ("to_doc", "<i8"), ("to_line", "<i4")])
_REPLY = "chunk long, kind int, data binary"
_NAMES = ["chunk", "kind", "data"]
_TYPES = [pa.int64(), pa.int32(), pa.binary()]
_FIRST, _SHARED, _PARTNER, _TEXT, _NEARS = range(5)
#: Rows of a kind of message, the fields that are their key, and rows of the answer.
_FORM = {_FIRST: (_EXACT, ("h", "g"), _EXACT), _SHARED: (_HALF, ("key",), np.dtype("<u8")), _PARTNER: (_VARIANT, ("a", "b", "at"), _VARIANT)}


def _squeeze(rows: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(rows.tobytes())


def _open(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where rows in order begin a new combination of keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _place(by: np.ndarray, buckets: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each of by, and the part of it."""
    place = (by % U64(len(buckets) * parts)).astype(np.int64)
    return buckets[place % len(buckets)], place // len(buckets)


def _messages(chunk: int, rows: np.ndarray, by: np.ndarray, buckets: np.ndarray, kind: int, parts: int) -> pa.Table:
    """rows in one message for each bucket of by."""
    bucket, _ = _place(by, buckets, parts)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    at = _heads(bucket)
    data = [_squeeze(p) for p in np.split(rows, at[1:])] if len(rows) else []
    return pa.table({"bucket": pa.array(bucket[at], pa.int64()), "chunk": pa.array([chunk] * len(at), pa.int64()), "kind": pa.array([kind] * len(at), pa.int32()), "data": pa.array(data, pa.binary())})


_SENT = "bucket long, chunk long, kind int, data binary"


def _reply(chunks: list, kind: int, data: list[np.ndarray]) -> pa.Table:
    on = [k for k, d in enumerate(data) if len(d)]
    columns = [[chunks[k] for k in on], [kind] * len(on), [_squeeze(data[k]) for k in on]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


class _Chunk:
    """The lines of a chunk's documents, in order of doc_id and text, and its different lines (entries)."""

    def __init__(self, table: pa.Table, doc: str, text: str, hashed: bool = True):
        self.table = table.sort_by([(doc, "ascending"), (text, "ascending")])
        self.number = table["chunk"][0].as_py()
        self.doc_ids = self.table[doc].to_pylist()
        self.texts = as_bytes(self.table[text].combine_chunks())
        counts = [t.count(b"\n") + 1 if t else 1 for t in self.texts]
        self.begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)  # of each document's lines
        owner = np.repeat(np.arange(len(counts)), counts)
        self.place = (np.arange(len(owner)) - self.begin[owner]).astype(np.int32)
        known = np.array([d is not None for d in self.doc_ids], bool)
        self.doc = np.array([d or 0 for d in self.doc_ids], np.int64)[owner]
        self.data = b"\n".join(t or b"" for t in self.texts)
        buf = np.frombuffer(self.data, np.uint8)
        self.low = np.concatenate([[0], np.flatnonzero(buf == 0x0A) + 1])
        self.high = np.concatenate([self.low[1:] - 1, [len(buf)]])
        if not hashed:
            return
        starts, ends = bounds(~SPACE[buf])
        self.first = np.searchsorted(starts, self.low)
        self.last = np.concatenate([self.first[1:], [len(starts)]])
        self.words = self.last - self.first
        hashes = word_hashes(buf, starts, ends)
        self.one, self.two = Sequences(hashes, 0), Sequences(mix(hashes), 1)
        lines = np.flatnonzero((self.words >= LINE_WORDS) & known[owner])
        h, g = self.one.runs(self.first[lines], self.last[lines]), self.two.runs(self.first[lines], self.last[lines])
        order = np.lexsort((lines, g, h))
        head = _heads(h[order], g[order])
        self.lines, self.entry = lines[order], np.repeat(np.arange(len(head)), np.diff(np.concatenate([head, [len(order)]])))
        self.top, self.h, self.g = self.lines[head], h[order][head], g[order][head]  # an entry's earliest line

    def exact(self) -> np.ndarray:
        out = np.empty(len(self.top), _EXACT)
        out["h"], out["g"], out["doc"], out["line"] = self.h, self.g, self.doc[self.top], self.place[self.top]
        return out

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, key and whether it is of a first half, of the entries long enough: as the shorter and as the longer line."""
        entry = np.flatnonzero(self.words[self.top] >= NEAR_WORDS)
        f, t = self.first[self.top[entry]], self.last[self.top[entry]]
        keys = []
        for shorter in (0, 1):
            n = t - f - shorter
            half = n // 2
            keys.append(mix(self.one.runs(f, f + half) + n.astype(U64) * U64(4) + U64(1)))
            keys.append(mix(self.one.runs(t - (n - half), t) + n.astype(U64) * U64(4) + U64(2)))
        return np.tile(entry, 4), np.concatenate(keys), np.repeat([True, False, True, False], len(entry))

    def half_rows(self) -> np.ndarray:
        entry, key, _ = self.halves()
        order = np.lexsort((self.h[entry], key))
        key, tag = key[order], self.h[entry][order]
        head = _heads(key)
        tail = np.concatenate([head[1:], [len(key)]]) - 1
        out = np.empty(len(head), _HALF)
        out["key"], out["tag"], out["many"] = key[head], tag[head], tag[head] != tag[tail] if len(head) else 0
        return out

    def earlier(self, replies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each entry: whether its line occurs earlier in another chunk, and that place."""
        found = np.zeros(len(self.top), bool)
        doc, line = np.zeros(len(self.top), np.int64), np.zeros(len(self.top), np.int32)
        if replies:
            rows = np.concatenate([_open(r, _EXACT) for r in replies])
            rows = rows[np.lexsort((rows["g"], rows["h"]))]
            # both are in order of (h, g), and replies are of entries of this chunk
            both = np.concatenate([rows[["h", "g"]], self.exact()[["h", "g"]]])
            order = np.lexsort((np.arange(len(both)), both["g"], both["h"]))
            head = _heads(both["h"][order], both["g"][order])
            lead = order[np.repeat(head, np.diff(np.concatenate([head, [len(order)]])))]
            back = np.empty(len(both), np.int64)
            back[order] = lead
            back = back[len(rows) :]
            found = back < len(rows)
            doc[found], line[found] = rows["doc"][back[found]], rows["line"][back[found]]
        return found, doc, line

    def variants(self, first: list[bytes], shared: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Entry and row of each key of the entries that are the corpus's earliest and may have a partner."""
        entry, key, front = self.halves()
        known = np.sort(np.concatenate([_open(r, np.dtype("<u8")) for r in shared])) if shared else np.empty(0, U64)
        if not len(known) or not len(entry):
            return np.empty(0, np.int64), np.empty(0, _VARIANT)
        on = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
        same_front, same_back = (np.bincount(entry[on & (front == side)], minlength=len(self.top)) > 0 for side in (True, False))
        late, _, _ = self.earlier(first)
        own = np.flatnonzero((same_front | same_back) & ~late)
        n = self.words[self.top[own]]
        # where the front halves agree the edit is behind them, and the other way round
        lo, hi = np.where(same_back[own], 0, (n - 1) // 2), np.where(same_front[own], n, n // 2 + 1)
        count = hi - lo
        which = np.repeat(np.arange(len(own)), count)
        at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
        f, t = self.first[self.top[own]], self.last[self.top[own]]
        keys = []
        for s in (self.one, self.two):
            back = powers(s.back, s.n + 1)
            i = f[which] + at
            less = mix((s.total[i] - s.total[f[which]]) * back[f[which]] + (s.total[t[which]] - s.total[i + 1]) * back[f[which] + 1] + (n[which] - 1).astype(U64))
            keys.append(np.concatenate([less, s.runs(f, t)]))
        entry = np.concatenate([own[which], own])
        out = np.empty(len(entry), _VARIANT)
        out["a"], out["b"], out["at"] = *keys, np.concatenate([at, np.full(len(own), -1)])
        out["doc"], out["line"] = self.doc[self.top[entry]], self.place[self.top[entry]]
        order = np.lexsort((self.top[entry], out["at"], out["b"], out["a"]))
        return entry[order], out[order]

    def line(self, i: int) -> bytes:
        return self.data[self.low[i] : self.high[i]]


def _by_kind(table: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {k: [] for k in range(5)}
    for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
        out[kind].append(data)
    return out


def _settle(table: pa.Table) -> pa.Table:
    """For a bucket: the earliest place of each line, and the halves that different lines share."""
    table = table.sort_by([("kind", "ascending"), ("chunk", "ascending")])
    out = []
    for kind, form in ((_FIRST, _EXACT), (_SHARED, _HALF)):
        own = table.filter(pc.equal(table["kind"], kind))
        parts = [_open(d, form) for d in own["data"].to_pylist()]
        if not parts:
            continue
        rows, source = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        if kind == _FIRST:
            order = np.lexsort((rows["line"], rows["doc"], rows["g"], rows["h"]))
            head = _heads(rows["h"][order], rows["g"][order])
            lead = order[np.repeat(head, np.diff(np.concatenate([head, [len(order)]])))]
            say = rows[order].copy()
            on = (rows["doc"][lead] != say["doc"]) | (rows["line"][lead] != say["line"])
            say["doc"], say["line"] = rows["doc"][lead], rows["line"][lead]
        else:
            order = np.lexsort((rows["tag"], rows["key"]))
            head = _heads(rows["key"][order])
            size = np.diff(np.concatenate([head, [len(order)]]))
            tail = head + size - 1
            many = (rows["tag"][order][head] != rows["tag"][order][tail]) | (np.add.reduceat(rows["many"][order].astype(np.int64), head) > 0)
            say, on = rows["key"][order], np.repeat(many, size)
        say, source = say[on], source[order][on]
        place = np.argsort(source, kind="stable")
        cuts = np.searchsorted(source[place], np.arange(1, len(parts)))
        out.append(_reply(own["chunk"].to_pylist(), kind, np.split(say[place], cuts)))
    return pa.concat_tables(out)


def _join(table: pa.Table) -> pa.Table:
    """For a bucket: the earliest line that each key leads to."""
    table = table.sort_by("chunk")
    parts = [_open(d, _VARIANT) for d in table["data"].to_pylist()]
    rows, source = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    age = np.lexsort((rows["line"], rows["doc"]))
    rank = np.empty(len(rows), np.int64)
    rank[age] = np.arange(len(rows))
    order = np.lexsort((rank, rows["at"], rows["b"], rows["a"]))
    r = rows[order]
    spread = lambda head, v: np.repeat(v, np.diff(np.concatenate([head, [len(r)]])))
    same = _heads(r["a"], r["b"], r["at"])
    best = spread(same, rank[order][same])
    key = _heads(r["a"], r["b"])
    far = len(rows)
    whole = np.where(r["at"] == -1, rank[order], far)
    less = np.where(r["at"] == -1, far, rank[order])
    to_whole, to_less = spread(key, np.minimum.reduceat(whole, key)), spread(key, np.minimum.reduceat(less, key))
    best = np.minimum(best, np.where(r["at"] == -1, to_less, to_whole))
    lead = age[np.minimum(best, far - 1)]
    on = (best < rank[order]) & ((rows["doc"][lead] != r["doc"]) | (rows["line"][lead] != r["line"]))
    say = r[on].copy()
    say["doc"], say["line"] = rows["doc"][lead[on]], rows["line"][lead[on]]
    source = source[order][on]
    place = np.argsort(source, kind="stable")
    return _reply(table["chunk"].to_pylist(), _PARTNER, np.split(say[place], np.searchsorted(source[place], np.arange(1, len(parts)))))


def _ranked(rows: np.ndarray, key: tuple[str, ...], *before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows in order of their key, of before and of their place, and where a new key begins."""
    order = np.lexsort((rows["line"], rows["doc"], *before, *(rows[k] for k in reversed(key))))
    return order, _heads(*(rows[k][order] for k in key))


def _reduced(kind: int, rows: np.ndarray) -> np.ndarray:
    """Each key once: with its earliest line, or with one of its lines and whether there are others."""
    _, key, _ = _FORM[kind]
    if kind != _SHARED:
        order, head = _ranked(rows, key)
        return rows[order[head]]
    rows = rows[np.lexsort((rows["tag"], rows["key"]))]
    head = _heads(rows["key"])
    tail = np.concatenate([head[1:], [len(rows)]]) - 1
    out = rows[head].copy()
    out["many"] = (rows["tag"][head] != rows["tag"][tail]) | (np.add.reduceat(rows["many"].astype(np.int64), head) > 0)
    return out


def _by_message(table: pa.Table, kind: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The chunks that sent a kind of message, and of all their rows, the rows and whose each is."""
    own = table.filter(pc.equal(table["kind"], kind))
    rows = [_open(d, _FORM[kind][0]) for d in own["data"].to_pylist()]
    every = np.concatenate(rows) if rows else np.empty(0, _FORM[kind][0])
    return own["chunk"].to_pylist(), every, np.repeat(np.arange(len(rows)), np.array([len(r) for r in rows], np.int64))


def _gather(buckets: np.ndarray, parts: int):
    """What a group of chunks sends to each part of a bucket; chunk is the group's number there."""

    def each(table: pa.Table) -> pa.Table:
        bucket, group, out = table["bucket"][0].as_py(), table["group"][0].as_py(), []
        for kind, (_, key, _) in _FORM.items():
            _, rows, _ = _by_message(table, kind)
            if len(rows):
                rows = _reduced(kind, rows)
                _, part = _place(rows[key[0]], buckets, parts)
                order = np.argsort(part, kind="stable")
                at = _heads(part[order])
                out += [(bucket, int(p), group, kind, _squeeze(r)) for p, r in zip(part[order][at], np.split(rows[order], at[1:]), strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), *_TYPES], strict=True)], names=["bucket", "part", *_NAMES])

    return each


def _of_part(run):
    def each(table: pa.Table) -> pa.Table:
        out = run(table)
        return out.append_column("bucket", pa.array([table["bucket"][0].as_py()] * out.num_rows, pa.int64()))

    return each


def _spread(left: pa.Table, right: pa.Table) -> pa.Table:
    """The answers to a group's chunks, from those to the group and from what its chunks have among themselves."""
    out = [_reply([], 0, [])]
    for kind, (_, key, form) in _FORM.items() if left.num_rows else ():
        chunks, rows, source = _by_message(left, kind)
        said = [_open(d, form) for d in right.filter(pc.equal(right["kind"], kind))["data"].to_pylist()]
        said = np.concatenate(said) if said else np.empty(0, form)
        if not len(rows):
            continue
        if kind == _SHARED:
            say, on = rows["key"], np.isin(rows["key"], said)
        else:
            every = np.concatenate([said, rows])
            order, head = _ranked(every, key, np.arange(len(every)) >= len(said))
            lead = np.empty(len(every), np.int64)
            lead[order] = order[np.repeat(head, np.diff(np.append(head, len(every))))]
            lead, say = lead[len(said) :], rows.copy()
            say["doc"], say["line"] = every["doc"][lead], every["line"][lead]
            on = (say["doc"] != rows["doc"]) | (say["line"] != rows["line"])
        out.append(_reply(chunks, kind, np.split(say[on], np.searchsorted(source[on], np.arange(1, len(chunks))))))
    return pa.concat_tables(out)


def answered(sent: DataFrame, run, buckets: np.ndarray, groups: int) -> DataFrame:
    """The answers of run to the messages sent to each bucket."""
    if groups == 1:
        return sent.groupBy("bucket").applyInArrow(run, _REPLY)
    sent = sent.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    met = sent.groupBy("bucket", "group").applyInArrow(_gather(buckets, groups), f"bucket long, part long, {_REPLY}")
    found = met.groupBy("bucket", "part").applyInArrow(_of_part(run), f"{_REPLY}, bucket long").withColumnRenamed("chunk", "group")
    return sent.groupBy("bucket", "group").cogroup(found.groupBy("bucket", "group")).applyInArrow(_spread, _REPLY)


def _partners(chunk: _Chunk, said: dict[int, list[bytes]]) -> list[np.ndarray]:
    """doc, line, and the place of the earliest partner of the entries that have an earlier one."""
    entry, rows = chunk.variants(said[_FIRST], said[_SHARED])
    if not len(rows):
        return [np.empty(0, np.int64)] * 4
    head = _heads(rows["a"], rows["b"], rows["at"])
    lead = np.repeat(head, np.diff(np.concatenate([head, [len(rows)]])))
    doc, line = rows["doc"][lead].copy(), rows["line"][lead].copy()
    if said[_PARTNER]:
        got = np.concatenate([_open(d, _VARIANT) for d in said[_PARTNER]])
        both = np.concatenate([got, rows[head]])
        order = np.lexsort((np.arange(len(both)), both["at"], both["b"], both["a"]))
        top = _heads(both["a"][order], both["b"][order], both["at"][order])
        to = np.empty(len(both), np.int64)
        to[order] = order[np.repeat(top, np.diff(np.concatenate([top, [len(order)]])))]
        to = to[len(got) :][np.repeat(np.arange(len(head)), np.diff(np.concatenate([head, [len(rows)]])))]
        on = to < len(got)
        doc[on], line[on] = got["doc"][to[on]], got["line"][to[on]]
    order = np.lexsort((line, doc, entry))
    first = order[_heads(entry[order])]
    own = chunk.top[entry[first]]
    on = (doc[first] < chunk.doc[own]) | ((doc[first] == chunk.doc[own]) & (line[first] < chunk.place[own]))
    return [chunk.doc[own[on]], chunk.place[own[on]], doc[first[on]], line[first[on]]]


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word's insertion, deletion or replacement, or none, makes a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: bool = True, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, group: int = GROUP) -> DataFrame:
    """docs without the lines that are removed, and _n_lines, _n_removed and _n_near (of those, lines that only come near
    an earlier one) appended. Kept lines are joined by a line feed.

    Lines are parted by line feeds; words are [^\\x20\\x09-\\x0D]+. A line of under LINE_WORDS words always stays, and one
    of under NEAR_WORDS goes only if its words equal an earlier line's; so does any without near. Lines are judged on the
    input, whether or not the earlier one is removed itself. A null text stays null, with no line. A row without a doc_id
    stays whole, and removes nothing elsewhere; rows that share a doc_id have the same places.
    """
    names = docs.columns
    d, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn(t, F.col(t).cast("string")).withColumn(d, F.col(d).cast("long"))
    size = rows.agg(F.sum(F.octet_length(t))).first()[0] or 0
    chunks = even_keys(docs.sparkSession, max(8, -(-size // chunk_bytes)))
    groups = -(-len(chunks) // group)
    buckets = even_keys(docs.sparkSession, -(-max(8, -(-size // bucket_bytes)) // groups))
    dealt = lambda c: key_of(F.pmod(F.xxhash64(c), F.lit(len(chunks))), chunks)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    counts = (F.when(F.col(t).isNull(), 0).otherwise(breaks), F.lit(0), F.lit(0))
    unnamed = rows.where(F.col(d).isNull()).select("*", *[c.cast("long").alias(n) for c, n in zip(counts, ("_n_lines", "_n_removed", "_n_near"), strict=True)])
    rows = rows.where(F.col(d).isNotNull()).withColumn("chunk", dealt(d))
    by_chunk = lambda: rows.groupBy("chunk")

    def send(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, d, t)
        exact = chunk.exact()
        out = [_messages(chunk.number, exact, exact["h"], buckets, _FIRST, groups)]
        if near:
            half = chunk.half_rows()
            out.append(_messages(chunk.number, half, half["key"], buckets, _SHARED, groups))
        return pa.concat_tables(out)

    def send_variants(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _messages(0, np.empty(0, _VARIANT), np.empty(0, U64), buckets, _PARTNER, groups)
        chunk, said = _Chunk(left, d, t), _by_kind(right)
        entry, own = chunk.variants(said[_FIRST], said[_SHARED])
        own = own[_heads(own["a"], own["b"], own["at"])] if len(own) else own
        return _messages(chunk.number, own, own["a"], buckets, _PARTNER, groups)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        """A row for each line that is the earliest partner of lines here; and one of those lines and their partners,
        which stays with the chunk."""
        doc, line, to_doc, to_line = _partners(_Chunk(left, d, t), _by_kind(right)) if left.num_rows else [np.empty(0, np.int64)] * 4
        order = np.lexsort((line, doc, to_line, to_doc))
        near = np.empty(len(order), _NEAR)
        for name, values in zip(_NEAR.names, (doc, line, to_doc, to_line), strict=True):
            near[name] = values[order]
        at = _heads(near["to_doc"], near["to_line"])
        own = left["chunk"][0].as_py() if left.num_rows else 0
        n, some = len(at), int(len(near) > 0)
        return pa.table({"asked_by": pa.array([own] * (n + some), pa.int64()), "kind": pa.array([_TEXT] * n + [_NEARS] * some, pa.int32()), "to_doc": pa.array([*near["to_doc"][at].tolist(), *[None] * some], pa.int64()), "to_line": pa.array([*near["to_line"][at].tolist(), *[None] * some], pa.int64()), "data": pa.array([*[None] * n, *[_squeeze(near)] * some], pa.binary())})

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        """The texts of the lines that are asked for, after their places, to those who ask, chunks or groups of them; what
        stays goes on as it is."""
        out = [r for r in zip(*(right[c].to_pylist() for c in ("asked_by", "kind", "data")), strict=True) if r[1] == _NEARS]
        right = right.filter(pc.equal(right["kind"], _TEXT))
        if left.num_rows and right.num_rows:
            chunk, rows_of = _Chunk(left, d, t, hashed=False), {}
            for k, doc in enumerate(chunk.doc_ids):
                rows_of.setdefault(doc, []).append(k)
            for by, doc, line in zip(*(right[c].to_pylist() for c in ("asked_by", "to_doc", "to_line")), strict=True):
                for k in rows_of.get(doc, []):
                    if (i := int(chunk.begin[k]) + line) < chunk.begin[k + 1]:
                        out.append((by, _TEXT, doc.to_bytes(8, "big", signed=True) + line.to_bytes(8, "big") + chunk.line(i)))
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, _TYPES, strict=True)], names=_NAMES)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([*left.drop(["chunk"]).schema, *((n, pa.int64()) for n in ("_n_lines", "_n_removed", "_n_near"))]))
        chunk, said = _Chunk(left, d, t), _by_kind(right)
        late, first_doc, first_line = chunk.earlier(said[_FIRST])
        gone = np.zeros(len(chunk.place), bool)
        top = chunk.top[chunk.entry]
        lines = chunk.lines
        later = (chunk.doc[lines] > chunk.doc[top]) | ((chunk.doc[lines] == chunk.doc[top]) & (chunk.place[lines] > chunk.place[top]))
        e = chunk.entry
        gone[lines] = later | (late[e] & ((first_doc[e] < chunk.doc[lines]) | ((first_doc[e] == chunk.doc[lines]) & (first_line[e] < chunk.place[lines]))))
        close = np.zeros(len(gone), bool)
        rows_of: dict[int, list[int]] = {}
        for k, doc in enumerate(chunk.doc_ids):
            rows_of.setdefault(doc, []).append(k)
        partner: dict[tuple[int, int], list[list[bytes]]] = {}
        for data in said[_TEXT]:
            to = int.from_bytes(data[:8], "big", signed=True), int.from_bytes(data[8:16], "big")
            partner.setdefault(to, []).append(data[16:].split())
        for data in said[_NEARS]:
            for doc, line, *to in _open(data, _NEAR).tolist():
                for k in rows_of.get(doc, []):
                    i = int(chunk.begin[k]) + line
                    if i < chunk.begin[k + 1] and not gone[i] and chunk.words[i] >= NEAR_WORDS:
                        own = chunk.line(i).split()
                        close[i] |= any(within_one_edit(own, other) for other in partner.get(tuple(to), []))
        texts, total, near_total = [], np.concatenate([[0], np.cumsum(gone | close)]), np.concatenate([[0], np.cumsum(close)])
        for text_, s, e in zip(chunk.texts, chunk.begin[:-1].tolist(), chunk.begin[1:].tolist(), strict=True):
            if text_ and total[e] > total[s]:
                text_ = b"\n".join([x for x, g in zip(text_.split(b"\n"), (gone | close)[s:e].tolist(), strict=True) if not g])
            texts.append(None if text_ is None else text_.decode())
        table = chunk.table.drop(["chunk"])
        table = table.set_column(table.schema.get_field_index(t), t, pa.array(texts, pa.string()))
        count = lambda x: pa.array((x[chunk.begin[1:]] - x[chunk.begin[:-1]]).astype(np.int64))
        n = np.where([x is None for x in chunk.texts], 0, chunk.begin[1:] - chunk.begin[:-1]).astype(np.int64)
        return table.append_column("_n_lines", pa.array(n)).append_column("_n_removed", count(total)).append_column("_n_near", count(near_total))

    def told(asked: DataFrame) -> DataFrame:
        texts = lambda rows: by_chunk().cogroup(rows.groupBy("chunk")).applyInArrow(tell, _REPLY)
        if groups == 1:
            return texts(asked.withColumn("chunk", F.when(F.col("kind") == _TEXT, dealt("to_doc")).otherwise(F.col("asked_by"))))
        asked = stored(asked.withColumn("group", F.pmod(F.xxhash64("asked_by"), F.lit(groups))), "asked")
        stay, asks = asked.where(F.col("kind") == _NEARS).select(F.col("asked_by").alias("chunk"), "kind", "data"), asked.where(F.col("kind") == _TEXT)
        once = asks.select(F.col("group").alias("asked_by"), "kind", "to_doc", "to_line", "data").distinct().withColumn("chunk", dealt("to_doc"))
        head = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("to_doc", "to_line"))))
        to = asks.select(F.col("asked_by").alias("to"), "group", head.alias("head"))
        said = texts(once).select(F.col("chunk").alias("group"), "kind", "data", F.substring("data", 1, 16).alias("head"))
        return stay.unionAll(said.join(to, ["group", "head"]).select(F.col("to").alias("chunk"), "kind", "data"))

    settled = answered(by_chunk().applyInArrow(send, _SENT), _settle, buckets, groups)
    heard = settled
    if near:
        keys = by_chunk().cogroup(settled.groupBy("chunk")).applyInArrow(send_variants, _SENT)
        partners = answered(keys, _join, buckets, groups)
        asked = by_chunk().cogroup(settled.unionAll(partners).groupBy("chunk")).applyInArrow(ask, "asked_by long, kind int, to_doc long, to_line long, data binary")
        heard = settled.unionAll(told(asked))
    new = "_n_lines long, _n_removed long, _n_near long"
    out = by_chunk().cogroup(heard.groupBy("chunk")).applyInArrow(remove, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("chunk").schema) + f", {new}")
    return out.unionAll(unnamed).toDF(*names, "_n_lines", "_n_removed", "_n_near")
