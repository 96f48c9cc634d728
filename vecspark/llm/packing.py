"""Best-fit packing of documents into sequences, with certified bounds.

Pieces are dealt to partitions, and each partition packs its own by best-fit decreasing. A lower bound on a partition's
number of bins, the largest over a family of dual feasible functions, certifies those whose bin count equals it. The
pieces of the other partitions' less than full bins are exchanged, and with them the emptiest bin of each certified one:
fewer, newly mixed partitions run best-fit decreasing again and keep the outcome only where it needs fewer bins. Rounds go
on as long as they lower the number of bins. Sizes are integers up to the capacity, so that a partition is packed from its
pieces' lengths alone; texts and ids are never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored
from ._text import pick, pieces
from ._tokenize import load

#: Pieces of a partition, about.
PART_PIECES = 50_000
#: The rounds that a sequence_id has room for.
MOST_ROUNDS = 15
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def _cut(path: str, capacity: int, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, end = load(path), b"" if end_id is None else int(end_id).to_bytes(4, "little")
        row = TaskContext.get().partitionId() << 33
        for batch in pieces(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer.encode(text) + end
                n, view = len(ids) // 4, memoryview(ids)
                first = n % capacity or min(n, capacity)
                for k, (s, e) in enumerate([(0, first), *((s, s + capacity) for s in range(first, n, capacity))] if n else []):
                    for column, value in zip(out, (doc, k, s, e - s, zlib.crc32(view[4 * s : 4 * e]), row), strict=True):
                        column.append(value)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return run


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0) -> DataFrame:
    """The pieces of docs (doc_id, text): a document of more than capacity ids is cut into pieces of capacity, its
    first one being what is left over. A null text is an empty one; a document without any id has no piece.
    row numbers the documents, so that rows that share a doc_id stay apart."""
    rows = pick(docs, doc_id="long", text="string")
    return rows.mapInArrow(_cut(tokenizer, capacity, end_id), PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and the offset of each length, and the number of bins. A longest piece goes to the fullest bin that
    has room for it; open bins are kept by room, and a bitmap of rooms in use finds the bin in constant time."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the largest of ceil(sum of f(length) / f(capacity)) over dual feasible functions f:
    the identity; for each threshold t up to half the capacity, lengths under t as 0, those over capacity - t as the
    capacity, others as they are; and for k from 2 to 20 the rounding of (k + 1) * length / capacity, down unless whole."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    number, amount = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    t = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - t + 1]
    middle = amount[capacity - t + 1] - amount[t]
    best = int(np.max(-(-(large * capacity + middle) // capacity)))
    for k in range(2, 21):
        scaled = (k + 1) * sizes
        f = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((counts * f).sum()) // (k * capacity)))
    return best


_BINNED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, part long, bin long, at long, open boolean"


def _arrow(table: pa.Table, part: int, bins: np.ndarray, offsets: np.ndarray, open_: np.ndarray) -> pa.Table:
    keep = table.select(["doc_id", "piece", "start", "length", "ids_crc32", "row"])
    return keep.append_column("part", pa.array(np.full(len(bins), part))).append_column("bin", pa.array(bins)).append_column("at", pa.array(offsets)).append_column("open", pa.array(open_))


def _pack(capacity: int, round_: int):
    """Packs the pieces of a partition; open: those in partly filled bins, of a certified partition in the emptiest one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy()
        part = int(table["deal"][0].as_py())
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        if round_:  # the bins that the pieces came in, numbered anew
            code, was = np.unique(np.stack([table["part"].to_numpy(), table["bin"].to_numpy()]), axis=1, return_inverse=True)
            if code.shape[1] <= count:
                bins, offsets, count = was.ravel(), table["at"].to_numpy(), code.shape[1]
        fill = np.bincount(bins, weights=lengths, minlength=count)
        done = count <= lower_bound(lengths, capacity)
        open_ = (fill < capacity)[bins]
        if done:
            open_ &= bins == np.argmin(fill)
        return _arrow(table, round_ << 40 | part, bins, offsets, open_)

    return run


def pack(pieces_: DataFrame, capacity: int = 2048, part_pieces: int = PART_PIECES, rounds: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to the pieces that cut() gives, stored once. Sequences are gapless from 0 and hold
    capacity ids at most; a piece of capacity ids is a sequence of its own. rounds: of exchange at most, 15 or fewer."""
    pieces_ = stored(pieces_, "pieces")
    base = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces_.where(F.col("length") == capacity).select(*base, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces_.where(F.col("length") < capacity)
    parts = max(1, -(-rest.count() // part_pieces))
    deal = lambda n: F.pmod(F.xxhash64("row", "piece"), F.lit(n)).cast("long")
    count = lambda df: df.agg(F.count_distinct("part").alias("parts"), F.count_distinct("part", "bin").alias("bins"), F.count("*").alias("pieces")).first()
    settled: list[DataFrame] = []
    packed = stored(rest.withColumn("deal", deal(parts)).groupBy("deal").applyInArrow(_pack(capacity, 0), _BINNED), "packed")
    for round_ in range(1, min(MOST_ROUNDS, MOST_ROUNDS if rounds is None else rounds) + 1):
        now = count(packed.where("open"))
        if now["parts"] < 2:
            break
        settled.append(packed.where(~F.col("open")))
        # whole bins move, so that what is not improved stays as it is
        n = max(1, min(now["parts"] - 1, -(-now["pieces"] // part_pieces)))
        moved = packed.where("open").withColumn("deal", F.pmod(F.xxhash64("part", "bin", F.lit(round_)), F.lit(n)).cast("long"))
        packed = stored(moved.groupBy("deal").applyInArrow(_pack(capacity, round_), _BINNED), "packed")
        if count(packed)["bins"] >= now["bins"]:
            break
    settled.append(packed)
    out = full
    for df in settled:
        # above the ids of full pieces: bit 62, then round and partition, then the bin
        sequence = F.lit(1 << 62).bitwiseOR(F.shiftleft(F.shiftright("part", 40), 58)).bitwiseOR(F.shiftleft(F.col("part").bitwiseAND(F.lit((1 << 40) - 1)), 22)).bitwiseOR(F.col("bin"))
        out = out.unionByName(df.select(*base, sequence.alias("sequence_id"), F.col("at").alias("offset")))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece of docs (doc_id, text)."""
    return pack(cut(docs, tokenizer, capacity, end_id), capacity, **options)


def materialise(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """sequence_id and ids of each sequence: the packed pieces joined to their documents' ids, for unique doc_ids."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = load(tokenizer), b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in pieces(batches):
            rows = batch.to_pylist()
            ids = [np.frombuffer(own.encode(r["text"]) + end, "<u4") for r in rows]
            out = [(p["sequence_id"], p["offset"], i[p["start"] : p["start"] + p["length"]].tolist()) for r, i in zip(rows, ids, strict=True) for p in r["pieces"]]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["sequence_id", "offset", "ids"])

    places = packed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("pieces"))
    parts = docs.select("doc_id", "text").join(places, "doc_id").mapInArrow(slices, "sequence_id long, offset long, ids array<long>")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(ordered["ids"]).alias("ids"))
