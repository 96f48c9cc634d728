"""Token ids in files of directly addressable codes.

An id is split into chunks of bits, lowest first. Level k holds the k-th chunks of those ids that have one; a bitmap
beside it tells which of them go on in the next level, and a rank directory gives the number of set bits before each
block of the bitmap. Token i is read from byte i of the first level; where its bit is set, the rank of that bit is its
place in the next level. Nothing else is decoded.

A file row is a shard: the ids of consecutive documents, their doc_ids and lengths, the levels, and the number of ids
that its writing task put before it. Shards are written by Spark as Parquet in ascending order of doc_id, so that the
commit protocol covers lost executors and any store that Spark writes to can hold them; statistics on first_doc let a
reader skip files. A reader adds the ids of earlier tasks to what it has decoded, so that shards are never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import pick, pieces
from ._tokenize import load

#: Bits of each level; the last takes what is left of 32.
CHUNKS = (8, 8, 16)
#: Bits of a bitmap for each entry of its rank directory.
RANK_BITS = 512
#: Ids of a shard, a document more at most.
SHARD_IDS = 1 << 18
#: Bytes of input of a writing task, by Spark's own estimate, at most; and an estimate that is none.
PART_BYTES, _UNKNOWN = 64 << 20, 1 << 60
#: Writing tasks whose starts are sent to all executors, at 16 bytes each; those of more are joined by a shuffle. And
#: tasks whose sizes are summed up together.
FEW_PARTS, _GROUP = 200_000, 1000
SHARD_SCHEMA = "part int, seq int, before long, first_doc long, last_doc long, n_docs long, n_ids long, doc_ids binary, lengths binary, levels array<binary>, more array<binary>, ranks array<binary>"
_TYPES = {8: "<u1", 16: "<u2", 32: "<u4"}


class Dac:
    """Directly addressable codes of unsigned 32-bit integers."""

    def __init__(self, n: int, levels: list[bytes], more: list[bytes], ranks: list[bytes], chunks: tuple[int, ...] = CHUNKS):
        self.n, self.levels, self.more, self.ranks, self.chunks = n, levels, more, ranks, chunks

    @classmethod
    def encode(cls, ids: np.ndarray, chunks: tuple[int, ...] = CHUNKS) -> Dac:
        rest, levels, more, ranks = np.asarray(ids, np.uint64), [], [], []
        for k, bits in enumerate(chunks):
            levels.append((rest & np.uint64((1 << bits) - 1)).astype(_TYPES[bits]).tobytes())
            if k + 1 == len(chunks):
                if (rest >> np.uint64(bits)).any():
                    raise ValueError("an id has more bits than the levels")
                break
            rest = rest >> np.uint64(bits)
            on = rest > 0
            packed = np.packbits(on, bitorder="little")
            before = np.concatenate([[0], np.cumsum(on, dtype=np.uint64)[RANK_BITS - 1 :: RANK_BITS]]).astype("<u8") if len(on) else np.zeros(1, "<u8")
            more.append(packed.tobytes())
            ranks.append(before.tobytes())
            rest = rest[on]
            if not len(rest):
                break
        return cls(len(ids), levels, more, ranks, chunks)

    def __len__(self) -> int:
        return self.n

    def _rank(self, k: int, i: int) -> int:
        """Set bits of bitmap k before bit i."""
        block = i // RANK_BITS
        count = int.from_bytes(self.ranks[k][8 * block : 8 * block + 8], "little")
        first = block * RANK_BITS // 8
        own = int.from_bytes(self.more[k][first : i // 8 + 1], "little") & ((1 << (i - 8 * first)) - 1)
        return count + own.bit_count()

    def __getitem__(self, i: int) -> int:
        """Id i, from one chunk of each level that it reaches."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for k, bits in enumerate(self.chunks):
            size = bits // 8
            value |= int.from_bytes(self.levels[k][i * size : (i + 1) * size], "little") << shift
            if k >= len(self.more) or not self.more[k][i // 8] >> (i % 8) & 1:
                return value
            i, shift = self._rank(k, i), shift + bits
        return value

    def decode(self) -> np.ndarray:
        """All ids."""
        value = np.frombuffer(self.levels[0], _TYPES[self.chunks[0]]).astype(np.uint32)
        at, shift = np.arange(self.n), self.chunks[0]
        for k in range(1, len(self.levels)):
            at = at[np.unpackbits(np.frombuffer(self.more[k - 1], np.uint8), count=len(at), bitorder="little").astype(bool)]
            value[at] |= np.frombuffer(self.levels[k], _TYPES[self.chunks[k]]).astype(np.uint32) << np.uint32(shift)
            shift += self.chunks[k]
        return value.astype("<u4")


def _shards(path: str, end_id: int | None, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, seq = load(path), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        docs: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        have, before = 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal docs, lengths, held, have, seq, before
            code = Dac.encode(np.frombuffer(b"".join(held), "<u4"))
            known = [d for d in docs if d is not None]
            row = {
                "part": part, "seq": seq, "before": before, "first_doc": known[0] if known else None, "last_doc": known[-1] if known else None, "n_docs": len(docs), "n_ids": have,
                "doc_ids": np.array([d is None for d in docs], np.uint8).tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes(),
                "lengths": np.array(lengths, "<u8").tobytes(), "levels": code.levels, "more": code.more, "ranks": code.ranks,
            }
            docs, lengths, held, have, seq, before = [], [], [], 0, seq + 1, before + have
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in pieces(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer.encode(text) + end
                docs.append(doc)
                lengths.append(len(ids) // 4)
                held.append(ids)
                have += len(ids) // 4
                if have >= shard_ids:
                    yield shard()
        if docs:
            yield shard()

    return run


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), *((n, pa.int64()) for n in ("before", "first_doc", "last_doc", "n_docs", "n_ids")), ("doc_ids", pa.binary()), ("lengths", pa.binary()), *((n, pa.list_(pa.binary())) for n in ("levels", "more", "ranks"))])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of docs (doc_id, text; other columns are ignored) to path, in ascending order of doc_id.

    tokenizer: a file of the tokenizers library, at the same place on every executor. end_id is appended to each
    document. A null text is an empty one; a null doc_id comes first; rows that share a doc_id stand in order of text.
    """
    rows = pick(docs, doc_id="long", text="string")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES if size < _UNKNOWN else 1)
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_shards(tokenizer, end_id, shard_ids), SHARD_SCHEMA).write.parquet(path)


def open_shard(row) -> tuple[list[int | None], np.ndarray, Dac]:
    """doc_ids, lengths and codes of a shard row."""
    n = int(row["n_docs"])
    ids = np.frombuffer(row["doc_ids"], "<i8", offset=n)
    docs = [None if no else int(d) for no, d in zip(row["doc_ids"][:n], ids, strict=True)]
    return docs, np.frombuffer(row["lengths"], "<u8"), Dac(int(row["n_ids"]), list(row["levels"]), list(row["more"]), list(row["ranks"]))


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part and part_start, the number of ids that earlier writing tasks have written. Only the counts are read; they are
    summed up within groups of parts, and the groups' sums in one place."""
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("g", F.floor(F.col("part") / _GROUP))
    groups = parts.groupBy("g").agg(F.sum("n").alias("in_group"))
    groups = groups.select("g", (F.sum("in_group").over(Window.orderBy("g")) - F.col("in_group")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")
    return parts.withColumn("within", within).join(groups, "g").select("part", (F.col("before") + F.col("within")).alias("part_start"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            docs, lengths, code = open_shard(row)
            ids, ends = code.decode(), np.cumsum(lengths).astype(np.int64)
            starts, view = ends - lengths.astype(np.int64), memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            part = pa.array(np.full(len(docs), row["part"], np.int32))
            yield pa.RecordBatch.from_arrays([part, pa.array(docs, pa.int64()), pa.array(starts + row["before"], pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "in_part", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files in path."""
    shards = spark.read.parquet(path).select("part", "before", "n_docs", "n_ids", "doc_ids", "lengths", "levels", "more", "ranks")
    found = shards.mapInArrow(_documents, "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long")
    starts = part_starts(spark, path)
    starts = F.broadcast(starts) if spark.read.parquet(path).select("part").distinct().count() <= FEW_PARTS else starts
    return found.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def read_token(spark: SparkSession, path: str, doc_id: int, i: int) -> int:
    """Id i of a document: its shard by file statistics, the id by random access."""
    rows = spark.read.parquet(path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("part", "seq").toLocalIterator()
    for row in rows:
        docs, lengths, code = open_shard(row)
        if doc_id in docs:
            k = docs.index(doc_id)
            if not 0 <= i < int(lengths[k]):
                raise IndexError(i)
            return code[int(lengths[:k].sum()) + i]
    raise KeyError(doc_id)
