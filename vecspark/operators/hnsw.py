"""Navigable small-world graphs, one for each shard of the rows.

Rows are dealt to shards of a stated size by a hash of the key; a task builds a shard's graph in numpy and stores it as a
row: keys, vectors, and links as arrays of 32-bit integers, which a search reads as they are. A node's links are the
nearest of all nodes before it, which ef_construction could only miss: a shard's rows are few enough to compare them by
products. A search descends each shard's graph, for many queries side by side, and merges the shards' best. Shards are
seeded, so that a rebuild gives the same graph.

Changes go into the graphs of the shards that they fall into: a removed row is marked and passed through but not found,
and a new one is linked in. A shard with many marked rows is built anew. An index that was stored beside a table is
reconciled with the rows that the table has now.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import Metric, Vector
from ..functions.prepare import searchable
from ..plans.schema import VectorField
from ..plans.session import fresh_path, stored
from .search import SCORE, Nearest, batches_of, matrix, merged, ordering, prepared, query_of

#: Rows of a shard, about, and bytes of its vectors at most.
SHARD_ROWS, SHARD_BYTES = 20_000, 64 << 20
SEED = 42
#: Similarities that a task holds at once when it links nodes, and when it walks, which is best in a core's own cache.
CELLS, WALK_CELLS = 1 << 21, 1 << 17
#: The share of removed rows from which on a shard is built anew, and how often the planned size it may have.
REMOVED, GROWN = 0.25, 2


class Level:
    """Links of a level: those of nodes[i], which ascend, are near[edge[i]:edge[i + 1]]."""

    def __init__(self, nodes: np.ndarray, edge: np.ndarray, near: np.ndarray):
        self.nodes, self.edge, self.near = nodes, edge, near

    @classmethod
    def of(cls, nodes: np.ndarray, source: np.ndarray, near: np.ndarray) -> Level:
        """From edges in order of source."""
        edge = np.searchsorted(source, np.append(nodes, nodes[-1] + 1 if len(nodes) else 0)).astype("<i4")
        return cls(nodes.astype("<i4"), edge, near.astype("<i4"))

    def source(self) -> np.ndarray:
        return np.repeat(self.nodes, np.diff(self.edge))

    def table(self, n: int) -> np.ndarray:
        """A row of neighbours for each of n nodes, filled up with the node itself."""
        many = np.zeros(n, np.int64)
        many[self.nodes] = np.diff(self.edge)
        out = np.repeat(np.arange(n, dtype=np.int32)[:, None], max(1, int(many.max(initial=0))), axis=1)
        out[np.arange(out.shape[1]) < many[:, None]] = self.near
        return out


class Graph:
    """Nodes 0 .. n - 1 with vectors, normalised where the metric wants it; links by level. removed nodes are walked but
    not found.

    Similarities come from products of many rows at once, which for the rows of a shard cost less than the many small
    ones of a walk from node to node: a new node's candidates are all nodes before it, and many queries walk side by side."""

    def __init__(self, m: int, metric: Metric, seed: int):
        self.m, self.metric = m, metric
        self.rng = np.random.default_rng(seed)
        self.vectors = np.empty((0, 0))
        self.removed = np.empty(0, bool)
        self.links: list[Level] = []
        self.entry = -1

    def most(self, level: int) -> int:
        return self.m * 2 if level == 0 else self.m

    def _like(self, q: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Queries by rows; what is no number is last."""
        if self.metric.normalised or self.metric.name == "dot":
            s = q @ m.T
        elif self.metric.name == "euclidean":
            gap = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", m, m) - 2 * (q @ m.T)
            s = 1 / (1 + np.sqrt(np.maximum(gap, 0)))
        else:
            step = max(1, CELLS // max(1, m.size))
            s = np.concatenate([np.empty((0, len(m))), *(self.metric.kernel(m, q[i : i + step]).T for i in range(0, len(q), step))])
        return np.where(np.isnan(s), -np.inf, s)

    def add(self, vectors: np.ndarray) -> Graph:
        """Links new nodes in, after those that are there. A node is linked to the nearest before it, on each of its levels,
        and these to it; of its links each keeps the nearest, as if nodes had come one by one."""
        first = len(self.vectors)
        self.vectors = np.concatenate([self.vectors, vectors]) if first else vectors
        self.removed = np.concatenate([self.removed, np.zeros(len(vectors), bool)])
        tall = (-np.log(1.0 - self.rng.random(len(vectors))) / math.log(max(2, self.m))).astype(int)
        top = len(self.links) - 1
        for level in range(max(top, int(tall.max(initial=-1))) + 1):
            old = self.links[level] if level <= top else Level.of(*[np.empty(0, np.int64)] * 3)
            new = first + np.flatnonzero(tall >= level)
            if len(new):
                self.links[level : level + 1] = [self._linked(old, new, self.most(level))]
        if len(tall) and tall.max() > top:
            self.entry = first + int(np.argmax(tall))
        return self

    def _linked(self, old: Level, new: np.ndarray, most: int) -> Level:
        nodes, source, near, like = np.concatenate([old.nodes, new]).astype(np.int64), [], [], []
        at, step = len(old.nodes), max(1, CELLS // (len(old.nodes) + len(new)))
        for i in range(at, len(nodes), step):
            end = min(i + step, len(nodes))
            s = self._like(self.vectors[nodes[i:end]], self.vectors[nodes[:end]])
            s[np.arange(end) >= np.arange(i, end)[:, None]] = -np.inf
            on = np.argpartition(-s, most - 1, axis=1)[:, :most] if end > most else np.broadcast_to(np.arange(end), s.shape)
            before = on < np.arange(i, end)[:, None]
            source.append(np.broadcast_to(nodes[i:end, None], on.shape)[before])
            near.append(nodes[on[before]])
            like.append(np.take_along_axis(s, on, axis=1)[before])
        source, near, like = (np.concatenate([np.empty(0, kind), *x]) for x, kind in ((source, np.int64), (near, np.int64), (like, float)))
        was, to = old.source().astype(np.int64), old.near.astype(np.int64)
        if len(was):  # what has new links is compared with its older ones
            step = max(1, CELLS // max(1, self.vectors.shape[1]))
            known = [self._pairs(was[i : i + step], to[i : i + step]) for i in range(0, len(was), step)]
            source, near, like = np.concatenate([was, source]), np.concatenate([to, near]), np.concatenate([*known, like])
        back = len(was)
        source, near, like = np.concatenate([source, near[back:]]), np.concatenate([near, source[back:]]), np.concatenate([like, like[back:]])
        order = np.lexsort((near, -like, source))
        source, near = source[order], near[order]
        start = np.searchsorted(source, source)
        keep = np.arange(len(source)) - start < most
        return Level.of(nodes, source[keep], near[keep])

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.vectors[a], self.vectors[b]
        if self.metric.normalised or self.metric.name == "dot":
            s = (x * y).sum(axis=1)
        elif self.metric.name == "euclidean":
            s = 1 / (1 + np.sqrt(((x - y) ** 2).sum(axis=1)))
        else:
            s = np.array([self.metric.kernel(i[None], j[None])[0, 0] for i, j in zip(x, y, strict=True)])
        return np.where(np.isnan(s), -np.inf, s)

    def search(self, near: Nearest, keys: pa.Array, ef: int) -> None:
        """Offers near what its queries find: each descends to the nearest node of the upper levels, and walks on from all
        nodes that are among the ef most similar it has seen, until there are no others."""
        n = len(self.vectors)
        if self.entry < 0:
            return
        gone = int(self.removed.sum())
        if gone:  # as many more as may be passed through
            ef = math.ceil(ef * n / max(1, n - gone))
        ef, links = min(ef, n), [x.table(n) for x in self.links]
        step = max(1, WALK_CELLS // n)
        for i in range(0, len(near.q), step):
            to = np.arange(i, min(i + step, len(near.q)))
            s = self._like(near.q[to], self.vectors)
            seen = self._walked(s.astype(np.float32), links, ef)
            if gone:
                seen &= ~self.removed
            near.offer(to, s, keys, self.vectors if near.exact else None, seen)

    def _walked(self, s: np.ndarray, links: list[np.ndarray], ef: int) -> np.ndarray:
        """For queries by nodes, whether the node is among the ef most similar that the query has seen."""
        many, n = s.shape
        own, row = np.full(many, self.entry), np.arange(many)
        for table in links[:0:-1]:
            at = row
            while len(at):
                near = table[own[at]]
                like = s[at[:, None], near]
                best = np.argmax(like, axis=1)
                on = np.take_along_axis(like, best[:, None], axis=1)[:, 0] > s[at, own[at]]
                own[at[on]] = near[on, best[on]]
                at = at[on]
        seen, done = np.zeros((many, n), bool), np.zeros((many, n), bool)
        seen[row, own] = True
        flat, table = seen.ravel(), links[0]
        at, node = row, own
        while True:
            done[at, node] = True
            flat[(table[node] + (at * n)[:, None]).ravel()] = True
            beam = seen
            if ef < n:
                like = np.where(seen, s, np.float32(-np.inf))
                beam = seen & (like >= np.partition(like, n - ef, axis=1)[:, n - ef, None])
            at, node = np.nonzero(beam & ~done)
            if not len(at):
                return beam

    def row(self, shard: int, keys: pa.Array, schema: pa.Schema) -> pa.Table:
        dims = self.vectors.shape[1] if len(self.vectors) else 0
        own = {"shard": shard, "n": len(keys), "alive": len(keys) - int(self.removed.sum()), "dims": dims, "entry": self.entry, "vectors": self.vectors.astype("<f8").tobytes(), "removed": self.removed.astype(np.uint8).tobytes()}
        own |= {name: [getattr(x, field).tobytes() for x in self.links] for name, field in (("nodes", "nodes"), ("edges", "edge"), ("near", "near"))}
        columns = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.cast(f.type.value_type)).cast(f.type) if f.name == "keys" else pa.array([own[f.name]], f.type) for f in schema]
        return pa.Table.from_arrays(columns, schema=schema)

    def load(self, row: pa.RecordBatch | pa.Table) -> Graph:
        one = lambda name: row.column(name)[0].as_py()
        self.vectors = np.frombuffer(one("vectors"), "<f8").reshape(one("n"), one("dims"))
        self.removed = np.frombuffer(one("removed"), np.uint8).astype(bool)
        self.links = [Level(*(np.frombuffer(x, "<i4") for x in level)) for level in zip(one("nodes"), one("edges"), one("near"), strict=True)]
        self.entry = one("entry")
        return self


def shard_schema(key: T.DataType) -> T.StructType:
    out = T.StructType().add("shard", T.LongType()).add("n", T.IntegerType()).add("alive", T.IntegerType()).add("dims", T.IntegerType()).add("entry", T.IntegerType()).add("keys", T.ArrayType(key))
    for name in ("vectors", "removed"):
        out = out.add(name, T.BinaryType())
    for name in ("nodes", "edges", "near"):
        out = out.add(name, T.ArrayType(T.BinaryType()))
    return out


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _mark(m: np.ndarray) -> list[int]:
    """A hash of each row, by which a stored vector and a table's are compared."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in m.astype("<f8")]


@dataclass
class HnswIndex:
    """count: the number of shards. shards: their rows, those of later changes in place of earlier ones."""

    field: VectorField
    key: str
    kind: T.DataType
    count: int
    shards: DataFrame

    @property
    def n(self) -> int:
        """Rows that can be found."""
        return self.shards.agg(F.sum("alive")).first()[0] or 0

    @classmethod
    def build(cls, df: DataFrame, key: str, field: VectorField, path: str, shard_rows: int = SHARD_ROWS) -> HnswIndex:
        """Writes the shards' graphs to path, with a record of the parameters they were made with."""
        own = cls._rows(df, key, field)
        kind = df.schema[key].dataType
        count = max(1, -(-own.count() // max(1, min(shard_rows, SHARD_BYTES // (8 * field.dims)))))
        spec, schema = field.index, shard_schema(kind)
        arrow = _arrow(schema)

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("_k")
            number = table["shard"][0].as_py()
            graph = Graph(spec.m, field.resolved, SEED + number).add(matrix(field, _whole(table["_v"])))
            return graph.row(number, _whole(table["_k"]), arrow)

        shards = own.withColumn("shard", cls._dealt(count)).groupBy("shard").applyInArrow(run, schema)
        cls._tagged(shards, field, count).write.mode("overwrite").parquet(path)
        return cls.load(df.sparkSession, key, field, path, kind)

    @staticmethod
    def _rows(df: DataFrame, key: str, field: VectorField) -> DataFrame:
        return df.where(searchable(F.col(field.name))).select(F.col(key).alias("_k"), prepared(field).alias("_v"))

    @staticmethod
    def _dealt(count: int):
        return F.pmod(F.xxhash64("_k"), F.lit(count)).cast("long")

    @classmethod
    def _tagged(cls, shards: DataFrame, field: VectorField, count: int) -> DataFrame:
        return shards.withColumns({"made_with": F.lit(cls.made_with(field)), "count": F.lit(count)})

    @staticmethod
    def made_with(field: VectorField) -> str:
        spec = field.index
        return json.dumps([field.resolved.name, field.effective or field.dims, spec.m, spec.ef_construction])

    @classmethod
    def load(cls, spark: SparkSession, key: str, field: VectorField, path: str, kind: T.DataType | None = None) -> HnswIndex:
        """The index in path; an error if it was made with other parameters, so that it has to be rebuilt."""
        shards = spark.read.parquet(path)
        first = shards.select("made_with", "count").limit(1).collect()
        if first and first[0]["made_with"] != cls.made_with(field):
            raise ValueError(f"the index was made with {first[0]['made_with']}, not {cls.made_with(field)}")
        return cls(field, key, kind or shards.schema["keys"].dataType.elementType, first[0]["count"] if first else 1, shards.drop("made_with", "count"))

    def save(self, path: str) -> None:
        self._tagged(self.shards, self.field, self.count).write.parquet(path)

    # changes

    def updated(self, keys: DataFrame, rows: DataFrame, shard_rows: int = SHARD_ROWS) -> HnswIndex:
        """The index after the rows of keys have gone, and those of them that are in rows, a table, have come (again).
        Only the shards that they fall into are written; the number of shards is what reaches the driver."""
        keys = keys.select(F.col(self.key).alias("_k")).distinct()
        new = self._rows(rows, self.key, self.field).join(keys, "_k", "left_semi")
        changes = keys.select("_k", F.lit(None).cast("array<double>").alias("_v")).unionByName(new).withColumn("shard", self._dealt(self.count))
        changes = stored(changes, "changes")
        touched = [r["shard"] for r in changes.select("shard").distinct().collect()]
        if not touched:
            return self
        spark, field, spec = rows.sparkSession, self.field, self.field.index
        schema = shard_schema(self.kind)
        arrow, most = _arrow(schema), GROWN * shard_rows

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            number = (left if left.num_rows else right)["shard"][0].as_py()
            graph = Graph(spec.m, field.resolved, SEED + number + (left["n"][0].as_py() if left.num_rows else 0))
            names = _whole(right["_k"]).slice(0, 0)
            known = names
            if left.num_rows:
                graph.load(left)
                known = _whole(left["keys"]).flatten().cast(names.type)
            graph.removed = graph.removed | pc.is_in(known, value_set=_whole(right["_k"])).to_numpy(zero_copy_only=False)
            came = right.filter(pc.is_valid(right["_v"])).sort_by("_k")
            if came.num_rows:
                names = _whole(came["_k"])
            vectors = matrix(field, _whole(came["_v"])) if came.num_rows else np.empty((0, field.effective or field.dims))
            if graph.removed.sum() > REMOVED * (len(known) + len(names)):
                alive = np.flatnonzero(~graph.removed)
                old, names = graph.vectors[alive], pa.concat_arrays([known.take(pa.array(alive)), names])
                graph, known = Graph(spec.m, field.resolved, SEED + number), names.slice(0, 0)
                vectors = np.concatenate([old, vectors]) if len(old) else vectors
            if len(names):
                graph.add(vectors)
            return graph.row(number, pa.concat_arrays([known, names]), arrow)

        old = self.shards.where(F.col("shard").isin(touched))
        path = fresh_path(spark, "hnsw")
        old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(run, schema).write.parquet(path)
        now = self.shards.where(~F.col("shard").isin(touched)).unionByName(spark.read.schema(schema).parquet(path))
        out = HnswIndex(field, self.key, self.kind, self.count, now)
        if now.where(F.col("n") > most).limit(1).collect():  # dealt anew to more shards
            return HnswIndex.build(rows, self.key, field, fresh_path(spark, "hnsw"), shard_rows)
        return out

    def held(self) -> DataFrame:
        """_k and _h, a hash of its vector, of each row that can be found."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    one = lambda name, row=row: row.column(name)[0].as_py()
                    alive = np.flatnonzero(np.frombuffer(one("removed"), np.uint8) == 0)
                    m = np.frombuffer(one("vectors"), "<f8").reshape(one("n"), one("dims"))[alive]
                    yield pa.RecordBatch.from_arrays([row.column("keys").flatten().take(pa.array(alive)).cast(kind), pa.array(_mark(m), pa.int64())], names=["_k", "_h"])

        schema = T.StructType().add("_k", self.kind).add("_h", T.LongType())
        kind = _arrow(schema).field("_k").type
        return self.shards.select("n", "dims", "keys", "vectors", "removed").mapInArrow(run, schema)

    def reconciled(self, rows: DataFrame) -> HnswIndex:
        """The index as it should be for the table's rows: what it has and the table hasn't goes, what it lacks or has
        with another vector comes."""
        field = self.field

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_mark(matrix(field, batch.column(1))), pa.int64())], names=["_k", "_h"])

        table = self._rows(rows, self.key, field).mapInArrow(run, T.StructType().add("_k", self.kind).add("_h", T.LongType()))
        both = self.held().withColumnRenamed("_h", "_i").join(table, "_k", "full")
        return self.updated(stored(both.where(~F.col("_h").eqNullSafe(F.col("_i"))).select(F.col("_k").alias(self.key)), "changed"), rows)

    # search

    def _found(self, ids: list, vectors: list[list[float]], each: int, wide: int) -> DataFrame:
        """_i, _k and similarity: for each query, by its place, the best of each task's shards."""
        field, q = self.field, np.array(vectors, float).reshape(len(ids), -1)
        sent = self.shards.sparkSession.sparkContext.broadcast(q)
        schema = T.StructType().add("_i", T.LongType()).add("_k", self.kind).add(SCORE, T.DoubleType())
        kind = _arrow(schema).field("_k").type

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Nearest(field.resolved, sent.value, each)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    Graph(field.index.m, field.resolved, 0).load(row).search(near, row.column("keys").flatten().cast(kind), wide)
            yield from near.batch()

        return self.shards.mapInArrow(run, schema)

    def topk(self, q: Vector, k: int, live: DataFrame | None = None, ef: int | None = None) -> DataFrame:
        """key and similarity of k near rows. live: rows whose keys still count; others are dropped after each shard has
        found ef of its own."""
        if k <= 0:
            raise ValueError(f"k must be positive, not {k}")
        wide = max(ef or self.field.index.ef_search, k)
        hits = self._found([0], [query_of(self.field, q)], k if live is None else wide, wide).select(F.col("_k").alias(self.key), SCORE)
        if live is not None:
            hits = hits.join(live.select(self.key), self.key, "left_semi")
        return hits.orderBy(*ordering(self.key)).limit(k)

    def batch_topk(self, queries: DataFrame, query_key: str, query_vector: str, k: int, ef: int | None = None) -> DataFrame:
        """query_key, key, similarity and rank (from 1) of k near rows for each query. Each block of queries opens a shard
        once."""
        if k <= 0:
            raise ValueError(f"k must be positive, not {k}")
        wide = max(ef or self.field.index.ef_search, k)
        return batches_of(queries, query_key, query_vector, self.field, lambda ids, vectors: merged(self._found(ids, vectors, k, wide), ids, queries.schema[query_key].dataType, k), self.kind, self.key)

    def threshold(self, q: Vector, least: float) -> DataFrame:
        """Of the max(ef_search, n // 10) nearest rows those that reach least, in order."""
        return self.topk(q, max(self.field.index.ef_search, self.n // 10)).where(F.col(SCORE) >= least).orderBy(*ordering(self.key))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
