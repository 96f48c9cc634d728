"""Inverted-file index: rows are assigned to the nearest of some centroids, and a query scans the lists of the nearest few.

Centroids are learned from a sample that has some rows for each of them, by Lloyd's steps with the field's own metric: on
the driver after k-means++ where its bytes are few, and otherwise by a job for each step, in which tasks sum up the rows
nearest to each centroid. Every row is then assigned, new ones as they come. The index is a table in order of cluster_id,
so that a query's list of clusters prunes files and row groups; changes stand beside it until there are several.
"""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import Vector
from ..functions.prepare import searchable
from ..plans.schema import VectorField
from ..plans.session import fresh_path, stored
from .search import SCORE, Nearest, batches_of, matrix, merged, ordering, prepared, query_of, score

#: Rows that centroids are learned from, more where a centroid has fewer than PER_CLUSTER; and Lloyd's steps at most.
SAMPLE_ROWS, PER_CLUSTER, STEPS, SEED = 50_000, 64, 50, 42
#: Bytes of a sample that is learned from on the driver, and steps of jobs at most.
LOCAL_BYTES, JOBS = 128 << 20, 12
#: Changes after which the index table is written anew; and how often its rows may double before centroids are, too.
CHANGES, GROWN = 8, 4
#: Rows by which the number of lists to look at is measured, the k for a search without one, and the share of changed rows
#: after which it is measured again.
PROBED, FOUND, MOVED = 256, 10, 0.1
CLUSTER = "cluster_id"


def _likeness(field: VectorField, m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rows by centroids. For choosing centroids Euclidean distance comes from a product, too."""
    metric = field.resolved
    if metric.normalised or metric.name == "dot":
        return m @ c.T
    if metric.name == "euclidean":
        gap = np.einsum("ij,ij->i", m, m)[:, None] + np.einsum("ij,ij->i", c, c) - 2 * (m @ c.T)
        return 1 / (1 + np.sqrt(np.maximum(gap, 0)))
    return metric.kernel(m, c)


def _blocks(field: VectorField, m: np.ndarray, c: np.ndarray) -> Iterator[np.ndarray]:
    """The same for a block of rows at a time."""
    flat = field.resolved.normalised or field.resolved.name in {"dot", "euclidean"}
    step = max(1, (1 << 22) // max(1, len(c) if flat else c.size))
    for i in range(0, len(m), step):
        yield _likeness(field, m[i : i + step], c)


def _nearest(field: VectorField, m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(np.argmax(x, axis=1) for x in _blocks(field, m, c))])


def _summed(m: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum and the number of the rows of each centroid."""
    order, count = np.argsort(own, kind="stable"), np.bincount(own, minlength=k)
    sums, on = np.zeros((k, m.shape[1])), np.flatnonzero(count)
    if len(on):
        sums[on] = np.add.reduceat(m[order], (np.cumsum(count) - count)[on])
    return sums, count


def learn(field: VectorField, m: np.ndarray, clusters: int) -> np.ndarray:
    """Centroids of rows m: means of the rows nearest by the metric; one without rows stays."""
    rng, k = np.random.default_rng(SEED), min(clusters, len(m))
    chosen = [int(rng.integers(len(m)))]
    gap, size = np.full(len(m), np.inf), np.einsum("ij,ij->i", m, m)
    for _ in range(k - 1):
        gap = np.minimum(gap, np.maximum(size + size[chosen[-1]] - 2 * (m @ m[chosen[-1]]), 0))
        gap[chosen[-1]] = 0
        chosen.append(int(rng.choice(len(m), p=gap / gap.sum())) if gap.sum() > 0 else int(rng.integers(len(m))))
    c, before = m[chosen].copy(), None
    for _ in range(STEPS):
        own = _nearest(field, m, c)
        if before is not None and (own == before).all():
            break
        before, (sums, count) = own, _summed(m, own, k)
        c[count > 0] = sums[count > 0] / count[count > 0, None]
    return c


def learn_in_jobs(field: VectorField, vectors: DataFrame, clusters: int) -> np.ndarray:
    """The same from vectors (_k, _v), a stored table; the first centroids are rows chosen by a hash. What reaches the
    driver at each step is a sum for each centroid."""
    first = vectors.orderBy(F.xxhash64("_k", F.lit(SEED)), "_k").limit(clusters).select("_v").toArrow()["_v"]
    c, before = matrix(field, first.combine_chunks()).copy(), None
    for _ in range(JOBS):
        sent = vectors.sparkSession.sparkContext.broadcast(c)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            c = sent.value
            sums, count, far = np.zeros_like(c), np.zeros(len(c), np.int64), 0.0
            for b in batches:
                m = matrix(field, b.column(0))
                far += sum(float(x.max(axis=1).sum()) for x in _blocks(field, m, c))
                more, n = _summed(m, _nearest(field, m, c), len(c))
                sums, count = sums + more, count + n
            on = np.flatnonzero(count)
            like = np.zeros(len(on))
            like[:1] = far
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(count[on]), pa.array(list(sums[on]), pa.list_(pa.float64())), pa.array(like)], names=["c", "n", "s", "far"])

        def add(t: pa.Table) -> pa.Table:
            total = np.array(t["s"].to_pylist()).sum(axis=0)
            return pa.table({"c": t["c"][:1], "n": pa.array([sum(t["n"].to_pylist())]), "s": pa.array([total.tolist()]), "far": pa.array([sum(t["far"].to_pylist())])})

        schema = "c long, n long, s array<double>, far double"
        got = vectors.select("_v").mapInArrow(run, schema).groupBy("c").applyInArrow(add, schema).toArrow()
        sent.unpersist()
        at, n = got["c"].to_numpy(), got["n"].to_numpy()
        c[at] = np.array(got["s"].to_pylist()) / n[:, None]
        far = float(got["far"].to_numpy().sum())
        if before is not None and abs(far - before) <= 1e-4 * abs(before):
            break
        before = far
    return c


@dataclass
class IvfIndex:
    """rows: the searchable rows of the table with cluster_id. trained: the number of rows when centroids were learned;
    changes: those since the index table was written. measured: lists that a search looks at, by k; moved: keys that have
    changed since."""

    field: VectorField
    key: str
    centroids: np.ndarray
    rows: DataFrame
    trained: int = 0
    changes: int = 0
    measured: dict[int, int] = dataclasses.field(default_factory=dict)
    moved: int = 0

    @classmethod
    def build(cls, df: DataFrame, key: str, field: VectorField, path: str | None = None, sample_rows: int = SAMPLE_ROWS) -> IvfIndex:
        """The number of clusters is the field's, or the root of the number of searchable rows. With path, the rows are
        written there in order of cluster."""
        own = df.where(searchable(F.col(field.name)))
        n = own.count()
        k = field.index.clusters or max(1, math.isqrt(n))
        vectors, dims = own.select(F.col(key).alias("_k"), prepared(field).alias("_v")), field.effective or field.dims
        want = max(sample_rows, PER_CLUSTER * k)
        if n > want:
            vectors = vectors.where(F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) < int((1 << 30) * want / n))
        if not n:
            centroids = np.empty((0, dims))
        elif 8 * dims * min(n, want) > LOCAL_BYTES:
            centroids = learn_in_jobs(field, stored(vectors, "sample"), k)
        else:
            m = matrix(field, vectors.orderBy("_k").select("_v").toArrow()["_v"].combine_chunks())
            centroids = learn(field, m, k) if len(m) else np.empty((0, dims))
        index = cls(field, key, centroids, own, n)
        index.rows = index.assign(own)
        if path:
            index._write(path)
        return index

    def _write(self, path: str) -> None:
        self.rows.repartitionByRange(CLUSTER).sortWithinPartitions(CLUSTER).write.mode("overwrite").parquet(path)
        self.rows, self.changes = self.rows.sparkSession.read.schema(self.rows.schema).parquet(path), 0

    def updated(self, keys: DataFrame, rows: DataFrame) -> IvfIndex:
        """The index after the rows of keys have gone, and those of them that are in rows, a table, have come (again). The
        new ones are assigned to the centroids that there are; these are learned anew when there are GROWN times the
        rows."""
        keys = stored(keys.select(self.key).distinct(), "changes")
        new = stored(self.assign(rows.where(searchable(F.col(self.field.name))).join(keys, self.key, "left_semi").select(*rows.columns)), "assigned")
        out = IvfIndex(self.field, self.key, self.centroids, self.rows.join(keys, self.key, "left_anti").unionByName(new), self.trained, self.changes + 1)
        out.moved = self.moved + keys.count()
        if out.moved <= MOVED * self.trained:
            out.measured = dict(self.measured)
        else:
            out.moved = 0
        if out.changes >= CHANGES or not len(self.centroids):
            path = fresh_path(rows.sparkSession, "ivf")
            if rows.count() > GROWN * self.trained:
                return IvfIndex.build(rows, self.key, self.field, path)
            out._write(path)
        return out

    @staticmethod
    def made_with(field: VectorField) -> str:
        return json.dumps([field.resolved.name, field.effective or field.dims, field.index.clusters])

    def save(self, path: str) -> None:
        """The centroids; rows are assigned when the index is loaded."""
        spark = self.rows.sparkSession
        spark.createDataFrame([(i, x.tolist(), self.trained, self.made_with(self.field)) for i, x in enumerate(self.centroids)], "id int, centroid array<double>, trained long, made_with string").write.parquet(path)

    @classmethod
    def load(cls, df: DataFrame, key: str, field: VectorField, path: str, to: str) -> IvfIndex:
        """The index whose centroids are in path, over the rows of df, written to to; an error if it was made with other
        parameters."""
        got = df.sparkSession.read.parquet(path).orderBy("id").collect()
        if got and got[0]["made_with"] != cls.made_with(field):
            raise ValueError(f"the index was made with {got[0]['made_with']}, not {cls.made_with(field)}")
        centroids = np.array([r["centroid"] for r in got], float).reshape(len(got), field.effective or field.dims)
        own = df.where(searchable(F.col(field.name)))
        index = cls(field, key, centroids, own, got[0]["trained"] if got else 0)
        index.rows = index.assign(own)
        index._write(to)
        return index

    def assign(self, df: DataFrame) -> DataFrame:
        """df with the nearest centroid's number."""
        names, field = df.columns, self.field
        if not len(self.centroids):
            return df.withColumn(CLUSTER, F.lit(0))
        held = df.sparkSession.sparkContext.broadcast(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = matrix(field, b.column(b.num_columns - 1))
                near = _nearest(field, m, held.value)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(near.astype(np.int32))], names=[*names, CLUSTER])

        rows = df.withColumn("_v", prepared(field))
        return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(CLUSTER, T.IntegerType())]))

    def nearest(self, q: Vector, probes: int) -> list[int]:
        return self._order(np.asarray(query_of(self.field, q))[None], probes)[0].tolist()

    def _order(self, q: np.ndarray, probes: int) -> np.ndarray:
        """For each prepared query the numbers of the nearest centroids, in order."""
        if not len(self.centroids):
            return np.empty((len(q), 0), np.int64)
        return np.concatenate([np.argsort(-x, axis=1, kind="stable")[:, :probes] for x in _blocks(self.field, q, self.centroids)])

    def lists(self, k: int) -> int:
        """How many lists a search for k rows looks at: the field's number, or as many more as hold the field's share of
        the k rows nearest to PROBED rows of the index, against all of them. It is measured when it is first asked for,
        by one pass over the rows, and again when a MOVED share of them has changed."""
        spec, n = self.field.index, len(self.centroids)
        if spec.recall is None or n <= spec.probes:
            return spec.probes
        if k not in self.measured:
            self.measured[k] = max(spec.probes, self._needed(k, spec.recall))
        return self.measured[k]

    def _needed(self, k: int, share: float) -> int:
        field, key = self.field, F.col(self.key)
        rows = self.rows.select(self.key, CLUSTER, prepared(field).alias("_v"))
        chosen = rows.select("_v", F.xxhash64(key, F.lit(SEED)).alias("_h"), key.alias("_k")).orderBy("_h", "_k").limit(PROBED).select("_v").toArrow()["_v"].combine_chunks()
        if not len(chosen):
            return 1
        q = matrix(field, chosen)
        order = self._order(q, len(self.centroids))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
        sent = self.rows.sparkSession.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Nearest(field.resolved, sent.value, k + 1)
            for b in batches:
                near.add(b.column(0).cast(pa.int64()), matrix(field, b.column(1)))
            yield from near.batch()

        schema = T.StructType().add("_i", T.LongType()).add("_k", T.LongType()).add(SCORE, T.DoubleType())
        got = rows.select(CLUSTER, "_v").mapInArrow(run, schema).toArrow()
        at, cluster, s = (got[c].to_numpy() for c in ("_i", "_k", SCORE))
        best = np.lexsort((-s, at))
        each = np.bincount(at, minlength=len(q))
        rank = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        on = best[(rank > 0) & (rank <= k)]  # the nearest is the row itself
        if not len(on):
            return 1
        places = np.sort(place[at[on], cluster[on]])
        return int(places[min(len(places), math.ceil(share * len(places))) - 1]) + 1

    def _lists(self, q: Vector, probes: int) -> DataFrame:
        rows = self.rows.where(F.col(CLUSTER).isin(self.nearest(q, probes)))
        return rows.withColumn(SCORE, score(self.field, query_of(self.field, q))).drop(CLUSTER)

    def topk(self, q: Vector, k: int, probes: int | None = None) -> DataFrame:
        """Of the rows in the probed lists the k most similar."""
        if k <= 0:
            raise ValueError(f"k must be positive, not {k}")
        return self._lists(q, probes or self.lists(k)).orderBy(*ordering(self.key)).limit(k)

    def batch_topk(self, queries: DataFrame, query_key: str, query_vector: str, k: int, probes: int | None = None) -> DataFrame:
        """query_key, key, similarity and rank (from 1): of the rows in each query's probed lists the k most similar."""
        if k <= 0:
            raise ValueError(f"k must be positive, not {k}")
        run = lambda ids, vectors: merged(self._probed(vectors, k, probes or self.lists(k)), ids, queries.schema[query_key].dataType, k)
        return batches_of(queries, query_key, query_vector, self.field, run, self.rows.schema[self.key].dataType, self.key)

    def _probed(self, vectors: list[list[float]], k: int, probes: int) -> DataFrame:
        """_i, _k and similarity: the best k of each task's lists, for the queries that probe them."""
        field, q = self.field, np.array(vectors)
        order = self._order(q, probes)
        to = np.argsort(order.ravel(), kind="stable")
        clusters, starts = np.unique(order.ravel()[to], return_index=True)
        wanted = dict(zip(clusters.tolist(), np.split((to // max(1, order.shape[1])).astype(np.int32), starts[1:]), strict=False))
        sent = self.rows.sparkSession.sparkContext.broadcast((q, wanted))
        schema = T.StructType().add("_i", T.LongType()).add("_k", self.rows.schema[self.key].dataType).add(SCORE, T.DoubleType())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, wanted = sent.value
            near = Nearest(field.resolved, q, k)
            for b in batches:
                cluster, m = b.column(1).to_numpy(), matrix(field, b.column(2))
                for c in np.unique(cluster).tolist():
                    rows = np.flatnonzero(cluster == c)
                    near.add(b.column(0).take(pa.array(rows)), m[rows], wanted[c])
            yield from near.batch()

        rows = self.rows.where(F.col(CLUSTER).isin(list(wanted))).select(self.key, CLUSTER, prepared(field).alias("_v"))
        return rows.mapInArrow(run, schema)

    def threshold(self, q: Vector, least: float, probes: int | None = None) -> DataFrame:
        """Rows that reach least, in no order, from twice as many lists as topk() looks at."""
        if math.isnan(least):
            raise ValueError("the threshold is no number")
        return self._lists(q, 2 * (probes or self.lists(FOUND))).where(F.col(SCORE) >= least)
