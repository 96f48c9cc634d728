"""Similarity search as plans: top-k, filtered top-k, threshold, top-1, and top-k of many queries.

A single query is a projection, a sort and a limit, which Spark runs as a bounded heap in each task and a merge of k
rows from each. Order is by similarity, NaN last, then key, so that ties are settled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import Metric, Vector, doubles, literal, norm, plain_dot
from ..functions.prepare import half, prepare_query, searchable, sq8_codes, sq8_decoded, sq8_scale, truncated
from ..plans.schema import VectorField
from ..plans.session import stored

SCORE = "similarity"
#: Bytes of query vectors that are held at once by each task of a batch search; more queries are searched in blocks.
QUERY_BLOCK_BYTES = 8 << 20
#: Rows that a batch search scores at once, and scores that it holds at once.
SCORE_ROWS, SCORE_CELLS = 4096, 1 << 22


def prepared(field: VectorField) -> Column:
    """The stored vector as it is compared, but for normalisation: truncated, rounded or decoded, in doubles."""
    v = doubles(truncated(F.col(field.name), field.effective))
    if field.half:
        v = half(v)
    if field.quantised:
        v = sq8_decoded(sq8_codes(v, sq8_scale(v)), sq8_scale(v))
    return v


def score(field: VectorField, q: Vector) -> Column:
    """Similarity of a row's vector to q, a query that is prepared."""
    metric, target = field.resolved, literal(q)
    if metric.normalised:  # the query has norm 1, and a zero vector stays zero
        return F.coalesce(F.try_divide(plain_dot(prepared(field), target), norm(prepared(field))), F.lit(0.0))
    return metric.column(prepared(field), target)


def query_of(field: VectorField, q: Vector) -> list[float]:
    own = prepare_query(q, field.dims, field.effective, field.resolved.normalised)
    return np.asarray(own, np.float16).astype(float).tolist() if field.half and not field.resolved.normalised else own


def scored(df: DataFrame, field: VectorField, q: Vector) -> DataFrame:
    """The searchable rows with their similarity."""
    return df.where(searchable(F.col(field.name))).withColumn(SCORE, score(field, query_of(field, q)))


def ordering(key: str, by: str = SCORE) -> list[Column]:
    return [F.isnan(by).asc(), F.col(by).desc(), F.col(key).asc()]


def _positive(value: int, name: str) -> int:
    if value <= 0:
        raise ValueError(f"{name} must be positive, not {value}")
    return value


def topk(df: DataFrame, key: str, field: VectorField, q: Vector, k: int) -> DataFrame:
    """The k most similar rows, fewer if there are fewer searchable ones, in order."""
    _positive(k, "k")
    return scored(df, field, q).orderBy(*ordering(key)).limit(k)


def topk_filtered(df: DataFrame, key: str, field: VectorField, q: Vector, k: int, predicate: Column | str, over_fetch: int = 4) -> DataFrame:
    """Of the k * over_fetch most similar rows those that satisfy predicate, k at most: fewer may come out than the table
    has. topk() over a filtered table is the complete way."""
    _positive(k, "k"), _positive(over_fetch, "over_fetch")
    near = scored(df, field, q).orderBy(*ordering(key)).limit(k * over_fetch)
    return near.where(predicate).orderBy(*ordering(key)).limit(k)


def threshold(df: DataFrame, field: VectorField, q: Vector, least: float) -> DataFrame:
    """All rows whose similarity is least or more, in no order."""
    if least is None or math.isnan(least):
        raise ValueError("the threshold is no number")
    return scored(df, field, q).where(~F.isnan(SCORE) & (F.col(SCORE) >= float(least)))


def threshold_truncated(df: DataFrame, key: str, field: VectorField, q: Vector, least: float, ef_search: int = 50) -> DataFrame:
    """A graph index's threshold search on exact scores: of the max(ef_search, n // 10) most similar rows those that reach
    least, in order."""
    if least is None or math.isnan(least):
        raise ValueError("the threshold is no number")
    n = df.where(searchable(F.col(field.name))).count()
    return topk(df, key, field, q, max(ef_search, n // 10)).where(F.col(SCORE) >= float(least)).orderBy(*ordering(key))


def top1(df: DataFrame, key: str, field: VectorField, q: Vector) -> DataFrame:
    """The most similar row, or none."""
    return topk(df, key, field, q, 1)


def materialised(df: DataFrame, key: str, hits: DataFrame) -> DataFrame:
    """The rows of df for hits (key, similarity), with their similarity; hits whose row is gone are dropped. hits are k
    rows, so that Spark broadcasts them by their size."""
    return df.join(hits.select(key, SCORE), key).orderBy(*ordering(key))


def late_topk(df: DataFrame, key: str, field: VectorField, q: Vector, k: int) -> DataFrame:
    """topk() that reads the other columns, payloads among them, for the k hits alone."""
    return materialised(df, key, topk(df.select(key, field.name), key, field, q, k).select(key, SCORE))


def batch_topk(df: DataFrame, key: str, field: VectorField, queries: DataFrame, query_key: str, query_vector: str, k: int) -> DataFrame:
    """query_key, key, similarity and rank (from 1) of the k most similar rows for each query.

    Queries go to the tasks in blocks of QUERY_BLOCK_BYTES at most, one pass over df for each. A task scores its rows by
    one matrix product a batch where the metric allows it, keeps the best k of each query, and hands on k rows a query; a
    window merges them.
    """
    _positive(k, "k")
    kind = queries.schema[query_key].dataType
    return batches_of(queries, query_key, query_vector, field, lambda ids, vectors: merged(_batch(df, key, field, vectors, k), ids, kind, k), df.schema[key].dataType, key)


def batches_of(queries: DataFrame, query_key: str, query_vector: str, field: VectorField, run: Callable[[list, list[list[float]]], DataFrame], key_type: T.DataType, key: str) -> DataFrame:
    """What run gives for the queries: at once, or block by block, with only one block on the driver and broadcast at a
    time, and its outcome stored."""
    own = queries.select(F.col(query_key).alias("_q"), doubles(F.col(query_vector)).alias("_v")).where(searchable(F.col("_v")))
    per = max(1, QUERY_BLOCK_BYTES // (8 * field.dims))
    blocks, parts = max(1, -(-own.count() // per)), []
    for b in range(blocks):
        block = own if blocks == 1 else own.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b)
        rows = block.orderBy("_q").collect()
        if rows:
            part = run([r["_q"] for r in rows], [query_of(field, r["_v"]) for r in rows])
            parts.append(part if blocks == 1 else stored(part, "batch"))
    if not parts:
        schema = T.StructType([T.StructField("_q", queries.schema[query_key].dataType), T.StructField("_k", key_type), T.StructField(SCORE, T.DoubleType()), T.StructField("rank", T.IntegerType())])
        parts = [queries.sparkSession.createDataFrame([], schema)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.select(F.col("_q").alias(query_key), F.col("_k").alias(key), SCORE, "rank")


def merged(found: DataFrame, ids: list, kind: T.DataType, k: int) -> DataFrame:
    """_q, _k, similarity and rank of the k best for each query, from _i, its place in ids, _k and similarity."""
    rank = F.row_number().over(Window.partitionBy("_i").orderBy(*ordering("_k")))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    # as many names as queries of the block, whose size is bounded
    known = found.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("_i", T.LongType()), T.StructField("_q", kind)]))
    return ranked.join(F.broadcast(known), "_i").select("_q", "_k", SCORE, "rank")


class Nearest:
    """The k best rows of each query, by its place in q, as blocks of rows come; ties go to the smaller key, NaN is last.

    Rows are scored by a matrix product where the metric allows it. Of Euclidean distance the product gives a bound that
    rounding can't pass, and only pairs within it are measured, so that scores are the kernel's own. What a query has no
    use for any more is left out before keys are looked at."""

    def __init__(self, metric: Metric, q: np.ndarray, k: int):
        self.metric, self.q, self.k = metric, q, k
        self.size = np.einsum("ij,ij->i", q, q) if metric.name == "euclidean" else None
        #: Whether single pairs are measured after a product has chosen them.
        self.exact = metric.normalised or metric.name in {"dot", "euclidean"}
        self.least = np.full(len(q), np.inf)  # what the k-th best has, turned over, or more
        self.at, self.down, self.keys = np.empty(0, np.int64), np.empty(0), None
        self.more: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.waiting = 0

    def add(self, keys: pa.Array, m: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Rows m, normalised where the metric wants it, for the queries asked, or all."""
        asked = np.arange(len(self.q)) if asked is None else asked
        kind = "product" if self.metric.normalised or self.metric.name == "dot" else self.metric.name
        cell = 1 if kind in {"product", "euclidean", "pearson"} else m.shape[1]
        rows = max(1, min(SCORE_ROWS, SCORE_CELLS // cell))
        for i in range(0, len(m), rows):
            part, own = m[i : i + rows], keys.slice(i, rows)
            step = max(1, SCORE_CELLS // (cell * len(part)))
            size = np.einsum("ij,ij->i", part, part) if kind == "euclidean" else None
            for j in range(0, len(asked), step):
                to = asked[j : j + step]
                if kind == "product":
                    self.offer(to, self.q[to] @ part.T, own, part)
                elif kind == "euclidean":
                    self._measured(to, part, size, own)
                else:
                    self.offer(to, self.metric.kernel(part, self.q[to]).T, own)

    def _measured(self, to: np.ndarray, m: np.ndarray, size: np.ndarray, keys: pa.Array) -> None:
        """Pairs whose distance may be among the k least, by squares from a product and the error that they may have."""
        gap = self.size[to][:, None] + size - 2 * (self.q[to] @ m.T)
        error = 1e-12 * (self.size[to] + (size.max() if len(size) else 0))
        if not np.isfinite(gap).all() or not np.isfinite(error).all():
            step = max(1, SCORE_CELLS // m.size)
            for own in (to[i : i + step] for i in range(0, len(to), step)):
                self.offer(own, self.metric.kernel(m, self.q[own]).T, keys)
            return
        least = self.least[to]
        most = np.full(len(to), np.inf)
        known = least < 0  # minus 1 / (1 + distance)
        most[known] = (-1 / least[known] - 1) ** 2
        if len(m) > self.k and not known.all():
            most = np.minimum(most, np.partition(gap, self.k - 1, axis=1)[:, self.k - 1] + error)
        i, j = np.nonzero(gap <= (most * (1 + 1e-12) + error)[:, None])
        self._put(to[i], self.pairs(to[i], m, j), keys, j)

    def pairs(self, at: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores of single pairs, turned over: the same for equal rows, wherever they are, as a product's aren't."""
        out, step = np.empty(len(j)), max(1, SCORE_CELLS // m.shape[1])
        for x in range(0, len(j), step):
            a, b = m[j[x : x + step]], self.q[at[x : x + step]]
            out[x : x + step] = -1 / (1 + np.sqrt(((a - b) ** 2).sum(axis=1))) if self.size is not None else -(a * b).sum(axis=1)
        return np.where(np.isnan(out), np.inf, out)

    def offer(self, to: np.ndarray, s: np.ndarray, keys: pa.Array, m: np.ndarray | None = None, where: np.ndarray | None = None) -> None:
        """Scores s of rows for the queries to. m: the rows, if the scores come from a product or a bound and pairs have
        to be measured; where: which of them count."""
        down = np.where(np.isnan(s), np.inf, -s)
        if where is not None:
            down[~where] = np.inf
        most = self.least[to]
        if down.shape[1] > self.k and np.isinf(most).any():
            most = np.minimum(most, np.partition(down, self.k - 1, axis=1)[:, self.k - 1])
        if m is not None:  # what a product may be off by
            most = most + 1e-12 * np.abs(most) + 1e-13 * np.where(np.isfinite(s), np.abs(s), 0).max(axis=1, initial=0)
        on = down <= most[:, None]
        i, j = np.nonzero(on if where is None else on & where)
        self._put(to[i], down[i, j] if m is None else self.pairs(to[i], m, j), keys, j)

    def _put(self, at: np.ndarray, down: np.ndarray, keys: pa.Array, j: np.ndarray) -> None:
        if len(at):
            self.more.append((at, down, keys.take(pa.array(j))))
            self.waiting += len(at)
            if self.waiting > max(1 << 16, len(self.q) * self.k):
                self._settle()

    def _settle(self) -> None:
        if not self.more:
            return
        at, down = np.concatenate([self.at, *(x[0] for x in self.more)]), np.concatenate([self.down, *(x[1] for x in self.more)])
        keys = pa.concat_arrays([*([] if self.keys is None else [self.keys]), *(x[2] for x in self.more)])
        if pa.types.is_integer(keys.type):
            own = keys.to_numpy(zero_copy_only=False)
        else:
            own = np.unique(np.array([*keys.to_pylist(), None], object)[:-1], return_inverse=True)[1]
        order = np.lexsort((own, down, at))
        each = np.bincount(at, minlength=len(self.q))
        rank = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        order, last = order[rank < self.k], order[rank == self.k - 1]
        self.at, self.down, self.keys = at[order], down[order], keys.take(pa.array(order))
        self.least[at[last]] = down[last]
        self.more, self.waiting = [], 0

    def batch(self) -> Iterator[pa.RecordBatch]:
        """_i, _k and similarity, if there are any; what is last is no number."""
        self._settle()
        if self.keys is not None:
            yield pa.RecordBatch.from_arrays([pa.array(self.at), self.keys, pa.array(np.where(self.down == np.inf, np.nan, -self.down))], names=["_i", "_k", SCORE])


def matrix(field: VectorField, v: pa.Array) -> np.ndarray:
    """Prepared vectors as rows, with norm 1 where the metric wants it; a zero vector stays."""
    m = np.asarray(v.flatten(), np.float64).reshape(len(v), field.effective or field.dims)
    if field.resolved.normalised:
        size = np.sqrt(np.einsum("ij,ij->i", m, m))
        m = np.divide(m, size[:, None], out=m.copy(), where=size[:, None] > 0)
    return m


def _batch(df: DataFrame, key: str, field: VectorField, vectors: list[list[float]], k: int) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(np.array(vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(field.resolved, held.value, k)
        for batch in batches:
            near.add(batch.column(0), matrix(field, batch.column(1)))
        yield from near.batch()

    schema = T.StructType([T.StructField("_i", T.LongType()), T.StructField("_k", df.schema[key].dataType), T.StructField(SCORE, T.DoubleType())])
    rows = df.where(searchable(F.col(field.name))).select(F.col(key), prepared(field).alias("_v"))
    return rows.mapInArrow(run, schema)
