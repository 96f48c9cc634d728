"""Similarity metrics as Column expressions over arrays, and as numpy kernels over a block of rows.

Every score is a similarity: higher is closer, distances as 1 / (1 + d). Sums are in double. What a metric needs of one
side alone (norm, mean) is a column of its own, so that no lambda holds an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[float] | tuple[float, ...] | np.ndarray


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(q: Vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in q]) if len(q) else F.array().cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of each two elements; null for a null, and an error where the lengths differ."""
    other = F.raise_error(F.lit("vectors of different lengths")).cast("array<double>")
    return F.zip_with(a, F.when(F.size(a) != F.size(b), other).otherwise(b), f)


def dot(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: x * y))


def plain_dot(a: Column, b: Column) -> Column:
    """Without the check, for a search: Spark may score a row before it leaves it out for having no vector."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(zipped(a, b, lambda x, y: (x - y) * (x - y))))


def _plain_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def max_magnitude(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x)))


def added(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x + y)


def divided(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x / F.lit(float(by)))


def _known(value: Column, otherwise: float) -> Column:
    """value, or otherwise where a division by 0 makes it null."""
    return F.coalesce(value, F.lit(otherwise))


def _cosine(a: Column, b: Column) -> Column:
    return _known(F.try_divide(plain_dot(a, b), norm(a) * norm(b)), 0.0)


def _euclidean(a: Column, b: Column) -> Column:
    return 1 / (1 + _plain_distance(a, b))


def _manhattan(a: Column, b: Column) -> Column:
    return 1 / (1 + total(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def _chebyshev(a: Column, b: Column) -> Column:
    return 1 / (1 + F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0)))


def _pearson(a: Column, b: Column) -> Column:
    # sums of powers, so that no mean is inside a lambda: n*sxy - sx*sy over the root of both variances
    n, sa, sb = F.size(a), total(a), total(b)
    va, vb = n * plain_dot(a, a) - sa * sa, n * plain_dot(b, b) - sb * sb
    tiny = F.lit(1e-12)
    flat = (va <= tiny * n * plain_dot(a, a)) | (vb <= tiny * n * plain_dot(b, b))
    return F.when(flat, 0.0).otherwise(_known(F.try_divide(n * plain_dot(a, b) - sa * sb, F.sqrt(va) * F.sqrt(vb)), 0.0))


def _hamming(a: Column, b: Column) -> Column:
    same = total(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)))
    return _known(F.try_divide(same, F.size(a)), 1.0)


def _jaccard(a: Column, b: Column) -> Column:
    low, high = total(F.zip_with(a, b, lambda x, y: F.least(x, y))), total(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return F.when(high <= 0, 1.0).otherwise(low / high)


def _canberra(a: Column, b: Column) -> Column:
    part = total(F.zip_with(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, 0.0).otherwise(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)))))
    return _known(1 - F.try_divide(part, F.size(a)), 1.0)


def _rows_norm(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m))


def _k_cosine(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = np.outer(_rows_norm(m), _rows_norm(q))
    return np.divide(m @ q.T, d, out=np.zeros((len(m), len(q))), where=d > 0)


def _k_euclidean(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.sqrt(((m[:, None, :] - q[None]) ** 2).sum(axis=2)))


def _k_pearson(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    return _k_cosine(m - m.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True))


def _k_jaccard(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    low, high = np.minimum(m[:, None, :], q[None]).sum(axis=2), np.maximum(m[:, None, :], q[None]).sum(axis=2)
    return np.where(high <= 0, 1.0, low / np.where(high <= 0, 1.0, high))


def _k_canberra(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    d, s = np.abs(m[:, None, :] - q[None]), np.abs(m)[:, None, :] + np.abs(q)[None]
    return 1 - np.divide(d, s, out=np.zeros_like(d), where=s > 0).mean(axis=2)


@dataclass(frozen=True)
class Metric:
    """column(a, b): over two array<double>; kernel(rows, queries): a matrix of scores. normalised: vectors are stored
    with norm 1, and scored by their dot product."""

    name: str
    column: Callable[[Column, Column], Column]
    kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]
    normalised: bool = False


METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("cosine", _cosine, _k_cosine, normalised=True),
        Metric("dot", plain_dot, lambda m, q: m @ q.T),
        Metric("euclidean", _euclidean, _k_euclidean),
        Metric("manhattan", _manhattan, lambda m, q: 1 / (1 + np.abs(m[:, None, :] - q[None]).sum(axis=2))),
        Metric("chebyshev", _chebyshev, lambda m, q: 1 / (1 + np.abs(m[:, None, :] - q[None]).max(axis=2))),
        Metric("pearson", _pearson, _k_pearson),
        Metric("hamming", _hamming, lambda m, q: (m[:, None, :] == q[None]).mean(axis=2)),
        Metric("jaccard", _jaccard, _k_jaccard),
        Metric("canberra", _canberra, _k_canberra),
    )
}


def custom(name: str, column: Callable[[Column, Column], Column] | None = None, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Metric:
    """A metric of the caller's: an expression over two array<double>, or a numpy kernel over rows and queries, or both.
    Its vectors are not normalised. It is not registered under its name; a field holds the metric itself."""
    if column is None and kernel is None:
        raise TypeError("a custom metric needs a column expression or a kernel")
    if column is None:
        @F.pandas_udf("double")
        def score(a: pd.Series, b: pd.Series) -> pd.Series:
            out = np.empty(len(a))
            if len(a) and a.map(len).nunique() == 1 and b.map(len).nunique() == 1:
                rows, other = np.stack(a.to_list()), np.stack(b.to_list())
                if (other == other[0]).all():  # one query: a call for each batch
                    return pd.Series(np.asarray(kernel(rows, other[:1]), float)[:, 0])
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                out[i] = kernel(np.asarray(x)[None], np.asarray(y)[None])[0, 0]
            return pd.Series(out)

        column = score
    if kernel is None:

        def kernel(_m: np.ndarray, _q: np.ndarray) -> np.ndarray:
            raise TypeError(f"metric {name} has no kernel, which batch search needs")

    return Metric(name, column, kernel)


def resolve(metric: str | Metric) -> Metric:
    if isinstance(metric, Metric):
        return metric
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known are {sorted(METRICS)}")
    return METRICS[metric]
