import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions.metrics import METRICS, custom, literal, resolve
from vecspark.functions.prepare import half, normalised, prepare_query, sq8_codes, sq8_decoded, sq8_scale

A, B, ZERO = [3.0, 1.0, 4.0, 1.0], [5.0, 9.0, 2.0, 6.0], [0.0] * 4
DOT = 15 + 9 + 8 + 6
CASES = [
    ("cosine", A, B, DOT / math.sqrt(27 * 146)), ("cosine", ZERO, B, 0.0), ("dot", A, B, DOT), ("euclidean", A, B, 1 / (1 + math.sqrt(4 + 64 + 4 + 25))), ("euclidean", A, A, 1.0),
    ("manhattan", A, B, 1 / (1 + 2 + 8 + 2 + 5)), ("chebyshev", A, B, 1 / 9), ("pearson", [1, 2, 3, 4], [2, 4, 6, 8], 1.0), ("pearson", [1, 2, 3, 4], [9, 7, 5, 3], -1.0), ("pearson", [2, 2, 2, 2], B, 0.0),
    ("hamming", A, [3, 1, 4, 2], 0.75), ("hamming", A, B, 0.0), ("jaccard", A, B, (3 + 1 + 2 + 1) / (5 + 9 + 4 + 6)), ("jaccard", ZERO, ZERO, 1.0), ("canberra", A, B, 1 - (2 / 8 + 8 / 10 + 2 / 6 + 5 / 7) / 4), ("canberra", ZERO, ZERO, 1.0),
]


@pytest.mark.parametrize("name,a,b,expected", CASES)
def test_values(spark, name, a, b, expected):
    row = spark.range(1).select(METRICS[name].column(literal(a), literal(b)).alias("s")).first()
    assert row["s"] == pytest.approx(expected, abs=1e-9)
    assert METRICS[name].kernel(np.array([a], float), np.array([b], float))[0, 0] == pytest.approx(expected, abs=1e-9)


def test_columns_and_kernels_agree(spark):
    m = np.random.default_rng(1).normal(size=(20, 6))
    df = spark.createDataFrame([(x.tolist(),) for x in m], "v array<double>")
    for metric in METRICS.values():
        got = [r[0] for r in df.select(metric.column(F.col("v"), literal(m[3]))).collect()]
        assert np.allclose(got, metric.kernel(m, m[3:4])[:, 0], atol=1e-9), metric.name


def test_custom_metrics(spark):
    by_column = custom("first", lambda a, b: a[0] * b[0])
    by_kernel = custom("first", kernel=lambda m, q: m[:, :1] @ q[:, :1].T)
    for m in (by_column, by_kernel):
        assert spark.range(1).select(m.column(literal([2, 3]), literal([5, 7]))).first()[0] == 10
    with pytest.raises(TypeError):
        custom("nothing")
    with pytest.raises(ValueError):
        resolve("unheard of")


def test_preparation(spark):
    row = spark.range(1).select(normalised(literal([3, 4])), normalised(literal([0, 0]))).first()
    assert row[0] == [0.6, 0.8] and row[1] == [0, 0]
    v = literal([1.0, -0.5, 0.25 / 127, 0.0])
    codes = spark.range(1).select(sq8_codes(v, sq8_scale(v)), sq8_decoded(sq8_codes(v, sq8_scale(v)), sq8_scale(v)), sq8_codes(literal([0, 0]), sq8_scale(literal([0, 0])))).first()
    assert codes[0] == [127, -64, 0, 0] and codes[1][0] == 1.0 and codes[2] == [0, 0]


def test_half_precision(spark):
    x = [0.1, -0.2, 1.0, 65504.0, 65519.0, 70000.0, 5.9e-8, 2.0**-25, 6.1e-5, 0.0, 1 / 3, 2047.5, 4097.0, 0.99999]
    got = spark.range(1).select(half(literal(x))).first()[0]
    assert got == np.array(x, np.float16).astype(float).tolist()


def test_queries_are_prepared_without_change():
    q = np.array([3.0, 4.0, 12.0])
    assert prepare_query(q, 3, 2, True) == [0.6, 0.8] and q.tolist() == [3, 4, 12]
    assert prepare_query([0, 0, 0], 3, None, True) == [0, 0, 0]
    with pytest.raises(ValueError):
        prepare_query([1.0], 3, 2, False)
    with pytest.raises(TypeError):
        prepare_query(None, 3, None, False)


def test_lengths_of_vectors_are_checked(spark):
    from pyspark.sql import functions as F

    from vecspark.functions.metrics import added, distance, dot

    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0, 5.0])], "a array<double>, b array<double>")
    for f in (dot, distance, added):
        with pytest.raises(Exception, match="different lengths"):
            df.select(f(F.col("a"), F.col("b"))).collect()
        assert df.select(f(F.col("a"), F.lit(None).cast("array<double>"))).first()[0] is None
