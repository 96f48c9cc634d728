"""A query for each operator of the engine over the driver's tables, and SQL that gives the same rows.

Vectors in `embeddings` have norm 1, under which cosine and dot agree and a missing normalisation is not seen; queries
that depend on it scale each vector by 1 + label first. The query vector is that of vec_id 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.metrics import added, custom, distance, divided, dot, doubles, literal, max_magnitude, norm, plain_dot, total
from .functions.prepare import half, normalised, searchable
from .operators import dml, search
from .operators.hnsw import HnswIndex
from .operators.ivf import IvfIndex
from .operators.table import Options, VectorDatabase, VectorTable
from .plans.schema import IndexSpec, LargeField, TableSpec, VectorField
from .plans.session import fresh_path, ready, stored
from .sources import exchange
from .sources.migrate import Rules
from .sources.storage import Store, UnknownTableError, merge_stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIMS, K = 64, 10


def _query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str, vector: str = "embedding") -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr(vector).alias("v"))


#: A vector of another norm in each row; its sign pattern; its magnitudes. In Spark and in DuckDB.
SCALED = ("transform(cast(embedding AS array<double>), x -> x * (1 + label))", "list_transform(embedding, lambda x: x::DOUBLE * (1 + label))")
SIGNS = ("transform(cast(embedding AS array<double>), x -> CASE WHEN x > 0 THEN 1D ELSE 0D END)", "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")
SIZES = ("transform(cast(embedding AS array<double>), x -> abs(x))", "list_transform(embedding, lambda x: abs(x::DOUBLE))")


def query_vector(rows: DataFrame, vec_id: int = 0) -> list[float]:
    return list(rows.where(F.col("vec_id") == vec_id).select("v").first()["v"])


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("vec_id", "label", F.round(search.SCORE, 6).alias("similarity"))


def scores(expr: str, vector: str) -> str:
    """A CTE s(vec_id, label, v, q, s) of all rows with the SQL similarity expr over q and v."""
    return f"WITH b AS (SELECT vec_id, label, {vector} AS v FROM embeddings), q AS (SELECT v AS q FROM b WHERE vec_id = 0), s AS (SELECT b.vec_id, b.label, {expr} AS s FROM b, q WHERE v IS NOT NULL AND len(v) > 0)"


def best(expr: str, vector: str, k: int = K) -> str:
    return f"{scores(expr, vector)} SELECT vec_id, label, round(s, 6) AS similarity FROM s ORDER BY s DESC, vec_id LIMIT {k}"


_Z = "list_sum(list_transform(list_zip(q, v), lambda t: {}))"
EXPR = {
    "cosine": "list_cosine_similarity(q, v)",
    "dot": "list_inner_product(q, v)",
    "euclidean": "1 / (1 + list_distance(q, v))",
    "manhattan": f"1 / (1 + {_Z.format('abs(t[1] - t[2])')})",
    "chebyshev": "1 / (1 + list_max(list_transform(list_zip(q, v), lambda t: abs(t[1] - t[2]))))",
    "pearson": "list_cosine_similarity(list_transform(q, lambda x: x - list_avg(q)), list_transform(v, lambda x: x - list_avg(v)))",
    "hamming": f"{_Z.format('CASE WHEN t[1] = t[2] THEN 1.0 ELSE 0.0 END')} / len(v)",
    "jaccard": f"{_Z.format('least(t[1], t[2])')} / {_Z.format('greatest(t[1], t[2])')}",
    "canberra": f"1 - {_Z.format('CASE WHEN abs(t[1]) + abs(t[2]) = 0 THEN 0.0 ELSE abs(t[1] - t[2]) / (abs(t[1]) + abs(t[2])) END')} / len(v)",
}
VECTORS = {"hamming": SIGNS, "jaccard": SIZES}


def _metric(metric: str) -> None:
    spark_vector, sql_vector = VECTORS.get(metric, SCALED)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = base(spark, sf_dir, spark_vector)
        return shown(search.topk(rows, "vec_id", VectorField("v", DIMS, metric), query_vector(rows), K))

    run.__name__ = f"topk_{metric}"
    _query(best(EXPR[metric], sql_vector))(run)


for _m in EXPR:
    _metric(_m)
EUCLIDEAN, COSINE = VectorField("v", DIMS, "euclidean"), VectorField("v", DIMS, "cosine")


@_query(f"{scores(EXPR['euclidean'], SCALED[1])}, n AS (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 40) SELECT vec_id, label, round(s, 6) AS similarity FROM n WHERE label < 3 ORDER BY s DESC, vec_id LIMIT 10")
def topk_filtered_overfetch(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.topk_filtered(rows, "vec_id", EUCLIDEAN, query_vector(rows), K, "label < 3"))


@_query(f"{scores(EXPR['euclidean'], SCALED[1])}, n AS (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 40) SELECT vec_id, label, round(s, 6) AS similarity FROM n WHERE label = 2 ORDER BY s DESC, vec_id LIMIT 10")
def topk_filtered_under_k(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.topk_filtered(rows, "vec_id", EUCLIDEAN, query_vector(rows), K, F.col("label") == 2))


@_query(f"{scores(EXPR['euclidean'], SCALED[1])} SELECT vec_id, label, round(s, 6) AS similarity FROM s WHERE label < 3 ORDER BY s DESC, vec_id LIMIT 10")
def topk_prefiltered(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.topk(rows.where("label < 3"), "vec_id", EUCLIDEAN, query_vector(rows), K))


@_query(f"{scores(EXPR['cosine'], SCALED[1])} SELECT vec_id, label, round(s, 6) AS similarity FROM s WHERE s >= 0.2")
def threshold_cosine(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.threshold(rows, COSINE, query_vector(rows), 0.2))


@_query(f"{scores(EXPR['euclidean'], SCALED[1])} SELECT vec_id, label, round(s, 6) AS similarity FROM s WHERE s >= 0.25")
def threshold_euclidean(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.threshold(rows, EUCLIDEAN, query_vector(rows), 0.25))


@_query(f"{scores(EXPR['cosine'], SCALED[1])}, n AS (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT (SELECT greatest(50, count(*) // 10) FROM s)) SELECT vec_id, label, round(s, 6) AS similarity FROM n WHERE s >= 0.1")
def threshold_truncated(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.threshold_truncated(rows, "vec_id", COSINE, query_vector(rows), 0.1))


@_query(f"{scores(EXPR['manhattan'], SCALED[1])} SELECT vec_id, label, round(s, 6) AS similarity FROM s WHERE vec_id <> 0 ORDER BY s DESC, vec_id LIMIT 1")
def top1(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.top1(rows.where("vec_id <> 0"), "vec_id", VectorField("v", DIMS, "manhattan"), query_vector(rows)))


SPEC = TableSpec("items", "vec_id", (("vec_id", "long"), ("label", "int")), (VectorField("v", DIMS, "dot"),))


@_query(best(EXPR["dot"], SCALED[1]))
def default_field_topk(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.topk(rows, SPEC.key, SPEC.vector(), query_vector(rows), K))


@_query(best("list_cosine_similarity(q, v)", f"({SCALED[1]})[1:32]"))
def truncate_topk(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.topk(rows, "vec_id", VectorField("v", DIMS, "cosine", effective=32), query_vector(rows), K))


@_query(f"WITH b AS (SELECT vec_id, {SCALED[1]} AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM b) SELECT vec_id, round(v[1] / n, 6) AS first_element, round(list_sum(v) / n, 6) AS total, round(list_inner_product(v, v) / (n * n), 6) AS squares FROM n")
def normalize_vectors(spark, sf_dir):
    v = F.col("u")
    rows = base(spark, sf_dir, SCALED[0]).select("vec_id", normalised(F.col("v")).alias("u"))
    return rows.select("vec_id", F.round(v[0], 6).alias("first_element"), F.round(total(v), 6).alias("total"), F.round(dot(v, v), 6).alias("squares"))


@_query(f"WITH b AS (SELECT vec_id, {SCALED[1]} AS v FROM embeddings), q AS (SELECT v AS q FROM b WHERE vec_id = 0) SELECT vec_id, round(list_sum(v), 6) AS total, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(list_distance(v, q), 6) AS distance, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS largest, round((v[1] + q[1]) / 4, 6) AS quarter FROM b, q")
def vector_math(spark, sf_dir):
    rows, v = base(spark, sf_dir, SCALED[0]), F.col("v")
    q = literal(query_vector(rows))
    shown_ = {"total": total(v), "norm": norm(v), "distance": distance(v, q), "largest": max_magnitude(v), "quarter": divided(added(v, q), 4)[0]}
    return rows.select("vec_id", *[F.round(c, 6).alias(n) for n, c in shown_.items()])


_SQ8 = "list_transform(list_transform({v}, lambda x: CASE WHEN x < 0 THEN -1 ELSE 1 END * least(127, floor(abs(x / ({s})) + 0.5))), lambda c: c * ({s}))"


@_query(
    f"WITH a AS (SELECT vec_id, label, {SCALED[1]} AS w FROM embeddings), c AS (SELECT vec_id, label, w, list_max(list_transform(w, lambda x: abs(x))) / 127 AS sc FROM a), b AS (SELECT vec_id, label, w, {_SQ8.format(v='w', s='sc')} AS v FROM c), q AS (SELECT w AS q FROM b WHERE vec_id = 0), s AS (SELECT b.vec_id, b.label, {EXPR['euclidean']} AS s FROM b, q) SELECT vec_id, label, round(s, 6) AS similarity FROM s ORDER BY s DESC, vec_id LIMIT 10"
)
def sq8_roundtrip_topk(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.topk(rows, "vec_id", VectorField("v", DIMS, "euclidean", quantised=True), query_vector(rows), K))


#: Half precision by arithmetic: 11 significant bits, ties to even, subnormals below 2 ** -14.
_STEP = "pow(2.0, greatest(floor(log2(abs(x))), -14) - 10)"
_HALF = f"list_transform({SCALED[1]}, lambda x: CASE WHEN x = 0 THEN x ELSE sign(x) * round_even(abs(x) / {_STEP}, 0) * {_STEP} END)"
HALF = VectorField("v", DIMS, "euclidean", half=True)


@_query(best(EXPR["euclidean"], _HALF))
def half_topk(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.topk(rows, "vec_id", HALF, query_vector(rows), K))


@_query(f"{scores(EXPR['euclidean'], _HALF)}, n AS (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 40) SELECT vec_id, label, round(s, 6) AS similarity FROM n WHERE label < 3 ORDER BY s DESC, vec_id LIMIT 10")
def half_filtered(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.topk_filtered(rows, "vec_id", HALF, query_vector(rows), K, "label < 3"))


@_query(f"{scores(EXPR['euclidean'], _HALF)} SELECT vec_id, label, round(s, 6) AS similarity FROM s WHERE s >= 0.25")
def half_threshold(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.threshold(rows, HALF, query_vector(rows), 0.25))


@_query(f"{scores(EXPR['euclidean'], _HALF)} SELECT vec_id, label, round(s, 6) AS similarity FROM s WHERE vec_id <> 0 ORDER BY s DESC, vec_id LIMIT 1")
def half_top1(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.top1(rows.where("vec_id <> 0"), "vec_id", HALF, query_vector(rows)))


@_query(f"SELECT vec_id, round(list_sum({_HALF}), 6) AS total FROM embeddings")
def half_vectors(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0]).select("vec_id", half(F.col("v")).alias("h"))
    return rows.select("vec_id", F.round(total(F.col("h")), 6).alias("total"))


@_query(best(EXPR["euclidean"], f"CASE WHEN vec_id % 7 = 3 THEN NULL WHEN vec_id % 7 = 4 THEN [] ELSE {SCALED[1]} END"))
def nullable_vector_topk(spark, sf_dir):
    rows = base(spark, sf_dir, f"CASE WHEN vec_id % 7 = 3 THEN NULL WHEN vec_id % 7 = 4 THEN cast(array() AS array<double>) ELSE {SCALED[0]} END")
    return shown(search.topk(rows, "vec_id", VectorField("v", DIMS, "euclidean", nullable=True), query_vector(rows), K))


@_query(best(EXPR["dot"].replace("list_inner_product(q, v)", "list_inner_product(q, v) / (1 + list_inner_product(v, v))"), SCALED[1]))
def custom_metric_topk(spark, sf_dir):
    own = custom("damped", lambda a, b: plain_dot(a, b) / (1 + plain_dot(a, a)))
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.topk(rows, "vec_id", VectorField("v", DIMS, own), query_vector(rows), K))


@_query(best("1 / (1 + list_max(list_transform(list_zip(q, v), lambda t: abs(t[1] - t[2]))) + abs(q[1] - v[1]))", SCALED[1]))
def custom_kernel_topk(spark, sf_dir):
    own = custom("mixed", kernel=lambda m, q: 1 / (1 + np.abs(m[:, None, :] - q[None]).max(axis=2) + np.abs(m[:, None, 0] - q[None, :, 0])))
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.topk(rows, "vec_id", VectorField("v", DIMS, own), query_vector(rows), K))


@_query(
    f"WITH b AS (SELECT vec_id, {SCALED[1]} AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, b.vec_id, list_cosine_similarity(q.v, b.v) AS s FROM b, b AS q WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(s, 6) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= 10"
)
def batch_topk(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return search.batch_topk(rows, "vec_id", COSINE, queries, "query_id", "q", K).withColumn("similarity", F.round("similarity", 6))


@_query(best(EXPR["euclidean"], SCALED[1]))
def kdtree_topk(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.topk(rows, "vec_id", VectorField("v", DIMS, "euclidean", index=IndexSpec("kdtree")), query_vector(rows), K))


@_query(best(EXPR["euclidean"], SCALED[1]))
def ivf_full_probe(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    index = IvfIndex.build(rows, "vec_id", EUCLIDEAN, fresh_path(ready(spark), "ivf"))
    return shown(index.topk(query_vector(rows), K, probes=len(index.centroids)))


#: Recall of the 10 best for the queries of every id divisible by 20, against all rows. SQL states what it has to be.
RECALL = "SELECT count(*) AS queries, 10 * count(*) AS hits, true AS recall_is_90 FROM embeddings WHERE vec_id % 20 = 0"
GRAPH = VectorField("v", DIMS, "cosine", index=IndexSpec("hnsw", ef_construction=100, ef_search=100))
LISTS = VectorField("v", DIMS, "euclidean", index=IndexSpec("ivf", probes=16))


def found(index: HnswIndex | IvfIndex, rows: DataFrame, k: int = K) -> tuple[int, DataFrame, float]:
    """The number of queries, what the index finds for them, and its recall."""
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    got = stored(index.batch_topk(queries, "query_id", "q", k).select("query_id", "vec_id"), "got")
    want = stored(search.batch_topk(rows, "vec_id", index.field, queries, "query_id", "q", k).select("query_id", "vec_id"), "want")
    return queries.count(), got, want.join(got, ["query_id", "vec_id"], "left_semi").count() / max(1, want.count())


def recall(index: HnswIndex | IvfIndex, rows: DataFrame) -> DataFrame:
    n, got, share = found(index, rows)
    return got.agg(F.lit(n).cast("long").alias("queries"), F.count("*").alias("hits"), F.lit(share >= 0.9).alias("recall_is_90"))


@_query(RECALL)
def ivf_probe_approx(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return recall(IvfIndex.build(rows, "vec_id", LISTS, fresh_path(ready(spark), "ivf")), rows)


def _changed(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows without some and with others in their place at first, rows as they are, and the keys that differ."""
    first = rows.where("vec_id % 5 <> 0").withColumn("v", F.when(F.col("vec_id") % 7 == 0, F.transform("v", lambda x: -x)).otherwise(F.col("v")))
    extra = rows.where("vec_id % 9 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    keys = rows.where("vec_id % 5 = 0 OR vec_id % 7 = 0").select("vec_id").unionByName(extra.select("vec_id"))
    return first.unionByName(extra), rows, keys


@_query(RECALL)
def ivf_updated(spark, sf_dir):
    first, rows, keys = _changed(base(spark, sf_dir, SCALED[0]))
    return recall(IvfIndex.build(first, "vec_id", LISTS, fresh_path(ready(spark), "ivf")).updated(keys, rows), rows)


@_query(f"{scores(EXPR['euclidean'], SCALED[1])} SELECT vec_id, label, round(s, 6) AS similarity FROM s WHERE s >= 0.25")
def ivf_threshold_full(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    index = IvfIndex.build(rows, "vec_id", EUCLIDEAN, fresh_path(ready(spark), "ivf"))
    return shown(index.threshold(query_vector(rows), 0.25, probes=len(index.centroids)))


@_query(RECALL)
def hnsw_topk(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return recall(HnswIndex.build(rows, "vec_id", GRAPH, fresh_path(ready(spark), "hnsw"), shard_rows=512), rows)


@_query(RECALL)
def hnsw_updated(spark, sf_dir):
    """Rows linked into graphs and taken out of them."""
    first, rows, keys = _changed(base(spark, sf_dir, SCALED[0]))
    return recall(HnswIndex.build(first, "vec_id", GRAPH, fresh_path(ready(spark), "hnsw"), shard_rows=512).updated(keys, rows, 512), rows)


@_query(RECALL)
def hnsw_snapshot(spark, sf_dir):
    """A stored index that is reconciled with the rows of now."""
    first, rows, _ = _changed(base(spark, sf_dir, SCALED[0]))
    path = fresh_path(ready(spark), "hnsw")
    HnswIndex.build(first, "vec_id", GRAPH, fresh_path(spark, "hnsw"), shard_rows=512).save(path)
    return recall(HnswIndex.load(spark, "vec_id", GRAPH, path).reconciled(rows), rows)


@_query("SELECT true AS recall_is_90, 0 AS below")
def threshold_hnsw_truncated(spark, sf_dir):
    """Through the graph; of the rows that reach the threshold among the nearest, the share that it finds."""
    rows = base(spark, sf_dir, SCALED[0])
    index = HnswIndex.build(rows, "vec_id", GRAPH, fresh_path(ready(spark), "hnsw"))
    got = index.threshold(query_vector(rows), 0.1)
    want = search.threshold_truncated(rows, "vec_id", COSINE, query_vector(rows), 0.1, ef_search=GRAPH.index.ef_search)
    share = want.join(got.select("vec_id"), "vec_id", "left_semi").count() / max(1, want.count())
    return got.agg(F.lit(share >= 0.9).alias("recall_is_90"), F.coalesce(F.sum((F.col(search.SCORE) < 0.1).cast("int")), F.lit(0)).cast("int").alias("below"))


@_query(f"{scores(EXPR['euclidean'], SCALED[1])}, n AS (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 10) SELECT n.vec_id, label, round(s, 6) AS similarity FROM n")
def late_materialised_topk(spark, sf_dir):
    rows = base(spark, sf_dir, SCALED[0])
    return shown(search.late_topk(rows, "vec_id", EUCLIDEAN, query_vector(rows), K))


_ORDERS = "o_orderkey, o_custkey, o_orderstatus"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@_query(f"SELECT {_ORDERS} FROM orders")
def add_range(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return dml.add_range(rows.where("o_orderstatus = 'O'"), rows.where("o_orderstatus <> 'O'"), "o_orderkey")


@_query("SELECT o_orderkey, o_custkey + CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS o_custkey, o_orderstatus FROM orders")
def upsert_range(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    part = rows.where("o_orderstatus = 'F'")
    twice = part.withColumns({"o_custkey": F.col("o_custkey") + 1, "n": F.lit(1)}).unionByName(part.withColumns({"o_custkey": F.col("o_custkey") + 2, "n": F.lit(2)}))
    return dml.upsert_range(rows.where("o_orderstatus <> 'F' OR o_custkey > 100"), twice, "o_orderkey", order="n")


@_query(f"SELECT {_ORDERS} FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def remove_keys(spark, sf_dir):
    dead = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return dml.remove_keys(_orders(spark, sf_dir), dead, "o_orderkey")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def find_key(spark, sf_dir):
    return dml.find(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 42)


@_query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9000) AS some, EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 1e9) AS none")
def exists_pred(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return spark.range(1).select(F.lit(dml.exists(rows, "c_acctbal > 9000")).alias("some"), F.lit(dml.exists(rows, "c_acctbal > 1e9")).alias("none"))


@_query("SELECT count(*) AS n FROM orders")
def count_rows(spark, sf_dir):
    return _orders(spark, sf_dir).agg(F.count("*").alias("n"))


@_query("SELECT c_custkey, c_name FROM customer WHERE false")
def clear_set(spark, sf_dir):
    return dml.clear(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


@_query("SELECT o_orderstatus, count(*) AS n, max(o_custkey) AS last FROM orders WHERE o_custkey > 10 GROUP BY o_orderstatus")
def scan_rows(spark, sf_dir):
    return _orders(spark, sf_dir).where("o_custkey > 10").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_custkey").alias("last"))


def _sources(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return [rows.withColumn("src", F.lit(1)), rows.where("o_orderstatus = 'O'").withColumn("src", F.lit(2)), rows.where("o_custkey > 100").withColumn("src", F.lit(3))]


_SRC = f"(SELECT {_ORDERS}, 1 AS src FROM orders UNION ALL SELECT {_ORDERS}, 2 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT {_ORDERS}, 3 FROM orders WHERE o_custkey > 100)"


@_query(f"SELECT * FROM {_SRC}")
def merge_append(spark, sf_dir):
    return dml.merge(_sources(spark, sf_dir), "o_orderkey", "append")


@_query(f"SELECT * FROM {_SRC} QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY src DESC) = 1")
def merge_lww(spark, sf_dir):
    return dml.merge(_sources(spark, sf_dir), "o_orderkey", "last")


@_query(f"SELECT * FROM {_SRC} QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY src) = 1")
def merge_fww(spark, sf_dir):
    return dml.merge(_sources(spark, sf_dir), "o_orderkey", "first")


STORED = TableSpec("items", "vec_id", (("vec_id", "long"), ("label", "int")), (VectorField("v", DIMS, "cosine", nullable=True),))
_SUMMED = "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings"


def _summed(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "label", F.round(total(doubles(F.col("v"))), 6).alias("total"))


def _store(spark, name: str) -> Store:
    return Store(ready(spark), fresh_path(spark, name))


@_query(_SUMMED)
def append_load(spark, sf_dir):
    rows, store = base(spark, sf_dir), _store(spark, "append")
    for part in ("label < 3", "label BETWEEN 3 AND 6", "label > 6"):
        store.append(STORED, rows.where(part), None)
    return _summed(store.load(STORED))


@_query(f"{_SUMMED} WHERE label <> 3 OR embedding[1] > 0")
def tombstone_load(spark, sf_dir):
    rows, store = base(spark, sf_dir), _store(spark, "tombstones")
    store.append(STORED, rows, None)
    store.append(STORED, None, rows.where("label = 3").select("vec_id"))
    store.append(STORED, rows.where("label = 3 AND v[0] > 0"), None)  # what comes after a tombstone lives
    return _summed(store.load(STORED))


@_query(f"{_SUMMED} WHERE label <> 3")
def compact_load(spark, sf_dir):
    rows, store = base(spark, sf_dir), _store(spark, "compact")
    store.append(STORED, rows, None)
    store.append(STORED, None, rows.where("label = 3").select("vec_id"))
    store.compact(STORED)
    return _summed(store.load(STORED))


@_query("SELECT 'items' AS table_name, count(*) AS n, true AS crc_valid FROM embeddings UNION ALL SELECT 'low', count(*), true FROM embeddings WHERE label < 5")
def inspect_counts(spark, sf_dir):
    rows, store = base(spark, sf_dir), _store(spark, "inspect")
    low = TableSpec("low", "vec_id", STORED.columns, STORED.vectors)
    store.save({"items": (STORED, rows), "low": (low, rows.where("label < 5"))})
    seen = store.inspect()
    return spark.createDataFrame([(n, c, seen["crc_valid"]) for n, c in seen["counts"].items()], "table_name string, n long, crc_valid boolean")


@_query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, CASE WHEN label < 5 THEN 2 ELSE 1 END AS source FROM embeddings")
def merge_stores_lww(spark, sf_dir):
    rows, paths = base(spark, sf_dir), []
    spec = TableSpec("items", "vec_id", (("vec_id", "long"), ("label", "int"), ("source", "int")), STORED.vectors)
    for i, cut in ((1, "true"), (2, "label < 5")):
        store = _store(spark, f"source{i}")
        store.save({"items": (spec, rows.where(cut).withColumn("source", F.lit(i)).select("vec_id", "label", "source", "v"))})
        paths.append(store.path)
    target = _store(spark, "merged")
    merge_stores(spark, paths, target.path, [spec], "last", verify=True)
    return target.load(spec).select("vec_id", "label", F.round(total(doubles(F.col("v"))), 6).alias("total"), "source")


@_query(_SUMMED)
def json_roundtrip(spark, sf_dir):
    path = fresh_path(ready(spark), "json")
    exchange.export_json(base(spark, sf_dir), path)
    return _summed(exchange.import_json(spark, path, STORED))


@_query(_SUMMED)
def xml_roundtrip(spark, sf_dir):
    path = fresh_path(ready(spark), "xml")
    exchange.export_xml(base(spark, sf_dir), path)
    return _summed(exchange.import_xml(spark, path, STORED))


@_query("SELECT c_custkey AS id, c_name AS full_name, CAST(round_even(c_acctbal, 0) AS INTEGER) AS balance, 'none' AS note, upper(c_mktsegment) AS segment FROM customer")
def migrate_rename_coerce_default(spark, sf_dir):
    from .sources.migrate import migrated

    spec = TableSpec("people", "id", (("id", "long"), ("full_name", "string"), ("balance", "int"), ("note", "string"), ("segment", "string")), (VectorField("v", 1, nullable=True),), defaults=(("note", "none"),))
    rules = Rules().rename("c_custkey", "id").rename("c_name", "full_name").rename("c_acctbal", "balance").rename("c_mktsegment", "segment").transform("segment", F.upper)
    return migrated(table(spark, sf_dir, "customer"), spec, rules).drop("v")


@_query("SELECT count(*) AS searchable FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0")
def searchable_rows(spark, sf_dir):
    return base(spark, sf_dir).where(searchable(F.col("v"))).agg(F.count("*").alias("searchable"))


# the table's and the database's own interface


def _items(spark, sf_dir, rows: DataFrame | None = None, **options) -> VectorTable:
    out = VectorTable(ready(spark), STORED, Options(**options))
    out.add_range(base(spark, sf_dir) if rows is None else rows)
    return out


def _first(spark, sf_dir) -> dict:
    return base(spark, sf_dir).where("vec_id = 0").first().asDict()


def _refused(kind: type[Exception], f: Callable, *args) -> bool:
    try:
        f(*args)
    except kind:
        return True
    return False


@_query(_SUMMED)
def insert_row(spark, sf_dir):
    t = _items(spark, sf_dir, base(spark, sf_dir).where("vec_id > 0"))
    t.add(_first(spark, sf_dir))
    return _summed(t.rows)


@_query(_SUMMED)
def insert_async(spark, sf_dir):
    t = VectorTable(ready(spark), STORED)
    t.submit("add_range", base(spark, sf_dir)).result()
    return _summed(t.rows)


@_query("SELECT vec_id, CASE WHEN vec_id = 0 THEN 99 ELSE label END AS label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def upsert_row(spark, sf_dir):
    t = _items(spark, sf_dir)
    t.upsert(_first(spark, sf_dir) | {"label": 99})
    return _summed(t.rows)


@_query(f"{_SUMMED} WHERE vec_id <> 0")
def remove_entity(spark, sf_dir):
    t = _items(spark, sf_dir)
    if not t.remove(_first(spark, sf_dir)):
        raise AssertionError("the row is there")
    return _summed(t.rows)


@_query("SELECT true AS found, false AS missing, false AS absent")
def exists_key(spark, sf_dir):
    t = _items(spark, sf_dir)
    return spark.createDataFrame([(t.exists(0), t.exists(-1), t.remove_by_key(None))], "found boolean, missing boolean, absent boolean")


@_query("SELECT count(*) AS n, true AS refused FROM embeddings")
def set_accessor(spark, sf_dir):
    db = VectorDatabase(ready(spark), [STORED])
    db.table("items").add_range(base(spark, sf_dir))
    return spark.createDataFrame([(db.table("items").count(), _refused(LookupError, db.table, "others"))], "n long, refused boolean")


@_query("SELECT 'v' AS name, 64 AS dims UNION ALL SELECT 'w', 8")
def field_catalog(spark, sf_dir):
    t = VectorTable(ready(spark), TableSpec("two", "id", (("id", "long"),), (VectorField("v", 64), VectorField("w", 8))))
    return spark.createDataFrame(list(t.vector_fields.items()), "name string, dims int")


@_query("SELECT true AS no_field, true AS many_fields, true AS query_length, true AS row_length, true AS null_key, true AS key_twice, true AS same_key, true AS bad_k")
def payload_checks(spark, sf_dir):
    """What is refused, and leaves the table as it is."""
    t, row = _items(spark, sf_dir), _first(spark, sf_dir)
    two = VectorTable(spark, TableSpec("two", "id", (("id", "long"),), (VectorField("v", 64), VectorField("w", 8))))
    n, q = t.count(), row["v"]
    checks = {
        "no_field": _refused(ValueError, t.search, q, 3, "w"), "many_fields": _refused(LookupError, two.search, q, 3), "query_length": _refused(ValueError, t.search, q[:5], 3),
        "row_length": _refused(Exception, t.add, row | {"vec_id": -1, "v": q[:5]}), "null_key": _refused(Exception, t.add, row | {"vec_id": None}),
        "key_twice": _refused(dml.KeyConflict, t.add_range, [row | {"vec_id": -1}] * 2), "same_key": _refused(dml.KeyConflict, t.add, row), "bad_k": _refused(ValueError, t.search, q, 0),
    }
    return spark.createDataFrame([tuple(v and t.count() == n for v in checks.values())], ", ".join(f"{k} boolean" for k in checks))


@_query(f"{scores(EXPR['cosine'], 'embedding')} SELECT vec_id, label, round(s, 6) AS similarity FROM s ORDER BY s DESC, vec_id LIMIT 1")
def default_top1(spark, sf_dir):
    t = _items(spark, sf_dir)
    return shown(spark.createDataFrame([t.search_top1(query_vector(t.rows))], t.search(query_vector(t.rows), 1).schema))


@_query(best(EXPR["cosine"], "embedding"))
def search_async(spark, sf_dir):
    t = _items(spark, sf_dir)
    q = query_vector(t.rows)
    return shown(spark.createDataFrame(t.submit("search", q, K).result(), t.search(q, 1).schema))


@_query(f"{scores(EXPR['euclidean'], 'embedding')} SELECT vec_id, label, round(s, 6) AS similarity FROM s WHERE s >= 0.44")
def kdtree_threshold(spark, sf_dir):
    spec = STORED.with_vector("v", metric="euclidean", index=IndexSpec("kdtree"))
    t = VectorTable(ready(spark), spec)
    t.add_range(base(spark, sf_dir))
    return shown(t.search_by_threshold(query_vector(t.rows), 0.44))


@_query(f"{_SUMMED} WHERE label <> 4 AND vec_id <> 1")
def memory_rows(spark, sf_dir):
    """A table whose newest rows are cached, and earlier ones released."""
    t = _items(spark, sf_dir, memory=True)
    t.remove_keys(t.rows.where("label = 4").select("vec_id"))
    t.remove_by_key(1)
    return _summed(t.rows)


@_query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, 1 AS segments, 0 AS tombstones FROM embeddings WHERE label <> 3")
def auto_merge_load(spark, sf_dir):
    """Rows read after an append that rewrote the table, by the database that appended."""
    path = fresh_path(ready(spark), "merged")
    first = VectorDatabase(spark, [STORED], path)
    first.table("items").add_range(base(spark, sf_dir))
    first.save()
    db = VectorDatabase(spark, [STORED], path, Options(auto_merge=True, merge_ratio=0.01))
    db.load()
    db.table("items").remove_keys(db.table("items").rows.where("label = 3").select("vec_id"))
    db.append()
    entry = Store(spark, path).manifest()["tables"]["items"]
    return _summed(db.table("items").rows).withColumns({"segments": F.lit(len(entry["segments"])), "tombstones": F.lit(len(entry["dead"]))})


@_query("SELECT (SELECT count(*) FROM embeddings) AS before, (SELECT count(*) FROM embeddings WHERE label <> 3) AS after, true AS vacuumed")
def older_state(spark, sf_dir):
    """A frame over an older state counts what it had while the table is saved and rewritten, until vacuum()."""
    rows, store = base(spark, sf_dir), _store(spark, "states")
    store.append(STORED, rows, None)
    old, version = store.load(STORED), store.versions()[-1]
    store.append(STORED, None, rows.where("label = 3").select("vec_id"))
    store.compact(STORED)
    again = store.load(STORED, manifest=store.manifest(version))
    counts = (old.count(), store.load(STORED).count()) if again.count() == old.count() else (-1, -1)
    return spark.createDataFrame([(*counts, store.vacuum(0) == 2 and store.versions() == [3])], "before long, after long, vacuumed boolean")


@_query("SELECT c_custkey, c_name, octet_length(encode(repeat(c_name, 50))) AS n_bytes, sha256(repeat(c_name, 50)) AS digest FROM customer")
def blob_roundtrip(spark, sf_dir):
    spec = TableSpec("people", "c_custkey", (("c_custkey", "long"), ("c_name", "string")), (VectorField("v", 2, nullable=True),), large=(LargeField("photo"),))
    db = VectorDatabase(ready(spark), [spec], fresh_path(spark, "blobs"))
    db.table("people").add_range(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.repeat("c_name", F.lit(50)).cast("binary").alias("photo")))
    db.save()
    back = VectorDatabase(spark, [spec], db.path)
    back.load()
    rows = back.table("people")
    if "photo" in rows.scan(large=False).columns:
        raise AssertionError("a scan leaves large fields out")
    return rows.rows.select("c_custkey", "c_name", F.octet_length("photo").cast("long").alias("n_bytes"), F.sha2("photo", 256).alias("digest"))


@_query("SELECT count(*) FILTER (WHERE label < 5) AS n, true AS warned, true AS refused FROM embeddings")
def unknown_tables(spark, sf_dir):
    """A stored table that isn't declared: passed over, warned of, or refused."""
    import warnings

    rows, store = base(spark, sf_dir), _store(spark, "unknown")
    low = TableSpec("low", "vec_id", STORED.columns, STORED.vectors)
    store.save({"items": (STORED, rows), "low": (low, rows.where("label < 5"))})
    load = lambda how: VectorDatabase(spark, [low], store.path, Options(unknown=how)).load()
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        load("warn")
    db = VectorDatabase(spark, [low], store.path, Options(unknown="ignore"))
    db.load()
    return spark.createDataFrame([(db.table("low").count(), any("items" in str(w.message) for w in said), _refused(UnknownTableError, load, "throw"))], "n long, warned boolean, refused boolean")


@_query(f"{_SUMMED}")
def json_document_roundtrip(spark, sf_dir):
    db = VectorDatabase(ready(spark), [STORED])
    db.table("items").add_range(base(spark, sf_dir))
    path = fresh_path(spark, "document")
    db.export_document(f"{path}/all.json")
    return _summed(exchange.import_json_document(spark, f"{path}/all.json", "items", STORED))


@_query("SELECT vec_id, CASE WHEN label < 5 THEN label ELSE -1 END AS label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def import_rows(spark, sf_dir):
    """Imported rows take the place of those with their keys."""
    rows = base(spark, sf_dir)
    part = VectorDatabase(ready(spark), [STORED])
    part.table("items").add_range(rows.where("label < 5"))
    path = fresh_path(spark, "export")
    part.export(path)
    db = VectorDatabase(spark, [STORED])
    db.table("items").add_range(rows.withColumn("label", F.lit(-1)))
    db.import_(path)
    return _summed(db.table("items").rows)


@_query("SELECT c_custkey, ' ' || c_name || '  ' AS padded, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE ' ' END AS blank, '<' || c_mktsegment || '> & \\N' AS marked FROM customer")
def xml_texts(spark, sf_dir):
    spec = TableSpec("people", "c_custkey", (("c_custkey", "long"), ("padded", "string"), ("blank", "string"), ("marked", "string")), (VectorField("v", 2, nullable=True),))
    texts = {"padded": F.concat(F.lit(" "), "c_name", F.lit("  ")), "blank": F.when(F.col("c_custkey") % 3 == 0, None).when(F.col("c_custkey") % 3 == 1, "").otherwise(" "), "marked": F.concat(F.lit("<"), "c_mktsegment", F.lit("> & \\N"))}
    path = fresh_path(ready(spark), "xml")
    exchange.export_xml(table(spark, sf_dir, "customer").select("c_custkey", *[c.alias(n) for n, c in texts.items()]), path)
    return exchange.import_xml(spark, path, spec).drop("v")


_DAY = "DATE '2020-01-01' + CAST(c_custkey AS INTEGER)"


@_query(
    f"SELECT c_custkey AS id, c_custkey::DOUBLE AS as_double, c_custkey::VARCHAR AS as_text, CASE WHEN c_custkey <= 127 THEN c_custkey ELSE 7 END::TINYINT AS as_tiny, round_even(c_acctbal, 0)::BIGINT AS as_long, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END::INTEGER AS from_text, (c_custkey % 2 = 0)::INTEGER AS from_flag, round((c_acctbal::FLOAT)::DOUBLE, 3) AS narrowed, c_custkey + 0.5 AS widened, CAST({_DAY} AS VARCHAR) AS from_day, {_DAY} AS to_day, c_custkey * 1000000 AS micros FROM customer"
)
def coercions(spark, sf_dir):
    from .sources.migrate import migrated

    day, key = F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_custkey").cast("int")), F.col("c_custkey")
    stored_ = {
        "as_double": key, "as_text": key, "as_tiny": key, "as_long": F.col("c_acctbal").cast("double"), "from_text": F.when(key % 2 == 0, key.cast("string")).otherwise(F.concat(F.lit("x"), key.cast("string"))), "from_flag": key % 2 == 0,
        "narrowed": F.array(F.col("c_acctbal").cast("double")), "widened": F.array((key + 0.5).cast("float")), "from_day": day, "to_day": day.cast("string"), "micros": F.make_dt_interval(secs=key.cast("decimal(18,6)")),
    }
    kinds = {"as_double": "double", "as_text": "string", "as_tiny": "sbyte", "as_long": "long", "from_text": "int", "from_flag": "int", "narrowed": "float[]", "widened": "double[]", "from_day": "string", "to_day": "date", "micros": "long"}
    spec = TableSpec("people", "id", (("id", "long"), *kinds.items()), (VectorField("v", 1, nullable=True),), defaults=(("as_tiny", 7),))
    rows = table(spark, sf_dir, "customer").select(key.alias("id"), *[c.alias(n) for n, c in stored_.items()])
    got = migrated(rows, spec, None).drop("v")
    return got.withColumns({"narrowed": F.round(F.col("narrowed")[0].cast("double"), 3), "widened": F.col("widened")[0]})


@_query("SELECT c_custkey AS id, upper(c_name) AS title, c_acctbal AS score FROM customer")
def legacy_upgrade(spark, sf_dir):
    """A directory of older layout, rewritten by the rules that a database registers."""
    from .sources.migrate import upgrade

    spec = TableSpec("people", "id", (("id", "long"), ("title", "string"), ("score", "double")), (VectorField("v", 1, nullable=True),))
    path, target = fresh_path(ready(spark), "legacy"), fresh_path(spark, "upgraded")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("old_title"), F.col("c_acctbal").alias("score"), F.lit("gone").alias("removed")).write.parquet(f"{path}/people")
    db = VectorDatabase(spark, [spec], target)
    db.configure_migration("people", Rules().rename("old_title", "title").transform("title", F.upper))
    upgrade(spark, path, target, {"people": spec}, db.rules)
    db = VectorDatabase(spark, [spec], target)
    db.load()
    return db.table("people").rows.drop("v")


@_query("SELECT count(*) FILTER (WHERE label <> 3) + 3 AS n, true AS stored, true AS heals, true AS finds FROM embeddings")
def index_snapshot(spark, sf_dir):
    """A graph that is saved with its table, rows removed without it, and a database that loads both."""
    spec = STORED.with_vector("v", index=IndexSpec("hnsw", ef_construction=64))
    path = fresh_path(ready(spark), "snapshot")
    first = VectorDatabase(spark, [spec], path)
    first.table("items").add_range(base(spark, sf_dir))
    first.save()
    second = VectorDatabase(spark, [spec], path)
    second.load()
    second.table("items").remove_keys(second.table("items").rows.where("label = 3").select("vec_id"))
    second.flush_tombstones()
    third = VectorDatabase(spark, [spec], path)
    third.load()
    t = third.table("items")
    known = bool(t._snapshots)
    q = query_vector(t.rows, t.rows.agg(F.min("vec_id")).first()[0])
    heals = all(r["label"] != 3 for r in t.search(q, 50).collect())
    t.add_range([{"vec_id": 10_000_000 + i, "label": 3, "v": [x + i for x in q]} for i in range(3)])
    finds = 10_000_000 in {r["vec_id"] for r in t.search(q, 5).collect()}
    return spark.createDataFrame([(t.count(), known, heals, finds)], "n long, stored boolean, heals boolean, finds boolean")
