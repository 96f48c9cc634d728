import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.operators import search
from vecspark.operators.hnsw import HnswIndex
from vecspark.operators.ivf import IvfIndex
from vecspark.plans.schema import IndexSpec, VectorField

M = np.random.default_rng(5).normal(size=(300, 8))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, i % 4, x.tolist()) for i, x in enumerate(M)] + [(1000, 0, None), (1001, 0, [])]
    return spark.createDataFrame(data, "id long, kind int, v array<float>").persist()


def exact(metric, q, k=None):
    s = metric.kernel(M.astype(np.float32).astype(float), np.array([q]))[:, 0]
    order = sorted(range(len(M)), key=lambda i: (-s[i], i))
    return order[:k], s


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot", "pearson"])
def test_topk(rows, metric):
    field = VectorField("v", 8, metric, nullable=True)
    got = [r["id"] for r in search.topk(rows, "id", field, M[7], 10).collect()]
    assert got == exact(field.resolved, M[7], 10)[0]


def test_plan_is_a_bounded_heap(rows):
    plan = search.topk(rows, "id", VectorField("v", 8), M[0], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_filter_after_overfetch(rows):
    field = VectorField("v", 8, "euclidean")
    near = exact(field.resolved, M[3], 20)[0]
    got = [r["id"] for r in search.topk_filtered(rows, "id", field, M[3], 5, F.col("kind") == 1).collect()]
    assert got == [i for i in near if i % 4 == 1][:5]
    few = search.topk_filtered(rows, "id", field, M[3], 5, "id = 299", over_fetch=1).collect()
    assert len(few) <= 1


def test_threshold_and_top1(rows):
    field = VectorField("v", 8, "euclidean")
    order, s = exact(field.resolved, M[3])
    assert sorted(r["id"] for r in search.threshold(rows, field, M[3], 0.3).collect()) == sorted(i for i in order if s[i] >= 0.3)
    assert search.top1(rows, "id", field, M[3]).first()["id"] == 3
    got = [r["id"] for r in search.threshold_truncated(rows, "id", field, M[3], 0.0, ef_search=7).collect()]
    assert got == order[:30]


def test_errors(rows):
    field = VectorField("v", 8)
    for bad in (0, -1):
        with pytest.raises(ValueError):
            search.topk(rows, "id", field, M[0], bad)
        with pytest.raises(ValueError):
            search.topk_filtered(rows, "id", field, M[0], 3, "true", over_fetch=bad)
    with pytest.raises(ValueError):
        search.threshold(rows, field, M[0], float("nan"))
    with pytest.raises(ValueError):
        search.topk(rows, "id", field, M[0][:5], 3)
    for kwargs in ({"metric": "hamming", "quantised": True}, {"half": True, "quantised": True}, {"metric": "none"}):
        with pytest.raises(ValueError):
            VectorField("v", 8, **kwargs)


def test_nan_is_last(spark):
    df = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])], "id long, v array<float>")
    assert [r["id"] for r in search.topk(df, "id", VectorField("v", 2, "dot"), [1, 1], 3).collect()] == [3, 2, 1]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_batch_equals_single(spark, rows, metric):
    field = VectorField("v", 8, metric)
    queries = spark.createDataFrame([(i, M[i].tolist()) for i in range(0, 300, 20)] + [(999, None)], "qid long, q array<double>")
    got = {}
    for r in search.batch_topk(rows, "id", field, queries, "qid", "q", 6).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["id"]
    assert len(got) == 15
    for i, hits in got.items():
        assert [hits[k] for k in sorted(hits)] == exact(field.resolved, M[i], 6)[0]


def test_batch_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK_BYTES", 8 * 8 * 4)
    queries = spark.createDataFrame([(i, M[i].tolist()) for i in range(0, 300, 20)], "qid long, q array<double>")
    got = search.batch_topk(rows, "id", VectorField("v", 8), queries, "qid", "q", 1).collect()
    assert sorted((r["qid"], r["id"]) for r in got) == [(i, i) for i in range(0, 300, 20)]


def asked(spark):
    return spark.createDataFrame([(i, M[i].tolist()) for i in range(0, 300, 20)], "qid long, q array<double>")


def recall(spark, index, k=10):
    got = {(r["qid"], r["id"]) for r in index.batch_topk(asked(spark), "qid", "q", k).collect()}
    return sum((i, j) in got for i in range(0, 300, 20) for j in exact(index.field.resolved, M[i], k)[0]) / (15 * k)


@pytest.mark.parametrize("kind", ["ivf", "hnsw"])
def test_indexes_follow_changes(spark, rows, tmp_path, kind):
    """Removed, replaced and new rows, in several steps, with keys that are dates."""
    import datetime

    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i)
    frame = lambda data: spark.createDataFrame([(day(i), x.tolist()) for i, x in data], "id date, v array<float>")
    field = VectorField("v", 8, "euclidean", index=IndexSpec(kind, clusters=10 if kind == "ivf" else None, probes=10, m=8, ef_construction=60, ef_search=60))
    now = {i: M[i] for i in range(100)}
    build = lambda data: (IvfIndex.build(data, "id", field, str(tmp_path / "i")) if kind == "ivf" else HnswIndex.build(data, "id", field, str(tmp_path / "h"), shard_rows=40))
    index, rng = build(frame(now.items())), np.random.default_rng(1)
    for step in range(10 if kind == "ivf" else 3):
        gone = [i for i in now if i % 7 == step % 7]
        moved = [i for i in now if i % 7 == (step + 1) % 7]
        new = [1000 * (step + 1) + i for i in range(12)]
        for i in gone:
            del now[i]
        now |= {i: rng.normal(size=8) for i in (*moved, *new)}
        keys = spark.createDataFrame([(day(i),) for i in (*gone, *moved, *new)], "id date")
        index = index.updated(keys, frame(now.items()))
    if kind == "hnsw":
        assert index.n == len(now)
        index.save(str(tmp_path / "saved"))
        del now[max(now)]
        now[min(now)] = rng.normal(size=8)
        index = HnswIndex.load(spark, "id", field, str(tmp_path / "saved")).reconciled(frame(now.items()))
        assert index.n == len(now)
    else:
        index.save(str(tmp_path / "saved"))
        index = IvfIndex.load(frame(now.items()), "id", field, str(tmp_path / "saved"), str(tmp_path / "again"))
    queries = spark.createDataFrame([(day(k), M[k].tolist()) for k in range(0, 300, 20)], "asked date, q array<double>")
    got = index.batch_topk(queries, "asked", "q", 5).collect()
    want = search.batch_topk(frame(now.items()), "id", field, queries, "asked", "q", 5).collect()
    pairs = lambda x: {(r["asked"], r["id"]) for r in x}
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(want) and len(want) == 75 and isinstance(got[0]["asked"], datetime.date)
    assert {r["id"] for r in index.topk(M[0], 500).collect()} <= {day(i) for i in now}


def test_centroids_from_jobs(spark, rows, tmp_path, monkeypatch):
    from vecspark.operators import ivf

    monkeypatch.setattr(ivf, "LOCAL_BYTES", 0)
    for metric in ("euclidean", "cosine"):
        field = VectorField("v", 8, metric, index=IndexSpec("ivf", clusters=12, probes=8))
        index = IvfIndex.build(rows, "id", field, str(tmp_path / metric))
        assert len(index.centroids) == 12 and recall(spark, index) >= 0.9


def test_keys_keep_their_types(spark, rows):
    queries = spark.createDataFrame([(7, M[7].tolist())], "qid int, q array<double>")
    for asked_ in (queries, queries.limit(0)):
        assert search.batch_topk(rows, "id", VectorField("v", 8), asked_, "qid", "q", 2).schema["qid"].dataType.simpleString() == "int"


def test_custom_kernel(spark, rows):
    from vecspark.functions.metrics import custom

    own = custom("sum", kernel=lambda m, q: -np.abs(m[:, None, :] - q[None]).sum(axis=2))
    got = [r["id"] for r in search.topk(rows.where("size(v) = 8"), "id", VectorField("v", 8, own), M[3], 5).collect()]
    assert got == exact(own, M[3], 5)[0]


def test_ivf(spark, rows, tmp_path):
    field = VectorField("v", 8, "euclidean", index=IndexSpec("ivf", clusters=12, probes=8))
    index = IvfIndex.build(rows, "id", field, str(tmp_path / "ivf"))
    full = [r["id"] for r in index.topk(M[9], 10, probes=12).collect()]
    assert full == exact(field.resolved, M[9], 10)[0]
    assert recall(spark, index) >= 0.9
    assert {r["id"] for r in index.batch_topk(asked(spark).where("qid = 20"), "qid", "q", 10).collect()} == {r["id"] for r in index.topk(M[20], 10).collect()}
    plan = index.topk(M[9], 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cluster_id" in plan
    again = IvfIndex.build(rows, "id", field, str(tmp_path / "ivf2"))
    assert np.allclose(again.centroids, index.centroids)


def test_ivf_looks_at_as_many_lists_as_recall_takes(spark, tmp_path):
    """Many lists and few probes: the index measures that one list isn't enough, also after changes."""
    m = np.random.default_rng(9).normal(size=(1500, 16))
    frame = lambda data: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "id long, v array<double>")
    rows, queries = frame(m).persist(), frame(m[:300:20]).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    for metric in ("euclidean", "cosine"):
        want = {(r["qid"], r["id"]) for r in search.batch_topk(rows, "id", VectorField("v", 16, metric), queries, "qid", "q", 10).collect()}
        shares = []
        for least in (0.95, None):
            field = VectorField("v", 16, metric, index=IndexSpec("ivf", clusters=40, probes=1, recall=least))
            index = IvfIndex.build(rows, "id", field, str(tmp_path / f"{metric}{least}"))
            shares.append(len(want & {(r["qid"], r["id"]) for r in index.batch_topk(queries, "qid", "q", 10).collect()}) / len(want))
        assert len(want) == 150 and shares[0] >= 0.9 > shares[1]
        assert len(index.measured) == 0 and index.lists(10) == 1


def test_copies_are_in_order_of_key(spark):
    """Equal rows have equal scores wherever they are in a block."""
    m = np.random.default_rng(2).normal(size=(90, 5))
    m[::3] = m[0]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(i, m[i].tolist()) for i in range(7)], "qid long, q array<double>")
    for metric in ("cosine", "dot", "euclidean"):
        got = search.batch_topk(rows, "id", VectorField("v", 5, metric), queries, "qid", "q", 4).where("qid % 3 = 0").orderBy("qid", "rank").collect()
        assert metric == "dot" or [r["id"] for r in got] == [0, 3, 6, 9] * 3
        assert all(len({r["similarity"] for r in got[i : i + 4]}) == 1 for i in (0, 4, 8) if got[i]["id"] % 3 == 0)


def test_hnsw(spark, rows, tmp_path):
    field = VectorField("v", 8, "cosine", index=IndexSpec("hnsw", m=8, ef_construction=60, ef_search=60))
    index = HnswIndex.build(rows, "id", field, str(tmp_path / "hnsw"), shard_rows=160)
    assert index.n == 300
    assert recall(spark, index) >= 0.9
    assert [r["id"] for r in index.batch_topk(asked(spark).where("qid = 20"), "qid", "q", 10).orderBy("rank").collect()] == [r["id"] for r in index.topk(M[20], 10).collect()]
    live = rows.where("id <> 0")
    assert 0 not in {r["id"] for r in index.topk(M[0], 5, live=live).collect()}
    with pytest.raises(ValueError):
        HnswIndex.load(spark, "id", VectorField("v", 8, "dot", index=field.index), str(tmp_path / "hnsw"))
    best = [r["similarity"] for r in index.threshold(M[0], 0.5).collect()]
    assert best == sorted(best, reverse=True) and best[-1] >= 0.5


def test_graph_links_the_nearest():
    """Of the nodes before it a node links to the nearest, and keeps the nearest of those that link to it, in one step or
    several."""
    import pyarrow as pa

    from vecspark.functions.metrics import resolve
    from vecspark.operators.hnsw import Graph

    for metric in map(resolve, ("cosine", "euclidean", "manhattan")):
        m = np.random.default_rng(3).normal(size=(200, 6))
        m /= np.linalg.norm(m, axis=1)[:, None]
        s = m @ m.T if metric.normalised else metric.kernel(m, m)
        pick = lambda x, among: sorted(among, key=lambda y: (-s[x, y], y))[:8]  # noqa: E731, B023
        own = [pick(x, range(x)) for x in range(200)]
        want = [sorted(pick(x, {*own[x], *(y for y in range(x + 1, 200) if x in own[y])})) for x in range(200)]
        for parts in ([200], [90, 1, 109]):
            graph, at = Graph(4, metric, 1), 0
            for n in parts:
                graph.add(m[at : at + n])
                at += n
            level = graph.links[0]
            assert [sorted(level.near[a:b].tolist()) for a, b in zip(level.edge[:-1], level.edge[1:], strict=True)] == want
            near = search.Nearest(metric, m[:20], 5)
            graph.search(near, pa.array(range(1000, 1200)), 60)
            got = next(near.batch()).to_pydict()
            best = {(i, 1000 + j) for i in range(20) for j in pick(i, range(200))[:5]}
            assert len(best & set(zip(got["_i"], got["_k"], strict=True))) >= 95


def test_task_hands_on_the_best_of_its_shards(spark, rows, tmp_path):
    index = HnswIndex.build(rows, "id", VectorField("v", 8, "cosine", index=IndexSpec("hnsw")), str(tmp_path / "many"), shard_rows=10)
    index.shards = index.shards.coalesce(1)
    assert index.count == 30 and index._found([0, 1], [M[0].tolist(), M[1].tolist()], 4, 50).count() == 8


def test_late_materialisation_reads_payloads_for_hits_only(spark, tmp_path):
    spark.createDataFrame([(i, x.tolist(), bytes(10)) for i, x in enumerate(M)], "id long, v array<float>, blob binary").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = search.late_topk(df, "id", VectorField("v", 8), M[4], 3)
    assert out.first()["id"] == 4 and len(out.first()["blob"]) == 10


def test_vectors_reach_a_task_without_objects():
    """index_snapshot: a shard's rows become a matrix with few copies, and none of an object for each element."""
    import tracemalloc

    import pyarrow as pa

    flat = pa.array(np.random.default_rng(1).normal(size=4000 * 64).astype(np.float32))
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 64), pa.int32()), flat)
    tracemalloc.start()
    try:
        m = search.matrix(VectorField("v", 64, "cosine"), column)
        assert m.shape == (4000, 64) and tracemalloc.get_traced_memory()[1] <= 4 * m.nbytes
    finally:
        tracemalloc.stop()


def test_threshold_through_the_graph_of_a_large_shard():
    """threshold_hnsw_truncated: as many nodes as the shard has are asked for, and linking takes no walk for each node."""
    import time

    import pyarrow as pa

    from vecspark.functions.metrics import resolve
    from vecspark.operators.hnsw import Graph

    m = np.random.default_rng(4).normal(size=(6000, 32))
    m /= np.linalg.norm(m, axis=1)[:, None]
    began = time.process_time()
    graph, near = Graph(16, resolve("cosine"), 1).add(m), search.Nearest(resolve("cosine"), m[:1], 5000)
    graph.search(near, pa.array(range(6000)), 6000)
    got = next(near.batch())["_k"].to_pylist()
    assert time.process_time() - began < 15  # a walk for each node took over 2 ms
    assert len(set(got) & set(np.argsort(-(m @ m[0]), kind="stable")[:5000].tolist())) >= 4500


def test_centroids_are_learned_by_products(monkeypatch):
    """ivf_full_probe, ivf_threshold_full: Euclidean distances of all rows to all centroids without their differences."""
    import time

    from vecspark.operators import ivf

    monkeypatch.setattr(ivf, "STEPS", 20)
    m, field = np.random.default_rng(6).normal(size=(20_000, 64)), VectorField("v", 64, "euclidean")
    began = time.thread_time()
    c = ivf.learn(field, m, 150)
    assert time.thread_time() - began < 6  # differences took over half a second for each of 20 steps
    assert c.shape == (150, 64) and np.isfinite(c).all()
    want = np.argmax(field.resolved.kernel(m[:500], c), axis=1)
    assert (ivf._nearest(field, m, c)[:500] == want).mean() > 0.99
