import numpy as np
import pytest

from vecspark.operators.dml import KeyConflict, merge
from vecspark.operators.table import Options, VectorDatabase, VectorTable
from vecspark.plans.schema import IndexSpec, LargeField, TableSpec, VectorField, type_of
from vecspark.sources.migrate import Rules, migrated, upgrade
from vecspark.sources.storage import ConflictError, FormatVersionError, Store, UnknownTableError, merge_stores
from vecspark.sources import exchange, files

FACES = TableSpec("faces", "id", (("id", "string"), ("label", "string"), ("score", "double")), (VectorField("v", 2, "cosine", nullable=True),), large=(LargeField("photo"),))


def face(i, v=(1.0, 0.0), label="x", score=0.5, photo=None):
    return {"id": f"p{i}", "label": label, "score": score, "v": None if v is None else [float(x) for x in v], "photo": photo}


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_changes(spark):
    t = VectorTable(spark, FACES)
    t.add_range([])
    t.add_range([face(i, (i, 1)) for i in range(6)])
    assert t.count() == 6 and t.find("p3")["v"] == [3, 1] and t.find("none") is None
    assert t.exists("p0") and t.exists_where("score > 0.4") and not t.exists_where("score > 9")
    t.upsert_range([face(1, (5, 5), "old"), face(1, (6, 6), "new"), face(9)])
    assert t.count() == 7 and t.find("p1")["label"] == "new"
    assert t.remove(face(0)) and not t.remove_by_key("p0") and not t.remove_by_key(None)
    assert t.count() == 6 and t.vector_fields == {"v": 2}
    assert t.search_top1([1.0, 1.0])["id"] == "p1"
    assert "photo" not in t.scan(large=False).columns
    t.clear()
    assert t.count() == 0 and t.search([1, 0], 3).collect() == []


def test_batches_are_all_or_nothing(spark):
    t = VectorTable(spark, FACES)
    t.add(face(1))
    for batch in ([face(2), face(1)], [face(2), face(2)], [face(2), face(3) | {"id": None}]):
        with pytest.raises(Exception) as e:
            t.add_range(batch)
        assert isinstance(e.value, KeyConflict) or "null" in str(e.value).lower() or "None" in str(e.value)
    with pytest.raises(Exception, match="length"):
        t.add_range([face(5, (1, 2, 3))])
    assert ids(t.rows) == ["p1"]


def test_null_vectors_are_kept_but_not_found(spark):
    t = VectorTable(spark, FACES)
    t.add_range([face(1), face(2, None), face(3, ())])
    assert t.count() == 3 and ids(t.search([1, 0], 9)) == ["p1"]
    strict = VectorTable(spark, FACES.with_vector("v", nullable=False))
    with pytest.raises(Exception):
        strict.add(face(1, None))


def test_calls_in_threads(spark):
    t = VectorTable(spark, FACES)
    assert t.submit("add_range", [face(i, (1, i)) for i in range(9)]).result() is None
    found = [t.submit("search", [1, i], 1) for i in range(4)]
    assert [f.result()[0]["id"] for f in found] == [f"p{i}" for i in range(4)]
    with pytest.raises(ValueError):
        t.submit("search", [1, 1], 0).result()


@pytest.mark.parametrize("kind", ["flat", "kdtree", "ivf", "hnsw"])
def test_indexes(spark, kind):
    spec = FACES.with_vector("v", index=IndexSpec(kind, clusters=2 if kind == "ivf" else None, probes=2))
    t = VectorTable(spark, spec)
    t.add_range([face(i, (1, i)) for i in range(12)])
    assert [r["id"] for r in t.search([1, 3], 1).collect()] == ["p3"]
    assert [r["id"] for r in t.search([1, 3], 2, predicate="id <> 'p3'").collect()][:1] == ["p4"]
    assert [r["id"] for r in t.search([1, 3], 1, pre_filter="id > 'p5'").collect()] == ["p6"]
    assert "p3" in ids(t.search_by_threshold([1, 3], 0.999))
    t.remove_by_key("p3")
    assert t.search([1, 3], 1).first()["id"] == "p4"


def test_declarations():
    for bad in ({"key": "nope"}, {"vectors": ()}, {"large": (LargeField("v"),)}, {"columns": (("id", "map"),)}):
        with pytest.raises((ValueError, TypeError)):
            TableSpec(**{"name": "t", "key": "id", "columns": (("id", "long"),), "vectors": (VectorField("v", 2),)} | bad)
    assert type_of("ulong").simpleString() == "decimal(20,0)" and type_of("half[]").simpleString() == "array<float>" and type_of("byte[]").simpleString() == "binary"
    two = TableSpec("t", "id", (("id", "long"),), (VectorField("a", 2), VectorField("b", 2, effective=9)))
    with pytest.raises(LookupError):
        two.vector()
    assert two.vector("b").effective is None
    with pytest.raises(ValueError):
        IndexSpec("tree")


def test_save_append_load(spark, tmp_path):
    path = str(tmp_path / "db")
    db = VectorDatabase(spark, [FACES], path)
    db.load()
    t = db.table("faces")
    t.add_range([face(i, photo=b"abc") for i in range(4)])
    db.save()
    t.add(face(7))
    t.remove_by_key("p1")
    db.append()
    again = VectorDatabase(spark, [FACES], path)
    again.load()
    assert ids(again.table("faces").rows) == ["p0", "p2", "p3", "p7"] and bytes(again.table("faces").find("p2")["photo"]) == b"abc"
    again.table("faces").remove_by_key("p7")
    again.flush_tombstones()
    again.table("faces").add(face(7, label="back"))
    again.append()
    third = VectorDatabase(spark, [FACES], path)
    third.load()
    assert third.table("faces").find("p7")["label"] == "back" and third.table("faces").count() == 4
    seen = third._store(None).inspect()
    assert seen["version"] == 4 and seen["crc_valid"] and seen["counts"] == {"faces": 6}
    third.table("faces").upsert(face(0, label="changed"))
    third.append()
    fourth = VectorDatabase(spark, [FACES], path, Options(auto_merge=True, merge_ratio=0.01))
    fourth.load()
    assert fourth.table("faces").find("p0")["label"] == "changed" and fourth.table("faces").count() == 4
    fourth.table("faces").remove_by_key("p0")
    fourth.append()
    table = fourth._store(None).manifest()["tables"]["faces"]
    assert len(table["segments"]) == 1 and not table["dead"] and table["segments"][0]["rows"] == 3
    with pytest.raises(LookupError):
        db.table("other")


def test_corruption_and_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    with pytest.raises(FileNotFoundError):
        store.inspect()
    store.save({"faces": (FACES, spark.createDataFrame([face(1)], FACES.schema()))})
    part = next((tmp_path / "db" / "faces").rglob("part-*.parquet"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 1
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    part.write_bytes(bytes(data))
    assert store.inspect()["crc_valid"] is False and store.inspect(verify=False)["crc_valid"] is None
    store._commit(lambda m: m | {"version": 3})
    with pytest.raises(FormatVersionError):
        store.manifest()


def test_unknown_tables_and_aliases(spark, tmp_path):
    path = str(tmp_path / "db")
    Store(spark, path).save({"faces": (FACES, spark.createDataFrame([face(1)], FACES.schema()))})
    other = TableSpec("people", "id", FACES.columns, FACES.vectors, FACES.large)
    with pytest.raises(UnknownTableError):
        VectorDatabase(spark, [other], path, Options(unknown="throw")).load()
    with pytest.warns(UserWarning):
        VectorDatabase(spark, [other], path).load()
    renamed = VectorDatabase(spark, [TableSpec("people", "id", FACES.columns, FACES.vectors, FACES.large, aliases=("faces",))], path, Options(unknown="throw"))
    renamed.load()
    assert ids(renamed.table("people").rows) == ["p1"]
    for bad in ({"unknown": "maybe"}, {"merge_segments": 0}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_merge_policies(spark, tmp_path):
    paths = []
    for k, keys in enumerate(((1, 2), (2, 3))):
        store = Store(spark, str(tmp_path / f"s{k}"))
        store.save({"faces": (FACES, spark.createDataFrame([face(i, label=f"s{k}") for i in keys], FACES.schema()))})
        paths.append(store.path)
    got = {}
    for policy in ("append", "last", "first"):
        out = str(tmp_path / policy)
        merge_stores(spark, paths, out, [FACES], policy, verify=True)
        got[policy] = sorted((r["id"], r["label"]) for r in Store(spark, out).load(FACES).collect())
    assert got["append"] == [("p1", "s0"), ("p2", "s0"), ("p2", "s1"), ("p3", "s1")]
    assert got["last"] == [("p1", "s0"), ("p2", "s1"), ("p3", "s1")] and got["first"] == [("p1", "s0"), ("p2", "s0"), ("p3", "s1")]
    with pytest.raises(ValueError):
        merge_stores(spark, paths, str(tmp_path / "x"), None, "last")
    with pytest.raises(ValueError):
        merge([spark.range(1)], "id", "none")


@pytest.mark.parametrize("form", ["json", "xml"])
def test_exchange(spark, tmp_path, form):
    rows = [face(1, (0.1, -2.5), "a<b>&\"é", photo=b"\x00\xff"), face(2, None, None, None), face(3, (1e-8, 3e8), " "), face(4, label="  a\tb\n "), face(5, label="\\N"), face(6, label="")]
    db = VectorDatabase(spark, [FACES])
    db.table("faces").add_range(rows)
    db.export(str(tmp_path / "out"), form)
    other = VectorDatabase(spark, [FACES])
    other.table("faces").add(face(1, label="replaced"))
    other.import_(str(tmp_path / "out"), form)
    a, b = ([sorted(map(str, x.table("faces").rows.collect()))][0] for x in (db, other))
    assert a == b


def test_json_arrays_and_documents(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{"faces": [{"id": "p1", "label": "a", "v": [1.5, 2]}, {"id": "p2", "v": "AAAAPwAAgD8=", "odd": 1}], "others": [1, 2]}')
    got = {r["id"]: r for r in exchange.import_json_document(spark, str(tmp_path / "doc.json"), "faces", FACES).collect()}
    assert got["p1"]["v"] == [1.5, 2] and got["p2"]["v"] == [0.5, 1.0] and got["p2"]["label"] is None
    (tmp_path / "bad.json").write_text('{"faces": [{"id": "p1"')
    with pytest.raises(Exception):
        exchange.import_json_document(spark, str(tmp_path / "bad.json"), "faces", FACES).collect()


def test_migration(spark, tmp_path):
    old = spark.createDataFrame([(1, 2.5, "7", 300, [1.0, 2.0]), (2, 3.5, "x", -1, None)], "id int, amount double, text string, big int, vec array<double>")
    spec = TableSpec("t", "id", (("id", "long"), ("total", "int"), ("text", "int"), ("big", "sbyte"), ("note", "string"), ("flag", "bool")), (VectorField("v", 2, nullable=True),), defaults=(("note", "new"),))
    rules = Rules().rename("amount", "total").rename("vec", "v").transform("total", lambda c: c * 10).transform("absent", lambda c: c)
    rows = [tuple(r) for r in migrated(old, spec, rules).orderBy("id").collect()]
    assert rows == [(1, 20, 7, 0, "new", False, [1, 2]), (2, 40, 0, -1, "new", False, None)]
    old.write.parquet(str(tmp_path / "old" / "legacy"))
    upgrade(spark, str(tmp_path / "old"), str(tmp_path / "new"), {"legacy": spec}, {"legacy": rules})
    assert Store(spark, str(tmp_path / "new")).load(spec).count() == 2
    with pytest.raises(FileExistsError):
        upgrade(spark, str(tmp_path / "old"), str(tmp_path / "new"), {"legacy": spec})
    with pytest.raises(ValueError):
        upgrade(spark, str(tmp_path / "old"), str(tmp_path / "third"), {})
    assert files.exists(spark, str(tmp_path / "old"))


def test_stream(spark, tmp_path):
    from vecspark.streaming.append import append_stream

    source, path = str(tmp_path / "in"), str(tmp_path / "db")
    for label in ("first", "second"):
        spark.createDataFrame([face(i, label=label) for i in range(3)], FACES.schema()).coalesce(1).write.mode("append").parquet(source)
        append_stream(spark.readStream.schema(FACES.schema()).parquet(source), FACES, path, str(tmp_path / "cp")).awaitTermination()
    got = Store(spark, path).load(FACES).collect()
    assert sorted((r["id"], r["label"]) for r in got) == [(f"p{i}", "second") for i in range(3)]


def test_reads_after_auto_merge(spark, tmp_path):
    path = str(tmp_path / "db")
    first = VectorDatabase(spark, [FACES], path)
    first.table("faces").add_range([face(i) for i in range(10)])
    first.save()
    for step in range(6):
        db = VectorDatabase(spark, [FACES], path, Options(auto_merge=True, merge_segments=4, merge_ratio=10.0))
        db.load()
        t = db.table("faces")
        t.remove_by_key(f"p{step}")
        t.add_range([face(100 + 10 * step + i) for i in range(5)])
        db.append()
        assert t.count() == 10 + 4 * (step + 1) and t.find(f"p{step}") is None  # read by the one that appended
        t.upsert(face(9, label=f"step {step}"))
        assert t.search([1.0, 0.0], 100).count() == t.count()
    seen = Store(spark, path).inspect()
    assert len([s for s in seen["segments"] if s["kind"] == "rows"]) <= 4 and seen["crc_valid"]


def test_older_states_can_be_read_until_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    frame = lambda *i: spark.createDataFrame([face(k) for k in i], FACES.schema())
    store.append(FACES, frame(1, 2, 3), None)
    old = store.load(FACES)
    store.save({"faces": (FACES, frame(7))})
    store.append(FACES, frame(8), None)
    store.compact(FACES)
    assert ids(old) == ["p1", "p2", "p3"] and ids(store.load(FACES)) == ["p7", "p8"]
    assert store.vacuum() == 0 and ids(old) == ["p1", "p2", "p3"]
    assert store.vacuum(0) == 3 and ids(store.load(FACES)) == ["p7", "p8"] and len(store.versions()) == 1
    with pytest.raises(Exception):
        store.load(FACES, manifest=store.manifest(1))


def test_a_writer_that_ends_between_its_steps_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "db"))
    frame = lambda *i: spark.createDataFrame([face(k) for k in i], FACES.schema())
    store.append(FACES, frame(1, 2), None)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(files, "create_text", killed)
        for change in (lambda: store.append(FACES, frame(3), frame(1).select("id")), lambda: store.save({"faces": (FACES, frame(9))}), lambda: store.compact(FACES)):
            with pytest.raises(KeyboardInterrupt):
                change()
    assert ids(store.load(FACES)) == ["p1", "p2"] and store.versions() == [1]
    store.append(FACES, frame(4), None)
    assert ids(store.load(FACES)) == ["p1", "p2", "p4"] and store.vacuum(0) == 4  # what the killed ones left


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    a, b = Store(spark, path), Store(spark, path)
    frame = lambda *i: spark.createDataFrame([face(k) for k in i], FACES.schema())
    a.append(FACES, frame(1), None)
    real, raced = files.create_text, []

    def slow(*args):
        if not raced:  # another writer is first
            raced.append(True)
            b.append(FACES, frame(2), None)
        return real(*args)

    monkeypatch.setattr(files, "create_text", slow)
    a.append(FACES, frame(3), frame(1).select("id"))
    assert ids(a.load(FACES)) == ["p2", "p3"] and len(a.versions()) == 3
    raced.clear()
    with pytest.raises(ConflictError):
        a.compact(FACES)
    assert ids(a.load(FACES)) == ["p2", "p2", "p3"]
    assert not real(spark, f"{path}/_manifests/{1:012d}.json", "x")


def test_a_stored_graph_heals(spark, tmp_path):
    """Rows go without the graph being stored again; what loads both finds none of them, and new ones."""
    rng = np.random.default_rng(7)
    spec = TableSpec("faces", "id", (("id", "string"),), (VectorField("v", 32, "cosine", index=IndexSpec("hnsw", m=8, ef_construction=64, ef_search=32)),))
    row = lambda name: {"id": name, "v": rng.normal(size=32).tolist()}
    path = str(tmp_path / "db")
    db = VectorDatabase(spark, [spec], path)
    db.table("faces").add_range([row(f"H{i:04d}") for i in range(300)])
    db.save()
    db = VectorDatabase(spark, [spec], path)
    db.load()
    assert db.table("faces").count() == 300
    db.table("faces").remove_keys(spark.createDataFrame([(f"H{i:04d}",) for i in range(100, 160)], "id string"))
    db.flush_tombstones()
    assert db._store(None).indexes(spec)
    db = VectorDatabase(spark, [spec], path)
    db.load()
    t = db.table("faces")
    assert t.count() == 240 and t.find("H0120") is None and t.find("H0050") is not None
    assert t._snapshots and t.index("v").n == 240
    new = [row(f"NEW{i:02d}") for i in range(20)]
    t.add_range(new)
    graph = t.index("v")
    assert graph.n == 260 and t.search(new[3]["v"], 5).first()["id"] == "NEW03"
    assert not {f"H{i:04d}" for i in range(100, 160)} & {r["id"] for r in t.search(new[0]["v"], 100).collect()}
    db.save()
    other = VectorDatabase(spark, [spec.with_vector("v", index=IndexSpec("hnsw", m=4))], path)
    other.load()
    with pytest.warns(UserWarning, match="indexed anew"):
        assert other.table("faces").search(new[3]["v"], 1).first()["id"] == "NEW03"


def test_cached_rows_are_released(spark):
    t = VectorTable(spark, FACES, Options(memory=True))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for i in range(5):
        t.add(face(i))
    assert t.count() == 5 and spark.sparkContext._jsc.getPersistentRDDs().size() <= before + 1


def test_frames_are_upserted_as_they_were_read_once(spark):
    t = VectorTable(spark, FACES)
    rows = spark.createDataFrame([face(i % 7, label=str(i)) for i in range(70)], FACES.schema()).repartition(5)
    t.upsert_range(rows)
    assert t.count() == 7 and ids(t._fresh) == ids(t.rows)
    assert sorted(r["label"] for r in t._fresh.collect()) == sorted(r["label"] for r in t.rows.collect())
