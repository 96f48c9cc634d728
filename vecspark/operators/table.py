"""Databases and tables: a session, a directory, declared tables, and the rows that changes have led to."""

from __future__ import annotations

import warnings
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import Vector
from ..plans.schema import TableSpec
from ..plans.session import fresh_path, stored
from ..sources import exchange
from ..sources.migrate import Rules
from ..sources.storage import RETENTION, Store
from . import dml, search
from .hnsw import HnswIndex
from .ivf import IvfIndex


@dataclass
class Options:
    """merge_segments and merge_ratio: when a table with auto_merge is rewritten after an append. unknown: what happens on
    load to stored tables that aren't declared. cut_every: changes after which the rows are written out, so that plans
    stay short. memory: whether rows are cached in memory and on disk; results are the same."""

    auto_merge: bool = False
    merge_segments: int = 32
    merge_ratio: float = 0.25
    unknown: str = "warn"
    save_on_close: bool = False
    cut_every: int = 8
    memory: bool = False
    retention: float = RETENTION

    def __post_init__(self):
        if self.merge_segments <= 0 or self.merge_ratio <= 0 or self.cut_every <= 0:
            raise ValueError("options must be positive")
        if self.unknown not in {"ignore", "warn", "throw"}:
            raise ValueError(f"unknown must be ignore, warn or throw, not {self.unknown!r}")


class VectorTable:
    """Rows of a declared table. Each change makes a new plan; nothing is changed in place, the caller's rows included."""

    def __init__(self, spark: SparkSession, spec: TableSpec, options: Options | None = None):
        self.spark, self.spec, self.options = spark, spec, options or Options()
        self.rows = spark.createDataFrame([], spec.schema())
        self._fresh = self.rows  # since the last save, load or append
        self._dead: DataFrame | None = None
        self._indexes: dict[str, IvfIndex | HnswIndex] = {}
        self._pending: list[DataFrame] = []  # keys that have changed since the indexes were made
        self._snapshots: dict[str, str] = {}  # stored indexes that haven't been asked for yet
        self._held: DataFrame | None = None
        self._changes = 0

    # changes

    def _frame(self, rows: DataFrame | list) -> DataFrame:
        own = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.spec.schema())
        return dml.conform(self.spec, own)

    def _set(self, rows: DataFrame, fresh: DataFrame, keys: DataFrame | None = None) -> None:
        """keys: those whose rows have changed; None where all may have."""
        self._changes += 1
        if self._changes % self.options.cut_every == 0:
            rows, fresh = stored(rows, self.spec.name), stored(fresh, self.spec.name)
            if keys is not None:
                keys = stored(keys, f"{self.spec.name}-keys")
        if self.options.memory:
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
            rows.count()  # before what it was made from goes
            if self._held is not None:
                self._held.unpersist()
            self._held = rows
        self.rows, self._fresh = rows, fresh
        if keys is None:
            self._indexes, self._pending, self._snapshots = {}, [], {}
        elif self._indexes:
            self._pending.append(keys.select(self.spec.key))

    def add(self, row: dict | Row | tuple) -> None:
        self.add_range([row])

    def add_range(self, rows: DataFrame | list) -> None:
        """All rows or, with an error, none: keys must be new and given once, vectors of their declared lengths."""
        if isinstance(rows, list) and not rows:
            return
        new = self._frame(rows)
        both = dml.add_range(self.rows, new, self.spec.key)
        dml.verify(new)
        self._set(both, self._fresh.unionByName(new), new)

    def upsert(self, row: dict | Row | tuple) -> None:
        self.upsert_range([row])

    def upsert_range(self, rows: DataFrame | list) -> None:
        """Rows take the place of those of equal key; of equal keys among them the last stays."""
        if isinstance(rows, list):
            if not rows:
                return
            # the order of a list is kept in a column
            names = self.spec.schema().names
            numbered = [(*(r.get(n) if isinstance(r, dict) else r[i] for i, n in enumerate(names)), k) for k, r in enumerate(rows)]
            if any(r[names.index(self.spec.key)] is None for r in numbered):
                raise dml.KeyConflict("a key is null")
            frame = self.spark.createDataFrame(numbered, self.spec.schema().add("_order", "long"))
            new = dml.conform(self.spec, dml.last_of_each(frame, self.spec.key, "_order").drop("_order"))
        else:
            # read once: tombstones, rows and fresh rows are to be of the same batch
            new = dml.last_of_each(dml.read_once(self._frame(rows)), self.spec.key, dml.ORDER).drop(dml.ORDER)
        dml.verify(new)
        new = stored(new, self.spec.name) if not isinstance(rows, list) else new
        self._bury(new.select(self.spec.key))
        order = new.withColumn(dml.ORDER, F.lit(0))  # keys differ already
        self._set(dml.upsert_range(self.rows, order, self.spec.key, dml.ORDER), dml.upsert_range(self._fresh, order, self.spec.key, dml.ORDER), new)

    def _bury(self, keys: DataFrame) -> None:
        gone = keys.join(self.rows.select(self.spec.key), self.spec.key, "left_semi")
        self._dead = gone if self._dead is None else self._dead.unionAll(gone)

    def remove_keys(self, keys: DataFrame) -> None:
        self._bury(keys.select(self.spec.key))
        self._set(dml.remove_keys(self.rows, keys, self.spec.key), dml.remove_keys(self._fresh, keys, self.spec.key), keys)

    def remove_by_key(self, value: object) -> bool:
        """Whether there was such a row."""
        if value is None or not self.exists(value):
            return False
        self.remove_keys(self.spark.createDataFrame([(value,)], [self.spec.key]).select(F.col(self.spec.key).cast(self.rows.schema[self.spec.key].dataType)))
        return True

    def remove(self, row: dict | Row) -> bool:
        """By the row's key alone."""
        return self.remove_by_key(row[self.spec.key])

    def clear(self) -> None:
        """No rows, and no pending tombstones; files stay."""
        self._dead = None
        empty = self.spark.createDataFrame([], self.spec.schema())
        self._set(empty, empty)

    # reading

    def find(self, value: object) -> Row | None:
        return next(iter(dml.find(self.rows, self.spec.key, value).collect()), None)

    def exists(self, value: object) -> bool:
        return dml.exists(self.rows, F.col(self.spec.key) == F.lit(value))

    def exists_where(self, predicate: Column | str) -> bool:
        return dml.exists(self.rows, predicate)

    def count(self) -> int:
        return self.rows.count()

    def __len__(self) -> int:
        return self.count()

    def scan(self, large: bool = True) -> DataFrame:
        """All rows; without large fields, which are then not read, unless large."""
        return self.rows if large else self.rows.drop(*[f.name for f in self.spec.large])

    @property
    def vector_fields(self) -> dict[str, int]:
        return {v.name: v.dims for v in self.spec.vectors}

    # search

    def search(self, q: Vector, k: int, field: str | None = None, predicate: Column | str | None = None, over_fetch: int = 4, pre_filter: Column | str | None = None) -> DataFrame:
        """The k most similar rows by the field's index; predicate applies to k * over_fetch of them, pre_filter to all
        rows before."""
        own = self.spec.vector(field)
        if predicate is not None:
            if over_fetch <= 0:
                raise ValueError("over_fetch must be positive")
            near = self.search(q, search._positive(k, "k") * over_fetch, own.name, pre_filter=pre_filter)
            return near.where(predicate).orderBy(*search.ordering(self.spec.key)).limit(k)
        if own.index.kind in {"flat", "kdtree"} or pre_filter is not None:
            rows = self.rows if pre_filter is None else self.rows.where(pre_filter)
            return search.topk(rows, self.spec.key, own, q, k)
        index = self.index(own.name)
        if isinstance(index, IvfIndex):
            return index.topk(q, k)
        return search.materialised(self.rows, self.spec.key, index.topk(q, k))

    def search_top1(self, q: Vector, field: str | None = None) -> Row | None:
        return next(iter(self.search(q, 1, field).collect()), None)

    def search_by_threshold(self, q: Vector, least: float, field: str | None = None) -> DataFrame:
        own = self.spec.vector(field)
        if own.index.kind in {"flat", "kdtree"}:
            return search.threshold(self.rows, own, q, least)
        if least is None or least != least:
            raise ValueError("the threshold is no number")
        index = self.index(own.name)
        hits = index.threshold(q, least)
        return hits if isinstance(index, IvfIndex) else search.materialised(self.rows, self.spec.key, hits)

    def search_batch(self, queries: DataFrame, query_key: str, query_vector: str, k: int, field: str | None = None) -> DataFrame:
        return search.batch_topk(self.rows, self.spec.key, self.spec.vector(field), queries, query_key, query_vector, k)

    def submit(self, method: str, *args, **kwargs) -> Future:
        """A method of the table in a thread of its own, such as add_range or search; a search's frame is collected there.
        Spark runs the jobs of several threads side by side; changes are to be waited for before the next."""

        def run():
            out = getattr(self, method)(*args, **kwargs)
            return out.collect() if isinstance(out, DataFrame) else out

        if not hasattr(self, "_pool"):
            self._pool = ThreadPoolExecutor(4, thread_name_prefix=self.spec.name)
        return self._pool.submit(run)

    def index(self, field: str) -> IvfIndex | HnswIndex:
        """The field's index, up to date: as it is, with what has changed since, from a stored one that is reconciled with
        the rows, or built."""
        if self._pending:
            keys = self._pending[0]
            for k in self._pending[1:]:
                keys = keys.unionAll(k)
            keys = stored(keys.distinct(), "pending")
            self._indexes = {n: i.updated(keys, self.rows) for n, i in self._indexes.items()}
            self._pending = []
        if field not in self._indexes:
            self._indexes[field] = self._loaded(field) or self._built(field)
        return self._indexes[field]

    def _built(self, field: str) -> IvfIndex | HnswIndex:
        own = self.spec.vector(field)
        kind = IvfIndex if own.index.kind == "ivf" else HnswIndex
        return kind.build(self.rows, self.spec.key, own, fresh_path(self.spark, f"{self.spec.name}-{field}"))

    def _loaded(self, field: str) -> IvfIndex | HnswIndex | None:
        """A stored index; None if there is none, or one that was made with other parameters."""
        path, own = self._snapshots.pop(field, None), self.spec.vector(field)
        if path is None:
            return None
        try:
            if own.index.kind == "ivf":
                return IvfIndex.load(self.rows, self.spec.key, own, path, fresh_path(self.spark, f"{self.spec.name}-{field}"))
            return HnswIndex.load(self.spark, self.spec.key, own, path, self.rows.schema[self.spec.key].dataType).reconciled(self.rows)
        except ValueError as e:
            warnings.warn(f"{self.spec.name}.{field} is indexed anew: {e}", stacklevel=3)
            return None


@dataclass
class VectorDatabase:
    spark: SparkSession
    specs: list[TableSpec]
    path: str | None = None
    options: Options = field(default_factory=Options)
    rules: dict[str, Rules] = field(default_factory=dict)

    def __post_init__(self):
        if len({s.name for s in self.specs}) < len(self.specs):
            raise ValueError("table names repeat")
        self.tables = {s.name: VectorTable(self.spark, s, self.options) for s in self.specs}

    def table(self, name: str) -> VectorTable:
        if name not in self.tables:
            raise LookupError(f"no table {name!r} is declared")
        return self.tables[name]

    def configure_migration(self, name: str, rules: Rules) -> None:
        self.table(name)
        self.rules[name] = rules

    def _store(self, path: str | None) -> Store:
        if not (path or self.path):
            raise ValueError("the database has no path")
        return Store(self.spark, path or self.path)

    def save(self, path: str | None = None) -> None:
        """All tables anew, with the graph indexes and such others as have been made."""
        store = self._store(path)
        indexes: dict[str, dict[str, str]] = {}
        for n, t in self.tables.items():
            for v in t.spec.vectors:
                if v.index.kind == "hnsw" or v.name in t._indexes:
                    name, at = store.index_path(n, v.name)
                    t.index(v.name).save(at)
                    indexes.setdefault(n, {})[v.name] = name
        store.save({n: (t.spec, t.rows) for n, t in self.tables.items()}, indexes)
        for t in self.tables.values():
            self._settle(store, t)

    def vacuum(self, path: str | None = None) -> int:
        """Deletes what replaced states alone need, once they are older than the options' retention."""
        return self._store(path).vacuum(self.options.retention)

    def append(self, path: str | None = None) -> None:
        """What has changed since the last save, load or append: tombstones and new rows."""
        store = self._store(path)
        for t in self.tables.values():
            store.append(t.spec, t._fresh, t._dead)
            t._dead, t._fresh = None, self.spark.createDataFrame([], t.spec.schema())
        self._merge(store)

    def flush_tombstones(self, path: str | None = None) -> None:
        """Pending tombstones alone; nothing if there are none."""
        store = self._store(path)
        for t in self.tables.values():
            if t._dead is not None:
                store.append(t.spec, None, t._dead)
                t._dead = None
        self._merge(store)

    def _merge(self, store: Store) -> None:
        if not self.options.auto_merge:
            return
        for t in self.tables.values():
            try:
                if store.crowded(t.spec.name, self.options.merge_segments, self.options.merge_ratio):
                    store.compact(t.spec)
                    self._settle(store, t)
            except Exception as e:  # what was appended is safe; the next append tries again
                warnings.warn(f"{t.spec.name} could not be rewritten: {e}", stacklevel=2)

    def _settle(self, store: Store, t: VectorTable, rows: DataFrame | None = None) -> None:
        """The table reads what is stored now; indexes that are up to date stay, as their rows are the same."""
        same = rows is None
        rows = store.load(t.spec, self.rules.get(t.spec.name)) if same else rows
        empty = self.spark.createDataFrame([], t.spec.schema())
        t._set(empty if rows is None else rows, empty, empty if same else None)
        t._fresh, t._dead = empty, None
        if not same:
            t._snapshots = store.indexes(t.spec)

    def load(self, path: str | None = None) -> None:
        """Adds the stored rows; nothing if there is no database. Rows that are in memory already make an error if their
        keys are stored as well."""
        store = self._store(path)
        if store.manifest() is None:
            return
        store.check_tables(self.specs, self.options.unknown)
        for t in self.tables.values():
            rows = store.load(t.spec, self.rules.get(t.spec.name))
            if rows is not None:
                self._settle(store, t, rows if t.rows.isEmpty() else dml.add_range(t.rows, rows, t.spec.key))

    def export(self, path: str, form: str = "json") -> None:
        for n, t in self.tables.items():
            {"json": exchange.export_json, "xml": exchange.export_xml}[form](t.rows, f"{path}/{n}")

    def export_document(self, path: str) -> None:
        """One file with one object of all tables' rows, {table: [rows]}, written by the driver as the rows come."""
        exchange.export_json_document({n: t.rows for n, t in self.tables.items()}, path)

    def import_(self, path: str, form: str = "json") -> None:
        """Merges what export() wrote; tables that aren't there are left alone."""
        from ..sources import files

        for n, t in self.tables.items():
            if files.exists(self.spark, f"{path}/{n}"):
                rules = self.rules.get(n) or Rules()
                rows = {"json": exchange.import_json, "xml": exchange.import_xml}[form](self.spark, f"{path}/{n}", t.spec, rules.renames)
                for name, how in rules.transforms.items():
                    if name in rows.columns:
                        rows = rows.withColumn(name, how(F.col(name)).cast(t.rows.schema[name].dataType))
                (t.add_range if t.rows.isEmpty() else t.upsert_range)(rows)

    def close(self) -> None:
        if self.options.save_on_close and self.path:
            self.save()

    def __enter__(self) -> VectorDatabase:
        return self

    def __exit__(self, *_) -> None:
        self.close()
