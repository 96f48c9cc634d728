"""A database directory: Parquet segments and tombstones of each table, and manifests that say which of them count.

A change writes new directories and then the next manifest, whose number no other writer can take as well; one that comes
second applies its change to the newer state. The manifest of the highest number holds. Nothing that an older one names is
deleted before vacuum(), so that whoever reads an older state can go on. Segments and tombstones are numbered together; a
tombstone, which is by key, takes the rows of earlier segments only. Index tables are named in the manifest as well.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import TableSpec
from . import files
from .migrate import Rules, migrated

VERSION = 4
MANIFESTS = "_manifests"
#: How often a change is applied to a newer state, where other writers come first.
TRIES = 50
#: Seconds for which a state that has been replaced can still be read.
RETENTION = 7 * 86400.0
_SEQ = "_seq"


class FormatVersionError(ValueError):
    """The directory is of another version, and has to be migrated first."""


class ConflictError(RuntimeError):
    """Another writer has changed the same table in the meantime."""


class UnknownTableError(ValueError):
    """The directory holds a table that isn't declared."""


@dataclass
class Store:
    """checksums: whether a segment is read once more after it is written, for the checksum that inspect() compares."""

    spark: SparkSession
    path: str
    checksums: bool = True

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n, _, _ in files.entries(self.spark, f"{self.path}/{MANIFESTS}") if n.endswith(".json") and n[:-5].isdigit()]

    def _at(self, version: int) -> str:
        return f"{self.path}/{MANIFESTS}/{version:012d}.json"

    def manifest(self, version: int | None = None) -> dict | None:
        """The newest, or that of a number; None if there is no database yet."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        out = json.loads(files.read_text(self.spark, self._at(version)))
        if out["version"] != VERSION:
            raise FormatVersionError(f"{self.path} has version {out['version']}; {VERSION} is needed")
        return out

    def _commit(self, change: Callable[[dict], dict]) -> None:
        """Makes the next manifest from the newest one, and again from a newer one if another writer was first."""
        for _ in range(TRIES):
            last = max(self.versions(), default=0)
            now = self.manifest(last) if last else {"version": VERSION, "tables": {}}
            text = json.dumps(change(copy.deepcopy(now)) | {"at": time.time()}, indent=1)
            if files.create_text(self.spark, self._at(last + 1), text):
                return
        raise ConflictError(f"{self.path}: other writers were first {TRIES} times")

    def _write(self, df: DataFrame, table: str, kind: str) -> dict:
        name = f"{table}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return {"kind": kind, "path": name, "rows": self.spark.read.parquet(f"{self.path}/{name}").count(), "crc": self._crc(name) if self.checksums else None}

    def _crc(self, name: str) -> str:
        """Over the checksums of all files, in order of name."""
        rows = self.spark.read.format("binaryFile").load(f"{self.path}/{name}").where("path LIKE '%.parquet'").select(F.crc32("content").alias("c"), F.element_at(F.split("path", "/"), -1).alias("p"))
        return rows.agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("p", "c")))), 256)).first()[0] or ""

    def _entry(self, spec: TableSpec, df: DataFrame, indexes: dict[str, str] | None = None) -> dict:
        return {"key": spec.key, "schema": spec.schema().json(), "next": 1, "segments": [{"seq": 0, **self._write(df, spec.name, "rows")}], "dead": [], "indexes": indexes or {}}

    def save(self, tables: dict[str, tuple[TableSpec, DataFrame]], indexes: dict[str, dict[str, str]] | None = None) -> None:
        """Replaces the tables by one segment of each; tombstones go. indexes: directories of index tables, by table and
        vector field."""
        entries = {name: self._entry(spec, df, (indexes or {}).get(name)) for name, (spec, df) in tables.items()}
        gone = {*tables, *(a for s, _ in tables.values() for a in s.aliases)}
        self._commit(lambda m: m | {"tables": {n: t for n, t in m["tables"].items() if n not in gone} | entries})

    def append(self, spec: TableSpec, rows: DataFrame | None, dead: DataFrame | None) -> None:
        """Adds tombstones for the keys in dead, and then a segment of rows."""
        parts = [(kind, self._write(df.select(spec.key).distinct() if kind == "dead" else df, spec.name, kind)) for df, kind in ((dead, "dead"), (rows, "rows")) if df is not None]

        def change(m: dict) -> dict:
            table = m["tables"].setdefault(spec.name, {"key": spec.key, "schema": spec.schema().json(), "next": 0, "segments": [], "dead": [], "indexes": {}})
            for kind, part in parts:
                if part["rows"]:
                    table["dead" if kind == "dead" else "segments"].append({"seq": table["next"], **part})
                    table["next"] += 1
            return m

        self._commit(change)

    def crowded(self, name: str, segments: int = 32, ratio: float = 0.25) -> bool:
        """Whether a table has so many segments, or so many tombstones for each live row, that it should be rewritten."""
        table = (self.manifest() or {"tables": {}})["tables"].get(name)
        if not table:
            return False
        dead, rows = sum(d["rows"] for d in table["dead"]), sum(s["rows"] for s in table["segments"])
        return len(table["segments"]) >= segments or (dead > 0 and dead / max(1, rows - dead) >= ratio)

    def compact(self, spec: TableSpec) -> None:
        """Rewrites a table as one segment; its indexes stay. An error, and no change, if it is changed meanwhile."""
        before = self.manifest()
        rows = self.load(spec, manifest=before)
        if rows is None:
            return
        names = [n for n in (spec.name, *spec.aliases) if n in before["tables"]]
        entry = self._entry(spec, rows, before["tables"][names[0]].get("indexes"))

        def change(m: dict) -> dict:
            if any(m["tables"].get(n) != before["tables"][n] for n in names):
                raise ConflictError(f"{spec.name} was changed while it was rewritten")
            return m | {"tables": {n: t for n, t in m["tables"].items() if n not in names} | {spec.name: entry}}

        self._commit(change)

    def vacuum(self, retention: float = RETENTION) -> int:
        """Deletes states that were replaced more than retention seconds ago, and directories as old that no other state
        names; gives the number of these."""
        now, known = time.time(), self.versions()
        states = {v: json.loads(files.read_text(self.spark, self._at(v))) for v in known}
        ends = {v: states[w]["at"] for v, w in zip(known, known[1:], strict=False)}
        old = [v for v in known if v in ends and ends[v] <= now - retention]
        named = {p for v in known if v not in old for t in states[v]["tables"].values() for p in (*(s["path"] for s in (*t["segments"], *t["dead"])), *t["indexes"].values())}
        for v in old:
            files.delete(self.spark, self._at(v))
        gone = [f"{table}/{n}" for table, is_dir, _ in files.entries(self.spark, self.path) if is_dir and table != MANIFESTS for n, _, at in files.entries(self.spark, f"{self.path}/{table}") if f"{table}/{n}" not in named and at <= now - retention]
        for name in gone:
            files.delete(self.spark, f"{self.path}/{name}")
        return len(gone)

    def index_path(self, table: str, field: str) -> tuple[str, str]:
        """A name for a new index table, and where it is."""
        name = f"{table}/index-{field}-{uuid.uuid4().hex}"
        return name, f"{self.path}/{name}"

    def indexes(self, spec: TableSpec) -> dict[str, str]:
        """Where the stored indexes of a table's vector fields are."""
        tables = (self.manifest() or {"tables": {}})["tables"]
        return {f: f"{self.path}/{p}" for n in (spec.name, *spec.aliases) if n in tables for f, p in tables[n].get("indexes", {}).items()}

    def check_tables(self, specs: list[TableSpec], unknown: str = "warn") -> list[str]:
        """Names of stored, not empty tables that aren't declared; unknown: ignore, warn or throw."""
        if unknown not in {"ignore", "warn", "throw"}:
            raise ValueError(f"unknown must be ignore, warn or throw, not {unknown!r}")
        known = {n for s in specs for n in (s.name, *s.aliases)}
        found = sorted(n for n, t in (self.manifest() or {"tables": {}})["tables"].items() if n not in known and sum(s["rows"] for s in t["segments"]))
        if found and unknown == "throw":
            raise UnknownTableError(f"{self.path} holds {', '.join(found)}")
        if found and unknown == "warn":
            warnings.warn(f"{self.path} holds {', '.join(found)}, which isn't declared", stacklevel=2)
        return found

    def load(self, spec: TableSpec, rules: Rules | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The live rows of a table, stored under its name or an alias, in the declared schema; None if there are none
        stored. manifest: an older state, of manifest(version)."""
        tables = (manifest or self.manifest() or {"tables": {}})["tables"]
        parts = [self._live(tables[n]) for n in (spec.name, *spec.aliases) if n in tables and tables[n]["segments"]]
        if not parts:
            return None
        out = [migrated(p, spec, rules) for p in parts]
        every = out[0]
        for p in out[1:]:
            every = every.unionByName(p)
        return every

    def _live(self, table: dict) -> DataFrame:
        key, schema = table["key"], T.StructType.fromJson(json.loads(table["schema"]))
        read = lambda s: self.spark.read.schema(schema).parquet(f"{self.path}/{s['path']}")
        if not table["dead"]:
            return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s['path']}" for s in table["segments"]])
        last = max(d["seq"] for d in table["dead"])
        # segments after the last tombstone need no join
        late = [s for s in table["segments"] if s["seq"] > last]
        early = [read(s).withColumn(_SEQ, F.lit(s["seq"])) for s in table["segments"] if s["seq"] < last]
        dead = [self.spark.read.parquet(f"{self.path}/{d['path']}").select(F.col(key).alias("_key"), F.lit(d["seq"]).alias("_dead")) for d in table["dead"]]
        for parts in (early, dead):
            while len(parts) > 1:
                parts[:] = [a.unionAll(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
        out = self.spark.read.schema(schema).parquet(*[f"{self.path}/{s['path']}" for s in late]) if late else None
        if early:
            marks = dead[0].groupBy("_key").agg(F.max("_dead").alias("_dead"))
            live = early[0].join(marks, (F.col(key) == F.col("_key")) & (F.col(_SEQ) < F.col("_dead")), "left_anti").drop(_SEQ)
            out = live if out is None else live.unionAll(out)
        return out

    def inspect(self, verify: bool = True) -> dict:
        """Version, bytes, segments with their checksums' state, and rows of each table, tombstones not subtracted."""
        manifest = self.manifest()
        if manifest is None:
            raise FileNotFoundError(self.path)
        parts = [{"table": n, **s, "crc_valid": self._crc(s["path"]) == s["crc"] if verify and s["crc"] else None} for n, t in manifest["tables"].items() for s in (*t["segments"], *t["dead"])]
        return {"version": manifest["version"], "bytes": files.size(self.spark, self.path), "segments": parts, "counts": {n: sum(s["rows"] for s in t["segments"]) for n, t in manifest["tables"].items()}, "crc_valid": all(p["crc_valid"] is not False for p in parts) if verify else None}


def merge_stores(spark: SparkSession, sources: list[str], target: str, specs: list[TableSpec] | None, policy: str = "append", verify: bool = False) -> None:
    """One database from several: append keeps all rows; last and first keep a key's row of the last or first source, and
    need specs for the keys. Tables that aren't declared are taken over with all rows. Indexes are to be rebuilt."""
    from ..operators.dml import merge

    if not sources:
        raise ValueError("there is nothing to merge")
    if policy != "append" and not specs:
        raise ValueError(f"policy {policy} needs the tables' declarations")
    stores = [Store(spark, s) for s in sources]
    if verify and (bad := [s.path for s in stores if not s.inspect()["crc_valid"]]):
        raise ValueError(f"checksums differ in {', '.join(bad)}")
    by_name = {n: s for s in specs or [] for n in (s.name, *s.aliases)}
    parts: dict[str, list[DataFrame]] = {}
    keys: dict[str, tuple[str, str]] = {}
    for store in stores:
        for name, table in (store.manifest() or {"tables": {}})["tables"].items():
            own = by_name[name].name if name in by_name else name
            if table["segments"]:
                parts.setdefault(own, []).append(migrated(store._live(table), by_name[name], None) if name in by_name else store._live(table))
                keys.setdefault(own, (table["key"], table["schema"]))
    entries, out = {}, Store(spark, target)
    for name, dfs in parts.items():
        rows = merge(dfs, keys[name][0], policy if name in by_name else "append")
        schema = by_name[name].schema().json() if name in by_name else keys[name][1]
        entries[name] = {"key": keys[name][0], "schema": schema, "next": 1, "segments": [{"seq": 0, **out._write(rows, name, "rows")}], "dead": [], "indexes": {}}
    out._commit(lambda m: m | {"tables": entries})
