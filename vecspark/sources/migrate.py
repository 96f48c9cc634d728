"""Schema migration on read: renames, type coercion, removed and added fields, and value transforms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import TableSpec

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Rules:
    """renames: stored name to declared name. transforms: declared name to a function of its column, after coercion;
    names that the table doesn't have are passed over."""

    renames: dict[str, str] = field(default_factory=dict)
    transforms: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def rename(self, old: str, new: str) -> Rules:
        self.renames[old] = new
        return self

    def transform(self, name: str, how: Callable[[Column], Column]) -> Rules:
        self.transforms[name] = how
        return self


def zero(kind: T.DataType) -> object:
    """What a value type holds where it is not set; null for others."""
    if isinstance(kind, T.BooleanType):
        return False
    return 0 if isinstance(kind, T.NumericType) else None


def coerced(value: Column, old: T.DataType, new: T.DataType, default: object) -> Column:
    """value as the new type: whole numbers from fractions round half to even; what doesn't fit has the default, a null
    stays null for types that can be null and is the default for others."""
    if old == new:
        return value
    fallback = F.lit(zero(new) if default is None else default).cast(new)
    name = new.simpleString()
    if isinstance(new, _WHOLE) and isinstance(old, (T.FloatType, T.DoubleType, T.DecimalType)):
        value = F.rint(value.cast("double"))
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return value.cast(new)
    if isinstance(old, T.DayTimeIntervalType) and isinstance(new, T.LongType):  # microseconds
        part = lambda unit, seconds: F.extract(F.lit(unit), value).cast("long") * (seconds * 1_000_000)
        return F.coalesce(part("DAY", 86400) + part("HOUR", 3600) + part("MINUTE", 60) + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("long"), fallback)
    if isinstance(new, T.StructType) and isinstance(old, (T.TimestampType, T.TimestampNTZType)):
        return F.struct(value.cast("timestamp").alias("ts"), F.lit(0).cast("short").alias("offset_min"))
    if isinstance(old, (T.StructType, T.MapType, T.BinaryType)) or isinstance(new, (T.StructType, T.MapType)):
        return fallback
    return F.coalesce(value.try_cast(name), fallback)


def migrated(rows: DataFrame, spec: TableSpec, rules: Rules | None) -> DataFrame:
    """rows in the declared schema of spec."""
    rules, defaults, out = rules or Rules(), dict(spec.defaults), []
    back = {new: old for old, new in rules.renames.items()}
    have = {f.name: f.dataType for f in rows.schema}
    for f in spec.schema():
        source = back[f.name] if back.get(f.name) in have else f.name
        if source in have and (source == f.name or f.name in back):
            value = coerced(F.col(f"`{source}`"), have[source], f.dataType, defaults.get(f.name))
        else:
            value = F.lit(defaults.get(f.name, zero(f.dataType))).cast(f.dataType)
        if f.name in rules.transforms:
            value = rules.transforms[f.name](value).cast(f.dataType)
        out.append(value.alias(f.name))
    return rows.select(*out)


def upgrade(spark: SparkSession, source: str, target: str, specs: dict[str, TableSpec], rules: dict[str, Rules] | None = None, overwrite: bool = False, delete_source: bool = False) -> None:
    """Rewrites a directory of older layout, one Parquet directory for each stored table name, as a database. specs: the
    declared table of each stored name; a stored, not empty name without one is refused before anything is written."""
    from . import files
    from .storage import Store

    if Store(spark, source).versions():
        raise ValueError(f"{source} is a database already")
    if Store(spark, target).versions() and not overwrite:
        raise FileExistsError(target)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(source)
    names = sorted(s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if s.isDirectory())
    stored = {n: spark.read.parquet(f"{source}/{n}") for n in names}
    if missing := [n for n, df in stored.items() if n not in specs and not df.isEmpty()]:
        raise ValueError(f"no table is declared for {', '.join(missing)}")
    Store(spark, target).save({specs[n].name: (specs[n], migrated(df, specs[n], (rules or {}).get(n))) for n, df in stored.items() if n in specs})
    if delete_source:
        files.delete(spark, source)
