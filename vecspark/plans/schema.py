"""Declared tables: a key, vector fields with their metric and index, and large binary fields."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from ..functions.metrics import Metric, resolve

#: Names of value types in schemas of other systems and what holds them here. Unsigned and half-precision types are held
#: by the next wider one; an offset timestamp keeps its offset in minutes; a GUID is its text.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampNTZType(), "guid": T.StringType(), "decimal": T.DecimalType(38, 9),
    "byte": T.ShortType(), "sbyte": T.ByteType(), "short": T.ShortType(), "ushort": T.IntegerType(), "uint": T.LongType(), "ulong": T.DecimalType(20, 0), "half": T.FloatType(), "timespan": T.DayTimeIntervalType(), "char": T.StringType(), "date": T.DateType(), "time": T.LongType(), "binary": T.BinaryType(),
    "datetimeoffset": T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("offset_min", T.ShortType())]),
}


def type_of(name: str) -> T.DataType:
    """The type for a name in TYPES, or for it with [] as an array; anything else isn't supported."""
    base, array = name.removesuffix("[]"), name.endswith("[]")
    if base not in TYPES or (array and base in {"datetimeoffset", "guid", "decimal"}):
        raise TypeError(f"type {name!r} isn't supported")
    if base == "byte" and array:
        return T.BinaryType()
    return T.ArrayType(TYPES[base]) if array else TYPES[base]


@dataclass(frozen=True)
class IndexSpec:
    """kind: flat, kdtree (both exact), ivf or hnsw. clusters None: the root of the number of rows. probes: lists that a
    search of ivf looks at, at least; it looks at more where the index measures that they hold less than the share recall
    of the nearest rows. recall None: never more."""

    kind: str = "flat"
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    clusters: int | None = None
    probes: int = 10
    recall: float | None = 0.95

    def __post_init__(self):
        if self.kind not in {"flat", "kdtree", "ivf", "hnsw"}:
            raise ValueError(f"unknown index {self.kind!r}")
        if min(self.m, self.ef_construction, self.ef_search, self.probes) <= 0 or (self.clusters is not None and self.clusters <= 0):
            raise ValueError("index parameters must be positive")
        if self.recall is not None and not 0 < self.recall <= 1:
            raise ValueError("recall must be over 0 and at most 1")


@dataclass(frozen=True)
class VectorField:
    """effective: leading dimensions that are used, active only between 1 and dims - 1. quantised: stored as 8-bit codes
    with a scale. half: element values have half precision."""

    name: str
    dims: int
    metric: str | Metric = "cosine"
    nullable: bool = False
    effective: int | None = None
    quantised: bool = False
    half: bool = False
    index: IndexSpec = field(default_factory=IndexSpec)

    def __post_init__(self):
        if self.dims <= 0:
            raise ValueError(f"{self.name}: dims must be positive")
        own = resolve(self.metric)
        if self.quantised and own.name == "hamming":
            raise ValueError(f"{self.name}: 8-bit codes don't go with hamming")
        if self.quantised and self.half:
            raise ValueError(f"{self.name}: 8-bit codes don't go with half precision")
        if self.effective is not None and not 0 < self.effective < self.dims:
            object.__setattr__(self, "effective", None)

    @property
    def resolved(self) -> Metric:
        return resolve(self.metric)

    @property
    def lengths(self) -> tuple[int, ...]:
        return (self.dims, self.effective) if self.effective else (self.dims,)


@dataclass(frozen=True)
class LargeField:
    """A binary payload that a scan leaves out unless it is selected."""

    name: str
    nullable: bool = True


@dataclass(frozen=True)
class TableSpec:
    """name: the stored name; aliases: other stored names that are read as this table. columns: the non-vector ones."""

    name: str
    key: str
    columns: tuple[tuple[str, str], ...]
    vectors: tuple[VectorField, ...]
    large: tuple[LargeField, ...] = ()
    defaults: tuple[tuple[str, object], ...] = ()
    aliases: tuple[str, ...] = ()

    def __post_init__(self):
        names = [n for n, _ in self.columns]
        if self.key not in names:
            raise ValueError(f"{self.name}: the key {self.key} is no column")
        if not self.vectors:
            raise ValueError(f"{self.name}: a table needs a vector field")
        every = [*names, *(v.name for v in self.vectors), *(f.name for f in self.large)]
        if len({n.lower() for n in every}) < len(every):
            raise ValueError(f"{self.name}: column names repeat")
        self.schema()

    def schema(self) -> T.StructType:
        fields = [T.StructField(n, type_of(t), n != self.key) for n, t in self.columns]
        fields += [T.StructField(v.name, T.ArrayType(T.FloatType()), v.nullable, {"vector": {"dims": v.dims, "metric": v.resolved.name, "index": v.index.kind}}) for v in self.vectors]
        return T.StructType(fields + [T.StructField(f.name, T.BinaryType(), f.nullable) for f in self.large])

    def vector(self, name: str | None = None) -> VectorField:
        """The named vector field, or the only one."""
        if name is None:
            if len(self.vectors) != 1:
                raise LookupError(f"{self.name} has {len(self.vectors)} vector fields; name one")
            return self.vectors[0]
        for v in self.vectors:
            if v.name == name:
                return v
        raise ValueError(f"{name!r} is no vector field of {self.name}")

    def with_vector(self, name: str, **changes) -> TableSpec:
        return replace(self, vectors=tuple(replace(v, **changes) if v.name == name else v for v in self.vectors))
