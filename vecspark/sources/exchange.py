"""JSON and XML exchange. Names are in camel case; number arrays are Base64 of their little-endian bytes, or arrays."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import TableSpec

_CODES = {"float": "<f4", "double": "<f8", "tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8"}
#: Characters that XML 1.0 can't hold.
_NOT_XML = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"


def camel(name: str) -> str:
    return name[:1].lower() + name[1:]


def _packs(kind: T.DataType) -> str | None:
    return _CODES.get(kind.elementType.simpleString()) if isinstance(kind, T.ArrayType) else None


def packed(value: Column, code: str) -> Column:
    """Number arrays as their bytes."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, code).tobytes())

    return pack(value)


def unpacked(value: Column, code: str, kind: str) -> Column:
    @F.pandas_udf(kind)
    def unpack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x, code).tolist())

    return unpack(value)


def _outward(df: DataFrame, base64: bool) -> DataFrame:
    out = []
    for f in df.schema:
        value, code = F.col(f"`{f.name}`"), _packs(f.dataType)
        if base64 and code:
            value = F.base64(packed(value, code))
        elif isinstance(f.dataType, T.BinaryType):
            value = F.base64(value)
        out.append(value.alias(camel(f.name)))
    return df.select(*out)


def _schema(spec: TableSpec, renames: dict[str, str], text: bool) -> T.StructType:
    """Of what is read: number arrays and binaries as text, under the stored names."""
    back = {new: old for old, new in renames.items()}
    fields = []
    for f in spec.schema():
        as_text = isinstance(f.dataType, T.BinaryType) or (text and _packs(f.dataType))
        fields += [T.StructField(n, T.StringType() if as_text else f.dataType) for n in dict.fromkeys((camel(f.name), camel(back.get(f.name, f.name))))]
    return T.StructType(fields)


def _inward(df: DataFrame, spec: TableSpec, renames: dict[str, str]) -> DataFrame:
    back = {new: old for old, new in renames.items()}
    out = []
    for f in spec.schema():
        names = list(dict.fromkeys((camel(back.get(f.name, f.name)), camel(f.name))))
        value, code = F.coalesce(*[F.col(f"`{n}`") for n in names]), _packs(f.dataType)
        if code:
            # what begins with a bracket is a number array, anything else Base64
            array = F.startswith(F.ltrim(value), F.lit("["))
            plain = F.from_json(F.when(array, value), f.dataType)
            value = F.coalesce(plain, unpacked(F.unbase64(F.when(~array, value)), code, f.dataType.simpleString()).cast(f.dataType))
        elif isinstance(f.dataType, T.BinaryType):
            value = F.unbase64(value)
        out.append(value.alias(f.name))
    return df.select(*out)


def export_json(df: DataFrame, path: str, base64: bool = True) -> None:
    """One object a line."""
    _outward(df, base64).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def import_json(spark: SparkSession, path: str, spec: TableSpec, renames: dict[str, str] | None = None) -> DataFrame:
    """What export_json() wrote, with Base64 or arrays, or any files of one object a line; unknown fields are skipped, and
    a line that can't be read is an error."""
    rows = spark.read.schema(_schema(spec, renames or {}, True)).option("mode", "FAILFAST").json(path)
    return _inward(rows, spec, renames or {})


def import_json_document(spark: SparkSession, path: str, set_name: str, spec: TableSpec, renames: dict[str, str] | None = None) -> DataFrame:
    """The rows of one set of files that each hold one object of sets, {set: [rows]}; other sets are skipped. A file is
    read by one task."""
    schema = T.StructType([T.StructField(camel(set_name), T.ArrayType(_schema(spec, renames or {}, True)))])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return _inward(rows.select(F.inline(camel(set_name))), spec, renames or {})


def export_json_document(tables: dict[str, DataFrame], path: str, base64: bool = True) -> None:
    """One file that holds one object of sets, {set: [rows]}. The driver writes it, with a partition's rows at a time."""
    from . import files

    def parts():
        yield "{"
        for k, (name, df) in enumerate(tables.items()):
            yield f"{', ' if k else ''}{json.dumps(camel(name))}: ["
            out = _outward(df, base64)
            rows = out.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns]), {"ignoreNullFields": "false"}).alias("j"))
            for i, r in enumerate(rows.toLocalIterator()):
                yield f"{',' if i else ''}\n{r['j']}"
            yield "]"
        yield "}"

    spark = next(iter(tables.values())).sparkSession
    files.write_lines(spark, path, parts())


def export_xml(df: DataFrame, path: str) -> None:
    """Elements Entity in a root Set; a null has no element, and white space stays as it is. Characters that XML lacks go."""
    rows = _outward(df, True)
    rows = rows.select(*[F.regexp_replace(f.name, _NOT_XML, "").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in rows.schema])
    rows.write.mode("overwrite").option("rootTag", "Set").option("rowTag", "Entity").format("xml").save(path)


def import_xml(spark: SparkSession, path: str, spec: TableSpec, renames: dict[str, str] | None = None) -> DataFrame:
    options = {"rowTag": "Entity", "mode": "FAILFAST", "ignoreSurroundingSpaces": "false"}
    return _inward(spark.read.format("xml").options(**options).schema(_schema(spec, renames or {}, True)).load(path), spec, renames or {})


def merge_import(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Imported rows are added to an empty table, and otherwise take the place of rows of equal key."""
    from ..operators.dml import add_range, upsert_range

    return add_range(old, new, key) if old.isEmpty() else upsert_range(old, new, key)
