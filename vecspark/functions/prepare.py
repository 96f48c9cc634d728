"""Vector preparation: truncation, normalisation, half precision, 8-bit codes, and checks, as expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import Vector, doubles, norm


def searchable(v: Column) -> Column:
    """Whether a vector takes part in search: neither null nor empty."""
    return v.isNotNull() & (F.size(v) > 0)


def truncated(v: Column, dims: int | None) -> Column:
    """The first dims elements; all without dims."""
    return F.slice(v, 1, dims) if dims else v


def normalised(v: Column) -> Column:
    """v over its norm, as doubles; a zero vector stays as it is."""
    own = doubles(v)
    # a vector and its norm as a struct, so that the lambda refers to a value and not to an aggregate
    both = F.struct(own.alias("v"), norm(own).alias("n"))
    return F.transform(F.array(both), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))[0]


def sq8_scale(v: Column) -> Column:
    """The largest magnitude over 127."""
    return F.coalesce(F.array_max(F.transform(doubles(v), lambda x: F.abs(x))), F.lit(0.0)) / 127


def sq8_codes(v: Column, scale: Column) -> Column:
    """Codes from -127 to 127: quotients rounded half away from zero; zeros where scale is 0."""
    quotient = lambda x: F.try_divide(x, scale)
    code = lambda x: F.least(F.lit(127.0), F.floor(F.abs(quotient(x)) + 0.5).cast("double")) * F.signum(x)
    return F.transform(doubles(v), lambda x: F.when(scale == 0, 0.0).otherwise(code(x)).cast("tinyint"))


def sq8_decoded(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("double") * scale)


def checked(v: Column, dims: tuple[int, ...], nullable: bool, name: str) -> Column:
    """v, or an error when a row's vector has another length, or is null or empty where that isn't allowed."""
    ok = F.size(v).isin(*dims)
    bad = F.raise_error(F.concat(F.lit(f"{name}: a vector has length "), F.size(v).cast("string"), F.lit(f", not {' or '.join(map(str, dims))}")))
    missing = v if nullable else F.raise_error(F.lit(f"{name}: a vector is null or empty"))
    kind = "array<float>"
    return F.when(~searchable(v) | v.isNull(), missing.cast(kind)).when(ok, v).otherwise(bad.cast(kind))


def half(v: Column) -> Column:
    """Each element rounded to half precision (11 significant bits, ties to even, subnormals, overflow to infinity)."""

    def one(x: Column) -> Column:
        size = F.abs(x)
        power = F.greatest(F.floor(F.log2(size)), F.lit(-14)).cast("int")
        # floor(log2) may be one too large just below a power of two
        power = F.when(F.pow(F.lit(2.0), power.cast("double")) > size, F.greatest(power - 1, F.lit(-14))).otherwise(power)
        step = F.pow(F.lit(2.0), (power - 10).cast("double"))
        rounded = F.rint(size / step) * step
        return F.when(size == 0, x).when(F.isnan(x), x).when(rounded > 65504, F.signum(x) * F.lit(float("inf"))).otherwise(F.signum(x) * rounded)

    return F.transform(doubles(v), one)


def prepare_query(q: Vector, dims: int, effective: int | None, normalise: bool) -> list[float]:
    """A copy of q, truncated, then normalised."""
    if q is None:
        raise TypeError("the query vector is None")
    own = np.asarray(q, np.float64).ravel()
    if len(own) not in {dims, effective or dims}:
        raise ValueError(f"the query vector has length {len(own)}, not {dims}" + (f" or {effective}" if effective else ""))
    own = own[: effective or dims].copy()
    size = float(np.sqrt(own @ own))
    return (own / size if normalise and size > 0 else own).tolist()
