"""Vector expressions: distances, scores, sparse products, 8-bit codes. Floats are computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Metric


def doubles(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _sized(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(value)


def dot(a: Column, b: Column) -> Column:
    """0 for lists of different lengths."""
    return _sized(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y)))


def l2_squared(a: Column, b: Column) -> Column:
    return _sized(a, b, _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; 0 beside a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def score(a: Column, b: Column, metric: Metric) -> Column:
    """Higher is better for each metric: similarity, product, or the negative squared distance."""
    return {Metric.COSINE: cosine, Metric.DOT: dot, Metric.EUCLIDEAN: lambda x, y: 0.0 - l2_squared(x, y)}[Metric.parse(metric)](a, b)


def parse_vector(text: Column) -> Column:
    """'0.1,0.2' to array<float>; an error on anything else."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("float"))


def sparse_from_pairs(pairs: Column) -> Column:
    """array<struct<index, weight>> to struct<indices, values> by index."""
    ordered = F.array_sort(pairs)
    return F.struct(F.transform(ordered, lambda p: p["index"].cast("long")).alias("indices"), F.transform(ordered, lambda p: p["weight"].cast("float")).alias("values"))


def sparse_dot(a: Column, b: Column) -> Column:
    """Product of two struct<indices, values>."""
    m = F.map_from_arrays(b["indices"], b["values"])
    return F.aggregate(F.arrays_zip(a["indices"].alias("i"), a["values"].alias("v")), F.lit(0.0), lambda s, x: s + F.coalesce(x["v"].cast("double") * F.try_element_at(m, x["i"]).cast("double"), F.lit(0.0)))


def encode(v: Column, low: Column, high: Column) -> Column:
    """The 8-bit code of a value between low and high."""
    span = F.greatest(high - low, F.lit(1e-8))
    return F.round(F.least(F.greatest((v - low) / span, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def decode(code: Column, low: Column, high: Column) -> Column:
    return low + code / F.lit(255.0) * (high - low)


def unit_vector(seed: int, key: Column, dimension: int) -> Column:
    """A deterministic unit vector: uniform in (-0.5, 0.5) by hash of (seed, key, place), then normalised."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(1 << 30)) / F.lit(float(1 << 30)) - 0.5)
    return F.transform(F.array(raw), lambda r: F.transform(r, lambda x: (x / F.greatest(norm(r), F.lit(1e-12))).cast("float")))[0]


def index_bytes(n: Column, dimension: int) -> Column:
    return n * F.lit(dimension * 4 + 256 + 64)
