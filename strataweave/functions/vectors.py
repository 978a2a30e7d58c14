"""Dense and sparse vector arithmetic as column expressions, computed in doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as zero.
#: A similarity of the user's own: two columns of doubles to a column, higher is nearer.
Metric = Callable[[Column, Column], Column]
TINY = 1e-12


def _doubles(v: Column | list[float]) -> Column:
    if isinstance(v, list):
        v = F.lit([float(x) for x in v])
    return v.cast("array<double>")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once: inside a lambda, an outer expression would be evaluated per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def same_dimension(a: Column, b: Column) -> Column:
    """a, or an error where the dimensions differ."""
    a, b = _doubles(a), _doubles(b)
    clash = F.size(a) != F.size(b)
    return F.when(clash, F.raise_error("vector dimensions differ").cast("array<double>")).otherwise(a)


def dot(a: Column | list[float], b: Column | list[float]) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def magnitude_squared(a: Column | list[float]) -> Column:
    return _total(F.transform(_doubles(a), lambda x: x * x))


def magnitude(a: Column | list[float]) -> Column:
    return F.sqrt(magnitude_squared(a))


def normalize(a: Column | list[float]) -> Column:
    """Unit vector; a near-zero vector as it is."""
    return let(_doubles(a), lambda v: let(magnitude(v), lambda n: F.when(n > TINY, F.transform(v, lambda x: x / n)).otherwise(v)))


def is_normalized(a: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(magnitude(a) - 1) <= tolerance


def cosine(a: Column | list[float], b: Column | list[float]) -> Column:
    """Clamped to [-1, 1]; 0 where either is empty or near zero."""
    a, b = _doubles(a), _doubles(b)
    ratio = lambda n: F.when(n > TINY, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)
    return let(magnitude(a) * magnitude(b), ratio)


def euclidean_squared(a: Column | list[float], b: Column | list[float]) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column | list[float], b: Column | list[float]) -> Column:
    return F.sqrt(euclidean_squared(a, b))


def angular(a: Column, b: Column) -> Column:
    return F.acos(cosine(a, b))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing entries."""
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))


def tanimoto(a: Column, b: Column) -> Column:
    both = dot(a, b)
    return both / (magnitude_squared(a) + magnitude_squared(b) - both)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "cosine":
        return 1 - cosine(a, b)
    return euclidean(a, b) if metric == "euclidean" else 1 - dot(a, b)


def as_vector(values: Column | list[float]) -> Column:
    return _doubles(values)


def similarity(a: Column, b: Column, metric: str | Metric = "cosine") -> Column:
    """Higher is nearer: cosine; 1 / (1 + L2); dot product; or a function of two columns of doubles."""
    if callable(metric):
        return metric(_doubles(a), _doubles(b))
    if metric == "cosine":
        return cosine(a, b)
    return 1 / (1 + euclidean(a, b)) if metric == "euclidean" else dot(a, b)


def drift(a: Column, b: Column, metric: str = "cosine") -> Column:
    return {"cosine": lambda: 1 - cosine(a, b), "euclidean": lambda: euclidean(a, b), "angular": lambda: angular(a, b)}[metric]()


def add(a: Column, b: Column) -> Column:
    return F.zip_with(_doubles(a), _doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(_doubles(a), _doubles(b), lambda x, y: x - y)


def scale(a: Column, by: Column | float) -> Column:
    if not isinstance(by, Column):
        return F.transform(_doubles(a), lambda x: x * float(by))
    return let(by, lambda factor: F.transform(_doubles(a), lambda x: x * factor))


def array_mean(vector: str, dimension: int) -> Column:
    """Aggregate: the mean vector of a group, one average per dimension, null for an empty group."""
    parts = [F.avg(F.get(F.col(vector), F.lit(k)).cast("double")) for k in range(dimension)]
    return F.when(F.count(vector) > 0, F.array(*parts))
