"""Retrieval metrics over rows of (retrieved, relevant) id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hits(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant))


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    n = F.least(F.size(retrieved), F.lit(k))
    return F.when(n > 0, _hits(retrieved, relevant, k) / n).otherwise(0.0)


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    n = F.size(F.array_distinct(relevant))
    return F.when(n > 0, _hits(retrieved, relevant, k) / n).otherwise(0.0)


def grounding_precision(cited: Column, supporting: Column) -> Column:
    """Share of the cited versions that support the answer."""
    return precision_at(cited, supporting, 1 << 30)


def citation_validity(cited: Column, existing: Column) -> Column:
    """Share of the cited versions that exist."""
    return precision_at(cited, existing, 1 << 30)


def temporal_accuracy(answered: Column, believed: Column) -> Column:
    """Aggregate: share of answers equal to what was believed at the asked coordinate."""
    return F.avg(F.when(answered.eqNullSafe(believed), 1.0).otherwise(0.0))
