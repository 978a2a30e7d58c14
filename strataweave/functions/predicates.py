"""Predicates under the three null regimes of the query front ends.

R1 two-valued and aware of absent keys (AQL, builder, SQL); R2 three-valued, which
is Spark's own (Cypher patterns); R3 for rows that an optional match left empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def eq(col: Column, value) -> Column:
    """R1 equality: absent is false, null equals null only as a literal, doubles within an epsilon."""
    if value is None:
        return col.isNull()
    if isinstance(value, float):
        return F.coalesce(F.abs(col - F.lit(value)) < EPSILON, F.lit(False))
    return F.coalesce(col == _lit(value), F.lit(False))


def ne(col: Column, value) -> Column:
    """R1 inequality: absent is true."""
    return ~eq(col, value)


def _ordered(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def gt(col: Column, value) -> Column:
    return _ordered(col > _lit(value))


def ge(col: Column, value) -> Column:
    return _ordered(col >= _lit(value))


def lt(col: Column, value) -> Column:
    return _ordered(col < _lit(value))


def le(col: Column, value) -> Column:
    return _ordered(col <= _lit(value))


def is_in(col: Column, values: list) -> Column:
    return F.coalesce(col.isin(*values), F.lit(False)) if values else F.lit(False)


def contains(col: Column, part: str) -> Column:
    return _ordered(col.contains(part))


def starts_with(col: Column, part: str) -> Column:
    return _ordered(col.startswith(part))


def ends_with(col: Column, part: str) -> Column:
    return _ordered(col.endswith(part))


def exists(col: Column) -> Column:
    return col.isNotNull()


def not_exists(col: Column) -> Column:
    return col.isNull()


def compare(regime: str, op: str, col: Column, value, bound: Column | None = None) -> Column:
    """col op value under a regime; bound: for R3, whether the optional variable matched."""
    if regime == "R2":
        value = _lit(value)
        return {"=": col == value, "<>": col != value, ">": col > value, ">=": col >= value, "<": col < value, "<=": col <= value}[op]
    r1 = {"=": eq, "<>": ne, ">": gt, ">=": ge, "<": lt, "<=": le}[op](col, value)
    if regime == "R1":
        return r1
    empty = F.lit(op == "=" and value is None)
    return F.when(bound, r1).otherwise(empty)
