"""Aggregates whose results differ from Spark's of the same name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import define

define("collect", "collect_list({0})", 1)
define("fusion", "flatten(collect_list({0}))", 1)
define("intersection", "aggregate(collect_list({0}), collect_list({0})[0], (a, x) -> array_intersect(a, x))", 1)


def sum_distinct(column: str) -> Column:
    """0, not NULL, if all values are NULL."""
    return F.coalesce(F.sum_distinct(F.col(column)), F.lit(0))


def string_agg(column: str, separator: str, order: bool = True) -> Column:
    """NULLs are skipped. Sorted by default, so that the result doesn't depend on how rows are dealt out."""
    values = F.collect_list(F.col(column))
    return F.array_join(F.array_sort(values) if order else values, separator)


def every(condition: Column) -> Column:
    return F.bool_and(condition)


def some(condition: Column) -> Column:
    return F.bool_or(condition)
