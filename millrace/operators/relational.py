"""Aggregation, order, sets and partitioned writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(frame: DataFrame, keys: list[str], *aggregates: Column, having: Column | str | None = None) -> DataFrame:
    out = (frame.groupBy(*keys) if keys else frame).agg(*aggregates)
    return out if having is None else out.filter(having)


def hot_grouped(frame: DataFrame, keys: list[str], partial: dict[str, tuple[str, str]], parts: int = 32) -> DataFrame:
    """Aggregates that can't be combined before the shuffle, in two steps by salt. partial: name -> (min, max or sum; column)."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(parts))
    first = frame.withColumn("_salt", salt).groupBy(*keys, "_salt").agg(*[getattr(F, f)(c).alias(n) for n, (f, c) in partial.items()])
    return first.groupBy(*keys).agg(*[getattr(F, f)(n).alias(n) for n, (f, _) in partial.items()])


def sort(frame: DataFrame, *items: str | tuple[str, bool]) -> DataFrame:
    """A total order over all partitions; (name, ascending); NULL is the largest value."""
    from ..functions.window import nulls_largest

    return frame.orderBy(*[nulls_largest(*((i,) if isinstance(i, str) else i)) for i in items])


def top(frame: DataFrame, n: int, *items: str | tuple[str, bool]) -> DataFrame:
    """The first n rows of an order: each task keeps n."""
    return sort(frame, *items).limit(n)


def union(left: DataFrame, right: DataFrame, distinct: bool = True) -> DataFrame:
    out = left.union(right)
    return out.distinct() if distinct else out


def intersect(left: DataFrame, right: DataFrame, distinct: bool = True) -> DataFrame:
    return left.intersect(right) if distinct else left.intersectAll(right)


def except_(left: DataFrame, right: DataFrame, distinct: bool = True) -> DataFrame:
    return left.subtract(right) if distinct else left.exceptAll(right)


def store_partitioned(frame: DataFrame, path: str, by: list[str], overwrite: bool = False, kind: str = "parquet") -> None:
    """Hive-style directories. Rows are dealt out by partition, large ones over several tasks; with overwrite only the
    partitions that get rows are replaced."""
    rows = frame.hint("rebalance", *[F.col(c) for c in by])
    rows.write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(kind).save(path)
