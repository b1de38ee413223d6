"""Joins. Strategy is Catalyst's and AQE's unless one is asked for; broadcast only below a checked size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = {"broadcast": "broadcast", "hash": "shuffle_hash", "merge": "merge", "auto": None}
#: Bytes, by Catalyst's estimate, up to which a side may be broadcast: joins, cross joins.
BROADCAST, CROSS = 5 << 20, 1 << 20


def size_of(frame: DataFrame) -> int:
    return int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def join(left: DataFrame, right: DataFrame, on: Column | list[str], how: str = "inner", strategy: str = "auto") -> DataFrame:
    """inner, left, right, full, left_semi, left_anti, right_semi, right_anti. NULL keys match nothing.

    strategy broadcast holds only if the right side is measured to be small enough, else Spark chooses.
    """
    if how in ("right_semi", "right_anti"):
        return join(right, left, on, how.replace("right", "left"), strategy)
    hint = STRATEGIES[strategy]
    if hint == "broadcast" and size_of(right) > BROADCAST:
        hint = None
    return left.join(right.hint(hint) if hint else right, on, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """An equality of all columns of the same name, each once in the result."""
    names = [c for c in left.columns if c in right.columns]
    if not names:
        raise ValueError("a natural join needs a column of the same name on both sides")
    return left.join(right, names, how)


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs; one side must be measured to be small."""
    if min(size_of(left), size_of(right)) > CROSS:
        raise ValueError("a cross join needs a side of at most 1 MB")
    return left.crossJoin(right)


def theta(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Any condition. Equalities in it become the keys; without any, Spark nests loops over a broadcast side."""
    return left.join(right, condition, how)


def union_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both sides, each with NULLs for the other's columns."""
    return left.unionByName(right, allowMissingColumns=True)


def band(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, equal: list[str] = (), how: str = "inner") -> DataFrame:
    """Rows with left.value in [right.low, right.high]: an equality of cells of ``width`` and a check, no cross join."""
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    keyed = right.withColumn("_cell", F.explode(cells))
    on = (F.floor(left[value] / width) == keyed["_cell"]) & (left[value] >= keyed[low]) & (left[value] <= keyed[high])
    for c in equal:
        on = on & (left[c] == keyed[c])
    return left.join(keyed, on, how).drop("_cell")


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, values: list[str], bucket: float | None = None) -> DataFrame:
    """Each left row with the values of the last right row of the same key at or before its time.

    One union and one window: a single shuffle by key, no pairs.  With a bucket (seconds of a timestamp, or units of a
    number) the window is by key and bucket, so that a key with very many rows is dealt out by time; what the buckets before
    leave is one row a key and bucket, carried on by a second window and joined.
    """
    a = left.select(*left.columns, F.col(time).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    b = right.select(*[(F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    rows = a.unionByName(b)
    own = F.struct(*[F.col(f"_{v}") for v in values])
    keys = list(by)
    if bucket:
        kind = left.schema[time].dataType.typeName()
        clock = F.unix_micros(F.col("_t").cast("timestamp")) / 1e6 if kind.startswith("timestamp") else F.col("_t").cast("double")
        rows, keys = rows.withColumn("_bucket", F.floor(clock / bucket)), [*by, "_bucket"]
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_last", F.last(F.when(F.col("_side") == 0, own), ignorenulls=True).over(w)).filter("_side = 1")
    if bucket:
        lasts = rows.groupBy(*keys).agg(F.max_by(F.when(F.col("_side") == 0, own), F.when(F.col("_side") == 0, F.col("_t"))).alias("_own"))
        before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = lasts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.last("_own", ignorenulls=True).over(before).alias("_carried"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        found = found.join(carried, reduce(lambda x, y: x & y, same), "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return found.select(*left.columns, *[F.col(f"_last._{v}").alias(v) for v in values])


def salted(left: DataFrame, right: DataFrame, keys: list[str], parts: int = 32, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are dealt out: the left side over ``parts`` tasks a key, the right side copied to each.

    For inner, left, left_semi and left_anti, and for a right side that is small for each key.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} can't be salted")
    # By place, not by value: equal rows are dealt out too.
    a = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
