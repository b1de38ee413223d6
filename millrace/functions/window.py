"""Window functions, in the dialect's way: an aggregate in OVER() always covers the whole partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def nulls_largest(column: str, ascending: bool = True) -> Column:
    """NULL sorts as the largest value."""
    return F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_first()


def over(partition: list[str], order: list[str | tuple[str, bool]] = ()) -> WindowSpec:
    """A window; order: names, or (name, ascending)."""
    w = Window.partitionBy(*partition)
    return w.orderBy(*[nulls_largest(*((o,) if isinstance(o, str) else o)) for o in order]) if order else w


def whole(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def aggregate(column: Column, window: WindowSpec) -> Column:
    return column.over(whole(window))


def first_value(column: str, window: WindowSpec) -> Column:
    """The first row's value; a NULL is kept."""
    return F.first(column).over(whole(window))


def last_value(column: str, window: WindowSpec) -> Column:
    """The last value that isn't NULL."""
    return F.last(column, ignorenulls=True).over(whole(window))


def lag(column: str, window: WindowSpec, offset: int = 1, default=None) -> Column:
    return F.lag(column, offset, default).over(window)


def lead(column: str, window: WindowSpec, offset: int = 1, default=None) -> Column:
    return F.lead(column, offset, default).over(window)


def rank(window: WindowSpec | None = None) -> Column:
    """1 for all rows without an order."""
    return F.rank().over(window) if window is not None else F.lit(1)


def row_number(window: WindowSpec) -> Column:
    return F.row_number().over(window)


def placed(frame: DataFrame, order: list[Column], calls: dict[str, tuple[str, int]], folder: str) -> DataFrame:
    """Functions of all rows in an order, without a task that has all rows. calls: name -> (function, n of ntile).

    Rows are dealt out by ranges of the order, sorted and written once to ``folder`` with their places within the range, so
    that they keep them; a range's rows before it are counted.  Rows of equal order are in one range if there are ranks, else they
    are dealt out too.  The driver sees a row for each range.
    """
    ranked = any(f not in ("row_number", "ntile") for f, _ in calls.values())
    frame.repartitionByRange(*order, *([] if ranked else [F.xxhash64(*frame.columns)])).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(folder)
    rows = frame.sparkSession.read.parquet(folder)
    rows = rows.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    w = Window.partitionBy("_range").orderBy(*order)
    if (ranks := {f for f, _ in calls.values()} - {"row_number", "ntile"}) - {"cume_dist"}:
        rows = rows.withColumns({"_rank": F.rank().over(w).cast("long"), "_dense": F.dense_rank().over(w).cast("long")})
    if "cume_dist" in ranks:
        rows = rows.withColumn("_upto", F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), (F.max("_dense") if "dense_rank" in ranks else F.lit(0)).alias("d")).orderBy("_range").collect()
    total, different, before = 0, 0, []
    for c in counts:
        before.append((c["_range"], total, different))
        total, different = total + c.n, different + c.d
    rows = rows.join(F.broadcast(frame.sparkSession.createDataFrame(before, "_range long, _before long, _different long")), "_range")
    place = F.col("_before") + F.col("_at") + 1

    def value(function: str, n: int) -> Column:
        if function == "ntile":  # the first parts have a row more
            size, more = divmod(total, n)
            late = F.floor((place - 1 - more * (size + 1)) / max(size, 1)) + more + 1
            return F.when(place <= more * (size + 1), F.floor((place - 1) / (size + 1)) + 1).otherwise(late).cast("int")
        if function == "percent_rank":
            return (F.col("_before") + F.col("_rank") - 1) / F.lit(float(max(total - 1, 1)))
        if function == "cume_dist":
            return (F.col("_before") + F.col("_upto")) / F.lit(float(total))
        return {"row_number": lambda: place, "rank": lambda: F.col("_before") + F.col("_rank"), "dense_rank": lambda: F.col("_different") + F.col("_dense")}[function]().cast("int")

    return rows.select(*frame.columns, *[value(f, n).alias(name) for name, (f, n) in calls.items()])
