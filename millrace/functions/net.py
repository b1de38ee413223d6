"""IPv4 functions; country look-ups over a table of ranges that the caller gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import define

_NUMBER = "aggregate(transform(split({0}, '[.]'), x -> cast(x as bigint)), 0L, (a, x) -> a * 256 + x)"
define("ipstr_to_int", f"cast({_NUMBER} as int)", 1)
define("ipstr_to_blob", f"unhex(lpad(hex({_NUMBER}), 8, '0'))", 1)
define("int_to_ipstr", "concat_ws('.', shiftrightunsigned({0}, 24) & 255, shiftrightunsigned({0}, 16) & 255, shiftrightunsigned({0}, 8) & 255, {0} & 255)", 1)
define("bin_to_ipstr", "concat_ws('.', transform(sequence(0, 3), k -> conv(substr(hex({0}), 2 * k + 1, 2), 16, 10)))", 1)


def with_country(frame: DataFrame, address: str, ranges: DataFrame, to: str = "country") -> DataFrame:
    """Adds the country of an IPv4 text. ranges: (first long, last long, code string), not overlapping.

    A range join by /16 prefix: ranges are cut at prefixes, so that the join is an equality with a check and no cross
    join. An address without a range, and what is no address, gets NULL.
    """
    number = F.expr(_NUMBER.replace("{0}", f"`{address}`"))
    cut = ranges.select("first", "last", F.col("code").alias(to), F.explode(F.sequence(F.shiftright("first", 16), F.shiftright("last", 16))).alias("_p"))
    keyed = frame.withColumn("_n", number).withColumn("_q", F.shiftright("_n", 16))
    return keyed.join(cut, (F.col("_p") == F.col("_q")) & F.col("_n").between(F.col("first"), F.col("last")), "left").drop("_n", "_q", "_p", "first", "last")
