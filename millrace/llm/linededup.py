"""Line dedup by site-relative frequency, in DataFrame operations only.

Lines are what ``\\n`` splits.  For every host, a line's frequency is the number of the host's different pages that
contain it over the number of its different pages; equal pages count once, so a group of copies isn't boilerplate.
Lines above ``RATIO`` that at least ``PAGES`` pages contain are dropped from every page of the host.  A host has at most
(mean lines of a page) / RATIO such lines, so its list is short.  The lists are written and measured: up to
``BROADCAST_LINES`` lines in all they are broadcast, and no text is shuffled; beyond, they are joined by host and salt, so
that a hot host's pages are dealt out over ``SALTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import as_text, cut, fresh

RATIO, PAGES = 0.05, 5
#: Lines (8 bytes each) of all hosts together up to which their lists are broadcast; parts of a host beyond.
BROADCAST_LINES, SALTS = 1_000_000, 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike("[^ \\t-\\r]")


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = PAGES) -> DataFrame:
    """pages: (host, text) -> one row per host with boilerplate: (host, lines array<long>, hashes)."""
    hashed = pages.select("host", F.xxhash64("text").alias("page"), F.transform(F.array_distinct(F.filter(_lines(F.col("text")), _has_word)), lambda line: F.xxhash64(line)).alias("own"))
    # Partial aggregation makes a line that all pages share, and a hot host, one row a task before any shuffle by them.
    # One row a page and line; then a row a page that has them counted.
    distinct = hashed.select("host", "page", F.explode("own").alias("line")).distinct()
    counted = distinct.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    totals = hashed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    return counted.join(totals, "host").filter(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_lines(pages: DataFrame, host_column: str = "source", text_column: str = "text", ratio: float = RATIO, least: int = PAGES, count_as: str | None = None) -> DataFrame:
    """The pages, with all their columns, without their hosts' boilerplate lines; ``count_as``: a column for how many.

    A null text stays null, an empty one empty; lines without a word are never boilerplate; a page of nothing but
    boilerplate becomes empty.  Null hosts are one host.  Repeated rows stay, and count as one page.  An empty table stays
    empty.  Other columns aren't touched, whatever their names.
    """
    host = F.coalesce(as_text(host_column), F.lit("\0"))
    lists = boilerplate(pages.select(host.alias("host"), as_text(text_column).alias("text")).filter("text is not null"), ratio, least)
    names = pages.columns
    its_host, lines, its_salt = (fresh(n, names) for n in ("_host", "_lines", "_salt"))
    lists = cut(lists.select(F.col("host").alias(its_host), F.col("lines").alias(lines)))
    if (lists.agg(F.sum(F.size(lines) + 4)).collect()[0][0] or 0) <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(lists), host == F.col(its_host), "left")
    else:
        dealt = lists.withColumn(its_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(as_text(text_column)), F.lit(SALTS))
        joined = pages.join(dealt, (host == F.col(its_host)) & (salt == F.col(its_salt)), "left")
    text, bad = as_text(text_column), F.col(lines)
    keep = F.filter(_lines(text), lambda line: ~F.array_contains(bad, F.xxhash64(line)) | ~_has_word(line))
    cleaned = F.when(bad.isNull(), text).otherwise(F.array_join(keep, "\n"))
    dropped = [(F.when(text.isNull() | bad.isNull(), F.lit(0)).otherwise(F.size(_lines(text)) - F.size(keep))).cast("long").alias(count_as)] if count_as else []
    return joined.select(*[cleaned.alias(c) if c == text_column else F.col(f"`{c}`") for c in names], *dropped)


def oracle(ratio: float = RATIO, least: int = PAGES) -> str:
    return rf"""
with pages as (select doc_id, coalesce(source, chr(1)) host, text, string_split(text, chr(10)) own from documents),
lines as (select distinct host, text, unnest(own) line from pages where text is not null),
counted as (select host, line, count(*) n from lines where regexp_matches(line, '[^ \t-\r]') group by 1, 2),
totals as (select host, count(distinct text) pages from pages where text is not null group by 1),
bad as (select host, list(line) drop_list from counted join totals using (host) where n >= {least} and n > {ratio} * pages group by 1)
select doc_id,
  case when drop_list is null or text is null then text
       else array_to_string([x for x in own if not list_contains(drop_list, x)], chr(10)) end as text,
  cast(case when drop_list is null or text is null then 0
       else len(own) - len([x for x in own if not list_contains(drop_list, x)]) end as bigint) as n_dropped
from pages left join bad using (host)
"""
