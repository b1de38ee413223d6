"""The registered queries of the engine: each with a DuckDB twin where SQL can express it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources, streaming
from .engine import Engine
from .functions import window as W
from .functions.aggregate import string_agg, sum_distinct
from .functions.registry import call, quoted
from .operators import joins, relational
from .session import place as _place
from .udf import output_type, two_phase

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def engine(spark: SparkSession, sf_dir: str, windows: str = "whole") -> Engine:
    """One engine for a session, folder and mode: the tables are registered once."""
    kept = spark.__dict__.setdefault("_millrace_engines", {})
    if (sf_dir, windows) not in kept:
        kept[sf_dir, windows] = Engine(spark, windows).register(sf_dir, TABLES)
    return kept[sf_dir, windows]


def sql(name: str, text: str, oracle: str | None = None, windows: str = "whole") -> None:
    """A query in the dialect; its oracle is the same text unless one is given."""
    named = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, windows)
        for t in named:  # files may have changed since they were registered
            e.spark.catalog.refreshTable(t)
        return e.sql(text)

    QUERIES[name] = run
    ORACLES[name] = oracle or text


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Projection, predicates, expressions

sql("scan_project", "select l_orderkey, l_extendedprice from lineitem where l_shipdate < timestamp '1996-01-01 00:00:00'")
sql("filter_and_or", "select o_orderkey, o_totalprice from orders where (o_orderstatus = 'F' or o_orderstatus = 'P') and not o_totalprice < 1000")
sql("filter_between_sym", "select p_partkey, p_size from part where p_size between symmetric 30 and 10", "select p_partkey, p_size from part where p_size between 10 and 30")
sql("filter_in_list", "select n_nationkey, n_name from nation where n_regionkey in (1, 3)")
sql("filter_like", "select p_partkey, p_name from part where p_name like '%ri_g' or p_type like 'E%'")
sql("filter_ilike", "select c_custkey, c_mktsegment from customer where c_mktsegment ilike 'b%'")
sql("filter_regex_full", "select p_partkey from part where p_brand ~ 'Brand#[12]\\d' and p_name !~* 'x.*'", "select p_partkey from part where regexp_full_match(p_brand, 'Brand#[12]\\d') and not regexp_full_match(p_name, '(?i)x.*')")
sql("filter_similar_to", "select p_partkey from part where p_brand similar to 'Brand#(1|2)_'", "select p_partkey from part where p_brand similar to 'Brand#(1|2).'")
sql("filter_is_null", "select count(*) as n from customer where c_acctbal is not null and not (c_name is null)")
sql("filter_is_true", "select o_orderkey from orders where (o_totalprice > 100000) is true and (o_custkey > 50) is not false")
sql("case_simple", "select o_orderstatus, count(*) as n, sum(case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end) as s from orders group by o_orderstatus", "select o_orderstatus, count(*) as n, cast(sum(case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end) as bigint) as s from orders group by o_orderstatus")
sql("case_searched", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as kind from part")
sql("cast_chain", "select l_orderkey, l_linenumber, l_quantity::int4::text as q, cast(l_linenumber as float8) as f from lineitem", "select l_orderkey, l_linenumber, l_quantity::int4::text as q, cast(l_linenumber as double) as f from lineitem")
sql("int_division", "select p_partkey, p_size / 7 as d, (p_size - 25) / 0 as z from part", "select p_partkey, cast(p_size // 7 as int) as d, cast(null as int) as z from part")
sql("mod_guard", "select p_partkey, p_size % 7 as m, mod(p_size - 25, 3) as s, p_size % 0 as z from part", "select p_partkey, p_size % 7 as m, (p_size - 25) % 3 as s, cast(null as int) as z from part")
sql("concat_null", "select c_custkey, concat(c_name, null, '-', c_mktsegment) as a, c_name || '-' || c_mktsegment as b from customer", "select c_custkey, concat(c_name, null, '-', c_mktsegment) as a, c_name || '-' || c_mktsegment as b from customer")
sql("extract_fields", "select o_orderkey, extract(year from o_orderdate) as y, extract(dow from o_orderdate) as w, extract(century from o_orderdate) as c, date_part('quarter', o_orderdate) as q from orders", "select o_orderkey, cast(extract(year from o_orderdate) as double) as y, cast(extract(dow from o_orderdate) as double) as w, cast(extract(century from o_orderdate) as double) as c, cast(extract(quarter from o_orderdate) as double) as q from orders")
sql("no_from", "select 1 + 1 as a, 'x' || 'y' as b, null is null as c")
sql("derived_table", "select k, n from (select l_suppkey as k, count(*) as n from lineitem group by l_suppkey) t where n > 10")
sql("asterisk", "select n.*, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey")
sql("scalar_subquery", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")

# Joins

sql("join_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
sql("join_left", "select c_custkey, o_orderkey from customer left outer join orders on c_custkey = o_custkey and o_totalprice > 200000")
sql("join_right", "select n_name, s_suppkey from supplier right outer join nation on s_nationkey = n_nationkey")
sql("join_full", "select c_custkey, s_suppkey from customer full outer join supplier on c_custkey = s_suppkey * 2")
sql("join_cross", "select r_name, n_name from region cross join nation")
sql("join_theta", "select a.n_nationkey as x, b.n_nationkey as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
sql("join_comma", "select n_name, r_name from nation, region where n_regionkey = r_regionkey and r_name <> 'ASIA'")
sql("join_semi_in", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 250000)")
sql("join_anti_notin", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_totalprice > 300000)")
sql("join_anti_notin_null", "select c_custkey from customer where c_custkey not in (select nullif(o_custkey, 5) from orders where o_totalprice > 300000) union all select count(*) from customer where c_custkey in (select nullif(o_custkey, 5) from orders where o_totalprice > 300000)")
sql("join_exists", "select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 49)")
sql("join_not_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
sql("join_self", "select count(*) as n from nation a join nation b on a.n_regionkey = b.n_regionkey")
sql("join_many", "select n_name, count(*) as n, cast(sum(cast(l_extendedprice as numeric(18, 6))) as float8) as v from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by n_name", "select n_name, count(*) as n, cast(sum(cast(l_extendedprice as numeric(18, 6))) as float8) as v from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by n_name")
sql("join_null_keys", "select a.k as ak, b.k as bk from (select nullif(n_regionkey, 0) as k from nation) a left join (select nullif(r_regionkey, 0) as k from region) b on a.k = b.k")


def _renamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "k"), table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "k")


@query("select n_regionkey as k, n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def join_natural(spark, sf_dir):
    return joins.natural(*_renamed(spark, sf_dir))


@query("select n_regionkey as k, n_nationkey, n_name, r_name from nation left join region on n_regionkey = r_regionkey")
def join_using(spark, sf_dir):
    a, b = _renamed(spark, sf_dir)
    return joins.join(a, b, ["k"], "left")


_STRATEGY = "select o_orderstatus, c_mktsegment, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2"


def _strategy(strategy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
        return joins.join(o, c, o.o_custkey == c.c_custkey, strategy=strategy).groupBy("o_orderstatus", "c_mktsegment").agg(F.count("*").alias("n"))

    return run


for _s in ("broadcast", "hash", "merge"):
    QUERIES[f"join_{_s}"], ORACLES[f"join_{_s}"] = _strategy(_s), _STRATEGY


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier where not exists (select 1 from customer where c_nationkey = s_nationkey and c_acctbal > 9800)")
def join_right_anti(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").filter("c_acctbal > 9800"), table(spark, sf_dir, "supplier")
    return joins.join(c, s, c.c_nationkey == s.s_nationkey, "right_anti")


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier where exists (select 1 from customer where c_nationkey = s_nationkey and c_acctbal > 9000)")
def join_right_semi(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").filter("c_acctbal > 9000"), table(spark, sf_dir, "supplier")
    return joins.join(c, s, c.c_nationkey == s.s_nationkey, "right_semi")


@query("select r_regionkey, r_name, cast(null as int) as n_nationkey from region union all select null, null, n_nationkey from nation")
def join_union(spark, sf_dir):
    return joins.union_join(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation").select("n_nationkey"))


@query("select l_suppkey, s_name, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2")
def join_salted(spark, sf_dir):
    l, s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return joins.salted(l, s, ["k"], 8).groupBy(F.col("k").alias("l_suppkey"), "s_name").agg(F.count("*").alias("n"))


@query(
    """with e as (select event_id, user_id, ts from events where event_type <> 'purchase'), p as (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by 1, 2)
select e.event_id, p.value as last_value from e asof left join p on e.user_id = p.user_id and e.ts >= p.ts"""
)
def join_as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return joins.as_of(e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), p.withColumnRenamed("ts", "t"), ["user_id"], "ts", "t", ["last_value"]).select("event_id", "last_value")


@query("select p_partkey, s_suppkey from part join supplier on p_retailprice between s_acctbal - 5 and s_acctbal + 5")
def join_band(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 5).alias("lo"), (F.col("s_acctbal") + 5).alias("hi"))
    return joins.band(p, s, "p_retailprice", "lo", "hi", 10.0).select("p_partkey", "s_suppkey")


# Aggregation

sql("agg_global", "select count(*) as n, round(cast(avg(l_quantity) as float8), 6) as a, min(l_shipdate)::text as lo, max(l_extendedprice) as hi from lineitem", "select count(*) as n, round(avg(l_quantity), 6) as a, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') as lo, max(l_extendedprice) as hi from lineitem")
sql("agg_group", "select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as numeric(18, 6))) as float8) as q from lineitem group by l_returnflag, l_linestatus", "select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as numeric(18, 6))) as float8) as q from lineitem group by 1, 2")
sql("agg_having", "select l_suppkey, count(*) as n from lineitem group by l_suppkey having count(*) > 20 and max(l_quantity) > 45")
sql("agg_distinct_one", "select l_returnflag, count(distinct l_suppkey) as s from lineitem group by l_returnflag")
sql("agg_distinct_many", "select l_returnflag, count(distinct l_suppkey) as s, count(distinct l_partkey) as p, sum(distinct l_linenumber) as d, count(*) as n from lineitem group by l_returnflag", "select l_returnflag, count(distinct l_suppkey) as s, count(distinct l_partkey) as p, cast(sum(distinct l_linenumber) as bigint) as d, count(*) as n from lineitem group by l_returnflag")
sql("agg_stddev_var", "select l_returnflag, round(stddev_pop(l_quantity), 6) as a, round(stddev_samp(l_quantity), 6) as b, round(var_pop(l_quantity), 4) as c, round(var_samp(l_quantity), 4) as d from lineitem group by l_returnflag")
sql("agg_corr", "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem group by l_returnflag")
sql("agg_filter", "select o_orderstatus, count(*) filter (where o_totalprice > 100000) as big, count(*) as n from orders group by o_orderstatus")
sql("agg_rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
sql("agg_cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
sql("agg_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
sql("agg_bool", "select o_orderstatus, bool_and(o_totalprice > 1000) as e, bool_or(o_totalprice > 300000) as s from orders group by o_orderstatus")
sql("agg_empty", "select count(*) as n, sum(l_linenumber) as s from lineitem where l_orderkey < 0", "select count(*) as n, cast(sum(l_linenumber) as bigint) as s from lineitem where l_orderkey < 0")
sql("select_distinct", "select distinct o_orderstatus, o_orderpriority from orders")
sql("agg_expression_key", "select p_size % 5 as k, count(*) as n from part group by p_size % 5")


@query("select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by 1")
def agg_string_agg(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(string_agg("n_name", ",").alias("names"))


@query("select l_returnflag, cast(0 as bigint) as s from lineitem group by 1")
def agg_sum_distinct_allnull(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("x", F.lit(None).cast("long")).groupBy("l_returnflag").agg(sum_distinct("x").alias("s"))


@query("select l_returnflag, min(l_quantity) as lo, max(l_quantity) as hi, cast(sum(l_linenumber) as bigint) as s from lineitem group by 1")
def agg_hot_key(spark, sf_dir):
    return relational.hot_grouped(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"lo": ("min", "l_quantity"), "hi": ("max", "l_quantity"), "s": ("sum", "l_linenumber")})


# Windows: aggregates cover the whole partition in the dialect, so frames are written out in the oracles

_FULL = "rows between unbounded preceding and unbounded following"
sql("win_row_number", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders")
sql("win_rank", "select n_nationkey, rank() over (order by n_regionkey) as r from nation")
sql("win_dense_rank", "select n_nationkey, dense_rank() over (order by n_regionkey desc) as r from nation", "select n_nationkey, dense_rank() over (order by n_regionkey desc nulls first) as r from nation")
sql("win_percent_rank", "select n_nationkey, round(percent_rank() over (order by n_regionkey), 6) as r from nation", "select n_nationkey, round(percent_rank() over (order by n_regionkey), 6) as r from nation")
sql("win_cume_dist", "select n_nationkey, round(cume_dist() over (order by n_regionkey), 6) as r from nation")
sql("win_first_last", "select o_orderkey, first_value(o_totalprice) over (partition by o_custkey order by o_orderkey) as f, last_value(o_totalprice) over (partition by o_custkey order by o_orderkey) as l from orders", f"select o_orderkey, first_value(o_totalprice) over (partition by o_custkey order by o_orderkey {_FULL}) as f, last_value(o_totalprice) over (partition by o_custkey order by o_orderkey {_FULL}) as l from orders")
sql("win_lag_lead_default", "select o_orderkey, lag(o_orderkey, 2, 0) over (partition by o_custkey order by o_orderkey) as a, lead(o_orderkey, 1) over (partition by o_custkey order by o_orderkey) as b from orders", "select o_orderkey, lag(o_orderkey, 2, cast(0 as bigint)) over (partition by o_custkey order by o_orderkey) as a, lead(o_orderkey, 1) over (partition by o_custkey order by o_orderkey) as b from orders")
sql("win_sum_partition", "select o_orderkey, cast(sum(cast(o_totalprice as numeric(18, 6))) over (partition by o_custkey order by o_orderkey) as float8) as s, count(*) over (partition by o_custkey) as n from orders", "select o_orderkey, cast(sum(cast(o_totalprice as numeric(18, 6))) over (partition by o_custkey) as float8) as s, count(*) over (partition by o_custkey) as n from orders")
sql("win_rows_frame", "select o_orderkey, cast(sum(cast(o_totalprice as numeric(18, 6))) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row) as float8) as s from orders", windows="ansi")
sql("win_over_agg", "select o_orderstatus, count(*) as n, row_number() over (order by count(*) desc, o_orderstatus) as r from orders group by o_orderstatus")
sql("win_named", "select o_orderkey, rank() over w as r from orders window w as (partition by o_orderstatus order by o_totalprice, o_orderkey)")
sql("win_ntile_nth", "select o_orderkey, ntile(4) over (order by o_orderkey) as q, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderkey) as v from orders", "select o_orderkey, cast(ntile(4) over (order by o_orderkey) as int) as q, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderkey) as v from orders")


@query(f"select c_custkey, c_nationkey, max(c_acctbal) over (partition by c_nationkey) as hi, last_value(c_custkey) over (partition by c_nationkey order by c_custkey {_FULL}) as l from customer")
def win_functions(spark, sf_dir):
    w = W.over(["c_nationkey"], ["c_custkey"])
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", W.aggregate(F.max("c_acctbal"), w).alias("hi"), W.last_value("c_custkey", w).alias("l"))


# Order, limit, sets

sql("sort_nulls", "select row_number() over (order by k, n_nationkey) as r, k, n_nationkey from (select nullif(n_regionkey, 2) as k, n_nationkey from nation) t order by k, n_nationkey", "select row_number() over (order by k nulls last, n_nationkey) as r, k, n_nationkey from (select nullif(n_regionkey, 2) as k, n_nationkey from nation) t")
sql("sort_multi", "select o_custkey, o_orderkey from orders order by o_custkey desc, o_orderkey")
sql("limit_rows", "select n_nationkey from nation order by n_nationkey limit 7")
sql("limit_offset", "select n_nationkey from nation order by n_nationkey limit 5 offset 3")
sql("topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
sql("union_all", "select n_regionkey as k from nation union all select r_regionkey from region")
sql("union_distinct", "select n_regionkey as k from nation union select r_regionkey from region")
sql("intersect_distinct", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
sql("intersect_all", "select c_nationkey as k from customer intersect all select s_nationkey from supplier")
sql("except_distinct", "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 5000")
sql("except_all", "select c_nationkey as k from customer except all select s_nationkey from supplier")
sql("set_precedence", "select n_regionkey as k from nation union select 99 intersect select 99")
sql("union_group", "select k, count(*) as n from (select n_regionkey as k from nation union all select r_regionkey from region) t group by k")

# Functions

sql(
    "fn_string_1",
    "select p_partkey, left(p_name, -2) as a, right(p_name, 3) as b, right(p_name, -3) as c, substr(p_name, 0, 3) as d, substr(p_name, 2) as e, locate(p_name, 'a') as f, locate(p_name, 'a', 3) as g, strpos(p_name, 'e') as h, split_part(p_name, ' ', 1) as i, split_part(p_name, ' ', 9) as j from part",
    "select p_partkey, left(p_name, -2) as a, right(p_name, 3) as b, right(p_name, -3) as c, substr(p_name, 1, 2) as d, substr(p_name, 2) as e, cast(strpos(p_name, 'a') as int) as f, cast(case when strpos(substr(p_name, 3), 'a') = 0 then 0 else strpos(substr(p_name, 3), 'a') + 2 end as int) as g, cast(strpos(p_name, 'e') as int) as h, split_part(p_name, ' ', 1) as i, cast(null as varchar) as j from part",
)
sql(
    "fn_string_2",
    "select c_custkey, upper(c_name) as a, lower(c_name) as b, initcap(lower(c_mktsegment)) as c, lpad(c_mktsegment, 12, '*') as d, rpad(c_mktsegment, 12, '-') as e, reverse(c_name) as f, repeat(c_mktsegment, 2) as g, char_length(c_name) as h, octet_length(c_name) as i, md5(c_name) as j, quote_ident(c_name) as k, trim(both 'C' from c_name) as l from customer",
    "select c_custkey, upper(c_name) as a, lower(c_name) as b, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) as c, lpad(c_mktsegment, 12, '*') as d, rpad(c_mktsegment, 12, '-') as e, reverse(c_name) as f, repeat(c_mktsegment, 2) as g, cast(length(c_name) as int) as h, cast(strlen(c_name) as int) as i, md5(c_name) as j, '\"' || c_name || '\"' as k, trim(c_name, 'C') as l from customer",
)
sql(
    "fn_string_3",
    "select n_nationkey, ascii(n_name) as a, chr(n_nationkey + 300) as b, bit_length(n_name) as c, to_hex(n_nationkey + 1) as d, to_bin(n_nationkey) as e, digest(n_name, 'sha256') as f, encode(n_name, 'base64') as g, decode(encode(n_name, 'hex'), 'hex') as h, regexp_replace(n_name, '[AEIOU]', '*') as i, concat_ws('/', n_name, n_name) as j, find_in_set('b', 'a,b,c') as k, strposb(n_name, 'A') as l from nation",
    "select n_nationkey, ascii(n_name) as a, chr(n_nationkey + 300) as b, cast(bit_length(n_name) as int) as c, printf('%x', n_nationkey + 1) as d, bin(n_nationkey) as e, sha256(n_name) as f, base64(encode(n_name)) as g, n_name as h, regexp_replace(n_name, '[AEIOU]', '*', 'g') as i, n_name || '/' || n_name as j, 2 as k, cast(strpos(n_name, 'A') as int) as l from nation",
)
sql(
    "fn_math",
    "select l_orderkey, l_linenumber, round(l_quantity / 3) as a, round(l_discount * 100, 1) as b, ceil(l_tax * 10) as c, floor(l_quantity / 7) as d, abs(l_linenumber - 4) as e, sign(l_linenumber - 4) as f, div(l_linenumber, 2) as g, round(sqrt(l_quantity), 6) as h, round(pow(l_linenumber, 2), 2) as i, round(degrees(radians(l_quantity)), 6) as j, round(cbrt(l_quantity), 6) as k, round(atan2(l_tax, l_quantity), 6) as l from lineitem",
    "select l_orderkey, l_linenumber, cast(round(l_quantity / 3) as bigint) as a, round(l_discount * 100, 1) as b, cast(ceil(l_tax * 10) as bigint) as c, cast(floor(l_quantity / 7) as bigint) as d, abs(l_linenumber - 4) as e, cast(sign(l_linenumber - 4) as double) as f, cast(l_linenumber // 2 as bigint) as g, round(sqrt(l_quantity), 6) as h, round(pow(l_linenumber, 2), 2) as i, round(degrees(radians(l_quantity)), 6) as j, round(cbrt(l_quantity), 6) as k, round(atan2(l_tax, l_quantity), 6) as l from lineitem",
)
sql("fn_trig", "select p_partkey, round(sin(p_size), 6) as a, round(cos(p_size), 6) as b, round(tan(p_size), 6) as c, round(asin(p_size / 100.0), 6) as d, round(acos(p_size / 100.0), 6) as e, round(atan(p_size), 6) as f, round(exp(p_size / 10.0), 6) as g, round(pi(), 6) as h from part")
sql(
    "fn_date",
    "select o_orderkey, to_char(o_orderdate, 'YYYY-MM-DD HH24:MI:SS') as a, to_char(add_days(o_orderdate, 10), 'YYYY-MM-DD') as b, to_char(add_months(o_orderdate, 1), 'YYYY-MM-DD') as c, to_char(to_date('1998-12-01', 'YYYY-MM-DD'), 'DD/MM/YYYY') as d, date_part('isodow', o_orderdate) as e, date_part('doy', o_orderdate) as f, date_part('epoch', o_orderdate) as g, to_char(date_trunc('month', o_orderdate), 'YYYYMMDD') as h from orders",
    "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as a, strftime(o_orderdate + interval 10 day, '%Y-%m-%d') as b, strftime(o_orderdate + interval 1 month, '%Y-%m-%d') as c, '01/12/1998' as d, cast(isodow(o_orderdate) as double) as e, cast(dayofyear(o_orderdate) as double) as f, cast(epoch(o_orderdate) as double) as g, strftime(date_trunc('month', o_orderdate), '%Y%m%d') as h from orders",
)
sql("fn_usec", "select event_id, utc_usec_to('day', unix_micros(ts::timestamp)) as d, utc_usec_to('hour', unix_micros(ts::timestamp)) as h from events", "select event_id, epoch_us(date_trunc('day', ts)) as d, epoch_us(date_trunc('hour', ts)) as h from events")
sql("fn_json", "select event_id, json_extract_path_text(props, '$.k') as k, json_array_length('[1,2,3]') as n, json_array_get('[1,2,3]', -1) as l, json_array_get('[1,2,3]', 0) as f, json_array_contains('[1,2,3]', 2) as c from events", "select event_id, json_extract_string(props, '$.k') as k, cast(3 as bigint) as n, '3' as l, '1' as f, true as c from events")
sql("fn_net", "select n_nationkey, int_to_ipstr(ipstr_to_int('192.168.0.' || n_nationkey::text)) as a, ipstr_to_int('127.0.1.1') as b, bin_to_ipstr(ipstr_to_blob('10.1.2.' || n_nationkey::text)) as c from nation", "select n_nationkey, '192.168.0.' || n_nationkey as a, 2130706689 as b, '10.1.2.' || n_nationkey as c from nation")
sql("fn_conditional", "select n_nationkey, coalesce(nullif(n_regionkey, 1), -1) as a, nullif(n_name, 'CHINA') as b from nation")


@query("select p_partkey, left(p_name, 3) as a, concat('<', p_brand, '>') as b from part")
def fn_builders(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", call("left", "p_name", 3).alias("a"), call("concat", quoted("<"), "p_brand", quoted(">")).alias("b"))


# Records, functions of users, writes, streams

@query("select n_nationkey, n_name as first_name, n_regionkey as k from nation")
def nested_field(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.struct(F.col("n_name").alias("first")).alias("name"), F.col("n_regionkey").alias("k")).alias("r")).select("n_nationkey", F.col("r.name.first").alias("first_name"), F.col("r.k").alias("k"))


@output_type("int4")
def _text_length(x):
    return None if x is None else len(x)


@query("select n_name, cast(length(n_name) as int) as n from nation")
def udf_scalar(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.functions.scalar("str_len", _text_length)
    return e.sql("select n_name, str_len(n_name) as n from nation")


class Mean:
    """A class-style aggregate: the mean of what isn't NULL."""

    output_type = "float8"

    def __init__(self):
        self.total, self.n = 0.0, 0

    def eval(self, x):
        if x is not None:
            self.total, self.n = self.total + x, self.n + 1

    def get_partial_result(self):
        return self.total, self.n

    def merge(self, partial):
        self.total, self.n = self.total + partial[0], self.n + partial[1]

    def get_final_result(self):
        return self.total / self.n if self.n else None


@query("select l_returnflag, round(avg(l_quantity), 6) as m from lineitem group by 1")
def udaf_class(spark, sf_dir):
    return two_phase(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity"], Mean, "m", "double").withColumn("m", F.round("m", 6))


@query("select n_nationkey, n_name, n_regionkey from nation where n_regionkey in (1, 2)")
def write_partitioned_roundtrip(spark, sf_dir):
    at = _place(spark, "partitioned")
    relational.store_partitioned(table(spark, sf_dir, "nation"), at, ["n_regionkey"])
    return spark.read.parquet(at).filter("n_regionkey in (1, 2)")


@query("select n_regionkey, count(*) as n from nation group by 1")
def ctas(spark, sf_dir):
    e = engine(spark, sf_dir)
    name = f"ctas_{uuid.uuid4().hex}"
    at = _place(spark, name)
    e.sql(f"create table {name} using parquet location '{at}' as select n_regionkey, count(*) as n from nation group by n_regionkey")
    rows = e.spark.read.parquet(at)
    e.sql(f"drop table {name}")
    return rows


@query("select n_nationkey, n_name, case when n_regionkey = 1 then 'new' else null end as note, n_regionkey from nation")
def insert_overwrite(spark, sf_dir):
    e = engine(spark, sf_dir)
    name = f"t_{uuid.uuid4().hex}"
    at = _place(spark, name)
    e.sql(f"create table {name} (n_nationkey int4, n_name text, note text) using parquet partition by column(n_regionkey int4) location '{at}'")
    e.sql(f"insert into {name} (n_nationkey, n_name, n_regionkey) select n_nationkey, n_name, n_regionkey from nation")
    e.sql(f"insert overwrite into {name} select n_nationkey, n_name, 'new', n_regionkey from nation where n_regionkey = 1")
    rows = e.spark.read.schema(e.spark.table(name).schema).parquet(at)
    e.sql(f"drop table {name}")
    return rows


@query("select n_nationkey, n_name from nation")
def text_roundtrip(spark, sf_dir):
    at = _place(spark, "text")
    sources.write(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), at, "text", {"text.delimiter": "|", "compression": "gzip"}, "overwrite")
    return sources.read(spark, at, "text", schema="n_nationkey int, n_name string")


@query("select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end, event_type, count(*) as n from events group by 1, 2, 3")
def window_tumbling(spark, sf_dir):
    return streaming.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], F.count("*").alias("n"))


@query(
    """with a as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
b as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from a)
select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from b group by user_id, s"""
)
def window_sessions(spark, sf_dir):
    return streaming.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], F.count("*").alias("n"))


# Arithmetic: left to right, integers stay integers whatever they come from

sql(
    "arith_chain",
    "select n_nationkey, n_nationkey * 7 / 4 as a, 100 / (n_nationkey + 1) / 2 as b, n_nationkey * 3 % 4 as c, 5 * 3 / 2 as d, 10 / 3 / 2 as e, 5 * 3 % 4 as f, 2 + 7 / 2 * 2 as g, n_nationkey % 5 * 3 / 2 as h, -7 / 2 as i from nation",
    "select n_nationkey, cast(n_nationkey * 7 // 4 as int) as a, cast(100 // (n_nationkey + 1) // 2 as int) as b, n_nationkey * 3 % 4 as c, 7 as d, 1 as e, 3 as f, 8 as g, cast(n_nationkey % 5 * 3 // 2 as int) as h, -3 as i from nation",
)
sql(
    "arith_typed",
    "select n_regionkey / 2 as k, count(*) / 2 as a, max(n_nationkey) / 5 as b, avg(n_nationkey) / 2 as c, sum(h) / count(*) as d from (select n_regionkey, n_nationkey, n_nationkey / 2 as h from nation) t group by n_regionkey / 2",
    "select cast(n_regionkey // 2 as int) as k, count(*) // 2 as a, cast(max(n_nationkey) // 5 as int) as b, avg(n_nationkey) / 2 as c, cast(sum(n_nationkey // 2) // count(*) as bigint) as d from nation group by n_regionkey // 2",
)
sql(
    "arith_window",
    "select o_orderkey, sum(o_orderkey) over (partition by o_custkey) / count(*) over (partition by o_custkey) as m, case when o_custkey > 700 then o_custkey else 7 end / 2 as h, cast(o_orderkey as float8) / 2 as f from orders",
    "select o_orderkey, cast(sum(o_orderkey) over (partition by o_custkey) // count(*) over (partition by o_custkey) as bigint) as m, case when o_custkey > 700 then o_custkey else 7 end // 2 as h, cast(o_orderkey as double) / 2 as f from orders",
)
sql("arith_bits", "select n_nationkey, n_nationkey & 6 as a, n_nationkey | 8 as b, n_nationkey ^ 5 as c from nation", "select n_nationkey, n_nationkey & 6 as a, n_nationkey | 8 as b, xor(n_nationkey, 5) as c from nation")
sql("unary_sign", "select n_nationkey, -n_nationkey as a, +n_nationkey as b, - (n_nationkey - 3) as c from nation")
sql("in_correlated", "select c_custkey from customer where 'P' in (select o_orderstatus from orders where o_custkey = c_custkey and o_totalprice > 400000)")
sql("any_subquery", "select n_name from nation where n_regionkey = any (select r_regionkey from region where r_name like 'A%') and n_nationkey <> all (select s_nationkey from supplier where s_acctbal > 9000)")
sql("table_statement", "table region", "select * from region")
sql("literals", "select interval '1' day + timestamp '2024-01-01 10:00:00' as a, date '2024-02-29' as b, 1.5e3 as c, 'it''s' as d, true as e, null is null as f", "select interval 1 day + timestamp '2024-01-01 10:00:00' as a, date '2024-02-29' as b, cast(1500 as double) as c, 'it''s' as d, true as e, true as f")
sql("clock", "select current_date = cast(now() as date) as a, length(current_time) = 8 as b, length(current_time()) = 8 as c, current_timestamp >= timestamp '2024-01-01 00:00:00' as d", "select true as a, true as b, true as c, true as d")
sql("join_natural_sql", "select * from (select n_nationkey, n_regionkey as k from nation) a natural join (select r_regionkey as k, r_name from region) b", "select n_regionkey as k, n_nationkey, r_name from nation join region on n_regionkey = r_regionkey")
sql("join_using_sql", "select k, n_nationkey, r_name from (select n_nationkey, nullif(n_regionkey, 2) as k from nation) a left join (select r_regionkey as k, r_name from region) b using (k)")
sql("join_union_sql", "select r_name, n_nationkey from region union join nation n where n_nationkey is null or n_nationkey < 4", "select r_name, cast(null as int) as n_nationkey from region union all select null, n_nationkey from nation where n_nationkey < 4")
sql("join_theta_pure", "select a.n_nationkey as x, b.s_suppkey as y from nation a join supplier b on a.n_nationkey * 3 < b.s_nationkey and a.n_regionkey <> b.s_suppkey")
sql("join_left_theta", "select r_regionkey, n_nationkey from region left join nation on n_nationkey < r_regionkey * r_regionkey - 4")
sql("agg_grouping_fn", "select l_returnflag, l_linestatus, grouping(l_returnflag) as a, grouping(l_linestatus) as b, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)", "select l_returnflag, l_linestatus, cast(grouping(l_returnflag) as tinyint) as a, cast(grouping(l_linestatus) as tinyint) as b, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
sql("agg_sum_distinct_sql", "select l_returnflag, sum(distinct nullif(l_linenumber, l_linenumber)) as z, sum(distinct l_linenumber) as s, sum(distinct l_linenumber) filter (where l_linenumber > 90) as e from lineitem group by l_returnflag", "select l_returnflag, cast(0 as bigint) as z, cast(sum(distinct l_linenumber) as bigint) as s, cast(0 as bigint) as e from lineitem group by l_returnflag")
sql("agg_every_some", "select o_orderstatus, every(o_totalprice > 1000) as e, some(o_totalprice > 400000) as s from orders group by o_orderstatus", "select o_orderstatus, bool_and(o_totalprice > 1000) as e, bool_or(o_totalprice > 400000) as s from orders group by o_orderstatus")
sql("agg_collections", "select k, cardinality(collect(n)) as c, array_join(array_sort(fusion(array(n, 1))), ',') as f, array_join(intersection(array(n % 2, 7)), ',') as i from (select n_regionkey as k, n_nationkey as n from nation) t group by k", "select k, cast(count(*) as int) as c, array_to_string(list_sort(flatten(list([n, 1]))), ',') as f, case when count(distinct n % 2) > 1 then '7' else array_to_string([min(n % 2), 7], ',') end as i from (select n_regionkey as k, n_nationkey as n from nation) t group by k")
sql("win_range_frame", "select o_orderkey, count(*) over (partition by o_orderstatus order by o_custkey range between 10 preceding and 5 following) as n from orders", windows="ansi")
sql("win_named_aggregate", "select n_nationkey, sum(n_nationkey) over w as s, count(*) over (w rows between 1 preceding and current row) as c, max(n_nationkey) over v as m, rank() over w as r from nation window w as (partition by n_regionkey order by n_nationkey), v as (partition by n_regionkey)", "select n_nationkey, cast(sum(n_nationkey) over (partition by n_regionkey) as bigint) as s, count(*) over (partition by n_regionkey) as c, max(n_nationkey) over (partition by n_regionkey) as m, rank() over (partition by n_regionkey order by n_nationkey) as r from nation")
sql("win_rank_no_order", "select n_nationkey, rank() over (partition by n_regionkey) as r, dense_rank() over () as d from nation", "select n_nationkey, 1 as r, 1 as d from nation")
sql("sort_forms", "select n_regionkey * 2 as k, n_nationkey from nation order by k desc, n_regionkey + n_nationkey, 2, 'x' limit 9", "select n_regionkey * 2 as k, n_nationkey from nation order by k desc, n_regionkey + n_nationkey, 2 limit 9")
sql("sort_in_order", "select row_number() over (order by o_totalprice desc, o_orderkey) as place, o_orderkey from (select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25) t")
sql("nested_group", "select r.name.first as k, count(*) as n from (select named_struct('name', named_struct('first', substr(n_name, 1, 8))) as r from nation) t group by r.name.first", "select substr(n_name, 1, 8) as k, count(*) as n from nation group by 1")
sql("nested_join", "select a.r.k as k, b.r_name from (select named_struct('k', n_regionkey) as r, n_nationkey from nation) a join region b on a.r.k = b.r_regionkey", "select n_regionkey as k, r_name from nation join region on n_regionkey = r_regionkey")
sql("fn_string_4", "select c_custkey, ltrim('  ' || c_mktsegment) as a, rtrim(c_mktsegment, 'G') as b, ltrim(c_mktsegment, 'B') as c, length(c_name) as d, trim(leading 'H' from c_mktsegment) as e, rtrim(c_mktsegment || '  ') as f from customer", "select c_custkey, c_mktsegment as a, rtrim(c_mktsegment, 'G') as b, ltrim(c_mktsegment, 'B') as c, cast(length(c_name) as int) as d, ltrim(c_mktsegment, 'H') as e, c_mktsegment as f from customer")
sql("fn_date_2", "select event_id, to_char(to_timestamp(1386577650), 'YYYY-MM-DD HH24:MI:SS') as a, date('09/12/2013 08:27:30') as b, random(10) between 0 and 9 as c, now() is not null as d, date_part('month', current_date) between 1 and 12 as e from events", "select event_id, '2013-12-09 08:27:30' as a, cast(1386577650000 as bigint) as b, true as c, true as d, true as e from events")
sql("string_agg_sql", "select n_regionkey, length(string_agg(n_name, ',')) as n from nation group by n_regionkey", "select n_regionkey, cast(length(string_agg(n_name, ',')) as int) as n from nation group by n_regionkey")
sql("like_escape", "select count(*) as n from part where p_name not like 'small%' and p_name like '% %' and p_name not ilike '%WIDGET'")
sql("cte", "with a as (select n_regionkey as k, count(*) as n from nation group by n_regionkey), b as (select k, n / 2 as h from a) select r_name, h from b join region on k = r_regionkey", "with a as (select n_regionkey as k, count(*) as n from nation group by n_regionkey) select r_name, n // 2 as h from a join region on k = r_regionkey")


# Statements: each makes what it needs under names of its own and takes it away again

@query("select n_nationkey, n_nationkey // 2 as h, cast(n_nationkey as double) / 2 as f from nation")
def ctas_typed(spark, sf_dir):
    e, name = engine(spark, sf_dir), f"ctas_{uuid.uuid4().hex}"
    at = _place(spark, name)
    e.sql(f"create table {name} using parquet location '{at}' as select n_nationkey, n_nationkey / 2 as h, cast(n_nationkey as float8) / 2 as f from nation")
    e.sql(f"drop table {name}")
    return e.spark.read.parquet(at)


@query("select * from (values (1, 'one', cast(null as double), 'p'), (2, null, 2.5, 'q'), (3, 'three', null, 'q')) t(id, name, v, k)")
def insert_values(spark, sf_dir):
    e, name = engine(spark, sf_dir), f"t_{uuid.uuid4().hex}"
    at = _place(spark, name)
    e.sql(f"create table {name} (id int4, name text, v float8) using parquet partition by column(k text) location '{at}'")
    e.sql(f"insert into {name} (id, name, k) values (1, 'one', 'p')")
    e.sql(f"insert into {name} values (2, null, 2.5, 'q'), (3, 'three', null, 'q')")
    rows = e.spark.read.schema(e.spark.table(name).schema).parquet(at)
    e.sql(f"drop table {name}")
    return rows


def _said(e: Engine, rows: list[tuple], schema: str) -> DataFrame:
    """Few rows that statements have answered."""
    return e.spark.createDataFrame(rows, schema)


@query("select * from (values ('columns', 'a,b,c'), ('database', 'true'), ('gone', 'true'), ('index', 'i1'), ('like', '0'), ('partitions', '2'), ('property', 'x'), ('renamed', '3'), ('session', '7'), ('tablespace', '2'), ('truncated', '0'), ('unset', 'null')) t(what, found)")
def ddl_statements(spark, sf_dir):
    """Databases, tables, LIKE, TRUNCATE, ALTER, indexes, tablespaces, session variables and the system tables that show them."""
    e = Engine(spark)
    db = f"d_{uuid.uuid4().hex}"
    place = _place(spark, db)
    e.script(f"create database {db}; set catalog {db}; create table t1 (a int4, b text) using parquet partition by column(c int4) location '{place}/t1'; insert into t1 values (1, 'x', 1), (2, 'y', 2), (3, 'z', 2)")
    found = {"database": str(e.sql("select * from information_schema.databases").filter(F.col("db_name") == db).count() == 1).lower()}
    found["columns"] = ",".join(r.column_name for r in e.sql("select column_name, ordinal_position from information_schema.columns where table_name = 't1' order by ordinal_position").collect())
    found["partitions"] = str(e.sql("select * from information_schema.partitions where table_name = 't1'").count())
    e.script("create table t2 like t1; create table t3 using parquet as select a, b from t1")
    found["like"] = str(e.sql("select * from t2").count())
    e.script("alter table t3 rename to t4; alter table t4 add column w text; alter table t4 set property 'own'='x'")
    found["renamed"] = str(len(e.sql("select * from t4").columns))
    found["property"] = e.sql("select value from information_schema.table_options where table_name = 't4' and key = 'own'").collect()[0][0]
    e.sql("alter table t4 unset property 'own'")
    found["unset"] = str((e.sql("select value from information_schema.table_options where table_name = 't4' and key = 'own'").collect() or [["null"]])[0][0])
    e.sql("create index i1 on t4 using btree (a)")
    found["index"] = e.sql("select index_name from information_schema.indexes where table_name = 't4'").collect()[0][0]
    e.sql("truncate table t4")
    found["truncated"] = str(e.sql("select * from t4").count())
    e.script(f"create tablespace s1 location '{place}/s1'; create table t5 tablespace s1 as select a from t1 where c = 2")
    found["tablespace"] = str(e.spark.read.parquet(f"{place}/s1/t5").count())
    e.sql("set session my.limit = 7")
    found["session"] = e.sql("select value from information_schema.session where key = 'my.limit'").collect()[0][0]
    e.script(f"reset my.limit; drop index i1; drop table t1; drop table t2; drop table if exists t4 purge; drop table t5; set catalog default; drop database {db}")
    found["gone"] = str(e.sql("select * from information_schema.databases").filter(F.col("db_name") == db).count() == 0).lower()
    return _said(e, list(found.items()), "what string, found string")


@query("select * from (values (10, 'a', 1), (20, 'b', 2)) t(v, s, k)")
def ddl_partitions(spark, sf_dir):
    """Partitions that are added with a place of their own, dropped, and found by repairing."""
    e, name = Engine(spark), f"p_{uuid.uuid4().hex}"
    place = _place(spark, name)
    e.sql(f"create table {name} (v int4, s text) using parquet partition by column(k int4) location '{place}/t'")
    e.sql(f"insert into {name} values (10, 'a', 1), (30, 'c', 3)")
    e.spark.createDataFrame([(20, "b")], "v int, s string").write.parquet(f"{place}/other")
    e.script(f"alter table {name} add if not exists partition (k = 2) location '{place}/other'; alter table {name} repair partition; alter table {name} drop partition (k = 3)")
    rows = _said(e, [tuple(r) for r in e.sql(f"select v, s, k from {name}").collect()], "v int, s string, k int")
    e.sql(f"drop table {name}")
    return rows


@query("select 'scan' as step, true as found union all select 'join', true union all select 'filter', true")
def explain_statement(spark, sf_dir):
    e = engine(spark, sf_dir)
    plan = e.sql("explain select n_name from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'").collect()[0][0]
    return _said(e, [("scan", "Scan parquet" in plan), ("join", "Join" in plan), ("filter", "r_name" in plan)], "step string, found boolean")


# Sources and functions of users


def _round_trip(kind: str, options: dict[str, str] | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = _place(spark, kind)
        rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.expr("nullif(n_regionkey, 3)").alias("k"))
        sources.write(rows, at, kind, options)
        return sources.read(spark, at, kind, options, "n_nationkey int, n_name string, k int")

    return run


for _kind in ("json", "orc", "csv", "tsv"):
    QUERIES[f"{_kind}_roundtrip"], ORACLES[f"{_kind}_roundtrip"] = _round_trip(_kind), "select n_nationkey, n_name, nullif(n_regionkey, 3) as k from nation"


@query("select n_name as name, n_nationkey as k from nation where n_nationkey < 10 union all select null, null from nation where n_nationkey >= 10")
def regex_rows(spark, sf_dir):
    at = _place(spark, "regex")
    sources.write_regex(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), at, "%1$s <%2$s>")
    return sources.read(spark, at, "regex", {"text.regex": r"(\d) <(.*)>"}, "k int, name string").select("name", "k")


@query("select n_nationkey, n_name from nation")
def text_header_lines(spark, sf_dir):
    """Three header lines in every file."""
    at = _place(spark, "header")
    rows = table(spark, sf_dir, "nation").select(F.concat_ws("|", "n_nationkey", "n_name").alias("value"))
    heads = spark.createDataFrame([("a|b",), ("2|second line",), ("--",)], "value string").coalesce(1)
    heads.union(rows).coalesce(1).write.text(at)
    return sources.read(spark, at, "text", {"text.skip.headerlines": "3"}, "n_nationkey int, n_name string")


@query("select n_nationkey as k, n_name as s from nation where n_nationkey % 5 <> 0")
def text_tolerance(spark, sf_dir):
    """Every fifth line is no number: dropped, as the table says that any number of errors is tolerated."""
    at = _place(spark, "errors")
    table(spark, sf_dir, "nation").select(F.concat_ws("|", F.expr("if(n_nationkey % 5 = 0, 'x', cast(n_nationkey as string))"), "n_name").alias("value")).write.text(at)
    return sources.read(spark, at, "text", {"text.error-tolerance.max-num": "-1"}, "k int, s string")


@query("select n_nationkey, n_name, nullif(n_regionkey, 3) as k from nation")
def avro_rows(spark, sf_dir):
    """Container files in the folder; the connector reads them where it is there, else this library."""
    from pathlib import Path

    from .sources.avro import container

    at = _place(spark, "avro").removeprefix("file:")
    schema = {"type": "record", "name": "nation", "fields": [{"name": "n_nationkey", "type": "int"}, {"name": "n_name", "type": "string"}, {"name": "k", "type": ["null", "int"]}]}
    rows = [r.asDict() for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.expr("nullif(n_regionkey, 3)").alias("k")).collect()]
    Path(at).mkdir(parents=True)
    for k in range(2):
        Path(at, f"{k}.avro").write_bytes(container(rows[k::2], schema, ["null", "deflate"][k], 5))
    return sources.read(spark, at, "avro")


@query("select cast(n_nationkey as varchar) as key, n_name as value from nation")
def sequence_roundtrip(spark, sf_dir):
    at = _place(spark, "sequence")
    sources.write_sequence(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string"), "n_name"), at)
    return sources.read(spark, at, "sequence")


@query("select n_regionkey, count(*) as n from nation where n_nationkey > 4 group by n_regionkey")
def jdbc_roundtrip(spark, sf_dir):
    """Through the database that comes with Spark."""
    url = sources.embedded_database(table(spark, sf_dir, "nation"), "nation", _place(spark, "jdbc"))
    rows = sources.read_jdbc(spark, url, "nation", "n_nationkey", (0, 25), 2).filter("n_nationkey > 4").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return spark.createDataFrame(rows.collect(), "n_regionkey int, n bigint")


@query("select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by r_name")
def jdbc_tablespace(spark, sf_dir):
    """A database as a tablespace: its tables join the warehouse's."""
    name = f"n_{uuid.uuid4().hex}"
    url = sources.embedded_database(table(spark, sf_dir, "nation"), name, _place(spark, "jdbc"))
    e = Engine(spark).register(sf_dir, ["region"])
    e.script(f"create tablespace db location '{url}'; create external table {name} (*) tablespace db")
    return spark.createDataFrame(e.sql(f"select r_name, count(*) as n from {name} join region on n_regionkey = r_regionkey group by r_name").collect(), "r_name string, n bigint")


@query("select n_nationkey as id, n_name as name, cast(null as double) as v from nation")
def http_json(spark, sf_dir):
    """A server of this process; on a cluster the address is any that executors reach."""
    import http.server
    import json
    import threading

    from .sources.http_json import HttpJson

    body = "\n".join(json.dumps({"id": r.n_nationkey, "name": r.n_name}) for r in table(spark, sf_dir, "nation").collect()).encode()

    class Lines(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Lines)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(HttpJson)
    rows = spark.read.format("http_json").schema("id int, name string, v double").load(f"http://127.0.0.1:{server.server_port}/").collect()
    server.shutdown()
    return spark.createDataFrame(rows, "id int, name string, v double")


class _Letters:
    """A table function: a row for each letter of a text."""

    def eval(self, text: str):
        for place, letter in enumerate(text or "", 1):
            yield place, letter


@query("select n_nationkey, cast(unnest(range(1, 1 + length(n_name))) as int) as place, unnest(string_split(n_name, '')) as letter from nation")
def udtf_lateral(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.functions.table("letters", _Letters, "place int, letter string")
    return e.sql("select n_nationkey, place, letter from nation, lateral letters(n_name)")


@query("select l_returnflag, round(avg(l_quantity), 6) as m from lineitem group by 1")
def udaf_sql(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.functions.aggregate("mean_of", Mean)
    return e.sql("select l_returnflag, round(mean_of(l_quantity), 1 + 5) as m from lineitem group by l_returnflag")


@query("select n_nationkey, max(n_nationkey) over (partition by n_regionkey) - min(n_nationkey) over (partition by n_regionkey) as w, avg(n_nationkey) over (partition by n_regionkey) as m from nation")
def udf_window(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.functions.window("spread", lambda x: int(x.max() - x.min()), "int4")
    e.functions.aggregate("mean_of", Mean)
    return e.sql("select n_nationkey, spread(n_nationkey) over (partition by n_regionkey) as w, mean_of(n_nationkey) over (partition by n_regionkey) as m from nation")


@query("select n_nationkey, n_nationkey * 3 + 1 as a from nation")
def udf_vectorised(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.functions.scalar("thrice_and_one", lambda x: x * 3 + 1, "int4", vectorised=True)
    return e.sql("select n_nationkey, thrice_and_one(n_nationkey) as a from nation")


@query("select n_nationkey, case when n_nationkey < 10 then 'AA' when n_nationkey < 20 then 'BB' end as c, n_nationkey < 10 as a from nation")
def fn_geoip(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.functions.countries(spark.createDataFrame([(167772160, 167772169, "AA"), (167772170, 167772179, "BB")], "first long, last long, code string"))
    return e.sql("select n_nationkey, geoip_country_code('10.0.0.' || n_nationkey::text) as c, geoip_in_country('10.0.0.' || n_nationkey::text, 'AA') as a from nation")


@query(
    """with e as (select event_id, user_id, ts from events where event_type <> 'purchase'), p as (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by 1, 2)
select e.event_id, p.value as last_value from e asof left join p on e.user_id = p.user_id and e.ts >= p.ts"""
)
def join_as_of_hot(spark, sf_dir):
    """The same in buckets of a day, for keys with very many rows."""
    e = table(spark, sf_dir, "events")
    p = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return joins.as_of(e.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), p.withColumnRenamed("ts", "t"), ["user_id"], "ts", "t", ["last_value"], bucket=86_400).select("event_id", "last_value")


@query("select w as window_start, w + interval 1 hour as window_end, count(*) as n from (select unnest([time_bucket(interval 20 minute, ts), time_bucket(interval 20 minute, ts) - interval 20 minute, time_bucket(interval 20 minute, ts) - interval 40 minute]) as w from events) t group by w")
def window_sliding(spark, sf_dir):
    return streaming.sliding(table(spark, sf_dir, "events"), "ts", "1 hour", "20 minutes", [], F.count("*").alias("n"))


# TPC-H on the columns that there are

sql(
    "tpch_q1",
    """select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as numeric(18, 6))) as float8) as sum_qty, cast(sum(cast(l_extendedprice as numeric(18, 6))) as float8) as sum_base_price, cast(sum(cast(l_extendedprice * (1 - l_discount) as numeric(18, 6))) as float8) as sum_disc_price,
cast(sum(cast(l_extendedprice * (1 - l_discount) * (1 + l_tax) as numeric(18, 6))) as float8) as sum_charge, round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= timestamp '1998-09-01 00:00:00' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
)
sql(
    "tpch_q3",
    """select l_orderkey, cast(sum(cast(l_extendedprice * (1 - l_discount) as numeric(18, 6))) as float8) as revenue, cast(o_orderdate as date) as o_orderdate from customer, orders, lineitem
where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < timestamp '1995-03-15 00:00:00' and l_shipdate > timestamp '1995-03-15 00:00:00'
group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10""",
)
sql(
    "tpch_q4",
    """select o_orderpriority, count(*) as order_count from orders where o_orderdate >= timestamp '1997-07-01 00:00:00' and o_orderdate < timestamp '1997-10-01 00:00:00'
and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate) group by o_orderpriority order by o_orderpriority""",
)
sql(
    "tpch_q5",
    """select n_name, cast(sum(cast(l_extendedprice * (1 - l_discount) as numeric(18, 6))) as float8) as revenue from customer, orders, lineitem, supplier, nation, region
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA'
and o_orderdate >= timestamp '1996-01-01 00:00:00' and o_orderdate < timestamp '1998-01-01 00:00:00' group by n_name order by revenue desc""",
)
sql("tpch_q6", "select cast(sum(cast(l_extendedprice * l_discount as numeric(18, 6))) as float8) as revenue from lineitem where l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1997-01-01 00:00:00' and l_discount between 0.05 and 0.07 and l_quantity < 24")
sql(
    "tpch_q7",
    """select supp_nation, cust_nation, l_year, cast(sum(cast(volume as numeric(18, 6))) as float8) as revenue from (select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(year(l_shipdate) as int8) as l_year, l_extendedprice * (1 - l_discount) as volume
from supplier, lineitem, orders, customer, nation n1, nation n2 where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey
and n1.n_regionkey <> n2.n_regionkey) shipping group by supp_nation, cust_nation, l_year order by supp_nation, cust_nation, l_year""",
)
sql(
    "tpch_q8",
    """select o_year, round(sum(case when nation = 'BRAZIL' then volume else 0 end) / sum(volume), 6) as mkt_share from (select cast(year(o_orderdate) as int8) as o_year, l_extendedprice * (1 - l_discount) as volume, n2.n_name as nation
from part, supplier, lineitem, orders, customer, nation n1, nation n2, region where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey
and n1.n_regionkey = r_regionkey and r_name = 'AMERICA' and s_nationkey = n2.n_nationkey) all_nations group by o_year order by o_year""",
)
sql(
    "tpch_q10",
    """select c_custkey, c_name, cast(sum(cast(l_extendedprice * (1 - l_discount) as numeric(18, 6))) as float8) as revenue, c_acctbal, n_name from customer, orders, lineitem, nation
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_returnflag = 'R' and c_nationkey = n_nationkey group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""",
)
sql("tpch_q12", "select o_orderpriority, sum(case when l_linestatus = 'F' then 1 else 0 end)::int8 as low_line, count(*) as n from orders, lineitem where o_orderkey = l_orderkey group by o_orderpriority")
sql("tpch_q13", "select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left outer join orders on c_custkey = o_custkey and o_orderpriority <> '1-URGENT' group by c_custkey) c_orders group by c_count")
sql("tpch_q14", "select round(100.00 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as promo_revenue from lineitem, part where l_partkey = p_partkey and l_shipdate >= timestamp '1995-09-01 00:00:00' and l_shipdate < timestamp '1995-10-01 00:00:00'")
sql(
    "tpch_q15",
    """with revenue as (select l_suppkey as supplier_no, cast(sum(cast(l_extendedprice * (1 - l_discount) as numeric(18, 6))) as float8) as total_revenue from lineitem where l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1996-04-01 00:00:00' group by l_suppkey)
select s_suppkey, s_name, total_revenue from supplier, revenue where s_suppkey = supplier_no and total_revenue = (select max(total_revenue) from revenue)""",
)
sql("tpch_q17", "select round(sum(l_extendedprice) / 7.0, 2) as avg_yearly from lineitem, part where p_partkey = l_partkey and p_size < 20 and l_quantity < (select 0.5 * avg(l_quantity) from lineitem where l_partkey = p_partkey)")
sql(
    "tpch_q18",
    """select c_name, c_custkey, o_orderkey, o_totalprice, cast(sum(cast(l_quantity as numeric(18, 6))) as float8) as q from customer, orders, lineitem where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 150)
and c_custkey = o_custkey and o_orderkey = l_orderkey group by c_name, c_custkey, o_orderkey, o_totalprice order by o_totalprice desc, o_orderkey limit 100""",
)
sql("tpch_q19", "select cast(sum(cast(l_extendedprice * (1 - l_discount) as numeric(18, 6))) as float8) as revenue from lineitem, part where (p_partkey = l_partkey and p_brand = 'Brand#12' and l_quantity between 1 and 11 and p_size between 1 and 25) or (p_partkey = l_partkey and p_brand = 'Brand#23' and l_quantity between 10 and 20 and p_size between 1 and 30) or (p_partkey = l_partkey and p_brand = 'Brand#4' and l_quantity between 20 and 30 and p_size between 1 and 15)")
sql("tpch_q22", "select c_nationkey, count(*) as numcust, cast(sum(cast(c_acctbal as numeric(18, 6))) as float8) as totacctbal from customer where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0.00) and not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '2000-06-01 00:00:00') group by c_nationkey")


#: There is no partsupp: a part's suppliers are those that delivered it, with what they asked and delivered.
_PARTSUPP = "partsupp as (select l_partkey as ps_partkey, l_suppkey as ps_suppkey, min(cast(l_extendedprice as numeric(18, 2))) as ps_supplycost, cast(sum(cast(l_quantity as numeric(18, 2))) as int8) as ps_availqty from lineitem group by l_partkey, l_suppkey)"
sql(
    "tpch_q2",
    f"""with {_PARTSUPP} select s_acctbal, s_name, n_name, p_partkey, p_brand from part, supplier, partsupp, nation, region where p_partkey = ps_partkey and s_suppkey = ps_suppkey and p_size = 15 and p_type like '%Y' and s_nationkey = n_nationkey
and n_regionkey = r_regionkey and r_name = 'EUROPE' and ps_supplycost = (select min(ps_supplycost) from partsupp, supplier, nation, region where p_partkey = ps_partkey and s_suppkey = ps_suppkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'EUROPE')
order by s_acctbal desc, n_name, s_name, p_partkey limit 100""",
)
sql(
    "tpch_q9",
    """select nation, o_year, cast(sum(cast(amount as numeric(18, 6))) as float8) as sum_profit from (select n_name as nation, cast(extract(year from o_orderdate) as int8) as o_year, l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity as amount
from part, supplier, lineitem, orders, nation where s_suppkey = l_suppkey and p_partkey = l_partkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_name like '%ring%') profit group by nation, o_year order by nation, o_year desc""",
)
sql(
    "tpch_q11",
    f"""with {_PARTSUPP} select ps_partkey, cast(sum(ps_supplycost * ps_availqty) as float8) as value from partsupp, supplier, nation where ps_suppkey = s_suppkey and s_nationkey = n_nationkey and n_name = 'NATION_7' group by ps_partkey
having cast(sum(ps_supplycost * ps_availqty) as float8) > (select cast(sum(ps_supplycost * ps_availqty) as float8) * 0.001 from partsupp, supplier, nation where ps_suppkey = s_suppkey and s_nationkey = n_nationkey and n_name = 'NATION_7') order by value desc""",
)
sql(
    "tpch_q16",
    f"""with {_PARTSUPP} select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt from partsupp, part where p_partkey = ps_partkey and p_brand <> 'Brand#5' and p_type not like 'MEDIUM%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9)
and ps_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by p_brand, p_type, p_size order by supplier_cnt desc, p_brand, p_type, p_size""",
)
sql(
    "tpch_q20",
    f"""with {_PARTSUPP} select s_name, s_nationkey from supplier, nation where s_suppkey in (select ps_suppkey from partsupp where ps_partkey in (select p_partkey from part where p_name like 'small%')
and ps_availqty > (select 0.1 * sum(l_quantity) from lineitem where l_partkey = ps_partkey and l_shipdate >= timestamp '1996-01-01 00:00:00')) and s_nationkey = n_nationkey and n_regionkey = 2 order by s_name""",
)
sql(
    "tpch_q21",
    """select s_name, count(*) as numwait from supplier, lineitem l1, orders, nation where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and l1.l_shipdate > o_orderdate
and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey) and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_shipdate > l1.l_shipdate)
and s_nationkey = n_nationkey and n_regionkey = 3 group by s_name order by numwait desc, s_name limit 100""",
)
