"""Calls that are worked out over all tasks: functions of all rows in an order, class-style aggregates."""

import duckdb
import pytest

from millrace import engine as engine_module
from millrace.engine import Engine
from millrace.queries import ORACLES, QUERIES, Mean
from tests.conftest import SF
from tests.test_queries import rows

DATA = "(values (1, 'b', 2.5), (2, null, 1.0), (3, 'b', null), (4, 'a', 1.0), (5, 'c', 7.0), (6, 'a', 2.5), (7, null, null)) t(k, s, x)"


@pytest.fixture
def over_tasks(monkeypatch):
    monkeypatch.setattr(engine_module, "ORDERED", -1)


def in_one_task(frame):
    return "SinglePartition" in frame._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["win_ntile_nth", "win_rank", "win_dense_rank", "win_percent_rank", "win_cume_dist", "win_over_agg", "sort_nulls"])
def test_functions_of_all_rows_in_an_order(spark, over_tasks, name):
    got = QUERIES[name](spark, SF)
    assert not in_one_task(got) or name in ("sort_nulls",)
    con = duckdb.connect()
    for t in ("nation", "orders"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    assert got.columns == list(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize(
    "items",
    [
        "row_number() over (order by k desc) * 10 as r, k",
        "k, rank() over (order by s) as a, dense_rank() over (order by x desc, s) as b, ntile(3) over (order by k) as c",
        "k, s || 'z' as y, round(percent_rank() over (order by x nulls first), 4) as a, ntile(20) over (order by k) b, cume_dist() over w c",
    ],
)
def test_ties_nulls_and_directions(spark, over_tasks, items):
    """As planned by Spark."""
    e = Engine(spark)
    text = f"select {items} from {DATA} where k > 1 window w as (order by s desc)"
    got, want = e.sql(text), spark.sql(e.translated(text))
    assert not in_one_task(got) and in_one_task(want)
    assert got.dtypes == want.dtypes and rows(got.columns, got.collect()) == rows(want.columns, want.collect())


@pytest.mark.parametrize(
    "text",
    [
        f"select k, row_number() over (order by k) + k as r from {DATA}",
        f"select k, row_number() over (partition by s order by k) as r from {DATA}",
        f"select rank() over (order by count(*), s) as r, s, count(*) as n from {DATA} group by 2",
        f"with u as (select k, s from {DATA} where k > 3) select r, s from (select s, row_number() over (order by k) as r from u) v where r < 3",
        f"select r, count(*) as n from (select ntile(2) over (order by k) as r from {DATA}) u group by r",
        f"select distinct ntile(2) over (order by k) as r from {DATA}",
        f"select *, row_number() over (order by k) as r from {DATA}",
        f"select row_number() over (order by k) as r from {DATA} union all select 8",
        f"select k, row_number() over (order by k desc) as r from {DATA} order by r limit 2",
        f"with u as (select k as j, s from {DATA}) select s, dense_rank() over (order by max(j)) as r from u group by s having count(*) > 1",
        f"select null as v, k, row_number() over (order by k) as r from {DATA} where k > 9",
    ],
)
def test_other_statements_mean_the_same(spark, over_tasks, text):
    e = Engine(spark)
    got, want = e.sql(text), spark.sql(e.translated(text))
    assert got.columns == want.columns and rows(got.columns, got.collect()) == rows(want.columns, want.collect())


def in_two_phases(frame):
    return "MapInArrow" in frame._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def with_classes(spark):
    class Product:
        """Of two columns: the sum of their products, as a whole number."""

        output_type = "int8"

        def __init__(self):
            self.total = 0

        def eval(self, a, b):
            self.total += (a or 0) * (b or 0)

        def get_partial_result(self):
            return self.total

        def merge(self, partial):
            self.total += partial

        def get_final_result(self):
            return self.total

    e = Engine(spark)
    e.functions.aggregate("mean_of", Mean)
    e.functions.aggregate("product_of", Product)
    return e


def test_class_aggregate_of_sql_has_no_group_in_one_task(spark):
    got = QUERIES["udaf_sql"](spark, SF)
    assert in_two_phases(got)
    want = duckdb.sql(ORACLES["udaf_sql"].replace("lineitem", f"'{SF}/lineitem.parquet'"))
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize(
    "text",
    [
        f"select mean_of(x) as m from {DATA}",
        f"select mean_of(x) as m, count(*) as n from {DATA} where k > 9",
        f"select s, mean_of(x) as m from {DATA} group by s",
        f"select x, mean_of(k) from {DATA} group by x",
        f"select t.s || 'y' as u, round(mean_of(k + 1), 3) m, mean_of(x) / 2 as h from {DATA} group by t.s order by m desc, u limit 2",
        f"select s as k, mean_of(k) as m, count(*) as n, max(x) filter (where k > 2) as hi from {DATA} group by s having count(*) > 1 and m > 1 order by k",
        f"select k % 2 as odd, mean_of(x) + sum(x) as m from {DATA} group by k % 2 having mean_of(x) > 0",
        f"select 2 * k as s, mean_of(x) as m from {DATA} group by 1 order by s",
        f"select rank() over (order by mean_of(k) desc) as r, s from {DATA} group by s",
        f"with u as (select * from {DATA} where k < 6) select u.s, mean_of(u.x) as m from u, (values ('a'), ('b')) v(w) where s = w group by s",
        f"select s, mean_of(x) as m, sum(count(*)) over () as n from {DATA} group by s",
        f"select max(m) as m, count(*) as n from (select s, mean_of(x) as m from {DATA} group by s) u where s is not null",
        f"select mean_of(m) as m from (select s, mean_of(x) as m from {DATA} group by s) u",
        f"select k, (select mean_of(x) from {DATA}) as m from {DATA}",
        f"select twin, mean_of(x) as m from (select s as twin, x from {DATA}) u group by twin order by 2",
    ],
)
def test_class_aggregates_of_sql(spark, with_classes, text):
    """As the built-in mean, with NULLs in keys and values."""
    got, want = with_classes.sql(text), with_classes.sql(text.replace("mean_of", "avg"))
    assert in_two_phases(got)
    assert rows(list("abcdefgh"[: len(got.columns)]), got.collect()) == rows(list("abcdefgh"[: len(want.columns)]), want.collect())


def test_class_aggregates_of_several_columns(spark, with_classes):
    got = with_classes.sql(f"select s, product_of(k, x) as p, mean_of(x) as m from (select k, s, cast(x as int4) as x from {DATA}) u group by s")
    assert in_two_phases(got) and got.dtypes[1] == ("p", "bigint")
    assert {r.s: (r.p, r.m) for r in got.collect()} == {"a": (16, 1.5), "b": (2, 2.0), "c": (35, 7.0), None: (2, 1.0)}


@pytest.mark.parametrize("text", [f"select s, mean_of(x) as m from {DATA} where x is not null group by rollup(s)", f"select array(s) as a, mean_of(x) as m from {DATA} where x is not null group by array(s)"])
def test_other_groups_are_as_before(spark, with_classes, text):
    got, want = with_classes.sql(text), with_classes.sql(text.replace("mean_of", "avg"))
    assert rows(got.columns, got.collect()) == rows(want.columns, want.collect())


def test_equal_keys_are_dealt_out(spark, over_tasks):
    e = Engine(spark)
    e.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.range(40_000).createOrReplaceGlobalTempView("same")
    got = e.sql("select id, row_number() over (order by id * 0) as r, ntile(3) over (order by id * 0) as q from global_temp.same")
    assert sorted(r.r for r in got.collect()) == list(range(1, 40_001))
    assert sorted((r.q, r["count"]) for r in got.groupBy("q").count().collect()) == [(1, 13_334), (2, 13_333), (3, 13_333)]
    assert len(got.inputFiles()) > 1


def test_kinds_of_keys_and_values(spark, with_classes):
    text = """select d, n, b, y, z, at, mean_of(k) as m from (select k, date '2020-01-01' + k % 2 as d, cast(k % 2 as decimal(9, 2)) as n, k % 2 = 0 as b, cast('x' as binary) as y,
case when k % 2 = 0 then cast('nan' as double) end as z, timestamp '2020-01-01 10:00:00' as at from (values (1), (2), (3), (4)) t(k)) u group by d, n, b, y, z, at"""
    got, want = with_classes.sql(text), with_classes.sql(text.replace("mean_of", "avg"))
    assert in_two_phases(got) and got.dtypes == want.dtypes
    assert rows(got.columns, got.collect()) == rows(want.columns, want.collect())
