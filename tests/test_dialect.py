import pytest

from millrace import Engine
from millrace.functions.datetime import java_pattern
from millrace.operators import joins
from millrace.plans.dialect import Mode, translate


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("left('abcdef', -2)", "abcd"), ("left('ab', -9)", ""), ("right('abcdef', -2)", "cdef"), ("substr('abcdef', 0, 3)", "ab"), ("substr('abcdef', -1, 3)", "a"), ("substr('abcdef', 5, 9)", "ef"),
        ("locate('abc', '')", 1), ("locate('abc', 'b', -1)", 0), ("locate('abcb', 'b', 3)", 4), ("locate('abc', '', 9)", 0), ("split_part('a|b', '|', 2)", "b"), ("split_part('a|b', '|', 9)", None), ("concat('a', null, 'b')", "ab"),
        ("7 / 2", 3), ("-7 / 2", -3), ("7 / 0", None), ("5 * 3 / 2", 7), ("10 / 3 / 2", 1), ("5 * 3 % 4", 3), ("2 + 7 / 2 * 2", 8), ("20 - 9 / 2", 16), ("7 / 2.0", 3.5), ("100 / (3 + 1) / 2 % 5", 2), ("7 / 2 / 2.0", 1.5), ("'9'::int4 / 2", 4), ("9::int8 / 2", 4), ("9::float8 / 2", 4.5),
        ("case when true then 9 else 1 end / 2", 4), ("array(7, 9)[1] / 2", 4), ("7 - -9 / 2", 11), ("abs(-9) / 2", 4), ("length('abc') / 2 * 2", 2), ("1.5", 1.5), ("5 = any (select 5)", True), ("5 <> all (select 4)", True), ("mod(-7, 3)", -1), ("5 % 0", None), ("round(2.5)", 3), ("round(-2.5)", -3), ("div(7, 0)", None), ("chr(0)", None), ("chr(300)", "Ĭ"), ("to_hex(0)", "00000000"), ("to_hex(-1)", "ffffffff"),
        ("'xabcx' ~ 'abc'", False), ("'ABC' ~* 'a.c'", True), ("'abc' !~ 'abc'", False), ("'abc' similar to 'a%'", True), ("5 between symmetric 9 and 1", True), ("5 between symmetric 6 and 9", False), ("'42'::int4 + 1", 43),
        ("extract(dow from date '2024-01-07')", 0.0), ("extract(isodow from date '2024-01-07')", 7.0), ("extract(century from date '2000-06-01')", 20.0), ("extract(millennium from date '2001-01-01')", 3.0), ("extract(decade from date '1999-01-01')", 199.0),
        ("extract(timezone from now())", None), ("to_char(add_months(date '2024-01-31', 1), 'YYYY-MM-DD')", "2024-02-29"), ("to_char(to_date('05/03/2020', 'DD/MM/YYYY'), 'YYYYMMDD')", "20200305"),
        ("ipstr_to_int('127.0.1.1')", 2130706689), ("int_to_ipstr(2130706689)", "127.0.1.1"), ("json_array_get('[1,2,3]', -1)", "3"), ("json_array_get('[1]', 5)", None), ("json_array_contains('[1,2]', 2)", True), ("json_array_contains('no', 2)", None),
        ("utc_usec_to('day', 1704196800000001)", 1704153600000000), ("digest('a', 'md5')", "0cc175b9c0f1b6a831c399e269772661"), ("digest('a', 'nothing')", None), ("decode(encode('é', 'base64'), 'base64')", "é"), ("encode('é', 'other')", None),
        ("strposb('éa', 'a')", 3), ("strpos('abc', '')", 1), ("'it''s' || 'b\\n'", "it's" + "b\\n"), ("null || 'a'", None), ("sign(-3)", -1.0), ("coalesce(null, 2)", 2), ("ceil(1.2)", 2), ("btrim('xxaxx', 'x')", "a"),
    ],
)
def test_expression(engine, expression, value):
    assert engine.sql(f"select {expression} as x").collect()[0].x == value


def test_nulls_are_largest(engine):
    got = [r.x for r in engine.sql("select * from (values (1), (null), (2)) t(x) order by x").collect()]
    assert got == [1, 2, None]
    assert [r.x for r in engine.sql("select * from (values (1), (null), (2)) t(x) order by x desc").collect()] == [None, 2, 1]


def test_windows_cover_the_partition(engine):
    text = "select x, sum(x) over (order by x rows between 1 preceding and current row) as s from (values (1), (2), (3)) t(x)"
    assert {r.s for r in engine.sql(text).collect()} == {6}
    assert [r.s for r in engine.spark.sql(translate(text, Mode(windows="ansi"))).orderBy("x").collect()] == [1, 3, 5]


def test_rank_without_order(engine):
    """All rows of a partition are peers."""
    rows = engine.sql("select rank() over (partition by x % 2) as r, dense_rank() over () as d, percent_rank() over () as p, cume_dist() over () as c, row_number() over (partition by 1) as n from (values (5), (6), (7)) t(x)").collect()
    assert [(r.r, r.d, r.p, r.c) for r in rows] == [(1, 1, 0.0, 1.0)] * 3 and sorted(r.n for r in rows) == [1, 2, 3]


def test_named_windows_are_inlined(engine):
    text = "select x, sum(x) over w as s, max(x) over (w) as m, count(*) over v as c, (select max(y) over w from (values (1)) u(y) window w as (order by y)) as i from (values (1), (2), (3)) t(x) window w as (partition by x % 2 order by x), v as (w)"
    assert sorted((r.x, r.s, r.m, r.c, r.i) for r in engine.sql(text).collect()) == [(1, 4, 3, 2, 1), (2, 2, 2, 1, 1), (3, 4, 3, 2, 1)]


def test_division_is_typed_by_the_analyser(engine):
    text = "with a as (select x / 2 as h, x * 1.0 as f from (values (7), (9)) t(x)) select sum(h) / 2 as s, sum(f) / 2 as g, count(*) / 4 as c, max(h) / 2 as m, avg(h) / 2 as v from a"
    r = engine.sql(text).collect()[0]
    assert (r.s, r.g, r.c, r.m, r.v) == (3, 8.0, 0, 2, 1.75) and dict(engine.sql(text).dtypes)["s"] == "bigint"
    # A column of the same name in another table, an alias, a join: the analyser knows.
    engine.sql("select 7.0D as q, 1 as k").createOrReplaceTempView("floats")
    engine.sql("select 7 as q, 1 as k").createOrReplaceTempView("integers")
    r = engine.sql("select f.q / 2 as a, i.q / 2 as b, f.q as q, count(*) over () / 2 as c from floats f join integers i on f.k = i.k where i.q / 2 = 3 order by i.q / 2").collect()[0]
    assert (r.a, r.b, r.c) == (3.5, 3, 0)


def test_sum_of_no_distinct_values_is_zero(engine):
    assert engine.sql("select sum(distinct x) as s, sum(distinct x) filter (where x > 5) as f, sum(x) as n from (values (cast(null as int))) t(x)").collect()[0] == (0, 0, None)


def test_java_patterns():
    assert java_pattern("YYYY-MM-DD HH24:MI:SS.MS") == "yyyy-MM-dd HH:mm:ss.SSS"
    assert java_pattern("yyyymmdd") == "yyyyMMdd"


def test_quoted_names_and_comments():
    assert translate('select "a b" -- x\n from t /* y */') == "select `a b` from t"


def test_ddl_and_dml(engine, tmp_path):
    e = engine
    e.script("create database if not exists d1; set catalog d1")
    e.sql(f"create table t1 (id int4, name text, v float8) using parquet partition by column(k int4) location '{tmp_path}/t1'")
    e.sql("insert into t1 (id, k) select 1, 10")
    e.sql("insert overwrite into t1 select 2, 'b', 1.5, 20")
    assert sorted((r.id, r.name, r.k) for r in e.sql("select * from t1").collect()) == [(1, None, 10), (2, "b", 20)]
    assert "PartitionFilters: [isnotnull(k" in e.explain("select id from t1 where k = 10")
    e.sql("create table t2 as select id, k from t1")
    e.sql("create table t3 like t2")
    assert e.sql("select * from t3").count() == 0 and e.sql("select * from t2").count() == 2
    e.sql("truncate table t2")
    assert e.sql("select * from t2").count() == 0
    e.sql("alter table t3 rename to t4")
    e.sql("alter table t4 add column w text")
    assert e.sql("select * from t4").columns == ["id", "k", "w"]
    e.sql("create index i1 on t4 using btree (id)")
    assert e.sql("select index_name from information_schema.indexes").collect()[0][0] == "i1"
    assert {r.table_name for r in e.sql("select * from information_schema.tables").collect()} >= {"t1", "t2", "t4"}
    assert e.sql("select * from information_schema.partitions").count() == 2
    assert e.sql("select column_name from information_schema.columns where table_name = 't4'").count() == 3
    e.script("drop index i1; drop table t1; drop table t2; drop table if exists t4 purge; set catalog default; drop database d1")


def test_external_text_and_self_describing(engine, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.tbl").write_text("1|one\n2|\n")
    engine.sql(f"create external table ext1 (id int4, name text) using text with ('text.delimiter'='|') location '{tmp_path}/a'")
    assert [(r.id, r.name) for r in engine.sql("select * from ext1 order by id").collect()] == [(1, "one"), (2, None)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.json").write_text('{"a": {"b": 3}}\n{"c": 1}\n')
    engine.sql(f"create external table j1 (*) using json location '{tmp_path}/j'")
    assert [r.b for r in engine.sql("select a.b as b from j1 order by b").collect()] == [3, None]
    engine.sql(f"insert overwrite into location '{tmp_path}/out' using csv select 1 as a, 'x' as b")
    assert engine.spark.read.csv(f"{tmp_path}/out").collect()[0][1] == "x"
    engine.script("drop table ext1; drop table j1")


def test_regex_rows(spark, tmp_path):
    from millrace import sources

    (tmp_path / "r.txt").write_text("a=1\nb=x\n")
    got = sources.read(spark, str(tmp_path / "r.txt"), "regex", {"text.regex": r"(\w)=(\d)"}, "k string, v int").collect()
    assert [(r.k, r.v) for r in got] == [("a", 1), (None, None)]
    sources.write_regex(spark.createDataFrame([("a", None)], "k string, v int"), str(tmp_path / "w"), "%1$s:%2$s")
    assert spark.read.text(str(tmp_path / "w")).collect()[0].value == "a:\\N"


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv", "tsv", "text"])
def test_formats(spark, tmp_path, kind):
    from millrace import sources

    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    sources.write(rows, str(tmp_path / kind), kind)
    assert sorted(map(tuple, sources.read(spark, str(tmp_path / kind), kind, schema="id int, s string").collect())) == [(1, "a"), (2, None)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_join_strategies_agree(spark, how):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k int, x string")
    b = spark.createDataFrame([(2, "p"), (3, "q"), (None, "r")], "k int, y string")
    found = {s: sorted(map(str, joins.join(a, b, ["k"], how, s).collect())) for s in joins.STRATEGIES}
    assert len({tuple(v) for v in found.values()}) == 1


def test_salted_join(spark):
    a = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99)], "k int, x int")
    b = spark.createDataFrame([(1, "one")], "k int, y string")
    assert joins.salted(a, b, ["k"], 4).count() == 50
    assert joins.salted(a, b, ["k"], 4, "left").filter("y is null").count() == 1


def test_cross_join_is_limited(spark):
    with pytest.raises(ValueError):
        joins.cross(spark.range(10**7), spark.range(10**7))


def test_country_ranges(spark):
    from millrace.functions.net import with_country

    ranges = spark.createDataFrame([(167837696, 167903231, "AA"), (3232235520, 3232301055, "BB")], "first long, last long, code string")
    got = {r.ip: r.country for r in with_country(spark.createDataFrame([("10.1.2.3",), ("192.168.1.1",), ("8.8.8.8",), (None,)], "ip string"), "ip", ranges).collect()}
    assert got == {"10.1.2.3": "AA", "192.168.1.1": "BB", "8.8.8.8": None, None: None}


def test_udfs(spark):
    from millrace.queries import Mean

    e = Engine(spark)
    e.functions.scalar("twice", lambda x: None if x is None else 2 * x, "int4")
    e.functions.aggregate("mean_py", Mean)
    assert e.sql("select twice(21) as x").collect()[0].x == 42
    assert e.sql("select mean_py(x) as m from (values (1.0D), (3.0D)) t(x)").collect()[0].m == 2.0


def test_streams_match_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from millrace import streaming

    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", m % 2) for m in range(0, 60, 7)], "t string, k int").withColumn("t", F.to_timestamp("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streaming.tumbling(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t", "20 minutes", ["k"], F.count("*").alias("n"), late="1 minute")
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, streaming.tumbling(rows, "t", "20 minutes", ["k"], F.count("*").alias("n")).collect()))


def test_header_lines_and_tolerance(spark, tmp_path):
    from millrace import sources

    (tmp_path / "t").mkdir()
    for f in ("a", "b"):
        (tmp_path / "t" / f).write_text("k|s\n-|-\n1|one\nx|two\n3|three\n")
    (tmp_path / "t" / "short").write_text("k|s\n")
    path, schema = str(tmp_path / "t"), "k int, s string"
    got = lambda **o: sorted(map(str, (tuple(r) for r in sources.read(spark, path, "text", {k.replace("_", "."): v for k, v in o.items()}, schema).collect())))
    assert got(text_skip_headerlines="2") == sorted(["(1, 'one')", "(3, 'three')", "(None, 'two')"] * 2)
    more = {"text.skip.headerlines": "2", "text.error-tolerance.max-num": "2"}
    assert sorted(r.k for r in sources.read(spark, path, "text", more, schema).collect()) == [1, 1, 3, 3]
    with pytest.raises(ValueError):
        sources.read(spark, path, "text", {**more, "text.error-tolerance.max-num": "1"}, schema)


def test_country_functions_are_bounded(spark, monkeypatch):
    from millrace import udf

    e = Engine(spark)
    ranges = spark.createDataFrame([(10, 20, "A"), (30, 40, "B")], "first long, last long, code string")
    e.functions.countries(ranges)
    r = e.sql("select geoip_country_code(x) as c from (values ('0.0.0.15'), ('0.0.0.25'), ('no'), (null)) t(x)").collect()
    assert [x.c for x in r] == ["A", None, None, None]
    monkeypatch.setattr(udf, "COUNTRY_RANGES", 1)
    with pytest.raises(ValueError):
        e.functions.countries(ranges)


def test_two_phase_hands_partial_results_on(spark, monkeypatch):
    from millrace import udf
    from millrace.queries import Mean

    rows = spark.range(2000).selectExpr("id % 700 as k", "cast(id as double) as x")
    want = {r.k: r.m for r in rows.groupBy("k").avg("x").withColumnRenamed("avg(x)", "m").collect()}
    monkeypatch.setattr(udf, "HELD", 50)
    assert {r.k: r.m for r in udf.two_phase(rows, ["k"], ["x"], Mean, "m", "double").collect()} == want


def test_salt_deals_equal_rows_out(spark):
    a = spark.range(1000).selectExpr("1 as k", "'same' as x").repartition(4)
    b = spark.createDataFrame([(1, "one")], "k int, y string")
    assert joins.salted(a, b, ["k"], 8).count() == 1000


@pytest.mark.parametrize("bucket", [None, 10.0, 3.5])
def test_as_of_with_buckets(spark, bucket):
    import random

    random.seed(3)
    left = [(random.randint(0, 3), random.randint(0, 60), i) for i in range(150)]
    right = {(random.randint(0, 3), random.randint(0, 60)): i for i in range(25)}
    a = spark.createDataFrame([*left, (None, 5, 900)], "k int, t int, i int")
    b = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k int, u int, v int")
    got = {r.i: r.v for r in joins.as_of(a, b, ["k"], "t", "u", ["v"], bucket).collect()}
    for k, t, i in left:
        before = [(u, v) for (kk, u), v in right.items() if kk == k and u <= t]
        assert got[i] == (max(before)[1] if before else None)
    assert got[900] is None and len(got) == 151


def test_order_holds_over_partitions(engine):
    """The rows come in order, not only the right ones."""
    rows = [(r.a, r.b) for r in engine.sql("select id % 7 as a, id as b from range(500) order by a desc, b").collect()]
    assert rows == sorted(rows, key=lambda r: (-r[0], r[1]))


def test_avro_types(spark, tmp_path):
    import bz2
    import datetime
    import lzma

    import pyarrow as pa

    from millrace.sources import avro

    inner = {"type": "record", "name": "inner", "fields": [{"name": "x", "type": ["null", "double"]}]}
    schema = {"type": "record", "name": "row", "namespace": "a.b", "fields": [
        {"name": "i", "type": "int"}, {"name": "l", "type": "long"}, {"name": "f", "type": "float"}, {"name": "b", "type": "boolean"}, {"name": "s", "type": ["null", "string"]}, {"name": "y", "type": "bytes"},
        {"name": "a", "type": {"type": "array", "items": ["null", "long"]}}, {"name": "m", "type": {"type": "map", "values": "int"}}, {"name": "r", "type": inner}, {"name": "q", "type": ["null", inner]},
        {"name": "d", "type": {"type": "int", "logicalType": "date"}}, {"name": "t", "type": {"type": "long", "logicalType": "timestamp-micros"}},
    ]}
    rows = [{"i": -k, "l": k * (1 << 40) * (-1) ** k, "f": k / 2, "b": k % 2 == 0, "s": None if k % 3 else f"é{k}", "y": bytes([k]), "a": [k, None, -k] if k else [], "m": {"p": k} if k else {}, "r": {"x": None}, "q": None if k % 2 else {"x": 1.5}, "d": -k, "t": -k * 1_000_003} for k in range(50)]
    for codec in ("null", "deflate"):
        (tmp_path / codec).mkdir()
        (tmp_path / codec / "x.avro").write_bytes(avro.container(rows, schema, codec, 7))
        got = sorted(avro.read_avro(spark, str(tmp_path / codec)).collect(), key=lambda r: -r.i)
        assert [(r.i, r.l, r.f, r.b, r.s, bytes(r.y), r.a, r.m, r.r.x, r.q and r.q.x) for r in got] == [(r["i"], r["l"], r["f"], r["b"], r["s"], r["y"], r["a"], r["m"], None, r["q"] and 1.5) for r in rows]
        assert got[40].d == datetime.date(1970, 1, 1) - datetime.timedelta(days=40)
    text = b"some text " * 50
    assert avro._unpacked(bz2.compress(text), "bzip2") == avro._unpacked(lzma.compress(text), "xz") == avro._unpacked(pa.compress(text, "zstd", asbytes=True), "zstandard") == text
    assert avro._unpacked(pa.compress(text, "snappy", asbytes=True) + b"sum!", "snappy") == text
    with pytest.raises(ValueError):
        avro.header(b"nothing")


def test_java_functions(spark, tmp_path):
    """Compiled here; without a compiler there is nothing to test."""
    import os
    import shutil
    import subprocess
    import zipfile

    import pyspark

    if not shutil.which("javac") and not os.path.exists("/usr/lib/jvm/default-java/bin/javac"):
        pytest.skip("no Java compiler")
    (tmp_path / "TwiceOf.java").write_text("public class TwiceOf implements org.apache.spark.sql.api.java.UDF1<Integer, Integer> { public Integer call(Integer x) { return x == null ? null : 2 * x; } }")
    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars", "*")
    subprocess.run([shutil.which("javac") or "/usr/lib/jvm/default-java/bin/javac", "-cp", jars, "-d", str(tmp_path), str(tmp_path / "TwiceOf.java")], check=True, timeout=120)
    with zipfile.ZipFile(tmp_path / "twice.jar", "w") as z:
        z.write(tmp_path / "TwiceOf.class", "TwiceOf.class")
    e = Engine(spark)
    e.spark.sql(f"ADD JAR '{tmp_path}/twice.jar'")
    e.functions.java("twice_of", "TwiceOf", "int4")
    assert [r.y for r in e.sql("select twice_of(x) as y from (values (21), (null)) t(x)").collect()] == [42, None]
