import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engine_helpers import rows
from tarnflow.operators import composing, grouping, joining, prefixes, running, windowing
from tarnflow.operators import rows as R
from tarnflow.operators.ordering import OrderRequired, carried, numbered


def ints(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i long, x long")


def test_prefixes(spark):
    df = ints(spark, [11, 14, 20, 17, 26, 12, 30])
    along = lambda f: [r.x for r in f.orderBy("i").collect()]
    assert along(prefixes.take_while(df, "x < 20", "i")) == [11, 14]
    assert along(prefixes.skip_while(df, "x < 20", "i")) == [20, 17, 26, 12, 30]
    assert along(prefixes.take_until(df, "x % 13 == 0", "i")) == [11, 14, 20, 17]
    assert along(prefixes.skip_until(df, "x % 13 == 0", "i")) == [26, 12, 30]
    assert prefixes.take_while(df, "x < 99", "i").count() == 7
    assert prefixes.limit(df, 0).count() == 0
    with pytest.raises(OrderRequired):
        prefixes.take_while(df, "x < 20", None)


def test_update_and_rename(spark):
    df = spark.createDataFrame([("Alice", 25), ("Bob", 15)], "name string, age long")
    out = R.update_clauses(df, [R.Clause([("age", "ge", "18")], sets={"kind": "adult"}), R.Clause(sets={"kind": "minor"})])
    assert rows(out) == [("Alice", 25, "adult"), ("Bob", 15, "minor")]
    assert R.rename(df, ("name", "age")).columns == ["age"]
    assert R.rename(df, ("nope", "x")).columns == ["name", "age"]
    assert R.match(df, "nope", "ne", "1") is not None
    assert R.where_clauses(df, [R.Clause([("nope", "ne", "1")])]).count() == 0
    assert R.where_clauses(df, [R.Clause([("age", "gt", "18.5")])]).count() == 1


def test_joins_overlay(spark):
    a = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (4, "d", "z")], "id long, name string, v string")
    b = spark.createDataFrame([(1, "E", None), (2, "S", "w"), (3, "T", "u")], "id long, dept string, v string")
    assert rows(joining.inner_join(a, b, ["id"])) == [(1, "a", "x", "E"), (2, "b", "w", "S")]
    assert len(rows(joining.full_join(a, b, joining.on_fields("id")))) == 4
    assert rows(joining.right_join(a, b, ["id"]), "id", "name") == sorted([(1, "a"), (2, "b"), (3, None)], key=repr)
    assert joining.left_join(a, b, joining.on_condition(lambda x, y: x["id"] > y["id"])).count() == 1 + 1 + 3
    n = spark.createDataFrame([(None, 1)], "id long, k long")
    assert joining.inner_join(n, n, ["id"]).count() == 0
    assert joining.inner_join(n, n, ["id"], null_safe=True).count() == 1


def test_aggregates_and_their_defaults(spark):
    df = spark.createDataFrame([("E", "10"), ("E", "20.5"), ("E", "x"), (None, None)], "k string, v string")
    out = grouping.group_by_fields(df, "k").aggregate(n=grouping.count(), s=grouping.sum_("v"), a=grouping.avg("v"), lo=grouping.min_("v"), t=grouping.max_("v", str))
    assert rows(out) == sorted([("E", 3, 30.5, 15.25, 10.0, "x"), (None, 1, 0.0, 0.0, 0.0, "")], key=repr)
    sql = grouping.group_by_fields(df, "k").aggregate(sql_nulls=True, s=grouping.sum_("v"))
    assert (None, None) in rows(sql)
    with pytest.raises(ValueError):
        grouping.group_by_fields(df.withColumn("r", F.struct("k")), "r")
    seq = grouping.group_by_fields(df, "k").sequence("g")
    assert rows(grouping.aggregate_sequence(seq, "g", n=grouping.column(F.count("v")))) == sorted([("E", 3), (None, 0)], key=repr)
    assert grouping.aggregate_sequence(df, "no", n=grouping.count()) is df


def test_flattening(spark):
    df = spark.createDataFrame([(1, ("A", "C"), ["p", "q", "r"], [1, 2]), (2, ("B", "D"), [], []), (3, None, None, [7])], "id long, user struct<name:string,city:string>, tags array<string>, n array<long>")
    out = R.dot_flatten(df)
    assert out.columns == ["id", "user.name", "user.city", "tags", "n"]
    assert rows(out) == sorted([(1, "A", "C", "p", 1), (1, "A", "C", "q", 2), (2, "B", "D", None, None), (3, None, None, None, 7)], key=repr)
    assert R.cross_flatten(df).count() == 6 + 1 + 1


def test_sorting_of_odd_numbers(spark):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None), (4, 1.0)], "i long, x double")
    assert [r.i for r in prefixes.sort(df, "x").collect()] == [3, 2, 4, 1]
    assert [r.i for r in prefixes.sort(df, "-x").collect()] == [1, 4, 2, 3]


def test_distinct_union(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "_row_number long, k string, v long")
    assert prefixes.distinct(df).count() == 1
    other = spark.createDataFrame([("a", 1, 2.0)], "k string, v long, w double")
    assert prefixes.union(df.drop("_row_number"), other, all_rows=True).count() == 3
    assert prefixes.union(df, df).count() == 1


def test_errors_travel(spark):
    df = composing.safe(ints(spark, [1, 2, 3, 4]))
    bad = R.select_safe(df, F.when(F.col("x") == 2, F.lit("two")), y="x * 10")
    assert composing.ignore_errors(bad).count() == 3
    assert rows(R.where_safe(bad, "x > 3"), "i") == [(1,), (3,)]
    assert rows(prefixes.limit_safe(bad, 2, "i"), "i") == [(0,), (1,), (2,)]
    assert rows(prefixes.offset_safe(bad, 1, "i"), "i") == [(1,), (2,), (3,)]
    with pytest.raises(Exception, match="two"):
        composing.unsafe(bad).collect()
    got, errors = composing.to_channel_with_errors(bad)
    assert len(list(got)) == 1 and errors == ["two"]
    assert composing.chain()(df) is df and composing.tee(df, 0) == [] and len(composing.lazy_tee(df, 3)) == 3


def test_running(spark):
    df = spark.createDataFrame([(0, 4.0), (1, 7.5), (2, -1.5), (3, 6.0)], "i long, value double")
    assert rows(running.running_sum(df, "value", "i"), "i", "running_sum", "running_count", "running_avg") == [(0, 4.0, 1, 4.0), (1, 11.5, 2, 5.75), (2, 10.0, 3, 10.0 / 3), (3, 16.0, 4, 4.0)]
    assert rows(running.running_average(df, "value", 3, "i"), "i", "moving_avg", "window_size", "total_count") == [(0, 4.0, 1, 1), (1, 5.75, 2, 2), (2, 10.0 / 3, 3, 3), (3, 4.0, 3, 4)]
    assert running.running_average(df, "value", 0, "i").count() == 0
    assert [r.ema for r in running.exponential_moving_average(df, "value", 0.2, "i").orderBy("i").collect()] == pytest.approx([4.0, 4.7, 3.46, 3.968])
    m = spark.createDataFrame([(0, 8), (1, 6), (2, None), (3, 2)], "i long, value long")
    assert rows(running.running_min_max(m, "value", "i"), "i", "running_min", "running_max")[-1] == (3, 0.0, 8.0)
    assert rows(running.running_min_max(m, "value", "i", skip_missing=True), "i", "running_min")[-1] == (3, 2.0)
    c = spark.createDataFrame([(0, "ash"), (1, "oak"), (2, "oak"), (3, "elm"), (4, "ash")], "i long, tree string")
    for parts in ((), ("k",)):
        got = running.running_count(c.withColumn("k", F.lit(1)), "tree", "i", parts).orderBy("i").collect()
        assert [(r.total_count, r.distinct_values) for r in got] == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 3)]
        assert [r.distinct_counts for r in got] == [{"ash": 1}, {"ash": 1, "oak": 1}, {"ash": 1, "oak": 2}, {"ash": 1, "oak": 2, "elm": 1}, {"ash": 2, "oak": 2, "elm": 1}]


def test_count_windows(spark):
    df = ints(spark, [9, 8, 6, 3, 7, 5, 4, 2])
    got = windowing.count_window(df, 3, "i").orderBy("window").collect()
    assert [[x.x for x in r.rows] for r in got] == [[9, 8, 6], [3, 7, 5], [4, 2]]
    got = windowing.sliding_count_window(df, 4, 2, "i").orderBy("window").collect()
    assert [[x.x for x in r.rows] for r in got] == [[9, 8, 6, 3], [6, 3, 7, 5], [7, 5, 4, 2]]
    got = windowing.sliding_count_window(df, 3, 5, "i").orderBy("window").collect()
    assert [[x.x for x in r.rows] for r in got] == [[9, 8, 6], [3, 7, 5]]


def test_time_windows(spark):
    at = dt.datetime(2023, 5, 6, 7, 0, 0)
    df = spark.createDataFrame([(at + dt.timedelta(seconds=s), i) for i, s in enumerate((3, 7, 11, 12, 31))] + [(None, 9)], "time timestamp_ntz, v long")
    got = windowing.time_window(df, 10, "time").orderBy("window_start").collect()
    assert [[x.v for x in r.rows] for r in got] == [[0, 1], [2, 3], [4]]
    assert windowing.offset_seconds(7 * 86400) == 4 * 86400 and windowing.offset_seconds(3600) == 0
    assert prefixes.time_limit(df.filter("v < 9"), "time", 9, "v").count() == 4
    text = df.filter("v < 9").withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    assert windowing.time_window(text, 10, "time").count() == 3
    unix = df.filter("v < 9").select(F.unix_seconds(F.col("time").cast("timestamp")).alias("time"), "v")
    assert windowing.time_window(unix, 10, "time").count() == 3


numbers = st.lists(st.one_of(st.none(), st.integers(-50, 50)), max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(numbers, st.integers(1, 6), st.integers(1, 6))
def test_against_plain_lists(spark, values, size, step):
    df = spark.createDataFrame(list(enumerate(values)), "i long, x long")
    v = [x or 0 for x in values]
    got = running.running_sum(df, "x", "i").orderBy("i").collect()
    assert [r.running_sum for r in got] == [float(sum(v[: i + 1])) for i in range(len(v))]
    got = running.running_average(df, "x", size, "i").orderBy("i").collect()
    assert [r.moving_avg for r in got] == pytest.approx([sum(w) / len(w) for w in (v[max(0, i - size + 1) : i + 1] for i in range(len(v)))])
    now, want = None, []
    for x in v:
        now = float(x) if now is None else 0.25 * x + 0.75 * now
        want.append(now)
    assert [r.ema for r in running.exponential_moving_average(df, "x", 0.25, "i").orderBy("i").collect()] == pytest.approx(want)
    s = min(step, size)
    want = [list(range(a, a + size)) for a in range(0, len(v) - size + 1, s)]
    got = windowing.sliding_count_window(df, size, step, "i").orderBy("window").collect()
    assert [[x.i for x in r.rows] for r in got] == want
    assert [r.n for r in numbered(df, "-i", "n").orderBy("i").collect()] == list(range(len(v), 0, -1))
    assert [r.m for r in carried(df, "i", {"m": ("max", F.coalesce("x", F.lit(0)))}).orderBy("i").collect()] == [max(v[: i + 1]) for i in range(len(v))]
