"""The fluent pipeline, the command line, streams, and the registered queries against SQL."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from engine_helpers import rows
from tarnflow import streaming
from tarnflow.operators import grouping
from tarnflow.operators.ordering import OrderRequired
from tarnflow.plans import catalog, cli
from tarnflow.plans.flow import Flow

SF = "/root/testdata/sf0.001"
BOATS = "boat,year,harbour,tonnes\nTern,1990,Oban,310\nSkua,1985,Mallaig,120\nGannet,1995,Oban,640\nPetrel,1988,Oban,450\nPuffin,2001,Oban,720\n"


def test_flow(spark, tmp_path):
    p = tmp_path / "boats.csv"
    p.write_text(BOATS)
    top = Flow.read_csv(spark, str(p)).where_match(("harbour", "eq", "Oban")).include("boat", "tonnes").sort("-tonnes").limit(3)
    assert [tuple(r) for r in top.frame.collect()] == [("Puffin", 720), ("Gannet", 640), ("Petrel", 450)]
    f = Flow.read_csv(spark, str(p))
    assert [r.boat for r in f.take_while("year >= 1990").frame.collect()] == ["Tern"]
    assert f.running_sum("tonnes").frame.orderBy("_row_number").collect()[1].running_sum == 430.0
    with pytest.raises(OrderRequired):
        f.group_by("harbour", n=grouping.count()).reverse()
    assert [r.boat for r in f.reverse().limit(1).frame.collect()] == ["Puffin"]


def test_command_line(spark, tmp_path, capsys):
    p = tmp_path / "boats.csv"
    p.write_text(BOATS)
    line = ["read-csv", str(p), "then", "where", "-match", "year", "gt", "1986", "+", "-expr", 'boat == "Skua"', "then", "update", "-match", "tonnes", "ge", "500", "-set", "band", "high", "+", "-set", "band", "low"]
    out = cli.run_line(spark, line)
    assert rows(out.frame, "boat", "band") == [("Gannet", "high"), ("Petrel", "low"), ("Puffin", "high"), ("Skua", "low"), ("Tern", "low")]
    g = cli.run_line(spark, [*line, "then", "group-by", "band", "-count", "n", "-avg", "tonnes", "mean", "then", "rename", "-as", "n", "count", "then", "sort", "count"])
    assert rows(g.frame, "band", "count") == [("high", 2), ("low", 3)]
    d = tmp_path / "d.csv"
    d.write_text("port,depth\nOban,3\n")
    j = cli.run_line(spark, ["read-csv", str(p), "then", "join", "-type", "left", "-right", str(d), "-left-field", "harbour", "-right-field", "port", "then", "exclude", "port"])
    assert j.frame.filter("depth is null").count() == 1
    u = cli.run_line(spark, ["read-csv", str(p), "then", "union", "-file", str(p), "then", "offset", "2", "then", "distinct"])
    assert u.frame.count() == 3
    assert cli.run_line(spark, ["read-csv", str(p), "then", "limit", "1", "then", "table"]) is None
    assert "Tern" in capsys.readouterr().out
    assert cli.main(["version"]) == 0 and cli.main(["functions", "-category", "math"]) == 0
    assert "round(n)" in capsys.readouterr().out
    assert cli.main(["limit", "x"]) == 2 and cli.main(["nonsense"]) == 2
    assert cli.main(["read-csv", str(p), "then", "limit", "1", "then", "generate"]) == 0
    text = capsys.readouterr().out
    compile(text, "x", "exec")
    assert "run_line" in text


def test_streams(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    s = streaming.read_stream(spark, f"{SF}/events.parquet*", e.schema)
    w = streaming.time_window(s, 86400, "ts", "1 hour", n=grouping.count())
    streaming.run_to_table(w, "days", str(tmp_path / "a"))
    batch = {r.d: r.n for r in e.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).collect()}
    got = {r.window_start.date(): r.n for r in spark.table("days").collect()}
    assert len(got) >= len(batch) - 1 and all(batch[k] == v for k, v in got.items())
    r = streaming.running_sum(streaming.read_stream(spark, f"{SF}/events.parquet*", e.schema), "user_id", "value", "ts")
    streaming.run_to_table(r, "sums", str(tmp_path / "b"))
    last = spark.table("sums").groupBy("user_id").agg(F.max_by("running_sum", "running_count").alias("s"))
    want = e.groupBy("user_id").agg(F.sum("value").alias("t"))
    assert last.join(want, "user_id").filter("abs(s - t) > 1e-6").count() == 0 and last.count() == want.count()
    c = streaming.count_window(streaming.read_stream(spark, f"{SF}/events.parquet*", e.schema), "user_id", "value", 5, "ts")
    streaming.run_to_table(c, "counts", str(tmp_path / "c"))
    assert spark.table("counts").count() == e.groupBy("user_id").count().select(F.sum(F.floor(F.col("count") / 5))).head()[0]
    m = streaming.exponential_moving_average(streaming.read_stream(spark, f"{SF}/events.parquet*", e.schema), "user_id", "value", 0.5, "ts")
    streaming.run_to_table(m, "emas", str(tmp_path / "d"))
    assert spark.table("emas").count() == e.count()
    seen = []
    q = streaming.tee(streaming.read_stream(spark, f"{SF}/events.parquet*", e.schema), [lambda b, n: seen.append(b.count()), lambda b, n: seen.append(b.count())], str(tmp_path / "e"))
    q.awaitTermination()
    assert sum(seen) == 2 * e.count()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return c


def plain(frame):
    out = []
    for r in frame.astype(object).itertuples(index=False):
        out.append(tuple("null" if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else float(v) for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    assert plain(got[cols]) == plain(want[cols])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
