import io
import json

import pytest
from pyspark.sql import functions as F

from engine_helpers import rows
from tarnflow.operators.profiling import profile
from tarnflow.sources import charts, readers, writers


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("name, age ,city\n# note\nAlice,30,NYC\nBob,25\nCarol,x1,LA,extra\nDan, 41 ,SF\n")
    safe = readers.read_csv_safe(spark, str(p)).orderBy("_row_number").collect()
    assert [(r.name, r._row_number, r._error is None) for r in safe] == [("Alice", 1, True), (None, 2, False), (None, 3, False), ("Dan", 4, True)]
    df = readers.read_csv(spark, str(p))
    assert dict(df.dtypes)["age"] == "bigint" and rows(df, "name", "age") == [("Alice", 30), ("Dan", 41)]
    with pytest.raises(Exception):
        readers.read_csv(spark, str(p), strict=True).collect()
    p.write_text("a|b\n1|true\n2.5|false\n")
    df = readers.read_csv(spark, str(p), readers.CSVConfig(delimiter="|"))
    assert dict(df.dtypes) == {"a": "double", "b": "boolean", "_row_number": "bigint"}
    df = readers.read_csv(spark, str(p), readers.CSVConfig(header=False, delimiter="|"))
    assert df.columns[:2] == ["col_0", "col_1"] and df.count() == 3
    assert rows(readers.csv_rows(spark, io.StringIO("x,y\n1,a\nbad\n")), "x", "y") == [(1, "a")]
    assert [readers.infer_value(x) for x in ("1", " 0", "true", "1.5", "t x ")] == [1, 0, True, 1.5, "t x"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5, [1, 2]), (2, None, 2.0, [])], "id long, s string, f double, arr array<long>")
    writers.write_csv(df, str(tmp_path / "o"), one_file=True)
    back = readers.read_csv(spark, str(tmp_path / "o"))
    assert back.columns == ["f", "id", "s", "_row_number"] and rows(back, "id", "f") == [(1, 1.5), (2, 2.0)]
    lines = list(writers.csv_lines(df, readers.CSVConfig(fields=("id", "arr"))))
    assert lines[0] == "id,arr" and lines[1] in ('1,"1,2"', "1,1,2")


def test_json(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "m": {"k": "v"}, "tags": ["a"], "f": 1.5}\n\nnot json\n{"id": 2}\n')
    safe = readers.read_json_safe(spark, str(p)).orderBy("_line_number").collect()
    assert [(r.id, r._line_number, r._error is None) for r in safe] == [(1, 0, True), (None, 2, False), (2, 3, True)]
    df = readers.read_json(spark, str(p))
    assert dict(df.dtypes)["id"] == "bigint" and dict(df.dtypes)["m"] == "struct<k:string>" and dict(df.dtypes)["tags"] == "array<string>"
    a = tmp_path / "b.json"
    a.write_text('[{"x": 1}, {"x": 2}]')
    assert rows(readers.read_json_auto(spark, str(a)), "x") == [(1,), (2,)]
    assert rows(readers.json_rows(spark, io.StringIO('{"x": 1}\nbad\n{"x": 2.5}\n')), "x") == [(1.0,), (2.5,)]
    odd = readers.json_rows(spark, io.StringIO('{"a b": 1, "STRING": "x", "c:d": {"e`f": [1.5, 2]}, "n": null, "BIGINT": true}\n'))
    assert dict(odd.dtypes)["a b"] == "bigint" and odd.select("`c:d`").head()[0]["e`f"] == [1.5, 2.0] and odd.head()["STRING"] == "x"
    writers.write_json(df.drop("_line_number"), str(tmp_path / "o"))
    assert readers.read_json(spark, str(tmp_path / "o")).count() == 2
    j = spark.createDataFrame([(1, '{"a":[1]}')], "id long, js string")
    assert json.loads(next(writers.json_lines(j, ["js"]))) == {"id": 1, "js": {"a": [1]}}
    writers.write_json_pretty(j, str(tmp_path / "p.json"), ["js"])
    assert json.loads((tmp_path / "p.json").read_text()) == [{"id": 1, "js": {"a": [1]}}]


def test_lines_and_commands(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("one\ntwo\n\n")
    assert rows(readers.read_lines(spark, str(p))) == sorted([("one", 0), ("two", 1), ("", 2)])
    writers.write_lines(readers.read_lines(spark, str(p)), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 3
    c = tmp_path / "c.txt"
    c.write_text("PID  TTY CMD\n 12 tty1 ls -l  x\n\n 7 ? \n")
    df = readers.read_command_output(spark, str(c))
    assert rows(df, "PID", "TTY", "CMD") == sorted([(12, "tty1", "ls -l x"), (7, "?", "")], key=repr)
    assert readers.read_command_output_safe(spark, str(c)).filter(F.col("_error").isNotNull()).count() == 1
    e = readers.exec_command(spark, "printf", ["a b\\n1 2\\n"])
    assert rows(e, "a", "b") == [(1, 2)] and e.head()._command.startswith("printf")
    assert readers.exec_command_safe(spark, "no-such-command").filter(F.col("_error").isNotNull()).count() == 1
    assert readers.exec_command_safe(spark, "false").filter(F.col("_error").contains("exit status 1")).count() == 1


def test_empty_files(spark, tmp_path):
    p = tmp_path / "e"
    p.write_text("")
    assert readers.read_csv(spark, str(p)).count() == 0
    assert readers.read_json(spark, str(p)).count() == 0
    assert readers.read_lines(spark, str(p)).count() == 0


def test_table_profile_and_charts(spark, tmp_path):
    df = spark.createDataFrame([("Widget with a long name", 1, "2024-01-01"), ("B", 3, "2024-01-02"), (None, None, "2024-01-03")], "product string, n long, day string")
    text = writers.format_table(df, 10)
    assert text.splitlines()[0].split() == ["day", "n", "product"] and "Widget ..." in text
    p = {f.name: f for f in profile(df)}
    assert (p["n"].kind, p["n"].mean, p["n"].stddev, p["n"].count) == ("numeric", 2.0, 1.0, 2) and p["day"].kind == "date" and p["product"].categories[0] == "B"
    charts.quick_chart(df, "product", "n", str(tmp_path / "c.html"))
    assert "n vs product" in (tmp_path / "c.html").read_text()
    charts.time_series_chart(df, "day", ["n"], str(tmp_path / "t.html"), charts.ChartConfig(title="</script>", theme="dark"))
    assert "&lt;/script&gt;" in (tmp_path / "t.html").read_text()
    with pytest.raises(ValueError):
        charts.interactive_chart(df.limit(0), str(tmp_path / "x.html"))


def test_a_chart_stands_for_all_rows(spark, tmp_path):
    """More rows than points: neighbours are averaged, none is left out, and the page says so."""
    import json
    import re

    from tarnflow.sources.charts import ChartConfig, interactive_chart

    df = spark.range(20).selectExpr("cast(100 + id as string) as x", "id as y")
    for most, noted in ((20, False), (10, True)):
        path = str(tmp_path / f"{most}.html")
        interactive_chart(df, path, ChartConfig(max_points=most, x_field="x", y_fields=["y"]), ["x"])
        with open(path, encoding="utf-8") as f:
            page = f.read()
        assert ("20 rows, drawn as 10 points" in page) == noted
        data = json.loads(re.search(r"const D=(\{.*?\});", page, re.S)[1])
        assert data["series"][0]["values"] == ([2 * i + 0.5 for i in range(10)] if noted else list(range(20)))
        assert data["labels"][1] == ("102" if noted else "101")
