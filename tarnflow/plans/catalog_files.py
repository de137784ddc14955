"""Registered queries of sources, sinks, the command line, composition, typed access and streams.

What a query writes lies in the shared folder; it is read back by the reader of that form.
"""

from __future__ import annotations

import io
import queue

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import streaming
from ..functions import access
from ..operators import composing, grouping, prefixes, rows, running
from ..operators.grouping import count
from ..sources import charts, readers, writers
from ..sources.readers import CommandConfig, CSVConfig
from ..scratch import new_path
from .catalog import Tables, query
from .cli import generate, run_line


def _written(df: DataFrame, tag: str, write, *args, **kw) -> str:
    path = new_path(df.sparkSession, tag)
    write(df, path, *args, **kw)
    return path


# delimited text


@query("select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer")
def csv_round_trip(t: Tables) -> DataFrame:
    c = t("customer")
    return rows.exclude(readers.read_csv(c.sparkSession, _written(c, "csv", writers.write_csv)), readers.ROW)


@query("select o_orderkey, o_orderpriority, o_totalprice from orders")
def csv_delimiter_and_fields(t: Tables) -> DataFrame:
    config = CSVConfig(delimiter="|", fields=("o_orderkey", "o_orderpriority", "o_totalprice"))
    o = t("orders")
    return rows.exclude(readers.read_csv(o.sparkSession, _written(o, "csv", writers.write_csv, config), config), readers.ROW)


@query("select p_name as col_0, p_partkey as col_1, p_retailprice as col_2 from part")
def csv_without_header(t: Tables) -> DataFrame:
    config = CSVConfig(header=False, fields=("p_name", "p_partkey", "p_retailprice"))
    p = t("part")
    return rows.exclude(readers.read_csv(p.sparkSession, _written(p, "csv", writers.write_csv, config), config), readers.ROW)


@query("select row_number() over (order by c_custkey) as _row_number, c_custkey as key_, c_name as name_ from customer")
def csv_row_numbers(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("key_"), F.col("c_name").alias("name_")).orderBy("key_")
    return readers.read_csv(c.sparkSession, _written(c, "csv", writers.write_csv, one_file=True))


@query("""select case when c_custkey % 5 = 0 then null else c_custkey end as key_, case when c_custkey % 5 = 0 then null else c_mktsegment end as segment, c_custkey % 5 = 0 as failed from customer""")
def csv_safe(t: Tables) -> DataFrame:
    """Every fifth row has a field too many."""
    fields = F.concat_ws(",", "c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, F.lit("surplus")))
    lines = t("customer").select(fields.alias("line"))
    path = _written(prefixes.union(lines.limit(0).sparkSession.createDataFrame([("key_,segment",)], "line string"), lines, all_rows=True), "ragged", writers.write_lines, one_file=True)
    got = readers.read_csv_safe(lines.sparkSession, path)
    return got.select("key_", "segment", F.col("_error").isNotNull().alias("failed"))


@query("select c_custkey as key_, c_mktsegment as segment from customer where c_custkey % 5 <> 0")
def csv_skips_bad_rows(t: Tables) -> DataFrame:
    fields = F.concat_ws(",", "c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, F.lit("surplus")))
    lines = t("customer").select(fields.alias("line"))
    path = _written(prefixes.union(lines.sparkSession.createDataFrame([("# a comment",), ("key_,segment",)], "line string"), lines, all_rows=True), "ragged", writers.write_lines, one_file=True)
    return rows.exclude(readers.read_csv(lines.sparkSession, path), readers.ROW)


@query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def csv_from_reader_and_to_writer(t: Tables) -> DataFrame:
    n = t("nation")
    text = io.StringIO("\n".join(writers.csv_lines(n)) + "\n")
    return rows.exclude(readers.csv_rows(n.sparkSession, text), readers.ROW)


# JSON


@query("select event_id, user_id, event_type, value from events")
def jsonl_round_trip(t: Tables) -> DataFrame:
    e = rows.include(t("events"), "event_id", "user_id", "event_type", "value")
    return rows.exclude(readers.read_json(e.sparkSession, _written(e, "json", writers.write_json)), readers.LINE)


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def jsonl_nested(t: Tables) -> DataFrame:
    """Fields that hold JSON text are written as what they stand for, and come back as records."""
    e = rows.include(t("events"), "event_id", "props")
    got = readers.read_json(e.sparkSession, _written(e, "json", writers.write_json, ("props",)))
    return rows.dot_flatten(rows.exclude(got, readers.LINE)).withColumnRenamed("props.k", "k")


@query("""select case when s_suppkey % 3 = 0 then null else s_suppkey end as s_suppkey, s_suppkey % 3 = 0 as failed, row_number() over (order by s_suppkey) - 1 as _line_number from supplier""")
def jsonl_safe(t: Tables) -> DataFrame:
    s = t("supplier").orderBy("s_suppkey")
    line = F.when(F.col("s_suppkey") % 3 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct("s_suppkey")))
    got = readers.read_json_safe(s.sparkSession, _written(s.select(line.alias("line")), "json", writers.write_lines, one_file=True))
    return got.select("s_suppkey", F.col("_error").isNotNull().alias("failed"), readers.LINE)


@query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def json_array_auto(t: Tables) -> DataFrame:
    """A file that holds one array, told from lines of objects by its first character."""
    n = t("nation")
    at = F.row_number().over(_by("n_nationkey"))
    items = n.select(at.alias("at"), F.concat(F.when(at == 1, "[").otherwise(","), F.to_json(F.struct(*n.columns))).alias("line"))
    lines = prefixes.union(items, n.sparkSession.createDataFrame([(1 << 30, "]")], "at int, line string"), all_rows=True).orderBy("at")
    return readers.read_json_auto(n.sparkSession, _written(lines, "array", writers.write_lines, one_file=True))


@query("select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier")
def json_auto_lines(t: Tables) -> DataFrame:
    s = t("supplier")
    return rows.exclude(readers.read_json_auto(s.sparkSession, _written(s, "json", writers.write_json)), readers.LINE)


@query("select r_regionkey::bigint as r_regionkey, r_name, row_number() over (order by r_regionkey) - 1 as _line_number from region")
def json_from_reader_and_to_writer(t: Tables) -> DataFrame:
    r = t("region").orderBy("r_regionkey")
    return readers.json_rows(r.sparkSession, io.StringIO("\n".join(writers.json_lines(r))))


@query("select r_regionkey::bigint as r_regionkey, r_name from region")
def json_pretty_array(t: Tables) -> DataFrame:
    r = t("region")
    return rows.exclude(readers.json_rows(r.sparkSession, io.StringIO("\n".join(writers.json_pretty_lines(r)))), readers.LINE)


def _by(name: str):
    from ..operators.ordering import window

    return window(name)


# lines, commands, Parquet, tables, charts


@query("select p_name as line, row_number() over (order by p_partkey) - 1 as line_number from part")
def lines_round_trip(t: Tables) -> DataFrame:
    p = t("part").orderBy("p_partkey")
    return readers.read_lines(p.sparkSession, _written(p, "lines", writers.write_lines, "p_name", one_file=True))


@query("select p_type as line, false as failed from part")
def lines_safe(t: Tables) -> DataFrame:
    p = t("part")
    got = readers.read_lines_safe(p.sparkSession, _written(p, "lines", writers.write_lines, "p_type"))
    return got.select("line", F.col("_error").isNotNull().alias("failed"))


def _listing(t: Tables) -> str:
    s = t("supplier").select(F.col("s_suppkey").alias("at"), F.format_string("%d   %d  %s of the world", "s_suppkey", "s_nationkey", "s_name").alias("line"))
    head = s.sparkSession.createDataFrame([(-1, "ID  NATION   NAME")], "at long, line string")
    return _written(prefixes.union(head, s, all_rows=True).orderBy("at"), "listing", writers.write_lines, one_file=True)


@query("""select s_suppkey as "ID", s_nationkey::bigint as "NATION", s_name || ' of the world' as "NAME", row_number() over (order by s_suppkey) as _line_number,
  s_suppkey || '   ' || s_nationkey || '  ' || s_name || ' of the world' as _raw_line from supplier""")
def command_output(t: Tables) -> DataFrame:
    return readers.read_command_output(t.spark, _listing(t))


@query("select s_suppkey || '   ' || s_nationkey || '  ' || s_name || ' of the world' as _raw_line, row_number() over (order by s_suppkey) as _line_number from supplier union all select 'ID  NATION   NAME', 0")
def command_output_without_header(t: Tables) -> DataFrame:
    return readers.read_command_output(t.spark, _listing(t), CommandConfig(header=False))


@query("select s_suppkey as \"ID\", false as failed from supplier")
def command_output_safe(t: Tables) -> DataFrame:
    return readers.read_command_output_safe(t.spark, _listing(t)).select("ID", F.col("_error").isNotNull().alias("failed"))


@query("select * from (values (7::bigint, 'seven days', 1::bigint, 'printf N WHAT\\n7 seven days\\n8 eight\\n'), (8, 'eight', 2, 'printf N WHAT\\n7 seven days\\n8 eight\\n')) v(\"N\", \"WHAT\", _line_number, _command)")
def exec_command(t: Tables) -> DataFrame:
    return rows.exclude(readers.exec_command(t.spark, "printf", ["N WHAT\\n7 seven days\\n8 eight\\n"]), readers.RAW)


@query("select 'false' as _command, 'exit status 1: ' as _error")
def exec_command_safe(t: Tables) -> DataFrame:
    return readers.exec_command_safe(t.spark, "false").select("_command", "_error")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def parquet_round_trip(t: Tables) -> DataFrame:
    o = rows.include(t("orders"), "o_orderkey", "o_orderstatus", "o_totalprice")
    return readers.read_parquet(o.sparkSession, _written(o, "parquet", writers.write_parquet, partition_by=["o_orderstatus"]))


@query("""with w as (select max(length(c_name)) as a, greatest(max(length(c_custkey::varchar)), 9) as b from customer)
  select rtrim(rpad(c_custkey::varchar, b::int, ' ') || '   ' || c_name) as line from customer, w
  union all select rpad('c_custkey', b::int, ' ') || '   c_name' from w union all select repeat('-', b::int + 9) from w""")
def table_of_all_rows(t: Tables) -> DataFrame:
    c = rows.include(t("customer"), "c_name", "c_custkey")
    return composing.from_rows(c.sparkSession, [(x,) for x in writers.table_lines(c)], "line string")


@query("""select floor((n - 1) * 500 / total)::bigint as point, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first, round(avg(value), 6) as value from
  (select ts, value, row_number() over (order by ts, event_id) as n, count(*) over () as total from events) group by 1""")
def chart_points(t: Tables) -> DataFrame:
    """A chart of more rows than points stands for all rows: runs of neighbours along the order are averaged."""
    e = t("events").select("ts", "event_id", "value")
    pts = charts.points(e, "ts", ["value"], ["ts", "event_id"], 500)
    return rounded_points(pts)


def rounded_points(pts: DataFrame) -> DataFrame:
    return pts.select(F.col("point"), F.date_format(F.col("x").try_cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.round("y0", 6).alias("value"))


# the command line


def _line(t: Tables, table: str, *commands: str) -> DataFrame:
    return run_line(t.spark, ["read-parquet", t.path(table), *commands]).frame


@query("select o_orderkey, case when o_totalprice >= 300000 and o_orderstatus = 'F' then 'big' else 'other' end as band, o_totalprice / 2 as half from orders where o_orderstatus = 'F' and o_totalprice > 1000 or o_totalprice > 200000 and o_orderpriority <> '5-LOW'")
def cli_where_update(t: Tables) -> DataFrame:
    return _line(
        t, "orders", "then", "where", "-match", "o_orderstatus", "eq", "F", "-m", "o_totalprice", "gt", "1000", "+", "-expr", 'o_totalprice > 200000 and o_orderpriority != "5-LOW"',
        "then", "update", "-match", "o_totalprice", "ge", "300000", "-m", "o_orderstatus", "eq", "F", "-set", "band", "big", "+", "-set", "band", "other",
        "then", "update", "-set-expr", "half", "o_totalprice / 2", "then", "include", "o_orderkey", "band", "half",
    )


@query("select o_orderpriority as priority, count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 2) as mean, min(o_totalprice) as low, max(o_totalprice) as high from orders group by 1 order by n desc limit 3")
def cli_group_rename_sort_limit(t: Tables) -> DataFrame:
    out = _line(
        t, "orders", "then", "group-by", "o_orderpriority", "-count", "n", "-sum", "o_totalprice", "total", "-avg", "o_totalprice", "mean", "-min", "o_totalprice", "low", "-max", "o_totalprice", "high",
        "then", "rename", "-as", "o_orderpriority", "priority", "then", "sort", "-desc", "n", "then", "limit", "3",
    )
    return out.withColumns({n: F.round(n, 2) for n in ("total", "mean")})


@query("select s_suppkey, s_name, n_name from supplier left join nation on s_nationkey = n_nationkey")
def cli_join_exclude(t: Tables) -> DataFrame:
    nation = t.path("nation")
    return _line(t, "supplier", "then", "join", "-type", "left", "-right", nation, "-left-field", "s_nationkey", "-right-field", "n_nationkey", "then", "exclude", "s_nationkey", "n_nationkey", "n_regionkey", "s_acctbal")


@query("select * from nation union all select * from nation")
def cli_union_all(t: Tables) -> DataFrame:
    return _line(t, "nation", "then", "union", "-all", "-file", t.path("nation"))


@query("select distinct o_orderstatus, o_orderpriority from orders")
def cli_distinct(t: Tables) -> DataFrame:
    return _line(t, "orders", "then", "include", "o_orderstatus", "o_orderpriority", "then", "distinct")


@query("select n_nationkey, n_name, n_regionkey from nation order by n_name offset 20")
def cli_sort_offset(t: Tables) -> DataFrame:
    return _line(t, "nation", "then", "sort", "n_name", "then", "offset", "20")


@query("select c_custkey, c_name from customer where c_acctbal < 0")
def cli_csv(t: Tables) -> DataFrame:
    spark, path = t.spark, new_path(t.spark, "cli")
    run_line(spark, ["read-parquet", t.path("customer"), "then", "write-csv", path])
    return run_line(spark, ["read-csv", path, "then", "where", "-match", "c_acctbal", "lt", "0", "then", "include", "c_custkey", "c_name"]).frame


@query("select c_mktsegment, count(*) as n from customer group by 1")
def cli_json(t: Tables) -> DataFrame:
    spark, path = t.spark, new_path(t.spark, "cli")
    run_line(spark, ["read-parquet", t.path("customer"), "then", "write-json", path])
    return run_line(spark, ["read-json", path, "then", "group-by", "c_mktsegment", "-count", "n"]).frame


@query("select line, row_number() over (order by line) - 1 as line_number from (select distinct p_type as line from part)")
def cli_lines(t: Tables) -> DataFrame:
    p = prefixes.distinct(rows.include(t("part"), "p_type")).orderBy("p_type")
    return run_line(p.sparkSession, ["read-lines", _written(p, "lines", writers.write_lines, "p_type", one_file=True)]).frame


@query("select s_suppkey, s_acctbal from supplier where s_acctbal > 0")
def cli_parquet_and_exec(t: Tables) -> DataFrame:
    spark, path = t.spark, new_path(t.spark, "cli") + ".parquet"
    run_line(spark, ["read-parquet", t.path("supplier"), "then", "write-parquet", path])
    least = run_line(spark, ["exec", "printf", "--", "LEAST\\n0\\n", "then", "include", "LEAST"]).frame.head()[0]
    return run_line(spark, ["read-parquet", path, "then", "where", "-match", "s_acctbal", "gt", str(least), "then", "include", "s_suppkey", "s_acctbal"]).frame


@query("select category, count(*) as n from (values ('string', 8), ('math', 6), ('array', 7), ('type', 3), ('helper', 2)) v(category, k), range(k) group by 1")
def cli_functions(t: Tables) -> DataFrame:
    from ..functions import functions

    return grouping.group_by_fields(composing.from_rows(t.spark, functions(), "category string, usage string, about string"), "category").aggregate(n=count())


@query("select n_regionkey, count(*) as n from nation group by 1")
def cli_generate(t: Tables) -> DataFrame:
    """The program that a line generates gives what the line gives."""
    program = generate(["read-parquet", t.path("nation"), "then", "group-by", "n_regionkey", "-count", "n"])
    scope: dict = {}
    exec("\n".join(x for x in program.splitlines() if "show()" not in x and not x.startswith("if ")), scope)  # noqa: S102
    return scope["flow"].frame


# composition and errors


@query("select o_orderkey, o_totalprice * 2 as doubled from orders where o_totalprice > 200000")
def pipe_two(t: Tables) -> DataFrame:
    return composing.pipe(lambda d: rows.where(d, "o_totalprice > 200000"), lambda d: rows.select(d, o_orderkey="o_orderkey", doubled="o_totalprice * 2"))(t("orders"))


@query("select o_orderstatus, count(*) as n from orders where o_totalprice > 100000 group by 1 having count(*) > 10")
def pipe_three(t: Tables) -> DataFrame:
    steps = composing.pipe3(lambda d: rows.where(d, "o_totalprice > 100000"), lambda d: grouping.group_by_fields(d, "o_orderstatus").aggregate(n=count()), lambda d: rows.where(d, "n > 10"))
    return steps(t("orders"))


@query("select o_orderkey, case when o_orderstatus = 'P' then null else o_totalprice / 2 end as half, o_orderstatus = 'P' as failed from orders where o_orderstatus = 'P' or o_totalprice / 2 > 50000")
def pipe_with_errors(t: Tables) -> DataFrame:
    bad = F.when(F.col("o_orderstatus") == "P", F.lit("pending"))
    steps = composing.pipe_with_errors(lambda d: rows.select_safe(d, bad, half="o_totalprice / 2"), lambda d: rows.where_safe(d, "half > 50000"))
    return steps(t("orders")).select("o_orderkey", "half", F.col("_error").isNotNull().alias("failed"))


@query("select r_regionkey::bigint as r_regionkey, r_name from region")
def from_and_to_channel(t: Tables) -> DataFrame:
    """Rows to a Python iterator and back."""
    return composing.from_rows(t.spark, [(r.r_regionkey, r.r_name) for r in composing.to_channel(t("region"))], "r_regionkey long, r_name string")


@query("select n_nationkey::bigint as n_nationkey, 'stopped at 7' as error from nation where n_nationkey < 7")
def to_channel_with_errors(t: Tables) -> DataFrame:
    df = rows.select_safe(t("nation").orderBy("n_nationkey"), F.when(F.col("n_nationkey") == 7, F.lit("stopped at 7")))
    got, errors = composing.to_channel_with_errors(df)
    keys = [r.n_nationkey for r in got]
    return composing.from_rows(df.sparkSession, [(k, e) for k in keys for e in errors], "n_nationkey long, error string")


@query("select n_nationkey::bigint as k, n_name as name, null::varchar as _error from nation union all select null, null, 'lost'")
def from_channel(t: Tables) -> DataFrame:
    items, errors = queue.Queue(), queue.Queue()
    for r in composing.to_channel(t("nation")):
        items.put((r.n_nationkey, r.n_name))
    items.put(None)
    errors.put("lost")
    return composing.from_channel(t.spark, items, errors, "k long, name string")


@query("select c_custkey, c_acctbal from customer where c_acctbal is not null")
def unsafe_rows(t: Tables) -> DataFrame:
    """A frame without failed rows passes; one with any raises (tested)."""
    df = rows.select_safe(rows.include(t("customer"), "c_custkey", "c_acctbal"), F.when(F.col("c_acctbal").isNull(), F.lit("no balance")))
    return composing.unsafe(df)


@query("select 'all' as branch, count(*) as n from orders union all select 'dear', count(*) from orders where o_totalprice > 300000")
def lazy_tee_branches(t: Tables) -> DataFrame:
    a, b = composing.lazy_tee(t("orders"), 2)
    one = a.agg(F.count("*").alias("n")).select(F.lit("all").alias("branch"), "n")
    two = rows.where(b, "o_totalprice > 300000").agg(F.count("*").alias("n")).select(F.lit("dear").alias("branch"), "n")
    return prefixes.union(one, two, all_rows=True)


@query("select n_nationkey, n_name from nation")
def timeout_rows(t: Tables) -> DataFrame:
    """All rows of a table that is read well within the time."""
    return composing.timeout(rows.include(t("nation"), "n_nationkey", "n_name"), 300)


@query("select o_orderkey, o_orderstatus = 'P' as failed from (select *, sum(case when o_orderstatus <> 'P' then 1 else 0 end) over (order by o_orderkey) as good from orders) where o_orderstatus = 'P' or good > 300")
def safe_offset(t: Tables) -> DataFrame:
    df = rows.select_safe(rows.include(t("orders"), "o_orderkey", "o_orderstatus"), F.when(F.col("o_orderstatus") == "P", F.lit("pending")))
    return prefixes.offset_safe(df, 300, "o_orderkey").select("o_orderkey", F.col("_error").isNotNull().alias("failed"))


@query("select row_number() over (order by p_partkey desc) - 1 as line_number, p_partkey::varchar as line from part")
def reverse_rows(t: Tables) -> DataFrame:
    """Rows in reverse order, as the lines of a file show it."""
    p = prefixes.reverse(t("part"), "p_partkey")
    return readers.read_lines(p.sparkSession, _written(p, "reverse", writers.write_lines, "p_partkey", one_file=True))


@query("select c_custkey, length(c_name)::bigint as letters from customer where c_acctbal > 0")
def select_by_python(t: Tables) -> DataFrame:
    def lengths(frames):
        for f in frames:
            f = f[f["c_acctbal"] > 0]
            yield pd.DataFrame({"c_custkey": f["c_custkey"], "letters": f["c_name"].str.len()})

    return rows.select_rows(rows.include(t("customer"), "c_custkey", "c_name", "c_acctbal"), lengths, "c_custkey long, letters long")


@query("select p_partkey from part where false")
def where_bad_regex(t: Tables) -> DataFrame:
    """A pattern that is none matches nothing."""
    return rows.include(rows.where_clauses(t("part"), [rows.Clause([("p_type", "regexp", "(ECO[")])]), "p_partkey")


# expressions, typed access and JSON text


@query("""select p_partkey, ends_with(p_name, 'n') as last_n, contains(p_name, 're') as has_re, contains(p_type, 'ECO') as economy, round_even(p_retailprice, 0) = round_even(p_retailprice, 0) as whole,
  ceil(p_retailprice) as up, case when p_retailprice >= 0 then floor(p_retailprice + 0.5) else ceil(p_retailprice - 0.5) end as near, p_size::double as size_ from part""")
def expr_more_functions(t: Tables) -> DataFrame:
    return rows.select(
        t("part"), p_partkey="p_partkey", last_n='endsWith(p_name, "n")', has_re='contains(p_name, "re")', economy='p_type contains "ECO"', whole="round(p_retailprice) == round(p_retailprice)",
        up="ceil(p_retailprice)", near="round(p_retailprice)", size_="float(p_size)",
    )


@query("""select c_custkey, c_custkey::varchar as text, trunc(c_acctbal)::bigint as whole, c_nationkey::double as number, c_nationkey <> 0 as truth, timestamp '1970-01-01' + to_seconds(c_custkey) as at_, '1|2' as seq_, 'none' as absent from customer""")
def typed_access(t: Tables) -> DataFrame:
    c = t("customer")
    out = rows.materialize(access.set_field(c, "seq_", [1, 2]), "seq_", "seq_", "|")
    return out.select(
        "c_custkey", access.get(c, "c_custkey", str).alias("text"), access.get(c, "c_acctbal", int).alias("whole"), access.get(c, "c_nationkey", float).alias("number"), access.get(c, "c_nationkey", bool).alias("truth"),
        access.get(c, "c_custkey", "time").alias("at_"), "seq_", access.get_or(c, "no_such", "none").alias("absent"),
    )


@query("select c_custkey, 1::bigint as i, 2.5::double as f, 'x' as s, true as b, timestamp '2024-01-02 03:04:05' as t_, c_name as inner_, '[1,2]' as seq_ from customer")
def typed_setters(t: Tables) -> DataFrame:
    import datetime as dt

    df = rows.include(t("customer"), "c_custkey", "c_name")
    for name, value, kind in (("i", 1, int), ("f", 2.5, float), ("s", "x", str), ("b", True, bool), ("t_", dt.datetime(2024, 1, 2, 3, 4, 5), "time"), ("rec", {"name": F.col("c_name")}, None), ("seq", [1, 2], None)):
        df = access.set_field(df, name, value, kind)
    df = rows.materialize_json(df.withColumn("inner_", F.col("rec.name")), "seq", "seq_")
    return access.delete(df, "c_name", "rec", "seq")


@query("""select event_id, event_id % 4 <> 0 as valid, case when event_id % 4 <> 0 then cast(json_extract(props, '$.k') as bigint) end as k, case when event_id % 4 <> 0 then '{\n  "k": ' || cast(json_extract(props, '$.k') as bigint) || '\n}' else 'no json' end as pretty from events""")
def json_text(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 0, F.lit("no json")).otherwise(F.col("props"))
    parsed = F.try_variant_get(access.parse_json(text), "$.k", "bigint")
    return t("events").select("event_id", access.json_valid(text).alias("valid"), parsed.alias("k"), access.json_pretty(text).alias("pretty"))


@query("select * from (values ('c_nationkey')) v(field)")
def invalid_fields(t: Tables) -> DataFrame:
    c = t("customer")
    return composing.from_rows(c.sparkSession, [(n,) for n in access.invalid_fields(c)], "field string")


@query("select a.c_custkey, a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment as equal_ from customer a join customer b on b.c_custkey = a.c_custkey + 1")
def record_equality(t: Tables) -> DataFrame:
    a = t("customer").select("c_custkey", F.struct("c_nationkey", "c_mktsegment").alias("one"))
    b = t("customer").select((F.col("c_custkey") - 1).alias("c_custkey"), F.struct("c_nationkey", "c_mktsegment").alias("two"))
    return a.join(b, "c_custkey").select("c_custkey", F.col("one").eqNullSafe(F.col("two")).alias("equal_"))


@query("select column_name as name, (row_number() over (order by i) - 1)::bigint as place from (values (0, 'o_orderkey'), (1, 'o_custkey'), (2, 'o_orderstatus'), (3, 'o_totalprice'), (4, 'o_orderdate'), (5, 'o_orderpriority')) v(i, column_name)")
def record_keys(t: Tables) -> DataFrame:
    o = t("orders")
    return composing.from_rows(o.sparkSession, [(n, i) for i, n in enumerate(o.columns)], "name string, place long")


@query("""select event_id, total_count, count(*) filter (where event_type = 'click') over w as clicks, count(*) filter (where event_type = 'view') over w as views,
  sum(case when rn = 1 then 1 else 0 end) over w::bigint as distinct_values from (select *, row_number() over (order by event_id) as total_count, row_number() over (partition by event_type order by event_id) as rn from events)
  window w as (order by event_id)""")
def running_map_global(t: Tables) -> DataFrame:
    """Counts of all values so far, over the whole table."""
    r = running.running_count(t("events"), "event_type", "event_id")
    seen = lambda v: F.coalesce(F.col("distinct_counts")[v], F.lit(0)).cast("long")
    return r.select("event_id", "total_count", seen("click").alias("clicks"), seen("view").alias("views"), "distinct_values")


# streams


def _stream(t: Tables) -> DataFrame:
    return streaming.read_stream(t.spark, t.path("events") + "*", t("events").schema)


@query("select user_id, count(*) as n, round(sum(value), 3) as total from events group by 1")
def stream_running_sum(t: Tables) -> DataFrame:
    """The last running sum of each key of a stream of files."""
    r = _collected_stream(t.spark, streaming.running_sum(_stream(t), "user_id", "value", "ts"))
    return r.groupBy("user_id").agg(F.max("running_count").cast("long").alias("n"), F.round(F.max_by("running_sum", "running_count"), 3).alias("total"))


@query("select user_id, count(*) // 5 as windows from events group by 1 having count(*) >= 5")
def stream_count_window(t: Tables) -> DataFrame:
    return _collected_stream(t.spark, streaming.count_window(_stream(t), "user_id", "value", 5, "ts")).groupBy("user_id").agg(F.count("*").alias("windows"))


@query("select time_bucket(interval '1 day', ts) as day, count(*) as n from events group by 1 having time_bucket(interval '1 day', ts) + interval '25 hours' <= (select max(ts) from events)")
def stream_time_window(t: Tables) -> DataFrame:
    """Days that the watermark has passed."""
    w = _collected_stream(t.spark, streaming.time_window(_stream(t), 86400, "ts", "1 hour", n=count()))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "n")


def _collected_stream(spark, df: DataFrame) -> DataFrame:
    """What is available of a stream, written to Parquet in the shared folder."""
    path = new_path(spark, "stream")
    streaming.run_to_files(df, path, new_path(spark, "stream-state"))
    return spark.read.schema(df.schema).parquet(path)
