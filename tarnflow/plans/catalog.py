"""Registered queries, and the SQL that must give the same rows.

Every query runs over its whole tables. Sums of floats are rounded to four places
on both sides, as their last digits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composing, grouping, joining, prefixes, rows, running, windowing
from ..operators.grouping import avg, collect, column, count, first, last, max_, min_, sum_
from ..operators.profiling import profile
from ..operators.rows import Clause
from .flow import Flow



class Tables:
    """The tables of a folder: ``tables(name)`` as frames, ``tables.path(name)`` where they lie."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table getter under its own name, with the SQL it must agree with."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


# projection


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def select_fields(t: Tables) -> DataFrame:
    return rows.include(t("orders"), "o_orderkey", "o_custkey", "no_such_field", "o_totalprice")


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate from orders")
def exclude_fields(t: Tables) -> DataFrame:
    return rows.exclude(t("orders"), "o_orderpriority", "no_such_field")


@query("select c_custkey as id, c_name as name, c_acctbal as c_mktsegment from customer")
def rename_fields(t: Tables) -> DataFrame:
    c = rows.include(t("customer"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return rows.rename(c, ("c_custkey", "id"), ("c_name", "x"), ("x", "name"), ("c_acctbal", "c_mktsegment"), ("absent", "y"))


@query("select c_custkey, upper(c_mktsegment) as segment, c_acctbal * 2 as doubled from customer")
def select_exprs(t: Tables) -> DataFrame:
    return rows.select(t("customer"), c_custkey="c_custkey", segment="upper(c_mktsegment)", doubled="c_acctbal * 2")


# filters


@query("select * from lineitem where l_quantity > 30 and l_discount <= 0.05")
def where_num(t: Tables) -> DataFrame:
    return rows.where_clauses(t("lineitem"), [Clause([("l_quantity", "gt", "30"), ("l_discount", "le", "0.05")])])


@query("select * from orders where (o_orderstatus = 'F' and o_totalprice >= 300000) or (o_orderpriority = '1-URGENT' and o_totalprice < 50000)")
def where_or_clauses(t: Tables) -> DataFrame:
    return rows.where_clauses(t("orders"), [Clause([("o_orderstatus", "eq", "F"), ("o_totalprice", "ge", "300000")]), Clause([("o_orderpriority", "eq", "1-URGENT"), ("o_totalprice", "lt", "50000")])])


@query("select p_partkey, p_name from part where contains(p_name, 'ed') and not starts_with(p_name, 'red') or ends_with(p_name, 'ring')")
def where_string_ops(t: Tables) -> DataFrame:
    p = rows.include(t("part"), "p_partkey", "p_name")
    return rows.where(p, 'contains(p_name, "ed") and not startsWith(p_name, "red") or p_name endsWith "ring"')


@query("select p_partkey, p_type from part where regexp_matches(p_type, '^(ECO|STANDARD).*')")
def where_regex(t: Tables) -> DataFrame:
    return rows.where_clauses(rows.include(t("part"), "p_partkey", "p_type"), [Clause([("p_type", "pattern", "^(ECO|STANDARD).*")])])


@query("select c_custkey, o_orderstatus from customer left join orders on c_custkey = o_custkey where o_orderstatus <> 'F'")
def where_ne_missing(t: Tables) -> DataFrame:
    j = joining.left_join(t("customer"), t("orders"), [("c_custkey", "o_custkey")])
    return rows.include(rows.where_clauses(j, [Clause([("o_orderstatus", "ne", "F")])]), "c_custkey", "o_orderstatus")


@query("select event_id, user_id, value from events where (value >= 20 and event_type in ('click', 'view')) or user_id % 7 = 3")
def where_expr(t: Tables) -> DataFrame:
    e = rows.include(t("events"), "event_id", "user_id", "value", "event_type")
    return rows.exclude(rows.where(e, 'value >= 20 && event_type in ["click", "view"] || user_id % 7 == 3'), "event_type")


# update


@query("select p_partkey, 'checked' as p_brand, cast(1 as bigint) as version from part")
def update_literal(t: Tables) -> DataFrame:
    p = rows.include(t("part"), "p_partkey", "p_brand")
    return rows.update_clauses(p, [Clause(sets={"p_brand": "checked", "version": 1})])


@query("select c_custkey, c_acctbal, case when c_acctbal > 8000 and c_mktsegment = 'BUILDING' then 'gold' when c_acctbal > 5000 then 'silver' else 'bronze' end as tier from customer")
def update_case(t: Tables) -> DataFrame:
    c = rows.include(t("customer"), "c_custkey", "c_acctbal", "c_mktsegment")
    clauses = [
        Clause([("c_acctbal", "gt", "8000"), ("c_mktsegment", "eq", "BUILDING")], sets={"tier": "gold"}),
        Clause([("c_acctbal", "gt", "5000")], sets={"tier": "silver"}),
        Clause(sets={"tier": "bronze"}),
    ]
    return rows.exclude(rows.update_clauses(c, clauses), "c_mktsegment")


@query("select l_orderkey, l_tax as l_discount, l_discount as l_tax, l_discount + l_tax as both_ from lineitem")
def update_preimage(t: Tables) -> DataFrame:
    x = rows.include(t("lineitem"), "l_orderkey", "l_discount", "l_tax")
    return rows.update_clauses(x, [Clause(set_exprs={"l_discount": "l_tax", "l_tax": "l_discount", "both_": "l_discount + l_tax"})])


@query("select l_orderkey, round(l_extendedprice * (1 - l_discount), 4) as net, case when l_quantity > 25 then 'bulk' when l_quantity > 10 then 'mid' else 'small' end as size_, cast(l_partkey % 10 as bigint) as digit, floor(l_tax * 100) as pct from lineitem")
def update_expr_math(t: Tables) -> DataFrame:
    x = rows.update_clauses(t("lineitem"), [Clause(set_exprs={"net": "l_extendedprice * (1 - l_discount)", "size_": 'l_quantity > 25 ? "bulk" : l_quantity > 10 ? "mid" : "small"', "digit": "l_partkey % 10", "pct": "floor(l_tax * 100)"})])
    return rounded(rows.include(x, "l_orderkey", "net", "size_", "digit", "pct"), "net")


# expressions


@query("""select p_partkey, upper(split_part(p_name, ' ', 1)) as head, lower(trim(p_brand)) || '!' as brand, substr(p_name, 1, 3) as short,
  array_to_string(string_split(p_name, ' '), '-') as slug, length(p_name)::bigint as n, starts_with(p_type, 'ECO') as eco from part""")
def expr_strings(t: Tables) -> DataFrame:
    return rows.select(
        t("part"), p_partkey="p_partkey", head='upper(split(p_name, " ")[0])', brand='(p_brand | trim | lower) + "!"', short="p_name[0:3]",
        slug='join(split(p_name, " "), "-")', n="len(p_name)", eco='startsWith(p_type, "ECO")',
    )


@query("""select vec_id, len(list_filter(embedding, lambda x: x > 0))::bigint as positive, round(list_sum(list_transform(embedding, lambda x: x::double * 2)), 4) as doubled,
  len(list_filter(embedding, lambda x: x < -10)) = 0 as bounded, len(list_filter(embedding, lambda x: x > 0.3)) > 0 as large, len(embedding)::bigint as n from embeddings""")
def expr_arrays(t: Tables) -> DataFrame:
    e = rows.select(
        t("embeddings"), vec_id="vec_id", positive="count(filter(embedding, {# > 0}))", doubled="sum(map(embedding, {# * 2}))",
        bounded="all(embedding, {# >= -10})", large="any(embedding, {# > 0.3})", n="len(embedding)",
    )
    return rounded(e, "doubled")


@query("""select c.c_custkey, o.o_totalprice is not null as has_order, coalesce(o.o_totalprice, 0) as price, coalesce(o.o_orderstatus, 'none') as status, 7::bigint as fallback
  from customer c left join orders o on c.c_custkey = o.o_custkey""")
def expr_has_getor(t: Tables) -> DataFrame:
    j = joining.left_join(t("customer"), t("orders"), [("c_custkey", "o_custkey")])
    return rows.select(j, c_custkey="c_custkey", has_order='has("o_totalprice")', price='getOr("o_totalprice", 0)', status='o_orderstatus ?? "none"', fallback='getOr("no_such", 7)')


@query("""select l_orderkey, coalesce(try_cast(l_returnflag as bigint), -1) as whole, case when l_tax = 0 then null else l_discount / l_tax end as ratio, l_quantity ** 2 as square,
  least(l_discount, l_tax) as low, greatest(l_discount, l_tax) as high, abs(l_discount - l_tax) as gap, cast(l_linenumber as varchar) as line from lineitem""")
def expr_math_errors(t: Tables) -> DataFrame:
    return rows.select(
        t("lineitem"), l_orderkey="l_orderkey", whole="int(l_returnflag) ?? -1", ratio="l_tax == 0 ? nil : l_discount / l_tax", square="l_quantity ** 2",
        low="min(l_discount, l_tax)", high="max(l_discount, l_tax)", gap="abs(l_discount - l_tax)", line="string(l_linenumber)",
    )


# joins


def _customers(t: Tables) -> DataFrame:
    return rows.rename(rows.include(t("customer"), "c_custkey", "c_name", "c_acctbal"), ("c_custkey", "custkey"))


def _orders(t: Tables) -> DataFrame:
    return rows.rename(rows.include(t("orders"), "o_custkey", "o_totalprice"), ("o_custkey", "custkey"))


_SIDES = "with c as (select c_custkey as custkey, c_name, c_acctbal from customer), o as (select o_custkey as custkey, o_totalprice from orders)"


@query(f"{_SIDES} select * from c join o using (custkey)")
def join_inner(t: Tables) -> DataFrame:
    return joining.inner_join(_customers(t), _orders(t), joining.on_fields("custkey"))


@query(f"{_SIDES} select * from c left join o using (custkey)")
def join_left(t: Tables) -> DataFrame:
    return joining.left_join(_customers(t), _orders(t), ["custkey"])


@query(f"{_SIDES} select * from c right join o using (custkey)")
def join_right(t: Tables) -> DataFrame:
    return joining.right_join(_customers(t), _orders(t), ["custkey"])


@query(f"{_SIDES} select * from c full join o using (custkey)")
def join_full(t: Tables) -> DataFrame:
    return joining.full_join(_customers(t), _orders(t), ["custkey"])


@query(f"{_SIDES} select custkey, c_name, coalesce(o_totalprice, c_acctbal) as amount from c full join o using (custkey)")
def join_overlay(t: Tables) -> DataFrame:
    left = rows.rename(_customers(t), ("c_acctbal", "amount"))
    right = rows.rename(_orders(t), ("o_totalprice", "amount"))
    return joining.full_join(left, right, ["custkey"])


@query("select s_suppkey, n_nationkey, s_nationkey, n_name from supplier join nation on cast(s_nationkey as varchar) = cast(n_nationkey as varchar)")
def join_pair(t: Tables) -> DataFrame:
    j = joining.inner_join(t("supplier"), t("nation"), joining.on_pairs(("s_nationkey", "n_nationkey")))
    return rows.include(j, "s_suppkey", "n_nationkey", "s_nationkey", "n_name")


@query("select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey and s_acctbal > 1000 * n_regionkey")
def join_theta(t: Tables) -> DataFrame:
    on = joining.on_condition(lambda left, right: (left["s_nationkey"] == right["n_nationkey"]) & (left["s_acctbal"] > 1000 * right["n_regionkey"]))
    return rows.include(joining.inner_join(t("supplier"), t("nation"), on), "s_suppkey", "n_name")


@query("""select l_orderkey, l_linenumber, count(*) as pairs, cast(sum(a.l_suppkey) as bigint) as suppliers from lineitem a join (select l_orderkey, l_linenumber, l_partkey as other from lineitem) b
  using (l_orderkey, l_linenumber) group by all""")
def join_multi(t: Tables) -> DataFrame:
    a = rows.include(t("lineitem"), "l_orderkey", "l_linenumber", "l_suppkey")
    b = rows.rename(rows.include(t("lineitem"), "l_orderkey", "l_linenumber", "l_partkey"), ("l_partkey", "other"))
    j = joining.inner_join(a, b, ["l_orderkey", "l_linenumber"])
    return grouping.group_by_fields(j, "l_orderkey", "l_linenumber").aggregate(pairs=count(), suppliers=column(F.sum("l_suppkey")))


@query("select n_name, count(*) as customers, round(sum(c_acctbal), 4) as balance from nation join customer on n_nationkey = c_nationkey group by n_name")
def join_then_group(t: Tables) -> DataFrame:
    j = joining.inner_join(t("customer"), t("nation"), [("c_nationkey", "n_nationkey")])
    return rounded(grouping.group_by_fields(j, "n_name").aggregate(customers=count(), balance=sum_("c_acctbal")), "balance")


# aggregates


@query("""select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 4) as qty, round(sum(l_extendedprice), 2) as price, round(avg(l_discount), 6) as disc
  from lineitem group by all""")
def group_count_sum_avg(t: Tables) -> DataFrame:
    g = grouping.group_by_fields(t("lineitem"), "l_returnflag", "l_linestatus").aggregate(n=count(), qty=sum_("l_quantity"), price=sum_("l_extendedprice"), disc=avg("l_discount"))
    return rounded(rounded(rounded(g, "qty"), "price", places=2), "disc", places=6)


@query("select p_brand, min(p_name) as first_name, max(p_name) as last_name, min(p_retailprice) as low, max(p_retailprice) as high, max(p_size)::bigint as size_ from part group by p_brand")
def group_min_max(t: Tables) -> DataFrame:
    return grouping.group_by_fields(t("part"), "p_brand").aggregate(first_name=min_("p_name", str), last_name=max_("p_name", str), low=min_("p_retailprice"), high=max_("p_retailprice"), size_=max_("p_size", int))


@query("select user_id, arg_min(event_type, event_id) as first_type, arg_max(event_type, event_id) as last_type, arg_max(value, event_id) as last_value from events group by user_id")
def group_first_last(t: Tables) -> DataFrame:
    return grouping.group_by_fields(t("events"), "user_id").aggregate(first_type=first("event_type", "event_id"), last_type=last("event_type", "event_id"), last_value=last("value", "event_id"))


@query("select user_id, string_agg(event_type, ',' order by event_id) as types from events group by user_id")
def group_collect(t: Tables) -> DataFrame:
    g = grouping.group_by_fields(t("events"), "user_id").aggregate(types=collect("event_type", "event_id"))
    return rows.materialize(g, "types", "types")


@query("select date_trunc('month', o_orderdate)::timestamp as month, count(*) as n from orders group by 1")
def group_expr_key(t: Tables) -> DataFrame:
    key = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return grouping.group_by(t("orders"), "month", key).aggregate(n=count())


@query("select p_brand, 0.0::double as total, 0.0::double as mean, 0.0::double as low, count(*) as n from part group by p_brand")
def group_defaults(t: Tables) -> DataFrame:
    return grouping.group_by_fields(t("part"), "p_brand").aggregate(total=sum_("p_name"), mean=avg("p_name"), low=min_("p_name"), n=count())


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
def having(t: Tables) -> DataFrame:
    return rows.where(grouping.group_by_fields(t("orders"), "o_custkey").aggregate(n=count()), "n > 12")


@query("select o_orderpriority, max(o_totalprice) - min(o_totalprice) as spread, count(distinct o_custkey) as customers from orders group by 1")
def group_custom(t: Tables) -> DataFrame:
    return grouping.group_by_fields(t("orders"), "o_orderpriority").aggregate(spread=column(F.max("o_totalprice") - F.min("o_totalprice")), customers=column(F.count_distinct("o_custkey")))


@query("select user_id, count(*)::bigint as n, max(value) as top from events group by user_id")
def group_sequence(t: Tables) -> DataFrame:
    groups = grouping.group_by_fields(rows.include(t("events"), "user_id", "value"), "user_id").sequence("rows_")
    return groups.select("user_id", F.size("rows_").cast("long").alias("n"), F.array_max(F.transform("rows_", lambda r: r["value"])).alias("top"))


# sets, sorting, paging


@query("select distinct o_orderstatus, o_orderpriority from orders")
def distinct_rows(t: Tables) -> DataFrame:
    return prefixes.distinct(rows.include(t("orders"), "o_orderstatus", "o_orderpriority"))


@query("select event_id, user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def distinct_by(t: Tables) -> DataFrame:
    return prefixes.distinct_by(rows.include(t("events"), "event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "event_id")


@query("select c_nationkey as k, c_name as name, null::double as extra from customer union all select s_nationkey, s_name, s_acctbal from supplier")
def union_all(t: Tables) -> DataFrame:
    a = t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
    b = t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("extra"))
    return prefixes.union(a, b, all_rows=True)


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(t: Tables) -> DataFrame:
    return prefixes.union(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def sort_limit_topk(t: Tables) -> DataFrame:
    return Flow(rows.include(t("orders"), "o_orderkey", "o_totalprice")).sort("-o_totalprice", "o_orderkey").limit(25).frame


@query("select o_orderkey, o_custkey from orders order by o_orderkey limit 50 offset 100")
def offset_page(t: Tables) -> DataFrame:
    o = rows.include(t("orders"), "o_orderkey", "o_custkey")
    return prefixes.offset(o, 100, "o_orderkey").limit(50)


@query("select c_custkey, row_number() over (order by c_custkey desc) as place from customer")
def reverse_rank(t: Tables) -> DataFrame:
    from ..operators.ordering import numbered

    return numbered(rows.include(t("customer"), "c_custkey"), "-c_custkey", "place")


_PREFIX = "select event_id, value from (select *, max(case when {stop} then 1 else 0 end) over (order by event_id) as hit from events) where hit = {hit}"


@query(_PREFIX.format(stop="not (value < 90)", hit=0))
def take_while(t: Tables) -> DataFrame:
    return rows.include(prefixes.take_while(t("events"), "value < 90", "event_id"), "event_id", "value")


@query(_PREFIX.format(stop="user_id = 3 and event_type = 'error'", hit=0))
def take_until(t: Tables) -> DataFrame:
    return rows.include(prefixes.take_until(t("events"), 'user_id == 3 and event_type == "error"', "event_id"), "event_id", "value")


@query(_PREFIX.format(stop="not (value < 90)", hit=1))
def skip_while(t: Tables) -> DataFrame:
    return rows.include(prefixes.skip_while(t("events"), "value < 90", "event_id"), "event_id", "value")


@query(_PREFIX.format(stop="user_id = 3 and event_type = 'error'", hit=1))
def skip_until(t: Tables) -> DataFrame:
    return rows.include(prefixes.skip_until(t("events"), 'user_id == 3 and event_type == "error"', "event_id"), "event_id", "value")


# along an order


@query("""select event_id, round(sum(value) over w, 4) as running_sum, count(*) over w as running_count, round(avg(value) over w, 9) as running_avg
  from events window w as (partition by user_id order by event_id)""")
def running_sum(t: Tables) -> DataFrame:
    r = running.running_sum(t("events"), "value", "event_id", ["user_id"])
    return rounded(rounded(rows.include(r, "event_id", "running_sum", "running_count", "running_avg"), "running_sum"), "running_avg", places=9)


@query("select event_id, round(sum(value) over (order by event_id), 3) as running_sum, row_number() over (order by event_id) as running_count from events")
def running_sum_global(t: Tables) -> DataFrame:
    r = running.running_sum(t("events"), "value", "event_id")
    return rounded(rows.include(r, "event_id", "running_sum", "running_count"), "running_sum", places=3)


@query("select event_id, min(value) over w as running_min, max(value) over w as running_max, max(value) over w - min(value) over w as running_range from events window w as (partition by user_id order by event_id)")
def running_minmax(t: Tables) -> DataFrame:
    return rows.include(running.running_min_max(t("events"), "value", "event_id", ["user_id"]), "event_id", "running_min", "running_max", "running_range")


@query("""select event_id, round(avg(value) over (partition by user_id order by event_id rows between 4 preceding and current row), 4) as moving_avg,
  least(5, row_number() over (partition by user_id order by event_id))::bigint as window_size, row_number() over (partition by user_id order by event_id) as total_count from events""")
def running_avg(t: Tables) -> DataFrame:
    r = running.running_average(t("events"), "value", 5, "event_id", ["user_id"])
    return rounded(rows.include(r, "event_id", "moving_avg", "window_size", "total_count"), "moving_avg")


@query("select event_id, round(avg(value) over (order by event_id rows between 4 preceding and current row), 4) as moving_avg from events")
def running_avg_global(t: Tables) -> DataFrame:
    return rounded(rows.include(running.running_average(t("events"), "value", 5, "event_id"), "event_id", "moving_avg"), "moving_avg")


@query("""select event_id, row_number() over (partition by user_id order by event_id) as total_count,
  sum(case when rn = 1 then 1 else 0 end) over (partition by user_id order by event_id)::bigint as distinct_values,
  count(*) over (partition by user_id, event_type order by event_id) as own_count
  from (select *, row_number() over (partition by user_id, event_type order by event_id) as rn from events)""")
def running_distinct(t: Tables) -> DataFrame:
    r = running.running_count(t("events"), "event_type", "event_id", ["user_id"])
    return r.select("event_id", "total_count", "distinct_values", F.col("distinct_counts")[F.col("event_type")].alias("own_count"))


@query("""with recursive o as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as n from events),
  r as (select user_id, event_id, n, value as ema from o where n = 1 union all select o.user_id, o.event_id, o.n, 0.3 * o.value + 0.7 * r.ema from r join o on o.user_id = r.user_id and o.n = r.n + 1)
  select event_id, round(ema, 6) as ema from r""")
def ema(t: Tables) -> DataFrame:
    e = running.exponential_moving_average(t("events"), "value", 0.3, "event_id", ["user_id"])
    return rounded(rows.include(e, "event_id", "ema"), "ema", places=6)


@query("""with recursive o as (select event_id, value, row_number() over (order by event_id) as n from events),
  r as (select event_id, n, value as ema from o where n = 1 union all select o.event_id, o.n, 0.3 * o.value + 0.7 * r.ema from r join o on o.n = r.n + 1)
  select event_id, round(ema, 5) as ema from r""")
def ema_global(t: Tables) -> DataFrame:
    return rounded(rows.include(running.exponential_moving_average(t("events"), "value", 0.3, "event_id"), "event_id", "ema"), "ema", places=5)


# windows


@query("""select user_id, (n - 1) // 10 as window, count(*) as rows_, round(sum(value), 4) as total, min(event_id) as start
  from (select *, row_number() over (partition by user_id order by event_id) as n from events) group by 1, 2""")
def count_window(t: Tables) -> DataFrame:
    return rounded(windowing.count_window(t("events"), 10, "event_id", ["user_id"], rows_=count(), total=sum_("value"), start=min_("event_id", int)), "total")


@query("select (n - 1) // 100 as window, count(*) as rows_, min(event_id) as start from (select *, row_number() over (order by event_id) as n from events) group by 1")
def count_window_global(t: Tables) -> DataFrame:
    return windowing.count_window(t("events"), 100, "event_id", rows_=count(), start=min_("event_id", int))


@query("""select user_id, (n - 5) // 3 as window, round(total, 4) as total, start from (
  select *, row_number() over w as n, sum(value) over f as total, min(event_id) over f as start from events
  window w as (partition by user_id order by event_id), f as (partition by user_id order by event_id rows between 4 preceding and current row))
  where n >= 5 and (n - 5) % 3 = 0""")
def sliding_count_window(t: Tables) -> DataFrame:
    return rounded(windowing.sliding_count_window(t("events"), 5, 3, "event_id", ["user_id"], total=sum_("value"), start=min_("event_id", int)), "total")


@query("select time_bucket(interval '1 hour', ts) as window_start, count(*) as n, round(sum(value), 4) as total from events group by 1")
def time_window_1h(t: Tables) -> DataFrame:
    return rounded(rows.exclude(windowing.time_window(t("events"), 3600, "ts", n=count(), total=sum_("value")), "window_end"), "total")


@query("select time_bucket(interval '7 days', ts, timestamp '2024-01-01') as window_start, time_bucket(interval '7 days', ts, timestamp '2024-01-01') + interval '7 days' as window_end, count(*) as n from events group by 1, 2")
def time_window_7d(t: Tables) -> DataFrame:
    return windowing.time_window(t("events"), 7 * 86400, "ts", n=count())


@query("""select h as window_start, count(*) as n, round(sum(value), 4) as total from (
  select value, unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as h from events) group by 1""")
def sliding_time_window(t: Tables) -> DataFrame:
    return rounded(rows.exclude(windowing.sliding_time_window(t("events"), 7200, 3600, "ts", n=count(), total=sum_("value")), "window_end"), "total")


@query("""with recursive r as (select min(ts) as e from events union all select (select min(ts) from events where ts >= r.e + interval '1 day') from r where r.e is not null)
  select e as window_end, count(*) as n, round(sum(value), 4) as total from r join events on ts <= e and ts > e - interval '2 days' where e is not null group by 1""")
def sliding_time_arrival(t: Tables) -> DataFrame:
    return rounded(windowing.sliding_time_arrival(t("events"), 2 * 86400, 86400, "ts", n=count(), total=sum_("value")), "total")


@query("select event_id, ts from events where ts <= (select min(ts) from events) + interval '10 days'")
def time_limit(t: Tables) -> DataFrame:
    return rows.include(prefixes.time_limit(t("events"), "ts", 10 * 86400, "event_id"), "event_id", "ts")


# nested and serialised data


@query("select c_custkey, sha256(c_name) as digest from customer")
def hash_field(t: Tables) -> DataFrame:
    return rows.include(rows.hash_field(t("customer"), "c_name", "digest"), "c_custkey", "digest")


@query("select p_partkey, array_to_string([p_partkey, p_size * 2], '|') as ids from part")
def materialize(t: Tables) -> DataFrame:
    p = t("part").select("p_partkey", F.array(F.col("p_partkey"), (F.col("p_size") * 2).cast("long")).alias("ids"))
    return rows.materialize(p, "ids", "ids", "|")


@query("select c_custkey, '{\"n\":' || c_nationkey || ',\"s\":\"' || c_mktsegment || '\"}' as js, '\"' || c_name || '\"' as name_js from customer")
def materialize_json(t: Tables) -> DataFrame:
    c = t("customer").withColumn("rec", F.struct(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")))
    return rows.include(rows.materialize_json(rows.materialize_json(c, "rec", "js"), "c_name", "name_js"), "c_custkey", "js", "name_js")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""select p_partkey, p_brand as "rec.brand", p_size as "rec.size", unnest(string_split(p_name, ' ')[1:1]) as words, p_size as sizes from part""")
def dot_flatten(t: Tables) -> DataFrame:
    p = t("part").select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("rec"), F.split("p_name", " ").alias("words"), F.array("p_size").alias("sizes"))
    return rows.dot_flatten(p)


@query("select p_partkey, w as words, unnest([p_size, p_size + 1]) as sizes from (select p_partkey, p_size, unnest(string_split(p_name, ' ')) as w from part)")
def cross_flatten(t: Tables) -> DataFrame:
    p = t("part").select("p_partkey", F.split("p_name", " ").alias("words"), F.array(F.col("p_size"), F.col("p_size") + 1).alias("sizes"))
    return rows.cross_flatten(p)


@query("select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def select_many(t: Tables) -> DataFrame:
    return rows.select_many(rows.include(t("part"), "p_partkey", "p_name"), 'split(p_name, " ")', "word").drop("p_name")


# plumbing


@query("select 'high' as branch, count(*) as n from orders where o_totalprice > 250000 union all select 'low', count(*) from orders where o_totalprice <= 250000")
def tee_branches(t: Tables) -> DataFrame:
    a, b = composing.tee(t("orders"), 2)
    high = rows.where(a, "o_totalprice > 250000").agg(F.count("*").alias("n")).select(F.lit("high").alias("branch"), "n")
    low = rows.where(b, "o_totalprice <= 250000").agg(F.count("*").alias("n")).select(F.lit("low").alias("branch"), "n")
    return prefixes.union(high, low, all_rows=True)


@query("select o_orderkey, o_totalprice / 2 as half from orders where o_totalprice >= 100000 and o_orderstatus <> 'P'")
def safe_chain(t: Tables) -> DataFrame:
    bad = F.when(F.col("o_orderstatus") == "P", F.lit("pending orders have no price"))
    steps = composing.chain_with_errors(
        lambda df: rows.select_safe(df, bad, half="o_totalprice / 2"),
        lambda df: rows.where_safe(df, "o_totalprice >= 100000"),
        composing.ignore_errors,
    )
    return rows.include(steps(t("orders")), "o_orderkey", "half")


@query("""select o_orderkey, o_orderstatus = 'P' as failed from (select *, sum(case when o_orderstatus <> 'P' then 1 else 0 end) over (order by o_orderkey) as good from orders)
  where case when o_orderstatus <> 'P' then good <= 200 else good < 200 end""")
def safe_limit(t: Tables) -> DataFrame:
    df = rows.select_safe(rows.include(t("orders"), "o_orderkey", "o_orderstatus"), F.when(F.col("o_orderstatus") == "P", F.lit("pending")))
    out = prefixes.limit_safe(df, 200, "o_orderkey")
    return out.select("o_orderkey", F.col("_error").isNotNull().alias("failed"))


@query("""select 'c_acctbal' as field, 'numeric' as kind, count(*) as n, min(c_acctbal) as low, max(c_acctbal) as high, round(avg(c_acctbal), 4) as mean, round(stddev_pop(c_acctbal), 4) as deviation from customer
  union all select 'c_mktsegment', 'string', count(*), null, null, null, null from customer""")
def profile_stats(t: Tables) -> DataFrame:
    c = rows.include(t("customer"), "c_acctbal", "c_mktsegment")
    got = [(p.name, p.kind, p.count, p.min, p.max, p.mean, p.stddev) for p in profile(c)]
    df = c.sparkSession.createDataFrame(got, "field string, kind string, n long, low double, high double, mean double, deviation double")
    return rounded(df, "mean", "deviation")


@query("""select c_mktsegment, count(*) as orders_, round(sum(o_totalprice), 2) as value_ from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'P'
  group by 1 order by 3 desc limit 5""")
def flagship(t: Tables) -> DataFrame:
    out = Flow(t("orders")).where('o_orderstatus != "P"').join(t("customer"), [("o_custkey", "c_custkey")]).group_by("c_mktsegment", orders_=count(), value_=sum_("o_totalprice")).sort("-value_").limit(5)
    return rounded(out.frame, "value_", places=2)


# extensions beyond the reference


@query("select event_id, rank() over (partition by user_id order by value desc, event_id) as r, lag(value) over (partition by user_id order by event_id) as prev from events")
def ext_rank_lag(t: Tables) -> DataFrame:
    from ..operators.ordering import window

    return t("events").select("event_id", F.rank().over(window(["-value", "event_id"], ["user_id"])).cast("long").alias("r"), F.lag("value").over(window("event_id", ["user_id"])).alias("prev"))


@query("""select user_id, min(ts) as window_start, count(*) as n from (select *, sum(case when gap is null or gap >= interval '6 hours' then 1 else 0 end) over (partition by user_id order by event_id) as s
  from (select *, ts - lag(ts) over (partition by user_id order by event_id) as gap from events)) group by user_id, s""")
def ext_session_window(t: Tables) -> DataFrame:
    w = windowing.session_window(t("events"), 6 * 3600, "ts", ["user_id"], n=count())
    return w.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def ext_anti_join(t: Tables) -> DataFrame:
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


from . import catalog_files  # noqa: E402, F401  (registers its queries here)
