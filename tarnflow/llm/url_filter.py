"""URL block and allow rules, matched by hash prefixes of host-suffix/path-prefix expressions.

A rule is a host and the start of a path. Each URL is expanded into the
expressions ``host suffix + path prefix`` that a rule could be made of: suffixes
at label borders, prefixes of the lengths that rules have. Expressions meet the
rules in an equi-join on a short prefix of their SHA-256 digest; the full digest
then confirms, and the longest rule wins. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join compares; the rest is compared after it.
SHORT = 8

#: Production rules of the registered query, as (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark, rules) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """``(key, host, path, rule, verdict)`` for every row of ``urls``.

    ``rules(verdict, host, path)``: a rule fits its host and every subdomain when
    the URL's path starts with its own. The longest rule text (host and path) wins;
    of equally long ones the longer host, then ``block``. Rules with a null or empty
    host fit nothing; of rules said twice with both verdicts ``block`` holds. URLs
    that are null or lack ``://`` have an empty host and path, and so no rule.
    Without a fitting rule ``rule`` is null and the verdict is ``default``. Rows that
    repeat a key keep one row each. Extra columns are ignored.
    """
    said = rules.select("verdict", ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path")).filter("r_host <> ''")
    said = said.groupBy("r_host", "r_path").agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocks"))
    expr = F.concat("r_host", F.lit("\n"), "r_path")
    said = said.withColumn("r_digest", F.sha2(expr, 256)).withColumn("r_short", F.substring("r_digest", 1, SHORT))
    # the label counts and path lengths that rules have; a handful of integers
    shapes = said.select(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars")).distinct()
    shapes = shapes.groupBy().agg(F.collect_set(F.struct("labels", "chars")).alias("shapes")).head()[0]

    base = urls.select(F.col(key).alias("k"), F.col(url_col).alias("u"))
    base = base.select("k", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    pairs = base.select("host", "path").filter("host <> ''").distinct()
    if not shapes:
        return base.select(F.col("k").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n = F.size(F.split("host", r"\."))
    cand = pairs.withColumn("s", F.explode(F.array(*[F.struct(F.lit(s.labels).alias("labels"), F.lit(s.chars).alias("chars")) for s in sorted(shapes)])))
    cand = cand.filter((n >= F.col("s.labels")) & (F.length("path") >= F.col("s.chars")))
    cand = cand.withColumn("suffix", F.expr("substring_index(host, '.', -s.labels)")).withColumn("prefix", F.expr("substring(path, 1, s.chars)"))
    cand = cand.withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256))
    hits = cand.join(said, F.substring("digest", 1, SHORT) == F.col("r_short")).filter("digest = r_digest and suffix = r_host and prefix = r_path")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), "blocks", "r_host", "r_path")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.concat("best.r_host", "best.r_path").alias("rule"), F.when(F.col("best.blocks") == 1, "block").otherwise("allow").alias("said"))
    out = base.join(best, (base.host == best.b_host) & (base.path == best.b_path), "left")
    return out.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"))


ORACLE_SQL = """
with p as (
  select page_id, coalesce(url, '') as u from pages
), q as (
  select page_id,
    case when position('://' in u) > 0 then
      translate(regexp_extract(substr(u, position('://' in u) + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    else '' end as host,
    case when position('://' in u) > 0 then
      regexp_extract(substr(u, position('://' in u) + 3), '^[^/?#]*([^?#]*)', 1)
    else '' end as path
  from p
), rules(v, h, pre) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit as (
  select page_id, v, h || pre as rule,
    row_number() over (partition by page_id order by length(h || pre) desc, length(h) desc, v desc) as rn
  from q join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, pre)
)
select q.page_id, q.host, q.path, f.rule, coalesce(f.v, 'allow') as verdict
from q left join fit f on f.page_id = q.page_id and f.rn = 1
"""
