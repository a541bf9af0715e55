"""URL filters: host-suffix and path-prefix expressions, met with the rules on short hash prefixes.

A url gives its host and each host suffix on a label boundary, times the prefixes of its path. A rule fits its host and
all subdomains if the url's path starts with the rule's path, so only prefixes as long as some rule's path can meet a
rule: the distinct lengths in the rule table say which prefixes to make, and no rule is lost. Expressions are hashed
(SHA-256); the first 8 hex digits are the equi-join key, the whole digest confirms the match, and of the rules that fit,
the longest (host and path together, then the longer host, then block before allow) decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.session import fresh

RULES = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "verdict")])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: on to `?`, `#` or the end. Null or no `://`: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    whole = F.regexp_extract(rest, r"(?s)\A([^?#]*)", 1)
    host = F.regexp_extract(whole, r"(?s)\A([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), F.substr(whole, F.length(host) + 1)


def suffixes(host: Column) -> Column:
    """The host and its suffixes on label boundaries."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule (host + path of the rule that decides; null if none fits) and verdict (the rule's, else `default`).

    rules: host, path (begins with `/`), verdict (allow or block). Rules with a null host or path are void; equal rules
    count once. Columns of `pages` stay, except that older columns of those four names are replaced. Each row is judged
    by itself, so repeated rows and null ids need no care; null and empty urls get empty host and path and the default.
    A url seen often is judged once: distinct (host, path) pairs are expanded, and the verdicts joined back, where Spark
    may split a hot url, as the other side has one row a pair.
    """
    made = ("host", "path", "rule", "verdict")
    rules = rules.filter("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    expression = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    # As many numbers as rule paths have distinct lengths: bounded by the longest path.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    keyed = rules.select(expression(F.col("host"), F.col("path")).alias("r_digest"), F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict")
    keyed = keyed.withColumn("short", F.substring("r_digest", 1, PREFIX))

    host, path = split_url(F.col(url))
    parts = pages.drop(*[c for c in pages.columns if c.lower() in made]).withColumns({"host": host, "path": path})
    urls = parts.select("host", "path").distinct()
    lengths = F.array(*map(F.lit, lengths)).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    met = (
        urls.select("host", "path", F.explode(suffixes(F.col("host"))).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .withColumn("digest", expression(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("digest", 1, PREFIX))
        .join(keyed, "short")
        .filter("digest = r_digest")
    )
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.col("verdict").alias("v"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(rank.alias("rank"), F.concat("r_host", "r_path").alias("rule"), "verdict")).alias("best"))
    b_host, b_path = fresh(parts.columns, "b_host", "b_path")
    best = best.select(F.col("host").alias(b_host), F.col("path").alias(b_path), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    out = parts.join(best, (F.col("host") == F.col(b_host)) & (F.col("path") == F.col(b_path)), "left").drop(b_host, b_path)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


#: The rules of the registered query: host, path, verdict.
OP10_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame(OP10_RULES, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = """
with p as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), w as (
  select page_id, regexp_extract(coalesce(rest, ''), '^([^?#]*)', 1) as whole from p
), h as (
  select page_id, regexp_extract(whole, '^([^/]*)', 1) as raw, whole from w
), u as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(whole, length(raw) + 1) as path from h
)
select page_id, host, path,
  case when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
       when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
       when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'com/en/'
       when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'net/de/'
       when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'org/es/' end as rule,
  case when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'allow'
       when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'block'
       when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'block'
       when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'allow'
       when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'block'
       else 'allow' end as verdict
from u
"""
