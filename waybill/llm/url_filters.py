"""URL filters: each URL's host suffixes and path prefixes are looked up in a rule table by short hash prefixes.

An expression is a host suffix and a path prefix. Expressions of distinct URLs meet the rules in an equi-join on the
first bytes of their digests; the full digest and the text confirm a hit, and the longest rule that fits wins.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import lower_ascii

#: Hex digits of the digest that are joined on (4 bytes).
PREFIX = 8

#: The rules of the contract as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    # A host has no slash, so the text is one to one with the pair.
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _suffixes(host: Column, labels: list[int]) -> Column:
    """The last n labels of a host for each n of `labels` that it has."""
    n = F.size(F.split(host, r"\."))
    own = F.filter(F.array(*[F.lit(k) for k in labels]), lambda k: k <= n)
    return F.transform(own, lambda k: F.call_function("substring_index", host, F.lit("."), -k))


def _prefixes(path: Column, lengths: list[int]) -> Column:
    own = F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k <= F.length(path))
    return F.transform(own, lambda k: F.substring(path, F.lit(1), k))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_shapes: int = 2000) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of `pages` (page_id, url; other columns are not read).

    A rule fits its host and all subdomains if the path starts with the rule's; of those that fit the longest text wins,
    then the longest host, then the smallest verdict. Without a fitting rule, rule is null and the verdict `default`. A null url, or
    one without `://`, has an empty host and path, and no rule fits it (an empty host has one empty label).
    Repeated rows stay; repeated rules count once. Only numbers of labels and lengths of paths that some rule has are
    expanded: `max_shapes` of either at most, which the call checks.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    shape = lambda c: sorted(r[0] for r in rules.select(c).distinct().limit(max_shapes + 1).collect())
    labels, lengths = shape(F.size(F.split("rule_host", r"\."))), shape(F.length("rule_path"))
    if max(len(labels), len(lengths)) > max_shapes:
        raise ValueError(f"rules have more than {max_shapes} host depths or path lengths")
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not labels:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    urls = pages.where("host <> ''").select("host", "path").distinct()
    expressions = (
        urls.withColumn("suffix", F.explode(_suffixes(F.col("host"), labels)))
        .withColumn("prefix", F.explode(_prefixes(F.col("path"), lengths)))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("digest", 1, PREFIX)))
    keyed = rules.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn(
        "rule_short", F.substring("rule_digest", 1, PREFIX))
    hits = expressions.join(keyed, F.expr("short = rule_short")).where(
        "digest = rule_digest and suffix = rule_host and prefix = rule_path")
    best = hits.groupBy("host", "path").agg(F.expr(
        "max_by(struct(concat(rule_host, rule_path) as rule, verdict), "
        "struct(length(rule_host) + length(rule_path), length(rule_host), verdict = 'allow'))").alias("best"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best")
    return pages.join(best, F.expr("host = _host and path = _path"), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def oracle() -> str:
    """DuckDB SQL for `judge_urls` of the table pages with RULES."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
with rules(rule_host, rule_path, verdict) as (values {values}),
parts as (
  select page_id, url,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
urls as (select distinct host, path from parts),
best as (
  select host, path, arg_max(rule_host || rule_path, length(rule_host) + length(rule_path)) as rule,
    arg_max(verdict, length(rule_host) + length(rule_path)) as verdict
  from urls join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path)
select page_id, p.host, p.path, rule, coalesce(verdict, 'allow') as verdict
from parts p left join best b on p.host = b.host and p.path = b.path"""
