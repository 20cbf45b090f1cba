"""URL rules: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base rules as (verdict, host, path).
BASE_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Rules are broadcast up to this many rows, and joined by a shuffle beyond it.
BROADCAST_RULES = 50_000
SHORT_DIGITS = 8


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for NULL and for a URL without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def short_key(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, 1, SHORT_DIGITS), 16, 10).cast("long")


def base_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASE_RULES, "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow") -> DataFrame:
    """The rule that fits each page and its verdict: one row per input row.

    A rule (verdict, host, path) fits its host and all subdomains if the page's path starts
    with the rule's path. The longest expression wins; of two rules with the same expression
    the one that blocks. Pages without a fitting rule get ``default`` and a NULL rule.

    NULL URLs have an empty host and path and fit no rule; a rule with an empty path fits every
    path of its host, the empty one included; rules with a NULL host or path are void. Repeated rows are judged row by row; empty tables give empty results.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.concat("host", "path").alias("rule"),
        F.length(F.concat("host", "path")).alias("rank"),
        F.length("path").alias("cut"),
        F.size(F.split("host", r"\.", -1)).alias("labels"),
        (F.col("verdict") == "block").cast("int").alias("blocks"),
        F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("full"),
    ).withColumn("short", short_key(F.col("full")))
    # Path lengths that some rule has: distinct integers, no more than the longest rule's path.
    cuts = sorted(r[0] for r in rules.select("cut").distinct().collect())
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"), host.alias("host"),
                         path.alias("path"))
    labels = F.split("host", r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<int>"), lambda c: c <= F.length("path")),
        lambda c: F.substring(F.col("path"), F.lit(1), c))
    keys = F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(
        prefixes, lambda p: short_key(F.sha2(F.concat(h, F.lit("\n"), p), 256))))))
    # Rows without a host fit nothing; equal URLs are judged once. Only short prefixes are exploded and
    # joined; the full digest of the expression that a hit stands for confirms it afterwards.
    probes = (parts.where("host <> ''").select("_url", "host", "path").distinct()
              .select("_url", "host", "path", F.explode(keys).alias("short")))
    met = probes.join(F.broadcast(rules) if few else rules, "short")
    expression = F.concat(F.expr("substring_index(host, '.', -labels)"), F.lit("\n"), F.substring(F.col("path"), F.lit(1), F.col("cut")))
    hits = met.where(F.sha2(expression, 256) == F.col("full"))
    best = hits.groupBy("_url").agg(F.max(F.struct("rank", "blocks", "rule")).alias("best"))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.blocks") == 1, "block").otherwise("allow")
    return parts.join(best, "_url", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the base rules on all ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), base_rules(spark))


ORACLE_SQL = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
h AS (SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
        arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
      GROUP BY page_id)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM p LEFT JOIN h USING (page_id)
"""
