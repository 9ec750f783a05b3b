"""URL filters over host-suffix and path-prefix expressions.

Each URL is expanded into the expressions ``suffix + path prefix`` that a rule could name: host
suffixes at dots, and path prefixes that end in ``/``. Expressions meet rules by an equi-join on the
first four bytes of their SHA-256; full digests then confirm the match, and the longest rule wins.
Expansion stops at the most labels and path parts any rule has: longer expressions fit no rule.

Cases: a null URL and one without ``://`` have empty host and path and fit no rule; only A-Z is
lower-cased; ports and user names count as part of the host; an empty path fits no rule; repeated
rows are judged one by one; an empty table gives an empty result; the columns that are
asked for are kept in the struct ``row``, whatever their names. A rule's path must start and end with ``/``. Of two rules
of the same text, block wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules with their digests; the table has a row a rule."""
    for host, path, verdict in rules:
        if not (path.startswith("/") and path.endswith("/")) or verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {host!r} {path!r} {verdict!r}")
    frame = spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")
    digest = F.sha2(F.concat("rule_host", "rule_path"), 256)
    return frame.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("rule_digest", digest).withColumn("rule_short", F.substring(digest, 1, 8))


def judge_urls(pages: DataFrame, keep: list[str], rules=RULES, default: str = "allow") -> DataFrame:
    """(row, host, path, rule, verdict) of each row of ``pages``, read from its column ``url``; ``row`` has the columns ``keep``."""
    known = rule_table(pages.sparkSession, rules)
    labels = max([h.count(".") + 1 for h, _, _ in rules], default=1)
    parts = max([p.count("/") for _, p, _ in rules], default=1)
    urls = (
        pages.select(F.struct(*keep).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumn("rid", F.monotonically_increasing_id())
    )
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in range(1, labels + 1)]))
    prefixes = F.array_distinct(F.array(*[F.concat(F.substring_index("path", "/", n), F.lit("/")) for n in range(1, parts + 1)]))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(prefixes, lambda p: F.col("path").startswith(p)), lambda p: F.concat(s, p))))
    expressed = urls.withColumn("expression", F.explode_outer(F.when(F.col("host") != "", pairs))).withColumn("digest", F.sha2("expression", 256))
    met = expressed.join(known, F.substring("digest", 1, 8) == F.col("rule_short"), "left")
    fits = F.col("digest") == F.col("rule_digest")
    rank = F.when(fits, F.struct(F.length("rule"), F.length("rule_host"), F.col("rule_verdict"), F.col("rule")))
    return (
        met.groupBy("rid")
        .agg(F.first("row").alias("row"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(rank).alias("best"))
        .select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"))
    )


ORACLE = r"""
WITH u AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS nth
  FROM p LEFT JOIN r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE nth = 1
"""
