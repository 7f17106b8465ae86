"""URL rules: host suffixes and path prefixes, met on short hash prefixes.

Every url is expanded into the (host suffix, path prefix) expressions that a rule
could name.  Expressions and rules meet in an equi-join on the first bytes of
their digest; the whole digest confirms the meeting, the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's rules: host and path as one string, split at the first slash.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
PREFIX_HEX = 8
DEFAULT = "allow"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(url.isNotNull() & (at > 0), F.expr("substring(__url, locate('://', __url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """rule, verdict, digest and lengths; of equal rules with both verdicts block wins."""
    rows = [(r, r.split("/", 1)[0], "/" + r.split("/", 1)[1] if "/" in r else "", v) for r, v in rules]
    df = spark.createDataFrame(rows, "rule string, host string, path string, verdict string")
    return (df.groupBy("rule", "host", "path").agg(F.max("verdict").alias("verdict"))
            .withColumn("__digest", F.sha2(F.concat_ws("\n", "host", "path"), 256))
            .withColumn("__prefix", F.substring("__digest", 1, PREFIX_HEX)))


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest rule wins, then block.  Without a rule the verdict is allow and
    the rule null.  Null, empty and malformed urls have empty host and path; null and
    repeated keys pass through; other columns are ignored.  ``rules`` is a
    parameter list; path prefixes are cut at the lengths that rules have.
    """
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    lengths = sorted({len("/" + r.split("/", 1)[1]) if "/" in r else 0 for r, _ in rules})
    seen = pages.select(F.col(key).alias("page_id"), F.col(url).alias("__url"))
    host, path = parts(F.col("__url"))
    seen = seen.select("page_id", host.alias("host"), path.alias("path"))
    # One expansion per different address: a hot host or page costs one row per task after partial aggregation.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(cuts, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    spelled = (seen.select("host", "path").distinct()
               .select("host", "path", F.explode(suffixes).alias("__host"), prefixes.alias("__paths"))
               .select("host", "path", "__host", F.explode("__paths").alias("__path"))
               .withColumn("__whole", F.sha2(F.concat_ws("\n", "__host", "__path"), 256))
               .withColumn("__prefix", F.substring("__whole", 1, PREFIX_HEX)))
    met = spelled.join(table.select("__prefix", "__digest", "rule", "verdict"), "__prefix").where("__whole = __digest")
    best = (met.groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("n"), F.col("verdict").alias("v"), F.col("rule").alias("r"))).alias("__best"))
            .select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("__best.r").alias("rule"),
                    F.col("__best.v").alias("verdict")))
    out = seen.join(best, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"))


ORACLE_SQL = r"""
WITH rules(rule, host, path, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, row_number() OVER () AS k,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
met AS (SELECT s.k, r.rule, r.verdict, row_number() OVER (PARTITION BY s.k ORDER BY length(r.rule) DESC, r.verdict DESC) AS n
  FROM seen s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM seen s LEFT JOIN met m ON m.k = s.k AND m.n = 1
"""
