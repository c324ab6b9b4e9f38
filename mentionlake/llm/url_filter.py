"""URL filters: host-suffix and path-prefix expressions joined with rules on short hash prefixes.

DataFrame functions only. Each URL is expanded into every combination of a host suffix and a path prefix that a rule could have: the
numbers of host labels and the lengths of paths come from the rules, so a URL of any length makes no more rows than the rules have such
pairs. Expressions meet rules by the first 32 bits of their SHA-256; the whole digest then confirms, and the longest rule wins.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the default verdict; so does any URL that no rule
fits. Equal rules with different verdicts: block wins. Repeated rows are returned as often as they came. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import ascii_lower, table

#: The rules of the op8 query as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SHORT = 8  # hexadecimal digits of the digest on which the join runs


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as a table of the plan itself; a rule's parts are literals."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rules) + " AS t(verdict, host, path)")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of pages."""
    rules = rules.select(
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.sha2(F.concat("host", "path"), 256).alias("rule_digest"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("prefix"),
    )
    # Two lists no longer than the deepest host and the longest path of a rule.
    shape = rules.agg(F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("prefix"))).first()
    labels, prefixes = (F.array(*map(F.lit, x)).cast("array<int>") for x in shape)
    host, path = host_and_path(F.col("url"))
    urls = (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
        .groupBy("id", "url")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("id", "copies", "url", host.alias("host"), path.alias("path"))
    )
    own = F.split("host", r"\.")
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(own)), lambda n: F.array_join(F.slice(own, F.size(own) - n + 1, n), "."))
    heads = F.transform(F.filter(prefixes, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))
    expanded = urls.withColumn("digest", F.explode_outer(F.transform(expressions, lambda e: F.sha2(e, 256))))
    met = expanded.withColumn("short", F.substring("digest", 1, SHORT)).join(
        rules.withColumn("short", F.substring("rule_digest", 1, SHORT)), "short", "left"
    )
    # Longest first; of two rules of the same length that with the longer host.
    fit = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule"), F.col("labels"), F.col("rule_verdict") == "block", "rule", "rule_verdict"))
    best = met.groupBy("id", "url", "copies", "host", "path").agg(F.max(fit).alias("best"))
    return best.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


ORACLE = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (SELECT page_id,
  coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
fits AS (SELECT s.page_id, s.host, s.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM split s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
