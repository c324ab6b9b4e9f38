"""Recall against gold lists: set operations on URLs, sampling, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.functions.url import host_of, without_query


def recall(gold: DataFrame, found: DataFrame, key: str, group: str) -> DataFrame:
    """Of each group: how many distinct keys are wanted, found and missed."""
    hit = found.select(F.col(key).alias("k")).distinct().withColumn("hit", F.lit(1))
    joined = gold.select(group, key).distinct().join(hit, F.col(key) == F.col("k"), "left")
    return joined.groupBy(group).agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found"), (F.count(F.lit(1)) - F.count("hit")).alias("missed"))


def verdict(found: Column, expected: Column) -> Column:
    return F.when(expected == 0, "SKIP").when(found == expected, "PASS").when(found > 0, "PARTIAL").otherwise("FAIL")


def qualified(rows: DataFrame, *group: str, least: int = 5) -> DataFrame:
    """Groups with enough rows, the largest first."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), *group)


def spread_samples(rows: DataFrame, group: str, *order: str, n: int = 5) -> DataFrame:
    """n rows of each group, evenly spaced in its order: numbers int(i * (count - 1) / (n - 1)); all rows of smaller groups."""
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).withColumn("count", F.count(F.lit(1)).over(Window.partitionBy(group)))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("count") - 1) / (n - 1)).cast("int"))
    return numbered.where((F.col("count") <= n) | F.array_contains(picks, F.col("i"))).drop("i", "count")


def padded_days(days: DataFrame, start: str, end: str, padding: int) -> DataFrame:
    """Distinct days (day) with their neighbours, inside the window."""
    around = days.select(F.explode(F.sequence(F.date_sub("day", padding), F.date_add("day", padding), F.expr("interval 1 day"))).alias("day"))
    return around.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).distinct()


def saved_urls(articles: DataFrame, mentions: DataFrame, target: str, host: str = "") -> DataFrame:
    """The distinct URLs (url), without their queries, of articles that mention a target, on a host or on any."""
    named = articles.join(mentions.where(F.col("target_key") == target).select("article_id"), articles["id"] == mentions["article_id"], "left_semi")
    urls = named.select(without_query(F.col("url")).alias("url")).distinct()
    return urls.where(host_of(F.col("url")) == host.lower().removeprefix("www.")) if host else urls


def retained_texts(raw_texts: DataFrame, articles: DataFrame) -> DataFrame:
    """The raw texts (article_id, ...) of articles (article_id) that are kept."""
    return raw_texts.join(articles.select("article_id"), "article_id", "left_semi")
