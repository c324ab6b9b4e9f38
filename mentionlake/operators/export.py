"""The dashboard dataset: stories in scope, targets, totals, merging of snapshots, and URL dedup across stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.operators.articles import ai_flags


def decorate(stories: DataFrame, story_articles: DataFrame, articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """Stories with the first and last date and the numbers of their articles, of summarised and of raw ones; those without articles in scope go."""
    ai = ai_flags(mentions).withColumnRenamed("article_id", "m")
    rows = story_articles.join(articles.select("id", F.nullif("published_at", F.lit("")).alias("at")), F.col("article_id") == F.col("id")).drop("id").join(ai, F.col("article_id") == F.col("m"), "left")
    counts = rows.groupBy("story_id").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("article_count"), F.sum(F.coalesce("ai", F.lit(0))).cast("long").alias("ai_count"))
    joined = stories.join(counts, stories["id"] == counts["story_id"])
    return joined.select(
        "id", "title", "temperature", F.coalesce("first", "created_at").alias("first_published_at"), F.coalesce("last", "updated_at").alias("last_published_at"),
        "article_count", "ai_count", (F.col("article_count") - F.col("ai_count")).alias("raw_count"),
    )


def target_rows(decorated: DataFrame, story_targets: DataFrame, targets: DataFrame) -> DataFrame:
    """Stories and articles of each target. Known targets come first, in their order; others by key, with a label made of it; those without stories go."""
    joined = story_targets.join(decorated.select(F.col("id").alias("story_id"), "article_count"), "story_id")
    counts = joined.groupBy("target_key").agg(F.count(F.lit(1)).alias("story_count"), F.sum("article_count").alias("article_count"))
    known = counts.join(targets, counts["target_key"] == targets["key"], "left")
    label = F.coalesce("label", F.initcap(F.replace("target_key", F.lit("_"), F.lit(" "))))
    return known.select("target_key", label.alias("label"), F.coalesce("primary", F.lit(False)).alias("primary"), "story_count", "article_count", F.coalesce("ord", F.lit(1 << 30)).alias("ord")).orderBy("ord", "target_key").drop("ord")


def visible(keys: Column, selected: list[str], without_keys: bool = False) -> Column:
    """Whether a story shows under a selection. Stories without targets show in the browser, not in the totals."""
    if not selected:
        return F.lit(True)
    hit = F.arrays_overlap(keys, F.array(*map(F.lit, selected)))
    return hit | (F.size(keys) == 0) if without_keys else hit


def totals(decorated: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return decorated.agg(F.count(F.lit(1)).alias("stories"), n("article_count").alias("articles"), n("ai_count").alias("ai"), n("raw_count").alias("raw"))


def with_targets(decorated: DataFrame, story_targets: DataFrame) -> DataFrame:
    keys = story_targets.groupBy("story_id").agg(F.array_sort(F.collect_set("target_key")).alias("keys"))
    return decorated.join(keys, decorated["id"] == keys["story_id"], "left").drop("story_id").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


def dedup_story_urls(rows: DataFrame) -> DataFrame:
    """rows (story_id, article_id, url, last_published_at, temperature, ai): a URL stays in the first story only, by last date and temperature; empty URLs all stay. Counts are made anew, stories left empty go."""
    order = Window.partitionBy("url").orderBy(F.desc("last_published_at"), F.desc("temperature"), "story_id", "article_id")
    named = rows.where("url <> ''").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    kept = named.unionByName(rows.where("coalesce(url, '') = ''"))
    return kept.groupBy("story_id").agg(F.count(F.lit(1)).alias("article_count"), F.sum("ai").cast("long").alias("ai_count"), F.sum(1 - F.col("ai")).cast("long").alias("raw_count"))


def merge(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """New stories, and the old ones whose id no new story has."""
    return new.unionByName(old.join(new.select(id_col), id_col, "left_anti"))


def remap(rows: DataFrame, taken: DataFrame, id_col: str = "id") -> DataFrame:
    """rows with ids moved behind the greatest id taken."""
    offset = taken.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("offset"))
    return rows.crossJoin(F.broadcast(offset)).withColumn(id_col, F.col(id_col) + F.col("offset")).drop("offset")  # one row


def dataset_json(decorated: DataFrame) -> DataFrame:
    """Each story as a JSON line, the shape that the dashboard loads."""
    return decorated.select(F.to_json(F.struct(*decorated.columns)).alias("value"))


def summary_payload(ai: Column, summary: Column, full_text: Column, preview: int = 560) -> Column:
    """(label, preview, source) of an article: the summariser's text as it is, else an excerpt of the text, else a placeholder."""
    text = F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.nullif(F.trim(full_text), F.lit("")))
    cut = F.when(F.length(text) > preview, F.concat(F.rtrim(F.left(text, F.lit(preview - 1))), F.lit("..."))).otherwise(text)
    make = lambda label, shown, source: F.struct(F.lit(label).alias("label"), shown.alias("preview"), F.lit(source).alias("source"))
    return F.when(ai & text.isNotNull(), make("AI summary", text, "llm")).when(text.isNotNull(), make("Raw text", cut, "raw")).otherwise(make("No text", F.lit(""), "raw"))


def report(rows: DataFrame) -> DataFrame:
    """rows with every list, map and struct as JSON text, ready for a CSV report."""
    nested = ("array", "map", "struct")
    return rows.select(*(F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in rows.dtypes))


def write_report(rows: DataFrame, path: str) -> None:
    """The report as JSON lines and as CSV."""
    rows.write.mode("overwrite").json(f"{path}/json")
    report(rows).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def locale_key(text: Column, locale: str = "pt") -> Column:
    """Text that sorts and groups as the locale has it (a collation)."""
    return F.collate(text, locale)
