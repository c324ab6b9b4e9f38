"""The read API over articles, mentions and stories."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlake.sources.adapters import AI_REASONS


def effective_date(mode: str = "sql") -> Column:
    """The date that lists are filtered and sorted by. In the mode `sql` an empty published date counts as a date; in `python` it doesn't."""
    published = F.col("published_at") if mode == "sql" else F.nullif("published_at", F.lit(""))
    return F.coalesce(published, "discovered_at")


def summarised(reason: Column) -> Column:
    return F.coalesce(reason, F.lit("")).isin(*AI_REASONS)


def mention_sets(mentions: DataFrame) -> DataFrame:
    """One row an article: its targets, names and keywords as sorted lists, an AI flag, the least and the first sentiment."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return mentions.groupBy("article_id").agg(
        listed("target_key").alias("target_keys"),
        listed("target_name").alias("target_names"),
        listed("keyword_matched").alias("keywords"),
        F.max(summarised(F.col("sentiment_reason")).cast("int")).alias("has_ai_summary"),
        F.min("sentiment").alias("min_sentiment"),
        F.min_by("sentiment", "id").alias("first_sentiment"),
        F.count(F.lit(1)).alias("n_mentions"),
    )


def ai_flags(mentions: DataFrame) -> DataFrame:
    """(article_id, ai): whether a summariser has handled some mention of an article, 1 or 0."""
    return mentions.groupBy("article_id").agg(F.max(summarised(F.col("sentiment_reason")).cast("int")).alias("ai"))


def article_filter(articles: DataFrame, mentions: DataFrame, *, date_from: str = "", date_to: str = "", target_keys: list[str] | None = None, only_pending: bool = False) -> DataFrame:
    """Articles that meet all conditions given: text comparison of dates, some mention of a target, some mention that isn't summarised yet."""
    conditions = [F.lit(True)]
    if date_from:
        conditions.append(effective_date() >= date_from)
    if date_to:
        conditions.append(effective_date() <= date_to)
    kept = articles.where(reduce(and_, conditions))
    if target_keys:
        named = mentions.where(F.col("target_key").isin(*target_keys)).select("article_id")
        kept = kept.join(named, kept["id"] == named["article_id"], "left_semi")
    if only_pending:
        pending = mentions.where(~summarised(F.col("sentiment_reason"))).select("article_id")
        kept = kept.join(pending, kept["id"] == pending["article_id"], "left_semi")
    return kept


def export_articles(articles: DataFrame, mentions: DataFrame, story_articles: DataFrame, *, limit: int = 5000, **conditions) -> DataFrame:
    """Articles with mentions, newest first: lists cover all mentions of an article, whatever it was selected by."""
    kept = article_filter(articles, mentions, **conditions)
    top = newest(kept.join(mentions.select("article_id"), kept["id"] == mentions["article_id"], "left_semi"), limit)
    sets = sets_of(mentions, top).drop("n_mentions")
    joined = top.join(sets, top["id"] == sets["article_id"]).drop("article_id").join(story_articles, F.col("id") == F.col("article_id"), "left")
    return joined.orderBy(effective_date().desc(), F.col("id")).select("id", "url", "title", "source_name", "source_type", "published_at", "discovered_at", "story_id", "target_keys", "target_names", "keywords", "has_ai_summary")


def sets_of(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """The mention sets of some articles (id); mentions of others are not aggregated."""
    return mention_sets(mentions.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi"))


def newest(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(effective_date().desc(), F.col("id")).limit(max(1, limit))


def list_articles(articles: DataFrame, mentions: DataFrame, story_articles: DataFrame, *, limit: int = 300) -> DataFrame:
    """Articles with or without mentions, newest first, in the shape that the dashboard reads."""
    top = newest(articles, limit)
    sets = sets_of(mentions, top)
    joined = top.join(sets, top["id"] == sets["article_id"], "left").drop("article_id").join(story_articles, F.col("id") == F.col("article_id"), "left")
    return joined.select(
        F.concat(F.lit("a-"), F.col("id").cast("string")).alias("article_id"),
        F.when(F.col("story_id").isNotNull(), F.concat(F.lit("st-"), F.col("story_id").cast("string"))).otherwise("").alias("story_id"),
        "title",
        "url",
        "source_name",
        "source_type",
        effective_date("python").alias("published_at"),
        F.coalesce("target_keys", F.lit("")).alias("target_keys"),
        F.coalesce("target_names", F.lit("")).alias("target_names"),
        F.coalesce("keywords", F.lit("")).alias("keywords"),
        F.coalesce("first_sentiment", F.lit("neutral")).alias("sentiment"),
        F.when(F.coalesce("has_ai_summary", F.lit(0)) == 1, "llm").otherwise("raw").alias("summary_source"),
        F.coalesce("n_mentions", F.lit(0)).cast("long").alias("n_mentions"),
    )


def articles_by_ids(articles: DataFrame, mentions: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles with mentions whose id is among ids (id); ids that aren't positive are left out."""
    wanted = articles.join(ids.where("id > 0").select("id").distinct(), "id", "left_semi")
    sets = sets_of(mentions, wanted)
    return wanted.join(sets, wanted["id"] == sets["article_id"]).select("id", "url", "title", "source_name", "published_at", "target_keys", "target_names", "keywords", "has_ai_summary")


def recent_stories(stories: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Stories updated in the last days, by whole dates, hottest first."""
    return stories.where(F.to_date(F.left("updated_at", F.lit(10))) >= F.date_sub(F.to_date(F.lit(as_of)), days)).orderBy(F.desc("temperature"), F.desc("updated_at"), "id")


def story_context(stories: DataFrame, story_articles: DataFrame, story_targets: DataFrame, *, as_of: str, days: int = 365, limit: int = 160, fan_out: bool = True) -> DataFrame:
    """Stories with their number of articles and targets. With fan_out the number is of articles times targets, as a plain double join counts; without, of articles."""
    since = stories.where(F.to_date(F.left("updated_at", F.lit(10))) >= F.date_sub(F.to_date(F.lit(as_of)), max(1, days)))
    counts = story_articles.groupBy("story_id").agg(F.count("article_id").alias("articles"))
    keys = story_targets.groupBy("story_id").agg(F.array_join(F.array_sort(F.collect_set("target_key")), ",").alias("target_keys"), F.countDistinct("target_key").alias("targets"))
    joined = since.join(counts, since["id"] == counts["story_id"], "left").drop("story_id").join(keys, F.col("id") == F.col("story_id"), "left").drop("story_id")
    n = F.coalesce("articles", F.lit(0)) * (F.greatest(F.coalesce("targets", F.lit(1)), F.lit(1)) if fan_out else F.lit(1))
    top = joined.orderBy(F.desc("updated_at"), F.desc("temperature"), "id").limit(max(1, limit))
    return top.select("id", "title", "temperature", "updated_at", n.cast("long").alias("article_count"), F.coalesce("target_keys", F.lit("")).alias("target_keys"))


def story_temperature(article_count: Column, unique_sources: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 22.0 + 9.0 * article_count + 6.0 * unique_sources))


def story_stats(story_articles: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles, distinct sources and temperature of each story."""
    joined = story_articles.join(articles, story_articles["article_id"] == articles["id"])
    counted = joined.groupBy("story_id").agg(F.count("article_id").alias("articles"), F.countDistinct("source_name").alias("sources"))
    return counted.withColumn("temperature", story_temperature(F.col("articles"), F.col("sources")))


def story_nested(stories: DataFrame, story_articles: DataFrame, articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """Stories with their articles as an array, newest first. Stories without articles are left out."""
    sets = mention_sets(mentions).select(F.col("article_id").alias("m"), "min_sentiment", "has_ai_summary")
    rows = story_articles.join(articles, story_articles["article_id"] == articles["id"]).join(sets, F.col("id") == F.col("m"), "left")
    item = F.struct(effective_date("python").alias("at"), F.col("id").alias("article_id"), "url", "title", F.coalesce("min_sentiment", F.lit("neutral")).alias("sentiment"), F.coalesce("has_ai_summary", F.lit(0)).alias("has_ai"))
    nested = rows.groupBy("story_id").agg(F.sort_array(F.collect_list(item), asc=False).alias("articles"))
    return stories.join(nested, stories["id"] == nested["story_id"]).drop("story_id")
