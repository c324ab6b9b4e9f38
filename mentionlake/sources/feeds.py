"""Readers of captured feeds: RSS and Atom, sitemaps, posts and search results in JSON. Each gives candidate rows.

Files are read by Spark's XML and JSON sources, a row for each item, so many large captures are read in parallel. Fetching over the network is
not part of this library; captures are its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.functions.dates import parsed, within
from mentionlake.functions.html import hrefs, html_to_text
from mentionlake.functions.url import canonical, is_news_link, news_target
from mentionlake.operators.candidates import dedup_by_canonical_url, interleave, limit_per

POSTS = "link string, title struct<rendered string>, excerpt struct<rendered string>, date_gmt string, date string"
HITS = "result struct<hits struct<hits array<struct<_source struct<url string, title string, issued string, description string, body string>>>>>"


def _candidates(rows: DataFrame, source: str, kind: str, title: Column, url: Column, date: Column, snippet: Column) -> DataFrame:
    """Rows of the candidate model; those without a URL go."""
    made = rows.select(
        F.trim(F.coalesce(title, F.lit(""))).alias("title"), F.trim(F.coalesce(url, F.lit(""))).alias("url"), F.lit(source).alias("source_name"),
        F.lit(kind).alias("source_type"), F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), html_to_text(snippet).alias("snippet"),
    )
    return made.where("url <> ''")


def rss(spark: SparkSession, path: str, source: str, as_of: str) -> DataFrame:
    """Items of RSS files; a date that can't be read becomes as_of."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    return _candidates(rows, source, "rss", F.col("title"), F.col("link"), F.coalesce(parsed(F.col("pubDate")), F.to_timestamp(F.lit(as_of))), F.col("description"))


def atom(spark: SparkSession, path: str, source: str, as_of: str) -> DataFrame:
    """Entries of Atom files: the summary or else the content, the update or else the publication."""
    schema = "title string, link struct<_href string>, summary string, content string, updated string, published string"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    date = F.coalesce(parsed(F.col("updated")), parsed(F.col("published")), F.to_timestamp(F.lit(as_of)))
    return _candidates(rows, source, "rss", F.col("title"), F.col("link._href"), date, F.coalesce("summary", "content"))


def sitemap(spark: SparkSession, path: str, source: str) -> DataFrame:
    """URLs of sitemap files, whatever the namespaces: the first location, the publication date or else the last change."""
    schema = "loc string, lastmod string, news struct<title string, publication_date string>"
    rows = spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", True).schema(schema).load(path)
    return _candidates(rows, source, "sitemap", F.col("news.title"), F.col("loc"), F.coalesce(parsed(F.col("news.publication_date")), parsed(F.col("lastmod"))), F.lit(""))


def posts(spark: SparkSession, path: str, source: str, as_of: str) -> DataFrame:
    """Posts of a REST API's JSON pages."""
    rows = spark.read.schema(POSTS).option("multiLine", True).json(path)
    date = F.coalesce(parsed(F.concat("date_gmt", F.lit("Z"))), parsed(F.col("date")), F.to_timestamp(F.lit(as_of)))
    return _candidates(rows, source, "posts", html_to_text(F.col("title.rendered")), F.col("link"), date, F.col("excerpt.rendered"))


def search_hits(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Hits of a search API's JSON pages: the description or else the start of the body."""
    rows = spark.read.schema(HITS).option("multiLine", True).json(path).select(F.explode("result.hits.hits._source").alias("s"))
    return _candidates(rows, source, "internal_search", F.col("s.title"), F.col("s.url"), parsed(F.col("s.issued")), F.coalesce("s.description", F.left("s.body", F.lit(500))))


def targets(spark: SparkSession, path: str) -> DataFrame:
    """Monitored entities: key (made from the label if missing), label, primary, priority, and keywords with the label first."""
    from mentionlake.functions.text import slug_key

    rows = spark.read.schema("key string, label string, primary boolean, keywords array<string>").option("multiLine", True).json(path).where("label is not null")
    first = F.coalesce("primary", F.lit(False))
    return rows.select(F.coalesce("key", slug_key(F.col("label"))).alias("key"), "label", first.alias("primary"), F.when(first, 1).otherwise(2).alias("priority"), F.array_distinct(F.concat(F.array("label"), F.coalesce("keywords", F.array().cast("array<string>")))).alias("keywords"))


def collected(rows: DataFrame, feed: str, *order: str, limit: int, date_from: str = "", date_to: str = "") -> DataFrame:
    """What a collector returns of its captures: the candidates inside the window, so many of each feed."""
    return limit_per(rows.where(within(F.col("published_at"), date_from, date_to)), feed, max(1, limit), *order)


def news(rows: DataFrame, query: str, *order: str, limit: int, date_from: str = "", date_to: str = "") -> DataFrame:
    """Candidates of news searches (url, html snippet, ...): under the URL of the article itself where it is known, the first of each search in turn, each URL once. Links that still lead to the aggregator are marked for fetching."""
    direct = rows.withColumn("url", canonical(news_target(F.col("url"), hrefs(F.col("snippet")))))
    turned = interleave(collected(direct, query, *order, limit=limit, date_from=date_from, date_to=date_to), query, *order)
    return dedup_by_canonical_url(turned, "place", query).withColumn("force_full_fetch", is_news_link(F.col("url")))


def route(source: str, domain: str, routes: dict[str, list[str]], families: dict[str, str]) -> list[str]:
    """The collectors that serve a source: those of its domain, else those of its kind (a part of its name), else its feed."""
    kind = next((k for part, k in families.items() if part in source.lower()), None)
    return routes.get(domain) or ([kind] if kind else ["rss"])
