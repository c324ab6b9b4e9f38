"""The logical tables of the monitoring model, derived from the star-schema tables of the test data.

Articles come from orders, mentions from line items, stories from customers. Timestamps are ISO-8601 text as in the model; a published date may be
null or empty. A mention's id is its article's id times 1000 plus its place in the article, so it needs no numbering of the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Marks of mentions that a summariser has handled.
AI_REASONS = ("agent_summary", "model_summary")
ISO = "yyyy-MM-dd'T'HH:mm:ss"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, ISO), F.lit("+00:00"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    published = F.when(key % 11 == 0, F.lit(None).cast("string")).when(key % 13 == 0, F.lit("")).otherwise(iso(day))
    return read(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.concat(F.lit("https://h"), (F.col("o_custkey") % 7).cast("string"), F.lit(".example/"), key.cast("string")).alias("url"),
        F.concat_ws(" ", "o_orderpriority", key.cast("string")).alias("title"),
        F.col("o_orderpriority").alias("source_name"),
        F.col("o_orderstatus").alias("source_type"),
        published.alias("published_at"),
        iso(day + F.expr("interval 1 day")).alias("discovered_at"),
        F.col("o_custkey").alias("story_key"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    d = F.col("l_discount")
    ladder = F.when(d <= 0.01, "very_negative").when(d <= 0.03, "negative").when(d <= 0.06, "neutral").when(d <= 0.08, "positive").otherwise("very_positive")
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 1000 + F.row_number().over(order)).alias("id"),
        F.col("l_orderkey").alias("article_id"),
        F.col("l_returnflag").alias("target_key"),
        F.concat(F.lit("Target "), "l_returnflag").alias("target_name"),
        F.col("l_linestatus").alias("keyword_matched"),
        ladder.alias("sentiment"),
        F.when(F.col("l_tax") >= 0.06, "agent_summary").otherwise("").alias("sentiment_reason"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders; a story is updated when its last article comes."""
    span = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(iso(F.min("o_orderdate")).alias("created_at"), iso(F.max("o_orderdate")).alias("updated_at"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("summary"), (F.floor(F.col("c_acctbal") / 100) + 10).cast("double").alias("temperature"))
    return customers.join(span, "id")


def story_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("story_id"), F.col("o_orderkey").alias("article_id"))


def story_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = story_articles(spark, sf_dir).join(mentions(spark, sf_dir).select("article_id", "target_key"), "article_id")
    return edges.select("story_id", "target_key").distinct()


#: The same tables for DuckDB, as common table expressions.
LOGICAL = """
articles AS (SELECT o_orderkey AS id, 'https://h' || (o_custkey % 7) || '.example/' || o_orderkey AS url, o_orderpriority || ' ' || o_orderkey AS title,
  o_orderpriority AS source_name, o_orderstatus AS source_type,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS published_at,
  strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS discovered_at, o_custkey AS story_key FROM orders),
mentions AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS id,
  l_orderkey AS article_id, l_returnflag AS target_key, 'Target ' || l_returnflag AS target_name, l_linestatus AS keyword_matched,
  CASE WHEN l_discount <= 0.01 THEN 'very_negative' WHEN l_discount <= 0.03 THEN 'negative' WHEN l_discount <= 0.06 THEN 'neutral' WHEN l_discount <= 0.08 THEN 'positive' ELSE 'very_positive' END AS sentiment,
  CASE WHEN l_tax >= 0.06 THEN 'agent_summary' ELSE '' END AS sentiment_reason FROM lineitem),
spans AS (SELECT o_custkey AS id, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS updated_at FROM orders GROUP BY 1),
stories AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS summary, (floor(c_acctbal / 100) + 10)::DOUBLE AS temperature, created_at, updated_at FROM customer JOIN spans ON c_custkey = spans.id),
story_articles AS (SELECT o_custkey AS story_id, o_orderkey AS article_id FROM orders),
story_targets AS (SELECT DISTINCT story_id, target_key FROM story_articles JOIN mentions USING (article_id))
"""
