"""Registered queries of the dataset as it is published and read back, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionlake.functions import text as T
from mentionlake.operators import dataset as E
from mentionlake.operators import payload as P
from mentionlake.plans.catalogue import ORACLES, QUERIES, TARGETS, query
from mentionlake.plans.monitoring import NOW, RECORDS, records_of
from mentionlake.sources import adapters as L
from mentionlake.sources.settle import settled, shared_folder

__all__ = ["ORACLES", "QUERIES"]

#: What the SQL below starts with: the records of both datasets, each URL ranked over all stories, and what stays.
KEPT = RECORDS + """, placed AS (SELECT a.story_id, a.id, a.stamp, a.ai, CASE WHEN a.id % 17 = 0 THEN '' ELSE 'https://e/' || (a.id % 700) END AS u, s.temperature, coalesce(g.l, s.updated_at) AS last
  FROM a JOIN g USING (story_id) JOIN stories s ON s.id = a.story_id WHERE a.story_id % 3 <> 0 OR a.story_id % 2 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY coalesce(epoch_us(try_cast(last AS TIMESTAMPTZ)), 0) DESC, coalesce(temperature, 0) DESC, story_id, stamp DESC, id DESC) AS r FROM placed),
kept AS (SELECT story_id, string_agg(id, ',' ORDER BY stamp DESC, id DESC) AS articles, count(*) AS n, count(CASE WHEN ai THEN 1 END) AS k FROM ranked WHERE r = 1 OR u = '' GROUP BY story_id),
keyed AS (SELECT DISTINCT story_id, target_key, n, k FROM kept JOIN story_targets USING (story_id)),
counted AS (SELECT target_key AS key, CASE target_key WHEN 'A' THEN 'Alpha' WHEN 'N' THEN 'November' WHEN 'R' THEN 'Romeo' ELSE upper(target_key[1]) || lower(target_key[2:]) END AS label, target_key = 'A' AS "primary", count(*) AS "storyCount", sum(n)::BIGINT AS "articleCount" FROM keyed GROUP BY target_key) """


def read_back(spark, sf_dir) -> P.Dataset:
    """Two thirds of the stories, merged with those of an earlier dataset of every second story, published and read; URLs repeat across stories."""
    url = F.when(F.col("article_id") % 17 == 0, "").otherwise(F.concat(F.lit("https://e/"), (F.col("article_id") % 700).cast("string")))
    records = settled(records_of(spark, sf_dir, url))
    known = spark.createDataFrame([t[:3] for t in TARGETS], "key string, label string, primary boolean")
    earlier = spark.createDataFrame([("A", "Other", False), ("R", "Romeo", False)], known.schema)
    texts = spark.createDataFrame([], "key string, text string")
    made = P.merged(P.Dataset(records.where("storyIdInt % 3 <> 0"), texts, known), P.Dataset(records.where("storyIdInt % 2 = 0"), texts, earlier))
    path = shared_folder(spark)
    P.publish(made, path, generated_at=NOW, default="A")
    return P.published(spark, path, records)


@query(KEPT + "SELECT story_id AS story, articles, n AS n_articles, k AS ai, n - k AS raw FROM kept", logical=True)
def published_stories(spark, sf_dir):
    ids = F.array_join(F.transform("articles", lambda a: a["articleId"].cast("string")), ",")
    return read_back(spark, sf_dir).stories.select(F.col("storyIdInt").alias("story"), ids.alias("articles"), F.col("articleCount").alias("n_articles"), F.col("aiCount").alias("ai"), F.col("rawCount").alias("raw"))


@query(KEPT + "SELECT * FROM counted", logical=True)
def published_targets(spark, sf_dir):
    return read_back(spark, sf_dir).targets


@query(KEPT + """SELECT count(*) AS "totalStories", sum(n)::BIGINT AS "totalArticles", sum(k)::BIGINT AS "totalAi", sum(n - k)::BIGINT AS "totalRaw", count(CASE WHEN v THEN 1 END) AS "initialStoryCount", coalesce(sum(n) FILTER (v), 0)::BIGINT AS "initialArticleCount",
  coalesce(sum(k) FILTER (v), 0)::BIGINT AS "initialAiCount", coalesce(sum(n - k) FILTER (v), 0)::BIGINT AS "initialRawCount", 'Alpha' AS "defaultTargetLabel", (SELECT string_agg(key, ',' ORDER BY CASE key WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END, key) FROM counted) AS targets, 'A' AS "defaultTargets"
  FROM (SELECT *, EXISTS (SELECT 1 FROM keyed WHERE keyed.story_id = kept.story_id AND target_key = 'A') AS v FROM kept)""", logical=True)
def published_head(spark, sf_dir):
    head = read_back(spark, sf_dir).head
    totals = [F.col(f"meta.{c}") for c in ("totalStories", "totalArticles", "totalAi", "totalRaw", "initialStoryCount", "initialArticleCount", "initialAiCount", "initialRawCount", "defaultTargetLabel")]
    return head.select(*totals, F.array_join("targets.key", ",").alias("targets"), F.array_join("defaultTargets", ",").alias("defaultTargets"))


@query("""WITH s AS (SELECT doc_id, [x FOR x IN [trim(y, ' ') FOR y IN string_split(coalesce(text, ''), '.')] IF x <> ''] AS l FROM documents)
SELECT doc_id, md5(array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF list_position(l, l[i]) = i], '|')) AS sentences FROM s""")
def distinct_sentences(spark, sf_dir):
    """The sentences of each document, each once, in the order in which they are first seen."""
    sentences = F.split(F.coalesce("text", F.lit("")), r"\.")
    return L.read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.ordered_unique(sentences), "|")).alias("sentences"))


@query("SELECT coalesce(max(doc_id), 0) AS article FROM documents")
def last_article_number(spark, sf_dir):
    """The greatest number among the cards of an earlier snapshot, a page a document."""
    card = F.concat(F.lit('<article id="article-'), F.col("doc_id").cast("string"), F.lit('"><p>'), F.coalesce("text", F.lit("")), F.lit("</p></article>"))
    return E.last_article_in_page(L.read(spark, sf_dir, "documents").select(card.alias("html")))
