"""Candidates before they are stored: union of sources, dedup, limits, matching, and the ladder of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.functions import text as T
from mentionlake.functions import url as U
from mentionlake.functions.dates import within


def first_by(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in the order given; rows with an empty or null key go."""
    keyed = rows.withColumn("_key", key).where(F.coalesce(F.col("_key"), F.lit("")) != "")
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))
    return ranked.where("_rank = 1").drop("_key", "_rank")


def dedup_by_canonical_url(rows: DataFrame, *order: str) -> DataFrame:
    """Keeps the first candidate of each canonical URL, and writes that URL into it."""
    return first_by(rows, U.canonical(F.col("url")), *order).withColumn("url", U.canonical(F.col("url")))


def limit_per(rows: DataFrame, group: str, n: int, *order: str) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def interleave(rows: DataFrame, batch: str, *order: str) -> DataFrame:
    """rows with their place in their batch: sorted by place and batch they are the first of each batch, then the second of each, and so on."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(batch).orderBy(*order)).cast("long"))


def keyword_map(targets: DataFrame) -> DataFrame:
    """(keyword, key, name, ord): one row for each keyword in lower case; a later target takes a keyword over but not its place."""
    words = targets.select("key", "name", "ord", F.posexplode("keywords").alias("pos", "keyword")).withColumn("low", F.lower("keyword"))
    place = Window.partitionBy("low").orderBy("ord", "pos")
    last = Window.partitionBy("low").orderBy(F.desc("ord"), F.desc("pos"))
    return words.withColumn("place", F.first(F.struct("ord", "pos")).over(place)).withColumn("r", F.row_number().over(last)).where("r = 1").select("low", "keyword", "key", "name", "place")


def keyword_hits(texts: DataFrame, keywords: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """A row for each keyword found in each text: its target and the place of its first occurrence, from 0. Keywords are configuration, so they go into the plan as literals."""
    hit = lambda k, key, word: F.struct(F.lit(k).alias("ord"), F.lit(key).alias("target_key"), F.lit(word).alias("keyword"), (F.locate(word.lower(), F.lower(text)) - 1).alias("position"))
    hits = F.filter(F.array(*(hit(k, key, word) for k, (key, word) in enumerate(keywords))), lambda h: h["position"] >= 0)
    return texts.withColumn("hit", F.explode(hits)).select(*[c for c in texts.columns if c != text], "hit.*")


def first_hit_per_target(hits: DataFrame, article: str) -> DataFrame:
    best = hits.groupBy(article, "target_key").agg(F.min_by(F.struct("keyword", "position"), "ord").alias("hit"))
    return best.select(article, "target_key", "hit.keyword", "hit.position")


def decide(candidates: DataFrame, *, date_from: str = "", date_to: str = "", floor: str = "", terms: list[str] | None = None, mode: str = "any") -> DataFrame:
    """Status, reason and stage of each candidate: the first rule that fails wins.

    Columns: url, title, summary, published_at, body, n_hits, n_preview_hits, stored (whether the URL is known), fetch_error (null if none),
    needs_date and exact_body (flags). Nothing is dropped; there is one decision for each row.
    """
    full = F.concat_ws(" ", "title", "summary", "body")
    empty = F.coalesce(F.col("published_at"), F.lit("")) == ""
    inside = within(F.col("published_at"), date_from, date_to, floor)
    rules = [
        (~F.col("needs_date") & ~inside, "skipped", F.lit("outside_date_window"), "date_filter"),
        (F.col("fetch_error").isNotNull(), "skipped", F.concat(F.lit("fetch_fail:"), "fetch_error"), "fetch"),
        (F.col("needs_date") & empty, "skipped", F.lit("missing_published_at"), "date_extraction"),
        (F.col("n_hits") == 0, "skipped", F.lit("no_match_exact_name"), "exact_match"),
        (F.col("exact_body") & (F.trim(F.coalesce("body", F.lit(""))) == ""), "skipped", F.lit("missing_body"), "body_fetch"),
        (~T.passes_terms(full, terms or [], mode), "skipped", F.lit("forced_terms_not_matched"), "forced_terms"),
        (~inside, "skipped", F.lit("outside_date_window"), "date_filter"),
        (T.bad_quality(F.col("title"), F.col("summary"), F.col("url"), F.col("n_preview_hits") > 0), "skipped", F.lit("low_article_quality"), "quality_filter"),
        (F.col("stored"), "duplicate", F.lit("already_in_database"), "stored"),
    ]
    decision = F.struct(F.lit("selected").alias("status"), F.lit("saved").alias("reason"), F.lit("stored").alias("stage"))
    for rule, status, reason, stage in reversed(rules):
        decision = F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(status).alias("status"), reason.alias("reason"), F.lit(stage).alias("stage"))).otherwise(decision)
    return candidates.withColumn("decision", decision).select(*candidates.columns, "decision.*")


def skip_histogram(decisions: DataFrame) -> DataFrame:
    return decisions.where("status = 'skipped'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def source_counters(decisions: DataFrame, source: str) -> DataFrame:
    n = lambda status: F.sum((F.col("status") == status).cast("long"))
    return decisions.groupBy(source).agg(F.count(F.lit(1)).alias("seen"), n("selected").alias("inserted"), n("duplicate").alias("duplicates"), n("skipped").alias("skipped"))
