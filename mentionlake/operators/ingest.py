"""Ingestion as one plan: which candidates of all collectors are looked at, what is decided on them, and the rows that are then stored."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from mentionlake.functions import text as T
from mentionlake.operators import candidates as C
from mentionlake.sources.settle import settled

NEW_STORY, NEW_TITLE = 34.0, "Nova historia"


def planned(plans: list[tuple[str, str, DataFrame, bool]]) -> DataFrame:
    """All candidates (url, pos, ...) of the collectors (source, kind, candidates, later), in the order of plan and pos.

    A later collector adds only what no collector before it, nor it itself, has planned: of its candidates those stay that are the first with their
    URL among all. Those of other collectors all stay.
    """
    parts = [p.withColumn("plan_source", F.lit(s)).withColumn("plan_kind", F.lit(k)).withColumn("plan", F.lit(i)).withColumn("_later", F.lit(later)) for i, (s, k, p, later) in enumerate(plans)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    first = rows.where("coalesce(url, '') <> ''").groupBy("url").agg(F.min(F.struct("plan", "pos")).alias("_first")).withColumnRenamed("url", "_url")
    joined = rows.join(first, F.col("url") == F.col("_url"), "left")
    kept = joined.where(~F.col("_later") | (F.col("_first") == F.struct("plan", "pos")))
    return kept.drop("_later", "_first", "_url")


def until_older(rows: DataFrame, group: str, page: str, date: str, floor: Column) -> DataFrame:
    """The pages of each group up to the first one whose dated rows are all older than the floor; a page without dates ends nothing."""
    pages = rows.groupBy(group, page).agg(F.count(date).alias("dated"), F.count(F.when(F.col(date) < floor, 1)).alias("older"))
    last = pages.where("dated > 0 and older = dated").groupBy(F.col(group).alias("_group")).agg(F.min(page).alias("_last"))
    return rows.join(last, F.col(group).eqNullSafe(F.col("_group")), "left").where(F.col("_last").isNull() | (F.col(page) <= F.col("_last"))).drop("_group", "_last")


def select_targets(targets: list[dict], keys: list[str] | None) -> list[dict]:
    """The targets asked for, in that order; all of them if none is. Unknown keys are an error."""
    wanted = list(dict.fromkeys(k.strip() for k in map(str, keys or []) if k.strip()))
    by_key = {t["key"]: t for t in targets}
    if missing := [k for k in wanted if k not in by_key]:
        raise ValueError(f"unknown_target_keys:{','.join(missing)}")
    return [by_key[k] for k in wanted] if wanted else list(targets)


def search_terms(target: dict, *, variants: dict[str, list[str]] | None = None, site: dict | None = None) -> list[str]:
    """What is searched for a target on a site: the site's own terms, or else the target's spellings, or else its name."""
    terms = (site or {}).get("query_variants") or (variants or {}).get(target["key"]) or [target.get("name") or ""]
    return list(dict.fromkeys(str(t).strip() for t in terms if str(t).strip()))


def news_terms(target: dict, *, variants: dict[str, list[str]] | None = None, extra: str = "", hosts: dict[str, list[str]] | None = None) -> list[str]:
    """Quoted terms for a news search; for targets with several spellings also with a word added, and once for each known host."""
    names = search_terms(target, variants=variants)
    terms = [f'"{n}"' for n in names]
    if len(names) > 1 and extra:
        terms += [f'"{n}" {extra}' for n in names]
    return terms + [f'site:{h} "{n}"' for h in (hosts or {}).get(target["key"], []) for n in names]


def scrape_terms(target: dict, *, variants: dict[str, list[str]] | None = None, most: int = 3) -> list[str]:
    """The spellings of a target, or else its first keywords, or else its name."""
    own = (variants or {}).get(target["key"]) or target.get("keywords", [])[:most] or [target.get("name") or ""]
    return list(dict.fromkeys(str(t).strip() for t in own if str(t).strip()))


def ingest(candidates: DataFrame, stored: DataFrame, keywords: list[tuple[str, str]], *, source: str, per_source: int, names: dict[str, str], on_progress: Callable[[dict], None] | None = None, **options) -> dict[str, DataFrame]:
    """Tables decisions, articles, mentions and log in one pass over planned candidates (url, pos, title, summary, body, published_at, fetch_error, needs_date, exact_body, source).

    Each URL is looked at once a source, so many of each source. A candidate is matched by the keywords; the ladder of rules decides; what it selects is
    an article (the first of its URL), with one mention for each target that was found. The ladder runs once: its decisions are settled, and the other tables
    are made of them. What that pass has counted (seen, selected, duplicates, skipped, sources) goes to on_progress when it is over.
    """
    once = C.first_by(candidates, F.concat_ws("\n", F.col(source), F.col("url")), "pos").where("coalesce(url, '') <> ''")
    rows = C.limit_per(once, source, per_source, "pos")
    full, preview = F.concat_ws(" ", "title", "summary", "body"), F.concat_ws(" ", "title", "summary")
    known = stored.select(F.col("url").alias("_known")).distinct()
    found = lambda text: sum((F.contains(F.lower(text), F.lit(w.lower())).cast("int") for _, w in keywords), F.lit(0))
    ready = rows.join(known, F.col("url") == F.col("_known"), "left").withColumn("stored", F.col("_known").isNotNull()).drop("_known").withColumn("n_hits", found(full)).withColumn("n_preview_hits", found(preview))
    n = lambda status: F.coalesce(F.sum((F.col("status") == status).cast("long")), F.lit(0)).alias(status)
    passed = Observation()
    decisions = settled(C.decide(ready, **options).observe(passed, F.count(F.lit(1)).alias("seen"), n("selected"), n("duplicate"), n("skipped")))
    if on_progress:
        on_progress(passed.get)
    selected = C.first_by(decisions.where("status = 'selected'"), F.col("url"), "plan", "pos") if "plan" in decisions.columns else C.first_by(decisions.where("status = 'selected'"), F.col("url"), "pos")
    articles = selected.select(
        "url", T.capped(T.clean_title(F.col("title")), "title").alias("title"), F.col(source).alias("source_name"), "published_at",
        T.capped(F.col("summary"), "snippet").alias("snippet"), T.capped(F.col("body"), "full_text").alias("full_text"), T.summarize(full).alias("summary"),
    )
    hits = C.first_hit_per_target(C.keyword_hits(selected.select("url", full.alias("text")), keywords), "url")
    label = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.create_map().cast("map<string,string>")
    tone = selected.select(F.col("url").alias("_url"), T.sentiment(full).alias("sentiment"))
    mentions = new_mentions(hits.join(tone, F.col("url") == F.col("_url")).drop("_url").withColumn("target_name", F.coalesce(F.try_element_at(label, "target_key"), "target_key")).withColumnRenamed("keyword", "keyword_matched").drop("position"))
    counters = C.source_counters(decisions, source)
    return {"decisions": decisions, "articles": articles, "mentions": mentions, "log": counters}


def story_rows(articles: DataFrame, mentions: DataFrame, at: Column) -> DataFrame:
    """Articles as a store of stories takes them (id, at, title, summary, source_name, target_keys): the id is a hash of the URL, the targets are those of the mentions."""
    keys = mentions.groupBy(F.col("url").alias("_url")).agg(F.array_sort(F.collect_set("target_key")).alias("target_keys"))
    joined = articles.join(keys, F.col("url") == F.col("_url"))
    return joined.select(F.xxhash64("url").alias("id"), at.cast("timestamp").alias("at"), "title", "summary", "source_name", "target_keys")


def new_mentions(rows: DataFrame) -> DataFrame:
    """Mentions as they are stored: neutral without a sentiment, empty without a reason or a context."""
    for name, default in (("sentiment", "neutral"), ("sentiment_reason", ""), ("context", "")):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default))
    return rows


def new_stories(rows: DataFrame, stories: DataFrame, now: str) -> DataFrame:
    """rows (title, summary) as stories with ids behind the greatest one, in the order of title and summary. Numbers are dealt by ranges, so no task sees all rows."""
    title = T.capped(F.col("title"), "story_title")
    named = rows.select(F.when(title == "", NEW_TITLE).otherwise(title).alias("title"), F.coalesce(F.nullif(T.capped(F.col("summary"), "story_summary"), F.lit("")), title).alias("summary"))
    ranged = named.repartitionByRange("title", "summary").sortWithinPartitions("title", "summary").withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    last = stories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    numbered = ranged.join(F.broadcast(before), part == F.col("_part")).crossJoin(F.broadcast(last))  # one row
    place = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return numbered.select((F.col("_last") + F.col("_before") + place + 1).alias("id"), "title", "summary", F.lit(NEW_STORY).alias("temperature"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))


def attached(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges (story_id, article_id, pos) that are new: the first story of an article that has none yet."""
    fresh = edges.join(stored.select("article_id"), "article_id", "left_anti")
    return fresh.groupBy("article_id").agg(F.min_by("story_id", "pos").alias("story_id")).select("story_id", "article_id")


def new_story_targets(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges (story_id, target_key) that aren't stored yet, each once."""
    return edges.select("story_id", "target_key").distinct().join(stored.select("story_id", "target_key"), ["story_id", "target_key"], "left_anti")


def touched(stories: DataFrame, stats: DataFrame, now: str) -> DataFrame:
    """Stories with the temperature of their articles (stats: story_id, temperature) and the time of the change; those without stats as they are."""
    new = stats.select(F.col("story_id").alias("_id"), F.col("temperature").alias("_temperature"))
    joined = stories.join(new, F.col("id") == F.col("_id"), "left")
    return joined.withColumn("temperature", F.coalesce("_temperature", "temperature")).withColumn("updated_at", F.when(F.col("_id").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))).drop("_id", "_temperature")


def run_log(events: DataFrame) -> DataFrame:
    """A run for each log_id, from its events (log_id, at, source_name, source_type, status, articles_found, mentions_found, error_message): when it began, and what its last event says."""
    last = lambda c: F.max_by(c, "at").alias(c)
    kept = ("status", "articles_found", "mentions_found", "error_message")
    runs = events.groupBy("log_id").agg(F.min_by("source_name", "at").alias("source_name"), F.min_by("source_type", "at").alias("source_type"), F.min("at").alias("started_at"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"), *map(last, kept))
    return runs.select("log_id", "source_name", "source_type", "started_at", "finished_at", *kept)
