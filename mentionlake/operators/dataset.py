"""The dashboard dataset in full: story records with their articles, labels and defaults, reading of earlier snapshots; and the report by story."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionlake.functions import text as T
from mentionlake.functions.dates import parsed, shown
from mentionlake.functions.html import article_refs
from mentionlake.functions.url import host_everywhere

#: Labels of the dashboard.
AI, RAW, EXCERPT, NONE, NOTHING, GROUPED, NO_SUMMARY = "Resumo IA", "Texto bruto", "Trecho bruto", "Sem resumo", "Sem conteudo disponivel.", "Resumo do agrupamento", "Sem resumo."
NO_FILTERS, ALL_NAMES, UNTITLED, NO_SOURCE, STORY = "Sem filtros disponiveis", "Todos os nomes monitorados", "Sem titulo", "Fonte nao identificada", "Historia"
PREVIEW, STORY_PREVIEW = 560, 700


def article_payload(ai: Column, summary: Column, full_text: Column, snippet: Column) -> Column:
    """(label, preview, full_text) of an article: the summariser's text; or an excerpt, with the whole text if that is more; or what there is; or a placeholder."""
    summary, full, snippet = (T.normalize_text(c) for c in (summary, full_text, snippet))
    raw = F.coalesce(F.nullif(summary, F.lit("")), snippet)
    shown_text = F.coalesce(F.nullif(raw, F.lit("")), full)
    made = lambda label, preview, rest: F.struct(F.lit(label).alias("label"), preview.alias("preview"), rest.alias("full_text"))
    same = (shown_text == full) & (F.length(full) <= PREVIEW)
    return (
        F.when(ai & (summary != ""), made(AI, summary, F.lit("")))
        .when(full != "", made(RAW, T.excerpt(shown_text, PREVIEW), F.when(same, "").otherwise(full)))
        .when(raw != "", made(EXCERPT, raw, F.lit("")))
        .otherwise(made(NONE, F.lit(NOTHING), F.lit("")))
    )


def text_block(payload: Column) -> Column:
    """A payload as it is shown: preview and full text as HTML."""
    return F.struct(payload["label"].alias("label"), T.rendered(payload["preview"]).alias("preview"), T.rendered(payload["full_text"]).alias("full_text"))


def article_records(articles: DataFrame, fallback: Column | None = None) -> DataFrame:
    """articles (article_id, title, url, source_name, published_at, target_keys as a list, has_ai, summary, full_text, snippet, ...) with the column record, and raw_text for texts that are kept apart. fallback: target keys for articles without any."""
    blank = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))
    keys = F.coalesce("target_keys", F.array().cast("array<string>"))
    keys = keys if fallback is None else F.when(F.size(keys) > 0, keys).otherwise(fallback)
    paid = articles.withColumn("_paid", article_payload(F.coalesce("has_ai", F.lit(False)), F.col("summary"), F.col("full_text"), F.col("snippet")))
    rest = F.col("_paid.full_text")
    record = F.struct(
        F.col("article_id").alias("articleId"), F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)).alias("title"), F.trim(F.coalesce("url", F.lit(""))).alias("url"),
        blank(F.col("source_name"), NO_SOURCE).alias("sourceName"), host_everywhere(F.coalesce("url", F.lit(""))).alias("sourceHost"),
        F.trim(F.coalesce("published_at", F.lit(""))).alias("publishedAt"), shown(F.col("published_at")).alias("publishedDisplay"), keys.alias("targetKeys"),
        F.col("_paid.label").alias("summaryLabel"), F.col("_paid.preview").alias("summaryPreview"),
        F.when(rest != "", F.concat(F.lit("article-"), F.col("article_id").cast("string"))).alias("rawTextKey"),
        F.when(F.col("_paid.label") == AI, "ai").otherwise("raw").alias("summarySource"),
    )
    return paid.withColumn("record", record).withColumn("raw_text", F.when(rest != "", rest)).drop("_paid")


def story_records(stories: DataFrame, edges: DataFrame, articles: DataFrame) -> DataFrame:
    """A record for each story (id, title, summary, temperature, target_keys): its articles, newest first, its counts, its dates and what is shown as its summary.

    edges (story_id, article_id); articles as for article_records. Stories are in the order of the last date and temperature, both falling.
    """
    named = edges.join(stories.select(F.col("id").alias("story_id"), F.coalesce("target_keys", F.array().cast("array<string>")).alias("_story_keys")), "story_id").join(articles, "article_id")
    made = article_records(named, F.col("_story_keys"))
    at = F.coalesce(F.nullif("published_at", F.lit("")), F.col("discovered_at")) if "discovered_at" in articles.columns else F.coalesce("published_at", F.lit(""))
    summary = F.when(F.coalesce("has_ai", F.lit(False)), F.nullif(T.normalize_text(F.col("summary")), F.lit("")))
    rows = made.select("story_id", at.alias("at"), F.col("article_id").alias("n"), "record", summary.alias("ai"), F.nullif("published_at", F.lit("")).alias("day"))
    grouped = rows.groupBy("story_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "n", "record", "ai")), asc=False).alias("all"), F.min("day").alias("first"), F.max("day").alias("last"),
        F.count(F.lit(1)).alias("article_count"), F.count("ai").alias("ai_count"),
    )
    joined = stories.join(grouped, F.col("id") == F.col("story_id"))
    first_ai = F.get(F.filter("all", lambda x: x["ai"].isNotNull()), F.lit(0))["ai"]
    own, lead = T.normalize_text(F.col("summary")), F.get("all", F.lit(0))["record"]
    made_of = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    display = F.when(first_ai.isNotNull(), made_of(AI, T.excerpt(first_ai, STORY_PREVIEW))).when(own != "", made_of(GROUPED, T.excerpt(own, STORY_PREVIEW))).otherwise(F.struct(F.coalesce(lead["summaryLabel"], F.lit(NONE)).alias("label"), F.coalesce(lead["summaryPreview"], F.lit(NO_SUMMARY)).alias("text")))
    out = joined.select(
        F.col("id").alias("storyIdInt"), F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)).alias("title"), display["label"].alias("summaryLabel"), display["text"].alias("summaryText"),
        F.coalesce("temperature", F.lit(0.0)).alias("temperature"), F.coalesce("first", "created_at", F.lit("")).alias("firstPublishedAt"), F.coalesce("last", "updated_at", F.lit("")).alias("lastPublishedAt"),
        F.col("article_count").alias("articleCount"), F.col("ai_count").alias("aiCount"), (F.col("article_count") - F.col("ai_count")).alias("rawCount"),
        F.coalesce("target_keys", F.array().cast("array<string>")).alias("targetKeys"), F.transform("all", lambda x: x["record"]).alias("articles"),
    )
    return out.orderBy(F.desc(F.coalesce(F.unix_micros(parsed(F.col("lastPublishedAt"))), F.lit(0))), F.desc("temperature"), "storyIdInt")


def initial_targets(keys: list[str], default: str) -> list[str]:
    return [default] if default and default in keys else list(keys)


def same_selection(selected: list[str], keys: list[str]) -> bool:
    return set(selected) == set(keys)


def selection_label(selected: list[str], labels: dict[str, str]) -> str:
    """What the dashboard says about the selected targets."""
    if not labels:
        return NO_FILTERS
    named = [label for key, label in labels.items() if key in set(selected)]
    return ALL_NAMES if same_selection(selected, list(labels)) or not named else " + ".join(named)


def label_map(targets: DataFrame) -> Column:
    """Labels by key, as an aggregate of targets (key, label)."""
    return F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "label"))))


def scope(date_from: str = "", date_to: str = "") -> dict[str, str]:
    """Names of the span that a dataset covers: everything, or a window."""
    every = not (date_from or date_to)
    return {"token": "all_stories" if every else f"{date_from}_{date_to}", "kicker": "Historico completo" if every else f"Janela {date_from} a {date_to}", "value": "Banco inteiro" if every else f"{date_from} a {date_to}"}


def meta(records: DataFrame, selected: list[str], *, generated_at: str, default_label: str, date_from: str = "", date_to: str = "") -> DataFrame:
    """One row: totals of all records and of those that the selection shows, and the names of the dataset."""
    hit = F.lit(True) if not selected else F.arrays_overlap("targetKeys", F.array(*map(F.lit, selected)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counted = {"Stories": F.lit(1), "Articles": F.col("articleCount"), "Ai": F.col("aiCount"), "Raw": F.col("rawCount")}
    names = {"Stories": "initialStoryCount", "Articles": "initialArticleCount", "Ai": "initialAiCount", "Raw": "initialRawCount"}
    columns = [total(c).alias(f"total{k}") for k, c in counted.items()] + [total(F.when(hit, c)).alias(names[k]) for k, c in counted.items()]
    named = scope(date_from, date_to)
    return records.agg(*columns).withColumns({"scopeKicker": F.lit(named["kicker"]), "scopeValue": F.lit(named["value"]), "generatedAt": F.lit(generated_at), "defaultTargetLabel": F.lit(default_label)})


def flat_articles(records: DataFrame) -> DataFrame:
    """The articles of all stories, newest first; one without targets has those of its story."""
    rows = records.select("storyIdInt", F.col("targetKeys").alias("_keys"), F.explode("articles").alias("a")).select("storyIdInt", "_keys", "a.*")
    keys = F.when(F.size("targetKeys") > 0, F.col("targetKeys")).otherwise(F.col("_keys"))
    return rows.withColumn("targetKeys", keys).drop("_keys").orderBy(F.desc("publishedAt"), "title", "articleId")


def moved(records: DataFrame, story_offset: int = 0, article_offset: int = 0) -> DataFrame:
    """records with their story and article numbers moved; 0 stays 0. Keys of raw texts follow."""
    if story_offset <= 0 and article_offset <= 0:
        return records
    shift = lambda n, by: F.when(n > 0, n + max(by, 0)).otherwise(n)
    one = lambda a: a.withField("articleId", shift(a["articleId"], article_offset)).withField("rawTextKey", F.when(a["rawTextKey"].isNotNull(), F.concat(F.lit("article-"), shift(a["articleId"], article_offset).cast("string"))))
    return records.withColumn("storyIdInt", shift(F.col("storyIdInt"), story_offset)).withColumn("articles", F.transform("articles", one))


def last_numbers(records: DataFrame) -> DataFrame:
    """(story, article): the greatest numbers in use, 0 if there are none."""
    top = F.coalesce(F.array_max(F.transform("articles", lambda a: F.greatest(a["articleId"].cast("long"), T.article_number(a["rawTextKey"])))), F.lit(0))
    return records.agg(F.coalesce(F.max("storyIdInt"), F.lit(0)).cast("long").alias("story"), F.coalesce(F.max(top), F.lit(0)).cast("long").alias("article"))


def last_article_in_page(pages: DataFrame) -> DataFrame:
    """(article): the greatest article number that snapshot pages (html) name."""
    return pages.agg(F.coalesce(F.max(F.array_max(article_refs(F.col("html")))), F.lit(0)).alias("article"))


def write_bundle(records: DataFrame, raw_texts: DataFrame, path: str) -> None:
    """Records and raw texts (article_id, raw_text) as JSON lines, apart: a reader fetches texts only when it needs them."""
    records.write.mode("overwrite").json(f"{path}/stories")
    raw_texts.where("raw_text is not null").select(F.concat(F.lit("article-"), F.col("article_id").cast("string")).alias("key"), F.col("raw_text").alias("text")).write.mode("overwrite").json(f"{path}/raw_texts")


def read_bundle(spark: SparkSession, path: str, like: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stories and raw texts of an earlier bundle, with the columns of `like`; what a record lacks gets its default, and records without a number go."""
    stories = spark.read.schema(like.schema).json(f"{path}/stories").where("storyIdInt > 0")
    filled = stories.fillna("", [c for c, t in stories.dtypes if t == "string"]).fillna(0, [c for c, t in stories.dtypes if t in ("bigint", "double", "int")])
    for c in ("targetKeys", "articles"):
        filled = filled.withColumn(c, F.coalesce(c, F.array().cast(stories.schema[c].dataType)))
    return filled, spark.read.schema("key string, text string").json(f"{path}/raw_texts")


def stories_by_size(articles: DataFrame, story_articles: DataFrame, stories: DataFrame) -> DataFrame:
    """(story_id, title, article_ids, target_names, target_keys) of the report: articles (article_id, title, target_keys and target_names as lists) by story, those of no story each on its own, largest stories first.

    A story whose articles are all outside of the report has none of them but stays; its title is its own, or else that of an article.
    """
    part = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    there = F.col("_in").isNotNull()
    marked = story_articles.join(articles.withColumn("_in", F.lit(1)), "article_id", "left")
    grouped = marked.groupBy("story_id").agg(F.array_sort(F.collect_list(F.when(there, F.col("article_id")))).alias("article_ids"), F.min_by("title", F.when(there, F.col("article_id"))).alias("_title"), part("target_names").alias("target_names"), part("target_keys").alias("target_keys"))
    titled = grouped.join(stories.select(F.col("id").alias("story_id"), F.col("title").alias("_own")), "story_id", "left")
    own = titled.select(F.col("story_id").cast("string").alias("story_id"), F.coalesce(F.nullif("_own", F.lit("")), "_title", F.lit(STORY)).alias("title"), "article_ids", "target_names", "target_keys")
    alone = articles.join(story_articles.select("article_id"), "article_id", "left_anti")
    distinct = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))).alias(c)
    single = alone.select(F.concat(F.lit("auto-"), F.col("article_id").cast("string")).alias("story_id"), "title", F.array("article_id").alias("article_ids"), distinct("target_names"), distinct("target_keys"))
    return own.union(single).orderBy(F.desc(F.size("article_ids")), "story_id")


def first_seen_targets(articles: DataFrame, *order: str) -> DataFrame:
    """(key, label) of the targets of articles (target_keys, target_names as lists) in the order in which they are first seen; a key without a name of its own is its label."""
    at = F.row_number().over(Window.partitionBy("key").orderBy(*order, "pos"))
    pairs = articles.select(*order, F.posexplode("target_keys").alias("pos", "key"), "target_names").where("coalesce(key, '') <> ''")
    first = pairs.withColumn("label", F.coalesce(F.get("target_names", F.col("pos")), "key")).withColumn("_r", at).where("_r = 1")
    return first.orderBy(*order, "pos").select("key", "label")
