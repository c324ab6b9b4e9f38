"""The dataset as one publication: merged with an earlier one, each URL once across its stories, its targets and totals, and a store of its versions as JSON."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mentionlake.functions.dates import parsed
from mentionlake.operators import dataset as E
from mentionlake.sources.settle import settled

COUNTED = "key string, label string, primary boolean, storyCount long, articleCount long"
MANIFEST = "number long, folder string, stories long, articles long, rawTexts long"
MANIFESTS = "manifests"
META = "totalStories long, totalArticles long, totalAi long, totalRaw long, initialStoryCount long, initialArticleCount long, initialAiCount long, initialRawCount long, scopeKicker string, scopeValue string, generatedAt string, defaultTargetLabel string"


@dataclass
class Dataset:
    """stories: records as story_records makes them; raw_texts (key, text); targets (key, label, primary, ...), few; head: the row (meta, targets, defaultTargets) once published."""

    stories: DataFrame
    raw_texts: DataFrame
    targets: DataFrame
    head: DataFrame | None = None


def shape(columns: str) -> str:
    """Columns as one struct type."""
    return "struct<" + ",".join(":".join(c.split()) for c in columns.split(", ")) + ">"


def url_of(article: Column) -> Column:
    return F.trim(F.coalesce(article["url"], F.lit("")))


def place() -> Column:
    """What records are ordered by: the last date and the temperature, both falling, then the number. Records that share a number are told apart by their articles."""
    falling = lambda c, none: (-F.coalesce(c, F.lit(none))).alias
    return F.struct(
        falling(F.unix_micros(parsed(F.col("lastPublishedAt"))), 0)("at"), falling(F.col("temperature"), 0.0)("temperature"),
        F.col("storyIdInt").alias("story"), F.xxhash64("title", "articles").alias("twin"),
    )


def once_by_url(records: DataFrame) -> DataFrame:
    """records with each URL once: at its first place in the order of stories, then of articles. Articles without a URL all stay; stories left empty go; the others' counts follow.

    Only places and URLs are shuffled: the first place of each URL (combined before the shuffle, so a URL that a third of the articles share is no
    hot key), then the places that stay of each story. Two rows equal in all of number, title and articles keep the same articles.
    """
    marked = records.where(F.size("articles") > 0).withColumn("_place", place())
    named = marked.select("_place", F.posexplode("articles").alias("pos", "a")).select("_place", "pos", url_of(F.col("a")).alias("url")).where("url <> ''")
    first = named.groupBy("url").agg(F.min(F.struct("_place", "pos")).alias("w"))
    stay = first.groupBy(F.col("w._place").alias("_at")).agg(F.collect_list("w.pos").alias("_stay"))
    joined = marked.join(stay, F.col("_place") == F.col("_at"), "left")
    blank = F.filter(F.sequence(F.lit(0), F.size("articles") - 1), lambda i: url_of(F.get("articles", i)) == "")
    at = F.array_sort(F.array_union(blank, F.coalesce("_stay", F.array().cast("array<int>"))))
    left = joined.withColumn("_n", F.size("articles")).withColumn("articles", F.transform(at, lambda i: F.get("articles", i)))
    fewer, n = F.size("articles") < F.col("_n"), F.size("articles").cast("long")
    ai = F.size(F.filter("articles", lambda a: a["summarySource"] == "ai")).cast("long")
    counts = {"articleCount": n, "aiCount": ai, "rawCount": n - ai}
    kept = left.where(F.size("articles") > 0).withColumns({c: F.when(fewer, v).otherwise(F.col(c)) for c, v in counts.items()})
    return kept.select(*(F.col(f"`{c}`") for c in records.columns))


def merged(new: Dataset, old: Dataset, remap: bool = False) -> Dataset:
    """new with the stories of old whose numbers it doesn't use, the raw texts that these name, and the targets that it hasn't got, after its own. remap: the numbers of new are moved behind those of old, so nothing of old goes."""
    stories, texts = new.stories, new.raw_texts
    if remap:
        last = E.last_numbers(old.stories).first()
        stories = E.moved(stories, last.story, last.article)
        number = F.regexp_extract("key", r"^article-(\d+)$", 1).cast("long")
        texts = texts.withColumn("key", F.when(number > 0, F.concat(F.lit("article-"), (number + last.article).cast("string"))).otherwise(F.col("key")))
    used = stories.select("storyIdInt").distinct()
    others = old.stories.join(used, "storyIdInt", "left_anti").select(*stories.columns)
    named = others.select(F.explode("articles.rawTextKey").alias("key")).where("key is not null").distinct()
    kept = old.raw_texts.join(named, "key", "left_semi").select("key", "text")
    texts = texts.join(kept.select("key"), "key", "left_anti").select("key", "text").union(kept)  # as in a mapping, the later text of a key counts
    more = old.targets.where("coalesce(key, '') <> ''").join(F.broadcast(new.targets.select("key")), "key", "left_anti")  # a row a monitored name
    targets = new.targets.select("key", "label", "primary").union(more.select("key", F.coalesce("label", "key"), F.coalesce("primary", F.lit(False))))
    return Dataset(stories.union(others), texts, targets)


def counted_targets(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, label, primary, storyCount, articleCount) of the targets that stories have: known ones in their order, others after them by key."""
    ranked = targets.select("key", "label", "primary", F.monotonically_increasing_id().alias("ord"))
    stories = records.select(F.monotonically_increasing_id().alias("id"), F.col("articleCount").alias("article_count"), "targetKeys")
    pairs = stories.select("id", "article_count", F.explode(F.array_distinct("targetKeys")).alias("target_key")).where("target_key <> ''")
    counts = pairs.groupBy("target_key").agg(F.count(F.lit(1)).alias("storyCount"), F.sum("article_count").cast("long").alias("articleCount"))
    label = F.coalesce("label", F.initcap(F.replace("target_key", F.lit("_"), F.lit(" "))))
    rows = counts.join(ranked, F.col("target_key") == F.col("key"), "left")
    return rows.orderBy(F.col("ord").asc_nulls_last(), "target_key").select(F.col("target_key").alias("key"), label.alias("label"), F.coalesce("primary", F.lit(False)).alias("primary"), "storyCount", "articleCount")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """The publications at path, a row each. A folder that isn't there is one without rows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFESTS}")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(MANIFEST).json(f"{path}/{MANIFESTS}") if there else spark.createDataFrame([], MANIFEST)


def publish(data: Dataset, path: str, *, generated_at: str, default: str = "", date_from: str = "", date_to: str = "") -> None:
    """Writes data as a new version at path: stories and raw texts as JSON lines in many files, stories in their order, and one row with totals, targets and default targets.

    Files go to a folder of their own; the manifest that names it is one small file, written last. So readers see all of a version or the one before,
    and a run that fails, or that Spark repeats in part, shows nothing. URLs count once (once_by_url). Targets are as many as monitored names.
    """
    spark = data.stories.sparkSession
    records = settled(once_by_url(data.stories))
    counted = counted_targets(records, data.targets).collect()  # a row a monitored name
    keys = [t.key for t in counted]
    selected = E.initial_targets(keys, default)
    labels = {t.key: t.label for t in counted}
    folder = f"v-{uuid.uuid4().hex}"
    seen, texts = Observation(), Observation()
    ordered = records.orderBy(place()).observe(seen, F.count(F.lit(1)).alias("stories"), F.coalesce(F.sum("articleCount"), F.lit(0)).cast("long").alias("articles"))
    ordered.write.json(f"{path}/{folder}/stories")
    data.raw_texts.select("key", "text").observe(texts, F.count(F.lit(1)).alias("n")).write.json(f"{path}/{folder}/raw_texts")
    meta = E.meta(records, selected, generated_at=generated_at, default_label=labels.get(default, default), date_from=date_from, date_to=date_to)
    listed = F.from_json(F.lit(json.dumps([t.asDict() for t in counted])), f"array<{shape(COUNTED)}>")
    head = meta.select(F.struct(*meta.columns).alias("meta"), listed.alias("targets"), F.array(*map(F.lit, selected)).cast("array<string>").alias("defaultTargets"))
    head.coalesce(1).write.json(f"{path}/{folder}/head")
    number = manifests(spark, path).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
    row = (number, folder, seen.get["stories"], seen.get["articles"], texts.get["n"])
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/{MANIFESTS}")


def published(spark: SparkSession, path: str, like: DataFrame, number: int | None = None) -> Dataset:
    """The last version at path, or the one of that number; its stories have the columns of `like`. Of two that were published at once under one number the one with the greater folder name counts."""
    found = manifests(spark, path)
    last = (found if number is None else found.where(F.col("number") == number)).orderBy(F.desc("number"), F.desc("folder")).first()
    if last is None:
        raise ValueError(f"nothing is published at {path}" if number is None else f"no version {number} at {path}")
    at = f"{path}/{last.folder}"
    head = spark.read.schema(f"meta {shape(META)}, targets array<{shape(COUNTED)}>, defaultTargets array<string>").json(f"{at}/head")
    targets = head.select(F.explode("targets").alias("t")).select("t.*")
    return Dataset(spark.read.schema(like.schema).json(f"{at}/stories"), spark.read.schema("key string, text string").json(f"{at}/raw_texts"), targets, head)
