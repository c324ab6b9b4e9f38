"""Readers of earlier snapshots whose stories are cards of HTML, and of gold lists. Pages are rows (page, html)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionlake.functions import dates as D
from mentionlake.functions import html as H
from mentionlake.functions import text as T
from mentionlake.functions import url as U
from mentionlake.functions.bind import let
from mentionlake.operators.dataset import AI, GROUPED, NO_SOURCE, RAW, UNTITLED

#: Elements (tag, class) of snapshot pages.
LABEL, STORY_TEXT = ("div", "summary-label"), ("div", "story-blurb|story-summary", True)
META, META_BLOCK = ("p", "article-meta|meta-line"), ("div", "article-meta|meta-line")
PREVIEW, WHOLE = ("div", "(?:body-text|body)", True), ("div", "(?:body-text|body) full", True)
ARTICLE = H.opening("article", "article-card")
STORY_ID = r'<details\b[^>]*\bdata-story-id="(\d+)"'
CARD = STORY_ID.replace("(", "").replace(")", "")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, f"(?is){pattern}", group)


def cards(pages: DataFrame) -> DataFrame:
    """(page, story, card): the card of each story, the first one of a page."""
    rows = pages.select("page", F.posexplode(H.pieces(F.coalesce("html", F.lit("")), CARD)).alias("pos", "piece"))
    named = rows.withColumn("story", _found(F.col("piece"), STORY_ID).cast("long"))
    first = named.groupBy("page", "story").agg(F.min_by("piece", "pos").alias("piece"))
    return first.select("page", "story", H.balanced(F.col("piece"), "details").alias("card"))


def payload(html: Column, schema: str) -> Column:
    """The data that a page carries in its script."""
    script = F.get(F.filter(H.pieces(html, H.opening("script")), lambda s: H.attribute(s, "id") == "snapshot-payload"), F.lit(0))
    return F.from_json(H.first_inside(script, "script"), schema)


def bundle_links(html: Column) -> Column:
    """Where a page's data files are: (data, raw_texts), null for those that it doesn't name."""
    link = lambda name: F.nullif(H.unescape(H.attribute(html, f"data-clipping-{name}-url")), F.lit(""))
    return F.struct(link("data").alias("data"), link("raw").alias("raw_texts"))


def card_stories(found: DataFrame) -> DataFrame:
    """A row for each card: title, summary, numbers, dates and target keys."""
    c = F.col("card")
    attrs = H.attributes(c, "details")
    attr = lambda name: F.coalesce(F.nullif(F.try_element_at(attrs, F.lit(name)), F.lit("")), F.lit(None).cast("string"))
    shown = lambda which: D.from_shown(_found(c, rf"{which} publica[cç][aã]o:\s*([^<]+)"))
    n = F.size(H.pieces(c, ARTICLE)).cast("long")
    number = lambda name: attr(name).try_cast("long")
    label = T.fragment_text(H.first_inside(c, *LABEL))
    ai = F.coalesce(number("data-ai-count"), F.lit(0).cast("long"))
    shown_heat = F.get(F.filter(H.pieces(c, H.opening("strong")), lambda p: F.lower(H.fragment(H.first_inside(p, "span"))) == "temperatura"), F.lit(0))
    heat = F.coalesce(attr("data-temperature"), F.nullif(H.first_inside(shown_heat, "strong"), F.lit("")), F.lit("0"))
    return found.select(
        "page", "story", F.coalesce(F.nullif(T.fragment_text(H.first_inside(c, "h2")), F.lit("")), F.lit(UNTITLED)).alias("title"),
        F.when(label == "", GROUPED).otherwise(label).alias("summary_label"), T.fragment_text(H.first_inside(H.first_inside(c, *STORY_TEXT), "p")).alias("summary"),
        F.coalesce(heat.try_cast("double"), F.lit(0.0)).alias("temperature"), shown("[Pp]rimeira").alias("first_published_at"), F.coalesce(attr("data-last-published"), shown("[Uu]ltima")).alias("last_published_at"),
        F.coalesce(number("data-article-count"), n).alias("article_count"), ai.alias("ai_count"), F.coalesce(number("data-raw-count"), F.greatest(n - ai, F.lit(0).cast("long"))).alias("raw_count"),
        F.filter(F.split(F.coalesce(attr("data-targets"), F.lit("")), ","), lambda k: k != "").alias("target_keys"),
    )


def card_articles(found: DataFrame) -> DataFrame:
    """A row for each article of a card. Articles without a number get those behind the greatest that their page names, in order."""
    rows = found.select("page", "story", F.posexplode(H.pieces(F.col("card"), ARTICLE)).alias("pos", "a"))
    a = F.col("a")
    attrs = H.attributes(a, "article")
    own = T.article_number(F.coalesce(F.try_element_at(attrs, F.lit("id")), F.try_element_at(attrs, F.lit("data-article-id"))))
    top = found.groupBy("page").agg(F.coalesce(F.max(F.array_max(H.article_refs(F.col("card")))), F.lit(0).cast("long")).alias("top"))
    made = rows.withColumn("own", own).join(top, "page")
    late = F.row_number().over(Window.partitionBy("page", F.col("own") == 0).orderBy("story", "pos"))  # a page is one document
    meta = F.coalesce(F.nullif(H.first_inside(a, *META), F.lit("")), H.first_inside(a, *META_BLOCK))
    spans = F.transform(H.insides(meta, "span"), T.fragment_text)
    made = made.withColumn("spans", spans)
    span = lambda k: F.coalesce(F.get("spans", F.lit(k)), F.lit(""))
    heading = H.first_inside(a, "h3")
    url = H.linked(heading, "a")
    title = T.fragment_text(heading)
    label = T.fragment_text(H.first_inside(a, *LABEL))
    label = F.when(label != "", label).when(F.contains(a, F.lit("summary-ai")), AI).otherwise(RAW)
    raw = H.first_inside(a, *WHOLE)
    return made.select(
        "page", "story", "pos", F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("top") + late).alias("article"), F.when(title == "", UNTITLED).otherwise(title).alias("title"), url.alias("url"),
        F.when(span(0) == "", NO_SOURCE).otherwise(span(0)).alias("source_name"), F.when(span(2) != "", span(2)).otherwise(let(url, U.host_everywhere)).alias("source_host"),
        D.from_shown(span(1)).alias("published_at"), label.alias("summary_label"), T.fragment_text(H.first_inside(a, *PREVIEW)).alias("preview"),
        F.when(raw != "", T.fragment_text(raw)).alias("raw_text"),
    )


def gold_rows(spark: SparkSession, path: str, date_from: str, date_to: str, *, link: str = "LINK", date: str = "DATA") -> DataFrame:
    """(url, host, day) of a list kept as CSV: links that aren't blank, dates that can be read and lie in the window."""
    rows = spark.read.option("header", True).csv(path)
    day = F.coalesce(F.to_date(D.day_first(F.trim(F.col(date)))), F.to_date(D.in_utc(D.parsed(F.col(date)), "yyyy-MM-dd")))
    url = U.without_query(F.col(link))
    return rows.select(url.alias("url"), U.host_of(url).alias("host"), day.alias("day")).where((F.col("url") != "") & F.col("day").between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date")))
