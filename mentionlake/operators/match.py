"""Whether expected articles are among those found: exact keys first, then near copies of slugs and titles, all as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlake.functions import text as T
from mentionlake.functions import url as U
from mentionlake.functions.dates import day_first
from mentionlake.operators.evaluate import spread_samples, verdict

SLUG_LEAST, SLUG_SHARE = 20, 0.7
TITLE_LEAST, LONG_TITLE, TITLE_SHARE = 20, 30, 0.75


def keyed(rows: DataFrame, *keep: str) -> DataFrame:
    """rows (url, title) with all that they are compared by."""
    folded = T.folded_title(F.coalesce("title", F.lit("")))
    words = lambda text, by: F.array_distinct(F.split(text, by))
    return rows.select(
        *keep, U.canonical(F.col("url")).alias("canonical"), U.path_of(F.col("url")).alias("path"), U.hostname(F.col("url")).alias("host"),
        U.slug_of(F.col("url")).alias("slug"), words(U.slug_of(F.col("url")), "-").alias("slug_words"), folded.alias("folded"), words(folded, " ").alias("title_words"),
    )


def alike(a: DataFrame, b: DataFrame, words: str, share: float, *by: str) -> DataFrame:
    """Pairs of rows whose sets of words have this Jaccard similarity, as a.* and b.* (b's columns start with r_); only rows that agree in `by` meet.

    Words stand in one order for all rows, long ones first since they are rare. Two sets that are alike share one of the first n - ceil(share * n) + 1
    words of each, so only those are joined on.
    """
    order = lambda w: F.transform(F.array_sort(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("word")))), lambda s: s["word"])
    front = lambda w: F.slice(order(w), 1, F.size(w) - F.ceil(share * F.size(w)).cast("int") + 1)
    right = b.select(*(F.col(c).alias(f"r_{c}") for c in b.columns))
    left, right = a.withColumn("_word", F.explode(front(F.col(words)))), right.withColumn("_r_word", F.explode(front(F.col(f"r_{words}"))))
    same = [F.col("_word") == F.col("_r_word"), *(F.col(c) == F.col(f"r_{c}") for c in by)]
    met = left.join(right, same).drop("_word", "_r_word")
    return met.where(T.jaccard(F.col(words), F.col(f"r_{words}")) >= share)


def matches(expected: DataFrame, found: DataFrame, group: str | None = None) -> DataFrame:
    """(id, how) for expected (id, url, title) and found (url, title): by what each expected article is among those found, of its group if there are groups.

    how is canonical (the same URL), path, slug (of 20 characters or more, seven tenths of the words of both shared), title (equal when folded, of 20
    characters or more) or near_title (both of 30 or more, three quarters of the words shared). Titles count between hosts of one family only.
    """
    by = [group] if group else []
    a, b = keyed(expected, "id", *by), keyed(found, *by).distinct()
    same = lambda *keys: a.join(b.select(*by, *keys).distinct(), [*by, *keys])
    family = (F.col("host") == "") | (F.col("r_host") == "") | U.same_family(F.col("host"), F.col("r_host"))
    right = b.select(*(F.col(c).alias(f"r_{c}") for c in (*by, "host", "folded"))).distinct()
    titled = a.where(F.length("folded") >= TITLE_LEAST)
    slugs = alike(a.where(F.length("slug") >= SLUG_LEAST), b.where("slug <> ''").select(*by, "slug_words").distinct(), "slug_words", SLUG_SHARE, *by)
    equal = titled.join(right, [F.col(c) == F.col(f"r_{c}") for c in ("folded", *by)]).where(family)
    long = lambda x: x.where(F.length("folded") >= LONG_TITLE)
    near = alike(long(a), long(b).select(*by, "host", "title_words").distinct(), "title_words", TITLE_SHARE, *by).where(family)
    ways = {"canonical": same("canonical").where("canonical <> ''"), "path": same("path").where("path <> ''"), "slug": slugs, "title": equal, "near_title": near}
    rows = [df.select("id", F.lit(how).alias("how")) for how, df in ways.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out.distinct()


def evaluate(expected: DataFrame, found: DataFrame, *, least: int = 5, samples: int = 5, likely: Column | None = None) -> DataFrame:
    """(source, expected, found, day_from, day_to, verdict) of each source with `least` expected articles (source, url, title, date as dd/mm/yyyy).

    Of each source some articles are taken, evenly spaced by date, of distinct URLs that look like articles; the window reaches a day further than
    they do. Sources without dates are skipped.
    """
    enough = expected.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("source")
    rows = expected.join(enough, "source").where(U.likely_article(F.col("url")) if likely is None else likely)
    once = rows.groupBy("source", "url").agg(F.min_by(F.struct("title", "date"), F.col("date")).alias("r")).select("source", "url", "r.*")
    picked = spread_samples(once, "source", "date", "url", n=samples).withColumn("id", F.concat_ws("|", "source", "url"))
    hits = matches(picked.select("id", "url", "title", "source"), found.select("url", "title", "source"), "source").select("id").distinct().withColumn("hit", F.lit(1))
    day = F.to_date(day_first(F.col("date")))
    totals = picked.join(hits, "id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found"), F.date_sub(F.min(day), 1).alias("day_from"), F.date_add(F.max(day), 1).alias("day_to")
    )
    return totals.withColumn("verdict", F.when(F.col("day_from").isNull(), "SKIP").otherwise(verdict(F.col("found"), F.col("expected"))))
