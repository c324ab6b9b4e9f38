"""Collectors of archives whose pages lead on to older ones, and of result pages of many sites, on captures (url, html).

Links between captures are read once, for all pages at once. From the seeds the frontier then moves a page a round: a join with the small table of links, settled, until no seed has a page to go to. A seed ends at a page
that isn't captured or was visited, at its most pages, or behind a page whose dated items are all older than the window. Items are read of the pages that links lead to, a row a card, so a large page is
shared by many tasks; the way of each seed is then cut behind its first old page.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlake.functions import html as H
from mentionlake.functions import url as U
from mentionlake.functions.bind import let
from mentionlake.functions.dates import parsed, portuguese
from mentionlake.operators.candidates import first_by, limit_per
from mentionlake.sources import search
from mentionlake.sources.settle import settled

#: Elements (tag, class) of the council's archive.
COUNCIL_DATE, COUNCIL_HEADING = ("span", "catItemDateCreated"), ("h3", "catItemTitle")
ITEM = "pos", "title", "href", "created", "snippet"


def _item(pos: Column, title: Column, href: Column, created: Column, snippet: Column) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip((pos, title, href, created, snippet), ITEM, strict=True)))


def magazine_item(url: Column, card: Column, i: Column, host: str, prefix: str = "") -> Column:
    """Of a card the first link to an article of the host under the path prefix, its time and description."""

    def good(target: Column) -> Column:
        under = F.startswith(U.path_of(target), F.lit(prefix)) if prefix else F.lit(True)
        return U.host_matches(U.authority(target), F.lit(host)) & under & U.likely_article(target, host)

    link = F.get(F.filter(H.anchors(card), lambda a: let(U.resolved(url, a["href"]), lambda r: let(U.canonical(r), good))), F.lit(0))
    return let(link, lambda link: _item(i, link["title"], link["href"], H.first_inside(card, "time"), H.first_inside(card, "p", r"[^\"']*description[^\"']*", True)))


def council_headings(html: Column) -> Column:
    """Headings, each with the first date that stands between the heading before and itself; a heading without one is passed over."""
    parts = F.split(F.coalesce(html, F.lit("")), f"(?i)(?={H.opening(*COUNCIL_HEADING)})")

    def one(part: Column, before: Column) -> Column:
        link = F.get(H.anchors(H.first_inside(part, COUNCIL_HEADING[0])), F.lit(0))
        date = F.get(H.insides(before, *COUNCIL_DATE), F.lit(0))
        return let(link, lambda a: F.struct(a["title"].alias("title"), a["href"].alias("href"), date.alias("created")))

    pairs = let(parts, lambda p: F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.size(p) - 1), one))
    return F.filter(pairs, lambda r: r["href"].isNotNull() & r["created"].isNotNull())


def council_item(url: Column, heading: Column, i: Column, host: str, prefix: str = "") -> Column:
    return _item(i, heading["title"], heading["href"], heading["created"], F.lit(""))


#: Readers by source: (parts of a page, item of a part, without href if it is none, URL of the next page).
READERS: dict[str, tuple[Callable, Callable, Callable]] = {
    "magazine": (search.cards, magazine_item, lambda url, html: let(search.scrolled(html, F.regexp_extract(url, r"/pagina/(\d+)(?:/|$)", 1)), lambda href: U.resolved(url, href))),
    "council": (council_headings, council_item, lambda url, html: let(H.linked(html, "link", rel="next"), lambda href: U.resolved(url, href))),
}


def links(captures: DataFrame, source: str) -> DataFrame:
    """(page, next, html) of captures, settled: each page once, by its URL as search pages are written."""
    following = READERS[source][2]
    pages = captures.where(F.coalesce("url", F.lit("")) != "").groupBy(U.search_page(F.col("url")).alias("page")).agg(F.min_by("html", "url").alias("html"))
    url = F.col("page")
    return settled(pages.select("page", let(following(url, F.col("html")), lambda u: F.when(u == url, "").otherwise(U.search_page(u))).alias("next"), "html"))


def items(pages: DataFrame, source: str, host: str, prefix: str = "") -> DataFrame:
    """(page, pos, title, href, created, snippet, published) of pages (page, html), a row an item, settled."""
    parts, item, _ = READERS[source]
    cut = pages.select("page", F.posexplode(parts(F.col("html"))).alias("at", "part")).repartition("page", "at")
    whole = let(item(F.col("page"), F.col("part"), F.col("at"), host, prefix), lambda x: x.withField("published", let(H.fragment(x["created"]), portuguese)))
    return settled(cut.select("page", whole.alias("i"))).where("i.href is not null").select("page", "i.*")


def old_pages(found: DataFrame, start: str) -> DataFrame:
    """(page): pages of items that have dated ones, all of them before the start."""
    dated = found.where("published <> ''")
    return dated.groupBy("page").agg(F.min(F.coalesce(parsed(F.col("published")) < parsed(F.lit(start)), F.lit(False))).alias("old")).where("old").select("page")


def visited(pages: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(seed, n, page) of pages (page, next) in the order in which each seed (seed, url) comes to them."""
    small = settled(pages.select("page", "next"))
    frontier = seeds.select("seed", F.lit(1).alias("n"), U.search_page(F.col("url")).alias("page"))
    reached: list[DataFrame] = []
    for _ in range(most):
        here = settled(frontier.join(small, "page").select("seed", "n", "page", "next"))
        if here.isEmpty():
            break
        reached.append(here.select("seed", "n", "page"))
        onward = here.where("next <> ''").select("seed", (F.col("n") + 1).alias("n"), F.col("next").alias("page"))
        seen = reduce(DataFrame.unionByName, reached).select("seed", "page")
        frontier = onward.join(seen, ["seed", "page"], "left_anti")
    return reduce(DataFrame.unionByName, reached) if reached else frontier.limit(0)


def archive(captures: DataFrame, seeds: list[tuple[str, str]], source: str, host: str, *, name: str, prefix: str = "", date_from: str = "", date_to: str = "", limit: int = 120, most_pages: int = 12) -> DataFrame:
    """Candidates (seed, page, pos, title, url, source_name, source_type, published_at, snippet) of an archive's pages from the seeds (name, URL) on; undated items stay.

    Of all seeds, in their order, the first one that takes a URL has it, and each takes `limit` at most, first pages first. Seeds are configuration, so they are taken one by one.
    Whether a page is old is judged by all its items, also by those that an earlier page had.
    """
    spark = captures.sparkSession
    pages = links(captures, source)
    way = settled(visited(pages, spark.createDataFrame(seeds, "seed string, url string"), most_pages))
    read = items(pages.join(F.broadcast(way.select("page").distinct()), "page"), source, host, prefix)  # most_pages a seed
    if date_from:
        ends = way.join(old_pages(read, date_from), "page").groupBy("seed").agg(F.min("n").alias("end"))
        way = way.join(F.broadcast(ends), "seed", "left").where("end is null or n <= end").drop("end")  # a row a seed
    rows = read.join(F.broadcast(way), "page")
    end = parsed(F.lit(date_to)) + F.expr("interval 1 day") if len(date_to.strip()) == 10 else parsed(F.lit(date_to))
    at = parsed(F.col("published"))
    inside = F.lit(True) if not date_from else at.isNull() | (at >= parsed(F.lit(date_from)))
    inside = inside & (at.isNull() | (at < end)) if date_to else inside
    url = let(U.resolved(F.col("page"), F.col("href")), U.canonical)
    found = settled(rows.where(inside).withColumn("url", url).where(U.likely_article(F.col("url"), host)))
    taken: list[DataFrame] = []
    for seed, _ in seeds:
        own = first_by(found.where(F.col("seed") == seed), F.col("url"), "n", "pos")
        for earlier in taken:
            own = own.join(earlier.select("url"), "url", "left_anti")
        taken.append(settled(own.orderBy("n", "pos").limit(limit)))
    title = let(H.fragment(F.col("title")), lambda t: F.when(t == "", U.slug_title(F.col("url"))).otherwise(t))
    return reduce(DataFrame.unionByName, taken).select(
        "seed", F.col("n").alias("page"), "pos", title.alias("title"), "url", F.lit(name).alias("source_name"), F.lit(f"{source}_archive").alias("source_type"), F.col("published").alias("published_at"), H.fragment(F.col("snippet")).alias("snippet"),
    )


def direct_scrape(captures: DataFrame, now: str, *, limit: int = 50, longest: int = 12) -> DataFrame:
    """Candidates of result pages (site, query, place, url, html) of many sites: the likely articles on a page's own host, each once a page, `limit` at most for each site and query; then each URL once, by query, site and place.

    Their dates are not known and stand as `now`. The limit ranks inside (site, query): the planner cuts each partition to `limit` rows a group before the shuffle, so a hot group sends few rows.
    """
    rows = captures.select("site", "query", "place", F.col("url").alias("search_url"), F.posexplode(search.link_results(F.col("html"))).alias("pos", "r")).select("site", "query", "place", "search_url", "pos", "r.title", "r.href")
    target = let(F.when(F.startswith("href", F.lit("/")), U.resolved(F.col("search_url"), F.col("href"))).otherwise(F.col("href")), U.canonical)
    found = rows.withColumn("url", target)
    likely = found.where(U.likely_article(F.col("url"), "", longest) & F.contains(U.authority(F.col("url")), U.authority(F.col("search_url"))))
    once = likely.groupBy("site", "query", "place", "search_url", "url").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))
    few = limit_per(once.withColumn("_group", F.struct("site", "query")), "_group", limit, "place", "pos")
    first = few.groupBy("url").agg(F.min(F.struct("query", "site", "place", "pos", "title", "search_url")).alias("f"))
    return first.select(F.col("f.site").alias("source_name"), F.col("f.query").alias("query"), "f.search_url", "f.title", "url", F.lit("scrape").alias("source_type"), F.lit(now).alias("published_at"), F.lit("").alias("snippet"))
