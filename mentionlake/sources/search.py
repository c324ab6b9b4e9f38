"""Readers of captured result pages of site searches: candidates and the next page, by the markup of each site. Pages are rows (url, html)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlake.functions import html as H
from mentionlake.functions import url as U
from mentionlake.functions.bind import let
from mentionlake.functions.dates import portuguese
from mentionlake.operators.candidates import first_by

#: Elements (tag, class) of the sites' result pages.
CARD, CARD_TEXT, CARD_DATE = ("div", "list-item"), ("span", "description"), ("span", "date-post")
ITEM, ITEM_TEXT, ITEM_DATE = ("dt", "result-title"), ("dd", "result-text"), ("dd", "result-created")
PART = ("article", "uk-article")


def cards(html: Column) -> Column:
    """The posts of a list, each a division with a number."""
    return F.filter(F.transform(H.pieces(html, H.opening(*CARD)), lambda p: H.balanced(p, "div")), lambda c: H.attribute(c, "id").rlike(r"^post-\d+$"))


def card_results(html: Column) -> Column:
    """Cards of a list: all their links, the description and the date of each."""
    rows = F.transform(cards(html), lambda b, i: F.transform(H.anchors(b), lambda a: F.struct(i.alias("card"), a["title"].alias("title"), a["href"].alias("href"), H.first_inside(b, *CARD_TEXT).alias("snippet"), H.first_inside(b, *CARD_DATE).alias("created"))))
    return F.flatten(rows)


def listed_results(html: Column) -> Column:
    """Definition lists: a title with its link, then text and date, which stand before the next title."""

    def one(piece: Column, i: Column) -> Column:
        link = F.get(H.anchors(H.first_inside(piece, *ITEM)), F.lit(0))
        return F.struct(i.alias("card"), link["title"].alias("title"), link["href"].alias("href"), H.first_inside(piece, *ITEM_TEXT).alias("snippet"), H.first_inside(piece, *ITEM_DATE).alias("created"))

    return F.filter(F.transform(H.pieces(html, H.opening(*ITEM)), one), lambda r: r["href"].isNotNull())


def article_results(html: Column) -> Column:
    """Article elements: the first link of each, the whole element as text, no date."""
    first = lambda b: F.get(H.anchors(b), F.lit(0))
    return F.filter(F.transform(H.insides(html, *PART), lambda b, i: F.struct(i.alias("card"), first(b)["title"].alias("title"), first(b)["href"].alias("href"), b.alias("snippet"), F.lit("").alias("created"))), lambda r: r["href"].isNotNull())


def link_results(html: Column) -> Column:
    """Any links."""
    return F.transform(F.filter(H.anchors(html), lambda a: ~a["href"].rlike("^(javascript|mailto):")), lambda a, i: F.struct(i.alias("card"), a["title"].alias("title"), a["href"].alias("href"), F.lit("").alias("snippet"), F.lit("").alias("created")))


#: Hosts whose result pages have a markup of their own.
READERS = {"vejario.abril.com.br": card_results, "camara.rio": listed_results, "www.conib.org.br": article_results}


def results(pages: DataFrame, host: str, source: str, longest: int = 12) -> DataFrame:
    """Candidates of result pages of a host: whole URLs of likely articles on it, each once a page, by the first titled link of a card or else its first link.

    Captures of the same page have cards of their own; of a URL that several of them have the first place counts, then the least title, snippet and date.
    """
    rows = pages.select(F.col("url").alias("search_url"), F.sha2(F.coalesce(F.col("html"), F.lit("")), 256).alias("capture"), F.posexplode(READERS.get(host, link_results)(F.col("html"))).alias("pos", "r")).select("search_url", "capture", "pos", "r.*")
    found = rows.withColumn("url", let(U.resolved(F.col("search_url"), F.col("href")), U.canonical)).where(U.likely_article(F.col("url"), host.removeprefix("www."), longest))
    card = found.groupBy("search_url", "capture", "card").agg(F.min_by(F.struct("pos", "url", "title", "snippet", "created"), F.struct(F.col("title") == "", "pos")).alias("r")).select("search_url", "r.*")
    once = first_by(card, F.concat_ws("\n", "search_url", "url"), "pos", "title", "snippet", "created")
    title = let(H.fragment(F.col("title")), lambda t: F.when(t == "", U.slug_title(F.col("url"))).otherwise(t))
    return once.select(
        "search_url", "pos", title.alias("title"), "url", F.lit(source).alias("source_name"), F.lit("internal_search").alias("source_type"),
        portuguese(H.fragment(F.col("created"))).alias("published_at"), H.fragment(F.col("snippet")).alias("snippet"),
    )


def scrolled(html: Column, page: Column, host: str | None = None, parameters: bool = True) -> Column:
    """The next path of a list that scrolls on, from the settings in its script: a template with %d for a page's number, and what follows it. Of the settings those of a host's history, or else the first path."""
    settings = F.regexp_extract(F.coalesce(html, F.lit("")), r'(?s)"history":(\{[^{}]*\})', 1) if host else F.regexp_extract(F.coalesce(html, F.lit("")), r'(?s)infiniteScroll\s*=\s*\{"settings":(\{.*)$', 1)
    said = F.when(F.get_json_object(settings, "$.host") == host, F.get_json_object(settings, "$.path")) if host else F.replace(F.regexp_extract(settings, r'"path":"([^"]+)"', 1), F.lit("\\/"), F.lit("/"))
    rest = F.coalesce(F.get_json_object(settings, "$.parameters"), F.lit("")) if host and parameters else F.lit("")
    now = F.coalesce(F.nullif(page, F.lit("")).cast("int"), F.lit(1))
    return F.when(F.coalesce(said, F.lit("")) != "", F.concat(F.replace(said, F.lit("%d"), (now + 1).cast("string")), rest)).otherwise("")


def next_page(url: Column, html: Column, host: str) -> Column:
    """The URL of the next result page; empty if there is none. Links that say so by rel or by their text count, on the host only."""
    says = lambda a: F.lower(a["attrs"]).rlike("rel=[\"']next[\"']|title=\"próximo\"") | F.lower(a["title"]).rlike("próximo|proximo|next")
    links = F.transform(F.filter(H.anchors(html), says), lambda a: let(U.resolved(url, a["href"]), U.canonical))
    generic = F.get(F.filter(links, lambda u: U.host_matches(U.authority(u), F.lit(host))), F.lit(0))
    whole = lambda said: let(said, lambda href: F.when(href != "", let(U.resolved(url, href), U.canonical)).otherwise(""))
    if host == "camara.rio":
        return whole(H.linked(html, "link", rel="next"))
    if host == "www.conib.org.br":
        return whole(H.linked(html, "a", **{"class": "next"}))
    if host == "vejario.abril.com.br":
        return whole(scrolled(html, F.regexp_extract(url, r"/busca/pagina/(\d+)/", 1), host))
    return F.coalesce(generic, F.lit(""))
