"""HTML by regular expressions: text, titles, links and dates of pages, without a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mentionlake.functions.dates import parsed
from mentionlake.functions.entities import unescape


def html_to_text(html: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    plain = unescape(F.regexp_replace(plain, r"(?s)<[^>]+>", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"https?://\S+", " "), r"(?U)\s+", " "))


def opening(tag: str, cls: str | None = None, whole: bool = False) -> str:
    """A pattern for the beginning of a tag, up to its class if one is asked for (an expression for a name of it or, with `whole`, for all of it)."""
    if cls is None:
        return rf"<{tag}\b"
    name = cls if whole else rf"(?:[^\"']*[\s\"'])??(?<![\w-])(?:{cls})(?![\w-])[^\"']*"
    return rf"<{tag}\b[^>]*?\sclass\s*=\s*[\"']{name}[\"']"


def insides(html: Column, tag: str, cls: str | None = None, whole: bool = False) -> Column:
    """What stands between each such tag and the next closing one: of the text before a closing tag, what follows the first opening one in it."""
    start = opening(tag, cls, whole)
    ended = F.split(F.coalesce(html, F.lit("")), f"(?i)</{tag}>")
    opened = F.filter(F.slice(ended, 1, F.greatest(F.size(ended) - 1, F.lit(0))), lambda part: part.rlike(f"(?i){start}[^>]*>"))
    return F.transform(opened, lambda part: F.regexp_extract(part, f"(?is){start}[^>]*>(.*)$", 1))


def first_inside(html: Column, tag: str, cls: str | None = None, whole: bool = False) -> Column:
    return F.coalesce(F.get(insides(html, tag, cls, whole), F.lit(0)), F.lit(""))


def pieces(html: Column, start: str) -> Column:
    """The parts of a page that begin with a pattern, each up to the next one."""
    return F.filter(F.split(F.coalesce(html, F.lit("")), f"(?i)(?={start})"), lambda x: x.rlike(f"(?i)^{start}"))


def balanced(piece: Column, tag: str) -> Column:
    """A piece that starts with a tag, up to where that tag is closed; all of it if it isn't."""
    marks = F.regexp_extract_all(piece, F.lit(rf"(?i)(</?{tag}\b)"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"), F.lit(False).alias("over"))

    def step(s: Column, mark: Column) -> Column:
        closes = F.startswith(mark, F.lit("</"))
        depth, closed = s["depth"] + F.when(closes, -1).otherwise(1), s["closed"] + closes.cast("int")
        return F.when(s["over"], s).otherwise(F.struct(depth.alias("depth"), closed.alias("closed"), (depth == 0).alias("over")))

    end = F.aggregate(marks, start, step)
    closings = F.split(piece, rf"(?i)(?<=</{tag})\s*>")
    return F.when(end["over"], F.concat(F.array_join(F.slice(closings, 1, end["closed"]), ">"), F.lit(">"))).otherwise(piece)


def tags(html: Column, tag: str, **attrs: str) -> Column:
    """The opening tags of a kind whose attributes have these values, in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)(<{tag}\s[^>]*>)"), F.lit(1))
    return F.filter(found, lambda t: F.forall(F.array(*(F.lower(attribute(t, k)) == v for k, v in attrs.items())), lambda x: x)) if attrs else found


def linked(html: Column, tag: str, **attrs: str) -> Column:
    """Where the first such tag leads; empty without one."""
    return unescape(F.coalesce(attribute(F.get(tags(html, tag, **attrs), F.lit(0)), "href"), F.lit("")))


#: Parts of classes of elements that hold an article's text.
BODY_CLASSES = ("entry-content", "post-content", "article-content", "materia-content", "content-body")


def main_block(html: Column) -> Column:
    """The longest inside of an article or main element, or of a division of a known class; the first of equals, and the page if there is none."""
    known = insides(html, "div", rf"[^\"']*(?:{'|'.join(BODY_CLASSES)})[^\"']*", whole=True)
    found = F.concat(insides(html, "article"), insides(html, "main"), known)
    longest = F.aggregate(found, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when(F.size(found) > 0, longest).otherwise(F.coalesce(html, F.lit("")))


#: Words that the part of a page must have, or else the whole page counts.
LEAST_WORDS = 80


def article_text(html: Column) -> Column:
    """The text of the part of a page that holds the article; of the whole page if that part has too few words."""
    part = html_to_text(main_block(html))
    return F.when(F.size(F.filter(F.split(part, r"(?U)\s+"), lambda w: w != "")) < LEAST_WORDS, html_to_text(html)).otherwise(part)


def fragment(html: Column) -> Column:
    """The text of a piece of HTML in one line; URLs stay."""
    return F.btrim(F.regexp_replace(unescape(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", " ")), r"(?U)\s+", " "))


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, in either kind of quotes; empty if the tag hasn't got it."""
    quoted = lambda q: F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}([^{q}]*){q}", 1)
    return F.coalesce(F.nullif(quoted('"'), F.lit("")), quoted("'"))


def attributes(html: Column, tag: str) -> Column:
    """The attributes of the first such tag, as a map. Of a name that is repeated the last value in double quotes counts, or else the first in single ones."""
    first = F.get(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)(<{tag}\b[^>]*>)"), F.lit(1)), F.lit(0))
    written = F.regexp_extract_all(F.coalesce(first, F.lit("")), F.lit(r"(?s)([^\s\"'<>/=]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))"), F.lit(1))
    value = lambda p: F.ltrim(F.substring(p, F.locate("=", p) + 1, F.length(p)))
    pairs = F.transform(written, lambda p: F.struct(F.rtrim(F.substring_index(p, "=", 1)).alias("key"), F.startswith(value(p), F.lit('"')).alias("double"), unescape(F.substring(value(p), F.lit(2), F.length(value(p)) - 2)).alias("value")))

    def chosen(key: Column) -> Column:
        of = lambda double: F.filter(pairs, lambda p: (p["key"] == key) & (p["double"] == double))
        return F.coalesce(F.get(F.reverse(of(True)), F.lit(0)), F.get(of(False), F.lit(0)))["value"]

    return F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["key"])), lambda key: F.struct(key, chosen(key))))


def meta(html: Column, key: str, value: str) -> Column:
    """The content of the meta elements whose attribute is of this value, in order."""
    return F.transform(tags(html, "meta", **{key: value}), lambda t: attribute(t, "content"))


def _first(values: Column) -> Column:
    return F.coalesce(F.get(F.filter(values, lambda v: v != ""), F.lit(0)), F.lit(""))


def title(html: Column) -> Column:
    """The title that a page gives for sharing, or else its own."""
    own = first_inside(html, "title")
    shown = lambda t: F.btrim(F.regexp_replace(F.regexp_replace(unescape(t), r"<[^>]+>", " "), r"(?U)\s+", " "))
    return _first(F.transform(F.array(_first(meta(html, "property", "og:title")), _first(meta(html, "name", "twitter:title")), own), shown))


def published_at(html: Column) -> Column:
    """When a page was published, by its meta elements or its first time element."""
    times = F.transform(tags(html, "time"), lambda t: attribute(t, "datetime"))
    return F.coalesce(parsed(_first(meta(html, "property", "article:published_time"))), parsed(_first(meta(html, "name", "pubdate"))), parsed(_first(times)))


def hrefs(html: Column) -> Column:
    """Targets of links without fragments, in order; scripts and mail addresses are no links."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)href=[\"']([^\"'#]+)[\"']"), F.lit(1))
    return F.filter(F.transform(found, lambda h: F.trim(h)), lambda h: (h != "") & ~h.rlike("(?i)^(javascript|mailto):"))


def anchors(html: Column) -> Column:
    """The links of a page in order, as (title, href, attributes)."""
    whole = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<a\b[^>]*?href=[\"'][^\"'#]+[\"'][^>]*>.*?</a>)"), F.lit(1))

    def one(a: Column) -> Column:
        tag = F.regexp_extract(a, r"(?is)^(<a\b[^>]*>)", 1)
        rest = F.regexp_replace(F.regexp_replace(tag, r"(?i)^<a|>$", ""), r"(?i)href=[\"'][^\"'#]+[\"']", "")
        return F.struct(fragment(F.regexp_extract(a, r"(?is)^<a\b[^>]*>(.*)</a>$", 1)).alias("title"), F.trim(F.regexp_extract(tag, r"(?i)href=[\"']([^\"'#]+)[\"']", 1)).alias("href"), F.trim(rest).alias("attrs"))

    return F.transform(whole, one)


def blocks(html: Column, pattern: str) -> Column:
    """The insides of all matches of a pattern with one group."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1))


def article_refs(html: Column) -> Column:
    """The numbers of the articles that a snapshot names."""
    return F.transform(blocks(html, r"\barticle-(\d+)\b"), lambda x: x.cast("long"))
