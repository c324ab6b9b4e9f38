"""URLs: the canonical forms that different steps use, hosts, and the test for article pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mentionlake.functions.bind import let

#: Query keys that only track, parts of paths and file endings that no article has.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "ref", "ref_src", "ref_url", "_ga", "mc_cid", "mc_eid"]
BAD_PATHS = ["/feed", "/rss", "/wp-content", "/tag/", "/author/", "/category/", "/comentarios", "/search/", "/vereadores/", "/atividade-parlamentar/", "/comissoes/", "/frentes/"]
BAD_ENDINGS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".js", ".css", ".pdf", ".xml", ".php"]


#: A URL in its parts: scheme, authority, path, query.
SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), SPLIT, group)


def authority(url: Column) -> Column:
    return F.lower(_part(url, 2))


def _decoded(text: Column) -> Column:
    """Percent signs and pluses read; as it is if they make no sense."""
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _encoded(text: Column) -> Column:
    """As forms encode text: blanks as pluses, and letters, digits and ``_.-~`` as they are."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url: Column, blanks: bool = False) -> Column:
    """The decoded (key, value) pairs of the query, in order; those without a value only with `blanks`."""
    cut = lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("key"), _decoded(F.when(F.contains(p, F.lit("=")), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise("")).alias("value"))
    pairs = F.transform(F.filter(F.split(_part(url, 4), "&"), lambda p: p != ""), cut)
    return pairs if blanks else F.filter(pairs, lambda x: x["value"] != "")


def query_without_tracking(url: Column, in_order: bool = False) -> Column:
    """The query made anew without tracking keys and blank values: by key, or by where each key came first; values of a key keep their order."""
    pairs = F.filter(query_pairs(url), lambda x: ~F.array_contains(F.array(*map(F.lit, TRACKING)), F.lower(x["key"])))
    place = (lambda x: F.array_position(F.transform(pairs, lambda y: y["key"]), x["key"])) if in_order else (lambda x: F.lit(0))
    numbered = F.transform(pairs, lambda x, i: F.struct(place(x).alias("place"), x["key"].alias("key"), i.alias("i"), x["value"].alias("value")))
    return F.array_join(F.transform(F.array_sort(numbered), lambda x: F.concat(_encoded(x["key"]), F.lit("="), _encoded(x["value"]))), "&")


def _joined(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    """The parts as a URL; a scheme or a host that is empty leaves no mark."""
    head = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""))
    return F.concat(head, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _without_params(path: Column) -> Column:
    """Without what follows a semicolon in the last part of a path."""
    return F.regexp_replace(path, r";[^/]*$", "")


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no user, no default port, no slash at the end, no parameters, no fragment; of the query what ``query_without_tracking`` leaves, by key. Null is empty."""
    host = F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":(80|443|0*)$", "")
    path = _without_params(_part(url, 3))
    path = F.when(path == "", "/").when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(_joined(F.lower(_part(url, 1)), host, path, query_without_tracking(url)))


def with_slashes(url: Column) -> Column:
    """http:/x, a slash short, made whole."""
    return F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"(?i)^(https?:)/([^/])", "$1//$2")


def normalized(url: Column, by_key: bool = False) -> Column:
    """As canonical, but any port goes and keys keep their order (unless by_key)."""
    fixed = with_slashes(url)
    host = F.regexp_replace(F.regexp_replace(authority(fixed), "^.*@", ""), r":\d*$", "")
    path = F.regexp_replace(_without_params(_part(fixed, 3)), "/+$", "")
    return F.when(fixed == "", "").otherwise(_joined(F.lower(_part(fixed, 1)), host, F.when(path == "", "/").otherwise(path), query_without_tracking(fixed, not by_key)))


def without_query(url: Column) -> Column:
    """Scheme (https if there is none), host and path without what pasting leaves at the end (/n, /rn): what recall is measured on."""
    junk = r"(?i)(?:/(?:n|r|rn))+$"
    fixed = F.regexp_replace(with_slashes(url), junk, "")
    scheme, path = F.lower(_part(fixed, 1)), F.regexp_replace(_part(fixed, 3), "/+$", "")
    whole = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), authority(fixed), F.regexp_replace(F.when(path == "", "/").otherwise(path), junk, ""))
    return F.when(with_slashes(url) == "", "").otherwise(whole)


def search_page(url: Column) -> Column:
    """A search page: lower-case scheme and host, single slashes, blank values and tracking keys kept, no fragment."""
    path = F.regexp_replace(_part(url, 3), "/+", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.array_join(F.transform(query_pairs(url, blanks=True), lambda x: F.concat(_encoded(x["key"]), F.lit("="), _encoded(x["value"]))), "&")
    scheme = F.lower(_part(url, 1))
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "").otherwise(_joined(F.when(scheme == "", "https").otherwise(scheme), authority(url), path, query))


def resolved(base: Column, href: Column) -> Column:
    """href as seen from the page base: whole URLs, ones without scheme, host or directory, queries and fragments; `.` and `..` are followed."""
    site = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(_part(base, 3), "[^/]*$", "")
    path = F.when(F.startswith(href, F.lit("/")), _part(href, 3)).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), _part(href, 3)))
    steps = F.split(path, "/")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when((x == "..") & (F.size(a) > 1), F.slice(a, 1, F.size(a) - 1)).when(x == "..", a).otherwise(F.concat(a, F.array(x))))
    last = F.element_at(steps, -1)
    clean = F.concat(F.array_join(walked, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    tail = F.regexp_extract(href, r"([?#].*)?$", 1)
    own = F.regexp_extract(href, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    return (
        F.when(F.coalesce(href, F.lit("")) == "", base)
        .when(own != "", href)
        .when(F.startswith(href, F.lit("//")), F.concat(_part(base, 1), F.lit(":"), href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.substring_index(base, "#", 1), href))
        .when(F.startswith(href, F.lit("?")), F.concat(site, _part(base, 3), href))
        .otherwise(F.concat(site, clean, tail))
    )


def path_of(url: Column) -> Column:
    """The path without parameters and slashes at its end."""
    return F.regexp_replace(_without_params(_part(url, 3)), "/+$", "")


def slug_of(url: Column) -> Column:
    return F.substring_index(path_of(url), "/", -1)


def slug_title(url: Column) -> Column:
    """A title made of the last part of a path."""
    return F.initcap(F.trim(F.regexp_replace(slug_of(url), "[-_]+", " ")))


def hostname(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":\d*$", "")


def same_family(a: Column, b: Column) -> Column:
    """Whether two hosts are equal or one lies under the other; leading w and dots don't count."""
    x, y = (F.regexp_replace(h, r"^[w.]+", "") for h in (a, b))
    under = lambda p, q: F.endswith(p, F.concat(F.lit("."), q))
    return (x == y) | under(x, y) | under(y, x)


#: Where aggregated news links are, and how their tokens are written.
NEWS_HOST, NEWS_TOKEN = "news.google.com", r"/(?:rss/)?(?:articles|read)/([^/?#]+)"


def is_news_link(url: Column) -> Column:
    return F.contains(authority(url), F.lit(NEWS_HOST))


def news_token(url: Column) -> Column:
    """The token of an aggregated news link; empty for other URLs."""
    return F.when(is_news_link(url), F.trim(F.regexp_extract(_part(url, 3), NEWS_TOKEN, 1))).otherwise("")


def news_target(url: Column, snippet_links: Column) -> Column:
    """The article behind an aggregated link as far as it is known without the network: a link of its snippet to another host, or its own url parameter, else the link itself."""
    direct = F.get(F.filter(snippet_links, lambda h: (authority(h) != "") & ~is_news_link(h)), F.lit(0))
    named = F.get(F.filter(query_pairs(url), lambda x: x["key"] == "url"), F.lit(0))["value"]
    return F.coalesce(direct, F.when(is_news_link(url), named), url)


def news_feed(query: Column) -> Column:
    """The feed URL of a search."""
    return F.concat(F.lit(f"https://{NEWS_HOST}/rss/search?q="), _encoded(query), F.lit("&hl=pt-BR&gl=BR&ceid=BR:pt-419"))


def host_of(url: Column) -> Column:
    return F.regexp_replace(authority(url), r"^www\.", "")


def host_everywhere(url: Column) -> Column:
    """The host with every `www.` taken out, wherever it stands."""
    return F.replace(authority(url), F.lit("www."), F.lit(""))


def host_matches(host: Column, expected: Column) -> Column:
    return (host == expected) | F.endswith(host, F.concat(F.lit("."), expected))


def likely_article(url: Column, host_fragment: str = "", longest: int = 12) -> Column:
    """An http(s) URL on the host, with a path that has a long segment and nothing that only listings and files have."""

    def of(path: Column) -> Column:
        ok = ~path.isin("", "/") & ~F.exists(F.array(*map(F.lit, BAD_PATHS)), lambda token: F.contains(path, token)) & ~F.exists(F.array(*map(F.lit, BAD_ENDINGS)), lambda end: F.endswith(path, end))
        return ok & F.exists(F.split(path, "/"), lambda s: F.length(s) >= longest)

    def whole(u: Column) -> Column:
        ok = F.lower(_part(u, 1)).isin("http", "https") & let(F.lower(_part(u, 3)), of)
        return ok & F.contains(authority(u), F.lit(host_fragment.lower())) if host_fragment else ok

    return let(url, whole)
