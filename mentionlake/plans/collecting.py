"""Registered queries of collectors, on pages that Spark derives from the test tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mentionlake.functions import text as T
from mentionlake.functions import url as U
from mentionlake.operators import candidates as C
from mentionlake.operators import export as X
from mentionlake.plans.catalogue import ORACLES, PARTS, QUERIES, Tables, query
from mentionlake.sources import adapters as L
from mentionlake.sources import archive as R

__all__ = ["ORACLES", "QUERIES"]
MONTH_NAMES = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
#: The last events of the test data lie in January 2024; the window holds the last ten days.
SINCE = "2024-01-21"
MAGAZINE, COUNCIL = "vejario.abril.com.br", "camara.rio"


def listed_events(spark, sf_dir):
    """Events as items of an archive: a page a kind and day, newest first; every seventh has no date."""
    events = L.read(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    last = events.agg(F.max(F.to_date("ts")).alias("last"))
    shown = F.concat(F.dayofmonth("ts").cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month("ts")), F.lit(" "), F.date_format("ts", "yyyy, HH'h'mm"))
    dated = F.when(F.col("event_id") % 7 == 0, "").otherwise(shown)
    return events.crossJoin(F.broadcast(last)).select("event_id", "event_type", "ts", dated.alias("shown"), (F.datediff("last", F.to_date("ts")) + 1).alias("n"))  # last: one row


def bound(rows, card, *by):
    """The cards of each group, newest first, as one text."""
    listed = F.array_sort(F.collect_list(F.struct((-F.unix_micros("ts")).alias("t"), (-F.col("event_id")).alias("e"), card.alias("card"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["card"]), "\n").alias("cards"))


ARCHIVED = f"""WITH l AS (SELECT max(ts)::DATE AS last FROM events), e AS (SELECT event_id, event_type, ts, event_id % 7 = 0 AS bare, date_diff('day', ts::DATE, last) + 1 AS n FROM events, l),
p AS (SELECT event_type, n, count(CASE WHEN NOT bare THEN 1 END) AS dated, count(CASE WHEN NOT bare AND ts < DATE '{SINCE}' THEN 1 END) AS older FROM e GROUP BY ALL),
w AS (SELECT event_type, coalesce(min(CASE WHEN dated > 0 AND dated = older THEN n END), 999) AS stop FROM p GROUP BY event_type),
m AS (SELECT p.event_type, coalesce(min(CASE WHEN f.n IS NULL THEN p.n END), 0) AS hole FROM p LEFT JOIN p f ON f.event_type = p.event_type AND f.n = p.n + 1 GROUP BY p.event_type),
o AS (SELECT e.*, row_number() OVER (PARTITION BY e.event_type ORDER BY e.n, ts DESC, event_id DESC) AS r FROM e JOIN w USING (event_type) JOIN m USING (event_type) WHERE n <= least(stop, hole, 12) AND (bare OR ts >= DATE '{SINCE}') AND (SELECT count(*) FROM p x WHERE x.event_type = e.event_type AND x.n = 1) = 1 """


@query(ARCHIVED + f"""AND (event_type <> 'error' OR n = 1)) SELECT event_type AS seed, n AS page, 'Evento ' || event_id AS title, 'https://{MAGAZINE}/' || event_type || '/evento-de-numero-' || event_id AS url,
  CASE WHEN bare THEN '' ELSE strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS published_at, 'Sobre ' || event_id AS snippet FROM o WHERE r <= 150""")
def archive_articles(spark, sf_dir):
    """A magazine's archive that scrolls on: a list for each kind of event, with links to other places before the article's. The list of errors leads back to itself."""
    rows = listed_events(spark, sf_dir)
    number, kind = F.col("event_id").cast("string"), F.col("event_type")
    card = F.concat(
        F.lit('<div id="post-'), number, F.lit('" class="row list-item wide"><div><a href="/tag/x"><img></a><a href="https://elsewhere.example/evento-de-numero-1">x</a></div><h3><a class="t" href="/'), kind, F.lit("/evento-de-numero-"), number,
        F.lit('/?utm_source=list">Evento '), number, F.lit("</a></h3><time>"), F.col("shown"), F.lit('</time><p class="description short">Sobre <b>'), number, F.lit("</b></p></div>"),
    )
    path = F.when(kind == "error", "\\/error\\/").otherwise(F.concat(F.lit("\\/"), kind, F.lit("\\/pagina\\/%d\\/")))
    script = F.concat(F.lit('<script>var infiniteScroll = {"settings":{"id":"content","path":"'), path, F.lit('","parameters":"?a=1"}};</script>'))
    url = F.concat(F.lit(f"https://{MAGAZINE}/"), kind, F.when(F.col("n") == 1, "/").otherwise(F.concat(F.lit("/pagina/"), F.col("n").cast("string"), F.lit("/"))))
    pages = bound(rows, card, "event_type", "n").select(url.alias("url"), F.concat(F.lit("<html><body>"), "cards", script, F.lit("</body></html>")).alias("html"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    found = R.archive(pages, [(k, f"https://{MAGAZINE}/{k}/") for k in kinds], "magazine", MAGAZINE, name="Archive", date_from=SINCE, limit=150)
    return found.select("seed", F.col("page").cast("long"), "title", "url", "published_at", "snippet")


@query(ARCHIVED + f""" AND event_type = 'purchase' AND NOT bare) SELECT n AS page, 'Evento ' || event_id AS title, 'https://{COUNCIL}/noticias/evento-de-numero-' || event_id AS url, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS published_at FROM o WHERE r <= 300""")
def council_articles(spark, sf_dir):
    """A council's archive: dates stand before their headings, some headings have none and are passed over; pages name the next one."""
    rows = listed_events(spark, sf_dir).where("event_type = 'purchase'")
    number = F.col("event_id").cast("string")
    date = F.when(F.col("shown") != "", F.concat(F.lit('<span class="catItemDateCreated x">\n Criado em '), F.col("shown"), F.lit(" </span>"))).otherwise("")
    card = F.concat(date, F.lit('<div><h3 class="catItemTitle"> <a href="/noticias/evento-de-numero-'), number, F.lit('">\n Evento '), number, F.lit("</a></h3></div>"))
    at = lambda n: F.concat(F.lit("/noticias?limit=10&start="), ((n - 1) * 10).cast("string"))
    onward = F.concat(F.lit('<link rel="next" href="'), F.replace(at(F.col("n") + 1), F.lit("&"), F.lit("&amp;")), F.lit('">'))
    pages = bound(rows, card, "n").select(F.concat(F.lit(f"https://{COUNCIL}"), at(F.col("n"))).alias("url"), F.concat(onward, "cards").alias("html"))
    found = R.archive(pages, [("news", f"https://{COUNCIL}/noticias?limit=10&start=0")], "council", COUNCIL, name="Council", date_from=SINCE, limit=300)
    return found.select(F.col("page").cast("long"), "title", "url", "published_at")


FOUND_LINKS = """WITH l AS (SELECT page_id, url AS search_url, generate_subscripts(a, 1) AS pos, unnest(a) AS a FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)(<a\\b[^>]*?href=["''][^"''#]+["''][^>]*>.*?</a>)', 1) AS a FROM pages)),
h AS (SELECT *, regexp_extract(a, '(?i)href=["'']([^"''#]+)["'']', 1) AS href, regexp_extract(search_url, '^[A-Za-z]+://([^/?#]*)', 1) AS host,
  replace(replace(replace(trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)^<a\\b[^>]*>(.*)</a>$', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS title FROM l),
u AS (SELECT *, CASE WHEN starts_with(href, '/') THEN regexp_extract(search_url, '^[A-Za-z]+://') || lower(host) || rtrim(href, '/') ELSE href END AS url FROM h WHERE NOT regexp_matches(href, '^(javascript|mailto):')),
f AS (SELECT * FROM u WHERE regexp_matches(url, '^https?://') AND contains(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), lower(host))
  AND len([x FOR x IN string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') IF length(x) >= 3]) > 0) """


@query(FOUND_LINKS + """, s AS (SELECT *, regexp_extract(host, '[a-z-]+\\.[a-z]+$') AS site, split_part(regexp_extract(search_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', 2) AS query FROM f),
k AS (SELECT site, query, page_id, search_url, url, arg_min(title, pos) AS title, min(pos) AS pos FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY site, query ORDER BY page_id, pos) AS r FROM k)
SELECT url, arg_min(site, row(query, site, page_id, pos)) AS source_name, min(query) AS query, arg_min(title, row(query, site, page_id, pos)) AS title FROM r WHERE r <= 40 GROUP BY url""")
def scraped_links(spark, sf_dir):
    """All pages as result pages of their sites, the language of the path as the query: 40 links at most for each site and query."""
    pages = L.read(spark, sf_dir, "pages")
    site = F.regexp_extract(U.authority(F.col("url")), r"[a-z-]+\.[a-z]+$", 0)
    asked = F.split_part(U.path_of(F.col("url")), F.lit("/"), F.lit(2))
    found = R.direct_scrape(pages.select(site.alias("site"), asked.alias("query"), F.col("page_id").alias("place"), "url", "html"), "2026-01-01T00:00:00+00:00", limit=40, longest=3)
    return found.select("url", "source_name", "query", "title")


@query("SELECT user_id, coalesce(min(CASE WHEN event_type <> 'view' THEN event_type END), '') AS query, CASE WHEN sum(event_id % 3) - 20 > 0 THEN sum(event_id % 3) - 20 ELSE 100000 END::BIGINT AS candidates FROM events GROUP BY user_id")
def source_defaults(spark, sf_dir):
    """The first keyword of each target, and the limit where none is asked for."""
    events = L.read(spark, sf_dir, "events")
    words = F.array_sort(F.collect_set(F.when(F.col("event_type") != "view", F.col("event_type"))))
    return events.groupBy("user_id").agg(T.default_query(words).alias("query"), T.candidate_limit(F.sum(F.col("event_id") % 3) - 20).cast("long").alias("candidates"))


@query("""WITH t AS (SELECT doc_id, lang, split_part(regexp_replace(coalesce(text, ''), '[^\\p{L} ]', '', 'g'), ' ', 1) AS title FROM documents), r AS (SELECT lang, doc_id, title, row_number() OVER (PARTITION BY lang ORDER BY title COLLATE pt, doc_id) AS place FROM t)
SELECT lang, doc_id, place FROM r WHERE place <= 60""".replace("\\\\", "\\"))
def titles_in_locale_order(spark, sf_dir):
    """The first words of documents as titles, in the order of Portuguese: accents count after letters, case after accents."""
    title = F.split_part(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L} ]", ""), F.lit(" "), F.lit(1))
    rows = L.read(spark, sf_dir, "documents").select("lang", "doc_id", X.locale_key(title).alias("title"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("title", "doc_id")).cast("long")).where("place <= 60").select("lang", "doc_id", "place")


ORACLES["site_results"] = FOUND_LINKS + "SELECT search_url, arg_min(title, row(pos, title)) AS title, url FROM f WHERE contains(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'example.com') GROUP BY search_url, url"


@query(PARTS + ", hosts AS (SELECT regexp_replace(auth, '^www\\.', '') AS host, canonical FROM canon) SELECT host, string_agg(DISTINCT canonical, ' ' ORDER BY canonical) AS urls FROM hosts GROUP BY host")
def url_sets_per_host(spark, sf_dir):
    """The canonical URLs of each host as a set."""
    pages = L.read(spark, sf_dir, "pages").select(U.host_of(F.col("url")).alias("host"), U.canonical(F.col("url")).alias("canonical"))
    return pages.groupBy("host").agg(F.array_join(F.array_sort(F.collect_set("canonical")), " ").alias("urls"))


@query("SELECT url, pos FROM (SELECT trim(url) AS url, pos, row_number() OVER (PARTITION BY trim(url) ORDER BY pos) AS r FROM (SELECT doc_id AS pos, CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE ' http://h/' || (doc_id % 40) || ' ' END AS url FROM documents) WHERE trim(url) <> '') WHERE r = 1")
def candidates_by_url(spark, sf_dir):
    """The first candidate of each URL; blank URLs go, and blanks around one don't count."""
    k = F.col("doc_id")
    url = F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit(" http://h/"), (k % 40).cast("string"), F.lit(" ")))
    rows = L.read(spark, sf_dir, "documents").select(k.alias("pos"), url.alias("url"))
    return C.first_by(rows, F.trim("url"), "pos").select(F.trim("url").alias("url"), "pos")


@query(" SELECT target_key FROM story_targets WHERE story_id = (SELECT min(story_id) FROM story_articles)", logical=True)
def targets_of_a_story(spark, sf_dir):
    """The targets of one story, the one with the smallest number."""
    t = Tables(spark, sf_dir)
    one = t.story_articles.agg(F.min("story_id").alias("asked"))
    return t.story_targets.join(F.broadcast(one), F.col("story_id") == F.col("asked")).select("target_key")
