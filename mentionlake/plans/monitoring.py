"""More registered queries with their oracles: URLs and pages, evaluation, ingestion and its writers, the dataset in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from mentionlake.functions import dates as D
from mentionlake.functions import html as H
from mentionlake.functions import text as T
from mentionlake.functions import url as U
from mentionlake.operators import articles as A
from mentionlake.operators import candidates as C
from mentionlake.operators import dataset as E
from mentionlake.operators import evaluate as V
from mentionlake.operators import ingest as I
from mentionlake.operators import match as M
from mentionlake.plans.catalogue import KEYWORDS, ORACLES, PARTS, QUERIES, SETS, Tables, query
from mentionlake.sources import adapters as L
from mentionlake.sources import search, snapshots

__all__ = ["ORACLES", "QUERIES"]
NOW = "2001-09-01T00:00:00+00:00"


def pages_of(spark, sf_dir):
    return L.read(spark, sf_dir, "pages")


# --- URLs and pages ----------------------------------------------------------------------------------------------------------------------------


@query(PARTS + """, n AS (SELECT page_id, scheme, auth, regexp_replace(path, '/+$', '') AS p, string_split(q, '&') AS all_pairs, kept FROM cut)
SELECT page_id, scheme || '://' || auth || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS normalized,
  scheme || '://' || auth || regexp_replace(p, '/+', '/', 'g') || CASE WHEN len([x FOR x IN all_pairs IF x <> '']) > 0 THEN '?' || array_to_string([x FOR x IN all_pairs IF x <> ''], '&') ELSE '' END AS search_page,
  p AS path, regexp_extract(p, '[^/]*$') AS slug, regexp_replace(auth, ':[0-9]*$', '') AS hostname FROM n""")
def url_forms(spark, sf_dir):
    u = F.col("url")
    return pages_of(spark, sf_dir).select("page_id", U.normalized(u).alias("normalized"), U.search_page(u).alias("search_page"), U.path_of(u).alias("path"), U.slug_of(u).alias("slug"), U.hostname(u).alias("hostname"))


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)(<a\\b[^>]*?href=[\"''][^\"''#]+[\"''][^>]*>.*?</a>)', 1)) AS a FROM pages),
h AS (SELECT page_id, url, regexp_extract(a, '(?i)href=[\"'']([^\"''#]+)[\"'']', 1) AS href, trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)^<a\\b[^>]*>(.*)</a>$', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM l)
SELECT page_id, href, replace(replace(replace(title, '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS title, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || href
  ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') || href END AS target FROM h""")
def page_anchors(spark, sf_dir):
    """The links of all pages: title, what is written and where it leads."""
    rows = pages_of(spark, sf_dir).select("page_id", "url", F.explode(H.anchors(F.col("html"))).alias("a"))
    return rows.select("page_id", "a.href", "a.title", U.resolved(F.col("url"), F.col("a.href")).alias("target"))


@query()
def site_results(spark, sf_dir):
    """Links of pages that look like articles of the page's own host, read as result pages are; a word is long enough here. Canonical forms take several steps, so there is no SQL; tests compare with fixed pages."""
    return search.results(pages_of(spark, sf_dir).select("url", "html"), "example.com", "Example", longest=3).select("search_url", "title", "url")


@query("""WITH t AS (SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS e, text FROM documents)
SELECT doc_id, md5(replace(e, chr(10), '<br>')) AS shown, length(left(text, 500)) AS title_chars, length(left(text, 60000)) AS text_chars, contains(text, 'the') AS asked FROM t""")
def stored_texts(spark, sf_dir):
    """Texts as they are shown and as they are cut for storing."""
    text = F.col("text")
    docs = L.read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.rendered(F.coalesce(text, F.lit("")))).alias("shown"), F.length(T.capped(text, "title")).cast("long").alias("title_chars"), F.length(T.capped(text, "full_text")).cast("long").alias("text_chars"), T.matches_queries(text, ["the"]).alias("asked"))


@query("""WITH e AS (SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M UTC') AS s, strftime(ts, '%Y-%m-%dT%H:%M:00+00:00') AS iso, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%d/%m/%Y %H:%M') AS short FROM events)
SELECT event_id, iso AS back, d AS day, short, s AS as_is FROM e""")
def shown_dates(spark, sf_dir):
    """Shown dates read back."""
    s = D.in_utc(F.col("ts"), "dd/MM/yyyy HH:mm 'UTC'")
    return L.read(spark, sf_dir, "events").select("event_id", D.from_shown(s).alias("back"), D.day_first(s).alias("day"), D.shown_short(L.iso(F.col("ts"))).alias("short"), D.shown_or_as_is(s).alias("as_is"))


# --- evaluation --------------------------------------------------------------------------------------------------------------------------------

TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
NAMED = f"""WITH t AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS raw,
  trim(regexp_replace(regexp_replace(lower(strip_accents(replace({TITLE}, '&amp;', '&'))), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title FROM pages),
x AS (SELECT *, regexp_replace(regexp_replace(raw, '/+$', ''), '[^/]*$', '') || replace(title, ' ', '-') AS path FROM t),
e AS (SELECT page_id AS id, host, path, title, host || path AS canonical, regexp_extract(path, '[^/]*$') AS slug FROM x WHERE page_id % 2 = 0),
f AS (SELECT CASE WHEN page_id % 6 = 0 THEN 'other.example.org' ELSE host END AS host, CASE page_id % 4 WHEN 0 THEN path WHEN 1 THEN path || '-more' ELSE '/x/' || page_id END AS path, CASE WHEN page_id % 3 = 0 THEN '' ELSE title END AS title FROM x),
g AS (SELECT DISTINCT host, path, title, host || path AS canonical, regexp_extract(path, '[^/]*$') AS slug FROM f)"""


def named_pages(spark, sf_dir):
    """Pages under a URL made of their title (expected: every second one), and as found: some on another host, some with a longer slug, some with no title, some elsewhere."""
    title = T.folded_title(F.replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("&amp;"), F.lit("&")))
    k, host = F.col("page_id"), U.authority(F.col("url"))
    folder = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+$", ""), "[^/]*$", "")
    rows = pages_of(spark, sf_dir).select("page_id", host.alias("host"), title.alias("title"), F.concat(folder, F.replace(title, F.lit(" "), F.lit("-"))).alias("path"))
    expected = rows.where("page_id % 2 = 0").select(k.alias("id"), F.concat(F.lit("http://"), "host", "path").alias("url"), "title")
    there = F.when(k % 6 == 0, "other.example.org").otherwise(F.col("host"))
    path = F.when(k % 4 == 0, F.col("path")).when(k % 4 == 1, F.concat("path", F.lit("-more"))).otherwise(F.concat(F.lit("/x/"), k.cast("string")))
    return expected, rows.select(F.concat(F.lit("http://"), there, path).alias("url"), F.when(k % 3 == 0, "").otherwise(F.col("title")).alias("title"))


@query(NAMED + """, m AS (SELECT e.id, e.canonical = g.canonical AS c, e.path = g.path AND e.path <> '' AS p, length(e.slug) >= 20 AND g.slug <> '' AND len(list_intersect(string_split(e.slug, '-'), string_split(g.slug, '-'))) >= 0.7 * len(list_distinct(list_concat(string_split(e.slug, '-'), string_split(g.slug, '-')))) AS s,
  e.host = '' OR g.host = '' OR ltrim(e.host, 'w.') = ltrim(g.host, 'w.') OR ends_with(ltrim(e.host, 'w.'), '.' || ltrim(g.host, 'w.')) OR ends_with(ltrim(g.host, 'w.'), '.' || ltrim(e.host, 'w.')) AS near, length(e.title) >= 20 AND e.title = g.title AS t,
  length(e.title) >= 30 AND length(g.title) >= 30 AND len(list_intersect(string_split(e.title, ' '), string_split(g.title, ' '))) >= 0.75 * len(list_distinct(list_concat(string_split(e.title, ' '), string_split(g.title, ' ')))) AS w FROM e, g)
SELECT DISTINCT id, how FROM (SELECT id, unnest(list_concat(CASE WHEN c THEN ['canonical'] ELSE [] END, CASE WHEN p THEN ['path'] ELSE [] END, CASE WHEN s THEN ['slug'] ELSE [] END, CASE WHEN t AND near THEN ['title'] ELSE [] END, CASE WHEN w AND near THEN ['near_title'] ELSE [] END)) AS how FROM m)""")
def fuzzy_matches(spark, sf_dir):
    return M.matches(*named_pages(spark, sf_dir))


@query()
def source_evaluation(spark, sf_dir):
    """Verdicts by host over samples of expected pages. The samples are those of spread_samples and the matches those of fuzzy_matches, which have SQL."""
    expected, found = named_pages(spark, sf_dir)
    dated = expected.withColumn("source", U.hostname(F.col("url"))).withColumn("date", F.concat(F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"), F.lit("/03/2025")))
    return M.evaluate(dated, found.withColumn("source", U.hostname(F.col("url"))), likely=F.lit(True))


# --- ingestion and its writers -----------------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id AS pos, 'u' || (doc_id % 500) AS url, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END AS plan FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY plan, pos) AS k FROM p) SELECT plan, pos, url FROM r WHERE plan = 0 OR k = 1""")
def planned_candidates(spark, sf_dir):
    """Candidates of a collector and of two later ones, which add only new URLs."""
    docs = L.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.concat(F.lit("u"), (F.col("doc_id") % 500).cast("string")).alias("url"), "lang", "source")
    first = F.coalesce(F.col("source").isin("src0", "src1", "src2"), F.lit(False))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    plans = [("feeds", "rss", docs.where(first), False), ("maps", "sitemap", docs.where(~first & english), True), ("archive", "archive", docs.where(~first & ~english), True)]
    return I.planned(plans).select("plan", "pos", "url")


@query("""WITH e AS (SELECT user_id, event_id // 50 AS page, event_id, CASE WHEN event_id % 3 > 0 THEN ts END AS tm FROM events), floor AS (SELECT min(ts) + INTERVAL 10 DAY AS lo FROM events),
s AS (SELECT user_id, page FROM e, floor GROUP BY user_id, page HAVING count(tm) > 0 AND count(tm) = count(CASE WHEN tm < lo THEN 1 END)), l AS (SELECT user_id, min(page) AS last FROM s GROUP BY user_id)
SELECT event_id FROM e LEFT JOIN l ON e.user_id IS NOT DISTINCT FROM l.user_id WHERE last IS NULL OR page <= last""")
def pages_until_older(spark, sf_dir):
    """Pages of results, newest first, are read until one holds nothing but what is too old."""
    events = L.read(spark, sf_dir, "events")
    floor = events.agg((F.min("ts") + F.expr("interval 10 days")).alias("lo")).first()[0]
    rows = events.select("user_id", F.floor(F.col("event_id") / 50).alias("page"), "event_id", F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("at"))
    return I.until_older(rows, "user_id", "page", "at", F.lit(floor)).select("event_id")


@query("""WITH n AS (SELECT left(p_name, 220) AS t, left(p_type, 800) AS s FROM part) SELECT (SELECT max(id) FROM stories) + row_number() OVER (ORDER BY t, s) AS id, t AS title, s AS summary, 34.0::DOUBLE AS temperature FROM n""".replace("WITH n", ", n"), logical=True)
def created_stories(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.new_stories(t.part.select(F.col("p_name").alias("title"), F.col("p_type").alias("summary")), t.stories, NOW).select("id", "title", "summary", "temperature")


@query(""" SELECT arg_min(story_id, pos) AS story_id, article_id FROM (SELECT o_custkey AS story_id, o_orderkey // 2 AS article_id, o_orderkey AS pos FROM orders) WHERE article_id % 5 <> 0 GROUP BY article_id""".strip())
def attached_articles(spark, sf_dir):
    """Edges from articles to stories: the first one stays, and articles that have a story get no other."""
    orders = L.read(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_custkey").alias("story_id"), F.floor(F.col("o_orderkey") / 2).cast("long").alias("article_id"), F.col("o_orderkey").alias("pos"))
    return I.attached(edges, edges.where("article_id % 5 = 0"))


@query(" SELECT story_id, target_key FROM story_targets WHERE NOT (target_key = 'R' AND story_id % 2 = 0)", logical=True)
def added_story_targets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    edges = t.story_articles.join(t.mentions.select("article_id", "target_key"), "article_id")
    return I.new_story_targets(edges, t.story_targets.where("target_key = 'R' and story_id % 2 = 0"))


@query(f""" SELECT id, CASE WHEN n IS NOT NULL THEN least(100.0::DOUBLE, 22.0::DOUBLE + 9 * n + 6 * k) ELSE temperature END AS temperature, CASE WHEN n IS NOT NULL THEN '{NOW}' ELSE updated_at END AS updated_at
  FROM stories LEFT JOIN (SELECT story_id, count(*) AS n, count(DISTINCT source_name) AS k FROM story_articles JOIN articles ON article_id = id WHERE story_id % 3 = 0 GROUP BY story_id) ON id = story_id""", logical=True)
def touched_stories(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return I.touched(t.stories, A.story_stats(t.story_articles.where("story_id % 3 = 0"), t.articles), NOW).select("id", "temperature", "updated_at")


@query("""WITH e AS (SELECT user_id AS log_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-' || lpad(event_id::VARCHAR, 12, '0') AS tm, event_type AS source_name, CASE WHEN event_type = 'view' THEN 'running' ELSE 'ok' END AS status, event_id AS n FROM events)
SELECT log_id, min(tm) AS started_at, max(CASE WHEN status <> 'running' THEN tm END) AS finished_at, arg_min(source_name, tm) AS source_name, arg_max(status, tm) AS status, arg_max(n, tm) AS articles_found FROM e GROUP BY log_id""")
def run_log(spark, sf_dir):
    """Runs by the events that were logged of them."""
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    status = F.when(F.col("event_type") == "view", "running").otherwise("ok")
    events = L.read(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), at.alias("at"), F.col("event_type").alias("source_name"), F.lit("rss").alias("source_type"), status.alias("status"), F.col("event_id").alias("articles_found"), F.lit(0).alias("mentions_found"), F.lit("").alias("error_message"))
    return I.run_log(events).select("log_id", "started_at", "finished_at", "source_name", "status", "articles_found")


def ingested(spark, sf_dir):
    docs = L.read(spark, sf_dir, "documents").where("source is not null")
    text, k = F.col("text"), F.col("doc_id")
    rows = docs.select(
        F.concat(F.lit("http://h/"), (k % 700).cast("string")).alias("url"), k.alias("pos"), "source", F.regexp_extract(text, r"^\S+", 0).alias("title"), F.lit("").alias("summary"), text.alias("body"), F.lit("2000-06-01").alias("published_at"),
        F.lit(None).cast("string").alias("fetch_error"), F.lit(False).alias("needs_date"), F.lit(False).alias("exact_body"),
    )
    stored = spark.range(0, 700, 7).select(F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"))
    return I.ingest(rows, stored, KEYWORDS, source="source", per_source=400, names={"german": "German", "french": "French"}, date_from="2000-01-01")


INGESTED = r"""WITH c AS (SELECT doc_id AS pos, 'http://h/' || (doc_id % 700) AS url, doc_id % 700 % 7 = 0 AS stored, source, regexp_extract(coalesce(text, ''), '^\S+') AS title, lower(coalesce(regexp_extract(text, '^\S+'), '') || '  ' || coalesce(text, '')) AS low FROM documents WHERE source IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY pos) AS r FROM c), l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS k FROM o WHERE r = 1),
d AS (SELECT *, contains(low, 'idiot')::INT + contains(low, 'worthless')::INT + contains(low, 'the and')::INT + contains(low, 'und der')::INT + contains(low, 'de la')::INT AS hits FROM l WHERE k <= 400),
z AS (SELECT *, CASE WHEN hits = 0 THEN 'no_match_exact_name' WHEN trim(title) = '' OR lower(title) = '(sem titulo)' OR regexp_matches(title, '(?i)(wp-content|comments?)') OR NOT (regexp_matches(lower(title || ' '), 'idiot|worthless')) THEN 'low_article_quality' WHEN stored THEN 'already_in_database' ELSE 'saved' END AS reason FROM d) """


@query(INGESTED + "SELECT source, reason, count(*) AS n FROM z GROUP BY source, reason")
def ingested_decisions(spark, sf_dir):
    """A run over documents as candidates, stored URLs known."""
    return ingested(spark, sf_dir)["decisions"].groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


def ingested_whole(spark, sf_dir):
    """A run in which texts are their own summaries, so that long ones are saved."""
    docs, k = L.read(spark, sf_dir, "documents").where("source is not null"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.concat(F.lit("http://h/"), (k % 700).cast("string")).alias("url"), k.alias("pos"), "source", F.regexp_extract(text, r"^\S+", 0).alias("title"), text.alias("summary"), text.alias("body"), F.lit("2000-06-01").alias("published_at"),
        F.lit(None).cast("string").alias("fetch_error"), F.lit(False).alias("needs_date"), F.lit(False).alias("exact_body"),
    )
    stored = spark.range(0, 700, 7).select(F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"))
    return I.ingest(rows, stored, KEYWORDS, source="source", per_source=400, names={"german": "German", "french": "French"}, date_from="2000-01-01")


SAVED = r"""WITH c AS (SELECT doc_id AS pos, 'http://h/' || (doc_id % 700) AS url, doc_id % 700 % 7 = 0 AS stored, source, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '^\S+') AS title, lower(regexp_extract(coalesce(text, ''), '^\S+') || ' ' || coalesce(text, '') || ' ' || coalesce(text, '')) AS low FROM documents WHERE source IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY pos) AS r FROM c), l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS k FROM o WHERE r = 1),
w AS (SELECT *, [x FOR x IN [{'t': 'insult', 'w': 'idiot'}, {'t': 'insult', 'w': 'worthless'}, {'t': 'article', 'w': 'the and'}, {'t': 'german', 'w': 'und der'}, {'t': 'french', 'w': 'de la'}] IF contains(low, x.w)] AS hits FROM l WHERE k <= 400),
z AS (SELECT *, CASE WHEN len(hits) = 0 THEN 'skipped' WHEN trim(title) = '' OR lower(title) = '(sem titulo)' OR regexp_matches(title || chr(10) || text, '@NOISE') THEN 'skipped' WHEN stored THEN 'duplicate' ELSE 'selected' END AS status FROM w),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS u FROM z WHERE status = 'selected') WHERE u = 1) """.replace("@NOISE", T.SEARCH_NOISE).replace("\\\\", "\\")


@query(SAVED + "SELECT url, title, source AS source_name, left(text, 3000) AS snippet, md5(left(text, 60000)) AS full_text FROM s")
def ingested_articles(spark, sf_dir):
    return ingested_whole(spark, sf_dir)["articles"].select("url", "title", "source_name", "snippet", F.md5("full_text").alias("full_text"))


@query(SAVED + """, h AS (SELECT url, low, unnest(hits) AS h, generate_subscripts(hits, 1) AS i FROM s), f AS (SELECT url, h.t AS target_key, arg_min(h.w, i) AS keyword_matched, any_value(low) AS low FROM h GROUP BY ALL)
SELECT url, target_key, CASE target_key WHEN 'german' THEN 'German' WHEN 'french' THEN 'French' ELSE target_key END AS target_name, keyword_matched FROM (SELECT DISTINCT ON (url, target_key) url, target_key, keyword_matched FROM (SELECT url, h.t AS target_key, h.w AS keyword_matched, i FROM h) ORDER BY url, target_key, i)""")
def ingested_mentions(spark, sf_dir):
    return ingested_whole(spark, sf_dir)["mentions"].select("url", "target_key", "target_name", "keyword_matched")


@query(SAVED + "SELECT source, count(*) AS seen, count(CASE WHEN status = 'selected' THEN 1 END) AS inserted, count(CASE WHEN status = 'duplicate' THEN 1 END) AS duplicates, count(CASE WHEN status = 'skipped' THEN 1 END) AS skipped FROM z GROUP BY source")
def ingested_log(spark, sf_dir):
    return ingested_whole(spark, sf_dir)["log"]


# --- the dataset in full -----------------------------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT doc_id, doc_id % 3 = 0 AS ai, CASE WHEN doc_id % 4 = 0 THEN '' ELSE split_part(text, '.', 1) END AS s, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS f, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'snippet' END AS p FROM documents),
m AS (SELECT doc_id, ai, """ + ", ".join(f"regexp_replace(regexp_replace(array_to_string([trim(regexp_replace(x, '[ \\t]+', ' ', 'g')) FOR x IN string_split(replace(regexp_replace(coalesce({c}, ''), '\\r\\n?', chr(10), 'g'), chr(160), ' '), chr(10))], chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS {c}" for c in ("s", "f", "p")) + """ FROM n),
t AS (SELECT *, coalesce(nullif(s, ''), nullif(p, ''), f) AS v, coalesce(nullif(s, ''), p) AS r FROM m)
SELECT doc_id, CASE WHEN ai AND s <> '' THEN 'Resumo IA' WHEN f <> '' THEN 'Texto bruto' WHEN r <> '' THEN 'Trecho bruto' ELSE 'Sem resumo' END AS label,
  CASE WHEN ai AND s <> '' THEN s WHEN f <> '' THEN CASE WHEN length(v) > 560 THEN rtrim(left(v, 559)) || '...' ELSE v END WHEN r <> '' THEN r ELSE 'Sem conteudo disponivel.' END AS preview,
  CASE WHEN ai AND s <> '' OR f = '' OR (v = f AND length(f) <= 560) THEN '' ELSE md5(f) END AS full_text FROM t""")
def article_payloads(spark, sf_dir):
    """What is shown of each article: summary, excerpt with the text behind it, or a placeholder."""
    k, text = F.col("doc_id"), F.col("text")
    summary, full = F.when(k % 4 == 0, "").otherwise(F.split_part(text, F.lit("."), F.lit(1))), F.when(k % 5 == 0, "").otherwise(text)
    paid = E.article_payload(k % 3 == 0, summary, full, F.when(k % 10 == 0, "").otherwise("snippet"))
    rows = L.read(spark, sf_dir, "documents").select("doc_id", paid.alias("p")).select("doc_id", "p.*")
    return rows.withColumn("full_text", F.when(F.col("full_text") != "", F.md5("full_text")).otherwise(""))


def records_of(spark, sf_dir, url=None):
    """url: in place of the articles' own, of article_id."""
    t = Tables(spark, sf_dir)
    sets = A.mention_sets(t.mentions).select("article_id", F.split("target_keys", ",").alias("target_keys"), (F.col("has_ai_summary") == 1).alias("has_ai"))
    rows = t.articles.withColumnRenamed("id", "article_id").join(sets, "article_id", "left").withColumn("summary", F.col("title")).withColumn("full_text", F.lit("")).withColumn("snippet", F.lit(""))
    rows = rows if url is None else rows.withColumn("url", url)
    keys = t.story_targets.groupBy("story_id").agg(F.array_sort(F.collect_set("target_key")).alias("target_keys"))
    stories = t.stories.join(keys, F.col("id") == F.col("story_id"), "left").drop("story_id")
    return E.story_records(stories, t.story_articles, rows)


RECORDS = SETS + """, a AS (SELECT sa.story_id, x.id, x.title, coalesce(nullif(published_at, ''), discovered_at) AS stamp, nullif(published_at, '') AS day, has_ai_summary = 1 AS ai, coalesce(target_keys, '') AS keys FROM story_articles sa JOIN articles x ON x.id = sa.article_id LEFT JOIN sets ON m = x.id),
g AS (SELECT story_id, min(day) AS f, max(day) AS l, count(*) AS n, count(CASE WHEN ai THEN 1 END) AS k, arg_max(title, row(stamp, id)) FILTER (ai) AS summary FROM a GROUP BY story_id) """


@query(RECORDS + """SELECT s.id AS story, s.title, CASE WHEN g.summary IS NOT NULL THEN 'Resumo IA' ELSE 'Resumo do agrupamento' END AS label, coalesce(g.summary, s.summary) AS text, coalesce(f, created_at) AS "first", coalesce(l, updated_at) AS "last", n AS articles, k AS ai, n - k AS raw FROM stories s JOIN g ON s.id = story_id""", logical=True)
def story_record_heads(spark, sf_dir):
    r = records_of(spark, sf_dir)
    return r.select(F.col("storyIdInt").alias("story"), "title", F.col("summaryLabel").alias("label"), F.col("summaryText").alias("text"), F.col("firstPublishedAt").alias("first"), F.col("lastPublishedAt").alias("last"), F.col("articleCount").alias("articles"), F.col("aiCount").alias("ai"), F.col("rawCount").alias("raw"))


@query(RECORDS + """SELECT story_id AS story, id AS article, title, CASE WHEN ai THEN 'ai' ELSE 'raw' END AS source, CASE WHEN keys <> '' THEN keys ELSE coalesce((SELECT string_agg(target_key, ',' ORDER BY target_key) FROM story_targets st WHERE st.story_id = a.story_id), '') END AS keys FROM a""", logical=True)
def story_record_articles(spark, sf_dir):
    flat = E.flat_articles(records_of(spark, sf_dir))
    return flat.select(F.col("storyIdInt").alias("story"), F.col("articleId").alias("article"), "title", F.col("summarySource").alias("source"), F.array_join("targetKeys", ",").alias("keys"))


@query(RECORDS + """SELECT count(*) AS "totalStories", sum(n)::BIGINT AS "totalArticles", sum(k)::BIGINT AS "totalAi", sum(n - k)::BIGINT AS "totalRaw", count(CASE WHEN v THEN 1 END) AS "initialStoryCount", coalesce(sum(n) FILTER (v), 0)::BIGINT AS "initialArticleCount",
  'Historico completo' AS "scopeKicker", 'Alpha' AS "defaultTargetLabel" FROM (SELECT *, EXISTS (SELECT 1 FROM story_targets st WHERE st.story_id = g.story_id AND target_key = 'A') AS v FROM g)""", logical=True)
def dataset_meta_in_full(spark, sf_dir):
    made = E.meta(records_of(spark, sf_dir), E.initial_targets(["A", "N", "R"], "A"), generated_at=NOW, default_label="Alpha")
    return made.select("totalStories", "totalArticles", "totalAi", "totalRaw", "initialStoryCount", "initialArticleCount", "scopeKicker", "defaultTargetLabel")


@query(RECORDS + "SELECT max(story_id) + 100 AS story, max(id) + 1000 AS article FROM a", logical=True)
def moved_records(spark, sf_dir):
    """The greatest numbers of records that were moved."""
    return E.last_numbers(E.moved(records_of(spark, sf_dir), 100, 1000))


def report_articles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sets = A.mention_sets(t.mentions).select("article_id", F.split("target_keys", ",").alias("target_keys"), F.split("target_names", ",").alias("target_names"))
    return t.articles.where("id % 3 > 0").withColumnRenamed("id", "article_id").join(sets, "article_id").select("article_id", "title", "target_keys", "target_names"), t


@query(SETS + """, w AS (SELECT id, title, target_keys FROM articles JOIN sets ON m = id WHERE id % 3 > 0), edges AS (SELECT * FROM story_articles WHERE article_id % 5 > 0),
r AS (SELECT e.story_id, coalesce(string_agg(w.id, ',' ORDER BY w.id), '') AS ids FROM edges e LEFT JOIN w ON w.id = e.article_id GROUP BY e.story_id),
k AS (SELECT e.story_id, string_agg(DISTINCT x.k, ',' ORDER BY x.k) AS keys FROM edges e JOIN (SELECT id, unnest(string_split(target_keys, ',')) AS k FROM w) x ON x.id = e.article_id GROUP BY e.story_id)
SELECT r.story_id::VARCHAR AS story_id, s.title, ids, coalesce(keys, '') AS keys FROM r LEFT JOIN k USING (story_id) LEFT JOIN stories s ON s.id = r.story_id UNION ALL SELECT 'auto-' || id, title, id::VARCHAR, target_keys FROM w WHERE id NOT IN (SELECT article_id FROM edges)""", logical=True)
def report_stories(spark, sf_dir):
    rows, t = report_articles(spark, sf_dir)
    made = E.stories_by_size(rows, t.story_articles.where("article_id % 5 > 0"), t.stories)
    return made.select("story_id", "title", F.array_join(F.transform("article_ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join("target_keys", ",").alias("keys"))


@query(" SELECT DISTINCT target_key AS key, target_name AS label FROM mentions WHERE article_id % 3 > 0", logical=True)
def report_targets(spark, sf_dir):
    rows, _ = report_articles(spark, sf_dir)
    return E.first_seen_targets(rows, "article_id")


@query("""WITH k(ord, pos, key, word) AS (VALUES (0, 0, 'a', 'The'), (0, 1, 'a', 'und'), (1, 0, 'b', 'the'), (1, 1, 'b', 'que')), l AS (SELECT lower(word) AS low, arg_max(key, (ord, pos)) AS key, min(ord * 10 + pos) AS place FROM k GROUP BY lower(word))
SELECT doc_id, low, key FROM documents, l WHERE contains(lower(text), low)""")
def keyword_targets(spark, sf_dir):
    """Documents by the keywords of targets: a keyword of several targets is the last one's."""
    targets = spark.sql("SELECT * FROM VALUES ('a', 'A', 0, array('The', 'und')), ('b', 'B', 1, array('the', 'que')) AS t(key, name, ord, keywords)")
    words = C.keyword_map(targets).select("low", "key")
    return L.read(spark, sf_dir, "documents").join(F.broadcast(words), F.contains(F.lower("text"), F.col("low"))).select("doc_id", "low", "key")  # a few keywords


# --- snapshots and gold lists ------------------------------------------------------------------------------------------------------------------


def snapshot_pages(spark, sf_dir):
    """Stories as cards of HTML, a page for each of a hundred groups, with an article in each."""
    t = Tables(spark, sf_dir)
    card = F.concat(
        F.lit('<details class="x" data-story-id="'), F.col("id").cast("string"), F.lit('" data-temperature="'), F.col("temperature").cast("string"), F.lit('" data-targets="a,b"><summary><h2>'), "title",
        F.lit('</h2></summary><details>inner</details><article class="article-card" id="article-'), (F.col("id") + 1).cast("string"), F.lit('"><h3><a href="http://www.a.com/'), F.col("id").cast("string"),
        F.lit('">'), "summary", F.lit("</a></h3></article></details><p>after</p>"),
    )
    return t.stories.select((F.col("id") % 100).alias("page"), "id", card.alias("card")).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "card"))), lambda x: x["card"]), "\n").alias("html"))


@query(" SELECT id % 100 AS page, id AS story, title, temperature, 'a,b' AS keys, 1::BIGINT AS articles FROM stories", logical=True)
def snapshot_stories(spark, sf_dir):
    rows = snapshots.card_stories(snapshots.cards(snapshot_pages(spark, sf_dir)))
    return rows.select("page", "story", "title", "temperature", F.array_join("target_keys", ",").alias("keys"), F.col("article_count").alias("articles"))


@query(" SELECT id AS story, id + 1 AS article, summary AS title, 'http://www.a.com/' || id AS url, 'a.com' AS source_host FROM stories", logical=True)
def snapshot_articles(spark, sf_dir):
    return snapshots.card_articles(snapshots.cards(snapshot_pages(spark, sf_dir))).select("story", "article", "title", "url", "source_host")


@query(" SELECT DISTINCT url FROM articles WHERE starts_with(url, 'https://h3.example/') AND id IN (SELECT article_id FROM mentions WHERE target_key = 'R')", logical=True)
def saved_urls(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return V.saved_urls(t.articles, t.mentions, "R", "h3.example")
