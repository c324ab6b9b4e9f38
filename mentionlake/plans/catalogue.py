"""Registered queries and their DuckDB oracles, one pair for each, side by side."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionlake.functions import dates as D
from mentionlake.functions import html as H
from mentionlake.functions import similarity as S
from mentionlake.functions import text as T
from mentionlake.functions import url as U
from mentionlake.operators import articles as A
from mentionlake.operators import candidates as C
from mentionlake.operators import evaluate as V
from mentionlake.operators import export as X
from mentionlake.operators import persist as P
from mentionlake.operators import stories as R
from mentionlake.sources import adapters as L
from mentionlake.sources.settle import shared_folder
from mentionlake.streaming.story_store import StoryStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-08-01"
TARGETS = [("A", "Alpha", True, 0), ("N", "November", False, 1)]
KEYWORDS = [("insult", "idiot"), ("insult", "worthless"), ("article", "the and"), ("german", "und der"), ("french", "de la")]
POSITIVE, NEGATIVE = ["the", "and of", "elle", "ung"], ["idiot", "ou", "que", "worthless"]


def query(oracle: str | None = None, logical: bool = False):
    """Registers a function by its name, with the SQL that gives the same rows; logical: the SQL reads the logical tables."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH {L.LOGICAL}{oracle}" if logical else oracle
        return f

    return register


class Tables:
    """The logical tables, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("articles", "mentions", "stories", "story_articles", "story_targets"):
            return getattr(L, name)(*self._at)
        return L.read(*self._at, name)

    def decorated(self) -> DataFrame:
        return X.decorate(self.stories, self.story_articles, self.articles, self.mentions)


# --- lists of articles -------------------------------------------------------------------------------------------------------------------------

SETS = """, sets AS (SELECT article_id AS m, string_agg(DISTINCT target_key, ',' ORDER BY target_key) AS target_keys, string_agg(DISTINCT target_name, ',' ORDER BY target_name) AS target_names,
  string_agg(DISTINCT keyword_matched, ',' ORDER BY keyword_matched) AS keywords, max(CASE WHEN sentiment_reason IN ('agent_summary', 'model_summary') THEN 1 ELSE 0 END)::INTEGER AS has_ai_summary,
  min(sentiment) AS min_sentiment, arg_min(sentiment, id) AS first_sentiment, count(*) AS n_mentions FROM mentions GROUP BY article_id)"""
EXPORT = """ SELECT a.id, url, title, source_name, source_type, published_at, discovered_at, story_id, target_keys, target_names, keywords, has_ai_summary
  FROM articles a JOIN sets ON a.id = m LEFT JOIN story_articles sa ON sa.article_id = a.id WHERE {} ORDER BY coalesce(published_at, discovered_at) DESC, a.id LIMIT {}"""
WINDOW = "coalesce(published_at, discovered_at) >= '1996-01-01' AND coalesce(published_at, discovered_at) <= '2000-12-31T23:59:59'"


@query(SETS + EXPORT.format(WINDOW, 5000), logical=True)
def export_articles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.export_articles(t.articles, t.mentions, t.story_articles, date_from="1996-01-01", date_to="2000-12-31T23:59:59")


@query(SETS + EXPORT.format(WINDOW + " AND EXISTS (SELECT 1 FROM mentions x WHERE x.article_id = a.id AND x.target_key IN ('R'))", 5000), logical=True)
def export_articles_by_target(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.export_articles(t.articles, t.mentions, t.story_articles, date_from="1996-01-01", date_to="2000-12-31T23:59:59", target_keys=["R"])


@query(SETS + EXPORT.format("EXISTS (SELECT 1 FROM mentions x WHERE x.article_id = a.id AND coalesce(x.sentiment_reason, '') NOT IN ('agent_summary', 'model_summary'))", 200), logical=True)
def llm_batch_pending(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.export_articles(t.articles, t.mentions, t.story_articles, only_pending=True, limit=200)


@query(SETS + """ SELECT 'a-' || a.id AS article_id, CASE WHEN story_id IS NOT NULL THEN 'st-' || story_id ELSE '' END AS story_id, title, url, source_name, source_type, coalesce(nullif(published_at, ''), discovered_at) AS published_at, coalesce(target_keys, '') AS target_keys, coalesce(target_names, '') AS target_names, coalesce(keywords, '') AS keywords,
  coalesce(first_sentiment, 'neutral') AS sentiment, CASE WHEN has_ai_summary = 1 THEN 'llm' ELSE 'raw' END AS summary_source, coalesce(n_mentions, 0) AS n_mentions
  FROM articles a LEFT JOIN sets ON a.id = m LEFT JOIN story_articles sa ON sa.article_id = a.id ORDER BY coalesce(published_at, discovered_at) DESC, a.id LIMIT 300""", logical=True)
def list_articles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.list_articles(t.articles, t.mentions, t.story_articles)


@query(SETS + " SELECT a.id, url, title, source_name, published_at, target_keys, target_names, keywords, has_ai_summary FROM articles a JOIN sets ON a.id = m WHERE a.id IN (SELECT user_id FROM events WHERE user_id > 0)", logical=True)
def articles_by_ids(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.articles_by_ids(t.articles, t.mentions, t.events.select(F.col("user_id").alias("id")))


@query(" SELECT (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM mentions) AS mentions", logical=True)
def counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.articles.agg(F.count(F.lit(1)).alias("articles")).crossJoin(t.mentions.agg(F.count(F.lit(1)).alias("mentions")))  # one row each


@query(SETS + " SELECT m AS article_id, min_sentiment, first_sentiment, has_ai_summary, n_mentions FROM sets", logical=True)
def mention_summary(spark, sf_dir):
    return A.mention_sets(Tables(spark, sf_dir).mentions).select("article_id", "min_sentiment", "first_sentiment", "has_ai_summary", "n_mentions")


# --- stories -----------------------------------------------------------------------------------------------------------------------------------


@query(f" SELECT * FROM stories WHERE CAST(left(updated_at, 10) AS DATE) >= DATE '{AS_OF}' - 60", logical=True)
def recent_stories(spark, sf_dir):
    return A.recent_stories(Tables(spark, sf_dir).stories, AS_OF, 60)


CONTEXT = """ SELECT s.id, s.title, s.temperature, s.updated_at, {} AS article_count, coalesce(string_agg(DISTINCT st.target_key, ',' ORDER BY st.target_key), '') AS target_keys
  FROM stories s LEFT JOIN story_articles sa ON sa.story_id = s.id LEFT JOIN story_targets st ON st.story_id = s.id WHERE CAST(left(updated_at, 10) AS DATE) >= DATE '2001-08-01' - 365
  GROUP BY s.id, s.title, s.temperature, s.updated_at ORDER BY s.updated_at DESC, s.temperature DESC, s.id LIMIT 160"""


@query(CONTEXT.format("count(sa.article_id)"), logical=True)
def story_context_fanout(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.story_context(t.stories, t.story_articles, t.story_targets, as_of=AS_OF)


@query(CONTEXT.format("count(DISTINCT sa.article_id)"), logical=True)
def story_context_fixed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.story_context(t.stories, t.story_articles, t.story_targets, as_of=AS_OF, fan_out=False)


@query(""" SELECT story_id, count(article_id) AS articles, count(DISTINCT source_name) AS sources, least(100.0::DOUBLE, greatest(0.0::DOUBLE, 22.0::DOUBLE + 9 * count(article_id) + 6 * count(DISTINCT source_name))) AS temperature
  FROM story_articles JOIN articles ON article_id = id GROUP BY story_id""", logical=True)
def story_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.story_stats(t.story_articles, t.articles)


@query(SETS + """, items AS (SELECT story_id, coalesce(nullif(published_at, ''), discovered_at) AS at, a.id, coalesce(min_sentiment, 'neutral') AS s, coalesce(has_ai_summary, 0) AS ai
  FROM story_articles sa JOIN articles a ON a.id = sa.article_id LEFT JOIN sets ON a.id = m)
SELECT s.id, s.title, count(*) AS n, string_agg(i.at || '|' || i.id || '|' || i.s || '|' || i.ai, ';' ORDER BY i.at DESC, i.id DESC) AS articles FROM stories s JOIN items i ON s.id = i.story_id GROUP BY s.id, s.title""", logical=True)
def story_nested(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nested = A.story_nested(t.stories, t.story_articles, t.articles, t.mentions)
    flat = F.transform("articles", lambda a: F.concat_ws("|", a["at"], a["article_id"].cast("string"), a["sentiment"], a["has_ai"].cast("string")))
    return nested.select("id", "title", F.size("articles").cast("long").alias("n"), F.array_join(flat, ";").alias("articles"))


# --- the dashboard dataset ---------------------------------------------------------------------------------------------------------------------

DECORATED = SETS + """, counted AS (SELECT story_id, min(nullif(published_at, '')) AS f, max(nullif(published_at, '')) AS l, count(*) AS article_count, sum(coalesce(has_ai_summary, 0))::BIGINT AS ai_count
  FROM story_articles sa JOIN articles a ON a.id = sa.article_id LEFT JOIN sets ON a.id = m GROUP BY story_id),
decorated AS (SELECT s.id, s.title, s.temperature, coalesce(f, created_at) AS first_published_at, coalesce(l, updated_at) AS last_published_at, article_count, ai_count, article_count - ai_count AS raw_count FROM stories s JOIN counted ON s.id = story_id)"""
TOTALS = " SELECT count(*) AS stories, coalesce(sum(article_count), 0)::BIGINT AS articles, coalesce(sum(ai_count), 0)::BIGINT AS ai, coalesce(sum(raw_count), 0)::BIGINT AS raw FROM decorated d{}"


@query(DECORATED + " SELECT * FROM decorated", logical=True)
def decorate_stories(spark, sf_dir):
    return Tables(spark, sf_dir).decorated()


@query(DECORATED + """ SELECT target_key, CASE target_key WHEN 'A' THEN 'Alpha' WHEN 'N' THEN 'November' ELSE target_key END AS label, target_key = 'A' AS primary, count(*) AS story_count, sum(article_count)::BIGINT AS article_count
  FROM story_targets st JOIN decorated d ON st.story_id = d.id GROUP BY target_key""", logical=True)
def target_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return X.target_rows(t.decorated(), t.story_targets, spark.createDataFrame(TARGETS, "key string, label string, primary boolean, ord int"))


@query(DECORATED + TOTALS.format(" WHERE EXISTS (SELECT 1 FROM story_targets st WHERE st.story_id = d.id AND st.target_key IN ('A', 'R'))"), logical=True)
def visibility_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return X.totals(X.with_targets(t.decorated(), t.story_targets).where(X.visible(F.col("keys"), ["A", "R"])))


@query(DECORATED + TOTALS.format(" WHERE EXISTS (SELECT 1 FROM story_targets st WHERE st.story_id = d.id AND st.target_key = 'N') OR NOT EXISTS (SELECT 1 FROM story_targets st WHERE st.story_id = d.id)"), logical=True)
def visible_in_browser(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return X.totals(X.with_targets(t.decorated(), t.story_targets).where(X.visible(F.col("keys"), ["N"], without_keys=True)))


@query(DECORATED + TOTALS.format(""), logical=True)
def dataset_meta(spark, sf_dir):
    return X.totals(Tables(spark, sf_dir).decorated())


@query(DECORATED + """, urls AS (SELECT sa.story_id, a.id, CASE WHEN a.id % 17 = 0 THEN '' ELSE 'https://e/' || (a.id % 5000) END AS u, coalesce(has_ai_summary, 0) AS ai, d.last_published_at, d.temperature
  FROM story_articles sa JOIN articles a ON a.id = sa.article_id JOIN decorated d ON d.id = sa.story_id LEFT JOIN sets ON a.id = m),
ranked AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY last_published_at DESC, temperature DESC, story_id, id) AS r FROM urls)
SELECT story_id, count(*) AS article_count, sum(ai)::BIGINT AS ai_count, sum(1 - ai)::BIGINT AS raw_count FROM ranked WHERE r = 1 OR u = '' GROUP BY story_id""", logical=True)
def export_url_dedup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ai = A.mention_sets(t.mentions).select("article_id", F.col("has_ai_summary").alias("ai"))
    url = F.when(F.col("article_id") % 17 == 0, "").otherwise(F.concat(F.lit("https://e/"), (F.col("article_id") % 5000).cast("string")))
    rows = t.story_articles.join(t.decorated().select(F.col("id").alias("story_id"), "last_published_at", "temperature"), "story_id").join(ai, "article_id", "left")
    return X.dedup_story_urls(rows.withColumn("url", url).withColumn("ai", F.coalesce("ai", F.lit(0))))


@query(DECORATED + " SELECT id, title, temperature, last_published_at FROM decorated ORDER BY temperature DESC, last_published_at DESC, id LIMIT 50 OFFSET 50", logical=True)
def stories_hottest_page(spark, sf_dir):
    return Tables(spark, sf_dir).decorated().select("id", "title", "temperature", "last_published_at").orderBy(F.desc("temperature"), F.desc("last_published_at"), "id").offset(50).limit(50)


@query(""" SELECT d.id AS story_id, a.id AS article_id, a.title, coalesce(nullif(published_at, ''), discovered_at) AS "at" FROM stories d JOIN story_articles sa ON sa.story_id = d.id JOIN articles a ON a.id = sa.article_id
  ORDER BY "at" DESC, a.title, a.id LIMIT 50""", logical=True)
def flat_articles_newest(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.stories.select(F.col("id").alias("story_id")).join(t.story_articles, "story_id").join(t.articles.select(F.col("id").alias("article_id"), "title", A.effective_date("python").alias("at")), "article_id")
    return rows.select("story_id", "article_id", "title", "at").orderBy(F.desc("at"), "title", "article_id").limit(50)


@query(""" SELECT 'auto-' || id AS story_id, title, 1::BIGINT AS articles FROM articles WHERE id NOT IN (SELECT article_id FROM story_articles WHERE article_id % 5 <> 0)
  UNION ALL SELECT 'st-' || story_id, max(title), count(*) FROM story_articles JOIN articles ON article_id = id WHERE article_id % 5 <> 0 GROUP BY story_id""", logical=True)
def singleton_stories(spark, sf_dir):
    t = Tables(spark, sf_dir)
    edges = t.story_articles.where("article_id % 5 <> 0")  # every fifth article belongs to no story
    alone = t.articles.join(edges, F.col("id") == F.col("article_id"), "left_anti").select(F.concat(F.lit("auto-"), F.col("id").cast("string")).alias("story_id"), "title", F.lit(1).cast("long").alias("articles"))
    rest = edges.join(t.articles, F.col("article_id") == F.col("id")).groupBy("story_id").agg(F.max("title").alias("title"), F.count(F.lit(1)).alias("articles"))
    return alone.union(rest.select(F.concat(F.lit("st-"), F.col("story_id").cast("string")), "title", "articles"))


@query(" SELECT id, title, 'new' AS origin FROM stories WHERE temperature >= 50 UNION ALL SELECT id, title, 'old' FROM stories WHERE temperature < 80 AND id NOT IN (SELECT id FROM stories WHERE temperature >= 50)", logical=True)
def merge_snapshots(spark, sf_dir):
    s = Tables(spark, sf_dir).stories
    part = lambda rows, origin: rows.select("id", "title", F.lit(origin).alias("origin"))
    return X.merge(part(s.where("temperature < 80"), "old"), part(s.where("temperature >= 50"), "new"))


@query(" SELECT id + (SELECT max(id) FROM stories) AS id, title FROM stories", logical=True)
def remap_ids(spark, sf_dir):
    s = Tables(spark, sf_dir).stories.select("id", "title")
    return X.remap(s, s)


# --- URLs and pages ----------------------------------------------------------------------------------------------------------------------------

PARTS = """WITH parts AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS auth,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*\\?([^#]*)', 1) AS q FROM pages),
cut AS (SELECT *, [p FOR p IN string_split(q, '&') IF contains(p, '=') AND NOT ends_with(p, '=') AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid',
  'gclsrc', 'dclid', 'msclkid', 'ref', 'ref_src', 'ref_url', '_ga', 'mc_cid', 'mc_eid'], lower(string_split(p, '=')[1]))] AS kept FROM parts),
canon AS (SELECT page_id, scheme, auth, path, scheme || '://' || regexp_replace(regexp_replace(auth, '^.*@', ''), ':(80|443)$', '') || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS canonical FROM cut) """


@query(PARTS + " SELECT page_id, canonical, regexp_replace(auth, '^www\\.', '') AS host, replace(auth, 'www.', '') AS host_everywhere, scheme || '://' || auth || regexp_replace(path, '/+$', '') AS without_query FROM canon")
def canonical_url(spark, sf_dir):
    u = F.col("url")
    return L.read(spark, sf_dir, "pages").select("page_id", U.canonical(u).alias("canonical"), U.host_of(u).alias("host"), U.host_everywhere(u).alias("host_everywhere"), U.without_query(u).alias("without_query"))


@query(PARTS + " SELECT canonical AS url, min(page_id) AS page_id FROM canon GROUP BY canonical")
def pages_dedup_by_url(spark, sf_dir):
    return C.dedup_by_canonical_url(L.read(spark, sf_dir, "pages").select("page_id", "url"), "page_id")


@query(PARTS + """ SELECT page_id, scheme IN ('http', 'https') AND path NOT IN ('', '/') AND NOT regexp_matches(lower(path), '\\.(jpg|jpeg|png|gif|webp|svg|js|css|pdf|xml|php)$')
  AND NOT regexp_matches(lower(path), '/feed|/rss|/wp-content|/tag/|/author/|/category/|/comentarios|/search/|/vereadores/|/atividade-parlamentar/|/comissoes/|/frentes/')
  AND len([s FOR s IN string_split(lower(path), '/') IF length(s) >= 12]) > 0 AS likely, regexp_matches(url, '^http.*(e|n)[a-z]*[.]example[.](com|net)') AND page_id % 3 <> 1 AS likely_titled FROM canon JOIN pages USING (page_id)""")
def likely_article_url(spark, sf_dir):
    """Whether URLs look like articles: as they are, and with a title behind them (a third as a page of a tag)."""
    pages = L.read(spark, sf_dir, "pages")
    titled = F.concat(U.without_query(F.col("url")), F.when(F.col("page_id") % 3 == 1, F.lit("/tag/")).otherwise(F.lit("/")), F.lit("a-title-of-some-length"))
    near = F.col("url").rlike("^http.*(e|n)[a-z]*[.]example[.](com|net)")
    return pages.select("page_id", U.likely_article(F.col("url")).alias("likely"), (near & U.likely_article(titled)).alias("likely_titled"))


#: White space by Unicode, for DuckDB.
SQL_BLANK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def entities_read(source: str) -> str:
    """SQL for common table expressions: of source (page_id, ord, t), plain has t with its entities read by the standard's rule: names, old names without a semicolon, numbers."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    names = ", ".join(f"({quoted(k[:-1])}, {quoted(v)})" for k, v in html5.items() if k.endswith(";"))
    bare = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
    old = ", ".join(str(ord(bytes([b]).decode("cp1252", "ignore") or chr(b))) for b in range(128, 160))
    return rf"""named(name, said) AS (VALUES {names}), source AS (SELECT row_number() OVER () AS k, * FROM ({source})),
parts AS (SELECT k, page_id, ord, unnest(string_split(t, '&')) AS p, generate_subscripts(string_split(t, '&'), 1) AS i FROM source),
cut AS (SELECT *, regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1) AS name, regexp_extract(p, '^({bare})') AS bare, regexp_extract(p, '^#(?:[xX][0-9a-fA-F]+|[0-9]+);?') AS number, ltrim(regexp_extract(p, '^#[xX]?([0-9a-fA-F]+)', 1), '0') AS hexa, ltrim(regexp_extract(p, '^#([0-9]+)', 1), '0') AS deci FROM parts),
coded AS (SELECT *, CASE WHEN regexp_matches(number, '^#[xX]') THEN CASE WHEN length(hexa) <= 8 THEN ('0x0' || hexa)::BIGINT END WHEN length(deci) <= 8 THEN ('0' || deci)::BIGINT END AS code FROM cut),
given AS (SELECT k, page_id, ord, i, CASE WHEN i = 1 THEN p WHEN number <> '' THEN CASE WHEN code IS NULL OR code = 0 OR code BETWEEN 55296 AND 57343 OR code > 1114111 THEN chr(65533) WHEN code BETWEEN 128 AND 159 THEN chr([{old}][code - 127])
    WHEN code BETWEEN 1 AND 8 OR code = 11 OR code BETWEEN 14 AND 31 OR code = 127 OR code BETWEEN 64976 AND 65007 OR code & 65534 = 65534 THEN '' ELSE chr(code::INTEGER) END || p[length(number) + 1:]
  WHEN n.said IS NOT NULL THEN n.said || p[length(c.name) + 2:] WHEN b.said IS NOT NULL THEN b.said || p[length(bare) + 1:] ELSE '&' || p END AS p
  FROM coded c LEFT JOIN named n ON n.name = c.name LEFT JOIN named b ON b.name = c.bare),
plain AS (SELECT page_id, ord, string_agg(p, '' ORDER BY i) AS t FROM given GROUP BY k, page_id, ord) """


def _content(key: str, value: str) -> str:
    """SQL: the first content that is not empty of the meta elements whose attribute is of this value."""
    of = lambda name: rf"""coalesce(nullif(regexp_extract(x, '(?is)\s{name}\s*=\s*"([^"]*)"', 1), ''), regexp_extract(x, '(?is)\s{name}\s*=\s*''([^'']*)''', 1))"""
    return rf"[c FOR c IN [{of('content')} FOR x IN regexp_extract_all(html, '(?is)<meta\s[^>]*>') IF lower({of(key)}) = '{value}'] IF c <> ''][1]"


TITLES = f"""SELECT page_id, unnest([1, 2, 3]) AS ord, unnest([{_content("property", "og:title")}, {_content("name", "twitter:title")}, regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)]) AS t FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)"""


@query(f"WITH {entities_read(f"SELECT page_id, ord, coalesce(t, '') AS t FROM ({TITLES})")}, shown AS (SELECT page_id, ord, trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '{SQL_BLANK}', ' ', 'g')) AS t FROM plain) SELECT page_id, coalesce(arg_min(t, ord) FILTER (t <> ''), '') AS title FROM shown GROUP BY page_id")
def html_title(spark, sf_dir):
    return L.read(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"))


#: Tags in either case of ASCII; ignoring case, DuckDB would take a long s for an s too.
UNSHOWN = "([sS][cC][rR][iI][pP][tT]|[sS][tT][yY][lL][eE])"


@query(f"WITH {entities_read(f"SELECT page_id, 1 AS ord, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<{UNSHOWN}[^>]*>.*?</{UNSHOWN}>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages")} SELECT page_id, trim(regexp_replace(regexp_replace(t, 'https?://[^\\t-\\r ]+', ' ', 'g'), '{SQL_BLANK}', ' ', 'g')) AS body FROM plain")
def html_to_text(spark, sf_dir):
    return L.read(spark, sf_dir, "pages").select("page_id", H.html_to_text(F.col("html")).alias("body"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=[\"'']([^\"''#]+)[\"'']', 1)) AS href FROM pages")
def page_links(spark, sf_dir):
    return L.read(spark, sf_dir, "pages").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("href"))


# --- texts -------------------------------------------------------------------------------------------------------------------------------------

HITS = """WITH kw(ord, target_key, keyword) AS (VALUES (0, 'insult', 'idiot'), (1, 'insult', 'worthless'), (2, 'article', 'the and'), (3, 'german', 'und der'), (4, 'french', 'de la')),
hits AS (SELECT doc_id, ord, target_key, keyword, (strpos(lower(text), keyword) - 1)::INTEGER AS position FROM documents CROSS JOIN kw WHERE strpos(lower(text), keyword) > 0) """


@query(HITS + "SELECT * FROM hits")
def keyword_hits(spark, sf_dir):
    return C.keyword_hits(L.read(spark, sf_dir, "documents").select("doc_id", "text"), KEYWORDS)


@query(HITS + "SELECT doc_id, target_key, arg_min(keyword, ord) AS keyword, arg_min(position, ord) AS position FROM hits GROUP BY ALL")
def mentions_dedup(spark, sf_dir):
    return C.first_hit_per_target(C.keyword_hits(L.read(spark, sf_dir, "documents").select("doc_id", "text"), KEYWORDS), "doc_id")


@query("""WITH d AS (SELECT doc_id, contains(text, 'the')::INT + contains(text, 'and of')::INT + contains(text, 'elle')::INT + contains(text, 'ung')::INT
  - contains(text, 'idiot')::INT - contains(text, 'ou')::INT - contains(text, 'que')::INT - contains(text, 'worthless')::INT AS delta FROM documents)
SELECT doc_id, CASE WHEN delta >= 3 THEN 'very_positive' WHEN delta > 0 THEN 'positive' WHEN delta <= -3 THEN 'very_negative' WHEN delta < 0 THEN 'negative' ELSE 'neutral' END AS sentiment FROM d""")
def infer_sentiment(spark, sf_dir):
    return L.read(spark, sf_dir, "documents").select("doc_id", T.sentiment(F.col("text"), POSITIVE, NEGATIVE).alias("sentiment"))


@query("SELECT doc_id, contains(text, 'und') OR contains(text, 'idiot') AS some, contains(text, 'the') AND contains(text, 'and') AS every FROM documents")
def forced_terms(spark, sf_dir):
    text = F.col("text")
    return L.read(spark, sf_dir, "documents").select("doc_id", T.passes_terms(text, ["und", "idiot", "ab"]).alias("some"), T.passes_terms(text, ["the", "and"], "all").alias("every"))


WS = r"[\s\x{00A0}\x{0085}\x{2028}\x{2029}]"


@query(rf"""WITH plain AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g'), 'https?://\S+', ' ', 'g') AS p FROM documents),
cut AS (SELECT doc_id, p, [y FOR y IN [regexp_replace(x, '^{WS}+|{WS}+$', '', 'g') FOR x IN string_split(regexp_replace(p, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1))] IF y <> ''] AS s FROM plain),
good AS (SELECT doc_id, p, s, [x FOR x IN s IF NOT regexp_matches(x, '{T.SEARCH_NOISE}') AND len([w FOR w IN string_split_regex(x, '{WS}+') IF w <> '']) >= 6] AS g FROM cut)
SELECT doc_id, CASE WHEN len(s) = 0 THEN left(p, 420) ELSE left(array_to_string((CASE WHEN len(g) > 0 THEN g ELSE s END)[1:3], ' '), 700) END AS summary FROM good""")
def summarize(spark, sf_dir):
    return L.read(spark, sf_dir, "documents").select("doc_id", T.summarize(F.col("text")).alias("summary"))


NORMAL = r"regexp_replace(regexp_replace(array_to_string([trim(regexp_replace(x, '[ \t]+', ' ', 'g')) FOR x IN string_split(replace(regexp_replace(coalesce({}, ''), '\r\n?', chr(10), 'g'), chr(160), ' '), chr(10))], chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"WITH n AS (SELECT doc_id, {NORMAL.format('text')} AS p FROM documents) SELECT doc_id, CASE WHEN length(p) > 420 THEN rtrim(left(p, 419)) || '...' ELSE p END AS excerpt FROM n")
def excerpt(spark, sf_dir):
    return L.read(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


TOKENS = f"[w FOR w IN list_distinct(string_split_regex({NORMAL.format('text')}, '\\s+')) IF length(w) >= 4 AND NOT list_contains([{', '.join(repr(w) for w in T.STOP_WORDS)}], w)]"


@query(f"SELECT doc_id, array_to_string(list_sort({TOKENS}), ' ') AS tokens FROM documents")
def significant_tokens(spark, sf_dir):
    return L.read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.significant_tokens(F.col("text"))), " ").alias("tokens"))


@query("SELECT doc_id, round(length(text)::DOUBLE / greatest(len(string_split(text, ' ')), 1), 6) AS mean_word, split_part(text, chr(10), 1) AS first_line FROM documents")
def document_shape(spark, sf_dir):
    return L.read(spark, sf_dir, "documents").select("doc_id", F.round(F.length("text") / F.greatest(F.size(F.split("text", " ")), F.lit(1)), 6).alias("mean_word"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("first_line"))


@query()
def title_similarity(spark, sf_dir):
    """Titles of documents that start with the same three words, against the first of them: the ratio needs Python, so there is no SQL."""
    titled = L.read(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(80)).alias("title"))
    keyed = titled.withColumn("key", F.substring_index("title", " ", 3))
    first = keyed.groupBy("key").agg(F.min_by(F.struct("doc_id", "title"), "doc_id").alias("first"))
    pairs = keyed.join(first, "key").where(F.col("doc_id") != F.col("first.doc_id"))
    return pairs.select("doc_id", F.col("first.doc_id").alias("first_id"), F.round(S.similarity(F.col("title"), F.col("first.title")), 6).alias("similarity"))


# --- candidates --------------------------------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place FROM conversations")
def round_robin(spark, sf_dir):
    rows = L.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return C.interleave(rows, "conv_id", "turn", "role").orderBy("place", "conv_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 10")
def limit_per_source(spark, sf_dir):
    return C.limit_per(L.read(spark, sf_dir, "documents").select("source", "doc_id"), "source", 10, "doc_id")


DECISIONS = r"""WITH c AS (SELECT d.doc_id, d.source, trim(left(d.text, 80)) AS title, substr(d.text, 81, 200) AS summary, d.text AS body,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE strftime(DATE '2000-01-01' + (doc_id % 400)::INTEGER, '%Y-%m-%d') END AS published_at, doc_id % 7 = 0 AS needs_date, doc_id % 5 = 0 AS exact_body, doc_id % 4 = 0 AS stored,
  CASE WHEN doc_id % 23 = 0 THEN 'timeout' END AS fetch_error, contains(lower(d.text), 'the') OR contains(lower(d.text), 'und') AS hit, contains(lower(left(d.text, 280)), 'the') OR contains(lower(left(d.text, 280)), 'und') AS preview FROM documents d),
q AS (SELECT *, published_at = '' OR (published_at >= '2000-02-01' AND published_at <= '2000-12-31') AS inside,
  trim(title) = '' OR lower(title) = '(sem titulo)' OR regexp_matches(title, '@NOISE') OR regexp_matches(summary, '@NOISE') AS noise,
  len([w FOR w IN string_split_regex(summary, '\s+') IF w <> '']) < 20 AS short FROM c),
decided AS (SELECT doc_id, source, CASE WHEN NOT needs_date AND NOT inside THEN 'outside_date_window' WHEN fetch_error IS NOT NULL THEN 'fetch_fail:' || fetch_error WHEN needs_date AND published_at = '' THEN 'missing_published_at'
  WHEN NOT hit THEN 'no_match_exact_name' WHEN exact_body AND trim(body) = '' THEN 'missing_body' WHEN NOT contains(title || ' ' || summary || ' ' || body, 'the') THEN 'forced_terms_not_matched'
  WHEN NOT inside THEN 'outside_date_window' WHEN noise OR (short AND NOT preview) THEN 'low_article_quality' WHEN stored THEN 'already_in_database' ELSE 'saved' END AS reason FROM q),
final AS (SELECT *, CASE reason WHEN 'saved' THEN 'selected' WHEN 'already_in_database' THEN 'duplicate' ELSE 'skipped' END AS status FROM decided) """.replace("@NOISE", T.SEARCH_NOISE)


def decisions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, k = F.col("text"), F.col("doc_id")
    found = lambda x: (F.contains(F.lower(x), F.lit("the")) | F.contains(F.lower(x), F.lit("und"))).cast("int")
    candidates = L.read(spark, sf_dir, "documents").select(
        "doc_id", "source", F.trim(F.left(text, F.lit(80))).alias("title"), F.substring(text, 81, 200).alias("summary"), text.alias("body"), F.lit("").alias("url"),
        F.when(k % 9 == 0, "").otherwise(F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (k % 400).cast("int")), "yyyy-MM-dd")).alias("published_at"),
        (k % 7 == 0).alias("needs_date"), (k % 5 == 0).alias("exact_body"), (k % 4 == 0).alias("stored"), F.when(k % 23 == 0, "timeout").alias("fetch_error"),
        found(text).alias("n_hits"), found(F.left(text, F.lit(280))).alias("n_preview_hits"),
    )
    return C.decide(candidates, date_from="2000-02-01", date_to="2000-12-31", terms=["the"])


@query(DECISIONS + "SELECT doc_id, status, reason FROM final")
def decisions(spark, sf_dir):
    return decisions_of(spark, sf_dir).select("doc_id", "status", "reason")


@query(DECISIONS + "SELECT reason, count(*) AS n FROM final WHERE status = 'skipped' GROUP BY reason")
def skip_histogram(spark, sf_dir):
    return C.skip_histogram(decisions_of(spark, sf_dir))


@query(DECISIONS + """SELECT source, count(*) AS seen, sum((status = 'selected')::INT)::BIGINT AS inserted, sum((status = 'duplicate')::INT)::BIGINT AS duplicates, sum((status = 'skipped')::INT)::BIGINT AS skipped FROM final GROUP BY source""")
def source_counters(spark, sf_dir):
    return C.source_counters(decisions_of(spark, sf_dir), "source")


# --- storing and logs --------------------------------------------------------------------------------------------------------------------------


@query("""WITH stored AS (SELECT DISTINCT text FROM documents WHERE source IN ('src0', 'src1')), fresh AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents
  WHERE text NOT IN (SELECT text FROM stored)) SELECT doc_id FROM fresh WHERE r = 1""")
def insert_new_rows(spark, sf_dir):
    docs = L.read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return P.new_rows(docs, docs.where("source in ('src0', 'src1')"), "digest", "doc_id").select("doc_id")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_state(spark, sf_dir):
    return P.latest(L.read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type = 'error'")
def paused_states(spark, sf_dir):
    return P.latest(L.read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").where("event_type = 'error'").select("user_id", "event_id", "value")


# --- evaluation --------------------------------------------------------------------------------------------------------------------------------

RECALL = """WITH gold AS (SELECT DISTINCT c_nationkey, c_custkey FROM customer), found AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
r AS (SELECT c_nationkey, count(*) AS expected, count(o_custkey) AS found, count(*) - count(o_custkey) AS missed FROM gold LEFT JOIN found ON c_custkey = o_custkey GROUP BY c_nationkey) """


def recall_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return V.recall(L.read(spark, sf_dir, "customer"), found, "c_custkey", "c_nationkey")


@query(RECALL + "SELECT *, CASE WHEN expected = 0 THEN 'SKIP' WHEN found = expected THEN 'PASS' WHEN found > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM r")
def recall_per_group(spark, sf_dir):
    return recall_of(spark, sf_dir).withColumn("verdict", V.verdict(F.col("found"), F.col("expected")))


@query(RECALL + "SELECT sum(found)::BIGINT AS found, sum(expected)::BIGINT AS expected, round(sum(found)::DOUBLE / greatest(sum(expected), 1), 6) AS recall FROM r")
def recall_total(spark, sf_dir):
    return recall_of(spark, sf_dir).agg(F.sum("found").alias("found"), F.sum("expected").alias("expected"), F.round(F.sum("found") / F.greatest(F.sum("expected"), F.lit(1)), 6).alias("recall"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang HAVING count(*) >= 5")
def qualified_groups(spark, sf_dir):
    return V.qualified(L.read(spark, sf_dir, "documents"), "source", "lang")


@query("""WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM documents)
SELECT source, doc_id FROM n WHERE c <= 5 OR i IN (0, (c - 1) // 4, 2 * (c - 1) // 4, 3 * (c - 1) // 4, c - 1)""")
def spread_samples(spark, sf_dir):
    return V.spread_samples(L.read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query("SELECT DISTINCT strftime(d::DATE + k::INTEGER, '%Y-%m-%d') AS day FROM (SELECT DISTINCT ts::DATE AS d FROM events), (VALUES (-2), (-1), (0), (1), (2)) AS v(k) WHERE d + k::INTEGER BETWEEN DATE '1990-01-01' AND DATE '2030-01-01'")
def padded_days(spark, sf_dir):
    days = L.read(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    return V.padded_days(days, "1990-01-01", "2030-01-01", 2).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""SELECT source, strftime(day, '%Y-%m-%d') AS day, n FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM (SELECT min(ts)::DATE AS lo, min(ts)::DATE + 6 AS hi FROM events)), (SELECT count(*) AS n FROM events)""")
def work_items(spark, sf_dir):
    """Sources times days of a window: what a sitemap collector has to fetch."""
    span = L.read(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).alias("lo"), F.count(F.lit(1)).alias("n"))
    days = span.select(F.explode(F.sequence("lo", F.date_add("lo", 6), F.expr("interval 1 day"))).alias("day"), "n")
    return L.read(spark, sf_dir, "documents").select("source").distinct().crossJoin(F.broadcast(days)).select("source", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")  # seven days


@query("""WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'no date' WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE strftime(ts, '%Y-%m-%d') END AS at, event_id % 4 AS k, ts FROM events)
SELECT event_id, k < 2 OR (CASE WHEN k = 3 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END >= (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY FROM events)) AS inside, CASE WHEN k < 2 THEN 'Data nao informada'
  WHEN k = 2 THEN strftime(ts, '%d/%m/%Y %H:%M UTC') ELSE strftime(ts, '%d/%m/%Y 00:00 UTC') END AS shown FROM d""")
def date_windows(spark, sf_dir):
    """Text dates, some empty or unreadable: whether they pass a window, and how they are shown."""
    events = L.read(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    at = F.when(k == 0, "").when(k == 1, "no date").when(k == 2, L.iso(F.col("ts"))).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    low = events.agg(F.date_format(F.date_add(F.to_date(F.min("ts")), 1), "yyyy-MM-dd")).first()[0]
    return events.withColumn("at", at).select("event_id", D.within(F.col("at"), date_from=low).alias("inside"), D.shown(F.col("at")).alias("shown"))


# --- more of the scalar library ----------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'target') AS slug FROM documents")
def slug_keys(spark, sf_dir):
    return L.read(spark, sf_dir, "documents").select("doc_id", T.slug_key(F.col("text")).alias("slug"))


@query("WITH u AS (SELECT user_id, event_type, value FROM events) SELECT user_id FROM u WHERE event_type = 'click' INTERSECT SELECT user_id FROM u WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM u WHERE event_type = 'error' AND value > 90")
def user_sets(spark, sf_dir):
    """Found and wanted but not missed: intersection and difference of key sets."""
    of = lambda kind, least=float("-inf"): L.read(spark, sf_dir, "events").where((F.col("event_type") == kind) & (F.col("value") > least)).select("user_id")
    return of("click").intersect(of("purchase")).subtract(of("error", 90))


@query(PARTS + ", hosts AS (SELECT regexp_replace(auth, '^www\\.', '') AS host, canonical FROM canon) SELECT host, count(*) AS pages, count(DISTINCT canonical) AS urls FROM hosts GROUP BY host")
def urls_per_host(spark, sf_dir):
    pages = L.read(spark, sf_dir, "pages").select(U.host_of(F.col("url")).alias("host"), U.canonical(F.col("url")).alias("canonical"))
    return pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("canonical").alias("urls"))


@query("SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at FROM events")
def portuguese_dates(spark, sf_dir):
    """Dates written in Portuguese, read back."""
    names = F.array(*(F.lit(n) for n in ("janeiro", "fev", "março", "abril", "mai", "junho", "jul", "agosto", "set", "outubro", "nov", "dezembro")))
    shown = F.concat(F.lit("Criado em "), F.dayofmonth("ts").cast("string"), F.lit(" "), F.element_at(names, F.month("ts")), F.lit(" "), F.year("ts").cast("string"), F.date_format("ts", "', 'HH'h'mm"))
    return L.read(spark, sf_dir, "events").select("event_id", D.portuguese(shown).alias("at"))


@query("""WITH p AS (SELECT doc_id, doc_id % 3 = 0 AS ai, nullif(trim(CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END), '') AS s, nullif(trim(text), '') AS f FROM documents), t AS (SELECT doc_id, ai, coalesce(s, f) AS x FROM p)
SELECT doc_id, CASE WHEN x IS NULL THEN 'No text' WHEN ai THEN 'AI summary' ELSE 'Raw text' END AS label, CASE WHEN x IS NULL THEN '' WHEN ai OR length(x) <= 560 THEN x ELSE rtrim(left(x, 559)) || '...' END AS preview,
  CASE WHEN ai AND x IS NOT NULL THEN 'llm' ELSE 'raw' END AS source FROM t""")
def summary_payloads(spark, sf_dir):
    docs = L.read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")).alias("summary"))
    return docs.select("doc_id", X.summary_payload(F.col("doc_id") % 3 == 0, F.col("summary"), F.col("text")).alias("p")).select("doc_id", "p.*")


@query()
def assigned_stories(spark, sf_dir):
    """Stories of documents by the model's rule, article by article: titles are first sentences, summaries those of whole texts, the target is the language. Needs the ratio of blocks, so there is no SQL."""
    docs = L.read(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.col("doc_id") * 864 + 946_684_800)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), at.alias("at"), T.capped(F.get(F.split(text, "[.!?\n]"), F.lit(0)), "title").alias("title"), T.summarize(text).alias("summary"), F.col("source").alias("source_name"), F.array("lang").alias("target_keys"))
    return R.assign(rows)


# --- stories that grow batch by batch ----------------------------------------------------------------------------------------------------------

GROWN = """WITH a AS (SELECT event_id AS id, ts, md5(user_id || ':' || event_type) AS h, event_type, 's' || (event_id % 4) AS source FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 7 DAY THEN 0 ELSE 1 END AS cut FROM a WINDOW w AS (PARTITION BY h ORDER BY ts, id)), k AS (SELECT *, sum(cut) OVER (PARTITION BY h ORDER BY ts, id) AS island FROM g),
f AS (SELECT *, first_value(id) OVER (PARTITION BY h, island ORDER BY ts, id) AS story_id FROM k) """


def grown_stories(spark, sf_dir):
    """A store of stories fed with events in three batches of time, one of them twice. Titles are hashes of user and kind, so the same key is the same story unless a week has passed."""
    events = L.read(spark, sf_dir, "events")
    h = F.md5(F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    title = F.concat_ws(" ", F.left(h, F.lit(16)), F.right(h, F.lit(16)))
    rows = events.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), title.alias("title"), title.alias("summary"), F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("source_name"), F.array("event_type").alias("target_keys"))
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).select("low", ((F.unix_micros(F.col("high").cast("timestamp")) - F.unix_micros(F.col("low").cast("timestamp"))) / 3).alias("third"))
    part = F.least(F.floor((F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("low").cast("timestamp"))) / F.greatest("third", F.lit(1.0))), F.lit(2))
    dealt = rows.crossJoin(F.broadcast(span)).withColumn("part", part).drop("low", "third")  # one row
    store = StoryStore(spark, shared_folder(spark))
    for number in (0, 1, 1, 2):
        store.apply(number, dealt.where(F.col("part") == number).drop("part"))
    return store


@query(GROWN + """SELECT story_id AS id, substr(h, 1, 16) || ' ' || substr(h, 17) AS title, least(100.0::DOUBLE, 22.0::DOUBLE + 9 * count(*) + 6 * count(DISTINCT source)) AS temperature, count(*) AS n_articles, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  any_value(event_type) AS target_keys, min(ts)::TIMESTAMP AS created_at, max(ts)::TIMESTAMP AS updated_at FROM f GROUP BY story_id, h""")
def stored_stories(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",").alias(c)
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")]
    return grown_stories(spark, sf_dir).stories().select("id", "title", "temperature", "n_articles", joined("sources"), joined("target_keys"), *times)


@query(GROWN + "SELECT story_id, id AS article_id FROM f")
def stored_story_articles(spark, sf_dir):
    return grown_stories(spark, sf_dir).story_articles().select("story_id", "article_id")


@query(GROWN + "SELECT DISTINCT story_id, event_type AS target_key FROM f")
def stored_story_targets(spark, sf_dir):
    return grown_stories(spark, sf_dir).story_targets()
