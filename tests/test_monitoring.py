import pytest
from pyspark.sql import functions as F

from mentionlake.operators import dataset as E
from mentionlake.operators import ingest as I
from mentionlake.operators import match as M
from mentionlake.sources import search

CARDS = """<div id="post-1" class="x list-item y"><a href="/tag/x">no article here at all</a><a href="/cidade/uma-noticia-bem-longa/"><b>Uma &amp; not&iacute;cia</b></a>
<span class="description"> Um <i>resumo</i> </span><div><div><span class="date-post"> 3 mar 2025, 14h05 </span></div></div></div>
<script>"history":{"host":"vejario.abril.com.br","path":"\\/busca\\/pagina\\/%d\\/","x":1,"parameters":"?s=a"}</script>"""
LIST = """<link rel="next" href="?start=10"><dt class="result-title"> <a href="/noticias/uma-noticia-bem-longa"> Primeira </a></dt><dd class="result-category">x</dd><dd class="result-text"> Texto <b>um</b> </dd><dd class="result-created"> Criado em 4 abril 2025 </dd>
<dt class="result-title"><a href="/noticias/uma-noticia-bem-longa">Outra vez</a></dt><dd class="result-category">x</dd><dd class="result-text">Dois</dd><dd class="result-created">?</dd>"""
PARTS = """<article class="uk-article"><a href="https://www.conib.org.br/noticias/outra-noticia-bem-longa">Tres</a> e mais</article><a class="next" href="/p/2">seguinte</a>"""
LINKS = """<a href="javascript:x">no</a><a href="/um-titulo-bastante-longo">Quatro</a><a rel='next' href='https://other.com/2'>x</a><a href="/busca?p=2">Próximo</a>"""


@pytest.mark.parametrize(
    ("host", "url", "html", "rows", "following"),
    [
        ("vejario.abril.com.br", "https://vejario.abril.com.br/busca/?s=a", CARDS, [("Uma & notícia", "https://vejario.abril.com.br/cidade/uma-noticia-bem-longa", "2025-03-03T14:05:00+00:00", "Um resumo")], "https://vejario.abril.com.br/busca/pagina/2?s=a"),
        ("camara.rio", "https://camara.rio/busca?q=a", LIST, [("Primeira", "https://camara.rio/noticias/uma-noticia-bem-longa", "2025-04-04T12:00:00+00:00", "Texto um")], "https://camara.rio/busca?start=10"),
        ("www.conib.org.br", "https://www.conib.org.br/busca", PARTS, [("Tres", "https://www.conib.org.br/noticias/outra-noticia-bem-longa", "", "Tres e mais")], "https://www.conib.org.br/p/2"),
        ("a.com", "https://a.com/busca", LINKS, [("Quatro", "https://a.com/um-titulo-bastante-longo", "", "")], "https://a.com/busca?p=2"),
    ],
)
def test_result_pages(spark, host, url, html, rows, following):
    pages = spark.createDataFrame([(url, html), ("https://x.y/", None)], "url string, html string")
    got = search.results(pages, host, "S").collect()
    assert [(r.title, r.url, r.published_at, r.snippet) for r in got] == rows
    assert pages.limit(1).select(search.next_page(F.col("url"), F.col("html"), host)).first()[0] == following
    assert spark.createDataFrame([("https://a.com/", "<p>x</p>")], pages.schema).select(search.next_page(F.col("url"), F.col("html"), host)).first()[0] == ""


def test_matches_by_each_way(spark):
    expected = [(1, "http://a.com/x?utm_source=1", ""), (2, "http://a.com/y/", ""), (3, "http://a.com/um-dois-tres-quatro-cinco", ""), (4, "http://a.com/z", "Ação: é um título já bem longo aqui"), (5, "http://b.net/q", "um dois tres quatro cinco seis sete oito"), (6, "http://c.org/w", "nada")]
    found = [("http://a.com/x", None), ("http://other.com/y", ""), ("http://b.com/um-dois-tres-quatro-seis-cinco", ""), ("http://www.a.com/k", "acao e um titulo ja bem longo aqui"), ("http://b.net/r", "um dois tres quatro cinco seis sete nove"), ("http://x.org/v", "nada")]
    got = M.matches(spark.createDataFrame(expected, "id long, url string, title string"), spark.createDataFrame(found, "url string, title string"))
    by = {}
    for r in got.collect():
        by.setdefault(r.id, set()).add(r.how)
    assert by == {1: {"canonical", "path"}, 2: {"path"}, 3: {"slug"}, 4: {"title", "near_title"}, 5: {"near_title"}}


def test_matches_stay_in_their_group(spark):
    slug, title = "http://a.com/um-dois-tres-quatro-cinco", "um dois tres quatro cinco seis sete oito"
    expected = spark.createDataFrame([(k, f"{slug}-{k}", f"{title} {k}", g) for k, g in ((1, "s"), (2, "t"), (3, None))], "id long, url string, title string, site string")
    found = spark.createDataFrame([(f"{slug}-9", f"{title} 9", "s"), (f"{slug}-2", f"{title} 2", "s"), (f"{slug}-3", f"{title} 3", None)], "url string, title string, site string")
    by = {}
    for r in M.matches(expected, found, "site").collect():
        by.setdefault(r.id, set()).add(r.how)
    assert by == {1: {"slug", "near_title"}}
    assert {r.id for r in M.matches(expected, found).collect()} == {1, 2, 3}


def test_evaluation(spark):
    rows = [("s", f"http://a.com/a-long-article-name-{i}", f"t{i}", f"{i + 1:02d}/03/2025") for i in range(9)] + [("few", "http://b.com/a-long-article-name", "t", "01/01/2025")] + [("undated", f"http://c.com/a-long-article-name-{i}", "t", "") for i in range(5)]
    expected = spark.createDataFrame(rows, "source string, url string, title string, date string")
    found = spark.createDataFrame([("s", f"http://a.com/a-long-article-name-{i}/", "") for i in (0, 2, 4)], "source string, url string, title string")
    got = {r.source: (r.expected, r.found, str(r.day_from), str(r.day_to), r.verdict) for r in M.evaluate(expected, found).collect()}
    # Slugs that differ in their number share four of six words only.
    assert got["s"] == (5, 3, "2025-02-28", "2025-03-10", "PARTIAL")
    assert set(got) == {"s", "undated"} and got["undated"][-1] == "SKIP"


def test_planned_candidates_and_terms(spark):
    schema = "url string, pos long"
    a, b, c = (spark.createDataFrame(rows, schema) for rows in ([("u", 0), ("u", 1), (None, 2)], [("u", 0), ("v", 1), ("v", 2)], [("v", 0), ("w", 1)]))
    got = [(r.plan, r.url, r.pos) for r in I.planned([("A", "x", a, False), ("B", "y", b, True), ("C", "z", c, True)]).orderBy("plan", "pos").collect()]
    assert got == [(0, "u", 0), (0, "u", 1), (0, None, 2), (1, "v", 1), (2, "w", 1)]
    ana, bo = {"key": "ana", "name": "Ana Sá", "keywords": ["Ana", "Sá", "A", "B"]}, {"key": "bo", "name": "Bo"}
    assert I.select_targets([ana, bo], [" bo ", "bo"]) == [bo] and I.select_targets([ana, bo], None) == [ana, bo]
    with pytest.raises(ValueError, match="unknown_target_keys:x,y"):
        I.select_targets([ana], ["x", "ana", "y"])
    spellings = {"ana": ["Ana Sa", "Ana Sá"]}
    assert I.search_terms(ana, variants=spellings) == ["Ana Sa", "Ana Sá"] and I.search_terms(bo) == ["Bo"] and I.search_terms(bo, site={"query_variants": [" x ", "x"]}) == ["x"]
    assert I.news_terms(ana, variants=spellings, extra="v", hosts={"ana": ["h"]}) == ['"Ana Sa"', '"Ana Sá"', '"Ana Sa" v', '"Ana Sá" v', 'site:h "Ana Sa"', 'site:h "Ana Sá"']
    assert I.scrape_terms(ana) == ["Ana", "Sá", "A"] and I.scrape_terms(bo) == ["Bo"] and I.search_terms({"key": "c"}) == []


def test_ingested_tables(spark):
    body = " ".join(f"word{i}" for i in range(30))
    rows = [("u1", 0, "S", "Ana wins", body, "2001-01-01"), ("u1", 1, "S", "Ana again", body, "2001-01-01"), ("u2", 2, "S", "Nothing", body, "2001-01-01"), ("u3", 3, "T", "Bo and Ana lose", body, "1990-01-01"), ("u4", 4, "T", "Bo", body, ""), ("known", 5, "T", "Bo", body, ""), ("", 6, "T", "Bo", body, "")]
    made = spark.createDataFrame(rows, "url string, pos long, source string, title string, summary string, published_at string").withColumn("body", F.lit("apoio"))
    for name, value in (("fetch_error", None), ("needs_date", False), ("exact_body", False)):
        made = made.withColumn(name, F.lit(value).cast("string" if value is None else "boolean"))
    stored = spark.createDataFrame([("known",)], "url string")
    seen = []
    out = I.ingest(made, stored, [("ana", "Ana"), ("bo", "Bo")], source="source", per_source=10, names={"ana": "Ana Sá"}, date_from="2000-01-01", on_progress=seen.append)
    assert len(seen) == 1 and seen[0]["seen"] == out["decisions"].count() and seen[0]["selected"] == out["decisions"].where("status = 'selected'").count()
    assert {r.url: r.reason for r in out["decisions"].collect()} == {"u1": "saved", "u2": "no_match_exact_name", "u3": "outside_date_window", "u4": "saved", "known": "already_in_database"}
    assert {(r.url, r.title) for r in out["articles"].collect()} == {("u1", "Ana wins"), ("u4", "Bo")}
    assert {(r.url, r.target_key, r.target_name, r.keyword_matched, r.sentiment, r.context) for r in out["mentions"].collect()} == {("u1", "ana", "Ana Sá", "Ana", "positive", ""), ("u4", "bo", "bo", "Bo", "positive", "")}
    assert {tuple(r) for r in out["log"].collect()} == {("S", 2, 1, 0, 1), ("T", 3, 1, 1, 1)}


def test_labels_and_scope():
    labels = {"a": "A", "b": "B"}
    assert E.initial_targets(["a", "b"], "b") == ["b"] and E.initial_targets(["a", "b"], "x") == ["a", "b"]
    assert E.selection_label(["b", "a"], labels) == E.selection_label(["x"], labels) == E.ALL_NAMES and E.selection_label(["b"], labels) == "B" and E.selection_label([], {}) == E.NO_FILTERS
    assert E.scope()["token"] == "all_stories" and E.scope("2001-01-01", "2001-02-01")["value"] == "2001-01-01 a 2001-02-01"


def test_records_and_bundles(spark, tmp_path):
    stories = spark.createDataFrame([(1, "T", "", 50.0, ["k"], "2001", "2002"), (2, None, "sum", 60.0, None, "2001", "2002")], "id long, title string, summary string, temperature double, target_keys array<string>, created_at string, updated_at string")
    text = "long text " * 100
    articles = spark.createDataFrame([(7, "x", "http://www.a.com/p", "", "2001-02-03T04:05:00+00:00", None, False, "", text, ""), (8, "y", "", "S", "", ["z"], True, "an AI summary", text, ""), (9, "", "", "S", "2001-01-01", None, None, None, None, "bit")], "article_id long, title string, url string, source_name string, published_at string, target_keys array<string>, has_ai boolean, summary string, full_text string, snippet string")
    edges = spark.createDataFrame([(1, 7), (1, 8), (2, 9)], "story_id long, article_id long")
    records = E.story_records(stories, edges, articles)
    one, two = records.collect()
    assert (one.storyIdInt, one.summaryLabel, one.summaryText, one.articleCount, one.aiCount, one.rawCount) == (1, E.AI, "an AI summary", 2, 1, 1)
    assert (two.title, two.summaryLabel, two.summaryText, two.lastPublishedAt) == (E.UNTITLED, E.GROUPED, "sum", "2001-01-01")
    x, y = one.articles
    assert (x.articleId, x.sourceName, x.sourceHost, x.publishedDisplay, x.targetKeys, x.rawTextKey, x.summarySource) == (7, E.NO_SOURCE, "a.com", "03/02/2001 04:05 UTC", ["k"], "article-7", "raw")
    assert (y.targetKeys, y.rawTextKey, y.publishedDisplay) == (["z"], None, "Data nao informada") and two.articles[0].summaryPreview == "bit"
    E.write_bundle(records, E.article_records(articles), str(tmp_path))
    back, raw = E.read_bundle(spark, str(tmp_path), records)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, records.collect())) and {(r.key, r.text.strip()) for r in raw.collect()} == {("article-7", text.strip())}
    moved = E.moved(records, 10, 100)
    assert tuple(E.last_numbers(moved).first()) == (12, 109) and moved.orderBy("storyIdInt").first().articles[0].rawTextKey == "article-107"
