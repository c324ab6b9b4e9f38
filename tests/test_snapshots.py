from pyspark.sql import functions as F

from mentionlake.sources import feeds, snapshots

PAGE = """<script id="snapshot-payload" type="application/json">{"storyTargets": {"1": ["k"]}}</script><body data-clipping-data-url="a/b.json?x&amp;y">
<details class="s" data-story-id="1" data-temperature="" data-ai-count="1"><summary><h2>One &amp; <b>two</b></h2></summary><div class="summary-label">Label</div><div class="story-summary"><p>Text</p></div>
<strong>42</strong> <span>temperatura</span> Primeira publicação: 01/02/2025 03:04 UTC<br>Ultima publicação: 05/02/2025 03:04 UTC<br><details><p>inner</p></details>
<article class="article-card x" id="article-9"><h3><a href="http://www.a.com/p?x=1&amp;y=2">T1</a></h3><p class="meta-line"><span>S1</span><span>01/02/2025 03:04 UTC</span></p><div class="body">Prev<br>iew</div><div class="body full"><p>whole</p></div></article>
<article class="article-card"><h3>T2</h3><span class="summary-ai">x</span>
</details><p>between</p>
<details data-story-id="2" data-targets="a,,b" data-last-published="2025"><article class="article-card"><h3>T3</h3></article><details>never closed
<details data-story-id="1"><h2>again</h2></details>"""


def test_cards(spark):
    pages = spark.createDataFrame([("p", PAGE), ("q", None)], "page string, html string")
    found = snapshots.cards(pages)
    one, two = snapshots.card_stories(found).orderBy("story").collect()
    assert (one.title, one.summary_label, one.summary, one.temperature, one.article_count, one.ai_count, one.raw_count) == ("One & two", "Label", "Text", 42.0, 2, 1, 1)
    assert (one.first_published_at, one.last_published_at) == ("2025-02-01T03:04:00+00:00", "2025-02-05T03:04:00+00:00")
    assert (two.title, two.target_keys, two.last_published_at, two.temperature) == ("Sem titulo", ["a", "b"], "2025", 0.0)
    assert [c.card.endswith("</details>") for c in found.orderBy("story").collect()] == [True, False]
    a, b, c = snapshots.card_articles(found).orderBy("story", "pos").collect()
    assert (a.article, a.title, a.url, a.source_name, a.source_host, a.published_at, a.preview, a.raw_text) == (9, "T1", "http://www.a.com/p?x=1&y=2", "S1", "a.com", "2025-02-01T03:04:00+00:00", "Prev\niew", "whole")
    assert (b.article, b.title, b.summary_label, c.article, c.title) == (10, "T2", "Resumo IA", 11, "T3")
    row = pages.where("page = 'p'").select(snapshots.payload(F.col("html"), "storyTargets map<string,array<string>>").alias("p"), snapshots.bundle_links(F.col("html")).alias("l")).first()
    assert row.p.storyTargets == {"1": ["k"]} and tuple(row.l) == ("a/b.json?x&y", None)


def test_gold_rows(spark, tmp_path):
    path = tmp_path / "gold.csv"
    path.write_text("LINK,DATA\nhttp:/www.A.com/x/n,03/02/2025\n,03/02/2025\nhttp://a.com/y,2025-02-04\nhttp://a.com/z,2026-01-01\nhttp://a.com/w,?\n")
    got = snapshots.gold_rows(spark, str(path), "2025-02-01", "2025-02-28").orderBy("url").collect()
    assert [(r.url, r.host, str(r.day)) for r in got] == [("http://a.com/y", "a.com", "2025-02-04"), ("http://www.a.com/x", "a.com", "2025-02-03")]


def test_collectors(spark):
    rows = [("q1", 0, "https://news.google.com/rss/articles/a?url=http%3A%2F%2Fa.com%2F1", "", "2025-01-02"), ("q1", 1, "https://news.google.com/rss/articles/b", "<a href='http://b.com/2?utm_source=x'>x</a>", "2025-01-02"), ("q1", 2, "http://c.com/3", "", "2020-01-01"), ("q2", 0, "http://a.com/1/", "", "2025-01-03"), ("q2", 1, "https://news.google.com/rss/articles/c", "", "2025-01-03")]
    df = spark.createDataFrame(rows, "query string, pos long, url string, snippet string, published_at string")
    got = feeds.news(df, "query", "pos", limit=5, date_from="2025-01-01").orderBy("place", "query").collect()
    assert [(r.url, r.force_full_fetch) for r in got] == [("http://a.com/1", False), ("http://b.com/2", False), ("https://news.google.com/rss/articles/c", True)]
    assert feeds.collected(df, "query", "pos", limit=1).count() == 2
    assert feeds.route("G1", "g1.globo.com", {"g1.globo.com": ["sitemap"]}, {}) == ["sitemap"] and feeds.route("Google News x", "y", {}, {"google news": "google_news"}) == ["google_news"] and feeds.route("z", "y", {}, {}) == ["rss"]
