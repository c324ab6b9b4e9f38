import json

from mentionlake.sources import feeds


def test_rss_atom_and_sitemap(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>T</title><link>http://a/1</link><description>&lt;b&gt;S&lt;/b&gt;</description><pubDate>Mon, 06 Apr 2026 12:30:00 +0000</pubDate></item><item><title>No link</title></item><item><link>http://a/2</link><pubDate>bad</pubDate></item></channel></rss>")
    got = {r.url: r for r in feeds.rss(spark, str(tmp_path / "a.xml"), "feed", "2026-05-01").collect()}
    assert got["http://a/1"].published_at == "2026-04-06T12:30:00" and got["http://a/1"].snippet == "S"
    assert set(got) == {"http://a/1", "http://a/2"} and got["http://a/2"].published_at == "2026-05-01T00:00:00"
    (tmp_path / "b.xml").write_text('<feed><entry><title>T</title><link href="http://b/1"/><content>C</content><updated>2026-04-06T00:00:00Z</updated></entry></feed>')
    assert [(r.url, r.snippet) for r in feeds.atom(spark, str(tmp_path / "b.xml"), "feed", "2026-05-01").collect()] == [("http://b/1", "C")]
    (tmp_path / "c.xml").write_text('<urlset xmlns:n="x"><url><loc>http://c/1</loc><n:news><n:title>T</n:title><n:publication_date>2026-04-06</n:publication_date></n:news></url><url><loc>http://c/2</loc></url></urlset>')
    assert {(r.url, r.published_at) for r in feeds.sitemap(spark, str(tmp_path / "c.xml"), "map").collect()} == {("http://c/1", "2026-04-06T00:00:00"), ("http://c/2", None)}


def test_json_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"link": "http://p/1", "title": {"rendered": "A &amp; B"}, "excerpt": {"rendered": "<p>E</p>"}, "date_gmt": "2026-04-06T10:00:00"}]))
    assert [(r.title, r.snippet, r.published_at) for r in feeds.posts(spark, str(tmp_path / "p.json"), "p", "2026-05-01").collect()] == [("A & B", "E", "2026-04-06T10:00:00")]
    (tmp_path / "s.json").write_text(json.dumps([{"result": {"hits": {"hits": [{"_source": {"url": "http://s/1", "title": "T", "issued": "2026-04-06", "body": "B" * 900}}]}}}]))
    assert [(r.url, len(r.snippet)) for r in feeds.search_hits(spark, str(tmp_path / "s.json"), "s").collect()] == [("http://s/1", 500)]
    (tmp_path / "t.json").write_text(json.dumps([{"label": "Some Name", "primary": True, "keywords": ["x"]}, {"key": "no_label"}]))
    assert [(r.key, r.priority, r.keywords) for r in feeds.targets(spark, str(tmp_path / "t.json")).collect()] == [("some_name", 1, ["Some Name", "x"])]
