import difflib

import pytest
from pyspark.sql import functions as F

from mentionlake.functions import dates as D
from mentionlake.functions import html as H
from mentionlake.functions import similarity as S
from mentionlake.functions import text as T
from mentionlake.functions import url as U


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://User:pw@WWW.Example.com:443/A/b/?utm_source=x&b=2&a=1#frag", "https://www.example.com/A/b?a=1&b=2"),
        ("http://example.com:8080", "http://example.com:8080/"),
        ("http://example.com/?a=2&a=1&c=", "http://example.com/?a=2&a=1"),
        ("http://example.com/x?a-b=1&a=2", "http://example.com/x?a=2&a-b=1"),
        ("http://example.com/x;s=1?q=a%20b+c~*", "http://example.com/x?q=a+b+c~%2A"),
        ("http://example.com/a%20b//?q=%zz", "http://example.com/a%20b?q=%25zz"),
        ("example.com/a/", "example.com/a"),
        ("", ""),
        ("http://example.com/p?UTM_Source=1", "http://example.com/p"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, U.canonical, url) == want
    assert one(spark, U.canonical, want) == want


def test_hosts(spark):
    assert one(spark, U.host_of, "http://www.a.www.b.com/x") == "a.www.b.com"
    assert one(spark, U.host_everywhere, "http://www.a.www.b.com/x") == "a.b.com"
    assert one(spark, U.likely_article, "http://a.com/news/a-long-article-slug") is True
    assert one(spark, U.likely_article, "http://a.com/tag/a-long-article-slug") is False
    assert one(spark, U.likely_article, "http://a.com/") is False


def test_normalize_text(spark):
    assert one(spark, T.normalize_text, " a  b \r\n\r\n\r\n\r\nc\t d ") == "a b\n\nc d"
    assert one(spark, T.normalize_text, None) == ""
    assert one(spark, T.slug_key, "Ação & Obra") == "a_o_obra"
    assert one(spark, T.slug_key, "--") == "target"


def test_sentiment_ladder(spark):
    assert one(spark, T.sentiment, "apoio aprova elogia") == "very_positive"
    assert one(spark, T.sentiment, "atraso") == "negative"
    assert one(spark, T.sentiment, "apoio atraso") == "neutral"
    assert one(spark, T.sentiment, "Apoio") == "neutral"  # case counts


def test_dates(spark):
    assert one(spark, D.portuguese, "Criado em 3 de março de 2025") == ""
    assert one(spark, D.portuguese, "3 março 2025, 14h05") == "2025-03-03T14:05:00+00:00"
    assert one(spark, D.portuguese, "31 fev 2025") == ""
    assert one(spark, D.shown, "2026-04-06T12:30:00+00:00") == "06/04/2026 12:30 UTC"
    assert one(spark, D.shown, "Mon, 06 Apr 2026 12:30:00 +0000") == "06/04/2026 12:30 UTC"
    assert one(spark, D.shown, "nothing") == "Data nao informada"
    assert one(spark, lambda c: D.within(c, "2026-04-01", "2026-04-06"), "2026-04-06T23:59:59.5+00:00") is True
    assert one(spark, lambda c: D.within(c, "2026-04-01", "2026-04-06"), "nothing") is True
    assert one(spark, lambda c: D.within(c, floor="2025-01-01"), "2024-12-31") is False


def test_html(spark):
    page = "<html><head><title> A &amp; B </title><script>x</script></head><body><article>short</article><main>the longer one</main><a href='/x'>l</a></body></html>"
    assert one(spark, H.title, page) == "A & B"
    assert one(spark, H.main_block, page) == "the longer one"
    assert one(spark, H.html_to_text, page) == "A & B short the longer one l"
    assert one(spark, H.hrefs, page) == ["/x"]


def test_similarity_uses_the_standard_ratio(spark):
    a, b = "council approves budget", "council approves budget today"
    got = spark.createDataFrame([(a, b), (a, "")], "a string, b string").select(S.similarity(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())
    assert got[1][0] == 0


def rows(spark, column, pairs):
    got = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(pairs)], "k int, x string").select("k", column(F.col("x")).alias("y")).orderBy("k").collect()
    assert [r.y for r in got] == [want for _, want in pairs]


def test_other_urls(spark):
    rows(spark, U.normalized, [("http:/A.com:81/x/?b=1&a=2&b=3&gclid=4#f", "http://a.com/x?b=1&b=3&a=2"), ("http://a.com", "http://a.com/"), (None, "")])
    rows(spark, lambda c: U.normalized(c, by_key=True), [("http://a.com/x/?b=1&a=2&b=3", "http://a.com/x?a=2&b=1&b=3")])
    rows(spark, U.without_query, [("http:/A.com/x/n", "http://a.com/x"), ("http://a.com/x/rn/?q", "http://a.com/x"), ("//a.com", "https://a.com/"), ("http://a.com/news/", "http://a.com/news"), (" ", "")])
    rows(spark, U.search_page, [("HTTP://A.com//b//c/?q=&ref=x#f", "http://a.com/b/c?q=&ref=x"), ("//a.com/", "https://a.com/"), ("", "")])
    rows(spark, lambda c: U.resolved(F.lit("https://a.com/b/c.html?q#f"), c), [
        ("d", "https://a.com/b/d"), ("/d?x=1", "https://a.com/d?x=1"), ("../d/./e", "https://a.com/d/e"), ("//b.com/x", "https://b.com/x"), ("?y", "https://a.com/b/c.html?y"),
        ("http://c.com/", "http://c.com/"), ("..", "https://a.com/"), ("", "https://a.com/b/c.html?q#f"), ("mailto:x@y", "mailto:x@y"),
    ])
    rows(spark, U.slug_title, [("http://a.com/x/my-new_story/", "My New Story"), ("http://a.com/", "")])
    rows(spark, U.news_token, [("https://news.google.com/rss/articles/CBMi?oc=5", "CBMi"), ("https://news.google.com/read/x1", "x1"), ("https://a.com/read/x1", ""), ("https://news.google.com/", "")])
    rows(spark, U.news_feed, [('"Ana Sá" x', "https://news.google.com/rss/search?q=%22Ana+S%C3%A1%22+x&hl=pt-BR&gl=BR&ceid=BR:pt-419")])
    family = spark.createDataFrame([("oglobo.globo.com", "globo.com"), ("www.a.com", "a.com"), ("xa.com", "a.com"), ("a.com", "b.com")], "a string, b string")
    assert [r[0] for r in family.select(U.same_family(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_entities(spark):
    import html

    texts = ["S&atilde;o &#8217; &#x2019; &amp;lt; &nbsp;x", "a & b", "&unknown; &copy &copyx; AT&T;", "&#128512;&#0;", "&lt;p&gt; &quot;&#39;&hellip;", "&", None]
    rows(spark, H.unescape, [(t, t if t is None else html.unescape(t)) for t in texts])


def test_more_texts(spark):
    rows(spark, T.summarize, [
        ("One two three four five six.  Seven\n eight  nine ten eleven twelve. Short. A b c d e f!", "One two three four five six. Seven\n eight  nine ten eleven twelve. A b c d e f!"),
        ("Short one. Resultado da pesquisa a b c d e.", "Short one. Resultado da pesquisa a b c d e."), ("", ""), (None, ""), (" https://x.y ", " "),
    ])
    rows(spark, T.plain_title, [('"<b>A</b> &amp;  B"', "A & B"), (None, "")])
    rows(spark, T.clean_title, [("News - G1 Rio https://a.b", "News"), ("- a -", "a")])
    rows(spark, T.folded_title, [("Ação: é  já!", "acao e ja"), ("ÀÉÎõü", "aeiou")])
    rows(spark, T.rendered, [("a<b>\n'c' & \"d\"", "a&lt;b&gt;<br>&#39;c&#39; &amp; &quot;d&quot;")])
    rows(spark, T.fragment_text, [("<p>a&nbsp;b</p><p>c<br/>d</p>", "a b\nc\nd")])
    rows(spark, T.story_number, [("st-12", 12), ("7", 7), ("x", 0), (None, 0)])
    rows(spark, T.article_number, [("article-5", 5), ("a-6", 6), ("article-a-7", 7), ("st-1", 0)])
    rows(spark, lambda c: T.matches_queries(c, [" a  b ", ""]), [("x a b", True), ("x a", False), (None, False)])
    rows(spark, lambda c: T.json_for_script(F.struct(c.alias("x"))), [("</script>", '{"x":"\\u003c/script>"}')])


def test_more_dates(spark):
    rows(spark, lambda c: D.within(c, date_to="2000-12-31T12:00"), [("2000-12-31T11:59", True), ("2001-01-01T06:00", False)])
    rows(spark, D.from_shown, [("em 06/04/2026 12:30 UTC", "2026-04-06T12:30:00+00:00"), ("6/4/2026", "")])
    rows(spark, D.day_first, [("06/04/2026 12:30", "2026-04-06"), ("x", None)])
    rows(spark, D.shown_short, [("2026-04-06T12:30:00+00:00", "06/04/2026 12:30"), ("not a date at all", "not a date")])
    rows(spark, D.shown_or_as_is, [("06/04/2026 12:30 UTC", "06/04/2026 12:30 UTC"), ("2026-04-06", "06/04/2026 00:00 UTC"), ("?", "?")])
    days = lambda a, b: lambda c: F.transform(D.window_days(F.lit(a), F.lit(b), F.to_timestamp(c)), lambda d: d.cast("string"))
    rows(spark, days("2026-01-03", "2026-01-01"), [("2026-02-01T00:00:00Z", ["2026-01-01", "2026-01-02", "2026-01-03"])])
    rows(spark, days("", "2026-01-01"), [("2026-02-01T00:00:00Z", ["2026-01-01"])])
    assert len(one(spark, days("", ""), "2026-02-01T00:00:00Z")) == 7


def test_more_html(spark):
    page = "<meta content='T &amp; U' property=\"og:title\"><time class=x datetime='2026-01-02T03:04:05Z'>x</time><div class=\"a post-content b\">the longest text of all</div><main>short</main><a class='n' rel=\"next\" href='/p2'><b>Next</b> page</a>"
    assert one(spark, H.title, page) == "T & U"
    assert one(spark, H.main_block, page) == "the longest text of all"
    assert one(spark, lambda c: D.in_utc(H.published_at(c), "yyyy-MM-dd HH:mm:ss"), page) == "2026-01-02 03:04:05"
    (link,) = one(spark, H.anchors, page)
    assert (link.title, link.href) == ("Next page", "/p2") and 'rel="next"' in link.attrs
    assert one(spark, lambda c: H.attributes(c, "x"), "<x a='1' b=\"2\" a=\"3\" c='&lt;'>") == {"a": "3", "b": "2", "c": "<"}
    assert one(spark, H.article_refs, "id=article-12 article-7x article-3") == [12, 3]


def test_similarity_regards_case(spark):
    got = spark.createDataFrame([("ABC DEF GHI", "abc def ghi")], "a string, b string").select(S.similarity(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(0.55 * difflib.SequenceMatcher(None, "ABC DEF GHI", "abc def ghi").ratio())


def test_summaries_take_the_first_good_sentences(spark):
    long = "one two three four five six."
    rows(spark, T.summarize, [
        (f"Short. {long} A comment on two three four five six. {long}\u00a0{long} {long}", f"{long} {long} {long}"),
        ("\u2003Short. \n Two!\u2028Three? Four.", "Short. Two! Three?"),
        ("no end here", "no end here"),
        (" \u00a0 ", ""),
        (None, ""),
        ("http://a.b/c", " "),
        ("x" * 900, "x" * 700),
    ])


def test_terms_with_and_without_spaces(spark):
    rows(spark, lambda c: T.passes_terms(c, ["city \t hall", "budget"], "all"), [("the city\u00a0hall\nbudget", True), ("the city\nhall budget", False), ("city hall", False), (None, False)])
    rows(spark, lambda c: T.matches_queries(c, ["a  b", "cc"]), [("a \t b", True), ("xccx", True), ("ab", False), (None, False)])
