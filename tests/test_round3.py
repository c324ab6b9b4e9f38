"""Queries against their SQL on small tables of odd rows."""

import duckdb
import pytest
from compare import assert_same

from mentionlake.plans import catalogue, collecting, monitoring, publishing  # noqa: F401


def same(spark, folder, name, **tables):
    """The query and its SQL on tables given as (schema, rows); `tables` may name Parquet files of other tables too."""
    con = duckdb.connect()
    for table, rows in tables.items():
        at = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows[1], rows[0]).coalesce(1).write.mode("overwrite").parquet(at)
        con.sql(f"create view {table} as select * from read_parquet('{at}/*.parquet')")
    df = catalogue.QUERIES[name](spark, str(folder))
    assert_same(df, con.sql(catalogue.ORACLES[name]))
    return df.collect()


PAGE = "page_id long, url string, html string"


def test_captures_of_one_page_keep_their_links(spark, tmp_path):
    url = "https://en.example.com/news/search"
    link = lambda path, title: f'<a href="/news/{path}">{title}</a>'
    first, second = link("one-story", "One") + link("third", "Z"), link("two-story", "Two") + link("third", "Y")
    rows = same(spark, tmp_path, "site_results", pages=(PAGE, [(1, url, first), (2, url, second), (3, url, first)]))
    assert sorted((r.title, r.url.rsplit("/", 1)[1]) for r in rows) == [("One", "one-story"), ("Two", "two-story"), ("Y", "third")]


def test_an_article_without_targets_in_a_story_without_any(spark, tmp_path):
    from datetime import datetime

    day = datetime(1998, 1, 1)
    rows = same(
        spark, tmp_path, "story_record_articles",
        customer=("c_custkey long, c_name string, c_mktsegment string, c_acctbal double", [(1, "one", "a", 10.0), (2, "two", "b", 20.0)]),
        orders=("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_orderstatus string", [(1, 1, day, "1-HIGH", "F"), (2, 2, day, "1-HIGH", "F"), (3, 2, day, "2-LOW", "O")]),
        lineitem=("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string", [(2, 1, 1, 1, day, 1.0, 1.0, 0.0, 0.0, "R", "F")]),
    )
    assert sorted((r.article, r["keys"]) for r in rows) == [(1, ""), (2, "R"), (3, "R")]


ENTITIES = [
    "a&amp b", "&ampcopy;", "&amp;copy", "&copy&nbsp&nbsp;x", "&notit; &notin; &NotEqualTilde; &bogus; &bogus &", "&#39 &#390 &#x27;&#X1F600;", "&#128;&#x9f;&#129;", "&#0;&#xD800;&#1114112;&#99999999999;", "&#1;&#x0B;&#xFFFE;&#127;z",
    "a&#8232;b&#11;&#9;c", "&lt;b&gt;bold&lt;/b&gt;", "&&amp;&amp;amp;", "&#x;&#;&#xg", "&#65279;&#00065;", "&AMP&LT&Ouml &frac12x",
]


def test_titles_read_entities_by_the_standard(spark, tmp_path):
    pages = [(k, "http://a/", f"<html><title lang=x>{t}</title><p>x</p>") for k, t in enumerate(ENTITIES)] + [(100, "", None), (101, "", "<p>none</p>")]
    shared = [(102, "", "<meta property='og:title' content=''><META content=\"A &amp B\" property='OG:title'><title>no</title>"), (103, "", "<title>no</title><meta name=\"twitter:title\" content='T'>"), (104, "", "<meta name='twitter:title' content='&nbsp'><title>own</title>")]
    rows = same(spark, tmp_path, "html_title", pages=(PAGE, pages + shared))
    shown = {r.page_id: r.title for r in rows}
    assert (shown[0], shown[1], shown[2], shown[102], shown[103], shown[104]) == ("a& b", "&copy;", "&copy", "A & B", "T", "own")


def test_texts_read_entities_by_the_standard(spark, tmp_path):
    pages = [(k, "http://a/", f"<p>{t}</p><script>no</script> http://gone.example/x &amp") for k, t in enumerate(ENTITIES)] + [(100, "", None), (101, "", "")]
    rows = same(spark, tmp_path, "html_to_text", pages=(PAGE, pages))
    assert {r.page_id: r.body for r in rows}[0] == "a& b &"


def test_a_long_s_makes_no_script(spark, tmp_path):
    pages = [(1, "http://a/", "a<\u017fcript>b</\u017fcript>c"), (1, "http://a/", "a<SCRIPT>b</Script>c"), (2, "http://a/", "<\u017ftyle>&amp</style>"), (3, "http://a/", "<STYLE x>&amp</style>&lt")]
    rows = same(spark, tmp_path, "html_to_text", pages=(PAGE, pages))
    assert sorted((r.page_id, r.body) for r in rows) == [(1, "a b c"), (1, "a c"), (2, "&"), (3, "<")]
