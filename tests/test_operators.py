from pyspark.sql import functions as F

from mentionlake.operators import articles, candidates, evaluate, export, persist

COLUMNS = "n int, url string, title string, summary string, published_at string, body string, n_hits int, n_preview_hits int, stored boolean, fetch_error string, needs_date boolean, exact_body boolean"
GOOD = {"url": "http://a/x", "title": "A title", "summary": "word " * 25, "published_at": "2026-04-03", "body": "the body", "n_hits": 1, "n_preview_hits": 1, "stored": False, "fetch_error": None, "needs_date": False, "exact_body": False}


def test_each_rule_of_the_ladder(spark):
    cases = [
        ({}, "saved"),
        ({"published_at": "2020-01-01"}, "outside_date_window"),
        ({"fetch_error": "timeout"}, "fetch_fail:timeout"),
        ({"needs_date": True, "published_at": ""}, "missing_published_at"),
        ({"n_hits": 0}, "no_match_exact_name"),
        ({"exact_body": True, "body": " "}, "missing_body"),
        ({"body": "no term", "title": "x"}, "forced_terms_not_matched"),
        ({"needs_date": True, "published_at": "2020-01-01"}, "outside_date_window"),
        ({"url": "http://a/search/x"}, "low_article_quality"),
        ({"summary": "short", "n_preview_hits": 0}, "low_article_quality"),
        ({"summary": "short"}, "saved"),
        ({"stored": True}, "already_in_database"),
        ({"published_at": "garbage"}, "saved"),
    ]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = [tuple({**GOOD, **case, "n": k}[c] for c in names) for k, (case, _) in enumerate(cases)]
    got = candidates.decide(spark.createDataFrame(rows, COLUMNS), date_from="2026-04-01", date_to="2026-04-30", terms=["body", "title"]).orderBy("n").collect()
    assert [r.reason for r in got] == [reason for _, reason in cases]
    assert {r.status for r in got} == {"selected", "skipped", "duplicate"}


def test_keyword_map_lets_the_later_target_win_but_keeps_the_place(spark):
    targets = spark.createDataFrame([("a", "A", 0, ["Foo", "bar"]), ("b", "B", 1, ["foo"])], "key string, name string, ord int, keywords array<string>")
    got = {r.low: (r.key, r.place.ord) for r in candidates.keyword_map(targets).collect()}
    assert got == {"foo": ("b", 0), "bar": ("a", 0)}


def test_dedup_keeps_the_first_and_drops_empty_urls(spark):
    rows = spark.createDataFrame([(1, "http://a/x/"), (0, "http://A/x"), (2, ""), (3, None)], "pos int, url string")
    assert [(r.pos, r.url) for r in candidates.dedup_by_canonical_url(rows, "pos").collect()] == [(0, "http://a/x")]


def test_url_dedup_across_stories(spark):
    rows = spark.createDataFrame([(1, 1, "u", "2026", 1.0, 1), (2, 2, "u", "2025", 9.0, 0), (2, 3, "", "2025", 9.0, 0), (3, 4, "u", "2024", 1.0, 1)], "story_id int, article_id int, url string, last_published_at string, temperature double, ai int")
    got = {r.story_id: (r.article_count, r.ai_count, r.raw_count) for r in export.dedup_story_urls(rows).collect()}
    assert got == {1: (1, 1, 0), 2: (1, 0, 1)}


def test_spread_samples(spark):
    rows = spark.createDataFrame([("g", k) for k in range(11)] + [("h", 1)], "g string, k int")
    got = sorted(tuple(r) for r in evaluate.spread_samples(rows, "g", "k").collect())
    assert got == [("g", k) for k in (0, 2, 5, 7, 10)] + [("h", 1)]


def test_new_rows_and_latest(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 0), ("b", 2)], "url string, n int")
    assert [tuple(r) for r in persist.new_rows(batch, batch.where("url = 'b'"), "url", "n").collect()] == [("a", 0)]
    assert sorted(tuple(r) for r in persist.latest(batch, ["url"], "n").collect()) == [("a", 1), ("b", 2)]


def test_plans_use_semi_joins_and_no_python(spark, sf):
    from mentionlake.plans.catalogue import QUERIES

    plan = QUERIES["export_articles_by_target"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_temperature_is_clamped(spark):
    assert spark.range(1).select(articles.story_temperature(F.lit(50), F.lit(9))).first()[0] == 100


def test_assigned_stories_follow_chains(spark):
    """A story is met again for as long as its last article is recent, however old its first one is."""
    from datetime import datetime

    from mentionlake.operators.stories import assign

    title = "council approves annual budget plan"
    at = lambda month, day: datetime(2026, month, day)
    rows = [(1, at(1, 1), title, "", "s", ["a"]), (2, at(1, 5), title + " today", "", "s", ["a"]), (3, at(1, 10), title + " today", "", "s", ["a", "b"]), (4, at(1, 5), title, "", "s", ["c"]), (5, at(3, 1), title, "", "s", ["a"]), (6, at(1, 5), "other words entirely here", "", "s", ["a"])]
    got = assign(spark.createDataFrame(rows, "id long, at timestamp, title string, summary string, source_name string, target_keys array<string>"))
    assert {r.article_id: r.story_id for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_report_writes_nested_columns_as_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"])], "n int, xs array<string>")
    export.write_report(rows, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().xs == '["a","b"]'
    assert spark.read.json(str(tmp_path / "json")).first().xs == ["a", "b"]
