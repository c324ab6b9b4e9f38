import random

import pytest
from pyspark.sql import functions as F

from mentionlake.operators import payload as P

ARTICLE = "articleId long, title string, url string, sourceName string, summarySource string, rawTextKey string"
RECORD = f"storyIdInt long, title string, temperature double, firstPublishedAt string, lastPublishedAt string, articleCount long, aiCount long, rawCount long, targetKeys array<string>, articles array<{P.shape(ARTICLE)}>"


def record(story, day, articles, temperature=0.0, keys=()):
    made = [(n, f"t{n}", url, "s", source, f"article-{n}" if source == "raw" else None) for n, url, source in articles]
    ai = sum(a[4] == "ai" for a in made)
    return (story, f"story {story}", temperature, day, day, len(made), ai, len(made) - ai, list(keys), made)


def plain_once(records):
    """The rule as a loop, story by story in their order."""
    seen, out = set(), {}
    for r in sorted(records, key=lambda r: (r[4] or "", r[2] or 0.0, -r[0]), reverse=True):
        kept = []
        for a in r[9]:
            url = (a[2] or "").strip()
            if not url or url not in seen:
                kept.append(a[0])
                seen |= {url} - {""}
        if kept:
            out[r[0]] = kept
    return out


def test_each_url_once(spark):
    rng = random.Random(4)
    urls = [None, "", " ", "http://hot/", " http://hot/", *(f"http://u/{k}" for k in range(12))]
    number = iter(range(1, 10**6))
    records = [record(k, f"2025-01-{rng.randint(1, 9):02d}T00:00:00+00:00", [(next(number), rng.choice(urls), rng.choice(["ai", "raw"])) for _ in range(rng.randint(0, 6))], rng.choice([0.0, 1.5])) for k in range(1, 80)]
    got = P.once_by_url(spark.createDataFrame(records, RECORD)).collect()
    assert {r.storyIdInt: [a.articleId for a in r.articles] for r in got} == plain_once(records)
    for r in got:
        assert (r.articleCount, r.aiCount) == (len(r.articles), sum(a.summarySource == "ai" for a in r.articles)) and r.rawCount == r.articleCount - r.aiCount
    twice = spark.createDataFrame([record(1, "2025", [(1, "u", "ai")]), record(1, "2025", [(2, "u", "ai"), (3, "v", "ai")])], RECORD)
    assert sum(len(r.articles) for r in P.once_by_url(twice).collect()) == 2
    assert P.once_by_url(spark.createDataFrame([], RECORD)).count() == 0


@pytest.fixture
def sides(spark):
    targets = lambda rows: spark.createDataFrame(rows, "key string, label string, primary boolean")
    texts = lambda *keys: spark.createDataFrame([(f"article-{k}", f"text {k}") for k in keys], "key string, text string")
    new = [record(1, "2025-01-03", [(1, "u1", "raw"), (2, "u2", "ai")], keys=["a"]), record(2, "2025-01-02", [(3, "u1", "raw")], keys=["a", "new_name"])]
    old = [record(1, "2024-01-01", [(1, "o1", "raw")], keys=["b"]), record(7, "2024-01-02", [(9, "u2", "ai"), (10, "o2", "raw")], keys=["b"])]
    return P.Dataset(spark.createDataFrame(new, RECORD), texts(1, 3), targets([("a", "Ana", True)])), P.Dataset(spark.createDataFrame(old, RECORD), texts(1, 10, 99), targets([("a", "x", False), ("b", None, None), ("", "y", True)]))


def test_merged(sides):
    both = P.merged(*sides)
    assert sorted((r.storyIdInt, len(r.articles)) for r in both.stories.collect()) == [(1, 2), (2, 1), (7, 2)]
    assert sorted(r.key for r in both.raw_texts.collect()) == ["article-1", "article-10", "article-3"]
    assert [tuple(r) for r in both.targets.collect()] == [("a", "Ana", True), ("b", "b", False)]
    moved = P.merged(*sides, remap=True)
    assert sorted(r.storyIdInt for r in moved.stories.collect()) == [1, 7, 8, 9]
    assert sorted((r.key, r.text) for r in moved.raw_texts.collect()) == [("article-1", "text 1"), ("article-10", "text 10"), ("article-11", "text 1"), ("article-13", "text 3")]


def test_versions_show_whole_or_not_at_all(spark, sides, tmp_path):
    path, both = str(tmp_path / "d"), P.merged(*sides)
    with pytest.raises(ValueError):
        P.published(spark, path, both.stories)
    P.publish(both, path, generated_at="g", default="a")
    one = P.published(spark, path, both.stories)
    assert sorted((r.storyIdInt, [a.articleId for a in r.articles]) for r in one.stories.collect()) == [(1, [1, 2]), (7, [10])]
    head = one.head.first()
    assert (head.meta.totalStories, head.meta.totalArticles, head.meta.initialStoryCount, head.meta.defaultTargetLabel, head.defaultTargets) == (2, 3, 1, "Ana", ["a"])
    assert [tuple(t) for t in one.targets.collect()] == [("a", "Ana", True, 1, 2), ("b", "b", False, 1, 1)]
    broken = P.Dataset(both.stories, both.raw_texts.withColumn("text", F.raise_error(F.lit("lost")).cast("string")), both.targets)
    with pytest.raises(Exception, match="lost"):
        P.publish(broken, path, generated_at="h")
    assert P.published(spark, path, both.stories).head.first().meta.generatedAt == "g"
    P.publish(P.Dataset(both.stories.limit(0), both.raw_texts.limit(0), both.targets), path, generated_at="i", default="zz")
    last = P.published(spark, path, both.stories)
    assert last.stories.count() == 0 and tuple(last.head.first().meta)[:4] == (0, 0, 0, 0) and last.head.first().defaultTargets == []
    assert P.published(spark, path, both.stories, number=1).stories.count() == 2
    assert [(r.number, r.stories, r.articles, r.rawTexts) for r in P.manifests(spark, path).orderBy("number").collect()] == [(1, 2, 3, 3), (2, 0, 0, 0)]
