"""The stateful rule against a plain one, article by article, that scores every story with the standard library's matcher alone."""

import random
from datetime import UTC, datetime, timedelta
from difflib import SequenceMatcher

import pytest

from mentionlake.functions.similarity import common_subsequence, ratio_above
from mentionlake.operators import stories
from mentionlake.plans import catalogue
from mentionlake.streaming.story_store import StoryStore

SCHEMA = "id long, at timestamp, title string, summary string, source_name string, target_keys array<string>"
START = datetime(2026, 1, 1, tzinfo=UTC)


def tokens(text):
    return {w for w in text.split() if len(w) >= 4 and w not in stories.STOP_WORDS}


def similarity(a, b):
    if not a or not b:
        return 0.0
    x, y = tokens(a), tokens(b)
    ratio = SequenceMatcher(None, a, b).ratio()
    return max(ratio * (0.55 if len(x & y) < 2 else 1), len(x & y) / len(x | y) if x and y else 0.0)


def plain(rows, days=7):
    """{article: (story, score)} and the stories; titles hold no URLs and no names of sites."""
    known, edges = {}, {}
    for i, at, title, summary, source, keys in sorted(rows, key=lambda r: (r[1], r[0])):
        best, best_score = None, 0.0
        for s, story in sorted(known.items(), key=lambda x: (-x[1]["temperature"], -x[1]["updated"].timestamp(), x[0])):
            if story["updated"] < at - timedelta(days) or not story["targets"] & set(keys):
                continue
            of_title = similarity(title, story["title"])
            if len(tokens(title) & tokens(story["title"])) < 2 and of_title < 0.45:
                continue
            score = max(of_title, similarity(summary, story["summary"]) * 0.65)
            if score > best_score:
                best, best_score = s, score
        if best is None or best_score < 0.5:
            best, best_score = i, None
            known[i] = {"title": title[:220] or "Nova historia", "summary": summary[:800] or title[:220], "targets": set(), "sources": set(), "n": 0}
        story = known[best]
        story["n"] += 1
        story["sources"].add(source)
        story["targets"] |= set(keys)
        story["temperature"] = min(100.0, 22.0 + 9 * story["n"] + 6 * len(story["sources"]))
        story["updated"] = at
        edges[i] = (best, best_score)
    return edges, known


def made(seed, n=160, hours=900, words=None):
    rng = random.Random(seed)
    words = words or ["council", "budget", "river", "plan", "it", "is", "an", "old", "cat", "cats", "rivers", "mayor", "vote", "votes", "school"]
    sentence = lambda k: " ".join(rng.choices(words, k=k))
    return [(k, START + timedelta(hours=rng.randrange(hours)), sentence(rng.randrange(7)), sentence(rng.randrange(30)), rng.choice("xyz"), rng.sample("abcd", rng.randrange(1, 3))) for k in range(n)]


def found(df):
    return {r.article_id: (r.story_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_articles_one_by_one(spark, seed):
    rows = made(seed)
    edges, _ = plain(rows)
    assert found(stories.assign(spark.createDataFrame(rows, SCHEMA))) == edges
    assert 20 < sum(score is None for _, score in edges.values()) < 140


def test_gaps_and_targets_part_the_scan(spark):
    rows = [r[:5] + ([f"{r[5][0]}{r[0] % 3}"],) for r in made(9, 200, 4000)]
    edges, _ = plain(rows)
    assert found(stories.assign(spark.createDataFrame(rows, SCHEMA))) == edges


def test_documents(spark, sf):
    """The registered query, on the first sentences and the summaries of all documents."""
    df = catalogue.QUERIES["assigned_stories"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = catalogue.F.coalesce("text", catalogue.F.lit(""))
    prepared = docs.select("doc_id", "lang", "source", catalogue.T.capped(catalogue.F.get(catalogue.F.split(text, "[.!?\n]"), catalogue.F.lit(0)), "title").alias("t"), catalogue.T.summarize(text).alias("s"))
    plain_text = lambda c: catalogue.T.normalize_text(catalogue.T.clean_title(catalogue.F.col(c)))
    rows = [(r.doc_id, START + timedelta(seconds=864 * r.doc_id), r.t, r.s, r.source, [r.lang]) for r in prepared.select("doc_id", "lang", "source", plain_text("t").alias("t"), plain_text("s").alias("s")).collect()]
    assert found(df) == plain(rows)[0]


def test_titles_that_share_fewer_than_two_words(spark):
    rows = [
        (1, "council", "", ["a"]), (2, "council", "", ["a"]), (3, "council budget", "", ["a"]), (4, "it is so", "", ["b"]), (5, "it is so", "", ["b"]),
        (6, "oh my old cat ran up a big hill", "the same text of both of these articles", ["c"]), (7, "oh my old dog ran up a big hall", "the same text of both of these articles", ["c"]),
        (8, "council meets early", "the same text of both of these articles", ["d"]), (9, "council grows later", "the same text of both of these articles", ["d"]), (10, "council", "", []), (11, "council", "", None),
    ]
    got = found(stories.assign(spark.createDataFrame([(i, START, t, s, "x", k) for i, t, s, k in rows], SCHEMA)))
    assert {i: s for i, (s, _) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 11}


def test_nulls_and_an_empty_table(spark):
    rows = [(1, START, None, None, None, ["a"]), (2, START, None, None, None, ["a"]), (3, START, "council budget", None, None, ["a"]), (4, START, "council budget", None, "x", ["a", "a"])]
    assert {i: s for i, (s, _) in found(stories.assign(spark.createDataFrame(rows, SCHEMA))).items()} == {1: 1, 2: 2, 3: 3, 4: 3}
    assert stories.assign(spark.createDataFrame([], SCHEMA)).count() == 0


def test_store_in_batches(spark, tmp_path):
    """Three batches give what one gives; a batch run again, or cut off before its mark, changes nothing."""
    rows = sorted(made(21), key=lambda r: (r[1], r[0]))
    edges, known = plain(rows)
    store = StoryStore(spark, str(tmp_path / "store"))
    frames = [spark.createDataFrame(rows[a:b] * 2, SCHEMA) for a, b in ((0, 60), (60, 61), (61, 160))]
    store.apply(0, frames[0])
    for name in ("stories", "story_articles", "story_targets"):
        frames[0].limit(3).selectExpr("id as wrong").write.parquet(f"{tmp_path}/store/{name}/batch-1")
    store.apply(1, frames[1])
    before = sorted(map(tuple, store.stories().select("id", "n_articles", "temperature").collect()))
    for number, frame in ((0, frames[0]), (1, frames[2]), (2, frames[1])):
        store.apply(number, frame)
    assert sorted(map(tuple, store.stories().select("id", "n_articles", "temperature").collect())) == before
    store.compact()
    store.compact()
    store.apply(2, frames[2])
    store.apply(3, frames[2])
    assert found(store.story_articles()) == edges and store.story_articles().count() == 160
    got = {r.id: (r.title, r.summary, r.temperature, r.n_articles, set(r.sources), set(r.target_keys)) for r in store.stories().collect()}
    assert got == {i: (s["title"], s["summary"], s["temperature"], s["n"], s["sources"], s["targets"]) for i, s in known.items()}
    assert {(r.story_id, r.target_key) for r in store.story_targets().collect()} == {(i, t) for i, s in known.items() for t in s["targets"]}
    some = next(iter(known))
    assert {r.target_key for r in store.targets_of(some).collect()} == known[some]["targets"]


def test_store_follows_a_stream(spark, tmp_path):
    rows = sorted(made(22, 60), key=lambda r: (r[1], r[0]))
    store, source = StoryStore(spark, str(tmp_path / "store")), str(tmp_path / "in")
    for a, b in ((0, 25), (25, 60)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        store.follow(spark.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "check")).awaitTermination()
    assert found(store.story_articles()) == plain(rows)[0] and len(store.marks()) == 2


def test_bounds():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcdef ", k=rng.randrange(40))) for _ in range(2))
        exact = SequenceMatcher(None, a, b).ratio()
        blocks = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        assert blocks <= common_subsequence(a, b) <= min(len(a), len(b))
        for least in (0.2, 0.5, 0.8, exact):
            assert (got := ratio_above(a, b, least)) == exact or got is None and exact < least


def test_ingestion_ends_in_stories(spark, tmp_path):
    """Candidates become articles, mentions and stories in one run; a second run of the same batch changes nothing."""
    from mentionlake.operators import ingest

    body = "Ana Sá speaks on the budget of the city council " * 6
    rows = [("http://a/1", 1, "Council votes new budget", body), ("http://a/2", 2, "Council votes new budget today", body), ("http://a/3", 3, "River floods old town", "Bo Li was there. " * 12), ("http://a/4", 4, "No one", "nothing " * 30)]
    made = spark.createDataFrame([(u, k, t, b, b, "2026-01-01", None, False, False, "s") for u, k, t, b in rows], "url string, pos long, title string, summary string, body string, published_at string, fetch_error string, needs_date boolean, exact_body boolean, source string")
    stored = spark.createDataFrame([], "url string")
    out = ingest.ingest(made, stored, [("ana", "Ana Sá"), ("bo", "Bo Li")], source="source", per_source=10, names={})
    store = StoryStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        store.apply(0, ingest.story_rows(out["articles"], out["mentions"], catalogue.F.to_timestamp("published_at")))
    got = sorted((r.n_articles, r.target_keys) for r in store.stories().collect())
    assert got == [(1, ["bo"]), (2, ["ana"])] and store.story_articles().count() == 3
