"""The story scan's bounds and short cuts: the same stories as a plain scan, and few comparisons."""

import random
from datetime import UTC, datetime, timedelta
from difflib import SequenceMatcher

import pyarrow as pa
import pytest

from mentionlake.functions import similarity as S
from mentionlake.operators import stories as R


def texts(rng, n, alphabet="abcdef "):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(n // 3 + 1)]
    return [*base, *("".join(c for c in t if rng.random() > 0.1) for t in base), *("".join(c if rng.random() > 0.2 else "x" for c in t) for t in base)]


def test_pairs_of_letters_bound_the_ratio():
    rng = random.Random(5)
    for a in (sample := texts(rng, 60)):
        for b in sample:
            ratio = SequenceMatcher(None, a, b).ratio()
            assert R.possible(a, b, ratio)
            got = S.ratio_above(a, b, ratio)
            assert got == ratio
            assert S.common_subsequence(a, b, 1e9) >= S.common_subsequence(a, b) == S.common_subsequence(b, a)


def test_profiles_find_all_near_titles():
    rng, profiles = random.Random(6), R.Profiles()
    titles = texts(rng, 300, "abcdefghijkl ")
    slots = [profiles.add(t, k) for k, t in enumerate(titles)]
    for k in range(0, len(titles), 7):
        profiles.remove(slots[k])
    for t in titles[:80]:
        near = set(profiles.near(t, 0.8))
        assert near >= {k for k, x in enumerate(titles) if k % 7 and x and t and SequenceMatcher(None, t, x).ratio() >= 0.8}


def article(k, at, title, targets, words=None):
    row = {"key": "k", "stored": False, "id": k, "at": at * R.DAY, "source_name": None, "target_keys": targets, "n_articles": 0, "sources": [], "temperature": 0.0}
    return row | {"plain": title, "brief": title, "words": words or title.split(), "story_plain": None, "story_brief": None, "story_words": None}


def scanned(rows):
    return [tuple(r.values()) for b in R._scan(R.DAYS, R.THRESHOLD)(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]


@pytest.mark.parametrize("n", [400])
def test_articles_with_the_words_of_a_story_are_compared_with_none(monkeypatch, n):
    """Before, each article was compared with all stories of similar letters."""
    rng = random.Random(7)
    titles = [f"{rng.getrandbits(64):016x} {rng.getrandbits(64):016x}" for _ in range(40)]
    rows = [article(k, k / n, titles[k % 40], ["A"]) for k in range(n)]
    asked = []
    near = R.Profiles.near
    monkeypatch.setattr(R.Profiles, "near", lambda self, *a: asked.append(a) or near(self, *a))
    found = scanned(rows)
    assert [s for _, s, _ in found] == [k % 40 for k in range(n)] and {x for _, _, x in found[40:]} == {1.0}
    assert len(asked) == 40


def test_of_stories_with_the_same_words_the_warmest_counts():
    same = "alpha bravo charlie"
    rows = [article(1, 0, same, ["A"]), article(2, 0.1, "bravo charlie alpha", ["B"]), article(3, 0.2, same, ["B"]), article(4, 0.3, same, ["A", "B"]), article(5, 0.4, "alpha bravo charlie", ["C"]), article(6, 9, same, ["A"])]
    assert [(a, s) for a, s, _ in scanned(rows)] == [(1, 1), (2, 2), (3, 2), (4, 2), (5, 5), (6, 6)]


def changed(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text) + 1)
        text = text[:k] + rng.choice("abcdef ") * rng.randrange(2) + text[k + rng.randrange(2) :]
    return text


@pytest.mark.parametrize("least", [0.87, 0.5 / 0.55, 0.95])
def test_pieces_find_all_near_titles(spark, least):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    titles = sorted({t for b in base for t in (b, *(changed(rng, b, rng.randint(1, 1 + len(b) // 6)) for _ in range(4))) if t} | {"\U0001f642 and \u00e9" * 4, "\U0001f642 and e" * 4})
    texts = spark.createDataFrame([("k", t, None) for t in titles] + [("other", t, None) for t in titles[:9]], "key string, plain string, story_plain string")
    names = {r[0]: (r[1], r[2]) for r in texts.selectExpr("xxhash64(key, plain)", "key", "plain").collect()}
    got = {tuple(sorted((names[x], names[y]))) for x, y in R._near_titles(texts, least).collect()}
    near = {(("k", a), ("k", b)) for i, a in enumerate(titles) for b in titles[i + 1 :] if max(SequenceMatcher(None, *p).ratio() for p in ((a, b), (b, a))) >= least}
    assert near <= got and len(near) > 40
    assert all(x[0] == y[0] for x, y in got)


def rows_of(rng, n):
    """Titles without words, with few of them, near to others; summaries that tie some."""
    word = lambda k: "".join(rng.choice("abcdef") for _ in range(k))
    titles = [" ".join(word(rng.choice((2, 3, 3, 7))) for _ in range(rng.randint(1, 9))) for _ in range(n // 5)]
    rows = []
    for k in range(n):
        title = rng.choice(titles)
        title = changed(rng, title, rng.randrange(3)) if rng.random() < 0.6 else title
        summary = rng.choice((title, "", "the same old summary of these articles", word(9) + " " + word(9)))
        rows.append((k, datetime(2026, 1, 1, tzinfo=UTC) + timedelta(hours=rng.randrange(700)), title.strip(), summary.strip(), rng.choice("xyz"), rng.sample("abc", rng.randrange(1, 3))))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_scans_parted_by_texts_find_the_same_stories(spark, monkeypatch, seed):
    rows = spark.createDataFrame(rows_of(random.Random(seed), 300), "id long, at timestamp, title string, summary string, source_name string, target_keys array<string>")
    want = sorted(R.assign(rows).collect())
    monkeypatch.setattr(R, "LARGE", 0)
    monkeypatch.setattr(R, "HUB", 1)
    keys = []
    whole = R.parted
    monkeypatch.setattr(R, "parted", lambda *a: keys.append(whole(*a)) or keys[-1])
    assert sorted(R.assign(rows).collect()) == want
    assert 10 < keys[0].select("key").distinct().count() and 20 < sum(score is None for _, _, score in want) < 290
    old, late = rows.where("id < 150"), rows.where("id >= 150")
    edges = R.assign(old)
    state = R.stories_after(old, edges).drop("created_at").localCheckpoint()
    parts = sorted(R.assign(late, state).collect())
    monkeypatch.setattr(R, "LARGE", 10**9)
    assert sorted(R.assign(late, state).collect()) == parts


def test_unlike_titles_are_scans_of_their_own(spark, monkeypatch):
    """Before, all articles of a target were one task, in which each new title met all stories of the last days."""
    monkeypatch.setattr(R, "LARGE", 0)
    rng = random.Random(9)
    titles = [f"{rng.getrandbits(64):016x} {rng.getrandbits(64):016x}" for _ in range(300)]
    rows = [(k, datetime(2026, 1, 1, tzinfo=UTC) + timedelta(minutes=k), titles[k % 300], titles[k % 300], "x", ["a"]) for k in range(900)]
    keyed = []
    monkeypatch.setattr(R, "parted", lambda *a, of=R.parted: keyed.append(of(*a)) or keyed[-1])
    edges = R.assign(spark.createDataFrame(rows, "id long, at timestamp, title string, summary string, source_name string, target_keys array<string>"))
    assert {r.article_id: r.story_id for r in edges.collect()} == {k: k % 300 for k in range(900)}
    assert keyed[0].select("key").distinct().count() == 300
