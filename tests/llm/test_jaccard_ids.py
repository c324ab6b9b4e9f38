"""The Jaccard join where rows with one doc_id have different texts."""

import random

import brute

from mentionlake.llm.jaccard_join import jaccard_join


def found(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=repr)


def text(seed, n=40, changed=()):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10_000)}" for _ in range(n)]
    for i in changed:
        words[i] = "other"
    return " ".join(words)


def test_one_id_with_two_texts(texts):
    rows = [(1, text(1)), (1, text(2)), (2, text(1, changed=[0])), (3, text(2, changed=[39]))]
    assert found(jaccard_join(texts(rows))) == brute.jaccard(rows) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_ids_in_all_mixtures(texts):
    rng = random.Random(7)
    pool = [text(s, changed=c) for s in range(12) for c in ((), (0,), (39,), (0, 1))] + ["", None, "a b", "a b"]
    rows = [(rng.choice([*range(-3, 25), None, -(2**40)]), rng.choice(pool)) for _ in range(160)]
    assert found(jaccard_join(texts(rows))) == brute.jaccard(rows)


def test_an_id_that_has_no_words_elsewhere(texts):
    rows = [(5, None), (5, text(3)), (6, text(3, changed=[0])), (5, ""), (7, text(3))]
    assert found(jaccard_join(texts(rows))) == brute.jaccard(rows)
