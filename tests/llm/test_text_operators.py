import zlib

import brute
import pytest

from mentionlake.llm import jaccard_join, line_dedup, lm_score, substring_dedup

BASE = " ".join(f"w{i}" for i in range(100))
NEAR = [
    (7, BASE), (3, BASE + " x"), (9, None), (10, ""), (None, BASE), (3, BASE + " x"), (4, "q r"), (5, "q r"), (6, "one"),
    (12, " ".join(f"w{i}" if i != 50 else "zz" for i in range(100))), (13, " ".join(f"w{i}" if i % 10 else "zz" for i in range(100))),
]
LINES = [
    (50, "a b c d e f g\nx y\n\nq w e r t y"), (51, "a b c d e f\nx y\nq w e r t y u"), (52, "a b Z d e f g\nzz a b c d e f g"), (53, None), (54, ""),
    (None, "a b c d e f g h\nnew line of its own"), (50, "a b c d e f g\nx y\n\nq w e r t y"), (55, "long " * 3000 + "\n" + "long " * 2999),
]
PASSAGE = " ".join(f"p{i}" for i in range(30))
REPEATS = [(7, f"x {PASSAGE} y z"), (3, f"{PASSAGE} q"), (9, None), (10, ""), (11, "aa " * 50), (None, f"k {PASSAGE}"), (12, " ".join(f"u{i}" for i in range(20))), (3, f"{PASSAGE} q")]
TOKENS = [(7, "A b c a b c"), (3, "a b d"), (9, None), (10, ""), (None, "zz yy a B"), (3, "a b d"), (4, "q r s t"), (5, "x " * 30), (6, "a b c d")]


def pairs(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("options", [{}, {"small": 3, "block": 2}])
def test_jaccard_join(docs, texts, options):
    for df in (docs, texts(NEAR)):
        got = jaccard_join.jaccard_join(df, **options)
        assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=repr) == brute.jaccard(pairs(df))


def test_jaccard_join_of_nothing(docs):
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert jaccard_join.runs_needed(0.999) >= jaccard_join.runs_needed(0.9) >= 1


def test_line_dedup(docs, texts):
    for df in (docs, texts(LINES), docs.limit(0)):
        assert {tuple(r) for r in line_dedup.repeated_lines(df).collect()} == brute.lines_gone(pairs(df))


def test_line_dedup_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e\na b c d e", "k"), (2, None, None)], "doc_id long, text string, line string")
    got = {r.doc_id: (r.kept, r.n_removed, r.line) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: ("a b c d e", 1, "k"), 2: ("", 0, None)}


def test_line_dedup_runs_no_python(docs):
    assert "Python" not in line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()


def test_substring_dedup(docs, texts):
    for df in (docs, texts(REPEATS), docs.limit(0)):
        got = substring_dedup.remove_repeats(df, chunk_words=20000)
        assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got.collect()), key=repr) == brute.repeats(pairs(df))


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


@pytest.mark.parametrize("options", [{}, {"common_words": 50, "pairs": 40, "part_tokens": 3000}, {"common_words": 1, "pairs": 1, "part_tokens": 5000}])
def test_lm_score(docs, texts, options):
    for df in (docs, texts(TOKENS)):
        total, want = brute.language_model(pairs(df), lambda d: not held_out(d))
        rows = lm_score.score_texts(df, chunk_tokens=20000, **options).collect()
        assert {r.train_tokens for r in rows} == {total} and all(r.held_out == held_out(r.doc_id) for r in rows)
        order = lambda x: (x[0] is None, x[0] or 0, x[1:])
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows), key=order)
        assert len(got) == len(want)
        for x, y in zip(got, sorted(want, key=order), strict=True):
            assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], rel=1e-9) and x[4] == pytest.approx(y[4], rel=1e-5)


def test_lm_with_clashing_columns_and_long_texts(spark):
    df = spark.createDataFrame([(1, "a b " * 50_000, 1.0, "x"), (2, "a c", 2.0, "y"), (2, "b", 2.0, "y")], "doc_id int, text string, score double, chunk string")
    got = {(r.doc_id, r.n_tokens) for r in lm_score.score_texts(df).collect()}
    assert got == {(1, 100_001), (2, 3), (2, 2)}


def test_lm_without_training_texts(texts):
    (d,) = [d for d in range(20) if held_out(d)][:1]
    (row,) = lm_score.score_texts(texts([(d, "a b")])).collect()
    assert (row.n_known, row.train_tokens, row.score) == (0, 0, 0.0)


def test_lm_beats_its_base_on_held_out_texts(docs):
    held = [r for r in lm_score.score_texts(docs).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_of_nothing(docs):
    assert lm_score.score_texts(docs.limit(0)).count() == 0


CLASHES = ["id", "d", "k1", "k2", "n", "bucket", "starts", "copies", "listed", "part", "words"]


def clashing(spark, rows):
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))


def test_joins_and_dedup_with_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long.replace("w500 ", "other ")), (3, "a b c d e f"), (4, None), (5, long[:200_000])]
    df = clashing(spark, rows)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df).collect()) == brute.jaccard(rows)
    got = substring_dedup.remove_repeats(df)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got.collect()), key=repr) == brute.repeats(rows)
