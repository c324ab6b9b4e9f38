from collections import Counter

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from mentionlake.llm import bpe, toxicity
from mentionlake.llm.common import settled, table

STAGES = dict(corpus_pipeline.STAGES)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names of helper columns of the stages and of what they call.
HELPERS = ["d", "copy", "at", "gone", "listed", "bucket", "bit", "bitmap", "likely_toxic", "kept", "n_removed", "size", "turn", "place", "h1", "id", "m0", "ids"]


def test_stages_one_by_one(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        after = settled(stage(spark, docs, sf))
        got = {r.doc_id: r for r in after.collect()}
        if name != "bpe":
            assert after.columns == columns and set(got) <= {d for d, _ in before}
        if name == "toxicity":
            scores = {r.doc_id: r.likely_toxic for r in toxicity.score(docs.select("doc_id", "text"), *toxicity.train(docs, toxicity.learnable(table(spark, sf, "labels")))).collect()}
            assert set(got) == {d for d, s in scores.items() if s < 0.7} and len(got) < len(before)
        if name == "line_dedup":
            gone = brute.lines_gone(before)
            for d, text in before:
                kept = "\n".join(x for k, x in enumerate((text or "").split("\n")) if (d, k) not in gone)
                assert d not in got and not kept.strip() or got[d].text == kept
        if name == "jaccard_join":
            assert set(got) == {d for d, c, _ in brute.jaccard(before) if d == c}
        if name == "mixing":
            want = brute.mixed([(r.doc_id, r.text, r.source) for r in docs.collect()])
            assert Counter(r.doc_id for r in after.collect()) == want
        if name == "bpe":
            texts = dict(before)
            n = brute.library_tokens(bpe.public_vocabulary(), list(texts.values()))
            want = {d: k for d, k in zip(texts, n, strict=True)}
            assert after.count() == len(before) and {d: r.n_tokens for d, r in got.items()} == want
        docs = after


@pytest.mark.parametrize("name", STAGES)
def test_stages_with_clashing_columns_and_empty_tables(spark, sf, name):
    docs = table(spark, sf, "documents").limit(30)
    for k in HELPERS:
        docs = docs.withColumn(k, F.lit(k))
    assert STAGES[name](spark, docs.limit(0), sf).count() == 0
    rows = STAGES[name](spark, docs, sf)
    assert rows.count() > 0
    if name != "bpe":
        assert rows.columns == docs.columns and all(r[k] == k for r in rows.collect() for k in HELPERS)


@pytest.mark.parametrize("name", STAGES)
def test_stages_with_nulls_and_repeated_rows(spark, sf, name):
    rows = [(1, "one text of its own and more", "en", "a", 28), (1, "another text with that id", "en", "b", 25), (1, "another text with that id", "en", "b", 25), (None, "a text without an id", "en", None, 20), (None, None, None, None, None), (4, "", "en", "a", 0), (5, "long words here " * 30_000, "en", "a", 480_000)]
    got = [r.asDict() for r in STAGES[name](spark, spark.createDataFrame(rows, DOCUMENTS), sf).collect()]
    ids = Counter(r["doc_id"] for r in got)
    if name == "mixing":  # every source keeps its own copies
        assert {(r["doc_id"], r["text"]) for r in got} <= {r[:2] for r in rows} and all(r["text"] for r in got)
        assert ids == brute.mixed([(d, t, s) for d, t, _, s, _ in rows])
    elif name == "line_dedup":
        assert ids == Counter(r[0] for r in rows)
    elif name == "jaccard_join":
        assert ids == Counter(r[0] for r in rows)
    elif name == "bpe":
        assert ids == Counter(r[0] for r in rows) and sum(r["n_tokens"] == 0 for r in got) == 2
