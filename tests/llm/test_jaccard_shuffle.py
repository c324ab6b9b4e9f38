"""What the Jaccard join moves for copies, and its results where bitmaps are of little use."""

import functools
import random

import brute
import pytest

from mentionlake.llm import common
from mentionlake.llm import jaccard_join as jaccard


def written(spark):
    """Bytes of shuffles so far, and of those the rest of the session wrote before."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_texts_of_copies_are_not_shuffled(spark, tmp_path):
    rng = random.Random(3)
    kinds = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(500)) for _ in range(300)]
    rows = [(i, kinds[i % 300]) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables too large for it
    try:
        before = written(spark)
        got = jaccard.jaccard_join(docs).collect()
        moved = written(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r.doc_id, r.copy_of, r.class_id, r.n_links) for r in got) == [(i, i % 300, i % 300, 2) for i in range(900)]
    # Rows of buckets take 32 bytes of sketch each; the texts are 7 MB.
    assert moved < 0.2 * sum(len(t) for _, t in rows), moved


def test_rows_alone_in_their_bucket_are_not_shuffled_with_sketches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(60))) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written(spark)
        got = jaccard.jaccard_join(docs).collect()
        moved = written(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in got) and len(got) == 2000
    # About CHOICES rows a run and document: their sketches of 32 bytes alone would be more.
    assert moved < 32 * jaccard.CHOICES * jaccard.runs_needed() * len(rows), moved


@pytest.mark.parametrize("bits", [1, 64])
def test_bitmaps_that_list_nearly_all(texts, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "maybe_among", functools.partial(common.maybe_among, most_bits=bits))
    rng = random.Random(bits)
    pool = [" ".join(f"v{(s * 31 + i * (s + 1)) % 997}" if i not in c else "other" for i in range(40)) for s in range(9) for c in ((), (0,), (39,))] + ["", None, "a b", "a  b"]
    rows = [(i, rng.choice(pool)) for i in range(24)] + [(rng.randrange(24, 30), rng.choice(pool)) for _ in range(12)] + [(3, pool[0]), (3, pool[0]), (None, pool[0])]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(texts(rows)).collect()), key=repr)
    assert got == brute.jaccard(rows)
