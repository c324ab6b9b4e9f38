import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from mentionlake.llm import additive_index, bpe, kd_search, mixing, toxicity, url_filter
from mentionlake.llm.queries import ORACLES, QUERIES
from mentionlake.llm.vectors import by_length, clean

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, duck, sf, name):
    assert_same(QUERIES[name](spark, sf), duck.sql(ORACLES[name]))


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# --- BPE


LETTERS = "abcDEF  \n\t\r\x1c\x85\xa0\u3000\u2003 'stllveremd123éüñ漢字🙂.,!?-_\x00\x0b"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_vocabulary())


def as_library(library, texts):
    """(n_tokens, ids, decoded) of each text by the library."""
    out = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [(len(x.ids), ",".join(map(str, x.ids)), library.decode(x.ids, skip_special_tokens=False)) for x in out]


def test_bpe_is_that_of_the_library(library):
    ours = bpe.Bpe(open(bpe.public_vocabulary(), encoding="utf-8").read())
    random.seed(1)
    texts = ["".join(random.choice(LETTERS) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>a <|endoftext|>  b", "<|endof", "text|>", "<|endoftext|><|endoftext|> '", "  ", "a  ", " \n a\n\n b", "x" * 3000, "I'll've don't 'S", "it's's 're''s 'llx", " " * 700 + "a", "\n" * 40, "0007687190000", None]
    for part in (texts, texts[-5:], [], [None], ["", ""]):
        n, ids, decoded = ours.run(pa.array(part, pa.string()))
        assert list(zip(n.tolist(), ids.to_pylist(), decoded.to_pylist(), strict=True)) == as_library(library, part)


def test_bpe_query_is_that_of_the_library(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {d: (n, sha(ids), sha(text)) for d, (n, ids, text) in zip(texts, as_library(library, texts.values()), strict=True)}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op7_bpe(spark, sf).collect()} == want


def test_bpe_edges(spark, texts):
    rows = bpe.encode(texts([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a")]), bpe.public_vocabulary()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [(0, 1, "a"), (1, 0, ""), (2, 0, ""), (3, 2, "a b"), (3, 2, "a b")]
    clash = spark.createDataFrame([(1, "a b " * 100_000, "x", 1)], "doc_id long, text string, ids string, n_tokens int")
    (row,) = bpe.encode(clash, bpe.public_vocabulary()).collect()
    assert row.decoded == "a b " * 100_000 and row.n_tokens == row.ids.count(",") + 1
    assert bpe.encode(clash.limit(0), bpe.public_vocabulary()).count() == 0


# --- URL filter


def test_url_filter_edges(spark):
    urls = [None, "no scheme", "http://EXAMPLE.com/en/x?y", "http://www.example.com/en/x", "http://example.com", "http://example.com/de/", "http://a.net/es/", "http://net/es/#f", "http://xnet/es/", "http://a.org/", "://com/", "http://example.com/en/x?y"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(11, urls[11], "x")], "page_id long, url string, host string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, url_filter.RULES)).collect())
    rules = [None, None, "example.com/en/", "www.example.com/en/", None, "com/", "net/es/", "net/es/", None, None, "com/", "example.com/en/", "example.com/en/"]
    assert [r for _, r, _ in got] == rules
    assert [v for *_, v in got] == ["block" if r in ("example.com/en/", "net/es/") else "allow" for r in rules]
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_url_filter_with_very_long_urls(spark):
    urls = ["http://example.com/en/" + "x/" * 100_000, "http://" + "a." * 50_000 + "net/es/", "http://net/fr/" + "?" * 100_000]
    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in rows} == {0: ("example.com/en/", "block"), 1: ("net/es/", "block"), 2: ("net/fr/", "block")}


def test_url_filter_runs_no_python(spark, sf):
    assert "Python" not in url_filter.op8_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()


# --- mixing


def test_mix_with_clashing_columns(spark):
    names = ["size", "turn", "bucket", "s", "b", "target", "copy", "at", "rest", "epochs"]
    df = spark.createDataFrame([(k, "w " * (k % 5), "ab"[k % 2], *names) for k in range(60)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    assert mixing.mix_sources(df).count() == 60
    taken = mixing.training_order(df)
    assert taken.columns == df.columns and all(r[n] == n for r in taken.collect() for n in names)


def test_mix_meets_targets_and_caps(spark):
    rows = [(k, " ".join(["w"] * (k % 7)), ["a", "b", "c", None][k % 4]) for k in range(400)] + [(400, None, "a"), (5, "w w", "b"), (5, "w w", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    for source in ("a", "b", "c", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
        assert own[0].target <= 3 * own[0].source_size and all(0 <= r.taken <= 3 * r.size for r in own)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=repr)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_positions_follow_the_schedule(spark):
    at = spark.range(101).select((F.col("id") / 100).alias("share")).withColumn("t", mixing.training_time(F.col("share"), F.lit(0.5)))
    for r in at.collect():
        assert r.t + 0.5 * (r.t**2 - r.t) == pytest.approx(r.share)


# --- vectors


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def test_additive_index_recall(spark, vectors, sf):
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = additive_index.op4_additive_index(spark, sf).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hits = 0
    for q, found in by.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]])
        hits += len(want & {r.vec_id for r in found})
        assert [r.rank for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, 21))
        assert all(r.score == pytest.approx(s[ids == r.vec_id][0], abs=1e-12) for r in found)
    assert len(by) == (ids % 20 == 0).sum() and hits >= 0.9 * 20 * len(by)


EDGES = [(0, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (40, None, 1), (60, [float("nan"), 1.0], 1), (80, [None, 1.0], 1), (100, [0.0, 0.0], 1), (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0], 1), (3, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1)]


def test_vector_edges(spark):
    df = spark.createDataFrame(EDGES, VECTORS)
    v = clean(df, zero=False)
    assert sorted(r.vec_id for r in v.collect()) == [0, 1, 1, 2, 20]
    got = by_length(additive_index.search, v, v.where("vec_id % 20 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 5.0), (0, 2, 1, 5.0), (0, 3, 20, 5.0), (20, 1, 0, 5.0), (20, 2, 1, 5.0), (20, 3, 1, 5.0)]
    w = kd_search.whole(clean(df, zero=True))
    got = by_length(kd_search.search, w, w.where("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 327680), (0, 2, 1, 327680), (0, 3, 20, 327680), (0, 4, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 1, 0), (100, 4, 20, 0)]
    empty = clean(df.limit(0), zero=True)
    assert by_length(kd_search.search, empty, empty).count() == 0 and by_length(additive_index.search, empty, empty).count() == 0


def test_repeated_vec_ids(spark, tmp_path, monkeypatch):
    """Each row is a vector of its own, whichever of an id's it is: as candidate, for rows of its own id too, and as query."""
    import duckdb

    rng = np.random.default_rng(11)
    rows = [(int(rng.integers(0, 8)) * 25, [float(x) for x in rng.integers(-6, 7, 3) / 2]) for _ in range(400)] + [(1, [5.0] * 3), (1, [9.0] * 3), (None, [9.0] * 3), (7, [])]
    spark.createDataFrame([(*r, 0) for r in rows], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(kd_search, "SHARD", 100)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    plain = lambda rows: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows)
    want = con.sql(f"select query_id, rank, vec_id, score from ({kd_search.ORACLE})").fetchall()
    assert plain(kd_search.op6_kd_search(spark, str(tmp_path)).collect()) == sorted(want)
    assert len(want) == 5 * sum(k is not None and k % 50 == 0 for k, _ in rows)
    x, ids = np.array([v for k, v in rows if k is not None and v]), np.array([k for k, v in rows if k is not None and v])
    there = np.flatnonzero(np.abs(x).sum(1) > 0)
    want = []
    for q in there[ids[there] % 20 == 0]:
        others = there[there != q]
        scores = x[others] @ x[q]
        order = np.lexsort((ids[others], -scores))[:20]
        want += [(int(ids[q]), n + 1, int(ids[others][j]), float(scores[j])) for n, j in enumerate(order)]
    got = plain(additive_index.op4_additive_index(spark, str(tmp_path)).collect())
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.97 * len(set(want))


def test_kd_search_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [int(x) for x in rng.integers(-(10**9), 10**9, 8)]) for k in range(300)] + [(300, [2**62] * 8), (301, [2**62] * 8)]
    v = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in rows], "vec_id long, v array<double>").withColumn("row", F.col("vec_id") * 7)
    want = []
    for q, x in rows[::50]:
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(int(float(a)) * int(float(b)) for a, b in zip(x, y, strict=True)))), k) for k, y in rows if k != q)
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scores[:5])]
    got = kd_search.search(v, v.where("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_kd_search_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(kd_search, "SHARD", 200)
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (1500, 6)).astype(float)
    v = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, v array<double>").withColumn("row", F.col("vec_id") * 7)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in kd_search.search(v, v.where("vec_id % 50 = 0")).collect())
    want, ids = [], np.arange(1500)
    for q in range(0, 1500, 50):
        s = x @ x[q]
        s[q] = -np.inf
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(np.lexsort((ids, -s))[:5])]
    assert got == sorted(want)


def test_kd_search_joins_no_packs(spark, monkeypatch):
    """A pack of queries is made once for each shard; its size before that says nothing of the size after it, so a join sent all copies through the driver."""
    monkeypatch.setattr(kd_search, "SHARD", 50)
    v = spark.range(2000).select(F.col("id").alias("row"), F.col("id").alias("vec_id"), F.array(*((F.col("id") * p % 101).cast("double") for p in (3, 7, 11))).alias("v"))
    found = kd_search.search(v, v.where("vec_id % 5 = 0"))
    assert found.count() == 5 * 400
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in plan]
    for k, line in enumerate(plan):
        if "Join" in line:
            end = next((n for n in range(k + 1, len(plan)) if depth[n] <= depth[k]), len(plan))
            assert not [x for x in plan[k:end] if "MapInArrow" in x]


# --- toxicity


def test_toxicity_on_held_out_texts(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op5_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    toxic, fine = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([a > b for a in toxic for b in fine]) > 0.9
    assert np.mean([s >= 0.7 for s in fine]) < 0.02


def test_toxicity_without_labels(spark, texts):
    docs = texts([(1, "a b"), (2, None), (3, ""), (None, "c")])
    none = spark.createDataFrame([(9, 1)], "doc_id long, toxic int").limit(0)
    got = toxicity.score(docs, *toxicity.train(docs, none)).collect()
    assert len(got) == 4 and {r.likely_toxic for r in got} == {0.0}


def test_toxicity_models_are_plain_kneser_ney():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    counts = {w: (rng.randint(0, 3), rng.randint(1, 9)) for w in words}
    batch = pa.RecordBatch.from_arrays([pa.array(list(counts)), *(pa.array([c[k] for c in counts.values()]) for k in (0, 1))], names=["word", "toxic", "ordinary"])
    (grams,) = toxicity._grams([batch])
    models = toxicity.Models(np.stack([c.to_numpy() for c in grams.columns[: toxicity.ORDER]]), *(grams.column(k).to_numpy() for k in ("toxic", "ordinary")))
    asked = [*words[:50], "zzz", "abcde", "", "a"]
    assert models.words(asked) == pytest.approx(brute.kneser_ney(counts, asked), abs=1e-4)


def test_toxicity_edges(spark):
    rows = [(k, ("vile words here " if k % 3 == 0 else "kind words there ") * 3, "x", 0.5) for k in range(60)]
    docs = spark.createDataFrame([*rows, (3, "vile words here", "x", 0.5), (3, "vile words here", "x", 0.5), (61, "kind words there " * 50_000, "x", 0.5), (62, None, "x", 0.5), (None, "", "x", 0.5)], "doc_id long, text string, word string, m0 double")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(5, None), (None, 1), (7, 5)], "doc_id long, toxic int")
    models = toxicity.train(docs, labels)
    got = toxicity.score(docs, *models).collect()
    assert len(got) == 65 and all(0 <= r.likely_toxic <= 1 and r.m0 == 0.5 for r in got)
    by = {r.doc_id: r.likely_toxic for r in got}
    assert by[3] > by[61] and by[62] == by[None]
    assert toxicity.score(docs.limit(0), *models).count() == 0
