import corpus_pipeline
from mentionlake.llm import bpe


def test_the_pipeline_hands_small_batches_to_python(spark, monkeypatch):
    """Before, batches of 10,000 rows and groups of a megabyte, on executors that all stages had filled."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        asked, made = [], bpe._encode
        monkeypatch.setattr(bpe, "_encode", lambda spec, n: asked.append(n) or made(spec, n))
        docs = spark.createDataFrame([(k, f"some words {k} " * 9) for k in range(30)], "doc_id long, text string")
        out = corpus_pipeline.tokenize(spark, docs, "")
        assert asked == [400_000] and spark.conf.get(name) == "2000"
        assert sorted(out.collect()) == sorted(bpe.digests(bpe.encode(docs, bpe.public_vocabulary(), 1_000_000)).collect())
        spark.conf.set(name, 500)
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(name) == "500"
    finally:
        spark.conf.set(name, was)
