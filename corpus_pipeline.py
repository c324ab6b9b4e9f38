"""A training-data pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Every stage but the last takes and returns the columns of documents. ``STAGES`` lists them in order; ``run`` applies them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm import bpe, toxicity
from mentionlake.llm.common import settled, table, without_ids
from mentionlake.llm.jaccard_join import jaccard_join
from mentionlake.llm.line_dedup import dedup_lines
from mentionlake.llm.mixing import training_order

#: Helper columns, named so that no column of documents clashes with them.
SCORE, LINES = "__stage_score", ("__stage_lines", "__stage_removed", "__stage_kept")


#: Rows that Spark hands to Python at a time, and bytes of text that BPE encodes at a time: executors that ran all stages before have little memory left.
BATCH_ROWS, GROUP_BYTES = 2000, 400_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch to BATCH_ROWS; a lower bound that a user set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go; the models learn from the labels that op5 may learn from. Rows that repeat a document are scored each; one without text has the score of an empty text."""
    small_batches(spark)
    labels = toxicity.learnable(table(spark, sf_dir, "labels"))
    return toxicity.score(docs, *toxicity.train(docs, labels), into=SCORE).where(F.col(SCORE) < toxicity.THRESHOLD).select(*columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go. A document of which nothing but white space is left goes too; one that was empty before stays, as do all texts that lose no line."""
    cleaned = dedup_lines(docs, names=LINES).where((F.col(LINES[1]) == 0) | F.col(LINES[2]).rlike(r"\S"))
    changed = F.col(LINES[1]) > 0
    chars = F.when(changed, F.length(LINES[2]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", chars).withColumn("text", F.when(changed, F.col(LINES[2])).otherwise(F.col("text"))).select(*columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more, directly or through others, the one with the smallest doc_id stays, with all rows that repeat that doc_id; null doc_ids and texts without words stay."""
    small_batches(spark)
    gone = settled(jaccard_join(docs).where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("d")).distinct())
    return without_ids(docs, gone).select(*columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, in training order: a document once for each time it is taken, and not at all if it isn't. Repeated rows are rows of their own; empty texts are never taken."""
    return training_order(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row of the mix; a null text is an empty one."""
    small_batches(spark)
    return bpe.digests(bpe.encode(docs, bpe.public_vocabulary(), GROUP_BYTES))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("jaccard_join", drop_near_copies), ("mixing", mix), ("bpe", tokenize)]
#: SQL can't express the toxicity models; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
