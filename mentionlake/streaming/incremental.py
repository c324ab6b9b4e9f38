"""Incremental ingestion with Structured Streaming: each URL is stored once, and counts go by windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from mentionlake.functions.url import canonical
from mentionlake.operators.persist import new_rows


#: Folders that URLs are dealt to by hash; a batch is compared with those that its own URLs fall into.
PARTS = 256


def store_once(candidates: DataFrame, path: str, checkpoint: str, *order: str) -> StreamingQuery:
    """Appends candidates (url, ...) whose canonical URL isn't stored at path yet. A batch that is run again writes the same folder again, so nothing is stored twice."""
    rows = candidates.withColumn("url", canonical(F.col("url"))).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(PARTS)).cast("int"))
    schema: StructType = candidates.schema

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parts = [r.part for r in batch.select("part").distinct().collect()]  # PARTS at most
        earlier = stored(spark, path, schema).where((F.col("batch") < number) & F.col("part").isin(parts)).select("url")
        new_rows(batch, earlier, "url", *order).write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What store_once has stored, with the number of the batch that stored it and the folder of the URL; empty before the first batch."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    full = StructType([*schema.fields, StructField("batch", IntegerType()), StructField("part", IntegerType())])
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each key by tumbling window; rows later than the watermark allows are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_per_url(candidates: DataFrame, time: str, keep: str = "1 day") -> DataFrame:
    """Candidates without repeated canonical URLs, as far back as the watermark keeps state."""
    rows = candidates.withColumn("url", canonical(F.col("url")))
    return rows.withWatermark(time, keep).dropDuplicatesWithinWatermark(["url"])
