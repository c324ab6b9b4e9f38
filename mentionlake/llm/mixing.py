"""Mixing sources to target weights along a time-varying curriculum.

DataFrame functions only. Every source has a weight and a schedule by which that weight changes over training time t in [0, 1]:
w(t) = weight * (1 + ramp * (2t - 1)). Its integral over [0, 1] is the weight, so schedules move words in time and never change shares.

* Targets: the words of all documents are shared by weight; a source's target stops at ``max_epochs`` times its size and what lies above is
  shared among the others by weight, until none is above.
* Documents of a source form a stream in an order fixed by a hash of doc_id and text. The stream is read over and over until the target is met, so
  each document is taken ``target div size`` times, and those at the front once more; on the one document where the demand ends, only
  the words up to there count.
* The place of a document in training: the cumulative demand up to t is D(t) = target * (t + ramp * (t^2 - t)); the middle of the
  document's words in its stream, inverted through D, is its position, and the result is range-sorted by it.

No window sees a whole source: running sums go over 4096 hash buckets a source first (their sums only), then inside a bucket. Only the targets, one row
a source, are computed in one task.

``training_order`` moves the documents themselves. There the exact running sum is needed in one bucket a source only, that where its demand ends; elsewhere
a document's place in its bucket follows from its hash. So all that a document needs is a row a bucket, and texts are shuffled once, by position.

Defined results: a null text has size 0; documents of size 0 are never taken (taken 0, position null). A null source is a source of its own, after the others.
Rows with the same doc_id, source and text lie side by side in the stream; each is a row of its own. No rows in, none out. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionlake.llm.common import settled, table, word_array

WEIGHTS = (5, 2, 1)
#: By place in the cycle of weights: the heavy sources come early, the light ones late.
RAMPS = (-0.5, 0.0, 0.5)
MAX_EPOCHS = 3
SEED = "mix-1"
PART_WORDS = 1_500_000
#: Rows of a plan that are sent to all tasks, at most (about a hundred bytes each).
MOST_BUCKETS = 200_000
SIZE, TURN, BUCKET, PLAN, COPY, AT = (f"__mix_{k}" for k in ("size", "turn", "bucket", "plan", "copy", "at"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, ramp) from (source, source_size): one row a source, in and out."""
    whole, before = Window.partitionBy(), Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("place") % len(values) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", place)
        .withColumn("weight", pick(weights))
        .withColumn("ramp", pick(ramps).cast("double"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    # Sources reach their caps in the order of cap / weight. A source is below its cap if the words that are left, shared by the weights that are left, allow it.
    left = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
    unit = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levelled = ranked.withColumn("unit", unit).withColumn("level", F.max(F.when(F.col("unit") <= F.col("ratio"), F.col("unit"))).over(whole))
    target = F.when(F.col("unit") > F.col("ratio"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return levelled.select("source", "source_size", target.alias("target"), "ramp")


def training_time(share, ramp):
    """Solves share = t + ramp * (t^2 - t) for t."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - ramp) * (1 - ramp) + 4 * ramp * share))
    return F.when(ramp == 0, share).otherwise((root - (1 - ramp)) / (2 * F.when(ramp != 0, ramp)))


def turn_of(doc_id: Column, text: Column, seed: str) -> Column:
    """The place of a document in the stream of its source: 16 hexadecimal digits."""
    whole = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.substring(F.md5(whole), 1, 16)


def bucket_plan(buckets: DataFrame, weights: tuple[int, ...], ramps: tuple[float, ...], max_epochs: int) -> DataFrame:
    """(s, b, bucket_size, bucket_start, source_size, target, ramp, demand, epochs, rest) from (source, bucket, bucket_size): where each bucket begins in the stream of its source, and how much of that is taken."""
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, ramps, max_epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_size", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    demand = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("demand") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.join(offsets, F.col("source").eqNullSafe(F.col("s"))).drop("source").withColumn("demand", demand).withColumn("epochs", epochs)
    return plan.withColumn("rest", F.col("demand") - F.col("epochs") * F.col("source_size"))


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """docs with the words, the place in the stream and the bucket of each row."""
    text = F.col("text").cast("string")
    return docs.withColumn(SIZE, F.size(word_array(text)).cast("long")).withColumn(TURN, turn_of(F.col("doc_id"), text, seed)).withColumn(BUCKET, F.substring(TURN, 1, 3))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, ramp, stream_start, taken, epochs) for every row of docs: its words, those of the source and their target, where it starts in the stream, what is taken."""
    rows = settled(sized(docs.select("doc_id", "source", "text"), seed).select("doc_id", "source", F.col(SIZE).alias("size"), F.col(TURN).alias("turn"), F.col(BUCKET).alias("bucket")))
    plan = bucket_plan(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), weights, ramps, max_epochs)
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    within = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    partly = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("stream_start")))
    taken = (F.col("epochs") * F.col("size") + partly).cast("long")
    return placed.withColumn("stream_start", start).select("doc_id", "source", "size", "source_size", "target", "ramp", "stream_start", taken.alias("taken"), "epochs")


def training_order(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs in training order: each row once for each time it is taken, and not at all if it isn't. The document on which a source's demand ends is taken whole if half of it is wanted (rows that repeat it: together)."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = sized(docs, seed)
    buckets = rows.groupBy("source", F.col(BUCKET).alias("bucket")).agg(F.sum(SIZE).alias("bucket_size"))
    plan = settled(bucket_plan(buckets, weights, ramps, max_epochs))
    # In the bucket where a source's demand ends, the last document that is taken once more.
    last = plan.where("bucket_start <= rest and rest < bucket_start + bucket_size").select("s", "b", "bucket_start", "rest")
    near = rows.select("source", TURN, SIZE, BUCKET).join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col(BUCKET) == F.col("b")))
    near = near.groupBy("s", "b", "bucket_start", "rest", TURN).agg(F.sum(SIZE).alias("size"))
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(Window.partitionBy("s").orderBy(TURN).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = near.withColumn("left", F.col("rest") - start).where((F.col("left") > 0) & (F.col("left") * 2 >= F.col("size")))
    cuts = last.select(F.col("s").alias("own"), F.col("b").alias("cut_bucket")).join(wanted.groupBy("s").agg(F.max(TURN).alias("cut_turn")), F.col("own").eqNullSafe(F.col("s")), "left")
    cuts = cuts.select("own", F.coalesce("cut_turn", "cut_bucket").alias("cut"))  # a bucket's name comes before all places in it
    plan = settled(plan.join(cuts, F.col("s").eqNullSafe(F.col("own")), "left").select(F.struct("s", "b", "bucket_start", "bucket_size", "source_size", "target", "ramp", "epochs", "cut").alias(PLAN)))
    few = F.broadcast(plan) if plan.count() <= MOST_BUCKETS else plan
    placed = rows.where(F.col(SIZE) > 0).join(few, F.col("source").eqNullSafe(F.col(f"{PLAN}.s")) & (F.col(BUCKET) == F.col(f"{PLAN}.b")))
    p = lambda name: F.col(f"{PLAN}.{name}")
    copies = (p("epochs") + F.coalesce((F.col(TURN) <= p("cut")).cast("int"), F.lit(0))).cast("int")
    share = F.conv(F.substring(TURN, 4, 12), 16, 10).cast("double") / float(16**12)
    middle = p("bucket_start") + share * p("bucket_size") + F.col(COPY) * p("source_size")
    at = training_time(F.least(F.lit(1.0), middle / p("target")), p("ramp"))
    words = plan.agg(F.sum(F.col(f"{PLAN}.bucket_size"))).first()[0] or 0
    parts = int(words // PART_WORDS) + 1
    taken = placed.where(copies > 0).withColumn(COPY, F.explode(F.sequence(F.lit(0), copies - 1))).select(*columns, at.alias(AT), F.col(TURN), F.col(COPY))
    # Demand is even over time, so slices of time hold about as many words: no sample is needed to find ranges.
    dealt = taken.repartitionById(parts, F.least(F.lit(parts - 1), F.floor(F.col(AT) * parts)).cast("int"))
    return dealt.sortWithinPartitions(AT, TURN, COPY).select(*columns)


def position(copy=0):
    """Training time of the given copy (from 0) of a row of mix_sources."""
    middle = F.col("stream_start") + copy * F.col("source_size") + F.col("size") / 2
    return training_time(F.least(F.lit(1.0), middle / F.col("target")), F.col("ramp"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    timed = mixed.withColumn("position", F.when(F.col("taken") > 0, F.round(position(), 9)))
    return timed.select("doc_id", "size", "source_size", "target", "taken", "position").sort(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  substr(md5('mix-1' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 16) AS turn FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sources),
weighed AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight, [-0.5, 0.0, 0.5][place % 3 + 1]::DOUBLE AS ramp, source_size * 3 AS cap FROM placed),
ratios AS (SELECT *, cap::DOUBLE / weight AS ratio FROM weighed),
units AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS unit
  FROM ratios WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, CASE WHEN unit > ratio THEN cap::DOUBLE ELSE weight * (max(CASE WHEN unit <= ratio THEN unit END) OVER ()) END AS target FROM units),
streams AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.ramp, floor(t.target + 0.5)::BIGINT AS demand,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS epochs FROM streams),
taken AS (SELECT *, (epochs * size + greatest(0, least(size, demand - epochs * source_size - start)))::BIGINT AS taken,
  least(1.0::DOUBLE, (start + size / 2) / target) AS share FROM counted)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(CASE WHEN ramp = 0 THEN share ELSE (sqrt(greatest(0.0::DOUBLE, (1 - ramp) * (1 - ramp) + 4 * ramp * share)) - (1 - ramp)) / (2 * ramp) END, 9) END AS position
FROM taken
"""
