"""What both vector searches share: clean vectors, and packing them into blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.llm.common import stream_groups

PACK = "block int, ids binary, vectors binary"


def clean(vectors: DataFrame, zero: bool) -> DataFrame:
    """(row, vec_id, v): the vectors without null or non-finite components, and, if zero is false, not all zero; null ids take no part.

    row tells rows apart that repeat a vec_id, all of which stay. It holds for one reading of the table: write the result down before using it twice.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad)
    if not zero:
        good = good.where(F.exists("v", lambda x: x != 0))
    return good.where(F.size("v") > 0)


def by_length(search: Callable[[DataFrame, DataFrame], DataFrame], vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """What search(vectors, queries) finds among vectors of each length; there are few lengths."""
    lengths = [r[0] for r in vectors.groupBy(F.size("v")).count().collect()] or [0]
    of = lambda df, n: df.where(F.size("v") == n)
    return reduce(DataFrame.unionByName, (search(of(vectors, n), of(queries, n)) for n in sorted(lengths)))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (block,), group in stream_groups(batches, 1):
        ids, v = np.stack([group.column("vec_id").to_numpy(), group.column("row").to_numpy()]), matrix(group.column("v"))
        order = np.lexsort(ids[::-1])
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ids[:, order].tobytes()], pa.binary()), pa.array([v[order].tobytes()], pa.binary())], names=["block", "ids", "vectors"])


def dealt_to(n: int) -> Column:
    """The block of a row among n, by its place in the table, so that no vec_id, however often repeated, fills one."""
    return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")


def blocks(vectors: DataFrame, rows: int, count: int) -> tuple[DataFrame, int]:
    """vectors (row, vec_id, v) in blocks of about `rows`, one packed row each; and how many blocks there are. count: of the vectors."""
    n = max(1, -(-count // rows))
    dealt = vectors.select(dealt_to(n).alias("block"), "row", "vec_id", "v").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(_pack, PACK), n


def unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vec_ids, rows and vectors of a pack."""
    n, rows = np.frombuffer(ids, np.int64).reshape(2, -1)
    return n, rows, np.frombuffer(vectors, np.float64).reshape(len(n), -1)


def nearest_per_query(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of found (query_row, query_id, vec_id, score): the k greatest scores of each query row, ties to the smaller vec_id."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def result(rows: list, queries: list, ids: list, scores: list, kind: pa.DataType) -> pa.RecordBatch:
    join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
    return pa.RecordBatch.from_arrays([join(rows, pa.int64()), join(queries, pa.int64()), join(ids, pa.int64()), join(scores, kind)], names=["query_row", "query_id", "vec_id", "score"])
