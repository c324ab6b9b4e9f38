"""Exact top-k search by inner product over KD-trees, one for each shard.

Vectors are dealt to shards by a hash of their place in the table. In a shard a tree halves them at the median of the widest side, down to leaves, and each node has
the tight box around its vectors. The inner product of a query with anything in a box is at most the sum, over components, of the larger product
with the box's two ends. The traversal takes the node with the greatest bound first and ends when no bound reaches the query's k-th score.

A query visits the shard that its own hash names first. Its k-th score there goes with it to all other shards, where only better boxes (or equal ones:
ties go to the smaller vec_id) are opened. Queries and shards are packed in blocks; a task holds one of each. A shard is dealt once, and its queries come after it: nothing
is joined, so no shard is copied for each pack of queries and no pack is broadcast. The queries of a pack go down the tree together.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors meet those of their own length. Rows that repeat a vec_id
are vectors of their own: each is a candidate, also for the others, and one that asks has its own nearest. Fewer candidates than asked for: all of them. Scores are exact; those that a 64-bit integer can't hold are given as its ends, where ties go
to the smaller vec_id. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import settled, stream_groups, table
from mentionlake.llm.vectors import blocks, by_length, clean, dealt_to, matrix, nearest_per_query, result, unpack

SHARD, QUERY_BLOCK, LEAF = 8192, 1024, 128
NEAREST, EVERY, SCALE = 5, 50, 256
LEAST, MOST = -(2**63), 2**63 - 1


class Tree:
    """Nodes as ranges of rows in order, with their boxes; node 0 is the root."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.ranges, self.children, low, high = [(0, len(x))], [], [], []
        k = 0
        while k < len(self.ranges):
            a, b = self.ranges[k]
            rows = x[self.order[a:b]]
            lo, hi = rows.min(0), rows.max(0)
            low.append(lo)
            high.append(hi)
            if b - a > leaf and (hi > lo).any():
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, np.argmax(hi - lo)], middle)]
                self.children.append((len(self.ranges), len(self.ranges) + 1))
                self.ranges += [(a, a + middle), (a + middle, b)]
            else:
                self.children.append(())
            k += 1
        self.low, self.high = np.stack(low), np.stack(high)
        self.rows = x[self.order]
        self.largest = np.abs(x).max(initial=0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and node: no vector of the node has a greater inner product. A little is added for rounding, by the size of what is summed up."""
        b = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        return b + np.abs(q) @ np.maximum(np.abs(self.low), np.abs(self.high)).T * 1e-12

    def scores(self, a: int, b: int, q: np.ndarray) -> np.ndarray:
        """Exact inner products with the rows a to b: as doubles where these hold all of it, else as integers, held at the ends of 64 bits."""
        if self.largest * np.abs(q).sum() < 2**53:
            return self.rows[a:b] @ q
        exact = (sum(int(x) * int(y) for x, y in zip(row, q.tolist(), strict=True)) for row in self.rows[a:b].tolist())
        return np.array([min(max(s, LEAST), MOST) for s in exact], object)

    def best(self, q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int, k: int, reach: float | int) -> list[tuple[float, int]]:
        """The k best (score, -id) but of the row own, opening no box whose bound is below reach or the k-th score so far."""
        top: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= reach:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for c in self.children[node]:
                    if bounds[c] >= reach:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            a, b = self.ranges[node]
            scores = self.scores(a, b, q)
            for j in np.flatnonzero(scores >= reach):
                at = self.order[a + j]
                if rows[at] != own:
                    heapq.heappush(top, (int(scores[j]), -int(ids[at])))
                    if len(top) > k:
                        heapq.heappop(top)
            if len(top) == k:
                reach = max(reach, top[0][0])
        return top

    def best_of_all(self, q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, reach: list[float | int]) -> list[list[tuple[float, int]]]:
        """What best finds for each query. Those whose scores doubles hold go down the tree together, a product of matrices a leaf; a node is opened for the queries whose bound is not below their reach."""
        fits = self.largest * np.abs(q).sum(1) < 2**53
        tops = [[] if fit else self.best(q[j], bounds[j], ids, rows, own[j], k, reach[j]) for j, fit in enumerate(fits.tolist())]
        limit = np.array(reach, np.float64)  # as a double it may be rounded beyond 2**53, where no score of these queries lies
        heap = [(0.0, 0, np.flatnonzero(fits))]
        while heap:
            _, node, asked = heapq.heappop(heap)
            asked = asked[bounds[asked, node] >= limit[asked]]
            if not len(asked):
                continue
            if self.children[node]:
                for c in self.children[node]:
                    heapq.heappush(heap, (-bounds[asked, c].mean(), c, asked))
                continue
            a, b = self.ranges[node]
            scores = q[asked] @ self.rows[a:b].T
            at, found = np.nonzero(scores >= limit[asked][:, None])
            places = self.order[a + found]
            other = rows[places] != own[asked[at]]
            for j, score, i in zip(asked[at][other].tolist(), scores[at, found][other].tolist(), ids[places][other].tolist(), strict=True):
                top = tops[j]
                if len(top) < k:
                    heapq.heappush(top, (int(score), -i))
                elif (int(score), -i) > top[0]:
                    heapq.heapreplace(top, (int(score), -i))
                if len(top) == k:
                    limit[j] = max(limit[j], top[0][0])
        return tops


def _search(k: int) -> Callable:
    """Rows (block, ids, vectors, reach) sorted by block, in each the shard (its reach is null) before packs of queries with their k-th scores so far: the best of the shard for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, ids, rows = None, None, None, None
        for batch in batches:
            for block, packed_ids, vectors, reach in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reach is None:
                    (ids, rows, x), shard = unpack(packed_ids, vectors), block
                    tree = Tree(x)
                    continue
                if block != shard:  # no vector has this block
                    continue
                qi, qr, q = unpack(packed_ids, vectors)
                reached = [-np.inf if r == LEAST else r for r in np.frombuffer(reach, np.int64).tolist()]
                out: tuple[list, list, list, list] = ([], [], [], [])
                for j, (own, top) in enumerate(zip(qr.tolist(), tree.best_of_all(q, tree.bounds(q), ids, rows, qr, k, reached), strict=True)):
                    out[0].append(np.full(len(top), own, np.int64))
                    out[1].append(np.full(len(top), qi[j], np.int64))
                    out[2].append(np.array([-i for _, i in top], np.int64))
                    out[3].append(np.array([s for s, _ in top], np.int64))
                yield result(*out, pa.int64())

    return run


def _with_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repacks a shard's queries with their k-th scores; rows (block, row, vec_id, v, reach) sorted by block."""
    for (block,), g in stream_groups(batches, 1):
        pack = [np.stack([g.column("vec_id").to_numpy(), g.column("row").to_numpy()]).tobytes(), np.ascontiguousarray(matrix(g.column("v"))).tobytes(), g.column("reach").to_numpy(zero_copy_only=False).astype(np.int64).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([p], pa.binary()) for p in pack)], names=["home", "ids", "vectors", "reach"])


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors and queries (row, vec_id, v) with whole components, the queries rows of the vectors: the k greatest inner products, none with the query's own row."""
    shards, n = blocks(vectors, SHARD, vectors.count())
    shards = settled(shards)
    home = dealt_to(n)
    found = "query_row long, query_id long, vec_id long, score long"
    packed = "home int, ids binary, vectors binary, reach binary"
    packs = lambda asked: asked.repartition("block").sortWithinPartitions("block").mapInArrow(_with_reach, packed)
    # shard and queries meet by union: the size of exploded queries isn't known before, and a join would send them all through the driver
    met = lambda asked: shards.withColumn("reach", F.lit(None).cast("binary")).unionByName(asked).repartition("block").sortWithinPartitions("block", F.col("reach").isNotNull()).mapInArrow(_search(k), found)
    near = settled(met(packs(queries.select(home.alias("block"), "row", "vec_id", "v", F.lit(LEAST).alias("reach"))).withColumnRenamed("home", "block")))
    reach = near.groupBy("query_row").agg(F.count("score").alias("n"), F.min("score").alias("least"))
    known = queries.join(reach, queries["row"] == reach["query_row"], "left")
    known = known.select(home.alias("block"), "row", "vec_id", "v", F.when(F.col("n") == k, F.col("least")).otherwise(LEAST).alias("reach"))
    others = packs(known).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), "*").where("block <> home").drop("home")
    rest = met(others)
    return nearest_per_query(near.union(rest), k)


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    return vectors.select("row", "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def op6_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = settled(whole(clean(table(spark, sf_dir, "embeddings"), zero=True)))
    return by_length(search, vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = r"""
WITH good AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [floor(x::DOUBLE * 256)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.row <> c.row AND len(q.v) = len(c.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
