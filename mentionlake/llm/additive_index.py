"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of one entry of each of ``BOOKS`` codebooks, all of full dimension. Codebooks start as k-means of residuals and
are then refitted together, by least squares, to the codes of the sample. Codes are found by beam search: book by book, the ``BEAM`` sums
that leave the least are kept. An index row holds a vector's codes and its norm over that of its approximation.

A query's inner products with all codebook entries make a lookup table; the sum of a code's entries, times the stored ratio of norms, estimates
the score. The ``SHORTLIST`` best of each block of the index are scored exactly, on the original vectors in double precision.

The codebooks are fitted on ``SAMPLE`` vectors at most (those with the smallest hash of vec_id and vector), so what is sent to the tasks is bounded. Every
vector is indexed and every query meets every block. Queries and index are packed in blocks; a task holds one block of each.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, neither as queries nor as candidates; vectors meet those
of their own length. Rows that repeat a vec_id are vectors of their own: each is a candidate, also for the others, and one that asks has its own nearest. Fewer candidates than asked for: all of them. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import settled, table
from mentionlake.llm.vectors import blocks, by_length, clean, matrix, nearest_per_query, result, unpack

BOOKS, ENTRIES, BEAM = 12, 256, 4
SAMPLE = 8192
SHORTLIST = 256
INDEX_BLOCK, QUERY_BLOCK = 8192, 1024
NEAREST, EVERY = 20, 20


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM, step: int = 2048) -> np.ndarray:
    """Codes by beam search: a row for each vector, a column for each codebook."""
    out = np.zeros((len(x), len(books)), np.uint8)
    norms = (books**2).sum(2)
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        rest, codes = part[:, None, :], np.zeros((len(part), 1, 0), np.uint8)
        for book, norm in zip(books, norms, strict=True):
            left = (rest**2).sum(2)[:, :, None] - 2 * (rest @ book.T) + norm  # what each choice would leave, squared
            flat = left.reshape(len(part), -1)
            keep = min(beam, flat.shape[1])
            top = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            from_beam, entry = top // len(book), top % len(book)
            rest = np.take_along_axis(rest, from_beam[:, :, None], axis=1) - book[entry]
            codes = np.concatenate([np.take_along_axis(codes, from_beam[:, :, None], axis=1), entry[:, :, None].astype(np.uint8)], axis=2)
        least = (rest**2).sum(2).argmin(1)
        out[lo : lo + step] = codes[np.arange(len(part)), least]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def fit(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, refits: int = 2, seed: int = 0) -> np.ndarray:
    """Codebooks (book, entry, dimension) for the vectors x."""
    rng = np.random.default_rng(seed)
    rest, found = x.copy(), []
    for _ in range(books):
        book = _k_means(rest, entries, rng)
        found.append(book)
        rest = rest - book[np.argmax(rest @ book.T - 0.5 * (book**2).sum(1), axis=1)]
    c = np.stack(found)
    for _ in range(refits):
        at = encode(x, c).astype(np.int64) + np.arange(books) * entries
        gram = np.zeros((books * entries, books * entries))
        sums = np.zeros((books * entries, x.shape[1]))
        for m in range(books):
            np.add.at(sums, at[:, m], x)
            for k in range(books):
                np.add.at(gram, (at[:, m], at[:, k]), 1.0)
        gram[np.diag_indices_from(gram)] += 1e-3
        c = (np.linalg.solve(gram, sums + 1e-3 * c.reshape(-1, x.shape[1]))).reshape(c.shape)
    return c


def _index(books) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, _, x = unpack(ids, vectors)
                codes = encode(x, books.value)
                ratio = np.linalg.norm(x, axis=1) / np.maximum(np.linalg.norm(decode(codes, books.value), axis=1), 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ids]), pa.array([vectors]), pa.array([codes.tobytes()]), pa.array([ratio.astype(np.float32).tobytes()])], names=["block", "ids", "vectors", "codes", "ratios"])

    return run


def _search(books, k: int, shortlist: int, step: int = 256) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_vectors, ids, vectors, codes, ratios in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (qi, qr, q), (xi, xr, x) = unpack(q_ids, q_vectors), unpack(ids, vectors)
                c = np.frombuffer(codes, np.uint8).reshape(len(xi), -1)
                ratio = np.frombuffer(ratios, np.float32)
                few = min(shortlist, len(xi))
                out: tuple[list, list, list, list] = ([], [], [], [])
                for lo in range(0, len(qi), step):
                    part, own = q[lo : lo + step], qr[lo : lo + step]
                    estimate = np.zeros((len(part), len(xi)), np.float32)
                    for m, book in enumerate(books.value):
                        estimate += (part @ book.T).astype(np.float32)[:, c[:, m]]
                    estimate *= ratio
                    top = np.argpartition(-estimate, few - 1, axis=1)[:, :few]
                    score = np.einsum("qd,qrd->qr", part, x[top])
                    score[xr[top] == own[:, None]] = -np.inf
                    order = np.lexsort((xi[top], -score), axis=1)[:, :k]
                    found = np.take_along_axis(score, order, axis=1)
                    there = found > -np.inf
                    out[0].append(np.repeat(own, there.sum(1)))
                    out[1].append(np.repeat(qi[lo : lo + step], there.sum(1)))
                    out[2].append(np.take_along_axis(xi[top], order, axis=1)[there])
                    out[3].append(found[there])
                yield result(*out, pa.float64())

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, shortlist: int = SHORTLIST, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) for clean vectors and queries (row, vec_id, v), which are rows of them: the k greatest inner products found, none the query's own row."""
    spark = vectors.sparkSession
    learn = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(sample).toArrow()  # bounded by the parameter
    x = matrix(learn.column("v")) if learn.num_rows else np.zeros((1, 1))
    books = spark.sparkContext.broadcast(fit(x))
    index, n = blocks(vectors, INDEX_BLOCK, vectors.count())
    index = settled(index.mapInArrow(_index(books), "block int, ids binary, vectors binary, codes binary, ratios binary"))
    asked, _ = blocks(queries, QUERY_BLOCK, queries.count())
    asked = asked.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    met = asked.join(index, "block").select("q_ids", "q_vectors", "ids", "vectors", "codes", "ratios")
    return nearest_per_query(met.mapInArrow(_search(books, k, shortlist), "query_row long, query_id long, vec_id long, score double"), k)


def op4_additive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = settled(clean(table(spark, sf_dir, "embeddings"), zero=False))
    return by_length(search, vectors, vectors.where(F.col("vec_id") % EVERY == 0))
