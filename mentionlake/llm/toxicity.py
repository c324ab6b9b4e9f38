"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models, one of toxic and one of ordinary texts, give each character of a word its probability after the four before it. Their highest
order has counts of its own class, discounted; what the discount frees goes to lower orders, whose (continuation) counts both classes share.
An expression too rare to be counted in one class is so judged by the shared counts, and cancels out where neither has seen it.

The difference of the log-likelihoods is normalised by length, over the whole text, over the worst stretch of ten words and by the word, so that a few
insults show in a text of any length. A logistic curve over these, fitted on labelled texts that the models haven't seen, gives the score.

One bound, a parameter: the models and the curve are fitted on ``sample`` labelled texts of each class at most (those with the smallest hash of doc_id;
where that changes their odds, the curve is moved back to the odds among all labels). So what is sent to the tasks doesn't grow with the corpus. All
character sequences of those texts are kept, and every word of every text is scored. Words are cut at Unicode's white space and lower-cased.

Defined results: a null text is empty; an empty text has no words and gets the score of the curve there. Labels other than 0 and 1, or null, are
not learned from; of several labels for one document the highest counts. Without labels of both classes the score is the share of toxic ones
among the labels learned from (0 without any). Repeated rows each get a row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from mentionlake.llm.common import table

ORDER = 5
DISCOUNT = 0.75
SAMPLE = 3000
STRETCH = 10
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
CHUNK_BYTES = 1_500_000
START, STOP = "\x02", "\x03"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each with four starts before and a stop after it; and the places of characters to be predicted."""
    text = "".join([START * (ORDER - 1) + w + STOP for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return points, np.flatnonzero(points != ord(START))


def _mix(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at each place."""
    h = np.full(len(at), n, np.uint64)
    for k in range(n - 1, -1, -1):
        h = (h ^ points[at - k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def words_of(text: str) -> list[str]:
    return text.lower().replace(START, "").replace(STOP, "").split()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts in toxic and ordinary texts."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for w in words_of(text):
                counts.setdefault(w, [0, 0])[1 - toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], names=["word", "toxic", "ordinary"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character sequences, from distinct words with their counts in toxic and ordinary texts."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        points, at = _points(words)
        owner = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
        rows = np.stack([points[at - k].astype(np.int32) for k in range(ORDER - 1, -1, -1)])
        cells, where = np.unique(rows, axis=1, return_inverse=True)
        counts = [np.bincount(where.ravel(), weights=batch.column(c).to_numpy()[owner], minlength=cells.shape[1]).astype(np.int64) for c in ("toxic", "ordinary")]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cells), *map(pa.array, counts)], names=[*(f"c{k}" for k in range(ORDER)), "toxic", "ordinary"])


def _split(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, where = np.unique(h, return_inverse=True)
    return values, where.ravel()


def _shared(cells: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of the last character of each distinct sequence after the characters before it but the first, by continuation counts."""
    p = np.full(cells.shape[1], 1.0 / 4096)  # below the lowest order: any character
    for n in range(1, ORDER):
        longer, tail, head = (_hash_rows(cells[-m:]) if m else np.zeros(cells.shape[1], np.uint64) for m in (n + 1, n, 0))
        head = _hash_rows(cells[-n:-1]) if n > 1 else head
        first = np.unique(longer, return_index=True)[1]  # each distinct longer sequence once
        tails, at_tail = _split(tail)
        heads, at_head = _split(head)
        count = np.bincount(at_tail[first], minlength=len(tails)).astype(float)
        total = np.bincount(at_head[first], minlength=len(heads)).astype(float)
        kinds = np.bincount(at_head[np.unique(tail, return_index=True)[1]], minlength=len(heads)).astype(float)
        p = np.maximum(count[at_tail] - DISCOUNT, 0) / total[at_head] + DISCOUNT * kinds[at_head] / total[at_head] * p
    return p


def _hash_rows(cells: np.ndarray) -> np.ndarray:
    flat = cells.astype(np.uint64).T.ravel()
    return _mix(flat, np.arange(cells.shape[0] - 1, len(flat), cells.shape[0]), cells.shape[0])


class Models:
    """log p(toxic) - log p(ordinary) of a character: by the whole sequence if it was counted, else by what its context leaves to lower orders, else none."""

    def __init__(self, cells: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        shared = _shared(cells)
        context, gram = _hash_rows(cells[:-1]), _hash_rows(cells)
        heads, at = _split(context)
        logs, freed = [], []
        for counts in (toxic.astype(float), ordinary.astype(float)):
            total = np.bincount(at, weights=counts, minlength=len(heads))
            kinds = np.bincount(at, weights=counts > 0, minlength=len(heads))
            left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            p = np.where(total[at] > 0, np.maximum(counts - DISCOUNT, 0) / np.maximum(total[at], 1), 0.0) + left[at] * shared
            logs.append(np.log(p))
            freed.append(np.log(left))
        order = np.argsort(gram)
        self.grams, self.values = gram[order], (logs[0] - logs[1])[order].astype(np.float32)
        self.heads, self.left = heads, (freed[0] - freed[1]).astype(np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """The difference of the log-likelihoods of each word."""
        if not words or not len(self.grams):
            return np.zeros(len(words), np.float32)
        points, at = _points(words)
        owner = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
        gram = _mix(points, at, ORDER)
        k = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        found = self.grams[k] == gram
        value = np.where(found, self.values[k], np.float32(0))
        rest = np.flatnonzero(~found)
        head = _mix(points, at[rest] - 1, ORDER - 1)
        k = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
        value[rest] = np.where(self.heads[k] == head, self.left[k], np.float32(0))
        return np.bincount(owner, weights=value, minlength=len(words)).astype(np.float32)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _measures(models: Models, texts: list[str]) -> np.ndarray:
    """A row for each text: its difference of log-likelihoods by the word, in the worst stretch and in the worst words; and the logarithm of its length."""
    numbers = _Numbers()
    flat, lengths = [], []
    for t in texts:
        words = words_of(t)
        lengths.append(len(words))
        flat += [numbers[w] for w in words]
    lengths = np.array(lengths, np.int64)
    out = np.zeros((len(texts), 4))
    full = np.flatnonzero(lengths)
    if len(full):
        s = models.words(list(numbers))[np.array(flat, np.int64)].astype(np.float64)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        out[full, 0] = np.add.reduceat(s, begin[full]) / lengths[full]
        sums = np.concatenate(([0.0], np.cumsum(np.maximum(s, 0))))
        doc = np.repeat(np.arange(len(texts)), lengths)
        here = np.arange(len(s))
        stretch = (sums[np.minimum(here + STRETCH, (begin + lengths)[doc])] - sums[here]) / STRETCH
        out[full, 1] = np.maximum.reduceat(stretch, begin[full])
        out[full, 2] = np.maximum.reduceat(s, begin[full])
        out[full, 3] = np.log(lengths[full])
    return out


def _measured(model, finish: Callable | None, into: str = "") -> Callable:
    """Appends the measures of the column text, or what finish makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(text):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
                x = _measures(model.value, [t or "" for t in text.slice(at, end - at).to_pylist()])
                more = [pa.array(finish(x))] if finish else [pa.array(np.ascontiguousarray(c)) for c in x.T]
                names = [into] if finish else [f"m{k}" for k in range(len(more))]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in batch.columns), *more], names=[*batch.schema.names, *names])
                at = end

    return run


class Curve:
    """A logistic curve over the measures; `shift` is added to the logarithm of the odds that it gives."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 50, shift: float = 0.0):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hess = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)) * 0.1
            w = w + np.linalg.solve(hess, z.T @ (y - p) - 0.1 * w)
        self.weights = w
        self.weights[0] += shift

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def prior_shift(toxic: int, ordinary: int, sample: int) -> float:
    """Logarithm of the odds of 'toxic' among all labels by those in a sample of so many labels of each class at most: none where the bound cuts neither class."""
    return float(np.log(toxic / ordinary) - np.log(min(toxic, sample) / min(ordinary, sample)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Models, Callable]:
    """The models and the curve, from docs (doc_id, text) and labels (doc_id, toxic); the caller has left out what may not be learned from."""
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    sizes = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    # `sample` rows of each class at most, hence small enough to send to all tasks.
    picked = marked.where("toxic = 0").orderBy(order, "doc_id").limit(sample).union(marked.where("toxic = 1").orderBy(order, "doc_id").limit(sample))
    picked = picked.select(F.col("doc_id").alias("d"), "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0).alias("late"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("d"))
    texts = texts.select("text", "toxic", "late").persist()
    words = texts.where(~F.col("late")).select("toxic", "text").mapInArrow(_words, "word string, toxic long, ordinary long")
    counted = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    kinds = [f"c{k}" for k in range(ORDER)]
    sequences = counted.mapInArrow(_grams, ", ".join(f"{k} int" for k in kinds) + ", toxic long, ordinary long")
    top = sequences.groupBy(*kinds).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow()  # of the sample alone
    models = Models(np.stack([top.column(k).to_numpy() for k in kinds]), *(top.column(k).to_numpy() for k in ("toxic", "ordinary")))
    sent = spark.sparkContext.broadcast(models)
    rows = texts.where("late").select("toxic", "text").mapInArrow(_measured(sent, None), "toxic int, text string, m0 double, m1 double, m2 double, m3 double").drop("text").toArrow()
    texts.unpersist()
    y = rows.column("toxic").to_numpy().astype(float) if rows.num_rows else np.zeros(0)
    if 0 < y.sum() < len(y):
        return models, Curve(np.column_stack([rows.column(f"m{k}").to_numpy() for k in range(4)]), y, shift=prior_shift(sizes[1], sizes[0], sample))
    share = marked.agg(F.avg("toxic")).first()[0]
    return models, Constant(float(share or 0.0))


def score(docs: DataFrame, models: Models, curve: Callable, into: str = "likely_toxic") -> DataFrame:
    """docs with one more column, from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(models)
    return docs.mapInArrow(_measured(sent, curve, into), StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", "toxic").where(fold(F.col("doc_id")) != HELD_OUT)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), *train(docs, learnable(table(spark, sf_dir, "labels"))))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("likely_toxic").alias("score"), (F.col("likely_toxic") >= THRESHOLD).cast("int").alias("predicted"))
