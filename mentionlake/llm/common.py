"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, for Java's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def word_array(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row, however often (or in whatever lambda) it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder, which all executors share: lineage ends here, and a lost executor loses nothing. Its files go with the folder.

    Without spark.checkpoint.dir, local sessions get a temporary folder; on a cluster, whose executors share none, that is an error.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="mentionlake-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/mentionlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a bitmap that is sent to all tasks: at most 32 MB.
MOST_BITS = 1 << 28


def maybe_among(df: DataFrame, keys: DataFrame, on: str = "doc_id", most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose value of the column `on` may be among keys (d), a settled table, and those whose value surely isn't.

    A bitmap answers, of about 64 bits a key and `most_bits` at most; for so many keys that it would list nearly everything, all rows may be among them.
    A null may be among keys that hold a null.
    """
    n = keys.count()
    if n * 2 > most_bits:
        return df, df.limit(0)
    bits = min(most_bits, max(1 << 15, 1 << (64 * n).bit_length()))
    bucket, bit, bitmap, listed = (f"__maybe_{k}" for k in ("bucket", "bit", "bitmap", "listed"))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    maps = keys.select(at(F.col("d")).alias(bit)).groupBy(F.expr(f"bitmap_bucket_number({bit})").alias(bucket)).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({bit}))").alias(bitmap))
    byte = F.ascii(F.decode(F.expr(f"substring({bitmap}, cast(bitmap_bit_position({bit}) div 8 + 1 as int), 1)"), "ISO-8859-1"))
    found = F.coalesce(F.call_function("shiftright", byte, F.expr(f"cast(bitmap_bit_position({bit}) % 8 as int)")).bitwiseAND(1) == 1, F.lit(False))
    marked = df.withColumn(bit, at(F.col(on))).withColumn(bucket, F.expr(f"bitmap_bucket_number({bit})")).join(F.broadcast(maps), bucket, "left").withColumn(listed, found)
    return marked.where(listed).select(*(f"`{c}`" for c in df.columns)), marked.where(f"not {listed}").select(*(f"`{c}`" for c in df.columns))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but the rows whose doc_id is among ids (d), a settled table. Only rows that a bitmap lists are shuffled."""
    listed, others = maybe_among(docs, ids)
    gone = ids.select(F.col("d").alias("__gone_id"))
    return others.unionByName(listed.join(gone, F.col("doc_id") == F.col("__gone_id"), "left_anti"))


def corpus_chars(docs: DataFrame) -> int:
    """Characters in all texts: a cheap measure from which the numbers of partitions follow."""
    return int(docs.agg(F.sum(F.length("text"))).first()[0] or 0)


#: Values of bytes and powers for hashing words; the separators of words, space and 0x09 to 0x0D.
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SEPARATES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_powers: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1), modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(column: pa.Array, lower: bool = False, slice_bytes: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts of a string column, one after another, and the number of words of each text (none for null).

    Works on the column's bytes: a word's hash is the sum of its bytes' values times powers by place, freed of where the word stands.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    counts, found = np.zeros(len(column), np.int64), []
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + slice_bytes, side="right")) - 1)
        text, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if len(text):
            if lower:
                text = _LOWER[text]
            word = ~_SEPARATES[text]
            cut = np.zeros(len(text) + 1, bool)
            cut[at] = True  # texts touch in the buffer; a word ends with its text
            before = np.concatenate(([False], word[:-1])) & ~cut[:-1]
            after = np.concatenate((word[1:], [False])) & ~cut[1:]
            first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
            if len(_powers.get("up", ())) < len(text):
                _powers["up"], _powers["down"] = powers(_BASE, len(text)), powers(pow(_BASE, -1, 2**64), len(text))
            term = _VALUES[text]
            term *= _powers["up"][: len(text)]
            total = np.cumsum(term, dtype=np.uint64)
            h = (total[last] - total[first] + term[first]) * _powers["down"][first]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            found.append(h ^ (h >> np.uint64(32)))
            counts[lo:hi] = np.diff(np.searchsorted(first, at))
        lo = hi
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def hashed_texts(batches: Iterator[pa.RecordBatch], size: int, lower: bool = False, rows: int = 1 << 30) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(first column, hashes of all words, words by row) of runs of rows that hold about `size` words, and `rows` rows at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:  # six bytes a word
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + size * 6, side="right"))))
            yield batch.column(0).slice(lo, hi - lo), *word_hashes(batch.column(1).slice(lo, hi - lo), lower)
            lo = hi


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() cuts at space and 0x09 to 0x0D, just as the contracts do."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + length), one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    offsets = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + offsets


def stream_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows with equal first n_keys columns, from rows that are sorted by them; one group is held at a time."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:n_keys]]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(k[a].item() for k in keys)
            if own != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = own, []
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)
