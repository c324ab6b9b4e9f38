"""Substring dedup: windows of words that start earlier elsewhere, found behind a count-min prefilter.

1. Every partition sketches its windows: rows of counters that stop at two, so two bits a counter. Sketches travel as sorted positions, are
   merged segment by segment, and only the bits "twice or more" are sent out again. A counter never counts too low, so a window that
   repeats is always among those estimated repeated.
2. A second pass keeps the windows estimated repeated. Inside a chunk of documents all but the first of equal windows are repeats at once; that
   first one goes, by 80 bits of hash, to the others of its kind. A passage that every document holds so costs one row a chunk, not one a
   document.
3. The repeats of a document come back to it and every word that one of them covers goes.

The number of counters follows the corpus (one to two times its windows a row) up to ``max_bits``; that bounds what is broadcast by
``depth * 2^max_bits / 8`` bytes. Beyond it the prefilter lets more through; the result stays exact.

Defined results: a null text has no words. Texts of fewer words than a window lose nothing. Null doc_ids come last. A doc_id is one document: rows
that repeat it are at the same place and don't remove one another's words. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import corpus_chars, hashed_texts, maybe_among, powers, runs, settled, table, words_of

WINDOW = 20
DEPTH = 2
MAX_BITS = 29
SEGMENT_BITS = 22
CHUNK_WORDS = 1_000_000
SKETCHED = 6_000_000  # windows that a task sketches together
LAST = np.iinfo(np.int64).max  # stands for a null doc_id
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def window_hashes(words: np.ndarray, window: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of `window` word hashes, as sums of powers: the hash depends on the words only, not on where they stand."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    out = []
    for k, base in enumerate(BASES):
        if len(cache.get(k, ((),))[0]) < len(words):
            cache[k] = powers(base, len(words) + 1), powers(pow(base, -1, 2**64), len(words) + 1)
        up, down = cache[k]
        mixed = words if k == 0 else (words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * up[: len(words)], dtype=np.uint64)))
        h = (total[window:] - total[:-window]) * down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(32)))
    return out[0], out[1]


class Chunk:
    """The words of some documents in one array, and where each document begins."""

    def __init__(self, ids: pa.Array, words: np.ndarray, lengths: np.ndarray, window: int, cache: dict):
        self.ids = ids.cast(pa.int64()).fill_null(int(LAST)).to_numpy(zero_copy_only=False)
        self.lengths = lengths
        self.begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        a, b = window_hashes(words, window, cache)
        counts = np.maximum(self.lengths - window + 1, 0)
        starts = runs(self.begin, counts)  # windows that don't cross into the next document
        self.a, self.b = a[starts], b[starts]
        self.doc = np.repeat(np.arange(len(ids)), counts)
        self.pos = starts - self.begin[self.doc]


def _chunks(batches: Iterator[pa.RecordBatch], window: int, size: int) -> Iterator[Chunk]:
    cache: dict = {}
    for ids, words, lengths in hashed_texts(batches, size):
        yield Chunk(ids, words, lengths, window, cache)


def _deltas(values: np.ndarray) -> bytes:
    """Sorted numbers below 2^32, packed: low and high halves of their differences apart, compressed."""
    d = np.diff(values.astype(np.int64), prepend=0).astype(np.uint32)
    plain = (d & np.uint32(0xFF)).astype(np.uint8).tobytes() + (d >> np.uint32(8)).astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()
    return len(d).to_bytes(4, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _undeltas(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    parts = np.frombuffer(pa.decompress(blob[4:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).astype(np.uint32)
    return np.cumsum(parts[0] | parts[1] << np.uint32(8) | parts[2] << np.uint32(16) | parts[3] << np.uint32(24), dtype=np.int64)


def _sketch(window: int, bits: int, depth: int, size: int) -> Callable:
    """Of some chunks together, for each row and segment: the counters at one, then those at two, as sorted positions."""
    seg = min(bits, SEGMENT_BITS)

    def packed(row: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = np.sort(np.concatenate(held))
        if not len(at):
            return
        new = np.concatenate(([True], at[1:] != at[:-1]))
        one = at[new]
        counts = np.diff(np.append(np.flatnonzero(new), len(at)))
        for level, found in enumerate((one[counts == 1], one[counts > 1])):
            cuts = np.searchsorted(found, np.arange(0, (1 << (bits - seg)) + 1, dtype=np.int64) << seg)
            full = [k for k in range(len(cuts) - 1) if cuts[k] < cuts[k + 1]]
            if full:
                blobs = [_deltas(found[cuts[k] : cuts[k + 1]] - np.uint32(k << seg)) for k in full]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([level] * len(full), pa.int32()), pa.array(blobs, pa.binary())], names=["row", "segment", "level", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(depth)]
        n = 0
        for chunk in _chunks(batches, window, size):
            for row, h in list(enumerate((chunk.a, chunk.b)))[:depth]:
                held[row].append((h >> np.uint64(64 - bits)).astype(np.uint32))
            n += len(chunk.a)
            if n >= SKETCHED:
                for row in range(depth):
                    yield from packed(row, held[row])
                held, n = [[] for _ in range(depth)], 0
        if n:
            for row in range(depth):
                yield from packed(row, held[row])

    return run


def _merge(bits: int) -> Callable:
    """Sketches sorted by row and segment: the counters that reach two over all of them."""
    cells = 1 << min(bits, SEGMENT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one, two = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(two, bitorder="little").tobytes()], pa.binary())], names=["row", "segment", "bits"])

        for batch in batches:
            for row, segment, level, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (row, segment):
                    if key is not None:
                        yield done()
                    key, one, two = (row, segment), np.zeros(cells, bool), np.zeros(cells, bool)
                where = _undeltas(at)
                two[where] |= one[where] if level == 0 else True
                one[where] = True
        if key is not None:
            yield done()

    return run


def repeated_counters(docs: DataFrame, window: int, bits: int, depth: int = DEPTH, chunk_words: int = CHUNK_WORDS) -> np.ndarray:
    """The merged sketch: depth rows of 2^bits bits, set where a counter is two or more."""
    parts = docs.mapInArrow(_sketch(window, bits, depth, chunk_words), "row int, segment int, level int, at binary")
    merged = parts.repartition("row", "segment").sortWithinPartitions("row", "segment").mapInArrow(_merge(bits), "row int, segment int, bits binary")
    sketch = np.zeros((depth, max(1, (1 << bits) // 8)), np.uint8)
    width = max(1, (1 << min(bits, SEGMENT_BITS)) // 8)
    for r in merged.toLocalIterator():
        sketch[r["row"], r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return sketch


def _starts(ids: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """(doc_id, starts) of windows; doc points into ids."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.uint32)
    cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    owners = ids[doc[cuts]] if len(cuts) else np.zeros(0, np.int64)
    blobs = [x.tobytes() for x in np.split(pos, cuts[1:])] if len(cuts) else []
    return pa.RecordBatch.from_arrays([pa.array([-1] * len(cuts), pa.int32()), pa.array(owners, pa.int64()), pa.array(blobs, pa.binary())] + [pa.nulls(len(cuts), pa.binary())] * 4, names=["part", "doc_id", "starts", "a", "b", "docs", "pos"])


def _candidates(window: int, bits: int, sketch, parts: int, size: int) -> Callable:
    """Repeats inside a chunk (part -1), and for each part the first of each window that is estimated repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sketch.value
        for c in _chunks(batches, window, size):
            keep = np.ones(len(c.a), bool)
            for row, h in zip(rows, (c.a, c.b)):
                at = h >> np.uint64(64 - bits)
                keep &= (row[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            a, b, doc, pos = c.a[keep], (c.b[keep] >> np.uint64(48)).astype(np.uint16), c.doc[keep], c.pos[keep]
            owner = c.ids[doc]
            order = np.lexsort((pos, owner, b, a))
            a, b, doc, pos, owner = a[order], b[order], doc[order], pos[order], owner[order]
            if not len(a):
                continue
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (owner != owner[first]) | (pos != pos[first])
            if later.any():
                yield _starts(c.ids, doc[later], pos[later])
            a, b, pos, doc = a[new], b[new], pos[new], doc[new]
            part = ((a >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((pos, doc, part))  # by document inside a part: small differences
            a, b, pos, doc, part = a[order], b[order], pos[order], doc[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            full = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
            cut = lambda x: pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())  # noqa: E731, B023
            none = pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.binary())
            place = np.diff(c.ids[doc], prepend=0), np.diff(pos, prepend=0).astype(np.int32)
            first = [cuts[k] for k in full]
            place[0][first], place[1][first] = c.ids[doc[first]], pos[first]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *none, cut(a), cut(b), cut(place[0]), cut(place[1])], names=["part", "doc_id", "starts", "a", "b", "docs", "pos"])

    return run


def _packed_starts(homes: int, owner: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Starts of repeats, packed by the home partition of their documents."""
    home = ((owner.view(np.uint64) * np.uint64(BASES[0])) >> np.uint64(40)).astype(np.int64) % homes
    order = np.lexsort((pos, owner, home))
    owner, pos, home = owner[order], pos[order], home[order]
    cuts = np.searchsorted(home, np.arange(homes + 1))
    full = [k for k in range(homes) if cuts[k] < cuts[k + 1]]
    rows = []
    for k in full:
        docs, counts = np.unique(owner[cuts[k] : cuts[k + 1]], return_counts=True)
        rows.append((docs.tobytes(), counts.astype(np.uint32).tobytes(), pos[cuts[k] : cuts[k + 1]].astype(np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(3))], names=["home", "docs", "counts", "pos"])


def _group(homes: int) -> Callable:
    """All rows of some parts: of equal windows, all but the first in order of document and start. Repeats found before pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            known = []
            for part, doc_id, starts, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    known.append((doc_id, np.frombuffer(starts, np.uint32)))
                else:
                    held.setdefault(part, []).append(blobs)
            if known:
                owner = np.repeat(np.array([k[0] for k in known], np.int64), [len(k[1]) for k in known])
                yield _packed_starts(homes, owner, np.concatenate([k[1] for k in known]).astype(np.int64))
        for part in list(held):
            blobs = held.pop(part)
            a, b = (np.concatenate([np.frombuffer(x[k], kind) for x in blobs]) for k, kind in enumerate((np.uint64, np.uint16)))
            owner, pos = (np.concatenate([np.cumsum(np.frombuffer(x[k], kind), dtype=np.int64) for x in blobs]) for k, kind in ((2, np.int64), (3, np.int32)))
            order = np.lexsort((pos, owner, b, a))
            a, b, owner, pos = a[order], b[order], owner[order], pos[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (owner != owner[first]) | (pos != pos[first])
            yield _packed_starts(homes, owner[later], pos[later])

    return run


def _home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All starts of the documents of some home partitions: a row for each document."""
    held: dict[int, list] = {}
    for batch in batches:
        for home, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(home, []).append(blobs)
    for home in list(held):
        blobs = held.pop(home)
        docs, counts, pos = (np.concatenate([np.frombuffer(x[k], kind) for x in blobs]) for k, kind in enumerate((np.int64, np.uint32, np.uint32)))
        owner = np.repeat(docs, counts)
        ids, at = np.unique(owner, return_inverse=True)
        yield _starts(ids, at, pos).select(["doc_id", "starts"])


def repeated_starts(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, max_bits: int = MAX_BITS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, starts): one row for each document with repeats; starts are lists of 32-bit word numbers where a repeated window starts."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = corpus_chars(docs) / 6
    bits = int(np.clip(np.floor(np.log2(max(words, 1) * 2)), 10, max_bits))
    sketch = spark.sparkContext.broadcast(repeated_counters(docs, window, bits, depth, chunk_words))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(words // 4_000_000))
    found = docs.mapInArrow(_candidates(window, bits, sketch, parts, chunk_words), "part int, doc_id long, starts binary, a binary, b binary, docs binary, pos binary")
    # Repeats found inside a chunk are dealt by their document; the rest by their part.
    dealt = found.repartition(parts, F.when(F.col("part") < 0, F.col("doc_id")).otherwise(F.col("part").cast("long")))
    packed = dealt.mapInArrow(_group(parts), "home int, docs binary, counts binary, pos binary").repartition(parts, "home")
    starts = settled(packed.mapInArrow(_home, "doc_id long, starts binary"))
    sketch.destroy()  # the executors' memory is needed
    return starts


def _kept(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts").to_pylist(), strict=True):
                words = words_of(text.as_py())
                n_words.append(len(words))
                if starts:
                    at = np.frombuffer(starts, np.uint32).astype(np.int64)
                    edge = np.zeros(len(words) + window + 1, np.int32)
                    np.add.at(edge, at[at < len(words)], 1)
                    np.add.at(edge, at[at < len(words)] + window, -1)
                    stay = np.cumsum(edge)[: len(words)] == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"]
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text of the words that stay, joined by spaces, in UTF-8."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    starts = repeated_starts(docs, window, **options).select(F.when(F.col("doc_id") != int(LAST), F.col("doc_id")).alias("d"), "starts")
    listed, others = maybe_among(docs, starts)  # only texts that repeat something are shuffled
    some = listed.join(starts, F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "text", "starts")
    rest = others.select("doc_id", "text", F.lit(None).cast("binary").alias("starts"))
    return some.union(rest).mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept binary")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
