"""LM scoring by deleted interpolation of bigrams, unigrams and a uniform distribution.

p(w | v) = a3[b] * c(v, w) / c(v) + a2[b] * c(w) / N + a1[b] / (V + 1), where b is the bucket of c(v) (by powers of two) and N, V are the tokens and
distinct tokens of the training texts. The weights of each bucket come from expectation-maximisation on held-out counts: every training
occurrence is left out of the counts in turn (c - 1 over c - 1), so each is scored by a model that hasn't seen it.

How it runs at scale. Counts cover the whole corpus and are never brought to one place:

* Unigram counts are a distributed table. Its ``common`` (65,535 at most) most frequent words are sent to all tasks; that bound does not grow.
* Counting: each chunk of documents sends its distinct pairs with their numbers, those of two common words by a hash of the pair, others to the
  partition of the rare word, where that word's own count is known once all its tokens are there. Pairs of two rare words go to the second
  word, and from there meet the count of the first one in a join. Pairs shrink to a histogram of (bucket, bigram estimate, unigram estimate)
  on a grid of eighths of a power of two, from which the weights are learned.
* Scoring: the probabilities of the ``pairs`` most frequent pairs (a bound again) are sent to all tasks, so these need no shuffle: what is shuffled by
  occurrence has a share of the corpus below 1 / ``pairs``. Of the others each chunk sends its distinct pairs once, and for each occurrence the
  number of its row within the chunk (two bytes); sums by row come back.
* All of this travels packed, a row for each chunk and partition: sorted keys as differences, by byte planes, so that they compress.

Tokens: words after lower-casing A to Z, then one end token for each text; the end token is also the context of the first word.
Defined results: a null text is empty: one end token. Every row is a text of its own, rows that repeat a doc_id too. A null doc_id is trained on and
not held out. Without training tokens every score is that of the uniform distribution. No rows in, none out. Other columns are not looked at.
docs is read three times and must hold its rows in the same order each time, as tables in files do.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import hashed_texts, settled, stream_groups, table

COMMON = 65_535
PAIRS = 1 << 20
CHUNK_TOKENS = 1_000_000
#: Rows of a chunk: so many that their numbers and one bit more fit into two bytes.
CHUNK_ROWS = 30_000
PART_TOKENS = 2_000_000
FOLDS, HELD_OUT = 5, 1
END = np.uint64(0)  # in the place of a word hash
RARE = 0xFFFF
GRID = 8
NOTHING = -(1 << 14)  # on the grid: an estimate of zero
BUCKETS = 48
#: Kinds of packed rows: pairs of common words; rare words after common ones; common words after rare ones; two rare words; scores of pairs of rare words; rows.
COMMON_PAIR, RARE_WORD, RARE_CONTEXT, RARE_PAIR, RARE_SCORE, ROWS = range(6)
KEYS = {COMMON_PAIR: (np.uint32, np.uint8), RARE_WORD: (np.uint64, np.uint16), RARE_CONTEXT: (np.uint64, np.uint16), RARE_PAIR: (np.uint64, np.uint64)}
SPREAD = np.uint32(0x9E3779B1)
GATHER = np.uint32(pow(0x9E3779B1, -1, 1 << 32))
PACKED = "part int, kind int, chunk long, keys binary, others binary, counts binary, rows binary"
COUNTED = "what int, a long, b long, c long, d long, n double, keys binary, counts binary"
CELL, PAIR, TOP = range(3)
SUMS = "chunk long, ids binary, rows binary, n_tokens binary, n_known binary, base_score binary, score binary"
LINES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _is_training(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS != HELD_OUT


class Tokens:
    """Some documents as one array of word hashes, each text closed by the end token, with one more end token before the first."""

    def __init__(self, ids: pa.Array, words: np.ndarray, counts: np.ndarray):
        self.ids = ids
        self.training = np.array([_is_training(i) for i in ids.to_pylist()], bool)
        self.lengths = counts + 1
        self.doc = np.repeat(np.arange(len(counts)), self.lengths)
        self.all = np.full(len(words) + len(counts) + 1, END, np.uint64)
        at = np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)
        self.all[at + 1] = words


def _token_chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Tokens]:
    for ids, words, counts in hashed_texts(batches, size, lower=True, rows=CHUNK_ROWS):
        yield Tokens(ids, words, counts)


def _count(size: int) -> Callable:
    """Training tokens by word, and under no word all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _token_chunks(batches, size):
            words, counts = np.unique(t.all[1:][t.training[t.doc]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*words.view(np.int64), None], pa.int64()), pa.array(np.append(counts, len(t.doc)))], names=["h", "c"])

    return run


class Common:
    """The most frequent words in a table by the first bits of their hashes; of words that want the same place one stays, the others count as rare. Ranks and counts by place."""

    SLOTS = 21

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        slot = (hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        _, stay = np.unique(slot, return_index=True)
        self.hashes, self.counts, self.total, self.distinct = hashes[stay], counts[stay].astype(np.float64), total, distinct
        self.table = np.full(1 << self.SLOTS, RARE, np.uint16)
        self.table[slot[stay]] = np.arange(len(stay))
        self.padded = np.append(self.hashes, np.zeros(RARE + 1 - len(self.hashes), np.uint64))

    def ranks(self, h: np.ndarray) -> np.ndarray:
        at = self.table[(h >> np.uint64(64 - self.SLOTS)).astype(np.int64)]
        return np.where((at != RARE) & (self.padded[at] == h), at, RARE).astype(np.uint32)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def bucket(c: np.ndarray) -> np.ndarray:
    """Of the frequency of a context: 0 for none, then one for each power of two."""
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def ratio(a: np.ndarray, b) -> np.ndarray:
    return np.where(np.asarray(b) > 0, a / np.maximum(b, 1), 0.0)


def runs_of(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys sorted together: where each distinct one begins, and the number of the distinct one of each row."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])))
    return np.flatnonzero(new), np.cumsum(new) - 1


def totals(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begin) if len(begin) else np.zeros(0, values.dtype)


class Mixture:
    """The weights by bucket: rows of (uniform, unigram, bigram)."""

    def __init__(self, weights: np.ndarray, total: int, distinct: int):
        self.weights, self.total, self.uniform = weights, total, 1.0 / (distinct + 1)

    def log10(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        w = self.weights[bucket(context)]
        return np.log10(w[:, 0] * self.uniform + w[:, 1] * ratio(word, self.total) + w[:, 2] * ratio(pair, context))


def _on_grid(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * GRID), NOTHING).astype(np.int64)


def histogram(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: int) -> pa.RecordBatch:
    """Training occurrences of pairs by bucket and estimates, each occurrence left out of the counts."""
    keep = pair > 0
    pair, context, word = pair[keep], context[keep], word[keep]
    cells = np.stack([bucket(context - 1), _on_grid(ratio(pair - 1, context - 1)), _on_grid(ratio(word - 1, total - 1))])
    cells, where = np.unique(cells, axis=1, return_inverse=True)
    n = np.bincount(where.ravel(), weights=pair, minlength=cells.shape[1])
    return pa.RecordBatch.from_arrays([*map(pa.array, cells), pa.array(n)], names=["b", "p3", "p2", "n"])


def fit(b: np.ndarray, p3: np.ndarray, p2: np.ndarray, n: np.ndarray, distinct: int, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation on the held-out counts; buckets without any keep the weights that all counts together give."""
    estimates = np.stack([np.full(len(b), 1.0 / (distinct + 1)), *(np.where(p > NOTHING, np.exp2(p / GRID), 0.0) for p in (p2, p3))], axis=1)

    def climb(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        w, e, m = start.copy(), estimates[rows], n[rows]
        for _ in range(rounds):
            part = e * w
            part /= part.sum(axis=1, keepdims=True)
            w = (part * m[:, None]).sum(axis=0) + 0.01
            w /= w.sum()
        return w

    whole = climb(np.arange(len(b)), np.full(3, 1 / 3)) if len(b) else np.array([1.0, 0.0, 0.0])
    weights = np.tile(whole, (BUCKETS, 1))
    for k in np.unique(b):
        weights[k] = climb(np.flatnonzero(b == k), whole)
    weights[0] = weights[0] * [1, 1, 0]  # after a context never seen there is no bigram estimate
    return weights / np.maximum(weights.sum(axis=1, keepdims=True), 1e-12)


class Frequent:
    """log10 p of frequent pairs of common words, in a table by the first bits of their keys; of pairs that want the same place the more frequent one stays."""

    SLOTS = 21

    def __init__(self, keys: np.ndarray, counts: np.ndarray, common: Common, mixture: Mixture):
        order = np.argsort(-counts, kind="stable")
        keys, counts = keys[order], counts[order]
        slots, stay = np.unique(self.slot(keys), return_index=True)
        self.keys = ~(np.arange(1 << self.SLOTS, dtype=np.uint32) << np.uint32(32 - self.SLOTS))  # a key of another place
        self.keys[slots] = keys[stay]
        self.p = np.zeros(1 << self.SLOTS, np.float32)
        self.p[slots] = pair_scores(keys[stay], counts[stay], common, mixture)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint32(32 - self.SLOTS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is here, and its log10 p."""
        at = self.slot(keys)
        return self.keys[at] == keys, self.p[at]


def pair_counts(keys: np.ndarray, common: Common) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the contexts and of the words of pairs of common words."""
    pair = keys * GATHER
    return common.counts[pair >> np.uint32(16)], common.counts[pair & np.uint32(RARE)]


def pair_scores(keys: np.ndarray, n: np.ndarray, common: Common, mixture: Mixture) -> np.ndarray:
    return mixture.log10(n.astype(np.float64), *pair_counts(keys, common))


def to_planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a key: rises with it."""
    first = keys.astype(np.uint64) if keys.dtype == np.uint32 else keys >> np.uint64(32)
    return (first * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _packs(kind: int, chunk: int, parts: int, keys: np.ndarray, others: np.ndarray | None, counts: np.ndarray, rows: np.ndarray | None) -> Iterator[tuple]:
    """A packed row for each partition that some keys belong to. keys: sorted, with others; counts: what each stands for; rows: of all occurrences, in that order."""
    begin, _ = runs_of(part_of(keys, parts))
    ends = np.append(begin, len(keys))[1:]
    upto = np.concatenate(([0], np.cumsum(counts))) if rows is not None else None
    for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
        yield (
            int(part_of(keys[a : a + 1], parts)[0]), kind, chunk, to_planes(np.diff(keys[a:b], prepend=keys.dtype.type(0))), b"" if others is None else to_planes(others[a:b]),
            to_planes(counts[a:b].astype(np.uint32)), b"" if rows is None else to_planes(rows[upto[a] : upto[b]]),
        )


def _batches(rows: list[tuple], names: str) -> Iterator[pa.RecordBatch]:
    kinds = [x.split() for x in names.split(", ")]
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    for k in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(x, arrow[t]) for x, (_, t) in zip(zip(*rows[k : k + 64], strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def _pack(common, frequent, parts: int, size: int) -> Callable:
    """Chunks of documents as packed rows. Without frequent, for counting: distinct pairs with their training counts; with it, for scoring: those that aren't frequent, and the rows they stand in."""

    def packed(t: Tokens, chunk: int, kind: int, keys: np.ndarray, others: np.ndarray | None, doc: np.ndarray) -> Iterator[tuple]:
        trained = t.training[doc]
        if frequent is None and kind != RARE_PAIR:  # held-out pairs of rare words are asked for, too
            keys, others, doc = keys[trained], others if others is None else others[trained], doc[trained]
        order = np.argsort(keys, kind="stable") if others is None else np.lexsort((others, keys))
        keys, others, doc = keys[order], others if others is None else others[order], doc[order]
        begin, _ = runs_of(keys) if others is None else runs_of(keys, others)
        counts = totals(t.training[doc].astype(np.int64), begin) if frequent is None else np.diff(np.append(begin, len(keys)))
        rows = None if frequent is None else (doc * 2 + t.training[doc]).astype(np.uint16)
        yield from _packs(kind, chunk, parts, keys[begin], others if others is None else others[begin], counts, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Common = common.value
        f: Frequent | None = frequent.value if frequent else None
        at_home = TaskContext.get().partitionId() << 32
        for k, t in enumerate(_token_chunks(batches, size)):
            chunk = at_home + k
            h, r = t.all, c.ranks(t.all)
            rare = r == RARE
            before, now = rare[:-1], rare[1:]
            out = []
            at = np.flatnonzero(~before & ~now)
            keys = ((r[at] << np.uint32(16)) | r[at + 1]).astype(np.uint32) * SPREAD
            if f:
                # What common words and frequent pairs alone decide is summed up here.
                known = np.bincount(t.doc[~now], minlength=len(t.ids)).astype(np.int64)
                base = np.bincount(t.doc[~now], weights=c.base(c.counts[r[1:][~now]]), minlength=len(t.ids))
                there, p = f.find(keys)
                score = np.bincount(t.doc[at[there]], weights=p[there].astype(np.float64), minlength=len(t.ids))
                ids = b"".join((t.ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), t.ids.is_null().to_numpy(zero_copy_only=False).tobytes()))
                out.append((int(chunk % parts), ROWS, chunk, ids, t.lengths.astype(np.int64).tobytes(), known.tobytes(), base.tobytes() + score.tobytes()))
                at, keys = at[~there], keys[~there]
            out += packed(t, chunk, COMMON_PAIR, keys, None, t.doc[at])
            at = np.flatnonzero(~before & now)
            out += packed(t, chunk, RARE_WORD, h[at + 1], r[at].astype(np.uint16), t.doc[at])
            at = np.flatnonzero(before & ~now)
            out += packed(t, chunk, RARE_CONTEXT, h[at], r[at + 1].astype(np.uint16), t.doc[at])
            at = np.flatnonzero(before & now)
            out += packed(t, chunk, RARE_PAIR, h[at + 1], h[at], t.doc[at])
            yield from _batches(out, PACKED)

    return run


class Part:
    """All packed rows of one partition: by kind the keys, others and counts of distinct pairs of chunks."""

    def __init__(self, group: pa.Table):
        columns = [group.column(n).to_pylist() for n in ("kind", "chunk", "keys", "others", "counts", "rows")]
        self.blobs: dict[int, list] = {}
        for kind, *blobs in zip(*columns, strict=True):
            self.blobs.setdefault(kind, []).append(blobs)

    def distinct(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, others and counts, sorted by keys and others, with repeats."""
        key_type, other_type = KEYS[kind]
        blobs = self.blobs.get(kind, [])
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        keys = join([np.cumsum(from_planes(b[1], key_type), dtype=key_type) for b in blobs], key_type)
        others = join([from_planes(b[2], other_type) for b in blobs], other_type) if kind != COMMON_PAIR else None
        return keys, others, join([from_planes(b[3], np.uint32) for b in blobs], np.uint32)

    def counted(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys and others, sorted, with the sums of their counts."""
        keys, others, n = self.distinct(kind)
        order = np.argsort(keys) if others is None else np.lexsort((others, keys))
        keys, others = keys[order], others if others is None else others[order]
        begin, _ = runs_of(keys) if others is None else runs_of(keys, others)
        return keys[begin], others if others is None else others[begin], totals(n[order].astype(np.float64), begin)

    def occurrences(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, others, training flags and places (the number of the chunk in this partition, and the row in it) of all occurrences, sorted by keys and others."""
        keys, others, n = self.distinct(kind)
        blobs = self.blobs.get(kind, [])
        rows = [from_planes(b[4], np.uint16) for b in blobs]
        place = np.concatenate([np.zeros(0, np.int64), *((self.chunks[b[0]] << 15) + (x >> 1) for b, x in zip(blobs, rows, strict=True))])
        trained = np.concatenate([np.zeros(0, np.uint16), *rows]) & 1
        order = np.argsort(keys) if others is None else np.lexsort((others, keys))
        first = np.cumsum(n, dtype=np.int64) - n
        n = n[order].astype(np.int64)
        each = np.repeat(first[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        repeat = lambda x: np.repeat(x[order], n)
        return repeat(keys), others if others is None else repeat(others), trained[each].astype(np.float64), place[each]

    def number_chunks(self) -> list[int]:
        """The chunks, whose numbers places then use."""
        found = sorted({b[0] for kind, blobs in self.blobs.items() if kind in KEYS for b in blobs})
        self.chunks = {c: np.int64(k) for k, c in enumerate(found)}
        return found


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    for _, group in stream_groups(batches, 1):
        yield Part(group)


def look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of the asked keys; 0 for those that aren't among the (sorted) keys."""
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0.0)


def _counted(common, parts: int, pairs: int) -> Callable:
    """Of partitions of training counts: cells of the histogram, pairs of rare words with the count of the second one, and the most frequent pairs."""

    def cells(h: pa.RecordBatch) -> pa.RecordBatch:
        n = h.num_rows
        none = lambda kind: pa.nulls(n, kind)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, CELL, np.int32)), *h.columns[:3], none(pa.int64()), h.column(3), none(pa.binary()), none(pa.binary())], names=[x.split()[0] for x in COUNTED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Common = common.value
        for part in _parts(batches):
            keys, _, n = part.counted(COMMON_PAIR)
            if len(keys):
                yield cells(histogram(n, *pair_counts(keys, c), c.total))
                few = min(len(keys), -(-pairs // parts))
                top = np.argpartition(-n, few - 1)[:few]
                top = top[n[top] > 1]
                yield from _batches([(TOP, None, None, None, None, None, keys[top].tobytes(), n[top].tobytes())], COUNTED)
            (w1, v1, n1), (w3, v3, n3), (v2, w2, n2) = (part.counted(k) for k in (RARE_WORD, RARE_PAIR, RARE_CONTEXT))
            words = np.concatenate([w1, w3])
            own, at = np.unique(words, return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([n1, n3]), minlength=len(own))
            if len(w1):
                yield cells(histogram(n1, c.counts[v1], look_up(own, count, w1), c.total))
            if len(w2):
                yield cells(histogram(n2, look_up(own, count, v2), c.counts[w2], c.total))
            n = len(w3)
            if n:
                columns = [np.full(n, PAIR, np.int32), v3.view(np.int64), w3.view(np.int64), n3.astype(np.int64), look_up(own, count, w3).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(n, pa.float64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=[x.split()[0] for x in COUNTED.split(", ")])

    return run


def _rare_cells(total: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield histogram(*(batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in ("pair", "context", "word")), total)

    return run


def _rare_scores(mixture, parts: int) -> Callable:
    """log10 p of pairs of rare words, packed for the partition of the second one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, v = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in ("w", "v"))
            p = mixture.value.log10(*(batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in ("pair", "context", "word")))
            order = np.lexsort((v, w))
            w, v, p = w[order], v[order], p[order].astype(np.float32)
            begin, _ = runs_of(part_of(w, parts))
            cuts = zip(begin.tolist(), np.append(begin, len(w))[1:].tolist(), strict=True)
            yield from _batches([(int(part_of(w[a : a + 1], parts)[0]), RARE_SCORE, 0, to_planes(np.diff(w[a:b], prepend=np.uint64(0))), to_planes(v[a:b]), p[a:b].tobytes(), b"") for a, b in cuts], PACKED)

    return run


def _scored(common, mixture) -> Callable:
    """Of partitions of occurrences: what they add to the rows of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Common = common.value
        m: Mixture = mixture.value
        for part in _parts(batches):
            for chunk, ids, lengths, known, both in part.blobs.get(ROWS, []):
                half = len(both) // 2
                yield from _batches([(chunk, ids, b"", lengths, known, both[:half], both[half:])], SUMS)
            chunks = part.number_chunks()
            places, scores = [], []
            keys, _, trained, place = part.occurrences(COMMON_PAIR)
            begin, run_no = runs_of(keys)
            places.append(place)
            scores.append(pair_scores(keys[begin], totals(trained, begin), c, m)[run_no])
            w1, v1, t1, at1 = part.occurrences(RARE_WORD)
            w3, v3, t3, at3 = part.occurrences(RARE_PAIR)
            v2, w2, t2, at2 = part.occurrences(RARE_CONTEXT)
            own, at = np.unique(np.concatenate([w1, w3]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([t1, t3]), minlength=len(own))
            begin, run_no = runs_of(w1, v1)
            places.append(at1)
            scores.append(m.log10(totals(t1, begin), c.counts[v1[begin]], look_up(own, count, w1[begin]))[run_no])
            begin, run_no = runs_of(v2, w2)
            places.append(at2)
            scores.append(m.log10(totals(t2, begin), look_up(own, count, v2[begin]), c.counts[w2[begin]])[run_no])
            places.append(at3)
            scores.append(rare_scores(part, w3, v3))
            yield from sums(chunks, np.concatenate(places), {"score": np.concatenate(scores)})
            n = look_up(own, count, np.concatenate([w1, w3]))
            yield from sums(chunks, np.concatenate([at1, at3]), {"n_known": (n > 0).astype(np.int64), "base_score": c.base(n)})

    def rare_scores(part: Part, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The scores of pairs of rare words (sorted), which came along; every pair that occurs has one."""
        blobs = part.blobs.get(RARE_SCORE, [])
        if not len(w):
            return np.zeros(0)
        keys = np.concatenate([np.cumsum(from_planes(b[1], np.uint64), dtype=np.uint64) for b in blobs])
        others = np.concatenate([from_planes(b[2], np.uint64) for b in blobs])
        p = np.concatenate([np.frombuffer(b[3], np.float32) for b in blobs])
        order = np.lexsort((others, keys))
        begin, run_no = runs_of(w, v)
        assert len(begin) == len(order) and (keys[order] == w[begin]).all() and (others[order] == v[begin]).all()
        return p[order][run_no].astype(np.float64)

    def sums(chunks: list[int], place: np.ndarray, values: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        where, at = np.unique(place, return_inverse=True)
        added = {k: np.bincount(at, weights=x, minlength=len(where)) for k, x in values.items()}
        begin, _ = runs_of(where >> 15)
        rows = (where & 0x7FFF).astype(np.uint16)
        out = []
        for a, b in zip(begin.tolist(), np.append(begin, len(where))[1:].tolist(), strict=True):
            blobs = {k: x[a:b].astype({"score": np.float32, "n_known": np.uint32, "base_score": np.float64}[k]).tobytes() for k, x in added.items()}
            out.append((chunks[int(where[a] >> 15)], b"", rows[a:b].tobytes(), b"", *(blobs.get(k, b"") for k in ("n_known", "base_score", "score"))))
        yield from _batches(out, SUMS)

    return run


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that is added to the rows of each chunk: a row for each text."""
    for _, group in stream_groups(batches, 1):
        parts = list(zip(*(group.column(n).to_pylist() for n in ("ids", "rows", "n_tokens", "n_known", "base_score", "score")), strict=True))
        (whole,) = (x for x in parts if x[0])
        n = len(whole[2]) // 8
        ids = pa.array(np.frombuffer(whole[0], np.int64, n), mask=np.frombuffer(whole[0][8 * n :], bool))
        known, base, score = (np.frombuffer(whole[k], kind).astype(np.float64) for k, kind in ((3, np.int64), (4, np.float64), (5, np.float64)))
        for x in parts:
            if not x[0]:
                rows = np.frombuffer(x[1], np.uint16)
                for to, k, kind in ((known, 3, np.uint32), (base, 4, np.float64), (score, 5, np.float32)):
                    if x[k]:
                        to[rows] += np.frombuffer(x[k], kind)
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(whole[2], np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score_texts(docs: DataFrame, common_words: int = COMMON, chunk_tokens: int = CHUNK_TOKENS, pairs: int = PAIRS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = settled(docs.mapInArrow(_count(chunk_tokens), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    total, distinct, tokens = (int(x or 0) for x in counts.agg(F.sum(F.when(F.col("h").isNotNull(), F.col("c"))), F.count("h"), F.sum(F.when(F.col("h").isNull(), F.col("c")))).first())
    counts = counts.where("h is not null")
    top = counts.orderBy(F.desc("c"), "h").limit(min(common_words, COMMON)).toArrow()  # bounded: COMMON rows at most
    common = send(Common(top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy(), total, distinct))
    parts = max(1, round(tokens / part_tokens))
    tasks = max(2 * parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    gathered = lambda rows, key: rows.repartition(tasks, key).sortWithinPartitions(key)

    counted = settled(gathered(docs.mapInArrow(_pack(common, None, parts, chunk_tokens), PACKED), "part").mapInArrow(_counted(common, parts, pairs), COUNTED))
    rare = counted.where(F.col("what") == PAIR).select(F.col("a").alias("v"), F.col("b").alias("w"), F.col("c").alias("pair"), F.col("d").alias("word"))
    rare = settled(rare.join(counts.select(F.col("h").alias("v"), F.col("c").alias("context")), "v", "left").fillna(0, ["context"]))
    cells = "b long, p3 long, p2 long, n double"
    found = counted.where(F.col("what") == CELL).select(F.col("a").alias("b"), F.col("b").alias("p3"), F.col("c").alias("p2"), "n").union(rare.mapInArrow(_rare_cells(total), cells))
    grid = found.groupBy("b", "p3", "p2").agg(F.sum("n").alias("n")).toArrow()  # a grid of estimates: its cells don't grow with the corpus
    weights = fit(*(grid.column(k).to_numpy() for k in ("b", "p3", "p2", "n")), distinct)
    mixture = Mixture(weights, total, distinct)
    often = counted.where(F.col("what") == TOP).select("keys", "counts").toArrow()  # bounded: `pairs`, and one a partition
    keys, numbers = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in often.column(k).to_pylist())]) for k, kind in (("keys", np.uint32), ("counts", np.float64)))
    frequent, mixture = send(Frequent(keys, numbers, common.value, mixture)), send(mixture)

    asked = docs.mapInArrow(_pack(common, frequent, parts, chunk_tokens), PACKED).union(rare.mapInArrow(_rare_scores(mixture, parts), PACKED))
    scored = gathered(gathered(asked, "part").mapInArrow(_scored(common, mixture), SUMS), "chunk").mapInArrow(_lines, LINES)
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
