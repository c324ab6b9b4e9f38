"""Periodic run detection: all maximal stretches of words that repeat with a smallest period, by multi-scale minimizers.

Periods under ``SHORT`` are found by direct scans: one comparison of all words with those a lag away. A scale s covers periods q of 2^s to 2^(s+1)-1: blocks of k = 2^(s-1)
words have hashes, and of 2^(s-1) consecutive blocks the one with the least hash is their minimizer. Inside a run of period q the minimizers of two windows that lie q apart are q
apart too, with equal blocks. So pairs of equal minimizers at such distances are seeds; a seed's lag is extended to both sides by binary search on prefix hashes.

A block whose own period is at most k/2 lies in a run that is already known, and could have many equals. Pairs inside one such run say nothing new. Of two such runs
only a few lags can be a period: the distances of their starts and of their ends, and, if they touch, any lag that fits. So work is about
n log^2 n for any text. Every stretch found is compared word by word; where hashes told a lie, words decide.

Texts of many documents are searched together, longest first, so that a scale takes the documents in which its periods fit twice. No shuffle.

Defined cases: a null text has no words; a null doc_id leaves its text undamaged; each row of documents has its own result, so repeated ids have several; texts of any
length are searched whole; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mentionlake.llm.common import runs as ranges
from mentionlake.llm.common import table, words_of

#: The least length of a run; periods below SHORT are scanned directly; words that are searched together (or one document).
LEAST, SHORT, BATCH = 12, 32, 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
SCHEMA = "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


def stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True of that length at least."""
    edges = np.flatnonzero(same[1:] != same[:-1]) + 1
    if len(same) and same[0]:
        edges = np.concatenate(([0], edges))
    if len(edges) % 2:
        edges = np.append(edges, len(same))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return starts[keep], ends[keep]


class Lags:
    """How far a lag's equality reaches: on prefix hashes of the words, all seeds at once."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        values = mixed((ids.astype(np.uint64) + np.uint64(1)) * _BASE)
        self.up = np.cumprod(np.concatenate(([1], np.full(self.n, _BASE | np.uint64(1), np.uint64))), dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.up[:-1], dtype=np.uint64)))

    def equal(self, a: np.ndarray, lag: np.ndarray, length: np.ndarray) -> np.ndarray:
        left = self.sums[a + length] - self.sums[a]
        return left * self.up[lag] == self.sums[a + lag + length] - self.sums[a + lag]

    def _longest(self, most: np.ndarray, equal) -> np.ndarray:
        reach, step = np.zeros(len(most), np.int64), 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            further = np.minimum(reach + step, most)
            reach = np.where((further > reach) & equal(further), further, reach)
            step >>= 1
        return reach

    def extended(self, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretches [start, end) around places that have the lag's period."""
        ahead = self._longest(self.n - at - lag, lambda m: self.equal(at, lag, m))
        behind = self._longest(at, lambda m: self.equal(at - m, lag, m))
        return at - behind, at + lag + ahead


def least_of_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` (a power of two) consecutive keys."""
    step = 1
    while step < width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    return keys


def seeds_of_minimizers(hashes: np.ndarray, width: int, low: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of pairs of equal minimizers at lags from low to 2 low - 1; `known` marks blocks in runs of short periods."""
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    keys = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    least = least_of_windows(keys, width)
    least = np.sort(least[np.concatenate(([True], least[1:] != least[:-1]))])
    places = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    fresh = ~known[places]
    least, places = least[fresh] >> bits, places[fresh]
    found, j = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 1
    first = np.arange(len(places))
    while True:
        first = first[first < len(places) - j]
        lag = places[first + j] - places[first]
        near = (least[first + j] == least[first]) & (lag < 2 * low)
        first, lag = first[near], lag[near]
        if not len(first):
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))
        found.append((places[first][lag >= low], lag[lag >= low]))
        j += 1


def seeds_of_runs(runs: np.ndarray, block: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) from pairs of known runs (start, end, period) whose period is at most half a block and the same: only such lags can be periods beyond them."""
    long = runs[(runs[:, 2] * 2 <= block) & (runs[:, 1] - runs[:, 0] >= block)]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    found, j = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 1
    first = np.arange(len(long))
    while True:
        first = first[first < len(long) - j]
        a, b = long[first], long[first + j]
        near = (a[:, 2] == b[:, 2]) & (b[:, 0] - a[:, 1] < 2 * low)
        first, a, b = first[near], a[near], b[near]
        if not len(first):
            break
        for place, lag in ((a[:, 0], b[:, 0] - a[:, 0]), (a[:, 1] - 1, b[:, 1] - a[:, 1])):
            good = (lag >= low) & (lag < 2 * low)
            found.append((place[good], lag[good]))
        touch = a[:, 1] >= b[:, 0]  # then any lag up to the shorter one's length
        counts = np.clip(np.minimum(b[:, 1] - b[:, 0], a[:, 1] - a[:, 0]) - low + 1, 0, low) * touch
        lags = ranges(np.full(len(counts), low), counts)
        found.append((np.minimum(np.repeat(a[:, 1], counts), np.repeat(b[:, 1], counts) - lags) - 1, lags))
        j += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def proven(ids: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The stretches as words have them: those that hashes drew too far are drawn anew from their middle."""
    out = []
    for start, end, lag in found.tolist():
        same = ids[start : end - lag] == ids[start + lag : end]
        whole = (start == 0 or ids[start - 1] != ids[start - 1 + lag]) and (end == len(ids) or ids[end] != ids[end - lag])
        if same.all() and whole:
            out.append((start, end, lag))
            continue
        for a, b in zip(*stretches(ids[:-lag] == ids[lag:], max(LEAST, 2 * lag) - lag), strict=True):
            if a < end and b + lag > start:
                out.append((int(a), int(b) + lag, lag))
    return np.array(out, np.int64).reshape(-1, 3)


def all_runs(ids: np.ndarray, lengths: list[int]) -> np.ndarray:
    """(start, end, period) of the runs of texts that stand one after another, longest first; word numbers `ids`. After each text stands a number of its own."""
    parts = [np.zeros((0, 3), np.int64)]
    for lag in range(1, min(SHORT, len(ids))):
        starts, ends = stretches(ids[lag:] == ids[:-lag], max(LEAST, 2 * lag) - lag)
        parts.append(np.stack([starts, ends + lag, np.full(len(starts), lag)], axis=1))
    runs = smallest(np.concatenate(parts))
    sizes = np.array(lengths, np.int64)
    hashes, block, lags = mixed((ids.astype(np.uint64) + np.uint64(7)) * _ODD[2]), 1, None
    low = SHORT
    while len(sizes) and sizes[0] >= 2 * low:
        kept = int((sizes >= 2 * low).sum())
        n = int((sizes[:kept] + 1).sum())
        while block < low // 2:
            hashes = mixed(hashes[:-block] * _ODD[1] + hashes[block:])
            block *= 2
        here = hashes[: n - block + 1]
        lags = lags or Lags(ids[:n])
        inside = runs[(runs[:, 2] * 2 <= block) & (runs[:, 1] - runs[:, 0] >= block) & (runs[:, 1] <= n)]
        known = np.zeros(len(here) + 1, np.int64)
        np.add.at(known, inside[:, 0], 1)
        np.add.at(known, inside[:, 1] - block + 1, -1)
        seeds = [seeds_of_minimizers(here, low // 2, low, np.cumsum(known)[:-1] > 0), seeds_of_runs(runs[runs[:, 1] <= n], block, low)]
        place, lag = (np.concatenate(x) for x in zip(*seeds, strict=True))
        if len(place):
            start, end = lags.extended(place, lag)
            found = np.unique(np.stack([start, end, lag], axis=1)[end - start >= 2 * lag], axis=0)
            runs = smallest(np.concatenate([runs, proven(ids, found)]))
        low *= 2
    return runs


def smallest(runs: np.ndarray) -> np.ndarray:
    """Of stretches found with several periods the one with the smallest: the others are its multiples."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))] if len(runs) else runs


def damage(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents get a periodic end, which their id determines."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def described(texts: list[list[bytes]]) -> list[tuple]:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each text."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    flat = [w for i in order for w in texts[i]]
    sizes = [len(texts[i]) for i in order]
    numbers = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if flat else np.zeros(0, np.int64)
    ends = np.cumsum(np.array(sizes, np.int64) + 1)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    ends -= 1  # where the separators stand
    within = np.ones(len(ids), bool)
    within[ends] = False
    ids[within] = numbers
    ids[ends] = len(flat) + np.arange(len(ends))
    runs = all_runs(ids, sizes)
    cut = np.searchsorted(runs[:, 0], np.concatenate((ends - np.array(sizes, np.int64), [len(ids)])))
    out: list = [None] * len(texts)
    for k, i in enumerate(order):
        own = runs[cut[k] : cut[k + 1]] - np.array([ends[k] - sizes[k], ends[k] - sizes[k], 0])
        out[i] = _digest(texts[i], own[np.lexsort((own[:, 2], own[:, 0]))])
    return out


def _digest(words: list[bytes], runs: np.ndarray) -> tuple:
    if not len(runs):
        return 0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    start, length, period = runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    best = np.lexsort((period, start, -length))[0]
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, runs[:, 1], -1)
    kept = b" ".join(words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist())
    longest = (int(x[best]) for x in (start, length, period))
    return len(runs), *longest, int(1000 * length[best] // period[best]), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def _detect(schema: pa.Schema, damaging: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            texts: list[list[bytes]] = []
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                ids.append(doc_id.as_py())
                texts.append(damage(ids[-1], words) if damaging else words)
                held += len(words)
                if held >= BATCH:
                    yield _batch(ids, texts, schema)
                    ids, texts, held = [], [], 0
            if ids:
                yield _batch(ids, texts, schema)

    return run


def _batch(ids: list, texts: list[list[bytes]], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*((i, *d) for i, d in zip(ids, described(texts), strict=True)), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def detect(docs: DataFrame, damaging: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the whole texts of (doc_id, text), as they are or with the ends that `damage` gives."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    longs = [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *longs, ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
    return docs.select("doc_id", "text").mapInArrow(_detect(schema, damaging), SCHEMA.format(kind.simpleString()))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, of which a tenth are given a periodic end."""
    return detect(table(spark, sf_dir, "documents"), damaging=True)
