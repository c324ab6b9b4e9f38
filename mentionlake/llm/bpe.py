"""Byte-level BPE over a trie of distinct words, each shared prefix encoded once.

A text is cut at special tokens, and between them into pre-tokens: letters, digits or other signs with the blank before them, contractions, white space.
Distinct pre-tokens are put into a trie by sorting them, and one depth-first walk carries, for each prefix, its *last-token state*: the last token of
the prefix's encoding and where that token starts. Of the tokens that end a prefix, the last one is that which BPE keeps apart from the last token of
what stands before it; there is exactly one. Following the states back from the end of a word gives its encoding.

Encoding and decoding are maps over partitions; nothing is shuffled. Pre-tokens are cut on the code points of a whole Arrow batch and dictionary-encoded;
only distinct ones are walked, and ids and texts are put together from them again by Arrow. Caches are bounded and only save time.

Defined results: a null text is an empty one (no tokens). Bytes that are no UTF-8 count as U+FFFD. Special tokens in a text become their ids, and
decoding writes them out again. Other columns are not looked at; repeated rows are encoded each; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import runs, table

#: Kinds of characters; LETTER and DIGIT are the general categories L and N, SPACE is Unicode's white space.
OTHER, LETTER, DIGIT, SPACE = range(4)
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Bytes that the cache of words may hold, about; and entries of those of pairs and of tokens.
CACHE = 25_000_000
APART, EDGES = 150_000, 20_000
NEVER = 1 << 40
#: Bytes of text that are encoded at a time; arrays of several times that size are made of it.
GROUP_BYTES = 1_000_000


def byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: those that are printable stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def kinds() -> np.ndarray:
    """The kind of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = ord(".")
    every = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[SPACES] = SPACE
    return out


def pretokens(points: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in some code points. segment: where nothing before counts any more, at the start of each text."""
    kind = kinds()[points]
    begins = segment.copy()
    blank = points[:-1] == 0x20
    begins[1:] |= (kind[1:] != kind[:-1]) & ~(blank & (kind[1:] != SPACE))
    begins[:-1] |= (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~segment[1:]  # the last of some white space stands by itself, or with what follows
    at = np.flatnonzero(points == ord("'"))
    at = at[begins[at]]
    for letters in CONTRACTIONS:
        found = at[at + len(letters) < len(points)]
        for k, c in enumerate(letters, 1):
            found = found[(points[found + k] == ord(c)) & ~segment[found + k]]
        begins[found + 1] = False
        end = found + len(letters) + 1
        begins[end[end < len(points)]] = True
    return begins


class Bpe:
    """Encoder and decoder made from the JSON of a byte-level tokenizer file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        chars = byte_characters()
        as_bytes = lambda token: bytes(chars[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in data["model"]["vocab"].items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.special = {t["content"].encode(): t["id"] for t in data["added_tokens"]}
        self.bytes |= {i: t for t, i in self.special.items()}
        self.cut = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max(self.bytes) + 1
        self.decimals = pa.array([str(i).encode() for i in range(size)], pa.binary())
        self.texts = pa.array([self.bytes.get(i, b"") for i in range(size)], pa.large_binary())
        self.apart: dict[int, bool] = {}
        self.edges: dict[int, tuple | None] = {}
        self.words: dict[bytes, bytes] = {}
        self.held = CACHE + 1

    def spines(self, token: int) -> tuple | None:
        """What stands at the left and at the right edge of a token while BPE builds it from bytes, each with the rank at which it goes into something larger; None if BPE doesn't build it."""
        if token in self.edges:
            return self.edges[token]
        if len(self.edges) >= EDGES:
            self.edges.clear()
        parts = [bytes([b]) for b in self.bytes[token]]
        left, right = [], []
        while len(parts) > 1:
            rank, k = min((self.ranks.get((parts[k], parts[k + 1]), NEVER), k) for k in range(len(parts) - 1))
            if rank == NEVER:
                break
            if k == 0:
                left.append((parts[0], rank))
            if k == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        whole = (parts[0], NEVER)
        self.edges[token] = ([*left, whole], [*right, whole]) if len(parts) == 1 else None
        return self.edges[token]

    def stays(self, before: int, token: int) -> bool:
        """Whether BPE gives the two tokens for their bytes: no merge across them comes before what its two sides go into (of equal pairs the left one is merged first)."""
        a, b = self.spines(before), self.spines(token)
        if a is None or b is None:
            return False
        right, left = a[1], b[0]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            rank = self.ranks.get((x, y), NEVER)
            if rank < x_ends and rank <= y_ends and rank < NEVER:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """A depth-first walk over the trie of the words, which their sorted order is."""
        get, known, longest = self.ids.get, self.apart, self.longest
        path, tokens, starts = b"", [-1], [0]  # states by depth; the root has no last token
        for word in sorted(words):
            if len(known) > APART:
                known.clear()
            shared = len(commonprefix((path, word)))
            del tokens[shared + 1 :], starts[shared + 1 :]
            for depth in range(shared, len(word)):
                # Exactly one start is right; the likeliest come first: the last token goes on, or the byte stands alone.
                for start in (starts[depth], depth, *range(max(0, depth - longest), depth)):
                    token = get(word[start : depth + 1])
                    if token is None:
                        continue
                    if start:
                        key = tokens[start] << 32 | token
                        good = known.get(key)
                        if good is None:
                            good = known[key] = self.stays(tokens[start], token)
                    else:
                        good = self.spines(token) is not None
                    if good:
                        break
                else:
                    raise ValueError(f"no encoding of {word[: depth + 1]!r}: the vocabulary lacks a byte")
                tokens.append(token)
                starts.append(start)
            path, found, at = word, [], len(word)
            while at:
                found.append(tokens[at])
                at = starts[at]
            yield word, found[::-1]

    def forget(self) -> None:
        """Empties the caches: a worker that waits for its next task holds little memory."""
        self.words, self.apart, self.edges, self.held = {}, {}, {}, CACHE + 1

    def learn(self, words: list[bytes]) -> None:
        """Adds words to the cache."""
        if self.held > CACHE:
            self.words = {t: array("i", [i]).tobytes() for t, i in self.special.items()}  # nothing else makes a pre-token of their bytes
            self.held = 0
        for word, ids in self.encode_words(w for w in words if w not in self.words):
            self.words[word] = array("i", ids).tobytes()
            self.held += 160 + len(word) + 4 * len(ids)

    def with_special(self, texts: pa.Array) -> list[int]:
        """The texts that hold special tokens."""
        holds = np.zeros(len(texts), bool)
        for token in self.special:
            holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return np.flatnonzero(holds).tolist()

    def run(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Of each text: the number of its tokens, their ids as decimal numbers joined by commas, and what they decode to."""
        texts = texts.fill_null("").cast(pa.large_binary())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        segment = np.zeros(len(data) + 1, bool)
        segment[edges] = True
        marks = [(edges[k] + m.start(), edges[k] + m.end()) for k in self.with_special(texts) for m in self.cut.finditer(data[edges[k] : edges[k + 1]].tobytes())]
        for a, b in marks:
            segment[[a, b]] = True
        place = np.flatnonzero((data & 0xC0) != 0x80)  # of each code point
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        begins = pretokens(points, segment[:-1][place]) if len(points) else np.zeros(0, bool)
        for a, b in np.searchsorted(place, marks) if marks else ():
            begins[a + 1 : b] = False
        begin = place[begins]
        offsets = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.words]
        if new or not self.words:
            self.learn(distinct if self.held > CACHE else new)
        blobs = [self.words[w] for w in distinct]
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), np.int32)
        first = np.concatenate(([0], np.cumsum(size)))[:-1]
        tokens = pa.array(flat[runs(first[at], size[at])])
        ends = np.concatenate(([0], np.cumsum(size[at])))[np.searchsorted(begin, edges)]
        ids = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), self.decimals.take(tokens)), b",")
        whole = self.texts.take(tokens)
        bounds = np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1][ends] if len(whole) else np.zeros(len(ends), np.int64)
        decoded = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), whole.buffers()[2] or pa.py_buffer(b"")])
        return np.diff(ends), ids.cast(pa.string()), decoded.cast(pa.large_string()).cast(pa.string())


_ready: dict[str, Bpe] = {}


def _loaded(spec: str) -> Bpe:
    """One encoder for each Python worker, kept from task to task; its caches are not."""
    if spec not in _ready:
        _ready.clear()
        _ready[spec] = Bpe(spec)
    return _ready[spec]


def _groups(texts: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `size` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield lo, hi
        lo = hi


def _encode(spec, group_bytes: int = GROUP_BYTES) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        pool.release_unused()  # what this worker kept of earlier tasks, perhaps of other operators
        bpe = _loaded(spec.value)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in _groups(texts, group_bytes):
                tokens, ids, decoded = bpe.run(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(tokens), ids, decoded], names=["doc_id", "n_tokens", "ids", "decoded"])
        bpe.forget()
        pool.release_unused()

    return run


def encode(docs: DataFrame, vocabulary: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as decimal numbers joined by commas, and the text that they decode to. vocabulary: the path of a byte-level tokenizer file, read on the driver. group_bytes: text that a task encodes at a time; less takes less memory and more time."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.select("doc_id", F.make_valid_utf8(F.col("text").cast("string")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_encode(spec, group_bytes), f"doc_id {kind}, n_tokens long, ids string, decoded string")


def public_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), public_vocabulary()))
