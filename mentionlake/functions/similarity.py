"""Similarity of titles. Bounds decide most pairs; only what they leave open needs the matcher of blocks, which runs in Arrow batches."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mentionlake.functions.text import clean_title, jaccard, normalize_text, significant_tokens

#: What the ratio of blocks counts if texts share under two significant words.
WEAK = 0.55


def common_letters(a: str, b: str) -> int:
    """Letters that both have, each as often as the text that has fewer: no matching of blocks has more."""
    return (Counter(a) & Counter(b)).total()


@lru_cache(10_000)
def places_of(text: str) -> dict[str, int]:
    """Where each letter stands, as bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i
    return places


def common_subsequence(a: str, b: str, least: float = 0) -> int:
    """Length of the longest common subsequence, a row of bits for all of the longer text at a time; blocks that match in order are one. If it is surely under `least`, what is known to be above it."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    places, full = places_of(b), (1 << len(b)) - 1
    row = full
    for start in range(0, len(a), 64):
        for c in a[start : start + 64]:
            hit = row & places.get(c, 0)
            row = (row + hit | row - hit) & full
        most = len(b) - row.bit_count() + max(len(a) - start - 64, 0)
        if most < least:
            return most
    return len(b) - row.bit_count()


@dataclass(frozen=True)
class Pairs:
    """The pairs of neighbouring letters of a text as a set of bits, each pair as often as it occurs; `lost` of them fell on a bit that was set."""

    WORDS = 8  # of 64 bits

    bits: int
    lost: int

    @classmethod
    def of(cls, text: str) -> Pairs:
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        pairs = np.sort(letters[:-1] << np.uint64(21) | letters[1:])
        place = np.arange(len(pairs))
        again = place - np.maximum.accumulate(np.where(np.concatenate((pairs[:1] == pairs[:1], pairs[1:] != pairs[:-1])), place, 0))
        hashed = (pairs + again.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
        marks = np.zeros(64 * cls.WORDS, np.uint8)
        marks[hashed >> np.uint64(55)] = 1
        bits = int.from_bytes(np.packbits(marks).tobytes(), "little")
        return cls(bits, len(pairs) - bits.bit_count())

    def words(self) -> np.ndarray:
        return np.frombuffer(self.bits.to_bytes(8 * self.WORDS, "little"), np.uint64)

    def most_shared(self, other: Pairs) -> int:
        """No fewer than the pairs that both have."""
        return (self.bits & other.bits).bit_count() + min(self.lost, other.lost)


def shared_pairs(total, least: float):
    """How many pairs of letters two texts of that total length surely share if their ratio is at least that.

    M letters match in blocks; between two blocks a letter of one of the texts is left over, so there are total - 2 M + 1 blocks at most, and each but for its last letter begins a pair.
    """
    return total * (1.5 * least - 1) - 1 - 1e-6


def ratio_above(a: str, b: str, least: float) -> float | None:
    """The ratio of matching blocks, 2 M / (len(a) + len(b)), or None if that is surely under `least`: by the lengths, by the letters, by the longest common subsequence, or else by the blocks.

    M depends on which text comes first, as the matcher does.
    """
    total = len(a) + len(b)
    if not total:
        return 1.0
    need = least * total / 2 - 1e-9
    if min(len(a), len(b)) < need or common_letters(a, b) < need or common_subsequence(a, b, need) < need:
        return None
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def ratio_over(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio of blocks, or null where it is surely under `least`; null texts are pairs that need none."""
    return pd.Series([None if x is None or y is None else ratio_above(x, y, z) for x, y, z in zip(a, b, least, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """The greater of the ratio of sequences (weakened if under two significant words are shared) and the Jaccard similarity of significant words.

    Where the shorter text's length shows that the ratio can't exceed the Jaccard similarity, the pair isn't sent to Python.
    """
    x, y = normalize_text(clean_title(a)), normalize_text(clean_title(b))
    tokens_x, tokens_y = significant_tokens(x), significant_tokens(y)
    words = jaccard(tokens_x, tokens_y)
    weight = F.when(F.size(F.array_intersect(tokens_x, tokens_y)) < 2, WEAK).otherwise(1.0)
    both = (x != "") & (y != "")
    most = weight * 2 * F.least(F.length(x), F.length(y)) / F.greatest(F.length(x) + F.length(y), F.lit(1))
    open_ = both & (most > words)
    ratio = ratio_over(F.when(open_, x), F.when(open_, y), words / weight)
    return F.when(both, F.greatest(F.coalesce(weight * ratio, F.lit(0.0)), words)).otherwise(0.0)
