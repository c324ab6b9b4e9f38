"""Compatibility decomposition (NFKD) without marks, for all of the basic plane, as tables made by rule from the standard library's data."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from mentionlake.functions.bind import let

#: Hangul syllables are made of up to three letters, by arithmetic (fixed values of the Unicode standard).
HANGUL, LEADS, VOWELS, TAILS, PER_LEAD, PER_VOWEL = 0xAC00, 0x1100, 0x1161, 0x11A7, 588, 28


@cache
def _pages() -> str:
    """For each 256 code points what they decompose to, without marks; no entry for those that stay, as JSON."""
    pages: list[list] = [[] for _ in range(256)]
    for code in range(0x80, 0x10000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or HANGUL <= code <= 0xD7A3:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain != char:
            pages[code >> 8] = pages[code >> 8] or [None] * 256
            pages[code >> 8][code & 255] = plain
    return json.dumps(pages)


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def without_marks(text: Column) -> Column:
    """Text in compatibility decomposition, combining marks left out. Letters beyond the basic plane stay."""
    pages = F.from_json(F.lit(_pages()), "array<array<string>>")

    def hangul(code: Column) -> Column:
        s = (code - HANGUL).cast("int")
        tail = s % PER_VOWEL
        return F.concat(_char(LEADS + F.floor(s / PER_LEAD)), _char(VOWELS + F.floor((s % PER_LEAD) / PER_VOWEL)), F.when(tail > 0, _char(TAILS + tail)).otherwise(""))

    def one(char: Column, code: Column) -> Column:
        return F.when(code < 0x80, char).when(code.between(HANGUL, 0xD7A3), hangul(code)).when(code > 0xFFFF, char).otherwise(F.coalesce(F.get(F.get(pages, F.shiftright(code, 8)), code.bitwiseAND(255)), char))

    changed = F.array_join(F.transform(F.split(text, ""), lambda c: let(F.ascii(c), lambda code: one(c, code))), "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), changed).otherwise(text)
