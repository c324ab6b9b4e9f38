"""HTML entities: named and numbered ones, without a Python UDF. A name is looked up by its hash, in one step however many names there are."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

from mentionlake.functions.bind import let

BUCKETS = 4096
LOST = "�"


@cache
def _named() -> str:
    """The standard library's names without their semicolon and their texts, dealt by their hash, as JSON."""
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, value in html5.items():
        if name.endswith(";"):
            buckets[crc32(name[:-1].encode()) % BUCKETS][name[:-1]] = value
    return json.dumps(buckets, separators=(",", ":"))


@cache
def _bare_names() -> tuple[str, ...]:
    """Names that old pages write without a semicolon, longest first."""
    return tuple(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))


def _value(buckets: Column, name: Column) -> Column:
    """The text of a name; null for others."""
    return F.try_element_at(F.get(buckets, F.pmod(F.crc32(name), F.lit(BUCKETS)).cast("int")), name)


def _windows(byte: int) -> str:
    try:
        return bytes([byte]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(byte)


def _from_code(code: Column) -> Column:
    """The character that a number stands for: 128 to 159 as old pages mean them, nothing for what is no character, the mark of a lost one for 0, surrogates and beyond Unicode."""
    old = F.array(*(F.lit(_windows(b)) for b in range(128, 160)))
    nothing = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    char = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")  # a mark of byte order first, or the decoder takes U+FEFF for one
    return F.when(code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), LOST).when(code.between(128, 159), F.get(old, (code - 128).cast("int"))).when(nothing, "").otherwise(char)


def _numbered(digits: Column, base: int) -> Column:
    """The number of a digit text; null if it is longer than any character's."""
    plain = F.ltrim(digits, F.lit("0"))
    return F.when(F.length(plain) <= 8, F.conv(F.concat(F.lit("0"), plain), base, 10).cast("long"))


def unescape(text: Column) -> Column:
    """Text with its entities read: &name; &#number; &#xnumber; and the old names without a semicolon. Others stay."""
    table = F.from_json(F.lit(_named()), "array<map<string,string>>")
    bare_names = F.array(*map(F.lit, _bare_names()))
    after = lambda part, n: F.substring(part, n, F.length(part))

    def named(part: Column, buckets: Column) -> Column:
        bare = F.get(F.filter(bare_names, lambda n: F.startswith(part, n)), F.lit(0))
        without_semicolon = let(bare, lambda n: F.when(n.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(_value(buckets, n), after(part, F.length(n) + 1))))
        known = lambda name: let(_value(buckets, name), lambda v: F.when(v.isNotNull(), F.concat(v, after(part, F.length(name) + 2))).otherwise(without_semicolon))
        return let(F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1), known)

    def one(part: Column, buckets: Column) -> Column:
        number, hexa = F.regexp_extract(part, r"^#([0-9]+)", 1), F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]+)", 1)
        rest = lambda pattern: F.regexp_replace(part, pattern, "")
        return (
            F.when(~F.startswith(part, F.lit("#")), named(part, buckets))
            .when(number != "", F.concat(let(_numbered(number, 10), _from_code), rest(r"^#[0-9]+;?")))
            .when(hexa != "", F.concat(let(_numbered(hexa, 16), _from_code), rest(r"^#[xX][0-9a-fA-F]+;?")))
            .otherwise(F.concat(F.lit("&"), part))
        )

    def read(t: Column) -> Column:
        return let(table, lambda buckets: let(F.split(t, "&"), lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), lambda part: one(part, buckets)), ""))))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), read(t)).otherwise(t))
