"""The license scan against every rule tried at every text, and the base against a plain search of words."""

import random
import re
from re import _constants as K
from re import _parser

import pytest

from mentionlake.llm import license_scan as L
from mentionlake.llm.license_rules import rules

LICENSE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""
GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2 or (at your option) any later version."


def example(tree, rng):
    """A string that an expression's tree matches."""
    out = ""
    for op, arg in tree:
        if op is K.LITERAL:
            out += chr(arg)
        elif op is K.IN:
            kind, value = rng.choice(arg)
            out += {K.LITERAL: lambda v: chr(v), K.RANGE: lambda v: chr(rng.randint(*v)), K.CATEGORY: lambda v: str(rng.randrange(10))}[kind](value)
        elif op is K.ANY:
            out += "x"
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            out += "".join(example(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], 4))))
        elif op is K.SUBPATTERN:
            out += example(arg[-1], rng)
        elif op is K.BRANCH:
            out += example(rng.choice(arg[1]), rng)
        else:
            raise ValueError(op)
    return out


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    base = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(p := phrase.split())] == p]
    line = f" {' '.join(words)} "
    found = []
    for rule, (label, _, expression, confidence) in enumerate(rules()):
        for m in re.finditer(f"(?<= )(?:{expression})(?= )", line):
            first = len(line[: m.start()].split())
            found.append((rule, -len(m[0].split()), first, first + len(m[0].split()) - 1, label.replace("{v}", (m.groups() or [""])[0].replace(" ", ".")) if "{v}" in label else label, confidence))
    kept = []
    for d in sorted(found):
        if not any(k[2] <= d[2] and d[3] <= k[3] for k in kept):
            kept.append(d)
    best = {label: L.BASE_CONFIDENCE for _, label in base}
    for d in kept:
        best[d[4]] = max(best.get(d[4], 0), d[5])
    rest = 1.0
    for label in sorted(best):
        rest *= 1 - best[label]
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(best)), 1 - rest if best else 0.0


def test_rules():
    """Hundreds; each expression holds its keyword at the start of a word, matches what it describes, and that is found."""
    rng = random.Random(3)
    assert len(rules()) >= 450
    for label, keyword, expression, _ in rules():
        for _ in range(6):
            text = example(_parser.parse(expression), rng)
            assert re.fullmatch(expression, text) and f" {keyword}" in f" {text}", (label, keyword, text)
            assert L.normalised(text) == f" {text} " and L.scan(text)[5], text


def mixes():
    rng = random.Random(4)
    pieces = [example(_parser.parse(e), rng) for _, _, e, _ in rules()] + [*L.BASE, "gnu", "cc", "by", "license", "mit", "or later", "2 0", "é", "Ünïcode", "\x85", "under the terms of the"]
    for _ in range(150):
        words = " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))).split()
        yield "".join(w.upper() + "-" if rng.random() < 0.2 else w + rng.choice([" ", "\n", ", "]) for w in words)


def test_mixed_texts():
    for text in mixes():
        assert L.scan(text) == brute(text), text


def test_known_texts():
    assert L.scan(LICENSE)[1:6] == (1, 3, 3, "apache", "apache,apache-2.0")
    assert L.scan(GPL)[5] == "gpl,gpl-2-or-later"
    assert L.scan("SPDX-License-Identifier: GPL-2.0-only\nCC BY-SA 4.0, CC-BY 4.0; MIT License")[5] == "cc-by,cc-by-4.0,cc-by-sa-4.0,gpl-2-0,mit"
    assert L.scan("cc by cc by")[1:4] == (2, 0, 2)
    assert L.scan("Nothing to see, abcc by xmit license here.")[1:] == (0, None, None, "", "", 0.0)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in L.op13_license_scan(spark, sf).collect()) == sorted((r.doc_id, *brute(r.text)) for r in rows)


def test_nulls_empties_repeats_clashes_and_spans(spark):
    rows = [(None, "MIT License"), (None, None), (1, ""), (1, None), (2, LICENSE), (2, LICENSE), (3, "mit license " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 labels", "2 n_words", "3 score")
    got = sorted((tuple(r) for r in L.licenses(df).collect()), key=repr)
    assert got == sorted([(i, *(L.scan(t))) for i, t in rows], key=repr)
    assert L.licenses(df.limit(0)).count() == 0 and L.scan(rows[-1][1])[:4] == (40_000, 20_000, 0, 39_998)
    spans = L.license_spans(df).where("doc_id = 2").first().spans
    assert [(s.first_word, s.last_word, s.label) for s in spans] == [(0, 4, "apache"), (3, 7, "apache-2.0"), (10, 30, "apache")]
    assert all(a.first_word <= b.first_word for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 30])
def test_suppression(n):
    rng = random.Random(n)
    for _ in range(60):
        found = [L.Detection(a := rng.randrange(40), a + rng.randrange(9), rng.randrange(12), "x", 1.0) for _ in range(n)]
        kept = []
        for d in sorted(found, key=lambda d: (d.rule, d.first - d.last, d.first)):
            if not any(k.first <= d.first and d.last <= k.last for k in kept):
                kept.append(d)
        assert L.suppressed(found) == kept
