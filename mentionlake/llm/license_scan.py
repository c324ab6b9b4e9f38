"""License scans: hundreds of ordered signature rules, gated by keywords, with overlaps settled by priority and containment.

A text becomes its lower-cased words, joined by one space. One automaton of all rules' keywords reads it; only rules whose keyword occurs are tried, in the order of ``license_rules.rules``. A detection whose words
lie wholly inside an earlier rule's detection is suppressed; one that overlaps it in part stays. The base phrases are found apart and always stay. All of it happens where a row is: no shuffle.

Score: 1 - the product of (1 - confidence) over the labels that stay, each with its best detection; a base label has confidence 0.9. No label: 0.

Defined cases: a null text is an empty one; repeated rows have a result each; texts of any length are read whole; no texts give no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mentionlake.llm.common import table
from mentionlake.llm.license_rules import rules

#: Phrases of the base and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_CONFIDENCE = 0.9
#: Bytes to themselves if they belong to words (lower-cased), else to a space.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Detection:
    """Words first to last, both included, and the rule's place in the order."""

    first: int
    last: int
    rule: int
    label: str
    confidence: float


def normalised(text: str | None) -> str:
    """The words between single spaces, with a space before the first and after the last; one space if there are none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()
    return (b" " + b"".join(w + b" " for w in words)).decode("utf-8", "surrogatepass")


@cache
def compiled() -> tuple[list[tuple[str, re.Pattern, float]], ahocorasick.Automaton, dict[str, list[int]]]:
    """The rules with whole-word expressions, the automaton of keywords, and the rules of each keyword."""
    ordered = [(label, re.compile(f"(?<= )(?:{expression})(?= )"), confidence) for label, _, expression, confidence in rules()]
    gates: dict[str, list[int]] = {}
    for i, (_, keyword, _, _) in enumerate(rules()):
        gates.setdefault(keyword, []).append(i)
    automaton = ahocorasick.Automaton()
    for keyword in [*gates, *BASE]:
        automaton.add_word(f" {keyword}" if keyword not in BASE else f" {keyword} ", keyword)
    automaton.make_automaton()
    return ordered, automaton, gates


def places(text: str, phrase: str) -> list[int]:
    """Where the phrase's words stand, overlaps included: offsets of its first letter."""
    found, at = [], text.find(f" {phrase} ")
    while at >= 0:
        found.append(at + 1)
        at = text.find(f" {phrase} ", at + 1)
    return found


def suppressed(found: list[Detection]) -> list[Detection]:
    """What lies in no stretch of an earlier rule's detection that stays; of equal rules the longer wins. Kept stretches are held by their start with the furthest end so far."""
    starts: list[int] = []
    ends: list[int] = []  # the furthest end of stretches that start there or before
    kept = []
    for d in sorted(found, key=lambda d: (d.rule, d.first - d.last, d.first)):
        at = bisect_right(starts, d.first)
        if at and ends[at - 1] >= d.last:
            continue
        kept.append(d)
        starts.insert(at, d.first)
        ends.insert(at, d.last)
        while at < len(ends) and ends[at] <= d.last:
            ends[at] = d.last
            at += 1
    return kept


def detections(text: str, hits: set[str]) -> list[Detection]:
    """Those of the gated rules, before suppression. text: normalised."""
    ordered, _, gates = compiled()
    found: list[tuple] = []
    for i in sorted(i for keyword in hits if keyword in gates for i in gates[keyword]):
        label, expression, confidence = ordered[i]
        for m in expression.finditer(text):
            name = label.replace("{v}", m[1].replace(" ", ".")) if "{v}" in label else label
            found.append((m.start(), m.end(), i, name, confidence))
    if not found:
        return []
    marks = sorted({x for f in found for x in f[:2]})
    number, at, words = {}, 0, 0
    for mark in marks:
        words += text.count(" ", at, mark)
        number[mark], at = words - 1, mark  # spaces before a word's first letter, but the one at the start
    return [Detection(number[a], number[b], *rest) for a, b, *rest in found]


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    plain = normalised(text)
    n_words = plain.count(" ") - 1
    hits = {keyword for _, keyword in compiled()[1].iter(plain)}
    if not hits:
        return n_words, 0, None, None, "", "", 0.0
    base = {phrase: places(plain, phrase) for phrase in BASE if phrase in hits}
    starts = [at for found in base.values() for at in found]
    base_labels = {BASE[phrase] for phrase, found in base.items() if found}
    best = dict.fromkeys(base_labels, BASE_CONFIDENCE)
    for d in suppressed(detections(plain, hits)):
        best[d.label] = max(best.get(d.label, 0.0), d.confidence)
    doubt = 1.0
    for label in sorted(best):
        doubt *= 1 - best[label]
    word = lambda at: plain.count(" ", 0, at) - 1
    first, last = (word(min(starts)), word(max(starts))) if starts else (None, None)
    return n_words, len(starts), first, last, ",".join(sorted(base_labels)), ",".join(sorted(best)), 1 - doubt if best else 0.0


FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))
ROWS = 512


def _mapped(fields: list, of):
    """Runs of rows with what `of` gives for their texts, beside the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                columns = zip(*(of(text.as_py()) for text in part.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True))], names=[part.schema.names[0], *(name for name, _ in fields)])

    return run


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_mapped(FIELDS, scan), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def _spans(text: str | None) -> tuple[list[dict]]:
    plain = normalised(text)
    kept = suppressed(detections(plain, {keyword for _, keyword in compiled()[1].iter(plain)}))
    return ([{"first_word": d.first, "last_word": d.last, "label": d.label, "confidence": d.confidence} for d in sorted(kept, key=lambda d: (d.first, d.last, d.rule))],)


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the detections that stay, by place: words first_word to last_word, label, confidence."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<first_word: bigint, last_word: bigint, label: string, confidence: double>>"
    return docs.select("doc_id", "text").mapInArrow(_mapped([("spans", SPANS)], _spans), f"doc_id {kind}, spans {spans}")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every document names or quotes."""
    return licenses(table(spark, sf_dir, "documents"))
