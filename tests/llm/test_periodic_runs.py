"""Runs against a plain search of all lags."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from mentionlake.llm import periodic_runs as P


def brute_runs(words):
    """(start, length, period) of every stretch that no neighbour extends, with its smallest period."""
    seen, found = set(), []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q) and (i, length) not in seen:
                seen.add((i, length))
                found.append((i, length, q))
            i = max(j, i + 1) if j == i else j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, damaging=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if damaging and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(runs), s, length, q, 1000 * length // q if q else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def shapes():
    rng = random.Random(5)
    word = lambda k, n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n))
    yield from ["", "a", "a" * 11, "a" * 12, "a" * 500, "ab" * 6, "ab" * 400, fibonacci(900), "".join(chr(ord("0") + bin(i).count("1") % 2) for i in range(600))]
    for n in (31, 32, 33, 63, 64, 65, 100, 127, 128, 200):
        unit = word(26, n)
        yield word(26, 40) + unit * 2 + word(26, 9)
        yield unit * 3 + unit[: n // 2]
        yield unit + word(26, 3) + unit
    for n in (40, 90, 170):
        a, b = "a" * n, "ab" * (n // 2)
        yield from [a + "b" + a, a + "b" + a + "b" + a, b + b[1:], b + "c" + b + "c" + b, b[1:] + b[1:] + b[1:], (a + b) * 3, b + b[1:] + b + b[1:]]
        unit = "abcab" * (n // 5)
        yield from [unit + unit[2:], unit[1:] + unit[2:] + unit, (unit + "x" + unit) * 2, (unit + word(3, 5)) * 3]
    for k in (1, 2, 3):
        for _ in range(12):
            yield word(k, rng.randrange(20, 400))
    for _ in range(30):
        yield "".join(word(2, rng.randrange(1, 60)) * rng.randrange(1, 5) for _ in range(6))


@pytest.mark.parametrize("text", list(shapes()))
def test_runs(text):
    words = [w.encode() for w in text]
    (n, *_, listed, kept), = P.described([words])
    expected = brute(0, " ".join(text), False)
    assert (n, listed, kept) == (expected[1], *expected[-2:])


def test_texts_are_searched_apart():
    texts = [[w.encode() for w in t] for t in shapes()]
    assert P.described(texts) == [brute(0, " ".join(t), False)[1:] for t in shapes()]


def test_words_decide_where_hashes_lie(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") * rng.randrange(1, 3) for _ in range(n)) * m for n in (30, 50) for m in (1, 2, 3)]
    expected = [brute(0, " ".join(t), False)[1:] for t in texts]
    monkeypatch.setattr(P.Lags, "equal", lambda self, a, lag, length: (a + lag + length <= self.n) & (length % 1000 < 150))
    assert P.described([[w.encode() for w in t] for t in texts]) == expected


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if len(r.text or "") < 12_000]
    got = sorted(tuple(r) for r in P.op12_periodic_runs(spark, sf).collect())
    listed = {r.doc_id for r in rows}
    assert [r for r in got if r[0] in listed] == sorted(brute(*r) for r in rows)
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_nulls_empties_repeats_and_clashes(spark):
    rows = [(None, "a b " * 30), (None, None), (3, None), (3, ""), (3, " \n"), (4, "x " * 50), (4, "x " * 50), (5, "ÿ\u0085b " * 40)] + [(i, "one two three four five six seven eight nine ten " * 4) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 start", "2 n_runs")
    got = sorted((tuple(r) for r in P.detect(df, True).collect()), key=repr)
    assert got == sorted((brute(*r) for r in rows), key=repr)
    assert P.detect(df.limit(0)).count() == 0


def test_long_texts():
    """Periodic texts of a hundred thousand words take time near their length."""
    for text in (["a"] * 100_000 + ["b"] + ["a"] * 100_000, ["a", "b"] * 50_000 + ["c"] + ["a", "b"] * 50_000, [str(i % 30_011) for i in range(200_000)]):
        ids = np.unique(np.array(text), return_inverse=True)[1].astype(np.int64)
        runs = P.all_runs(np.append(ids, ids.max() + 1), [len(text)])
        assert 1 <= len(runs) <= 4 and (runs[:, 1] - runs[:, 0]).max() >= 100_000
