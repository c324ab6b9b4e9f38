import hashlib
import time

import brute

from mentionlake.llm import line_dedup

ROWS = [
    (1, "All rights reserved.\nx\n\na b c d e"),
    (2, "All  rights reserved. \nAll rights\nx\n\n \na b c d f"),
    (3, "x\nAll rights reserved!\na b c d\nx\nnew line of five words"),
    (4, None),
    (None, "a b c d\nnew line of five words more"),
]


def test_equal_short_lines_go(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {tuple(r) for r in line_dedup.repeated_lines(df).collect()}
    assert got == brute.lines_gone(ROWS)
    assert (2, 0) in got and (2, 1) not in got and (None, 0) in got


def test_query_removes_what_the_plain_version_does(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs]
    gone = brute.lines_gone(rows)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in line_dedup.op10_line_dedup(spark, sf).collect()}
    for d, t in rows:
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone)
        assert got[d] == (sum(g[0] == d for g in gone), hashlib.sha256(kept.encode()).hexdigest())


def test_very_long_lines_and_many_lines(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, long), (2, long.replace("w50000 ", "other ")), (3, long.replace("w99999", "w99999 more")), (4, long.replace("w7 ", "a b ")), (5, "\n".join(f"line number {i} of one text" for i in range(20_000))), (6, "\n".join(f"line number {i} of one text" for i in range(20_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 1), 4: (1, 0), 5: (20_000, 19_999), 6: (20_000, 20_000)}
    assert time.time() - began < 120


def test_columns_that_clash(spark):
    names = ["d", "h1", "place", "gone_lines", "key", "p", "bit", "bucket", "listed", "words", "first", "all"]
    df = spark.createDataFrame([(k, "a b c d e\nx", *names) for k in (1, 2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed", "kept"]
    assert {(r.doc_id, r.kept, r.place) for r in got.collect()} == {(1, "a b c d e\nx", "place"), (2, "", "place")}
