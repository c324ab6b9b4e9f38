from mentionlake.streaming import incremental

SCHEMA = "url string, n int"


def test_store_once_over_restarts(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: incremental.store_once(spark.readStream.schema(SCHEMA).parquet(source), out, check, "n").awaitTermination()
    put([("http://a/1", 1), ("http://A/1/", 0), ("http://a/2", 2)])
    run()
    put([("http://a/1", 5), ("http://a/3", 6)])
    run()
    got = sorted((r.url, r.n) for r in spark.read.parquet(out).collect())
    assert got == [("http://a/1", 0), ("http://a/2", 2), ("http://a/3", 6)]


def test_windowed_counts(spark, sf):
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/event*.parquet")
    counted = incremental.windowed_counts(events.selectExpr("cast(ts as timestamp) as ts", "event_type"), "ts", "event_type", "1 day")
    query = counted.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_captures_resume(spark, tmp_path):
    """A query that is stopped and started again reads each captured page once, in order, in bounded batches."""
    from mentionlake.streaming import captures

    folder = tmp_path / "captures"
    put = lambda day, page: (folder / day[:7]).mkdir(parents=True, exist_ok=True) or (folder / day[:7] / f"{day}_{page:04d}.html").write_text(f"https://a/{day}/{page}\n<p>{page}</p>\nend")
    for day, page in (("2026-01-01", 1), ("2026-01-01", 2), ("2026-01-02", 1), ("2026-01-03", 1), ("2025-12-31", 9)):
        put(day, page)
    (folder / "notes.txt").write_text("x")
    out = str(tmp_path / "out")

    def run():
        captures.follow(captures.captured(spark, str(folder), start_date="2026-01-01", end_date="2026-01-31", pages="2"), out, str(tmp_path / "check"), "q", "2026-01-01", "2026-01-31").awaitTermination()
        return sorted((r.day, r.page) for r in spark.read.parquet(f"{out}/pages").collect())

    first = run()
    assert first == [("2026-01-01", 1), ("2026-01-01", 2), ("2026-01-02", 1), ("2026-01-03", 1)] or first == [("2026-01-01", 1), ("2026-01-01", 2)]
    put("2026-01-03", 2)
    put("2026-02-01", 1)
    for _ in range(3):
        last = run()
    assert last == [("2026-01-01", 1), ("2026-01-01", 2), ("2026-01-02", 1), ("2026-01-03", 1), ("2026-01-03", 2)]
    log = spark.read.parquet(f"{out}/state")
    row = captures.state(log, "q", "2026-01-01", "2026-01-31").first()
    assert (row.current_date, row.current_page) == ("2026-01-03", 2) and captures.state(log, "q", "", "").count() == 0
    assert {r.html for r in spark.read.parquet(f"{out}/pages").collect()} == {"<p>1</p>\nend", "<p>2</p>\nend"}
