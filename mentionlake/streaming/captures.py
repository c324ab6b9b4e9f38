"""Captured pages as a stream with a resumable cursor.

Captures lie in files named by day and page, `2026-01-31_0007.html`, below one folder. The cursor is (day, page): the place behind the last page that was read. It is the offset of a Python data source, so the engine's checkpoint keeps it; a query that
stops and is started again goes on behind the last page that was committed, and each page is read once, in the order of day and page. Each batch takes `pages` files at most, a partition for each run of ``RUN`` files.

``state_of`` writes the cursor as rows of backfill_state, of which the last one counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from mentionlake.operators.persist import latest

START = {"day": "", "page": 0}
RUN, PAGES = 64, 1000
SCHEMA = "day string, page int, url string, html string"
STATE = "query string, start_date string, end_date string, current_date string, current_page int, status string, updated_at string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, whichever store it is in, and the path there."""
    return pafs.FileSystem.from_uri(path if urlparse(path).scheme else PurePosixPath(path).as_posix())


def place_of(name: str) -> tuple[str, int] | None:
    """(day, page) of a file's name; null for others."""
    stem, dot, ending = name.partition(".")
    day, _, page = stem.partition("_")
    return (day, int(page)) if ending == "html" and dot and len(day) == 10 and page.isdigit() else None


class Pages(InputPartition):
    def __init__(self, files: list[tuple[str, int, str]]):
        self.files = files


class CaptureReader(DataSourceStreamReader):
    """Offsets are places; an offset's page is the last one that it includes."""

    def __init__(self, options: dict):
        self.path, self.first, self.last = options["path"], options.get("start_date", ""), options.get("end_date", "9999-12-31")
        self.pages, self.at = int(options.get("pages", PAGES)), None

    def initialOffset(self) -> dict:  # noqa: N802
        return dict(START)

    def listed(self, after: dict, upto: dict | None = None) -> list[tuple[str, int, str]]:
        fs, root = opened(self.path)
        found = [(*place, f.path) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file and (place := place_of(f.base_name))]
        low, high = (after["day"], after["page"]), (upto["day"], upto["page"]) if upto else ("9999-12-31", 1 << 31)
        return sorted(x for x in found if low < x[:2] <= high and self.first <= x[0] <= self.last)

    def latestOffset(self) -> dict:  # noqa: N802
        """A bounded step behind what was handed out last; the same place if there is nothing new."""
        if self.at is None:
            self.at = self.initialOffset()
        ahead = self.listed(self.at)[: self.pages]
        if ahead:
            self.at = {"day": ahead[-1][0], "page": ahead[-1][1]}
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        if self.at is None or (self.at["day"], self.at["page"]) < (end["day"], end["page"]):
            self.at = dict(end)  # a restart hands out the checkpoint's step first
        files = self.listed(start, end)
        return [Pages(files[i : i + RUN]) for i in range(0, len(files), RUN)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fs, root = opened(self.path)
        for day, page, path in partition.files:
            with fs.open_input_stream(path) as f:
                head, _, html = f.read().decode("utf-8", "replace").partition("\n")
            yield day, page, head, html

    def commit(self, end: dict) -> None:
        """Nothing to free: captures stay."""


class Captures(DataSource):
    """Options: path, start_date, end_date (days, both included), pages (the most of a batch). A file's first line is its URL."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> CaptureReader:  # noqa: N802
        return CaptureReader(self.options)


def captured(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The stream (day, page, url, html) of a folder's captures."""
    spark.dataSource.register(Captures)
    return spark.readStream.format("captures").options(path=path, **options).load()


def follow(pages: DataFrame, out: str, checkpoint: str, query: str, start_date: str = "", end_date: str = "") -> StreamingQuery:
    """Stores the pages at out/pages and the cursor behind each batch at out/state; a batch that is run again writes the same folders again."""

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        rows.write.mode("overwrite").parquet(f"{out}/pages/batch={number}")
        state_of(rows, query, start_date, end_date, number).write.mode("overwrite").parquet(f"{out}/state/batch={number}")
        rows.unpersist()

    return pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_of(rows: DataFrame, query: str, start_date: str, end_date: str, number: int) -> DataFrame:
    """The row of backfill_state after a batch: the last day and page; none for an empty batch. Batches are numbered, and the number stands for the time."""
    last = rows.agg(F.max(F.struct("day", "page")).alias("l")).where("l is not null")
    return last.select(F.lit(query).alias("query"), F.lit(start_date).alias("start_date"), F.lit(end_date).alias("end_date"), F.col("l.day").alias("current_date"), F.col("l.page").alias("current_page"), F.lit("paused").alias("status"), F.lit(f"{number:012d}").alias("updated_at"))


def state(log: DataFrame, query: str, start_date: str, end_date: str) -> DataFrame:
    """The cursor of one query and window: a row, or none."""
    own = log.where((F.col("query") == query) & (F.col("start_date") == start_date) & (F.col("end_date") == end_date))
    return latest(own, ["query", "start_date", "end_date"], "updated_at")


def offset_text(day: str, page: int) -> str:
    """The offset as the engine's checkpoint has it."""
    return json.dumps({"day": day, "page": page})
