"""Stories that grow batch by batch on plain Parquet: three tables (stories, story_articles, story_targets) that change together.

Each batch writes its own folder in each table: the versions of the stories that it touched, and the edges that it adds. A mark of the batch, written last, makes all of them visible at once. A batch that was cut off
is written again over what it left; one that is marked already changes nothing. So each batch counts once, however often it is run. ``compact`` writes what is visible as one
new base; readers use the last base and the batches after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mentionlake.operators import stories as R
from mentionlake.sources.settle import settled

SCHEMAS = {"stories": f"{R.STATE}, created_at timestamp", "story_articles": f"{R.EDGES}, source_name string, at timestamp", "story_targets": "story_id long, target_key string"}
MARKS = "_marks"


class StoryStore:
    def __init__(self, spark: SparkSession, path: str, days: int = R.DAYS, threshold: float = R.THRESHOLD):
        self.spark, self.path, self.days, self.threshold = spark, path.rstrip("/"), days, threshold

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def marks(self) -> list[tuple[int, str]]:
        """(number, batch or base) of what is visible, in order; a base of a number comes after its batch."""
        fs, at = self._fs(f"{self.path}/{MARKS}")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted((int(n.split("-")[1]), n.split("-")[0]) for n in names if n[:1] == "b")

    def _mark(self, kind: str, number: int) -> None:
        fs, at = self._fs(f"{self.path}/{MARKS}/{kind}-{number}")
        fs.create(at, True).close()

    def _folders(self, table: str) -> list[str]:
        seen: list[str] = []
        for number, kind in sorted(self.marks(), key=lambda m: (m[0], m[1] == "base")):
            seen = [f"{self.path}/{table}/base-{number}"] if kind == "base" else [*seen, f"{self.path}/{table}/batch-{number}"]
        return seen

    def _rows(self, table: str) -> DataFrame:
        folders = self._folders(table)
        return self.spark.read.schema(SCHEMAS[table]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[table])

    def stories(self, since: object = None) -> DataFrame:
        """The last version of each story; with `since`, of those that were updated then or later. A story only grows, so its last version has the most articles, and the filter may come first."""
        rows = self._rows("stories")
        rows = rows if since is None else rows.where(F.col("updated_at") >= F.lit(since))
        last = rows.groupBy("id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "id")), "n_articles").alias("s"))
        return last.select("id", "s.*")

    def story_articles(self) -> DataFrame:
        return self._rows("story_articles")

    def story_targets(self) -> DataFrame:
        return self._rows("story_targets").distinct()

    def targets_of(self, story_id: int) -> DataFrame:
        """The targets of one story."""
        return self._rows("story_targets").where(F.col("story_id") == story_id).select("target_key").distinct()

    def apply(self, number: int, batch: DataFrame) -> None:
        """Assigns the articles (id, at, title, summary, source_name, target_keys) of a batch that have no story yet; of rows that repeat an id one counts, the first by time, title and summary."""
        if any(n == number and kind == "batch" or n >= number and kind == "base" for n, kind in self.marks()):
            return
        columns = ["at", "title", "summary", "source_name", "target_keys"]
        once = batch.groupBy(F.col("id").cast("long").alias("id")).agg(F.min(F.struct(F.col("at").cast("timestamp").alias("at"), *columns[1:])).alias("a")).select("id", "a.*")
        new = settled(once.join(self.story_articles().select(F.col("article_id").alias("id")), "id", "left_anti"))
        first = new.agg(F.min("at") - F.expr(f"interval {self.days} days")).first()[0]
        state = settled(self.stories(first)) if first is not None else self.stories()
        edges = settled(R.assign(new, state, self.days, self.threshold))
        grown = R.stories_after(new, edges, state).select(*(c.split()[0] for c in SCHEMAS["stories"].split(", ")))
        linked = edges.join(new.select(F.col("id").alias("article_id"), "source_name", "at", "target_keys"), "article_id")
        tables = {"stories": grown, "story_articles": linked.select("article_id", "story_id", "score", "source_name", "at"), "story_targets": linked.select("story_id", F.explode("target_keys").alias("target_key")).distinct()}
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch-{number}")
        self._mark("batch", number)

    def compact(self) -> None:
        """What is visible as one base of the last batch's number. Folders before it stay for readers that have begun."""
        marks = self.marks()
        if not marks or marks[-1] == (marks[-1][0], "base") or (marks[-1][0], "base") in marks:
            return
        number = marks[-1][0]
        for name, rows in (("stories", self.stories()), ("story_articles", self.story_articles()), ("story_targets", self.story_targets())):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/base-{number}")
        self._mark("base", number)

    def follow(self, articles: DataFrame, checkpoint: str) -> StreamingQuery:
        """A stream of articles into the store, until what is there is read. A batch that the engine runs again has the same number."""
        return articles.writeStream.foreachBatch(lambda batch, number: self.apply(number, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
