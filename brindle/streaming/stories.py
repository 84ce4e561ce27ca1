"""Stories kept up as items arrive: each micro-batch compares its items with those of the days around them, and joins the
stories that its new links connect.

The state is a folder of three logs, each with a folder per batch: `items` (what arrived), `labels` (an item's story when it
came) and `renames` (stories that a later batch joined to another: old, story). A batch reads the logs of earlier batches
only, and overwrites its own folders, so replaying a batch after a failure changes nothing. It reads the items of the days
around its own, their labels, and the renames of these; components are found over the stories that new links touch, not over
items. A renamed story's earlier names are renamed with it, so that the newest rename of a name is its story.

An item whose id has come before is ignored. Items: see brindle.operators.matching.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.matching import DAYS, THRESHOLD, links, nodes_of, words_of
from brindle.operators.resolve import components, dropped, saved

LOGS = {"items": "id long, source string, day date, title string, batch long", "labels": "id long, day date, story long, batch long", "renames": "old long, story long, batch long"}


def _log(spark: SparkSession, folder: str, name: str, before: int | None = None) -> DataFrame:
    """A log's rows of the batches before one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LOGS[name])
    rows = spark.read.schema(LOGS[name]).parquet(f"{folder}/{name}")
    return rows if before is None else rows.where(F.col("batch") < before)


def _write(rows: DataFrame, folder: str, name: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def _newest(renames: DataFrame) -> DataFrame:
    return renames.groupBy("old").agg(F.max_by("story", "batch").alias("story"))


def stories(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """id and story of all items."""
    named = _newest(_log(spark, folder, "renames", before)).withColumnRenamed("story", "now").withColumnRenamed("old", "story")
    return _log(spark, folder, "labels", before).join(named, "story", "left").select("id", "day", F.coalesce("now", "story").alias("story"))


def add_batch(batch: DataFrame, number: int, folder: str, same: Callable[[Column, Column, Column], Column] | None = None, threshold: float = THRESHOLD, days: int = DAYS) -> None:
    """Take in one micro-batch."""
    spark = batch.sparkSession
    known = _log(spark, folder, "items", number)
    new = saved(batch.select("id", "source", F.col("day").cast("date").alias("day"), "title").dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti"))
    span = new.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if span.a is None:  # nothing new, or nothing with a day
        for name in ("labels", "items"):
            _write(new.select(*[F.col(c) if c != "story" else F.col("id").alias("story") for c in LOGS[name].replace(",", "").split()[:-2:2]]), folder, name, number)
        return
    near = F.col("day").between(F.date_sub(F.lit(span.a), days), F.date_add(F.lit(span.b), days))  # dates of one row: reach the scan
    around = known.where(near).select("id", "source", "day", "title", F.lit(False).alias("fresh")).unionByName(new.withColumn("fresh", F.lit(True)))
    linked = links(around, same, threshold, days)
    label = saved(stories(spark, folder, number).where(near).select("id", "story").unionByName(new.select("id", F.col("id").alias("story"))))
    touched = _story_links(around, linked.select("a", "b"), label)
    ends = touched.select(F.col("a").alias("id")).union(touched.select("b")).distinct()
    joined = components(ends, touched)
    moved = saved(joined.where("id <> story").withColumnRenamed("id", "old"))
    # a name that came in this batch needs no rename: its item gets the story at once
    fresh = new.select("id", "day").join(moved.withColumnRenamed("old", "id"), "id", "left").select("id", "day", F.coalesce("story", "id").alias("story"))
    older = moved.join(new.select(F.col("id").alias("old")), "old", "left_anti")
    earlier = _newest(_log(spark, folder, "renames", number)).withColumnRenamed("story", "via").join(older.withColumnRenamed("old", "via"), "via").select("old", "story")
    _write(older.unionByName(earlier), folder, "renames", number)
    _write(fresh, folder, "labels", number)
    _write(new, folder, "items", number)
    dropped(new, linked, label, moved, touched)


def _story_links(items: DataFrame, links: DataFrame, label: DataFrame) -> DataFrame:
    """a, b: pairs of stories that the links of nodes connect, with the stories of all items of a linked node. Items of one
    set, day and source that came in different batches may have different stories until something links their node."""
    named = items.withColumn("words", words_of(F.col("title"))).join(nodes_of(items).select("words", "source", "day", "node"), ["words", "source", "day"]).select("id", "node")
    of_node = named.join(label, "id").select("node", "story").distinct()
    linked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    members = of_node.join(linked, "node")
    first = members.groupBy("node").agg(F.min("story").alias("first"))
    ends = links.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    inside = members.join(first, "node").select(F.col("first").alias("a"), F.col("story").alias("b"))
    return saved(ends.union(inside).where("a <> b").distinct())


def keep_stories(feed: DataFrame, folder: str, same: Callable[[Column, Column, Column], Column] | None = None, threshold: float = THRESHOLD, days: int = DAYS) -> StreamingQuery:
    """Start the stream over what is there; its checkpoint lies beside the logs."""

    def take(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, folder, same, threshold, days)

    return feed.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
