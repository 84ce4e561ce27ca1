"""Queries of windows, rate limits and streaming twins over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.operators.resolve import shared_folder
from brindle.plans.catalog import query, table
from brindle.sources import mail as sources
from brindle.streaming import feeds, keyed


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return feeds.tumbling(_events(spark, d), "ts", "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def events_sliding(spark, d):
    return feeds.sliding(_events(spark, d), "ts", "2 hours", "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_session(spark, d):
    return feeds.sessions(_events(spark, d), "ts", "1 hour", "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))


#: Starts of five groups of users, one after the other: five an hour, counted by a list of the last ones.
_STARTS = """WITH RECURSIVE e AS (SELECT user_id % 5 AS u, ts, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts) AS n FROM events),
  r AS (SELECT u, n, ts, true AS allowed, [ts] AS kept FROM e WHERE n = 1
    UNION ALL SELECT e.u, e.n, e.ts, len(list_filter(r.kept, lambda x: x > e.ts - INTERVAL 1 HOUR)) < 5,
      CASE WHEN len(list_filter(r.kept, lambda x: x > e.ts - INTERVAL 1 HOUR)) < 5 THEN list_append(list_filter(r.kept, lambda x: x > e.ts - INTERVAL 1 HOUR), e.ts) ELSE list_filter(r.kept, lambda x: x > e.ts - INTERVAL 1 HOUR) END
    FROM r JOIN e ON e.u = r.u AND e.n = r.n + 1)
  SELECT u, epoch_us(ts) AS at, allowed FROM r"""


@query(_STARTS)
def rate_limit_sliding_hour(spark, d):
    found = feeds.rate_limited(_events(spark, d).withColumn("u", F.col("user_id") % 5), "u", "ts")
    return found.select("u", F.round(F.col("ts") * 1e6).cast("long").alias("at"), "allowed")


@query(_STARTS)
def rate_limit_stream(spark, d):
    """The same starts as a stream in order of time, in three batches: the state is a list that a timer ends."""
    folder = f"{shared_folder(spark)}/starts-{uuid.uuid4().hex}"
    starts = _events(spark, d).withColumn("u", F.col("user_id") % 5).select("u", "ts")
    for first, last in ((0, 10), (11, 20), (21, 31)):  # files in the order of time
        starts.where(F.dayofmonth("ts").between(first, last)).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    keyed.with_store(spark)
    feed = spark.readStream.schema("u long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")
    run = keyed.rate_limit_stream(feed, "u", "ts").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("u long, t double, allowed boolean").parquet(f"{folder}/rows").select("u", F.round(F.col("t") * 1e6).cast("long").alias("at"), "allowed")


@query(
    """WITH t AS (SELECT event_id AS id, least(1 + event_id % 7, 5) AS last, 1 + event_id % 7 <= 5 AS ok FROM events WHERE event_type = 'click')
    SELECT id, CASE WHEN ok THEN 'sent' ELSE 'failed' END AS status, last AS attempts FROM t"""
)
def stream_deliveries(spark, d):
    """Every message answers 200 at its nth attempt, 503 before: it is tried in six batches, across a restart."""
    folder = f"{shared_folder(spark)}/sent-{uuid.uuid4().hex}"
    keyed.with_store(spark)
    messages = _events(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("id"), F.concat(F.lit("at "), (F.col("event_id") % 7).cast("string")).alias("text"))
    files = min(64, messages.rdd.getNumPartitions())
    for _ in range(2):
        for _ in range(3):
            messages.coalesce(files).write.mode("append").parquet(f"{folder}/ticks")
        feed = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", files).parquet(f"{folder}/ticks")
        out = keyed.deliveries(feed, lambda text, tried: 200 if tried >= int(text[3:]) else 503)
        out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id long, status string, attempts int").parquet(f"{folder}/rows").groupBy("id").agg(F.max_by("status", "attempts").alias("status"), F.max("attempts").alias("attempts"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT event_id FROM events)")
def streaming_dedup(spark, d):
    """The table read as a stream, each row twice, deduplicated within the watermark, counted."""
    source = table(spark, d, "events")
    feed = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = feed.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    folder = f"{shared_folder(spark)}/dedup-{uuid.uuid4().hex}"
    run = feeds.deduplicated(twice, "ts", ["event_id"]).select("event_id").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("event_id long").parquet(f"{folder}/rows").agg(F.count("*").alias("n"))



@query(
    """WITH m AS (SELECT 'box' || conv_id % 3 AS folder, conv_id * 1000 + turn + 1 AS uid, conv_id, coalesce(text, '') AS text FROM conversations), cut AS (SELECT max(conv_id) // 2 AS c FROM m),
    read AS (SELECT folder, 7 AS uidvalidity, uid, text FROM m, cut WHERE conv_id <= c UNION ALL SELECT folder, CASE WHEN folder = 'box1' THEN 8 ELSE 7 END, uid, text FROM m, cut WHERE conv_id > c OR folder = 'box1')
    SELECT folder, uidvalidity::BIGINT AS uidvalidity, count(*) AS n, count(DISTINCT uid) AS uids, sum(strlen(text))::BIGINT AS bytes FROM read GROUP BY 1, 2"""
)
def stream_mailbox(spark, d):
    """Half of the mail is there at first; the stream is started twice more, when all is there and box1 has a new uidvalidity.
    Each message comes once, those of box1 anew."""
    folder = f"{shared_folder(spark)}/mailbox-{uuid.uuid4().hex}"
    turns = table(spark, d, "conversations")
    mail = turns.select(F.concat(F.lit("box"), (F.col("conv_id") % 3).cast("string")).alias("folder"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("uid"), F.lit("2024-01-01").cast("date").alias("day"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), "conv_id")
    half = F.col("conv_id") <= F.lit(turns.agg(F.floor(F.max("conv_id") / 2)).first()[0])
    seven, eight = mail.withColumn("uidvalidity", F.lit(7).cast("long")), mail.where("folder = 'box1'").withColumn("uidvalidity", F.lit(8).cast("long"))
    sources.register(spark)
    for arrived in (seven.where(half), seven.where(~half & (F.col("folder") != "box1")).unionByName(eight), None):
        if arrived is not None:
            arrived.drop("conv_id").write.mode("append").parquet(f"{folder}/mail")
        feed = spark.readStream.format("mailbox").options(client="brindle.sources.mail:ParquetMailbox", path=f"{folder}/mail", folders="box0,box1,box2", first_days="0", span="20000").load()
        feed.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema("folder string, uidvalidity long, uid long, content binary").parquet(f"{folder}/rows")
    return read.groupBy("folder", "uidvalidity").agg(F.count("*").alias("n"), F.countDistinct("uid").alias("uids"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@query(
    """WITH m AS (SELECT conv_id % 3 AS box, conv_id * 1000 + turn + 1 AS uid FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY box ORDER BY uid DESC) AS n FROM m)
    SELECT 'box' || box AS folder, uid FROM r WHERE n <= 25"""
)
def mailbox_scan(spark, d):
    """The newest 25 messages of each folder, by the batch reader."""
    folder = f"{shared_folder(spark)}/mailbox-{uuid.uuid4().hex}"
    mail = table(spark, d, "conversations").select(F.concat(F.lit("box"), (F.col("conv_id") % 3).cast("string")).alias("folder"), F.lit(7).cast("long").alias("uidvalidity"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("uid"), F.lit("2024-01-01").cast("date").alias("day"), F.col("text").cast("binary").alias("content"))
    mail.write.parquet(f"{folder}/mail")
    sources.register(spark)
    read = spark.read.format("mailbox").options(client="brindle.sources.mail:ParquetMailbox", path=f"{folder}/mail", folders="box0,box1,box2", since="2023-12-31", limit="25").load()
    return read.select("folder", "uid")
