"""Queries of news stories, the day feed and notifications; items are documents, editions are days by id."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import matching, resolve, rules, state
from brindle.plans.catalog import query, table
from brindle.streaming import stories as kept_stories

_ITEMS = """items AS (SELECT doc_id AS id, source, (DATE '2024-01-01' + (doc_id % 30)::INT)::DATE AS day, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS block, substr(text, 1, 40) AS title, text AS blurb FROM documents)"""
_STORY = f"""{_ITEMS}, st AS (SELECT block AS story, min(day) AS first_seen, max(day) AS last_seen, list_sort(list_distinct(list(source))) AS sources, count(*) AS item_count, count(DISTINCT source) > 1 AS is_big FROM items GROUP BY 1)"""


def _items(spark, d):
    docs = table(spark, d, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    return docs.select(F.col("doc_id").alias("id"), "source", day.alias("day"), F.sha2(X.normalize_whitespace(F.col("text")), 256).alias("block"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("blurb"))


def _stories(spark, d):
    items = _items(spark, d)
    return resolve.stories(items, items.select("id", F.col("block").alias("story")))


@query(f"WITH {_STORY} SELECT story, first_seen, last_seen, array_to_string(sources, ',') AS sources, item_count, is_big FROM st ORDER BY is_big DESC, len(sources) DESC, item_count DESC, date_diff('day', first_seen, last_seen) DESC, last_seen DESC, story LIMIT 100")
def news_story_rank(spark, d):
    return resolve.story_rank(_stories(spark, d), 100).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH {_STORY} SELECT story, item_count FROM st WHERE is_big")
def news_big_only(spark, d):
    return _stories(spark, d).where("is_big").select("story", "item_count")


@query(
    f"""WITH RECURSIVE {_ITEMS}, e AS (SELECT l.id AS a, r.id AS b FROM items l JOIN items r ON l.block = r.block AND l.id < r.id AND l.source <> r.source AND abs(date_diff('day', l.day, r.day)) * 24 <= 48),
    g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), walk AS (SELECT id, id AS story FROM items UNION SELECT g.b AS id, walk.story FROM walk JOIN g ON walk.id = g.a)
    SELECT id, min(story) AS story FROM walk GROUP BY id"""
)
def story_cluster(spark, d):
    items = _items(spark, d)
    return resolve.components(items, resolve.story_edges(items))


_FEED = f"""{_ITEMS}, placed AS (SELECT block AS story, max(day) AS day, count(DISTINCT source) > 1 AS big, bool_or(id % 7 = 0) AS security, arg_max(title, (length(blurb), -id)) AS title,
  min(CASE WHEN id % 2 = 0 THEN id END) AS headline_id, string_agg(DISTINCT source, ',' ORDER BY source) AS links, min(id) AS first_id FROM items GROUP BY 1)"""


def _feed(spark, d):
    """One row per story, on its newest day: longest blurb's title, first headline, a link for each source."""
    return (
        _items(spark, d)
        .groupBy(F.col("block").alias("story"))
        .agg(
            F.max("day").alias("day"),
            (F.countDistinct("source") > 1).alias("big"),
            F.bool_or(F.col("id") % 7 == 0).alias("security"),
            F.max_by("title", F.struct(F.length("blurb"), -F.col("id"))).alias("title"),
            F.min(F.when(F.col("id") % 2 == 0, F.col("id"))).alias("headline_id"),
            F.array_join(F.array_sort(F.collect_set("source")), ",").alias("links"),
            F.min("id").alias("first_id"),
        )
    )


@query(
    f"""WITH {_FEED} SELECT day, story, big, security, title, headline_id, links, row_number() OVER (PARTITION BY day ORDER BY CASE WHEN big THEN 0 WHEN security THEN 1 ELSE 2 END, links, first_id) AS place
    FROM placed WHERE day >= DATE '2024-01-08' AND day < DATE '2024-01-15'"""
)
def news_day_feed(spark, d):
    group = F.when(F.col("big"), 0).when(F.col("security"), 1).otherwise(2)
    page = _feed(spark, d).where((F.col("day") >= F.lit("2024-01-08").cast("date")) & (F.col("day") < F.lit("2024-01-15").cast("date")))
    placed = state.ranks(page.withColumn("__group", group), "day", ["__group", "links", "first_id"], "place")
    return placed.withColumn("place", F.col("place") + 1).drop("first_id", "__group")


@query("SELECT CASE WHEN count(*) > 0 THEN DATE '2024-01-08' END AS next_before FROM (SELECT 1 FROM documents WHERE doc_id % 30 < 7 LIMIT 1)")
def feed_next_before(spark, d):
    older = _items(spark, d).where(F.col("day") < F.lit("2024-01-08").cast("date")).limit(1)
    return older.agg(F.when(F.count("*") > 0, F.lit("2024-01-08").cast("date")).alias("next_before"))


@query(
    f"""WITH {_STORY} SELECT story, CASE WHEN len(sources) > 1 THEN 'both newsletters' ELSE sources[1] END || ' · ' || item_count || CASE WHEN item_count = 1 THEN ' item' ELSE ' items' END || ' · '
    || strftime(first_seen, '%b %-d') || CASE WHEN first_seen = last_seen THEN '' WHEN strftime(first_seen, '%Y-%m') = strftime(last_seen, '%Y-%m') THEN '–' || strftime(last_seen, '%-d') ELSE '–' || strftime(last_seen, '%b %-d') END AS line FROM st"""
)
def coverage_lines(spark, d):
    return _stories(spark, d).select("story", X.coverage_line(F.col("sources"), F.col("item_count"), F.col("first_seen"), F.col("last_seen")).alias("line"))


@query(
    """WITH i AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'open' ELSE 'needs_info' END AS status, (o_orderdate + INTERVAL 14 DAY)::DATE AS due, o_orderkey % 3 = 0 AS told, o_orderkey % 12 = 0 AS told_due FROM orders)
    SELECT 'invoice_new:' || id AS key, 'invoice_new' AS kind, CASE WHEN status = 'paid' THEN 'skipped' ELSE 'pending' END AS status FROM i WHERE NOT told
    UNION ALL SELECT 'invoice_due:' || id, 'invoice_due', CASE WHEN told THEN 'pending' ELSE 'skipped' END FROM i WHERE status = 'open' AND due BETWEEN DATE '1997-06-01' AND DATE '1997-06-04' AND NOT told_due"""
)
def notification_plan(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "open").otherwise("needs_info")
    invoices = o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.date_add(F.to_date("o_orderdate"), 14).alias("due_date"))
    key = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("key")
    known = invoices.where("id % 3 = 0").select(key("invoice_new")).union(invoices.where("id % 12 = 0").select(key("invoice_due")))
    return rules.plan_notifications(invoices, known, F.lit("1997-06-01").cast("date"))


@query(
    f"""WITH {_ITEMS}, x AS (SELECT block AS story, count(DISTINCT source) OVER (PARTITION BY block) > 1 AS big, bool_or(id % 7 = 0) OVER (PARTITION BY block) AS alert, 'news:' || id AS key, id FROM items),
    w AS (SELECT *, id % 11 = 0 AS told, bool_or(id % 11 = 0) OVER (PARTITION BY story) AS announced, min(id) OVER (PARTITION BY story) AS first FROM x WHERE alert OR big)
    SELECT key, CASE WHEN alert THEN 'news_security' ELSE 'news_big' END AS kind, CASE WHEN id = first AND NOT announced THEN 'pending' ELSE 'skipped' END AS status FROM w WHERE NOT told"""
)
def story_announcements(spark, d):
    items = _items(spark, d)
    facts = items.groupBy(F.col("block").alias("story")).agg((F.countDistinct("source") > 1).alias("big"), F.when(F.bool_or(F.col("id") % 7 == 0), "new").alias("alert"))
    flat = items.select(F.col("block").alias("story"), F.concat(F.lit("news:"), F.col("id").cast("string")).alias("item_key"), F.col("id").alias("position")).join(facts, "story")
    return rules.announce_stories(flat, flat.where("position % 11 = 0").select(F.col("item_key").alias("key")))


@query(
    f"""WITH {_ITEMS}, p AS (SELECT DISTINCT block AS story FROM items WHERE id % 2 = 0 UNION SELECT 'orphan'), i AS (SELECT block AS story FROM items WHERE id % 4 <> 2), k AS (SELECT block AS story FROM items WHERE id % 5 = 0), r AS (SELECT block AS story FROM items WHERE id % 6 = 0)
    SELECT story FROM p WHERE (story IN (SELECT story FROM r) OR story NOT IN (SELECT story FROM i)) AND story NOT IN (SELECT story FROM k)"""
)
def stories_to_delete(spark, d):
    """Stories that were replaced or that no item names any more, but for those that a protected item names."""
    x = _items(spark, d).select("id", F.col("block").alias("story"))
    parents = x.where("id % 2 = 0").select("story").distinct().union(spark.range(1).select(F.lit("orphan")))
    return state.doomed(parents, x.where("id % 4 <> 2"), x.where("id % 5 = 0").select("story"), x.where("id % 6 = 0"), "story")


@query("SELECT text AS headline, min(doc_id) AS first_id FROM documents GROUP BY text ORDER BY first_id LIMIT 50")
def recent_unique_headlines(spark, d):
    return table(spark, d, "documents").groupBy(F.col("text").alias("headline")).agg(F.min("doc_id").alias("first_id")).orderBy("first_id").limit(50)


@query("SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'n' || doc_id WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS note FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 5")
def upsert_owned_columns(spark, d):
    """A table whose note column alone is written anew for even ids."""
    docs = table(spark, d, "documents")
    old = docs.select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("source")).alias("note"))
    new = docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("note"))
    return state.upsert_columns(old, new, ["doc_id"], ["note"])


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'create' WHEN doc_id % 4 = 1 THEN 'remote_only' WHEN doc_id % 4 = 2 THEN 'conflict' ELSE 'unchanged' END AS status FROM documents")
def dataset_sync(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    local = docs.where("id % 4 <> 1")
    remote = docs.where("id % 4 <> 0").withColumn("lang", F.when(F.col("id") % 4 == 2, "xx").otherwise(F.col("lang")))
    return state.sync_status(local, remote, "id", "lang", "source")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 5 = 0 OR doc_id % 2 = 0")
def upsert_latest_wins(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return state.latest_wins(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 5 = 0").withColumn("lang", F.lit("new")), ["doc_id"])


@query("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'new' ELSE role END AS role FROM conversations WHERE conv_id % 3 <> 0 OR turn < 2")
def replace_children(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return state.replace_children(turns, turns.where("conv_id % 3 = 0 AND turn < 2").withColumn("role", F.lit("new")), "conv_id")


#: Titles are the first 90 characters; near copies among the documents have other words there. The verdict: true from 0.6 on,
#: or on the same day; of the rest it isn't known.
_TITLED = r"""titled AS (SELECT doc_id AS id, source, (DATE '2024-01-01' + (doc_id % 30)::INT)::DATE AS day, list_sort(list_distinct(regexp_extract_all(lower(substr(text, 1, 90)), '[\p{L}\p{N}]+'))) AS words FROM documents),
  met AS (SELECT l.id AS a, r.id AS b, l.day = r.day AS same_day, len(list_intersect(l.words, r.words)) / (len(l.words) + len(r.words) - len(list_intersect(l.words, r.words))) AS similarity
    FROM titled l JOIN titled r ON l.id < r.id AND l.source <> r.source AND abs(date_diff('day', l.day, r.day)) <= 2 AND len(l.words) > 0 AND len(r.words) > 0),
  judged AS (SELECT a, b, similarity, CASE WHEN similarity >= 0.6 OR same_day THEN true END AS answer FROM met WHERE similarity >= 0.5)"""
_MATCHED = f"""WITH RECURSIVE {_TITLED}, g AS (SELECT a, b FROM judged WHERE answer UNION ALL SELECT b, a FROM judged WHERE answer),
  walk AS (SELECT id, id AS story FROM titled UNION SELECT g.b AS id, walk.story FROM walk JOIN g ON walk.id = g.a)
  SELECT id, min(story) AS story FROM walk GROUP BY id"""


def _titled(spark, d):
    return _items(spark, d).select("id", "source", "day", F.substring("blurb", 1, 90).alias("title"))


def _same_story(left, right, similarity):
    return F.when((similarity >= 0.6) | (left["day"] == right["day"]), True)


@query(_MATCHED)
def story_match(spark, d):
    """Stories of items whose titles are similar, not equal: set-similarity join, verdicts, components."""
    items = _titled(spark, d)
    return matching.matched_stories(items, matching.links(items, _same_story))


@query(
    f"""WITH {_TITLED}, node AS (SELECT words, source, day, min(id) AS node FROM titled GROUP BY ALL), n AS (SELECT id, node FROM titled JOIN node USING (words, source, day))
    SELECT least(x.node, y.node) AS a, greatest(x.node, y.node) AS b, any_value(similarity) AS similarity, any_value(answer) AS answer FROM judged JOIN n x ON x.id = a JOIN n y ON y.id = b GROUP BY 1, 2"""
)
def story_decisions(spark, d):
    """The verdict on every similar pair, unknown ones too; equal items of one day and source count once."""
    return matching.decisions(_titled(spark, d), _same_story)


@query(_MATCHED)
def stream_stories(spark, d):
    """The same stories, kept up over four batches of a stream."""
    folder = f"{resolve.shared_folder(spark)}/stories-{uuid.uuid4().hex}"
    _titled(spark, d).repartitionByRange(4, "id").write.parquet(f"{folder}/feed")
    feed = spark.readStream.schema("id long, source string, day date, title string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")
    kept_stories.keep_stories(feed, folder, _same_story).awaitTermination()
    return kept_stories.stories(spark, folder).select("id", "story")
