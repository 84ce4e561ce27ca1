"""Queries of the rules and transitions that need no table of their own: documents, pages, orders and turns play them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import feed, metrics, resolve, rules, search, state, workflow
from brindle.plans.catalog import query, table
from brindle.sources import bank
from brindle.streaming import feeds, keyed

_NEWS = """n AS (SELECT doc_id AS id, source, (DATE '2024-01-01' + (doc_id % 30)::INT)::DATE AS day, CASE WHEN doc_id % 4 <> 0 THEN 's' || (doc_id % 97) END AS story, doc_id % 12 AS position FROM documents)"""


def _news(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(k.alias("id"), "source", F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("day"), F.when(k % 4 != 0, F.concat(F.lit("s"), (k % 97).cast("string"))).alias("story"), (k % 12).alias("position"))


@query(
    f"""WITH {_NEWS}, c AS (SELECT *, abs(date_diff('day', DATE '2024-01-15', day)) <= 2 AS near FROM n), t AS (SELECT DISTINCT story FROM c WHERE near AND story IS NOT NULL)
    SELECT id, 'g' || (id % 50) AS plan FROM c WHERE near UNION ALL SELECT id, id::VARCHAR FROM c WHERE NOT near AND story IN (SELECT story FROM t)"""
)
def story_plan(spark, d):
    n = _news(spark, d).withColumn("id", F.col("id").cast("string"))
    groups = n.select("id", F.concat(F.lit("g"), (F.col("id").cast("long") % 50).cast("string")).alias("story"))
    return feed.plan_stories(n, groups, F.lit("2024-01-15").cast("date")).select(F.col("id").cast("long").alias("id"), "plan")


@query(f"WITH {_NEWS} SELECT 'p' || (id % 40) AS plan, min(day) AS first_seen, max(day) AS last_seen, bool_or(source = (SELECT min(source) FROM n)) AND bool_or(source = (SELECT max(source) FROM n)) AS is_big, count(*) AS items FROM n GROUP BY 1")
def planned_big_pairs(spark, d):
    """Big by a fixed pair of sources, the first and the last by name."""
    n = _news(spark, d)
    pair = n.agg(F.min("source"), F.max("source")).first()
    return feed.planned_stories(n, n.select("id", F.concat(F.lit("p"), (F.col("id") % 40).cast("string")).alias("plan")), tuple(pair))


@query(f"WITH {_NEWS} SELECT id FROM n WHERE story IN (SELECT story FROM n WHERE day >= DATE '2024-01-08' AND day < DATE '2024-01-10') OR (story IS NULL AND day >= DATE '2024-01-08' AND day < DATE '2024-01-10')")
def feed_membership(spark, d):
    return feed.feed_items(_news(spark, d), F.lit("2024-01-08").cast("date"), F.lit("2024-01-10").cast("date")).select("id")


@query(f"WITH {_NEWS} SELECT story, day, min(position) AS position FROM n WHERE story IS NOT NULL AND (story, day) IN (SELECT (story, max(day)) FROM n WHERE story IS NOT NULL GROUP BY story) GROUP BY 1, 2")
def feed_newest_position(spark, d):
    return feed.newest_positions(_news(spark, d))


@query(f"WITH {_NEWS} SELECT story, array_to_string(list(id ORDER BY day, position, id), ',') AS ids FROM n WHERE story IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, id::VARCHAR FROM n WHERE story IS NULL")
def story_item_lists(spark, d):
    return feed.story_lists(_news(spark, d), ["day", "position"], "id").select("story", F.array_join("values", ",").alias("ids"))


@query(f"WITH {_NEWS}, s AS (SELECT story, max(day) AS last_seen, count(*) AS item_count, count(DISTINCT source) > 1 AS is_big FROM n WHERE story IS NOT NULL GROUP BY 1) SELECT story, item_count FROM s WHERE is_big AND last_seen BETWEEN DATE '2024-01-19' AND DATE '2024-01-25' ORDER BY item_count DESC, last_seen DESC, story LIMIT 1")
def most_covered_story(spark, d):
    s = _news(spark, d).where("story is not null").groupBy("story").agg(F.max("day").alias("last_seen"), F.count("*").alias("item_count"), (F.countDistinct("source") > 1).alias("is_big"))
    return feed.most_covered(s, F.lit("2024-01-25").cast("date")).select("story", "item_count")


@query(f"WITH {_NEWS} SELECT id, story, row_number() OVER (PARTITION BY story ORDER BY id) - 1 AS position FROM n WHERE id % 5 <> 0")
def sponsors_dropped(spark, d):
    n = _news(spark, d).withColumn("sponsor", F.col("id") % 5 == 0)
    return feed.without_sponsors(n, "story", "id").select("id", "story", "position")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 IN (0, 1) AND doc_id % 2 = 0 THEN 'invoice' ELSE lang END AS label FROM documents")
def invoices_in_other_mail(spark, d):
    m = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    kind = F.element_at(F.array(*map(F.lit, ("to_pay", "already_paid", "reminder"))), (F.col("id") % 3 + 1).cast("int"))
    return feed.relabelled(m, m.where("id % 2 = 0").select("id", kind.alias("kind")))


_BILLS = """b AS (SELECT o_orderkey AS id, c_name AS payee, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS invoice_date, o_orderdate + INTERVAL 2 DAY AS sent_at, (o_orderdate + INTERVAL 14 DAY)::DATE AS due,
  CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN (o_orderdate + INTERVAL 14 DAY)::DATE < DATE '1997-01-01' THEN 'overdue' ELSE 'open' END AS status FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _bills(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    day = F.to_date("o_orderdate")
    shown = rules.display_status(F.when(F.col("o_orderstatus") == "F", "paid").otherwise("open"), F.date_add(day, 14), F.lit("1997-01-01").cast("date"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("payee"), F.when(F.col("o_orderkey") % 3 != 0, day).alias("invoice_date"), F.date_add(day, 2).cast("timestamp").alias("sent_at"), F.date_add(day, 14).alias("due"), shown.alias("status"))


@query(f"WITH {_BILLS} SELECT id FROM b WHERE status IN ('open', 'overdue') AND coalesce(invoice_date, sent_at::DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND contains(lower(payee), '0#7') IS NOT NULL AND contains(lower(payee), '17')")
def invoice_list_filter(spark, d):
    return feed.invoice_list(_bills(spark, d), F.col("status"), ["open", "overdue"], "1996-01-01", "1997-12-31", "17").select("id")


@query(f"WITH {_BILLS} SELECT id, status FROM b ORDER BY CASE WHEN status = 'overdue' THEN 0 ELSE 1 END, CASE WHEN status = 'overdue' THEN due END NULLS LAST, id LIMIT 200")
def invoices_overdue_first(spark, d):
    return _bills(spark, d).orderBy(*feed.overdue_first(F.col("status"), "due", "id")).limit(200).select("id", "status")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND d.doc_id % 2 = 0 WHERE CASE WHEN l.doc_id % 3 = 0 THEN NULL ELSE l.toxic END IS NULL")
def notes_without_verdict(spark, d):
    notes = table(spark, d, "documents").select(F.col("doc_id").alias("key"))
    items = table(spark, d, "labels").where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 3 != 0, F.col("toxic")).alias("security"))
    return feed.unjudged(notes, items).select(F.col("key").alias("doc_id"))


@query(
    r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(substr(text, 1, 200)), '[a-z]+')) AS keys FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_filter(keys, lambda k: k IN ('the', 'la', 'of') OR starts_with(k, 'in') OR starts_with(k, 'ent'))), ',') AS kept FROM w"""
)
def attributes_allowed(spark, d):
    """The words of a text's beginning as keys: some by name, some by how they begin."""
    keys = F.array_distinct(F.regexp_extract_all(F.lower(F.substring("text", 1, 200)), F.lit("[a-z]+"), F.lit(0)))
    attributes = F.map_from_arrays(keys, F.transform(keys, lambda k: F.length(k)))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.map_keys(feed.only_keys(attributes, ["the", "la", "of"], ["in", "ent"]))), ",").alias("kept"))


@query(
    """WITH x AS (SELECT o_custkey AS case_id, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 25), f AS (SELECT o_custkey AS case_id, o_orderkey FROM orders WHERE o_orderstatus = 'F')
    SELECT c.c_custkey AS case_id, CASE WHEN count(x.l_orderkey) > 0 THEN count(DISTINCT f.o_orderkey) / count(DISTINCT x.l_orderkey)::DOUBLE END AS distractor_rate
    FROM customer c LEFT JOIN x ON x.case_id = c.c_custkey LEFT JOIN f ON f.case_id = x.case_id AND f.o_orderkey = x.l_orderkey GROUP BY 1"""
)
def distractor_rates(spark, d):
    """Distractors: orders with large lines, one for each line; hits: all finished orders. Customers without any have no rate."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"), "o_orderstatus")
    large = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    lists = large.groupBy("case_id").agg(F.collect_list("o_orderkey").alias("distractors"))
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id")).join(lists, "case_id", "left").withColumn("distractors", F.coalesce("distractors", F.array().cast("array<long>")))
    return feed.distractor_rate(cases, orders.where("o_orderstatus = 'F'").select("case_id", F.col("o_orderkey").alias("parent_id")))


@query(
    """WITH s AS (SELECT doc_id % 10 AS wanted, doc_id % 8 AS given, doc_id % 5 AS found, doc_id % 3 AS exact, doc_id % 2 AS leaks, 0 AS drops, doc_id % 4 AS invented, CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 7) / 7.0::DOUBLE END AS o FROM documents)
    SELECT sum(wanted)::BIGINT AS wanted, sum(given)::BIGINT AS given, sum(found)::BIGINT AS found, sum(exact)::BIGINT AS exact, sum(leaks)::BIGINT AS leaks, sum(drops)::BIGINT AS drops, sum(invented)::BIGINT AS invented,
      round(sum(found) / sum(wanted)::DOUBLE, 9) AS recall, round(sum(found) / sum(given)::DOUBLE, 9) AS "precision", round(sum(exact) / sum(found)::DOUBLE, 9) AS url_exact, round(avg(o), 9) AS "order" FROM s"""
)
def extraction_pooled(spark, d):
    k = F.col("doc_id")
    parts = {"wanted": 10, "given": 8, "found": 5, "exact": 3, "leaks": 2, "invented": 4}
    s = table(spark, d, "documents").select(*[(k % n).alias(c) for c, n in parts.items()], F.lit(0).cast("long").alias("drops"), F.when(k % 6 != 0, (k % 7) / 7.0).alias("order"))
    found = feed.pooled(s)
    return found.select("wanted", "given", "found", "exact", "leaks", "drops", "invented", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "url_exact", "order")])


@query(
    """WITH p AS (SELECT page_id % 20 AS g, page_id AS e, (page_id * 7919) % 251 AS a FROM pages)
    SELECT x.g AS "group", round(sum((x.a < y.a)::INT) / count(*)::DOUBLE, 9) AS "order" FROM p x JOIN p y ON x.g = y.g AND x.e < y.e GROUP BY 1"""
)
def extraction_order(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 20).alias("group"), F.col("page_id").alias("expected_idx"), ((F.col("page_id") * 7919) % 251).alias("actual_idx"))
    return feed.order_kept(p).select("group", F.round("order", 9).alias("order"))


@query(
    """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN 1 - l_tax < 0.97 THEN 'recall' END, CASE WHEN 1 - l_discount / 3 < 0.98 THEN 'url_exact' END, CASE WHEN l_quantity < 10 THEN 'leaks' END, CASE WHEN l_quantity > 45 THEN 'invented' END) AS missed FROM lineitem"""
)
def extraction_pass_bar(spark, d):
    """Lines as editions: rates from tax and discount, counts from quantities."""
    bars = metrics.pass_bar(1 - F.col("l_tax"), 1 - F.col("l_discount") / 3, F.greatest(10 - F.ceil("l_quantity"), F.lit(0)), F.greatest(F.ceil("l_quantity") - 45, F.lit(0)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(bars, ",").alias("missed"))


@query(
    """WITH m AS (SELECT o_orderkey AS id, o_custkey AS sender, o_orderstatus AS title, o_orderdate::DATE AS day FROM orders),
    p AS (SELECT *, lead(id) OVER (PARTITION BY sender, title, date_trunc('month', day) ORDER BY day, id) AS second FROM m)
    SELECT id AS first, second, date_trunc('month', day)::DATE AS month, last_day(day) AS until FROM p WHERE second IS NOT NULL"""
)
def near_duplicate_cases(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sender"), F.col("o_orderstatus").alias("title"), F.to_date("o_orderdate").alias("day"))
    return feed.near_duplicate_cases(m)


@query("SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) IN (SELECT (conv_id, turn + 1) FROM conversations WHERE role = 'user')")
def turns_by_reference(spark, d):
    """Rows of a table by pairs of keys."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role")
    refs = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"))
    return t.join(refs, ["conv_id", "turn"], "left_semi").select("conv_id", "turn")


@query("SELECT doc_id, regexp_matches('news:' || md5(doc_id::VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN ':1' ELSE '' END, '^news:[0-9a-f]{32}$') AS by_item FROM documents")
def keys_by_shape(spark, d):
    key = F.concat(F.lit("news:"), F.md5(F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 3 == 0, ":1").otherwise(""))
    return table(spark, d, "documents").select("doc_id", key.rlike("^news:[0-9a-f]{32}$").alias("by_item"))


@query("SELECT count(*) AS n FROM events WHERE ts >= (SELECT min(ts) FROM events WHERE event_type = 'click') AND event_type <> 'click'")
def bounded_by_first(spark, d):
    """A scan that begins at the first row of another one."""
    e = table(spark, d, "events")
    first = e.where("event_type = 'click'").agg(F.min("ts")).first()[0]
    return e.where((F.col("ts") >= F.lit(first)) & (F.col("event_type") != "click")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = 'customer#000000007' OR lower(c_mktsegment) = 'building'")
def equals_any_case(spark, d):
    c = table(spark, d, "customer")
    return c.where(search.equals_any("Customer#000000007", F.col("c_name")) | search.equals_any("BUILDING", F.col("c_mktsegment"))).select("c_custkey", "c_name")


@query("SELECT doc_id, (lang <> 'en')::INT + (n_chars > 1500)::INT + (substr(text, 1, 1) BETWEEN 'A' AND 'M')::INT = 1 AS valid FROM documents")
def exactly_one_target(spark, d):
    """Targets from three columns: a foreign language, a long text, a text that begins in the alphabet's first half."""
    first = F.substring("text", 1, 1)
    targets = F.nullif("lang", F.lit("en")), F.when(F.col("n_chars") > 1500, F.col("n_chars")), F.when(first.between("A", "M"), first)
    return table(spark, d, "documents").select("doc_id", rules.exactly_one(*targets).alias("valid"))


@query(
    r"""WITH m AS (SELECT doc_id, lang, ' ' || upper(split_part(text, ' ', 1)) || '@' || source || '.Example ' AS address,
      [split_part(text, ' ', 2) || '.pdf', split_part(text, ' ', 3) || CASE lang WHEN 'de' THEN '_Rechnung' WHEN 'fr' THEN ' FACTURE 7' WHEN 'es' THEN 'fact' ELSE '' END || CASE WHEN n_chars % 2 = 0 THEN '.PDF' ELSE '.doc' END] AS files FROM documents),
    a AS (SELECT *, lower(trim(address)) AS known FROM m)
    SELECT doc_id, CASE WHEN known IN ('the@src1.example', 'of@src2.example') OR split_part(known, '@', -1) = 'src3.example' THEN 'ai_newsletter'
      WHEN len(list_filter(files, lambda f: lower(f) LIKE '%.pdf' AND regexp_matches(lower(f), 'rechnung|invoice|faktura|factura|facture|számla|szamla'))) > 0 THEN 'invoice' ELSE lang END AS label FROM a"""
)
def label_cascade(spark, d):
    """Senders from a text's first word and source, file names from the words after it, by language."""
    word = lambda n: F.split_part(F.col("text"), F.lit(" "), F.lit(n))
    address = F.concat(F.lit(" "), F.upper(word(1)), F.lit("@"), "source", F.lit(".Example "))
    ending = F.when(F.col("n_chars") % 2 == 0, ".PDF").otherwise(".doc")
    named = F.when(F.col("lang") == "de", "_Rechnung").when(F.col("lang") == "fr", " FACTURE 7").when(F.col("lang") == "es", "fact").otherwise("")
    files = F.array(F.concat(word(2), F.lit(".pdf")), F.concat(word(3), named, ending))
    known = {"the@src1.example": "a", "of@src2.example": "b", "src3.example": "c"}
    return table(spark, d, "documents").select("doc_id", rules.label(address, files, known, F.col("lang")).alias("label"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 1000 THEN 'too_large' END AS reason, CASE WHEN strlen(text) > 1000 THEN NULL ELSE strlen(text) END AS kept FROM documents")
def attachment_cap(spark, d):
    content, reason = rules.attachment_content(F.col("text").cast("binary"), 1000)
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"), F.octet_length(content).cast("long").alias("kept"))


@query("SELECT event_id, round_even(value::DECIMAL(20,6), 2)::DECIMAL(12,2) AS amount, CASE WHEN event_id % 3 <> 0 THEN upper(event_type) END AS code FROM events")
def invoice_field_clean(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", rules.clean_amount(F.col("value")).alias("amount"), F.upper(rules.clean_text(F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type")))).alias("code"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_totalprice > 150000 THEN 'paid' WHEN o_orderpriority LIKE '1%' THEN 'needs_info' ELSE 'open' END AS status FROM orders")
def paid_transitions(spark, d):
    """Paid by the owner: finished orders; matched: large ones; urgent ones have an issue."""
    issues = F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("missing_iban"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select("o_orderkey", workflow.paid(F.lit("paid"), issues, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000).alias("status"))


@query(
    """WITH a AS (SELECT event_id, event_type = 'click' AS done, user_id % 6 AS attempts, CASE WHEN value < 20 THEN 429 WHEN value < 40 THEN 500 + floor(value)::INT WHEN value < 50 THEN 403 WHEN value < 55 THEN NULL ELSE 200 END AS code, hour(ts) AS h FROM events)
    SELECT event_id, CASE WHEN done THEN 'sent' WHEN code = 200 THEN 'sent' WHEN (code IS NULL OR code = 429 OR code >= 500) AND attempts + 1 < 5 THEN 'pending' ELSE 'failed' END AS status,
      coalesce(code <> 200 AND code < 500, false) AS stops, h >= 22 OR h < 7 AS waits FROM a"""
)
def delivery_states(spark, d):
    """Answers of every kind from an event's value, attempts from its user, the hour from its time."""
    value = F.col("value")
    code = F.when(value < 20, 429).when(value < 40, 500 + F.floor(value).cast("int")).when(value < 50, 403).when(value < 55, F.lit(None)).otherwise(200)
    status = F.when(F.col("event_type") == "click", "sent").otherwise("pending")
    waits = feeds.quiet(F.hour(F.col("ts").cast("timestamp")))
    return table(spark, d, "events").select("event_id", rules.delivery(status, F.col("user_id") % 6, code).alias("status"), rules.stops_run(code).alias("stops"), waits.alias("waits"))


@query("SELECT page_id, nullif(trim(regexp_replace(trim(raw), '^<|>$', '', 'g')), '') AS message_id FROM (SELECT page_id, ' ' || repeat('<', (page_id % 3)::INT) || CASE WHEN length(url) % 5 = 0 THEN ' ' ELSE split_part(url, '/', 3) || '@' || length(html) END || repeat('>', (page_id % 4)::INT) || ' ' AS raw FROM pages)")
def message_ids(spark, d):
    """Identifiers made of hosts, some empty, in any number of brackets."""
    body = F.when(F.length("url") % 5 == 0, " ").otherwise(F.concat(F.split_part(F.col("url"), F.lit("/"), F.lit(3)), F.lit("@"), F.length("html").cast("string")))
    raw = F.concat(F.lit(" "), F.repeat(F.lit("<"), (F.col("page_id") % 3).cast("int")), body, F.repeat(F.lit(">"), (F.col("page_id") % 4).cast("int")), F.lit(" "))
    return table(spark, d, "pages").select("page_id", X.message_id(raw).alias("message_id"))


@query(
    """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)
    SELECT conv_id, turn, regexp_replace(text || ' [1, 2] end [3].', '\\s*\\[\\d+(?:,\\s*\\d+)*\\]', '', 'g') AS plain, replace(replace(replace(text || '<"&">', '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS escaped,
      CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS excerpt, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}]', ' ', 'g'), ' +', ' ', 'g')) AS title_key FROM t"""
)
def chat_text_functions(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_citation_markers(F.concat(text, F.lit(" [1, 2] end [3]."))).alias("plain"), X.xml_escape(F.concat(text, F.lit('<"&">'))).alias("escaped"), X.excerpt(text, 100).alias("excerpt"), X.title_key(text).alias("title_key"))


@query(
    r"""WITH t AS (SELECT doc_id, lang, text, CASE n_chars % 4 WHEN 0 THEN '$' || n_chars || '.50' WHEN 1 THEN '(' || n_chars || ')' WHEN 2 THEN n_chars || ' USD' ELSE n_chars || '.1.' END AS cell,
      list_filter(regexp_extract_all(substr(text, 1, 60), '[A-Z][a-z]+'), lambda w: length(w) > 5) AS heads, substr(text, 1, 50) || CASE WHEN n_chars % 3 = 0 THEN ' see iTem ' || n_chars % 20 || 'a. ' ELSE ' items 7' END AS body,
      translate(replace(substr(text, 3, 12), ' ', chr(10) || ' '), 'aeinrst', 'AEINRST') AS fact FROM documents)
    SELECT doc_id, regexp_matches(cell, '^\(?\$?[\d,]+(\.\d+)?\)?$') AS amount, coalesce(nullif(array_to_string(heads, ' > '), ''), nullif(regexp_extract(body, '\b(item\s+\d+[a-z]?\b\.?)', 1, 'i'), '')) AS section,
      CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS label, contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(fact, '\s+', ' ', 'g')))) AS fact FROM t"""
)
def table_text_functions(spark, d):
    """Cells, headings, bodies and facts cut from the texts."""
    n, text = F.col("n_chars"), F.col("text")
    number = n.cast("string")
    cell = F.when(n % 4 == 0, F.concat(F.lit("$"), number, F.lit(".50"))).when(n % 4 == 1, F.concat(F.lit("("), number, F.lit(")"))).when(n % 4 == 2, F.concat(number, F.lit(" USD"))).otherwise(F.concat(number, F.lit(".1.")))
    heads = F.filter(F.regexp_extract_all(F.substring(text, 1, 60), F.lit("[A-Z][a-z]+"), F.lit(0)), lambda w: F.length(w) > 5)
    body = F.concat(F.substring(text, 1, 50), F.when(n % 3 == 0, F.concat(F.lit(" see iTem "), (n % 20).cast("string"), F.lit("a. "))).otherwise(" items 7"))
    fact = F.translate(F.replace(F.substring(text, 3, 12), F.lit(" "), F.lit("\n ")), "aeinrst", "AEINRST")
    return table(spark, d, "documents").select("doc_id", X.is_amount(cell).alias("amount"), X.section_of(heads, body).alias("section"), X.known_or(F.concat(F.lit(" "), F.initcap("lang")), ("en", "de")).alias("label"), X.contains_fact(text, fact).alias("fact"))


@query(
    r"""WITH p AS (SELECT page_id, url, split_part(url, '/', 3) AS site FROM pages),
    l AS (SELECT page_id, site, CASE page_id % 6 WHEN 0 THEN ' ' || url || ' ' WHEN 1 THEN 'https://' || site || '/?UTM_Source=x&utm_b' WHEN 2 THEN 'https://' || site || '?q=1' WHEN 3 THEN 'https://GitHub.com/' || replace(site, '.', '-') || '/tool/' WHEN 4 THEN 'read ' || site ELSE url END AS raw FROM p),
    u AS (SELECT page_id, trim(raw) AS u, site FROM l),
    q AS (SELECT *, lower(regexp_extract(u, '^[A-Za-z]+://([^/?#@]*@)?([^/?#:]*)', 2)) AS host, regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1) AS netloc, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '\?([^#]*)', 1) AS query,
      'see ' || CASE page_id % 5 WHEN 0 THEN u WHEN 1 THEN regexp_extract(u, '^[A-Za-z]+://([^?#]*)', 1) WHEN 2 THEN replace(site, '.', '-') || '/tool' ELSE 'nothing' END || ' today' AS body FROM u),
    r AS (SELECT *, host IN ('example.com', 'example.net') OR host LIKE '%.example.com' OR host LIKE '%.example.net' AS own, regexp_matches(u, '^https?://[^/?#]', 'i') AS web,
      path IN ('', '/') AND len(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))) = 0 AS front, regexp_replace(netloc || path, '/+$', '') AS bare, regexp_replace(path, '^/+|/+$', '', 'g') AS repo FROM q)
    SELECT page_id, own, web AND NOT (front AND own) AS article, web AND NOT (front AND own) AND (contains(body, u) OR contains(body, bare) OR host IN ('github.com', 'www.github.com') AND regexp_matches(repo, '^[^/]+/[^/]+$') AND contains(body, repo)) AS supported FROM r"""
)
def news_link_rules(spark, d):
    """Addresses of pages, their front pages with and without other parameters, repositories and labels; texts that quote some."""
    url, k = F.col("url"), F.col("page_id")
    site = F.split_part(url, F.lit("/"), F.lit(3))
    own = ("example.com", "example.net")
    repo = F.replace(site, F.lit("."), F.lit("-"))
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit(" "), url, F.lit(" "))).when(k % 6 == 1, F.concat(F.lit("https://"), site, F.lit("/?UTM_Source=x&utm_b"))).when(k % 6 == 2, F.concat(F.lit("https://"), site, F.lit("?q=1")))
        .when(k % 6 == 3, F.concat(F.lit("https://GitHub.com/"), repo, F.lit("/tool/"))).when(k % 6 == 4, F.concat(F.lit("read "), site)).otherwise(url)
    )
    u = F.trim(raw)
    quoted = F.when(k % 5 == 0, u).when(k % 5 == 1, F.regexp_extract(u, "^[A-Za-z]+://([^?#]*)", 1)).when(k % 5 == 2, F.concat(repo, F.lit("/tool"))).otherwise("nothing")
    body = F.concat(F.lit("see "), quoted, F.lit(" today"))
    return table(spark, d, "pages").select("page_id", X.is_own_site(raw, own).alias("own"), X.is_article_link(raw, own).alias("article"), X.url_in_text(raw, body, own).alias("supported"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'amount unknown' WHEN 1 THEN '€' || o_totalprice::DECIMAL(14,2) ELSE o_totalprice::DECIMAL(14,2) || ' USD' END AS shown FROM orders")
def plain_amounts(spark, d):
    k = F.col("o_orderkey") % 3
    amount = F.when(k != 0, F.col("o_totalprice").cast("decimal(14,2)"))
    return table(spark, d, "orders").select("o_orderkey", X.format_plain_amount(amount, F.when(k == 1, "EUR").otherwise("USD")).alias("shown"))


@query(
    """WITH a AS (SELECT c_custkey, ['DE', 'GB', 'IE', 'FR', 'XX'][c_nationkey % 5 + 1] AS country, lpad(c_custkey::VARCHAR, 18, '0') AS account, c_acctbal < 0 AS broken FROM customer),
    n AS (SELECT *, array_to_string(list_transform(string_split(country, ''), lambda x: (ord(x) - 55)::VARCHAR), '') AS code FROM a),
    i AS (SELECT *, country || lpad((98 - (account || code || '00')::HUGEINT % 97)::VARCHAR, 2, '0') || CASE WHEN broken THEN '1' || substr(account, 2) ELSE account END AS iban FROM n)
    SELECT c_custkey, country IN ('DE', 'GB', 'IE') AND (substr(iban, 5) || code || substr(iban, 3, 2))::HUGEINT % 97 = 1 AS valid FROM i"""
)
def iban_countries(spark, d):
    """IBANs of 22 characters of five countries, in small letters and groups of four; a digit is wrong where the balance is below zero."""
    k = F.col("c_custkey")
    made = F.element_at(F.array(*[X.demo_iban(k, c) for c in ("DE", "GB", "IE", "FR", "XX")]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    iban = F.when(F.col("c_acctbal") < 0, F.concat(F.substring(made, 1, 4), F.lit("1"), F.substring(made, 6, 40))).otherwise(made)
    return table(spark, d, "customer").select("c_custkey", X.iban_valid(F.regexp_replace(F.lower(iban), "(.{4})", "$1 ")).alias("valid"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'h' || c_custkey ELSE 'old' || c_custkey END AS identification_hash FROM customer")
def accounts_rehashed(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("I"), F.col("c_custkey").cast("string")).alias("iban"), F.concat(F.lit("old"), F.col("c_custkey").cast("string")).alias("identification_hash"))
    fetched = c.where("id % 3 = 0").select("iban", F.concat(F.lit("h"), F.col("id").cast("string")).alias("identification_hash")).unionByName(c.where("id % 3 = 1").select("iban", "identification_hash"))
    return workflow.rehash_accounts(c, fetched).select("id", "identification_hash")


@query("SELECT invoice_id, count(*) FILTER (invoice_id % 2 = 1) AS left FROM (SELECT o_custkey AS invoice_id FROM orders) GROUP BY 1")
def match_reject(spark, d):
    """Every match of even invoices is rejected."""
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("invoice_id"), F.col("o_orderkey").alias("debit_id"), F.lit("linked").alias("status"))
    marked, _ = workflow.reject(m, m.where("invoice_id % 2 = 0").select("invoice_id", "debit_id"))
    return marked.groupBy("invoice_id").agg(F.count(F.when(F.col("status") == "linked", 1)).alias("left"))


@query(
    """WITH e AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM e GROUP BY 1)
    SELECT user_id, day FROM r WHERE (user_id, day) NOT IN (SELECT (user_id, day) FROM e)"""
)
def backfill_days(spark, d):
    """Days between a user's first and last purchase that have none."""
    return workflow.missing_days(table(spark, d, "events").where("event_type = 'purchase'").withColumn("day", F.to_date("ts")), "user_id", "day")


@query("SELECT o_orderkey, 'due ' || strftime(o_orderdate, '%-d %B %Y') || ' or ' || strftime(o_orderdate, '%d.%m.') || ' {other}' AS text FROM orders")
def date_templates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", workflow.fill_dates(F.lit("due {day} or {day:short} {other}"), {"day": F.to_date("o_orderdate")}).alias("text"))


@query("SELECT (SELECT max(ts) FROM events WHERE event_type = 'click') > (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AS cooling_down")
def job_cooldown(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("job"), F.col("ts").cast("timestamp").alias("started_at"))
    now = e.agg(F.max("started_at")).first()[0]
    return workflow.cooling_down(e, "click", F.lit(now))


@query("SELECT term FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM documents) WHERE term IN ('that', 'tion', 'zzz', 'thon') GROUP BY 1) ORDER BY df, term LIMIT 2")
def rare_keywords(spark, d):
    return workflow.keywords("That TION zzz thon", workflow.document_counts(table(spark, d, "documents")), 2)


@query("SELECT doc_id, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS e, (length(t) - length(replace(t, 'n', '')))::DOUBLE AS n, 26 AS dimensions FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def embeddings_in_batches(spark, d):
    """A small embedder, a function of a batch of texts: counts of letters."""
    e = workflow.embedded(table(spark, d, "documents"), "doc_id", "text", _letters, 26)
    return e.select("doc_id", F.col("embedding")[4].cast("double").alias("e"), F.col("embedding")[13].cast("double").alias("n"), F.size("embedding").alias("dimensions"))


def _letters(texts):
    import numpy as np

    raw = [np.frombuffer(t.encode("ascii", "ignore").lower(), np.uint8) for t in texts]
    return np.stack([np.bincount(r[(r > 96) & (r < 123)] - 97, minlength=26) for r in raw]).astype(float).tolist()


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def streaming_once_ever(spark, d):
    """Users as keys of a stream, each announced once."""
    source = table(spark, d, "events").select("user_id")
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select("user_id")
    keyed.with_store(spark)
    return _ran(spark, keyed.once(stream, "user_id"), source.schema, "append").agg(F.count("*").alias("n"))


@query("SELECT min(day) AS day, user_id FROM (SELECT user_id, ts::DATE AS day FROM events) GROUP BY user_id")
def streaming_first_starts(spark, d):
    """Starts of every user, of which one in a long time is let through: the first."""
    keyed.with_store(spark)
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    found = keyed.rate_limit_stream(stream, "user_id", "ts", 1, 1e12)
    rows = _ran(spark, found, "u long, t double, allowed boolean", "append").where("allowed")
    return rows.select(F.to_date(F.timestamp_seconds("t")).alias("day"), F.col("u").alias("user_id"))


def _ran(spark, stream, schema, mode):
    """What a stream writes until its input is used up."""
    folder = f"{resolve.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


@query("SELECT o_custkey AS account, count(*) FILTER (o_orderstatus <> 'P') AS booked, o_custkey % 11 = 0 AS failed FROM orders WHERE o_custkey % 11 <> 0 GROUP BY 1 UNION ALL SELECT DISTINCT o_custkey, 0, true FROM orders WHERE o_custkey % 11 = 0")
def bank_paged_scan(spark, d):
    """Every account's pages, followed to the last; an account whose bank fails doesn't stop the others."""
    pages = table(spark, d, "orders").select(F.col("o_custkey").alias("account"), "o_orderkey", "o_orderstatus")
    accounts = pages.groupBy("account").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("rows"))
    found = bank.paged(accounts, "account", "rows", _page)
    return found.groupBy("account").agg(F.count(F.when(F.get_json_object("json", "$.status") == "BOOK", 1)).alias("booked"), F.bool_or(F.col("error").isNotNull()).alias("failed"))


def _page(account, rows, key):
    """A bank with pages of two rows, that refuses every eleventh account."""
    import json

    if account % 11 == 0:
        raise ConnectionError("session expired")
    at = int(key or 0)
    entries = [json.dumps({"status": "PDNG" if r["o_orderstatus"] == "P" else "BOOK", "id": r["o_orderkey"]}) for r in rows[at : at + 2]]
    return entries, str(at + 2) if at + 2 < len(rows) else None


@query("SELECT doc_id, lang FROM documents WHERE source = (SELECT min(source) FROM documents) AND doc_id % 2 = 0 ORDER BY doc_id DESC LIMIT 25")
def remote_table_scan(spark, d):
    """select, eq, is, order and limit of a remote table, as filters that reach the scan."""
    t = table(spark, d, "documents")
    first = t.agg(F.min("source")).first()[0]
    return search.remote_scan(t, ["doc_id", "lang"], equal={"source": first}, where=[F.col("doc_id") % 2 == 0], order=[F.desc("doc_id")], limit=25)


@query("SELECT conv_id, count(*) FILTER (role = 'assistant') AS messages FROM conversations GROUP BY 1")
def embedded_counts(spark, d):
    t = table(spark, d, "conversations")
    return search.with_count(t.select("conv_id").distinct(), t.where("role = 'assistant'"), "conv_id", "messages")


@query("SELECT event_id, rn AS place FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS rn FROM events)")
def ranks_in_groups(spark, d):
    """Places in groups of any size; no group is sorted in one task."""
    return state.ranks(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", ["value", "event_id"], "place").select("event_id", "place")
