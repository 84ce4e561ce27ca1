"""Queries of the workflow operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import workflow
from brindle.plans.catalog import query, table


@query(
    """WITH m AS (SELECT o_custkey AS invoice_id, o_orderkey AS debit_id, CASE WHEN o_orderkey % 7 = 0 THEN 'rejected' ELSE 'suggested' END AS status FROM orders), c AS (SELECT o_custkey AS invoice_id, min(o_orderkey) AS debit_id FROM orders GROUP BY 1),
    ok AS (SELECT * FROM c WHERE debit_id % 7 <> 0)
    SELECT m.invoice_id, m.debit_id, CASE WHEN ok.debit_id IS NOT NULL THEN 'linked' ELSE status END AS status, c.debit_id IS NOT NULL AND ok.debit_id IS NULL AS refused
    FROM m LEFT JOIN ok USING (invoice_id, debit_id) LEFT JOIN c USING (invoice_id, debit_id) WHERE NOT (status = 'suggested' AND ok.debit_id IS NULL AND m.invoice_id IN (SELECT invoice_id FROM ok))"""
)
def match_confirm(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("invoice_id"), F.col("o_orderkey").alias("debit_id"))
    matches = o.withColumn("status", F.when(F.col("debit_id") % 7 == 0, "rejected").otherwise("suggested"))
    return workflow.confirm(matches, o.groupBy("invoice_id").agg(F.min("debit_id").alias("debit_id")))


@query(
    """SELECT o_custkey AS invoice_id, CASE WHEN o_custkey % 3 = 0 THEN 'not_open' WHEN bool_or(o_orderstatus = 'F') THEN 'already_approved' ELSE 'created' END AS outcome FROM orders GROUP BY o_custkey"""
)
def draft_payments(spark, d):
    o = table(spark, d, "orders")
    invoices = o.select(F.col("o_custkey").alias("id")).distinct().withColumn("status", F.when(F.col("id") % 3 == 0, "paid").otherwise("open"))
    drafts = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("invoice_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft").alias("status"))
    return workflow.draft_payments(invoices, drafts)[0]


@query(
    """SELECT page_id AS email_id, 0 AS position, CASE WHEN page_id % 4 = 0 THEN 'old' ELSE 'new' END AS payee, 'new' AS amount FROM pages WHERE page_id % 5 <> 0
    UNION ALL SELECT page_id, 0, 'old', 'old' FROM pages WHERE page_id % 5 = 0 AND page_id % 4 = 0"""
)
def extraction_merge(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("email_id"), F.lit(0).alias("position"))
    edited = F.when(F.col("email_id") % 4 == 0, F.array(F.lit("payee"))).otherwise(F.array().cast("array<string>"))
    stored = p.withColumns({"payee": F.lit("old"), "amount": F.lit("old"), "edited_fields": edited})
    extracted = p.where("email_id % 5 <> 0").withColumns({"payee": F.lit("new"), "amount": F.lit("new")})
    return workflow.merge_extraction(stored, extracted, ["payee", "amount"]).drop("edited_fields")


@query("SELECT c_nationkey AS user_id, count(*) FILTER (c_custkey % 5 <> 0 AND c_acctbal > 0) AS live, count(*) FILTER (NOT (c_custkey % 5 <> 0 AND c_acctbal > 0)) AS skipped FROM customer GROUP BY 1")
def sync_targets(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("user_id"), F.when(F.col("c_custkey") % 5 == 0, F.lit(1)).alias("invalidated_at"), F.col("c_acctbal").alias("valid_until"))
    return workflow.sync_targets(c, F.lit(0))


@query("SELECT user_id AS batch, event_id % 4 AS index, arg_min(event_type = 'click', event_id) AS security, CASE WHEN arg_min(event_type = 'click', event_id) THEN arg_min('s' || event_id, event_id) END AS status FROM events WHERE event_id % 4 < 3 GROUP BY 1, 2")
def verdict_parse(spark, d):
    e = table(spark, d, "events")
    raw = e.select(F.col("user_id").alias("batch"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("index"), (F.col("event_type") == "click").alias("security"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("status"), F.lit(3).alias("n"))
    return workflow.verdicts(raw, "n")


@query(
    """WITH p AS (SELECT conv_id, turn, text, greatest(ceil(length(text) / 24.0), 1)::INT AS n FROM conversations), s AS (SELECT conv_id, turn, text, n, unnest(range(0, n + 1)) AS seq FROM p)
    SELECT conv_id, turn, seq, 'data: ' || CASE WHEN seq = n THEN '{"type":"finish"}' ELSE '{"type":"text-delta","delta":' || to_json(substr(text, seq * 24 + 1, 24))::VARCHAR || '}' END || chr(10) || chr(10) AS frame FROM s"""
)
def stream_frames(spark, d):
    """The frames of every turn."""
    return workflow.stream_frames(table(spark, d, "conversations"), ["conv_id", "turn"], "text")


@query(
    """WITH p AS (SELECT conv_id, turn, text, greatest(ceil(length(text) / 24.0), 1)::INT AS n FROM conversations WHERE role = 'assistant'), s AS (SELECT conv_id, turn, text, n, unnest(range(0, n + 1)) AS seq FROM p)
    SELECT conv_id, turn, seq, 'data: ' || CASE WHEN seq = n THEN '{"type":"finish"}' ELSE '{"type":"text-delta","delta":' || to_json(substr(text, seq * 24 + 1, 24))::VARCHAR || '}' END || chr(10) || chr(10) AS frame FROM s"""
)
def stream_answer_frames(spark, d):
    """The frames of every answer."""
    return workflow.stream_frames(table(spark, d, "conversations").where("role = 'assistant'"), ["conv_id", "turn"], "text")


@query(
    r"""WITH w AS (SELECT doc_id, lang, n_chars, regexp_extract_all(lower(substr(text, 1, 400)), '[a-z]+') AS ws FROM documents),
    a AS (SELECT doc_id, lang <> 'es' AS answerable, n_chars < 600 AS insufficient, ws[1:6] AS cited, ws[7:9] AS expected, CASE WHEN n_chars % 2 = 0 THEN ws[12:14] ELSE [] END AS distractors, ws[1] = 'the' AS bad FROM w)
    SELECT doc_id AS answer_id, CASE WHEN answerable AND insufficient THEN 'wrong_refusal' WHEN NOT answerable AND NOT insufficient THEN 'missing_refusal' ELSE 'correct' END AS refusal,
    CASE WHEN answerable THEN len(list_intersect(cited, expected)) > 0 END::INT AS evidence_cited, CASE WHEN len(distractors) > 0 THEN len(list_intersect(cited, distractors)) > 0 END::INT AS distractor_cited, coalesce(NOT bad, true) AS grounded FROM a"""
)
def answer_scores(spark, d):
    """Words of a text as what is cited, expected and distracting; short texts refuse, Spanish ones can't be answered."""
    words = F.regexp_extract_all(F.lower(F.substring("text", 1, 400)), F.lit("[a-z]+"), F.lit(0))
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("answer_id"), (F.col("lang") != "es").alias("answerable"), (F.col("n_chars") < 600).alias("insufficient"), F.slice(words, 1, 6).alias("cited"), F.slice(words, 7, 3).alias("expected"),
        F.when(F.col("n_chars") % 2 == 0, F.slice(words, 12, 3)).otherwise(F.array().cast("array<string>")).alias("distractors"), F.when(F.get(words, F.lit(0)) == "the", "unknown_chunk").alias("problem"),
    )
    return workflow.answer_scores(rows).withColumns({c: F.col(c).cast("int") for c in ("evidence_cited", "distractor_cited")})


@query("SELECT doc_id AS answer_id, avg((quality = 1)::INT)::DOUBLE AS faithfulness, avg((toxic = 0)::INT)::DOUBLE AS fact_recall FROM labels GROUP BY 1")
def judge_scores(spark, d):
    x = table(spark, d, "labels")
    claims = x.select(F.col("doc_id").alias("answer_id"), F.lit("claim").alias("kind"), (F.col("quality") == 1).alias("ok")).unionByName(x.select(F.col("doc_id").alias("answer_id"), F.lit("fact").alias("kind"), (F.col("toxic") == 0).alias("ok")))
    return workflow.judged(claims)


@query("SELECT doc_id, CASE lang WHEN 'en' THEN round((n_chars * 2.0::DOUBLE + 10 * 8.0::DOUBLE) / 1e6, 9) END AS cost_usd FROM documents")
def model_costs(spark, d):
    prices = spark.sql("SELECT 'en' AS model, 2.0D AS price_in, 8.0D AS price_out")
    calls = table(spark, d, "documents").select("doc_id", F.col("lang").alias("model"), F.col("n_chars").alias("tokens_in"), F.lit(10).alias("tokens_out"))
    return workflow.costs(calls, prices).select("doc_id", F.round("cost_usd", 9).alias("cost_usd"))


@query("SELECT o_orderkey AS draft_id, DATE '1999-01-01' AS booking_date, -o_totalprice::DECIMAL(14,2) AS amount FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0")
def simulated_bookings(spark, d):
    o = table(spark, d, "orders")
    drafts = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("draft").alias("status"), F.col("o_totalprice").cast("decimal(14,2)").alias("amount"), F.lit("p").alias("payee"), F.lit("r").alias("reference"))
    return workflow.bookings(drafts, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("draft_id")), F.lit("1999-01-01").cast("date")).select("draft_id", "booking_date", "amount")


@query(
    """WITH k AS (SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS m, last_day(o_orderdate::DATE) AS l FROM orders), x AS (SELECT o_orderkey, l, unnest(generate_series(m, l, INTERVAL 1 DAY))::DATE AS day FROM k)
    SELECT o_orderkey, arg_min(day, (abs(day(day) - 0.5::DOUBLE * day(l)), -day(day))) AS day FROM x WHERE isodow(day) < 6 GROUP BY 1"""
)
def appointment_dates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("t"))
    return o.select("o_orderkey", workflow.weekday_near(F.col("t"), F.lit(0.5), F.array().cast("array<date>")).alias("day"))


@query(
    """WITH RECURSIVE s AS (SELECT o_custkey % 40 AS person, date_trunc('month', o_orderdate)::DATE AS month, o_orderkey AS step, (o_orderkey % 11) / 10.0::DOUBLE AS share, row_number() OVER (PARTITION BY o_custkey % 40, date_trunc('month', o_orderdate) ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'),
    w AS (SELECT DISTINCT month, unnest(generate_series(month, last_day(month), INTERVAL 1 DAY))::DATE AS day, day(last_day(month)) AS len FROM s), m AS (SELECT month, any_value(len) AS len, list(day) AS days FROM w WHERE isodow(day) < 6 GROUP BY 1),
    r AS (SELECT person, month, 0::BIGINT AS n, NULL::BIGINT AS step, NULL::DATE AS day, []::DATE[] AS taken FROM s GROUP BY ALL
      UNION ALL SELECT s.person, s.month, s.n, s.step, list_sort(list_transform(list_filter(m.days, lambda x: NOT list_contains(r.taken, x)), lambda x: {'a': abs(day(x) - s.share * m.len), 'b': -day(x), 'c': x}))[1].c,
        list_append(r.taken, list_sort(list_transform(list_filter(m.days, lambda x: NOT list_contains(r.taken, x)), lambda x: {'a': abs(day(x) - s.share * m.len), 'b': -day(x), 'c': x}))[1].c)
      FROM r JOIN s ON s.person = r.person AND s.month = r.month AND s.n = r.n + 1 JOIN m ON m.month = s.month)
    SELECT person, month, step, day FROM r WHERE n > 0"""
)
def appointments_in_order(spark, d):
    """Orders of forty persons as appointments; those that came first keep later ones off their days."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    slots = o.select((F.col("o_custkey") % 40).alias("person"), F.to_date("o_orderdate").alias("month"), F.col("o_orderkey").alias("step"), ((F.col("o_orderkey") % 11) / F.lit(10.0)).alias("share"))
    return workflow.appointments(slots)


@query("SELECT doc_id, lang AS run_1, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END END AS run_2, doc_id % 3 = 0 OR doc_id % 4 = 0 AS disagree FROM documents")
def run_alignment(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.col("lang").alias("v"))
    b = a.where("doc_id % 3 <> 0").select(F.col("doc_id"), F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("v")).alias("v"))
    return workflow.aligned_runs([a, b], "doc_id", "v")


@query(
    """WITH li AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey, max(l_extendedprice) AS l_extendedprice, max(l_quantity) AS l_quantity, max(l_tax) AS l_tax, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2),
    em AS (SELECT o_orderkey AS e, o_orderdate::TIMESTAMP AS sent, CASE left(o_orderpriority, 1) WHEN '1' THEN 'online_only' WHEN '2' THEN 'none' WHEN '3' THEN 'already_paid' WHEN '4' THEN 'to_pay' END AS v, o_orderstatus = 'P' AS failed FROM orders),
    st AS (SELECT l_orderkey AS e, l_linenumber - 1 AS p, 'S' || l_suppkey AS payee, l_extendedprice::DECIMAL(12,2) AS amount, l_returnflag = 'R' AS ed, CASE WHEN l_linestatus = 'F' THEN 'paid' ELSE 'open' END AS status FROM li WHERE l_quantity > 15),
    ex AS (SELECT l_orderkey AS e, l_linenumber - 1 AS p, CASE WHEN l_tax > 0.02 THEN 'P' || l_partkey END AS payee, (l_extendedprice + 1)::DECIMAL(12,2) AS amount FROM li WHERE l_linenumber <= 3 AND l_quantity > 5),
    plan AS (SELECT em.*, (SELECT bool_or(ed) FROM st WHERE st.e = em.e) AS has_ed, CASE WHEN v IN ('online_only', 'none') THEN 'empty' WHEN failed THEN 'keep' WHEN NOT EXISTS (SELECT 1 FROM ex WHERE ex.e = em.e) THEN 'empty' ELSE 'merge' END AS route FROM em),
    mg AS (SELECT coalesce(st.e, ex.e) AS e, coalesce(st.p, ex.p) AS p, CASE WHEN ex.e IS NULL THEN st.payee ELSE ex.payee END AS payee, CASE WHEN ex.e IS NULL OR coalesce(ed, false) THEN st.amount ELSE ex.amount END AS amount, coalesce(ed, false) AS ed, st.status, ex.e IS NOT NULL AS new FROM st FULL JOIN ex ON st.e = ex.e AND st.p = ex.p WHERE ex.e IS NOT NULL OR ed),
    r AS (SELECT mg.e, mg.p, payee, amount, CASE WHEN NOT new THEN status WHEN v = 'already_paid' OR status = 'paid' THEN 'paid' WHEN payee IS NULL THEN 'needs_info' ELSE 'open' END AS status, CASE WHEN new AND payee IS NULL THEN 'missing_payee' ELSE '' END AS issues, CASE WHEN new AND v = 'already_paid' THEN sent END AS paid_on
      FROM mg JOIN plan ON plan.e = mg.e WHERE route = 'merge'
    UNION ALL SELECT st.e, p, payee, amount, status, '', NULL FROM st JOIN plan ON plan.e = st.e WHERE route = 'keep' OR route = 'empty' AND has_ed AND ed
    UNION ALL SELECT e, 0, NULL, NULL, 'needs_info', CASE WHEN v = 'online_only' THEN 'invoice_online' WHEN v = 'none' OR v IS NULL AND NOT failed THEN 'no_invoice_found' WHEN failed THEN 'extraction_failed' ELSE 'no_invoice_found' END, NULL FROM plan WHERE route = 'empty' AND NOT coalesce(has_ed, false) OR route = 'keep' AND has_ed IS NULL)
    SELECT e AS email_id, p::BIGINT AS position, payee, amount, status, issues, paid_on AS paid_at FROM r"""
)
def extraction_routes(spark, d):
    """Orders as mails, their lines as stored and as extracted invoices, verdicts by priority."""
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_tax", "l_returnflag", "l_linestatus")))
    first = F.substring("o_orderpriority", 1, 1)
    verdict = F.when(first == "1", "online_only").when(first == "2", "none").when(first == "3", "already_paid").when(first == "4", "to_pay")
    emails = o.select(F.col("o_orderkey").alias("email_id"), F.col("o_orderdate").cast("timestamp").alias("sent_at"), verdict.alias("verdict"), (F.col("o_orderstatus") == "P").alias("failed"))
    keys = F.col("l_orderkey").alias("email_id"), (F.col("l_linenumber") - 1).cast("long").alias("position")
    none = F.array().cast("array<string>")
    stored = li.where("l_quantity > 15").select(
        *keys, F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("payee"), F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("amount"))).otherwise(none).alias("edited_fields"),
        F.when(F.col("l_linestatus") == "F", "paid").otherwise("open").alias("status"), none.alias("issues"), F.lit(None).cast("timestamp").alias("paid_at"),
    )
    extracted = li.where("l_linenumber <= 3 AND l_quantity > 5").select(*keys, F.when(F.col("l_tax") > 0.02, F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("payee"), (F.col("l_extendedprice") + 1).cast("decimal(12,2)").alias("amount"))
    found = workflow.routed_extraction(emails, stored, extracted, ["payee", "amount"], lambda: F.when(F.col("payee").isNull(), F.array(F.lit("missing_payee"))).otherwise(none))
    return found.select("email_id", "position", "payee", "amount", "status", F.array_join("issues", ",").alias("issues"), F.col("paid_at").cast("timestamp_ntz").alias("paid_at"))


@query()
def runs_side_by_side(spark, d):
    """Pages as newsletters of a dozen items, seen by three runs that miss, reorder and change some; a loop in the tests."""
    k = F.col("page_id")
    base = table(spark, d, "pages").select(F.floor(k / 12).alias("newsletter"), (k % 12).cast("int").alias("idx"), F.trim("url").alias("url"), F.substring("html", 60, 40).alias("title"), (k % 11 == 0).alias("sponsor"), "page_id")
    runs = {"a": base, "b": base.where(k % 5 != 2).withColumn("url", F.when(k % 7 == 3, "").otherwise(F.col("url"))), "c": base.where(k % 6 != 4).withColumn("idx", 11 - F.col("idx")).withColumn("title", F.concat("title", F.lit("!"))).withColumn("sponsor", k % 22 == 0).withColumn("url", F.when(k % 8 == 1, F.concat("url", F.lit("x"))).otherwise(F.col("url")))}
    items = reduce(DataFrame.unionByName, [r.withColumn("run", F.lit(n)) for n, r in runs.items()])
    url = F.col("url")
    return workflow.grouped_runs(items.select("newsletter", "run", "idx", X.compared_url(url).alias("url"), X.is_article_link(url).alias("link"), "title", "sponsor", (url.endswith("x") | (k % 3 == 0)).alias("in_text")), "a")
