"""Queries of invoices, bank debits and connections; orders play invoices and, shifted by days, the debits that pay them."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import resolve, rules, search, state
from brindle.plans.catalog import query, table

_I = """i AS (SELECT o_orderkey AS id, o_totalprice::DECIMAL(12,2) AS amount, 'EUR' AS currency, 'DE ' || o_custkey AS iban, 'INV-' || o_orderkey AS number, c_name AS payee, o_orderdate::DATE AS start FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT o_orderkey AS id, (o_orderdate::DATE + (o_orderkey % 150)::INT)::DATE AS booked, o_totalprice::DECIMAL(12,2) AS amount, CASE WHEN o_orderkey % 5 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
  CASE WHEN o_orderkey % 2 = 0 THEN c_name END AS party, CASE WHEN o_orderkey % 4 = 1 THEN 'de' || o_custkey END AS iban, CASE WHEN o_orderkey % 3 = 0 THEN 'payment inv ' || o_orderkey ELSE 'payment' END AS remittance FROM orders JOIN customer ON o_custkey = c_custkey)"""
_S = f"""{_I}, s AS (SELECT i.id AS invoice_id, d.id AS debit_id, coalesce(regexp_replace(lower(i.iban), '[^0-9a-z]', '', 'g') = regexp_replace(lower(d.iban), '[^0-9a-z]', '', 'g'), false) AS iban, contains(regexp_replace(lower(remittance), '[^0-9a-z]', '', 'g'), regexp_replace(lower(number), '[^0-9a-z]', '', 'g')) AS ref,
  coalesce(list_has_any(list_filter(string_split_regex(lower(payee), '[^0-9a-z]+'), lambda x: length(x) >= 4), list_filter(string_split_regex(lower(party), '[^0-9a-z]+'), lambda x: length(x) >= 4)), false) AS nam
  FROM i JOIN d ON i.amount = d.amount AND i.currency = d.currency AND booked BETWEEN start AND start + 120),
g AS (SELECT invoice_id, debit_id, concat_ws(',', 'amount', CASE WHEN iban THEN 'iban' END, CASE WHEN ref THEN 'reference' END, CASE WHEN nam THEN 'name' END) AS signals, ref, nam, iban FROM s)"""


def _sides(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    amount = F.col("o_totalprice").cast("decimal(12,2)")
    key = F.col("o_orderkey")
    invoices = o.select(key.alias("id"), amount.alias("amount"), F.lit("EUR").alias("currency"), F.concat(F.lit("DE "), F.col("o_custkey").cast("string")).alias("iban"), F.concat(F.lit("INV-"), key.cast("string")).alias("invoice_number"), F.lit(None).cast("string").alias("reference"), F.col("c_name").alias("payee"), F.to_date("o_orderdate").alias("start"))
    text = F.when(key % 3 == 0, F.concat(F.lit("payment inv "), key.cast("string"))).otherwise("payment")
    debits = o.select(key.alias("id"), F.date_add(F.to_date("o_orderdate"), (key % 150).cast("int")).alias("booking_date"), amount.alias("amount"), F.when(key % 5 == 0, "USD").otherwise("EUR").alias("currency"), F.when(key % 4 == 1, F.concat(F.lit("de"), F.col("o_custkey").cast("string"))).alias("counterparty_iban"), F.when(key % 2 == 0, F.col("c_name")).alias("counterparty_name"), text.alias("remittance"))
    return invoices, debits


@query(f"WITH {_S} SELECT invoice_id, debit_id, signals FROM g")
def invoice_match_signals(spark, d):
    return resolve.match_signals(*_sides(spark, d)).withColumn("signals", F.array_join("signals", ","))


@query(f"WITH {_S}, a AS (SELECT *, sum((ref OR iban)::INT) OVER (PARTITION BY invoice_id) AS n FROM g WHERE (ref OR nam OR iban) AND NOT (invoice_id = debit_id AND invoice_id % 30 = 0)) SELECT invoice_id, debit_id, CASE WHEN n = 1 THEN 'linked' ELSE 'suggested' END AS status, signals FROM a WHERE n = 0 OR ref OR iban")
def invoice_match_propose(spark, d):
    pairs = resolve.saved(resolve.match_signals(*_sides(spark, d), further=True))
    rejected = pairs.where("invoice_id = debit_id AND invoice_id % 30 = 0").select("invoice_id", "debit_id")
    return resolve.propose(pairs, rejected).withColumn("signals", F.array_join("signals", ","))


@query()
def invoice_assignment(spark, d):
    """Proposals in the order of invoices, without debits linked before; checked against a loop in the tests."""
    invoices, debits = _sides(spark, d)
    order = invoices.select(F.col("id").alias("invoice_id"), "start")
    return resolve.assign(resolve.match_signals(invoices, debits, further=True), order).withColumn("signals", F.array_join("signals", ","))


@query(
    """SELECT event_id, ordinal, sha256(concat_ws('|', day::VARCHAR, amount::VARCHAR, event_type, user_id::VARCHAR, ordinal::VARCHAR)) AS dedup_key FROM (
    SELECT event_id, ts::DATE AS day, round_even(value, 0)::DECIMAL(14,2) AS amount, event_type, user_id, (row_number() OVER (PARTITION BY ts::DATE, round_even(value, 0)::DECIMAL(14,2), event_type, user_id ORDER BY event_id) - 1)::INT AS ordinal FROM events)"""
)
def transaction_dedup_keys(spark, d):
    rows = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), F.bround("value", 0).cast("decimal(14,2)").alias("amount"), "event_type", "user_id")
    return state.with_dedup_keys(rows, ["day", "amount", "event_type", "user_id"], ["event_id"]).select("event_id", "ordinal", "dedup_key")


@query("SELECT event_type, count(*) AS added FROM events WHERE event_id % 10 >= 6 GROUP BY 1")
def insert_ignore_count(spark, d):
    """A re-read that overlaps with what is stored adds only what is new, though it holds every row twice."""
    e = table(spark, d, "events").select("event_id", "event_type")
    again = e.where("event_id % 10 >= 3")
    return state.insert_ignore(e.where("event_id % 10 < 6"), again.unionByName(again), ["event_id"]).groupBy("event_type").agg(F.count("*").alias("added"))


@query("SELECT user_id, max(ts)::DATE - 7 AS since FROM events GROUP BY 1")
def incremental_cursor(spark, d):
    return state.cursors(table(spark, d, "events"), "user_id", F.to_date("ts"), F.lit("2024-02-01").cast("date"))


@query("SELECT o_orderkey, o_totalprice::DECIMAL(14,2) AS amount, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE '%7%' AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def transactions_search(spark, d):
    o = table(spark, d, "orders").where(F.to_date("o_orderdate").between(F.lit("1996-01-01"), F.lit("1997-12-31")))
    c = table(spark, d, "customer").where(search.contains_any("7", F.col("c_name"))).select(F.col("c_custkey").alias("o_custkey"))
    return o.join(c, "o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", F.col("o_totalprice").cast("decimal(14,2)").alias("amount"), F.to_date("o_orderdate").alias("day"))


_CHECK = """SELECT *, concat_ws(',', CASE WHEN payee IS NULL OR trim(payee) = '' THEN 'missing_payee' END, CASE WHEN iban IS NULL THEN 'missing_iban' WHEN iban LIKE 'XX%' THEN 'invalid_iban' END,
  CASE WHEN amount IS NULL THEN 'missing_amount' WHEN amount <= 0 THEN 'amount_not_positive' END, CASE WHEN currency IS DISTINCT FROM 'EUR' THEN 'currency_not_eur' END) AS issues FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END AS payee, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'XX00' ELSE 'ok' END AS iban, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal::DECIMAL(12,2) END AS amount,
  CASE c_custkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'eur' WHEN 2 THEN NULL ELSE 'EUR' END AS currency FROM customer)"""


@query(f"SELECT c_custkey, issues, CASE WHEN c_custkey % 9 = 0 THEN 'paid' WHEN issues = '' THEN 'open' ELSE 'needs_info' END AS status FROM ({_CHECK})")
def invoice_checks(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k, F.when(k % 4 == 0, " ").otherwise(F.col("c_name")).alias("payee"), F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, "XX00").otherwise(X.demo_iban(k)).alias("iban"), F.when(k % 11 != 0, F.col("c_acctbal").cast("decimal(12,2)")).alias("amount"), F.when(k % 6 == 0, "USD").when(k % 6 == 1, "eur").when(k % 6 != 2, "EUR").alias("currency"))
    checked = rows.withColumn("found", rules.invoice_issues(F.col("payee"), F.col("iban"), F.col("amount"), F.col("currency")))
    return checked.select("c_custkey", F.array_join("found", ",").alias("issues"), rules.invoice_status(F.when(k % 9 == 0, "paid"), F.col("found")).alias("status"))


_UNTIL = """u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate::TIMESTAMP + to_hours((o_orderkey % 24)::INT) END AS until, CASE WHEN o_orderkey % 10 = 0 THEN 1 END AS gone, TIMESTAMP '1998-01-01 12:00:00' AS now FROM orders),
c AS (SELECT *, CASE WHEN gone = 1 OR until IS NULL OR until <= now THEN 'expired' WHEN until - now <= INTERVAL 14 DAY THEN 'expiring' ELSE 'active' END AS status FROM u)"""


def _connections(spark, d):
    """Ends of connections at any hour, some missing, some invalidated."""
    k = F.col("o_orderkey")
    until = F.when(k % 13 != 0, F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), (k % 24).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", until.alias("until"), F.when(k % 10 == 0, F.lit("1997-01-01").cast("timestamp")).alias("gone"), F.lit("1998-01-01 12:00:00").cast("timestamp").alias("now"))


@query(
    f"""WITH {_UNTIL}, r AS (SELECT *, CASE WHEN status = 'expired' THEN 3 WHEN until - now <= INTERVAL 3 DAY THEN 2 WHEN until - now <= INTERVAL 14 DAY THEN 1 ELSE 0 END AS r FROM c)
    SELECT o_orderkey, CASE WHEN r > o_orderkey % 3 THEN ['14d', '3d', 'expired'][r] END AS notice FROM r"""
)
def due_notice(spark, d):
    sent = F.when(F.col("o_orderkey") % 3 == 1, "14d").when(F.col("o_orderkey") % 3 == 2, "3d")
    return _connections(spark, d).select("o_orderkey", rules.due_notice(F.col("until"), F.col("gone"), F.col("now"), sent).alias("notice"))


@query(f"WITH {_UNTIL} SELECT o_orderkey, status FROM c")
def connection_status(spark, d):
    return _connections(spark, d).select("o_orderkey", rules.connection_status(F.col("until"), F.col("gone"), F.col("now")).alias("status"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'not_open' WHEN c_custkey % 5 = 0 THEN 'invalid_iban' WHEN c_custkey % 7 = 0 THEN 'iban_changed' WHEN c_custkey % 2 = 0 THEN 'amount_changed' END AS refusal FROM customer"""
)
def payment_refusal(spark, d):
    """Drafts whose IBAN stands in groups of four; some are another's, some amounts are changed."""
    k, iban = F.col("c_custkey"), X.demo_iban(F.col("c_custkey"))
    grouped = F.regexp_replace(F.lower(F.when(k % 7 == 0, X.demo_iban(k + 1)).otherwise(iban)), "(.{4})", "$1 ")
    draft = F.when(k % 2 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    found = rules.refusal(F.when(k % 3 == 0, "paid").otherwise("open"), F.when(k % 5 == 0, F.lit("DE00")).otherwise(iban), grouped, F.col("c_acctbal"), draft)
    return table(spark, d, "customer").select("c_custkey", found.alias("refusal"))


@query(
    f"""WITH {_S}, a AS (SELECT *, sum((ref OR iban)::INT) OVER (PARTITION BY invoice_id) AS n FROM g WHERE ref OR nam OR iban), p AS (SELECT invoice_id, debit_id, CASE WHEN n = 1 THEN 'linked' ELSE 'suggested' END AS status, signals FROM a WHERE n = 0 OR ref OR iban),
    o AS (SELECT invoice_id, debit_id, CASE invoice_id % 6 WHEN 0 THEN 'rejected' WHEN 1 THEN 'linked' ELSE 'suggested' END AS was FROM g WHERE invoice_id % 2 = 0 OR invoice_id % 3 = 1),
    m AS (SELECT invoice_id, debit_id, CASE WHEN was IN ('rejected', 'linked') THEN was ELSE coalesce(p.status, was) END AS status, CASE WHEN was IN ('rejected', 'linked') THEN 'old' ELSE coalesce(p.signals, 'old') END AS signals FROM o FULL JOIN p USING (invoice_id, debit_id))
    SELECT * FROM m WHERE NOT (status = 'suggested' AND (invoice_id IN (SELECT invoice_id FROM m WHERE status = 'linked') OR debit_id IN (SELECT debit_id FROM m WHERE status = 'linked')))"""
)
def invoice_apply_proposals(spark, d):
    pairs = resolve.saved(resolve.match_signals(*_sides(spark, d)))
    old = pairs.where("invoice_id % 2 = 0 OR invoice_id % 3 = 1").select("invoice_id", "debit_id", F.expr("CASE invoice_id % 6 WHEN 0 THEN 'rejected' WHEN 1 THEN 'linked' ELSE 'suggested' END").alias("status"), F.array(F.lit("old")).alias("signals"))
    return resolve.apply_proposals(old, resolve.propose(pairs)).withColumn("signals", F.array_join("signals", ","))


@query(
    f"""WITH {_S}, a AS (SELECT *, sum((ref OR iban)::INT) OVER (PARTITION BY invoice_id) AS n FROM g WHERE ref OR nam OR iban)
    SELECT count(*) FILTER (n = 1 AND (ref OR iban)) AS linked, count(*) FILTER (n = 0 OR (n > 1 AND (ref OR iban))) AS suggested, count(DISTINCT CASE WHEN n = 1 THEN invoice_id END) AS paid FROM a"""
)
def invoice_proposal_counts(spark, d):
    return resolve.proposal_counts(resolve.propose(resolve.match_signals(*_sides(spark, d), further=True)))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderkey % 8 = 0 THEN 'pending' WHEN o_orderdate::DATE + 14 < DATE '1998-01-01' THEN 'overdue' ELSE 'open' END AS status FROM orders")
def display_status(spark, d):
    o = table(spark, d, "orders")
    since = F.when(F.col("o_orderkey") % 8 == 0, F.lit("1997-12-29").cast("date"))
    shown = rules.display_status(F.when(F.col("o_orderstatus") == "F", "paid").otherwise("open"), F.date_add(F.to_date("o_orderdate"), 14), F.lit("1998-01-01").cast("date"), since)
    return o.select("o_orderkey", shown.alias("status"))


@query(f"SELECT c_custkey, 'BCD' || chr(10) || '002' || chr(10) || '1' || chr(10) || 'SCT' || chr(10) || 'AB1' || chr(10) || c_name || chr(10) || 'X' || chr(10) || 'EUR' || c_acctbal::DECIMAL(14,2) || chr(10) || chr(10) || chr(10) || 'ref ' || c_custkey AS payload FROM customer WHERE c_acctbal >= 0.01 AND c_custkey % 9 <> 0")
def epc_payload(spark, d):
    """Amounts with a fraction of a cent have no code."""
    c = table(spark, d, "customer")
    amount = F.col("c_acctbal").cast("decimal(14,3)") + F.when(F.col("c_custkey") % 9 == 0, F.lit("0.005").cast("decimal(14,3)")).otherwise(F.lit("0.000").cast("decimal(14,3)"))
    p = X.epc_payload(F.concat(F.lit(" "), "c_name", F.lit(" ")), F.lit("x"), F.lit(" ab1 "), amount, F.concat(F.lit(" ref "), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", p.alias("payload")).where("payload IS NOT NULL")


@query("SELECT l_orderkey, sum(q * p)::DECIMAL(24,4) AS net, round(sum(q * p) * 0.19, 2)::DECIMAL(24,2) AS vat FROM (SELECT l_orderkey, l_quantity::DECIMAL(10,2) AS q, l_extendedprice::DECIMAL(12,2) AS p FROM lineitem) GROUP BY 1")
def money_sums(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("decimal(10,2)") * F.col("l_extendedprice").cast("decimal(12,2)")).alias("m"))
    return li.groupBy("l_orderkey").agg(F.sum("m").cast("decimal(24,4)").alias("net"), F.round(F.sum("m") * F.lit("0.19").cast("decimal(4,2)"), 2).cast("decimal(24,2)").alias("vat"))
