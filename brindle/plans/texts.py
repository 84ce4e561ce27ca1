"""Queries of the text functions, chunking, sources and chat operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import markup
from brindle.functions import text as X
from brindle.operators import feed, rules, search, state
from brindle.plans.catalog import query, table
from brindle.sources import bank, chunks, mail, tables


@query(
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id AS parent_id, (p0 // 512)::INT AS chunk_index, array_to_string(w[p0 + 1 : p0 + 512], ' ') AS chunk_text, greatest(len(w[p0 + 1 : p0 + 512]), 1)::INT AS token_count
    FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 512)) AS p0 FROM w)"""
)
def chunk_fixed_tokens(spark, d):
    return search.fixed_chunks(table(spark, d, "documents"), "doc_id")


NORM = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


@query(f"SELECT sha256({NORM} || chr(10) || source) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(X.content_hash(F.coalesce("text", F.lit("")), F.col("source")).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query(
    f"""WITH h AS (SELECT doc_id, sha256({NORM} || chr(10) || source) AS h FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'skip' ELSE CASE WHEN doc_id % 2 = 0 THEN 'reembed' ELSE 'new' END END AS action FROM h"""
)
def ingest_action(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.content_hash(F.coalesce("text", F.lit("")), F.col("source")).alias("h"))
    kind = F.col("doc_id") % 3
    old = docs.where(kind != 0).select("doc_id", F.when((kind == 2) & (F.col("doc_id") % 2 == 1), F.lit("changed")).otherwise(F.col("h")).alias("old"), F.when(kind == 1, "m1").otherwise("m0").alias("model"), F.lit(64).alias("dims"))
    return docs.join(old, "doc_id", "left").select("doc_id", rules.ingest_action(F.col("h"), F.col("old"), F.col("model"), "m1", F.col("dims"), 64).alias("action"))


@query(
    r"""WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '  ' || url || chr(10) WHEN 2 THEN 'HTTP://WWW.' || upper(split_part(url, '/', 3)) || '/A/?UTM_Source=z&q=a%20b+c~*&=x&b&&utm%5Fx=1&100%&p=%C3%A9#f' ELSE url || '&Utm_y' END AS raw FROM pages),
    t AS (SELECT page_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS url FROM v),
    q AS (SELECT page_id, url, list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: [split_part(p, '=', 1), CASE WHEN contains(p, '=') THEN regexp_replace(p, '^[^=]*=', '') ELSE '' END]) AS pairs FROM t),
    w AS (SELECT page_id, url, array_to_string(list_transform(list_filter(list_transform(pairs, lambda x: list_transform(x, lambda y: url_decode(replace(y, '+', ' ')))), lambda x: NOT starts_with(lower(x[1]), 'utm_')), lambda x: replace(url_encode(x[1]), '%20', '+') || '=' || replace(url_encode(x[2]), '%20', '+')), '&') AS q FROM q)
    SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]', 'i') THEN regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1, 'i')), '^www\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1, 'i'), '/+$', '') END AS citation,
    lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS compared,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') AND NOT regexp_matches(regexp_replace(regexp_extract(url, '\?([^#]*)', 1), '(^|&)(utm_[^&]*|&*)', '', 'gi'), '[^&]') AS front_page,
    regexp_matches(url, '^https?://[^/?#]', 'i') AS article FROM w"""
)
def normalize_url(spark, d):
    """Addresses of pages as they are, between blanks, with a further parameter, and with queries of all kinds."""
    url, k = F.col("url"), F.col("page_id")
    odd = F.concat(F.lit("HTTP://WWW."), F.upper(F.split_part(url, F.lit("/"), F.lit(3))), F.lit("/A/?UTM_Source=z&q=a%20b+c~*&=x&b&&utm%5Fx=1&100%&p=%C3%A9#f"))
    u = F.when(k % 4 == 0, url).when(k % 4 == 1, F.concat(F.lit("  "), url, F.lit("\n"))).when(k % 4 == 2, odd).otherwise(F.concat(url, F.lit("&Utm_y")))
    return table(spark, d, "pages").select("page_id", X.citation_url(u).alias("citation"), X.compared_url(u).alias("compared"), X.is_front_page(u).alias("front_page"), X.is_article_link(u).alias("article"))


@query(
    """WITH s AS (SELECT page_id, replace(html, 't="</p>"', 't="' || chr(3) || '"') AS t FROM pages),
    a AS (SELECT page_id, regexp_replace(regexp_replace(t, '<!--.*?-->', ' ', 'gs'), '<!DOCTYPE[^>]*>', ' ', 'gi') AS t FROM s),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '</(p|h[1-6]|table|blockquote)>', chr(2), 'gi'), '</?(br|div|tr|li|table|ul|ol)\\b[^>]*>', chr(1), 'gi') AS t FROM a),
    c AS (SELECT page_id, regexp_replace(t, '<[^>]*>', ' ', 'g') AS t FROM b),
    e AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM c),
    g AS (SELECT page_id, regexp_replace(regexp_replace(t, '[\\x01\\s]*\\x02[\\x01\\x02\\s]*', chr(10) || chr(10), 'g'), '\\s*\\x01[\\x01\\s]*', chr(10), 'g') AS t FROM e),
    f AS (SELECT page_id, regexp_replace(regexp_replace(t, '[^\\S\\n]+', ' ', 'g'), ' *\\n *', chr(10), 'g') AS t FROM g)
    SELECT page_id, replace(trim(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)), chr(3), '</p>') AS body FROM f"""
)
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", markup.html_to_text(F.col("html")).alias("body"))


IBAN = "'DE' || lpad((98 - ((lpad(c_custkey::VARCHAR, 18, '0') || '131400')::HUGEINT % 97))::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 18, '0')"


@query(
    f"""SELECT c_custkey, i AS iban, true AS valid, false AS broken_valid, left(i, 4) || ' •••• ' || right(i, 4) AS masked FROM (SELECT c_custkey, {IBAN} AS i FROM customer)"""
)
def iban_checksum(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", X.demo_iban(F.col("c_custkey")).alias("iban"))
    broken = F.concat(F.substring("iban", 1, 21), F.pmod(F.right("iban", F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))
    return rows.select("c_custkey", "iban", X.iban_valid(F.col("iban")).alias("valid"), X.iban_valid(broken).alias("broken_valid"), X.mask_iban(F.col("iban")).alias("masked"))


@query(
    """SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', a), ',', '#'), '.', ','), '#', '.') || ' €' AS shown, a AS parsed
    FROM (SELECT o_orderkey, o_totalprice::DECIMAL(14,2) AS a FROM orders)"""
)
def euro_amounts(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(14,2)").alias("a"))
    shown = X.format_euro(F.col("a"))
    return rows.select("o_orderkey", shown.alias("shown"), X.parse_amount(F.replace(shown, F.lit(" €"), F.lit(""))).alias("parsed"))


@query("SELECT conv_id, max_by(text, turn) AS question, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1")
def chat_latest_user_text(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("turn"))


@query(
    """SELECT conv_id, CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 79)) || '…' ELSE t END AS title
    FROM (SELECT conv_id, trim(regexp_replace(min_by(text, turn), '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY 1)"""
)
def thread_title(spark, d):
    first = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", X.chat_title(F.col("t")).alias("title"))


@query(
    """WITH old AS (SELECT conv_id, max(turn) AS top FROM conversations WHERE turn < 2 GROUP BY 1), new AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn >= 2)
    SELECT conv_id, turn, (coalesce(top, -1) + n)::BIGINT AS sequence_number FROM new LEFT JOIN old USING (conv_id)"""
)
def thread_sequence(spark, d):
    turns = table(spark, d, "conversations")
    old = turns.where("turn < 2").select("conv_id", F.col("turn").alias("sequence_number"))
    return state.next_numbers(old, turns.where("turn >= 2").select("conv_id", "turn"), "conv_id", "sequence_number", "turn").select("conv_id", "turn", F.col("sequence_number").cast("long"))


@query(
    """WITH a AS (SELECT conv_id, turn, turn % 5 = 4 AS insufficient, CASE WHEN turn % 3 = 2 THEN [] WHEN turn % 7 = 6 THEN [0, 1, 1] WHEN turn % 7 = 5 THEN [7, 0, 0] ELSE [0, 1] END AS cited, CASE WHEN turn % 2 = 1 THEN [0, 1, 2] ELSE [0, 5] END AS seen FROM conversations WHERE role = 'assistant'),
    f AS (SELECT *, [CASE WHEN list_contains(cited[1 : i - 1], cited[i]) THEN 'duplicate_index' WHEN NOT list_contains(seen, cited[i]) THEN 'unknown_chunk' END for i in range(1, len(cited) + 1)] AS fails FROM a)
    SELECT conv_id, turn, CASE WHEN insufficient THEN CASE WHEN len(cited) > 0 THEN 'insufficient_with_citations' END WHEN len(cited) = 0 THEN 'missing_citations' ELSE list_filter(fails, lambda x: x IS NOT NULL)[1] END AS problem FROM f"""
)
def grounding_check(spark, d):
    return _cited(spark, d).select("conv_id", "turn", rules.grounding(F.col("turn") % 5 == 4, F.col("cited"), F.col("seen")).alias("problem"))


def _cited(spark, d):
    turn = F.col("turn")
    cited = F.when(turn % 3 == 2, F.expr("array()").cast("array<int>")).when(turn % 7 == 6, F.array(*map(F.lit, (0, 1, 1)))).when(turn % 7 == 5, F.array(*map(F.lit, (7, 0, 0)))).otherwise(F.array(F.lit(0), F.lit(1)))
    pairs = F.transform(cited, lambda c: F.struct(c.alias("chunk_id"), c.alias("citation_index")))
    seen = F.when(turn % 2 == 1, F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(F.lit(0), F.lit(5)))
    return table(spark, d, "conversations").where("role = 'assistant'").withColumns({"cited": pairs, "seen": seen})


@query(
    """WITH a AS (SELECT conv_id, turn, turn % 5 = 4 AS insufficient, CASE WHEN turn % 3 = 2 THEN [] WHEN turn % 7 = 6 THEN [0, 1, 1] WHEN turn % 7 = 5 THEN [7, 0, 0] ELSE [0, 1] END AS cited, CASE WHEN turn % 2 = 1 THEN [0, 1, 2] ELSE [0, 5] END AS seen,
      CASE WHEN turn % 4 = 1 THEN [] ELSE [(turn % 9)::INT] END AS web, turn % 4 = 3 AS web_known FROM conversations WHERE role = 'assistant'),
    f AS (SELECT *, CASE WHEN web_known THEN web ELSE [] END AS kept, [CASE WHEN list_contains(cited[1 : i - 1], cited[i]) THEN 'duplicate_index' WHEN NOT list_contains(seen, cited[i]) THEN 'unknown_chunk' END for i in range(1, len(cited) + 1)] AS fails FROM a),
    p AS (SELECT *, CASE WHEN insufficient THEN CASE WHEN len(cited) > 0 THEN 'insufficient_with_citations' END WHEN len(cited) = 0 THEN 'missing_citations' ELSE list_filter(fails, lambda x: x IS NOT NULL)[1] END AS plain FROM f)
    SELECT conv_id, turn, coalesce(CASE WHEN len(cited) > 0 OR len(web) = 0 THEN plain END, CASE WHEN insufficient AND len(kept) > 0 THEN 'insufficient_with_citations' WHEN len(list_distinct(list_concat(cited, kept))) < len(cited) + len(kept) THEN 'duplicate_index' END) AS problem FROM p"""
)
def news_grounding_check(spark, d):
    turn = F.col("turn")
    web = F.when(turn % 4 == 1, F.expr("array()").cast("array<struct<url:string,citation_index:int>>")).otherwise(F.array(F.struct(F.when(turn % 4 == 3, "https://www.x.org/a/?q=1").otherwise("https://y.org/").alias("url"), (turn % 9).cast("int").alias("citation_index"))))
    rows = _cited(spark, d).withColumn("web", web)
    return rows.select("conv_id", "turn", rules.news_grounding(turn % 5 == 4, F.col("cited"), F.col("seen"), F.col("web"), F.array(F.lit("x.org/a"))).alias("problem"))


@query()
def rfc822_parse(spark, d):
    """Turns as mails, written and parsed again."""
    t = table(spark, d, "conversations")
    raw = F.concat(F.lit("From: Ada <ada@example.com>\r\nTo: b@example.com, c@example.com\r\nSubject: turn "), F.col("turn").cast("string"), F.lit("\r\nMessage-ID: <"), F.col("conv_id").cast("string"), F.lit("@x>\r\nDate: Tue, 02 Jan 2024 10:00:00 +0100\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), F.coalesce("text", F.lit("")))
    return mail.parsed_mail(t.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), raw.cast("binary").alias("content")))


#: A filing of each customer: its orders as a table whose cells are written in one of four ways by the order's key, with a fact
#: in each amount, and a table of changes whose year spans two columns.
_FILED = """o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS p, o_totalprice::DECIMAL(14,2)::VARCHAR AS a, (o_orderkey % 90 + 1)::VARCHAR AS s FROM orders),
  cells AS (SELECT c, k, 'Order ' || k || ' ' || p AS label, CASE k % 4 WHEN 0 THEN '$' || a WHEN 1 THEN a WHEN 2 THEN '( ' || a || ' )' ELSE '$' || a END AS amount, s || '%' AS share, a AS fact, 'F' || k AS fact_id FROM o)"""


@query(
    f"""WITH {_FILED} SELECT c::VARCHAR AS doc_key, 0 AS table_index, 'Orders of customer ' || c AS title, CASE WHEN c % 2 = 0 THEN 'in thousands' END AS units, label, amount || ' ' || share AS cells, 'Price:' || fact_id || ':EUR:2:' || fact AS facts,
      CASE WHEN c % 3 = 0 THEN '(1) Of customer ' || c ELSE '' END AS notes FROM cells
    UNION ALL SELECT c::VARCHAR, 1, 'Changes', NULL, 'Order ' || k, '$' || a || ' ' || s || '% ' || a || ' ' || CASE WHEN k % 2 = 0 THEN '-' ELSE s || '%' END, '', '' FROM o"""
)
def sec_table_extract(spark, d):
    """Filings made of each customer's orders, parsed again."""
    found = tables.table_rows(_filings(spark, d), "k", "html").select("*", F.inline("rows"))
    facts = F.flatten(F.transform("cells", lambda c: c["facts"]))
    return found.select(
        "doc_key", "table_index", "title", "units", "label", F.array_join(F.transform("cells", lambda c: c["text"]), " ").alias("cells"),
        F.array_join(F.transform(facts, lambda f: F.concat_ws(":", f["name"], f["fact_id"], f["unit_ref"], f["decimals"], f["value"])), ",").alias("facts"), F.array_join("footnotes", ",").alias("notes"),
    )


def _filings(spark, d):
    """k and html of a filing of each customer with orders. Orders are gathered before they are written as rows, which are ten
    times as long; the number of parts is fixed, since by the orders' size they would be merged to fewer than there are cores."""
    cell = lambda *parts: F.concat(F.lit("<td>"), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("</td>"))

    def written(o):
        key, amount, share = o["key"].cast("string"), o["amount"], (o["key"] % 90 + 1).cast("string")
        fact = F.concat(F.lit('<ix:nonFraction name="Price" contextRef="c1" unitRef="EUR" decimals="2" scale="0" id="F'), key, F.lit('">'), amount, F.lit("</ix:nonFraction>"))
        way = o["key"] % 4
        cells = F.when(way == 0, F.concat(cell("$ ", fact), cell(share, "%"))).when(way == 1, F.concat(cell(fact), cell(share), cell("%"))).when(way == 2, F.concat(cell("( ", fact, " )"), cell(""), cell(share, "%"))).otherwise(F.concat(cell("$"), cell(fact), cell(share, "%")))
        return F.concat(F.lit("<tr>"), cell("<p>Order ", key, "</p> ", o["priority"]), cells, F.lit("</tr>"))

    def change(o):
        key, amount, share = o["key"].cast("string"), o["amount"], (o["key"] % 90 + 1).cast("string")
        share_cells = F.concat(cell(share), cell("%"))
        return F.concat(F.lit("<tr>"), cell("Order ", key), cell("$", amount), share_cells, cell(amount), F.when(o["key"] % 2 == 0, cell("—")).otherwise(share_cells), F.lit("</tr>"))

    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("decimal(14,2)").cast("string").alias("amount"), F.col("o_orderpriority").alias("priority"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    made = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), order.alias("o")).repartition(parts, "k")
    orders = made.groupBy("k").agg(F.array_sort(F.collect_list("o")).alias("orders"))
    joined = lambda f: F.array_join(F.transform("orders", f), "")
    each = orders.select("k", joined(written).alias("rows"), joined(change).alias("changes"))
    k = F.col("k").cast("string")
    units, note = F.when(F.col("k") % 2 == 0, "<p>(in thousands)</p>").otherwise(""), F.when(F.col("k") % 3 == 0, F.concat(F.lit("<p>(1) Of customer "), k, F.lit("</p>"))).otherwise("")
    html = F.concat(
        F.lit("<html><body><h1>Part "), k, F.lit("</h1><p>Text of the part. Item 7A. follows.</p><h2>Orders</h2><p>Orders of customer "), k, F.lit("</p>"), units, F.lit("<p>The following table has them.</p><table><thead><tr><td></td><td></td></tr><tr><td></td><th>2024</th><th>2023</th></tr></thead>"), F.col("rows"), F.lit("</table>"), note,
        F.lit("<p>Changes</p><table><tr><th></th><th>2024</th><th colspan=2>Change</th><th>2023</th><th colspan=2>Change</th></tr>"), F.col("changes"), F.lit("</table><p>The end.</p></body></html>"),
    )
    return each.select("k", html.alias("html"))


@query()
def structural_chunks(spark, d):
    """Chunks of the filings, of 512 tokens at most, with their tables row by row."""
    import public_tokenizers

    count = chunks.token_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return chunks.structural_chunks(_filings(spark, d), "k", "html", count=count)


@query()
def page_markdown(spark, d):
    """Headings, paragraphs and lists of raw web pages as Markdown."""
    return chunks.markdown_of(table(spark, d, "pages"), "page_id", "html")


@query(
    """SELECT o_orderkey, o_orderdate::DATE AS booking_date, (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * o_totalprice::DECIMAL(14,2))::DECIMAL(14,2) AS amount, 'Customer ' || o_custkey AS counterparty_name, 'line 1' || chr(10) || 'order ' || o_orderkey AS remittance, false AS unreadable FROM orders WHERE o_orderstatus <> 'P'"""
)
def bank_entries(spark, d):
    o = table(spark, d, "orders")
    debit = F.col("o_orderkey") % 2 == 0
    party = F.struct(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("name"))
    entry = F.struct(
        F.struct(F.lit("EUR").alias("currency"), F.col("o_totalprice").cast("decimal(14,2)").cast("string").alias("amount")).alias("transaction_amount"),
        F.when(debit, "DBIT").otherwise("CRDT").alias("credit_debit_indicator"),
        F.when(F.col("o_orderstatus") == "P", "PDNG").otherwise("BOOK").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("transaction_date"),
        F.when(debit, party).alias("creditor"),
        F.when(~debit, party).alias("debtor"),
        F.array(F.lit("line 1"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("remittance_information"),
    )
    found = bank.entries(o.select("o_orderkey", F.to_json(entry).alias("json")))
    return found.select("o_orderkey", "booking_date", "amount", "counterparty_name", "remittance", "unreadable")


@query("SELECT vec_id, true AS same FROM embeddings")
def vector_codec(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    back = bank.decode_vector(bank.encode_vector(F.col("embedding")))
    return v.select("vec_id", (back == F.col("embedding")).alias("same"))


@query("SELECT doc_id, CASE WHEN p % 5 IN (1, 3) THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p FROM documents)")
def split_assignment(spark, d):
    return state.splits(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "split")


@query(
    """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents)
    WHERE n <= 5 OR list_contains(list_transform(range(0, 5), lambda i: floor(n / 5.0::DOUBLE * i + n / 5.0::DOUBLE / 2)::BIGINT), p)"""
)
def evenly_spaced_sample(spark, d):
    return state.evenly_spaced(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@query(
    """SELECT 'orders_customer' AS check_name, count(*) AS broken FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'lineitem_orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'customer_duplicates', count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'order_dates', count(*) FROM orders WHERE NOT (o_orderdate::DATE < DATE '1998-01-01' AND o_orderdate::DATE >= DATE '1993-01-01')
    UNION ALL SELECT 'facts', count(*) FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) NOT BETWEEN 1 AND 4
    UNION ALL SELECT 'balance', count(*) FROM (SELECT s, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n, (SELECT count(*) / 4.0::DOUBLE FROM orders) AS average FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s)) WHERE abs(n - average) > greatest(2, average / 4)"""
)
def scenario_integrity(spark, d):
    """References, duplicates, ranges of dates and counts, balance of labels."""
    t = lambda n: table(spark, d, n)
    day = F.to_date("o_orderdate")
    facts = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    checks = {
        "orders_customer": t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti"),
        "lineitem_orders": t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti"),
        "customer_duplicates": t("customer").groupBy("c_custkey").count().where("count > 1"),
        "order_dates": t("orders").where(~((day < F.lit("1998-01-01").cast("date")) & (day >= F.lit("1993-01-01").cast("date")))),
        "facts": t("orders").join(facts, "o_orderkey", "left").where(~F.coalesce("n", F.lit(0)).between(1, 4)),
        "balance": feed.unbalanced(t("orders"), "o_orderstatus", ["F", "O", "P", "X"]),
    }
    named = [df.agg(F.count("*").alias("broken")).select(F.lit(n).alias("check_name"), "broken") for n, df in checks.items()]
    return reduce(DataFrame.unionByName, named)


@query(
    """WITH m AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, day(o_orderdate) <= 2 OR day(o_orderdate + INTERVAL 2 DAY) <= 2 AS boundary, o_custkey, o_orderstatus FROM orders),
    p AS (SELECT id, lead(id) OVER (PARTITION BY o_custkey, o_orderstatus, date_trunc('month', day) ORDER BY day, id) AS second FROM m)
    SELECT id, date_trunc('month', day)::DATE AS since, last_day(day) AS until FROM m WHERE boundary AND id NOT IN (SELECT id FROM p WHERE second IS NOT NULL UNION ALL SELECT second FROM p WHERE second IS NOT NULL)"""
)
def month_boundary_cases(spark, d):
    """Mails near a month's end that no case of near duplicates asks for."""
    day = F.to_date("o_orderdate")
    boundary = (F.dayofmonth(day) <= 2) | (F.dayofmonth(F.date_add(day, 2)) <= 2)
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sender"), F.col("o_orderstatus").alias("title"), day.alias("day"), boundary.alias("boundary"))
    pairs = feed.near_duplicate_cases(m)
    return feed.month_cases(m, pairs.select(F.col("first").alias("id")).union(pairs.select("second")))


@query(
    r"""WITH q AS (SELECT doc_id, lower(substr(text, 1, 120)) AS q, [substr(text, 5, 4), substr(text, 200, 4)] AS facts, [split_part(text, ' ', 3), lang, 'on('] AS terms, 'Re: ' || split_part(text, ' ', 2) AS subject, lang FROM documents)
    SELECT doc_id, array_to_string(list_concat(list_concat(list_transform(list_filter(facts, lambda f: contains(q, lower(f))), lambda f: 'answer ' || f),
      list_transform(list_filter(terms, lambda t: regexp_matches(q, '(^|[^0-9a-z_])' || regexp_escape(lower(t)) || '($|[^0-9a-z_])') AND regexp_matches(t, '^[a-zA-Z]+$')), lambda t: 'term ' || t)),
      CASE WHEN contains(q, lower(split_part(subject, 'Re: ', 2))) THEN ['subject ' || subject] ELSE [] END), ';') AS problems FROM q WHERE lang = 'en' AND regexp_matches(q, '^[\x00-\x7f]*$')"""
)
def question_problems(spark, d):
    """Questions cut from English texts, held against pieces of the same text."""
    word = lambda n: F.split_part(F.col("text"), F.lit(" "), F.lit(n))
    docs = table(spark, d, "documents").withColumn("q", F.substring("text", 1, 120)).where((F.col("lang") == "en") & F.col("q").rlike(r"^[\x00-\x7f]*$"))
    facts = F.array(F.substring("text", 5, 4), F.substring("text", 200, 4))
    terms = F.filter(F.array(word(3), F.col("lang"), F.lit("on(")), lambda t: t.rlike("^[a-zA-Z]+$"))
    return docs.select("doc_id", F.array_join(feed.question_problems(F.col("q"), facts, terms, F.concat(F.lit("Re: "), word(2))), ";").alias("problems"))


@query()
def chunk_bpe_tokens(spark, d):
    """Windows of 512 tokens of source and text; checked token by token in the tests."""
    import public_tokenizers

    return search.token_chunks(table(spark, d, "documents"), "doc_id", "source", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
