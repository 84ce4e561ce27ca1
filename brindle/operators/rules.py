"""Rules and state transitions as column expressions: labels, invoices, payments, connections, grounding, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import citation_url, iban_valid, invoice_filename, normalize_iban


def newsletter_source(address: Column, sources: dict[str, str]) -> Column:
    """By whole address, then by domain."""
    table = F.create_map(*[F.lit(x) for pair in sources.items() for x in pair]) if sources else F.lit(None).cast("map<string,string>")
    a = F.lower(F.trim(address))
    return F.coalesce(F.try_element_at(table, a), F.try_element_at(table, F.substring_index(a, "@", -1)))


def label(address: Column, attachments: Column, sources: dict[str, str], classified: Column) -> Column:
    """A known newsletter, else mail with an invoice attached, else what the classifier said."""
    return F.when(newsletter_source(address, sources).isNotNull(), "ai_newsletter").when(F.exists(attachments, lambda name: invoice_filename(name)), "invoice").otherwise(classified)


def ingest_action(new_hash: Column, old_hash: Column, old_model: Column, model: str, old_dims: Column, dims: int) -> Column:
    return F.when(old_hash.isNull() | (old_hash != new_hash), "new").when((old_model == model) & (old_dims == dims), "skip").otherwise("reembed")


def attachment_content(content: Column, cap: int = 10 * 1024 * 1024) -> tuple[Column, Column]:
    """Content within the cap, and the reason why it is missing."""
    large = F.octet_length(content) > cap
    return F.when(~large, content), F.when(large, "too_large")


def invoice_issues(payee: Column, iban: Column, amount: Column, currency: Column) -> Column:
    """In this order: payee, iban, amount, currency. Only EUR, in capitals, passes."""
    none = lambda c: F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))
    checks = [
        F.when(none(payee), "missing_payee"),
        F.when(F.coalesce(iban == "", F.lit(True)), "missing_iban").when(~iban_valid(iban), "invalid_iban"),
        F.when(amount.isNull(), "missing_amount").when(amount <= 0, "amount_not_positive"),
        F.when(~currency.eqNullSafe("EUR"), "currency_not_eur"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def invoice_status(current: Column, issues: Column) -> Column:
    """Paid stays paid; else open without issues."""
    return F.when(current.eqNullSafe("paid"), "paid").when(F.size(issues) == 0, "open").otherwise("needs_info")


def display_status(status: Column, due: Column, today: Column, pending_since: Column | None = None, pending_days: int = 5) -> Column:
    out = F.when(status == "paid", "paid")
    if pending_since is not None:
        out = out.when(F.coalesce(F.datediff(today, pending_since).between(0, pending_days), F.lit(False)), "pending")
    return out.when(F.coalesce(due < today, F.lit(False)), "overdue").otherwise(status)


def clean_text(c: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def clean_amount(c: Column) -> Column:
    """Two digits, halves to even."""
    return F.bround(c.cast("decimal(20,6)"), 2).cast("decimal(12,2)")


def refusal(status: Column, iban: Column, draft_iban: Column, amount: Column, draft_amount: Column) -> Column:
    """Why a draft can't be approved; null if it can. IBANs are compared without blanks and in capitals."""
    changed = ~normalize_iban(iban).eqNullSafe(normalize_iban(draft_iban))
    return F.when(~status.eqNullSafe("open"), "not_open").when(~iban_valid(iban), "invalid_iban").when(changed, "iban_changed").when(~amount.eqNullSafe(draft_amount), "amount_changed")


def connection_status(valid_until: Column, invalidated: Column, now: Column, days: int = 14) -> Column:
    """Of instants; a connection without an end is expired."""
    until, at = (c.cast("timestamp") for c in (valid_until, now))
    gone = invalidated.isNotNull() | F.coalesce(until <= at, F.lit(True))
    return F.when(gone, "expired").when(until <= at + F.expr(f"INTERVAL {days} DAYS"), "expiring").otherwise("active")


#: Stages of an expiry notice, from the first to the last, with the days left at which they begin.
STAGES = (("14d", 14), ("3d", 3), ("expired", 0))


def due_notice(valid_until: Column, invalidated: Column, now: Column, sent: Column) -> Column:
    """The last stage that a connection has reached, unless it or a later one was sent."""
    until, at = (c.cast("timestamp") for c in (valid_until, now))
    reached = F.lit(0)
    for i, (_, days) in enumerate(STAGES[:-1]):
        reached = F.when(until <= at + F.expr(f"INTERVAL {days} DAYS"), i + 1).otherwise(reached)
    reached = F.when(connection_status(valid_until, invalidated, now) == "expired", len(STAGES)).otherwise(reached)
    names = F.array(*[F.lit(s) for s, _ in STAGES])
    return F.when(reached > F.coalesce(F.array_position(names, sent), F.lit(0)), F.element_at(names, reached.cast("int")))


def grounding(insufficient: Column, cited: Column, seen: Column) -> Column:
    """Why an answer isn't grounded, null if it is. cited: array of (chunk_id, citation_index); seen: array of ids.

    The first citation that fails decides: a repeated index, or a chunk that was not seen.
    """
    before = lambda i: F.transform(F.slice(cited, 1, i), lambda c: c["citation_index"])
    fails = F.transform(cited, lambda c, i: F.when(F.array_contains(before(i), c["citation_index"]), "duplicate_index").when(~F.array_contains(seen, c["chunk_id"]), "unknown_chunk"))
    first = F.element_at(F.concat(F.filter(fails, lambda f: f.isNotNull()), F.array(F.lit(None).cast("string"))), 1)
    return F.when(insufficient, F.when(F.size(cited) > 0, "insufficient_with_citations")).when(F.size(cited) == 0, "missing_citations").otherwise(first)


def news_grounding(insufficient: Column, cited: Column, seen: Column, web: Column, web_seen: Column) -> Column:
    """grounding for answers that cite the web too. web: array of (url, citation_index); web_seen: normalised addresses.

    Web citations that weren't seen are only removed; an answer that cited nothing but the web stands without them. An index
    that an item and a web citation share is a repeated one.
    """
    kept = F.filter(web, lambda c: F.array_contains(web_seen, citation_url(c["url"])))
    plain = F.when((F.size(cited) > 0) | (F.size(web) == 0), grounding(insufficient, cited, seen))
    indices = F.concat(*[F.transform(x, lambda c: c["citation_index"].cast("int")) for x in (cited, kept)])
    late = F.when(insufficient & (F.size(kept) > 0), "insufficient_with_citations").when(F.size(F.array_distinct(indices)) < F.size(indices), "duplicate_index")
    return F.coalesce(plain, late)


def plan_notifications(invoices: DataFrame, known: DataFrame, today: Column, due_days: int = 3, enabled: bool = True) -> DataFrame:
    """key, kind, status of messages not sent before. invoices: id, status, due_date.

    A new invoice is announced once, one that arrives paid is recorded as skipped. An open one that is due within due_days is
    announced once more, but with a new invoice only recorded, since its first message says so. Disabled sending records
    everything as skipped.
    """
    key = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("id").cast("string"))
    due = (F.col("status") == "open") & F.coalesce(F.col("due_date").between(today, F.date_add(today, due_days)), F.lit(False))
    seen = known.select("key").distinct()
    told = invoices.withColumns({"new_key": key("invoice_new"), "due": due}).join(seen.select(F.col("key").alias("new_key"), F.lit(True).alias("told")), "new_key", "left")
    state = lambda skip: F.when(F.lit(not enabled) | skip, "skipped").otherwise("pending")
    new = told.where("told is null").select(F.col("new_key").alias("key"), F.lit("invoice_new").alias("kind"), state(F.col("status") == "paid").alias("status"))
    soon = told.where("due").select(key("invoice_due").alias("key"), F.lit("invoice_due").alias("kind"), state(F.col("told").isNull()).alias("status"))
    return new.unionByName(soon.join(seen, "key", "left_anti"))


def announce_stories(items: DataFrame, known: DataFrame) -> DataFrame:
    """key, kind, status of every item not recorded before of the stories to announce: big ones and alerts, which go before
    big news. The first item of a story none of whose items was recorded is pending, all others are skipped.

    items: story, big, alert (null, "new" or "update"; one value a story), item_key, position.
    """
    wanted = items.where(F.col("alert").isNotNull() | F.col("big"))
    seen = known.select(F.col("key").alias("item_key"), F.lit(True).alias("told")).distinct()
    marked = wanted.join(seen, "item_key", "left")
    first = marked.groupBy("story").agg(F.min_by("item_key", F.struct("position", "item_key")).alias("first"), F.max(F.coalesce("told", F.lit(False))).alias("announced"))
    fresh = marked.where("told is null").join(first, "story")
    status = F.when(~F.col("announced") & (F.col("item_key") == F.col("first")), "pending").otherwise("skipped")
    return fresh.select(F.col("item_key").alias("key"), F.when(F.col("alert").isNotNull(), "news_security").otherwise("news_big").alias("kind"), status.alias("status"))


def delivery(status: Column, attempts: Column, code: Column, most: int = 5) -> Column:
    """State after an attempt: sent on 200; tried again, until the last attempt, after 429, a server's error (500 and more) or
    none at all (null); failed at once after any other code."""
    again = code.isNull() | (code == 429) | (code >= 500)
    return F.when(status != "pending", status).when(code == 200, "sent").when(again & (attempts + 1 < most), "pending").otherwise("failed")


def stops_run(code: Column) -> Column:
    """Whether a response means that every further message of the run would be refused too."""
    return F.coalesce((code != 200) & (code < 500), F.lit(False))


def exactly_one(*columns: Column) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + c.isNotNull().cast("int")
    return total == 1
