"""Payments, confirmations, extraction merges, sync targets, job runs, answers' scores and other multi-table transitions."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import words


def confirm(matches: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links the chosen pairs, unless rejected or one side is linked already; competing suggestions on either side go.

    matches: invoice_id, debit_id, status; chosen: invoice_id, debit_id. Adds `refused` to pairs that could not be linked.
    """
    keys = ["invoice_id", "debit_id"]
    linked = matches.where("status = 'linked'")
    able = chosen.join(matches.where("status = 'rejected'").select(*keys), keys, "left_anti")
    able = able.join(linked.select("invoice_id").distinct(), "invoice_id", "left_anti").join(linked.select("debit_id").distinct(), "debit_id", "left_anti").select(*keys)
    marked = matches.join(able.withColumn("__ok", F.lit(True)), keys, "full").join(chosen.withColumn("__chosen", F.lit(True)), keys, "left")
    marked = marked.withColumn("status", F.when(F.col("__ok"), "linked").otherwise(F.col("status")))
    rivals = lambda side: able.select(side).distinct().withColumn(f"__{side}", F.lit(True))
    out = marked.join(rivals("invoice_id"), "invoice_id", "left").join(rivals("debit_id"), "debit_id", "left")
    gone = (F.col("status") == "suggested") & (F.col("__invoice_id").isNotNull() | F.col("__debit_id").isNotNull())
    return out.where(~F.coalesce(gone, F.lit(False))).select(*keys, "status", (F.col("__chosen").isNotNull() & F.col("__ok").isNull()).alias("refused"))


def reject(matches: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks pairs as rejected; also the invoices to open again, those whose link was rejected."""
    keys = ["invoice_id", "debit_id"]
    hit = matches.join(chosen.select(*keys).withColumn("__x", F.lit(True)), keys, "left")
    reopened = hit.where(F.col("__x") & (F.col("status") == "linked")).select("invoice_id").distinct()
    return hit.withColumn("status", F.when(F.col("__x"), "rejected").otherwise(F.col("status"))).drop("__x"), reopened


def rehash_accounts(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """Known accounts with the hash of a fetched one of equal IBAN whose hash isn't known; the row id stays."""
    new = fetched.join(known.select("identification_hash"), "identification_hash", "left_anti").groupBy("iban").agg(F.min("identification_hash").alias("__h"))
    return known.join(new, "iban", "left").withColumn("identification_hash", F.coalesce("__h", "identification_hash")).drop("__h")


def merge_extraction(stored: DataFrame, extracted: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of (email_id, position) after an extraction: fields that the owner edited stay, others follow the extraction;
    rows that weren't extracted again go unless edited. stored has edited_fields."""
    keys = ["email_id", "position"]
    new = extracted.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__new"))
    both = stored.join(new, keys, "full")
    edited = F.coalesce("edited_fields", F.array().cast("array<string>"))
    kept = both.where(F.col("__new").isNotNull() | (F.size(edited) > 0))
    value = lambda f: F.when(F.col("__new") & ~F.array_contains(edited, f), F.col(f"__{f}")).otherwise(F.col(f)).alias(f)
    return kept.select(*keys, *[value(f) for f in fields], edited.alias("edited_fields"))


def routed_extraction(emails: DataFrame, stored: DataFrame, extracted: DataFrame, fields: Sequence[str], issues: Callable[[], Column]) -> DataFrame:
    """The invoices of every email after an extraction, by what a check said of it.

    emails: email_id, sent_at, verdict (online_only, none, already_paid, other, null: the check failed), failed (the extraction
    did). stored: email_id, position, the fields, edited_fields, status, issues, paid_at. extracted: email_id, position, the fields.

    Found invoices are merged by position: edited fields stay, rows past the new list go unless edited; they are rechecked, or
    paid when the mail came if the verdict says so. After a failed extraction all rows stay. Where there is no invoice, edited
    rows stay, or else one empty row at position 0 says why. An email without rows gets such a row too.
    """
    keys = ["email_id", "position"]
    edited = F.size(F.coalesce("edited_fields", F.array().cast("array<string>"))) > 0
    has = stored.groupBy("email_id").agg(F.bool_or(edited).alias("__edited"), F.bool_or(F.col("position") == 0).alias("__first"))
    found = extracted.select("email_id").distinct().withColumn("__found", F.lit(True))
    none = F.col("verdict").isin("online_only", "none")
    route = F.when(F.coalesce(none, F.lit(False)), "empty").when(F.col("failed"), "keep").when(F.col("__found").isNull(), "empty").otherwise("merge")
    why = F.when(F.coalesce(none, F.lit(False)), F.when(F.col("verdict") == "online_only", "invoice_online").otherwise("no_invoice_found")).when(F.col("failed"), "extraction_failed").otherwise("no_invoice_found")
    plan = emails.join(found, "email_id", "left").join(has, "email_id", "left")
    plan = plan.select("email_id", "sent_at", (F.coalesce(F.col("verdict") == "already_paid", F.lit(False))).alias("__paid"), route.alias("__route"), why.alias("__why"), "__edited", F.coalesce("__first", F.lit(False)).alias("__first"))
    columns = [*keys, *fields, "edited_fields", "status", "issues", "paid_at"]
    planned = stored.join(plan, "email_id")
    merging = plan.where("__route = 'merge'").select("email_id", "sent_at", "__paid")
    merged = merge_extraction(planned.where("__route = 'merge'").select(*keys, *fields, "edited_fields"), extracted.join(merging.select("email_id"), "email_id", "left_semi"), fields)
    old = stored.select(*keys, F.col("status").alias("__status"), F.col("issues").alias("__issues"), F.col("paid_at").alias("__at"))
    new = extracted.select(*keys, F.lit(True).alias("__new"))
    checked = merged.join(merging, "email_id").join(old, keys, "left").join(new, keys, "left").withColumn("__again", issues())
    is_new = F.coalesce("__new", F.lit(False))
    status = F.when(~is_new, F.col("__status")).when(F.col("__paid"), "paid").otherwise(F.when(F.col("__status").eqNullSafe("paid"), "paid").when(F.size("__again") == 0, "open").otherwise("needs_info"))
    merged = checked.select(*keys, *fields, "edited_fields", status.alias("status"), F.when(is_new, F.col("__again")).otherwise(F.col("__issues")).alias("issues"), F.when(is_new & F.col("__paid"), F.coalesce("__at", "sent_at")).otherwise(F.col("__at")).alias("paid_at"))
    kept = planned.where(F.when(F.col("__route") == "keep", True).otherwise((F.col("__route") == "empty") & F.col("__edited") & edited)).select(*columns)
    bare = plan.where(F.when(F.col("__route") == "empty", ~F.coalesce("__edited", F.lit(False))).otherwise((F.col("__route") == "keep") & F.col("__edited").isNull()))
    kinds = dict(stored.dtypes)
    # what was at position 0 stays as a row: its time of payment is the only thing that an emptied row keeps
    times = stored.where("position = 0").select("email_id", F.col("paid_at").alias("__at"))
    empty = bare.join(times, "email_id", "left").select("email_id", F.lit(0).cast(kinds["position"]).alias("position"), *[F.lit(None).cast(kinds[f]).alias(f) for f in fields], F.array().cast("array<string>").alias("edited_fields"), F.lit("needs_info").alias("status"), F.array("__why").alias("issues"), F.col("__at").alias("paid_at"))
    return merged.unionByName(kept).unionByName(empty)


def draft_payments(invoices: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(invoice_id, outcome: created, not_open, already_approved) and the old drafts that a new one cancels."""
    approved = drafts.where("status = 'approved'").select("invoice_id").distinct().withColumn("__a", F.lit(True))
    outcome = F.when(F.col("status") != "open", "not_open").when(F.col("__a"), "already_approved").otherwise("created")
    planned = invoices.select(F.col("id").alias("invoice_id"), "status").join(approved, "invoice_id", "left").select("invoice_id", outcome.alias("outcome"))
    cancelled = drafts.where("status = 'draft'").join(planned.where("outcome = 'created'").select("invoice_id"), "invoice_id", "left_semi")
    return planned, cancelled.select("id", "invoice_id", F.lit("cancelled").alias("status"))


def paid(status: Column, issues: Column, owner_paid: Column, matched: Column) -> Column:
    """Paid by owner or match; what is no longer paid goes through its checks again."""
    return F.when(owner_paid | matched, "paid").when(F.size(issues) == 0, "open").otherwise("needs_info")


def sync_targets(connections: DataFrame, now: Column) -> DataFrame:
    """live and skipped connections of each user."""
    live = F.col("invalidated_at").isNull() & F.coalesce(F.col("valid_until") > now, F.lit(False))
    return connections.groupBy("user_id").agg(F.count(F.when(live, 1)).alias("live"), F.count(F.when(~live, 1)).alias("skipped"))


def verdicts(raw: DataFrame, count: str) -> DataFrame:
    """First verdict of each index within range; a status only for security news. raw: batch, seq, index, security, status."""
    ok = raw.where((F.col("index") >= 0) & (F.col("index") < F.col(count)))
    first = ok.withColumn("__n", F.row_number().over(Window.partitionBy("batch", "index").orderBy("seq"))).where("__n = 1")
    return first.select("batch", "index", "security", F.when(F.col("security"), F.col("status")).alias("status"))


def cards_of(cards: DataFrame, seen: DataFrame) -> DataFrame:
    """turn, kind, ids, dropped: the ids of each card that were seen, and how many weren't; a card without any isn't one.
    cards: turn, kind, id; seen: id."""
    marked = cards.join(seen.select("id").distinct().withColumn("__seen", F.lit(True)), "id", "left")
    kept = marked.groupBy("turn", "kind").agg(F.array_sort(F.collect_list(F.when(F.col("__seen"), F.col("id")))).alias("ids"), F.count(F.when(F.col("__seen").isNull(), 1)).alias("dropped"))
    return kept.where(F.size("ids") > 0)


def base_ledger(accounts: DataFrame, key: str, today: str, months: int = 3, salary: str = "4200.00", rent: str = "1350.00") -> DataFrame:
    """account, month, kind, n, day, amount: for each month before a day a salary, a rent, and eight or nine purchases whose day
    and price are hashes of account, month and number, so that every run makes the same."""
    month = accounts.select(F.col(key).alias("account"), F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("month"))
    ago = lambda n: F.date_sub(F.lit(today).cast("date"), (F.col("month") * 30 + n).cast("int"))
    drawn = lambda n, what: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("account").cast("string"), F.col("month").cast("string"), n, F.lit(what))), 1, 6), 16, 10).cast("long")
    money = lambda c: c.cast("decimal(12,2)").alias("amount")
    fixed = [month.select("account", "month", F.lit(kind).alias("kind"), F.lit(0).alias("n"), ago(F.lit(days)).alias("day"), money(F.lit(amount))) for kind, days, amount in (("salary", 1, salary), ("rent", 3, f"-{rent}"))]
    many = month.select("*", F.explode(F.sequence(F.lit(0), (7 + drawn(F.lit("0"), "count") % 2).cast("int"))).alias("n"))
    number = F.col("n").cast("string")
    price = -((350 + drawn(number, "price") % 8551).cast("decimal(12,2)") / 100)
    shops = many.select("account", "month", F.lit("shop").alias("kind"), "n", ago(drawn(number, "day") % 30).alias("day"), money(price))
    return fixed[0].unionByName(fixed[1]).unionByName(shops)


def cooling_down(starts: DataFrame, job: str, now: Column, seconds: int = 600) -> DataFrame:
    """One row: whether the job started within the cooldown."""
    latest = starts.where(F.col("job") == job).agg(F.max("started_at").alias("t"))
    return latest.select(F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("t") < seconds, F.lit(False)).alias("cooling_down"))


def job_run(spark: SparkSession, job: str, work: Callable[[], dict[str, int]], write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Writes a running row, does the work, writes its counts or the error (2000 characters), which is raised on."""
    schema = "job string, started_at timestamp, finished_at timestamp, status string, counts map<string,int>, error string"
    start = datetime.now(UTC).replace(tzinfo=None)
    row = lambda *end: spark.createDataFrame([(job, start, *end)], schema)
    write(row(None, "running", None, None))
    try:
        counts = work()
    except Exception as e:
        write(row(datetime.now(UTC).replace(tzinfo=None), "failed", None, f"{type(e).__name__}: {e}"[:2000]))
        raise
    write(row(datetime.now(UTC).replace(tzinfo=None), "ok", counts, None))
    return counts


def stream_frames(answers: DataFrame, ident: str | list[str], text: str, size: int = 24) -> DataFrame:
    """Server-sent events of an answer: pieces of the text, then the end; ordered by seq."""
    n = F.ceil(F.length(text) / F.lit(float(size))).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(F.col(text), (i - 1) * size + 1, F.lit(size)))
    frames = F.concat(F.transform(pieces, lambda p: F.to_json(F.struct(F.lit("text-delta").alias("type"), p.alias("delta")))), F.array(F.lit('{"type":"finish"}')))
    return answers.select(*([ident] if isinstance(ident, str) else ident), F.posexplode(frames).alias("seq", "data")).withColumn("frame", F.concat(F.lit("data: "), "data", F.lit("\n\n"))).drop("data")


def answer_scores(answers: DataFrame) -> DataFrame:
    """answers: answer_id, answerable, insufficient, cited, expected, distractors (arrays of parents), problem."""
    outcome = F.when(F.col("answerable") & F.col("insufficient"), "wrong_refusal").when(~F.col("answerable") & ~F.col("insufficient"), "missing_refusal").otherwise("correct")
    hit = lambda c: F.when(F.size(c) > 0, F.arrays_overlap("cited", c))
    return answers.select("answer_id", outcome.alias("refusal"), F.when(F.col("answerable"), F.arrays_overlap("cited", "expected")).alias("evidence_cited"), hit("distractors").alias("distractor_cited"), F.col("problem").isNull().alias("grounded"))


def judged(claims: DataFrame) -> DataFrame:
    """faithfulness and fact_recall of each answer: shares of supported claims and of right facts; null without any."""
    share = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("ok").cast("int")))
    return claims.groupBy("answer_id").agg(share("claim").alias("faithfulness"), share("fact").alias("fact_recall"))


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens by price per million; null for an unknown model."""
    usd = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return calls.join(prices, "model", "left").withColumn("cost_usd", usd)


def bookings(drafts: DataFrame, known: DataFrame, day: Column) -> DataFrame:
    """A debit for every completed draft that has none yet."""
    return drafts.where("status = 'completed'").join(known.select(F.col("draft_id").alias("id")), "id", "left_anti").select(F.col("id").alias("draft_id"), day.alias("booking_date"), (-F.col("amount")).alias("amount"), F.col("payee").alias("counterparty_name"), F.col("reference").alias("remittance"))


def missing_days(rows: DataFrame, group: str, day: str) -> DataFrame:
    """group and each day between a group's first and last that has no row: what a backfill has to fetch."""
    have = rows.select(group, F.col(day).cast("date").alias("day")).where("day is not null").distinct()
    ends = have.groupBy(group).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return ends.select(group, F.explode(F.sequence("a", "b")).alias("day")).join(have, [group, "day"], "left_anti")


def weekday_near(first: Column, share: Column, taken: Column) -> Column:
    """The free weekday of first's month nearest to a share of the month, the later of two equally near ones."""
    month = F.trunc(first, "month")
    days = F.filter(F.sequence(month, F.last_day(first)), lambda d: (F.weekday(d) < 5) & ~F.array_contains(taken, d))
    target = share * F.dayofmonth(F.last_day(first))
    best = F.array_min(F.transform(days, lambda d: F.struct(F.abs(F.dayofmonth(d) - target).alias("gap"), (-F.dayofmonth(d)).alias("late"), d.alias("day"))))
    return best["day"]


def appointments(slots: DataFrame) -> DataFrame:
    """person, month, step, day: the slots of a person and month are given days in order of step, each the free weekday nearest
    to its share of the month; a day that an earlier step took is no longer free. slots: person, month (any day of it), step,
    share. The days taken so far are the state of a fold over a month's slots, which are few. No day is left after all
    weekdays are taken: null."""
    month = F.trunc("month", "month").cast("date")
    lists = slots.groupBy("person", month.alias("month")).agg(F.array_sort(F.collect_list(F.struct("step", "share"))).alias("steps"))
    days = F.aggregate("steps", F.array().cast("array<date>"), lambda taken, s: F.concat(taken, F.array(weekday_near(F.col("month"), s["share"], F.filter(taken, lambda d: d.isNotNull())))))
    return lists.select("person", "month", F.inline(F.arrays_zip(F.col("steps.step").alias("step"), days.alias("day"))))


def fill_dates(template: Column, values: dict[str, Column]) -> Column:
    """{name} as 2 January 2024 and {name:short} as 02.01.; unknown names stay."""
    out = template
    for name, day in values.items():
        out = F.replace(F.replace(out, F.lit(f"{{{name}:short}}"), F.date_format(day, "dd.MM.")), F.lit(f"{{{name}}}"), F.date_format(day, "d MMMM yyyy"))
    return out


def keywords(query: str, document_counts: DataFrame, k: int = 5) -> DataFrame:
    """term: default of the pluggable keyword model, the query's rarest known terms; the query itself if none is known."""
    terms = [t for t in dict.fromkeys(query.lower().split()) if t]
    found = document_counts.where(F.col("term").isin(*terms)).orderBy("df", "term").limit(k).select("term")
    none = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(query).alias("term"))
    return found.unionByName(none)


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(F.array_distinct(words(F.lower(F.col(text))))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def embedded(rows: DataFrame, ident: str, text: str, embed: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = 100) -> DataFrame:
    """Vectors in batches; a wrong dimension fails the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                vectors = embed(part[text].fillna("").tolist())
                if any(len(v) != dimensions for v in vectors):
                    raise ValueError(f"embeddings of {dimensions} dimensions are asked for")
                yield pd.DataFrame({ident: part[ident].to_numpy(), "embedding": vectors})

    kind = dict(rows.dtypes)[ident]
    return rows.select(ident, text).mapInPandas(run, f"{ident} {kind}, embedding array<float>")


def grouped_runs(items: DataFrame, reference: str, least: float = 0.85) -> DataFrame:
    """The items of several runs over one newsletter side by side, in reading order.

    items: newsletter, run, idx, url (as compared), link (an article's), title, sponsor, in_text. Result: newsletter, place,
    position, versions (run, idx; in the order of runs), missing, reasons, choice.

    Runs are taken by name after the reference. An item joins the group whose first version has the same link (first come, first
    served) or else the most similar title; one that joins none stands half way between the groups of its neighbours in its
    run, or half a place after the last. Reasons to look at a group: a run lacks it, addresses differ and the text doesn't
    settle which is right, runs disagree on the sponsor, or all call it one. The choice is the run whose address alone is in
    the text, or, if none is, the first that left it empty. A newsletter, some dozens of items a run, is one task's group.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        runs = {name: part.sort_values("idx").to_dict("records") for name, part in frame.groupby("run", sort=True)}
        names = [reference, *(n for n in runs if n != reference)]
        groups = [{"at": float(k), "versions": {reference: x}} for k, x in enumerate(runs.get(reference, []))]
        for name in names[1:]:
            rows = runs[name]
            joined = _joined([next(iter(g["versions"].values())) for g in groups], rows, least)
            fixed = {i: groups[g]["at"] for i, g in joined.items()}
            at, added = -1.0, []
            for i, x in enumerate(rows):
                if i in joined:
                    groups[joined[i]]["versions"][name] = x
                    at = fixed[i]
                else:
                    at = (at + next((fixed[j] for j in range(i + 1, len(rows)) if j in fixed), at + 1.0)) / 2
                    added.append({"at": at, "versions": {name: x}})
            groups += added
        out = []
        for place, g in enumerate(sorted(groups, key=lambda g: g["at"])):
            found = g["versions"]
            supported: dict[str, str] = {}
            for n, x in found.items():
                if x["in_text"]:
                    supported.setdefault(x["url"], n)
            choice = next(iter(supported.values())) if len(supported) == 1 else next((n for n, x in found.items() if not x["url"]), None) if not supported else None
            lacking, flags = [n for n in names if n not in found], {bool(x["sponsor"]) for x in found.values()}
            reasons = ["missing in " + ", ".join(lacking)] * bool(lacking)
            reasons += ["different URLs"] * (len({x["url"] for x in found.values()}) > 1 and choice is None)
            reasons += ["sponsor flag differs"] * (len(flags) > 1) + ["flagged sponsor"] * (flags == {True})
            out.append((frame["newsletter"].iloc[0], place, g["at"], [{"run": n, "idx": int(found[n]["idx"])} for n in names if n in found], lacking, reasons, choice))
        return pd.DataFrame(out, columns=["newsletter", "place", "position", "versions", "missing", "reasons", "choice"])

    kind = dict(items.dtypes)["newsletter"]
    return items.groupBy("newsletter").applyInPandas(one, f"newsletter {kind}, place int, position double, versions array<struct<run:string,idx:int>>, missing array<string>, reasons array<string>, choice string")


def _joined(anchors: list[dict], rows: list[dict], least: float) -> dict[int, int]:
    """The group that each row joins: by link in order, then greedily by title."""
    waiting: dict[str, list[int]] = {}
    for g, x in enumerate(anchors):
        if x["link"]:
            waiting.setdefault(x["url"], []).append(g)
    out = {i: waiting[x["url"]].pop(0) for i, x in enumerate(rows) if x["link"] and waiting.get(x["url"])}
    folded = lambda x: x["title"].casefold().strip()
    free = [g for g in range(len(anchors)) if g not in out.values()]
    scored = sorted((-difflib.SequenceMatcher(None, folded(anchors[g]), folded(x)).ratio(), g, i) for g in free for i, x in enumerate(rows) if i not in out)
    for ratio, g, i in scored:
        if -ratio >= least and i not in out and g not in out.values():
            out[i] = g
    return out


def aligned_runs(runs: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Several runs side by side: key, run_1 ... run_n, and whether they disagree (a run that lacks the key does)."""
    named = [r.select(key, F.col(value).alias(f"run_{i + 1}")) for i, r in enumerate(runs)]
    out = reduce(lambda a, b: a.join(b, key, "full"), named)
    columns = [F.col(f"run_{i + 1}") for i in range(len(runs))]
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(columns[0]) for c in columns[1:]], F.lit(True))
    return out.withColumn("disagree", ~same)
