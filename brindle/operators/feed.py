"""News plans, feed membership and sorts, list filters, case derivation: transitions over several tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.resolve import saved
from brindle.operators.state import first_of, ranks


def plan_stories(items: DataFrame, groups: DataFrame, edition: Column, days: int = 2, pair: tuple[str, str] | None = None) -> DataFrame:
    """id, plan of the items to plan anew for an edition: candidates, within `days` of it, by the group that links put them in,
    and every other item of a story that a candidate belongs to, by itself. items: id, day, story; groups: id, story."""
    near = F.abs(F.datediff("day", edition)) <= days
    candidates = items.where(near)
    touched = candidates.where("story is not null").select("story").distinct()
    outside = items.where(~near).join(touched, "story", "left_semi").select("id", F.col("id").alias("plan"))
    return candidates.select("id").join(groups.select("id", F.col("story").alias("plan")), "id").unionByName(outside)


def planned_stories(items: DataFrame, plan: DataFrame, pair: tuple[str, str] | None = None) -> DataFrame:
    """Per plan: first_seen, last_seen, is_big, items. Big are those with items of both sources of the pair, or, without a
    pair, of several sources."""
    both = F.countDistinct("source") > 1 if pair is None else F.bool_or(F.col("source") == pair[0]) & F.bool_or(F.col("source") == pair[1])
    return items.join(plan, "id").groupBy("plan").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), both.alias("is_big"), F.count("*").alias("items"))


def feed_items(items: DataFrame, first: Column, last: Column) -> DataFrame:
    """Items of every story that has an item in [first, last), and items without a story that lie in it themselves."""
    inside = (F.col("day") >= first) & (F.col("day") < last)
    shown = items.where(inside & F.col("story").isNotNull()).select("story").distinct()
    return items.where(F.col("story").isNull() & inside).unionByName(items.join(shown, "story", "left_semi").select(*items.columns))


def newest_positions(items: DataFrame) -> DataFrame:
    """story, day, position: the least position of a story's items on its newest day."""
    return items.where("story is not null").groupBy("story").agg(F.max(F.struct("day", (-F.col("position")).alias("p"))).alias("top")).select("story", "top.day", (-F.col("top.p")).alias("position"))


def story_lists(items: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """story and its values in order. An item without a story is a list of its own, so that no list grows with what was never
    grouped."""
    lists = items.where("story is not null").groupBy("story").agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("l")).select("story", F.col(f"l.{value}").alias("values"))
    return lists.unionByName(items.where("story is null").select("story", F.array(value).alias("values")))


def most_covered(stories: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """The big story of the last days with most items; the later one of equals."""
    recent = stories.where(F.col("is_big") & (F.col("last_seen") > F.date_sub(today, days)) & (F.col("last_seen") <= today))
    return recent.orderBy(F.desc("item_count"), F.desc("last_seen"), "story").limit(1)


def without_sponsors(items: DataFrame, group: str, order: str) -> DataFrame:
    """Items that no sponsor paid for, numbered from 0 without gaps; only what stays is numbered, in groups of any size."""
    return ranks(items.where(~F.col("sponsor")).drop("sponsor"), group, [order], "position")


def relabelled(mail: DataFrame, verdicts: DataFrame, kinds: Sequence[str] = ("to_pay", "already_paid")) -> DataFrame:
    """Mail whose attachment turned out to be an invoice of one of the kinds is labelled so; other labels stay."""
    found = verdicts.where(F.col("kind").isin(*kinds)).select("id").distinct().withColumn("__v", F.lit(True))
    return mail.join(found, "id", "left").withColumn("label", F.when(F.col("__v"), "invoice").otherwise(F.col("label"))).drop("__v")


def invoice_list(invoices: DataFrame, status: Column, statuses: Sequence[str], first: str | None, last: str | None, payee: str) -> DataFrame:
    """Invoices by shown status, by date (the invoice's, else the mail's) and by a part of the payee, in any case."""
    day = F.coalesce("invoice_date", F.to_date("sent_at"))
    keep = F.lit(True)
    for condition in (status.isin(*statuses) if statuses else None, day >= F.lit(first).cast("date") if first else None, day <= F.lit(last).cast("date") if last else None, F.contains(F.lower(F.coalesce("payee", F.lit(""))), F.lit(payee.lower())) if payee else None):
        keep = keep if condition is None else keep & condition
    return invoices.where(keep)


def overdue_first(status: Column, due: str, given: str) -> list[Column]:
    """Sort keys: overdue ones by due date, then the rest in the given order."""
    late = status == "overdue"
    return [F.when(late, 0).otherwise(1), F.when(late, F.col(due)).asc_nulls_last(), F.col(given)]


def unjudged(notes: DataFrame, items: DataFrame) -> DataFrame:
    """Notes whose item's verdict is null, also where there is no item."""
    return notes.join(items.select("key", "security"), "key", "left").where(F.col("security").isNull())


def only_keys(attributes: Column, allowed: Sequence[str], prefixes: Sequence[str] = ()) -> Column:
    """Entries of a map whose key is allowed or begins with one of the prefixes."""
    return F.map_filter(attributes, lambda k, _: k.isin(*allowed) | F.exists(F.array(*map(F.lit, prefixes)).cast("array<string>"), lambda p: k.startswith(p)))


def distractor_rate(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """case_id and the share of a case's distractors among its hits, null without any. cases: case_id, distractors (array);
    hits: case_id, parent_id."""
    found = hits.groupBy("case_id").agg(F.collect_set("parent_id").alias("found"))
    both = cases.join(found, "case_id", "left")
    n = F.size(F.array_distinct("distractors"))
    hit = F.size(F.array_intersect("distractors", F.coalesce("found", F.array().cast(dict(cases.dtypes)["distractors"]))))
    return both.select("case_id", F.when(n > 0, hit / n).alias("distractor_rate"))


def pooled(scores: DataFrame) -> DataFrame:
    """One row: ratios of sums, so that long editions weigh more, and the plain mean of `order`.

    scores: wanted, given, found, exact, leaks, drops, invented, order.
    """
    total = {c: F.sum(c) for c in ("wanted", "given", "found", "exact", "leaks", "drops", "invented")}
    share = lambda a, b: F.try_divide(total[a].cast("double"), total[b].cast("double"))
    return scores.agg(*[t.alias(c) for c, t in total.items()], share("found", "wanted").alias("recall"), share("found", "given").alias("precision"), share("exact", "found").alias("url_exact"), F.avg("order").alias("order"))


def order_kept(pairs: DataFrame) -> DataFrame:
    """group and the share of its pairs of matched items that stand in the same order on both sides, null below two items.
    pairs: group, expected_idx, actual_idx.

    Counted by merging, over groups of any size: a pair of places differs first in one bit, and there one lies in the left and
    the other in the right half of a block of that size. In each block, in the order of the other side, a right item follows as
    many left ones as it keeps the order with. All blocks of all sizes are range-partitioned together, so that a large block is
    counted by many tasks: running counts start at what the parts before have.
    """
    placed = ranks(pairs.select("group", "expected_idx", "actual_idx"), "group", ["expected_idx", "actual_idx"], "__e")
    sizes = saved(placed.groupBy(F.col("group").alias("__g")).agg(F.count("*").alias("n")))
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(2)))).cast("int") - 1)
    each = placed.join(sizes, F.col("group").eqNullSafe(F.col("__g"))).select("group", "actual_idx", "__e", F.explode(levels).alias("level"))
    block = F.floor(F.col("__e") / F.pow(F.lit(2.0), F.col("level") + 1)).cast("long")
    half = F.floor(F.col("__e") / F.pow(F.lit(2.0), F.col("level"))).cast("long") % 2
    # of equal places on the other side the right items come first, so that they don't count as kept
    laid = each.select("group", "level", block.alias("block"), "actual_idx", (1 - half).cast("int").alias("left"))
    key, order = ["group", "level", "block"], ["actual_idx", "left"]
    spread = saved(laid.repartitionByRange(*key, *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = spread.groupBy(*key, "part").agg(F.sum("left").alias("n")).select(*[F.col(c).alias(f"__{c}") for c in key], F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    same = F.col("part") == F.col("__part")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = F.sum("left").over(Window.partitionBy(*key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = spread.withColumn("inside", inside).where("left = 0").join(first, same).groupBy("group").agg(F.sum(F.col("inside") + F.col("first")).alias("kept"))
    pairs_of = F.col("n") * (F.col("n") - 1)
    return sizes.join(kept, F.col("__g").eqNullSafe(F.col("group")), "left").select(F.col("__g").alias("group"), F.when(F.col("n") > 1, F.coalesce("kept", F.lit(0)) * 2 / pairs_of).alias("order"))


def near_duplicate_cases(mails: DataFrame) -> DataFrame:
    """Pairs of successive mails of one sender and title key in one month: first, second, month and its last day; the second
    is the distractor of the first. mails: id, sender, title, day."""
    month = F.trunc("day", "month")
    order = Window.partitionBy("sender", "title", month).orderBy("day", "id")
    paired = mails.withColumn("second", F.lead("id").over(order)).where("second is not null")
    return paired.select(F.col("id").alias("first"), "second", month.alias("month"), F.last_day("day").alias("until"))


def month_cases(mails: DataFrame, targeted: DataFrame) -> DataFrame:
    """Cases that ask for a mail by its month: id, since, until (the month's first and last day) of the mails that stand near a
    month's end and aren't targeted by a case already. mails: id, day, boundary; targeted: id."""
    return mails.where("boundary").join(targeted.select("id").distinct(), "id", "left_anti").select("id", F.trunc("day", "month").alias("since"), F.last_day("day").alias("until"))


def question_problems(question: Column, facts: Column, terms: Column, subject: Column) -> Column:
    """Why a question gives its answer away: it has a fact's value, names a term that it must not (as a whole word), or has the
    subject of the mail. All without regard to case."""
    text = F.lower(question)
    given = F.transform(F.filter(facts, lambda f: F.contains(text, F.lower(f))), lambda f: F.concat(F.lit("answer "), f))
    whole = lambda t: F.concat(F.lit(r"\b\Q"), F.lower(t), F.lit(r"\E\b"))
    named = F.transform(F.filter(terms, lambda t: F.regexp_like(text, whole(t))), lambda t: F.concat(F.lit("term "), t))
    bare = F.regexp_replace(F.lower(subject), "^re: ", "")
    return F.concat(given, named, F.when(F.contains(text, bare), F.array(F.concat(F.lit("subject "), subject))).otherwise(F.array().cast("array<string>")))


def unbalanced(rows: DataFrame, label: str, known: Sequence[str], least: float = 2, share: float = 0.25) -> DataFrame:
    """Known labels whose number of rows is further from the average than `least` or a share of it, whichever is larger."""
    total = rows.agg(F.count("*").alias("__all"))
    counts = rows.where(F.col(label).isin(*known)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = total.select(F.explode(F.array(*map(F.lit, known))).alias("label"), (F.col("__all") / len(known)).alias("average"))
    out = every.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.where(F.abs(F.col("n") - F.col("average")) > F.greatest(F.lit(float(least)), F.col("average") * share)).select("label", "n")


def edition_items(items: DataFrame, stories: DataFrame, first: str, last: str, big_only: bool) -> DataFrame:
    """Items of editions from a day to another, both included, with their story's columns; with big_only those of big stories."""
    found = items.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).join(stories, "story", "left")
    return found.where(F.coalesce("is_big", F.lit(False))) if big_only else found


def links_of(items: DataFrame) -> DataFrame:
    """story and links, the first link of each of its sources, in the order in which these come. items: story, source, position,
    url."""
    first = first_of(items.where("url IS NOT NULL AND url <> ''"), ["story", "source"], ["position"], "position", "url")
    return first.groupBy("story").agg(F.array_sort(F.collect_list(F.struct("position", "source", "url"))).alias("links"))
