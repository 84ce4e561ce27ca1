"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Sizes are words. Sources, ordered by code point with null last, get repeating weights and share the size of the whole
corpus; a source's target stops at `most` times its own size, and the excess is shared anew by weight (water-filling, in
closed form: with sources in the order of cap by weight, the level is the largest of (all - caps before) / weights left).

Within a source every document has the key -ln(u) / quality, u uniform from a hash of its id, so that the smallest keys
are a weighted sample without replacement. Complete epochs take every document; the rest of the target is taken in the
order of keys, each document whole, up to where its middle passes the budget. Equal keys, of rows with one id, follow each
other by size and then by a number that every row gets, so that some of them can be taken and others not.

A source may hold a third of all rows, so its keys are never sorted in one task: keys fall into `bins`, sizes are summed by
source and bin, and the bin in which the budget ends is divided again, by key, then by size, then by row number, until it
has LAST rows at most; only those are ordered.

Quality is the share of letters, digits and white space among a text's characters, 0.05 at least.

Nulls: a null text has size 0; a null source is a source of its own, the last; a null id hashes as the word null. Repeated
rows are rows of their own. Texts of any length count whole. An empty table gives no row. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 4096
SEED = "mix"
#: So many rows of a source are ordered in one task.
LAST = 50_000
#: One row for each source is broadcast up to this number, some 10 MB; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality_of(text: Column) -> Column:
    """Between 0.05 and 1."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), plain)


def key_of(ident: Column, quality: Column, seed: str = SEED) -> Column:
    """-ln(u) / quality; u from the first 52 bits of a hash of the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / quality


def weigh(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *more: Column) -> DataFrame:
    """ident, source, size, sampling key and number of each row, stored, without the text but with the columns of `more`."""
    body = text_of(text)
    columns = [F.col(f"`{key}`").alias("ident"), F.col(f"`{source}`").alias("source"), size_of(body).alias("size"), key_of(F.col(f"`{key}`"), quality_of(body)).alias("order_key")]
    return stored(docs.select(*columns, F.monotonically_increasing_id().alias("row"), *more), "mix-weighed")


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source and total to source, source_size, target. The windows run over one row for each source."""
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("total") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("caps_before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all", F.sum("total").over(everything))
        .withColumn("level", F.max((F.col("all") - F.col("caps_before")) / F.col("weights_left")).over(everything))
    )
    return filled.select("source", F.col("total").alias("source_size"), F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def plan(weighed: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, bins: int = BINS) -> DataFrame:
    """Per source: source_size, target, epochs, and the key, size and number of the last row of the fractional part."""
    rows = weighed.select("source", "order_key", "size", "row").withColumn("bin", F.floor(F.col("order_key") / (F.col("order_key") + 1) * bins))
    budget = targets(rows.groupBy("source").agg(F.sum("size").alias("total")), weights, most)
    budget = budget.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    budget = stored(budget.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    cut = None
    left = budget.where("left > 0").select(F.col("source").alias("s"), F.lit(0).cast("long").alias("start"), "left")
    while not left.isEmpty():
        # the bin in which each source's budget ends, and the words before it
        place = {f"{end}_{c}": getattr(F, end)(c) for c in ("order_key", "size", "row") for end in ("min", "max")}
        sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), *[e.alias(k) for k, e in place.items()])
        upto = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = sums.join(_small(left), F.col("source").eqNullSafe(F.col("s"))).withColumn("end", F.col("start") + F.sum("n").over(upto))
        edge = ends.where((F.col("end") >= F.col("left")) & (F.col("end") - F.col("n") < F.col("left"))).select("s", F.col("bin").alias("at"), (F.col("end") - F.col("n")).alias("start"), "left", "rows", *place)
        edge = stored(edge, "mix-edges")
        inside = rows.join(_small(edge), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("at")))
        few = inside.where(F.col("rows") <= LAST)
        running = Window.partitionBy("s").orderBy("order_key", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        middle = F.col("start") + F.sum("size").over(running) - F.col("size") / 2.0
        # without a row whose middle is within the budget, the cut stands before the bin's first one
        first = F.struct(F.lit(float("-inf")).alias("order_key"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("row"))
        found = few.withColumn("taken", F.when(middle <= F.col("left"), F.struct("order_key", "size", "row"))).groupBy("s").agg(F.max("taken").alias("cut"), F.min(F.struct(F.col("min_order_key").alias("order_key"), F.col("min_size").alias("size"), (F.col("min_row") - 1).alias("row"))).alias("before"))
        found = stored(found.select("s", F.coalesce("cut", "before", first).alias("cut")), "mix-cuts")
        cut = found if cut is None else cut.unionByName(found)
        rows = stored(inside.where(F.col("rows") > LAST).select("source", "order_key", "size", "row", _divided(bins).alias("bin")), "mix-inside")
        left = edge.where(F.col("rows") > LAST).select("s", "start", "left")
    if cut is None:
        return budget.select("source", "source_size", "target", "epochs", F.lit(None).cast("struct<order_key:double,size:bigint,row:bigint>").alias("cut"))
    return budget.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "cut")


def _divided(bins: int) -> Column:
    """The part of its bin in which a row lies: by key, or where all keys are equal by size, or else by number."""
    part = F.lit(0).cast("long")
    for c in ("row", "size", "order_key"):
        low, high = F.col(f"min_{c}").cast("double"), F.col(f"max_{c}").cast("double")
        part = F.when(high > low, F.floor((F.col(c) - low) / (high - low) * bins)).otherwise(part)
    return part


def _small(per_source: DataFrame) -> DataFrame:
    """Broadcast a table of one row for each source if its row count, which is read here, is within the bound."""
    return F.broadcast(per_source) if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else per_source


def decide(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with source, order_key, size and row, and besides them source_size, target and copies."""
    chosen = _small(per_source).withColumnRenamed("source", "s")
    extra = F.coalesce((F.struct("order_key", "size", "row") <= F.col("cut")).cast("int"), F.lit(0))
    return rows.join(chosen, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", F.col("epochs") + extra).drop("s", "epochs", "cut")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target, taken of each row."""
    weighed = weigh(docs, key, text, source)
    decided = decide(weighed, stored(plan(weighed), "mix-plan"))
    return decided.select(F.col("ident").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows that the mix takes, with all their columns, each as often as it is taken."""
    weighed = weigh(docs, key, text, source, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    decided = decide(weighed, stored(plan(weighed), "mix-plan")).where("copies > 0")
    return decided.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")


SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
weighed AS (
  SELECT doc_id, source,
    len(regexp_extract_all(body, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / greatest(0.05::DOUBLE, length(regexp_replace(body, '[^\p{L}\p{N}\s]+', '', 'g'))::DOUBLE / greatest(length(body), 1)) AS order_key
  FROM base),
totals AS (SELECT source, sum(size)::BIGINT AS total FROM weighed GROUP BY source),
ranked AS (
  SELECT source, total, total * 3 AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM totals),
levels AS (
  SELECT *, (sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS one FROM ranked),
budget AS (
  SELECT source, total AS source_size, least(cap::DOUBLE, max(one) OVER () * weight) AS target FROM levels),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM budget),
placed AS (
  SELECT w.doc_id, w.size, s.source_size, s.target, s.epochs, s.target - s.epochs * s.source_size AS rest,
    sum(w.size) OVER (PARTITION BY w.source ORDER BY w.order_key, w.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w.size / 2.0::DOUBLE AS middle
  FROM weighed w JOIN shares s ON w.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed
"""
