"""Incremental state on immutable tables: upserts, insert-ignore, replaced children, cursors, dedup keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.resolve import saved


def latest_wins(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert of whole rows: a key of the new table replaces the old row."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The rows to add: first of each key by `order`, whose key isn't there yet."""
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))).where("__n = 1").drop("__n")
    return first.join(old.select(*keys), list(keys), "left_anti")


def upsert_columns(old: DataFrame, new: DataFrame, keys: Sequence[str], owned: Sequence[str]) -> DataFrame:
    """Only the owned columns of a known key change; unknown keys are inserted with nulls elsewhere."""
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in owned], F.lit(True).alias("__new"))
    value = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in owned else F.col(c)
    return old.join(n, list(keys), "full").select(*[value(c) for c in old.columns])


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of a parent that comes again are replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def sync_status(local: DataFrame, remote: DataFrame, key: str, *columns: str) -> DataFrame:
    """key, status: create, unchanged, conflict, or remote_only."""
    a = local.select(key, F.struct(*columns).alias("__l"))
    b = remote.select(key, F.struct(*columns).alias("__r"))
    status = F.when(F.col("__r").isNull(), "create").when(F.col("__l").isNull(), "remote_only").when(F.col("__l").eqNullSafe(F.col("__r")), "unchanged").otherwise("conflict")
    return a.join(b, key, "full").select(key, status.alias("status"))


def dedup_key(fields: Sequence[Column], ordinal: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in fields], ordinal.cast("string")), 256)


def with_dedup_keys(rows: DataFrame, partition: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Numbers equal rows, from 0, so that two real bookings that look alike get two keys, and the same ones when re-read."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
    return rows.withColumn("ordinal", n).withColumn("dedup_key", dedup_key([F.col(c) for c in partition], F.col("ordinal")))


def cursors(rows: DataFrame, key: str, day: Column, today: Column, overlap: int = 7, first: int = 90) -> DataFrame:
    """Per key: where the next read starts, some days before the latest row, or `first` days back without one."""
    return rows.groupBy(key).agg(F.max(day).alias("latest")).select(key, F.coalesce(F.date_sub("latest", overlap), F.date_sub(today, first)).alias("since"))


def next_numbers(existing: DataFrame, new: DataFrame, group: str, number: str, order: str) -> DataFrame:
    """Numbers new rows of each group on from its largest number."""
    top = existing.groupBy(group).agg(F.max(number).alias("__top"))
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return new.withColumn("__n", n).join(top, group, "left").withColumn(number, F.coalesce(F.col("__top"), F.lit(-1)) + F.col("__n")).drop("__n", "__top")


def ranks(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds each row's place in its group, from 0, by an order without ties. Rows are range-partitioned by group and order, so
    that a hot group is spread over many tasks; counts per partition give each one's first place."""
    spread = saved(rows.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()))
    counts = spread.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1
    placed = spread.withColumn("__inside", inside).join(first, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return placed.withColumn(name, F.col("__first") + F.col("__inside")).drop("__part", "__inside", "__g", "__p", "__first")


def splits(rows: DataFrame, group: str, order: str, modulus: int = 5, held: Sequence[int] = (1, 3)) -> DataFrame:
    """Adds split: test for the places 1 and 3 of each five in a group's order, else train."""
    placed = ranks(rows, group, [order], "__place")
    return placed.withColumn("split", F.when((F.col("__place") % modulus).isin(*held), "test").otherwise("train")).drop("__place")


def evenly_spaced(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """k rows of each group, in the middle of k equal steps through its order; small groups are taken whole."""
    placed = ranks(rows, group, [order], "__place")
    sizes = placed.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    step = F.col("__n") / F.lit(k)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(step * i + step / 2))
    sized = placed.join(sizes, F.col(group).eqNullSafe(F.col("__g")))
    return sized.where((F.col("__n") <= k) | F.array_contains(wanted, F.col("__place"))).drop("__place", "__n", "__g")


def doomed(parents: DataFrame, items: DataFrame, keep: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
    """Keys of parents to delete: replaced, or referred to by no item, unless protected by `keep`."""
    used = items.select(key).where(F.col(key).isNotNull()).distinct()
    unused = parents.select(key).join(used, key, "left_anti").union(parents.select(key).join(replaced.select(key), key, "left_semi"))
    return unused.distinct().join(keep, key, "left_anti")


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """One row for each key: the values of its first row in an order. A reduction, so that no key is sorted as a whole."""
    top = F.min(F.struct(*order, *[F.col(v).alias(f"__{v}") for v in values])).alias("__top")
    return rows.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__top.__{v}").alias(v) for v in values])
