"""What five document filters remove together, in every order, with duplicates found by sorting.

Filters: A too few words, B too many repeated words, C too many capitals, D marks, E a copy of a text with a smaller id. A
document's failures are a mask of five bits; all counts of the audit are sums over masks, so the texts are read once.

Duplicates: rows are dealt by ranges of (fingerprint of the text, id), so that copies of one text, however many, go to as
many tasks as they fill, and are sorted by fingerprint, full text and id within each range. Every row is compared with the
one before it; a run of equal texts starts with its smallest id. Runs that a range's first or last fingerprint belongs to may
go on in another range: each task writes one row with the text of such a run, these are grouped by text, and the smallest
ids found come back as one small row per run. The ranges' bounds are drawn from fingerprints and ids, so no text goes to
the driver. Sorting spills; a lost executor repeats its ranges, and the sorted pass is written to the shared folder.

Counters: rows are counted by (id, part, mask) before the join with labels, then by (part, mask, label), which leaves at most
128 numbers for each part; the 600 steps of all orders are computed from these.

Nulls: a null text is an empty one, a null part is the part of the empty string, a null id is neither smaller than another nor
has a smaller one, and has no label. Equal ids are not smaller than each other, so repeated rows of the smallest id all stay.
An id with several labels counts as good or toxic if any of them says so, and null labels say neither. An empty text has no
words and no code points: it fails A, not B or C. Very long texts are rows like others. An empty table gives no row. Other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, small_batches, stored, text_of

FILTERS = "ABCDE"
WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 3
MARKS = b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_SORTED = "doc_id long, part string, mask int, task int, run int, first_id long, text binary"


def own_mask(text: bytes) -> int:
    """Filters A to D over a text in UTF-8: bit 0 for A. bytes.split() parts at exactly the white space of the rule."""
    words = text.split()
    n, points = len(words), len(text.translate(None, _FOLLOWING))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (n < WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1
        | (100 * capitals > CAPITALS_PERCENT * points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a sorted range, and one with the text for each run that may go on elsewhere: of the
    first and of the last fingerprint. In documents' rows run numbers such a run, if the row is in one of the first
    fingerprint; rows of the last one may be told only at its end, so all rows carry their run's number."""
    task = TaskContext.get().partitionId()
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("task", pa.int32()), ("run", pa.int32()), ("first_id", pa.int64()), ("text", pa.binary())])
    run, mask, first_id = -1, 0, None
    print_before = text_before = None
    first_print, edge = None, []  # runs of the fingerprint at hand: run, smallest id, text
    for batch in batches:
        rows: list[tuple] = []
        for found, text, key, part in zip(*(batch.column(n).to_pylist() for n in ("fingerprint", "text", "doc_id", "part")), strict=True):
            if found != print_before or text != text_before:
                if found != print_before:
                    if print_before is not None and print_before == first_print:
                        rows += [(None, None, None, task, r, i, t) for r, i, t in edge]
                    first_print = found if run < 0 else first_print
                    edge = []
                run, mask, first_id = run + 1, own_mask(text), None
                edge.append([run, None, text])
            if first_id is None:  # nulls come first
                first_id = edge[-1][1] = key
            rows.append((key, part, mask, task, run, first_id, None))
            print_before, text_before = found, text
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    if edge:  # those of the first fingerprint, if it is the only one, come here too
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((None, None, None, task, r, i, t) for r, i, t in edge), strict=True), schema, strict=True)], schema=schema)


def sorted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", partitions: int | None = None) -> DataFrame:
    """The sorted pass, stored: see _compared()."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text_of(text).alias("__text"))
    rows = rows.select("doc_id", "part", F.xxhash64("__text").alias("fingerprint"), F.col("__text").cast("binary").alias("text"))
    keys = ("fingerprint", "doc_id")
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    small_batches(docs.sparkSession)
    return stored(dealt.sortWithinPartitions("fingerprint", "text", "doc_id").mapInArrow(_compared, _SORTED), "filter-runs")


def masks(runs: DataFrame) -> DataFrame:
    """doc_id, part and mask of each document, all five filters."""
    edges = runs.where(F.col("text").isNotNull())
    smallest = edges.groupBy("text").agg(F.min("first_id").alias("smallest"), F.collect_set(F.struct("task", "run")).alias("places"), F.count("*").alias("n"))
    # a few runs for each task, however the rows are spread; AQE broadcasts them where they are small, by their measured size
    known = smallest.where("n > 1").select(F.explode("places").alias("place"), "smallest").select("place.task", "place.run", "smallest")
    rows = runs.where(F.col("text").isNull()).join(known, ["task", "run"], "left")
    copy = F.coalesce(F.col("doc_id") > F.least("first_id", "smallest"), F.lit(False))  # least() leaves nulls out
    return rows.select("doc_id", "part", F.col("mask").bitwiseOR(copy.cast("int") * (1 << FILTERS.index("E"))).alias("mask"))


def counters(found: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """n, good and toxic documents by part and mask."""
    counted = found.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("doc_id"))
    marks = marks.agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(f"__{c}") for c in ("quality", "toxic")))
    sums = [F.sum(F.col("n") * F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
    return counted.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, the mask of the filters before it and its filter's bit."""
    return [("".join(order), k + 1, sum(1 << FILTERS.index(f) for f in order[:k]), 1 << FILTERS.index(order[k])) for order in permutations(FILTERS) for k in range(len(FILTERS))]


def audit(counted: DataFrame) -> DataFrame:
    """One row for each part, order and step."""
    every = range(1 << len(FILTERS))
    by_mask = [F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in every)).alias(f"__{c}") for c in ("n", "good", "toxic")]
    table = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(f).alias("own")) for o, s, b, f in steps()))
    rows = counted.groupBy("part").agg(*by_mask).select("*", F.inline(table))
    before, own = F.col("before"), F.col("own")

    def total(name: str, wanted, times=None) -> Column:
        picked = F.transform(f"__{name}", lambda n, m: F.when(wanted(m), n * (times(m) if times else 1)).otherwise(0))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, n: a + n)

    fails = lambda m: m.bitwiseAND(own) != 0
    first = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    # of all orders, the filter comes first among the k that a document fails in one of k
    share = lambda m: (F.lit(120) / F.bit_count(m)).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", first).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"),
        total("n", fails, share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", partitions: int | None = None) -> DataFrame:
    """The whole audit; the counters, 128 numbers a part at most, are stored, and the sorted pass is dropped."""
    runs = sorted_runs(docs, key, text, part, partitions)
    counted = stored(counters(masks(runs), labels, key), "filter-counters")
    drop_stored(runs)
    return audit(counted)


#: The audit row by row, with copies by grouping.
SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS smallest FROM documents
), cut AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM docs),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > smallest THEN 'E' ELSE '' END) AS fails
  FROM cut LEFT JOIN marks USING (doc_id)
), counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a JOIN letters b ON a.f <> b.f JOIN letters c ON c.f NOT IN (a.f, b.f)
  JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), steps AS (SELECT o, s, substr(o, s, 1) AS own, substr(o, 1, s - 1) AS earlier FROM orders, range(1, 6) t(s)),
told AS (
  SELECT part, o, s, n, good, bad, fails = own AS alone, contains(fails, own) AS failing,
    earlier <> '' AND regexp_matches(fails, '[' || earlier || '_]') AS gone FROM counted, steps
), summed AS (
  SELECT part, o, s, substr(o, s, 1) AS own,
    coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost, coalesce(sum(bad) FILTER (NOT gone AND failing), 0) AS toxic_lost
  FROM told GROUP BY part, o, s
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""
