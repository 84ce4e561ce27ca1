"""Merkle fixity audit of WARC records, in DataFrame operations.

Pages are WARC resource records with the mandatory fields. Ids are cut into ranges, some FANOUT records in each if ids are
spread evenly; the cut (least id, width, and parts of the ranges that hold too much) comes from the primary and serves every
replica, so that a record that is lost or added changes the trees only on the way from its range to the root.

Within a range records stand in the order of id, URL and hash; equal records are one entry with a number of copies. A range's
hash covers, in order, the offsets at which its entries begin and end, counted from its own start, and the SHA-256 of their
bytes. Every FANOUT consecutive ranges, and so on, make a node, whose hash covers the offset ranges and hashes of its
children, up to one root. Absolute offsets come down the same tree, from the sizes of the children before, so no task ever
sorts or sums all rows, whatever the ids.

Replicas are compared by their roots; of a node that differs only the children are compared, down to the records, which are
then matched by id and URL: equal bytes are "ok", other bytes "corrupt", a record that the replica lacks is "missing", one
that it has besides is "extra". Of equal records so many are missing or extra as their numbers differ.

Nulls: a null url or html counts as an empty one; null ids come first, in a range that is parted by URL and text. Repeated
rows stay, each at its own offset. Texts of any length are hashed whole; only hashes are kept. An empty table has no record,
and a null root. Other columns may have any name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

FANOUT = 16
#: A range of more entries is parted by a hash of id and URL.
MOST = 1024
#: Suspect nodes, and parted ranges, are broadcast up to this number; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"


class Cut(NamedTuple):
    """How ids fall into ranges: FANOUT ** height of them between the least and the largest id."""

    least: int
    width: int
    height: int
    parts: DataFrame  # range, parts; only of those that hold more than MOST entries


def record_of(key: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC record, as a string."""
    body, url = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    digest = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), url))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = ["WARC/1.0", "WARC-Type: resource", F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")), f"WARC-Date: {DATE}", F.concat(F.lit("WARC-Target-URI: "), url), "Content-Type: text/html", F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *[F.lit(x) if isinstance(x, str) else x for x in head]), F.lit(CRLF * 2), body, F.lit(CRLF * 2))


def entries(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, hash, length and copies of each different record."""
    k, u = F.col(f"`{key}`").cast("long"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    record = record_of(k, u, F.col(f"`{html}`").cast("string"))
    each = pages.select(k.alias("key"), u.alias("url"), F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("hash"))
    return stored(each.groupBy("key", "url", "hash", "length").agg(F.count("*").alias("copies")), "warc-entries")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _range(least: int, width: int, height: int) -> Column:
    """0 for null ids, else from 1 on; ids beyond the primary's fall into the first and the last range."""
    at = F.expr(f"(CAST(key AS DECIMAL(20, 0)) - {least}BD) DIV {width}BD") + 1
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(FANOUT**height - 1), at)).cast("long"), F.lit(0).cast("long"))


def cut_of(primary: DataFrame) -> Cut:
    """From the primary's entries."""
    n, low, high = primary.agg(F.count("*"), F.min("key"), F.max("key")).first()
    low, high, height = low or 0, high or 0, 0
    while FANOUT ** (height + 1) < n:
        height += 1
    ranges = max(1, FANOUT**height - 1)
    width = -(-(high - low + 1) // ranges)
    sizes = primary.groupBy(_range(low, width, height).alias("range")).agg(F.count("*").alias("n")).where(F.col("n") > MOST)
    return Cut(low, width, height, stored(sizes.select("range", F.ceil(F.col("n") / MOST).alias("parts")), "warc-parts"))


def placed(found: DataFrame, cut: Cut) -> DataFrame:
    """Entries with range, part and the offset within both."""
    rows = found.withColumn("range", _range(cut.least, cut.width, cut.height)).join(_few(cut.parts), "range", "left")
    spread = F.when(F.col("key").isNull(), F.xxhash64("url", "hash")).otherwise(F.xxhash64("key", "url"))
    rows = rows.withColumn("part", F.coalesce(F.pmod(spread, F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    before = Window.partitionBy("range", "part").orderBy(F.col("key").asc_nulls_first(), "url", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return stored(rows.withColumn("inside", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0))), "warc-placed")


def _node(start: str, size: Column, *order: str) -> list[Column]:
    """hash and bytes of a node from its children in order: of each the range of offsets and the hash."""
    child = F.struct(*order, F.concat_ws(":", F.col(start), F.col(start) + size, "hash").alias("said"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["said"]), ",")
    return [F.sha2(said, 256).alias("hash"), F.sum(size).alias("bytes")]


def tree(rows: DataFrame, cut: Cut) -> list[DataFrame]:
    """Levels of (id, hash, bytes, inside), from the parts of the ranges, whose id is (range, part), to the root. inside is
    the offset within the parent."""
    parts = rows.groupBy("range", "part").agg(*_node("inside", F.col("length") * F.col("copies"), "inside"))
    before = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = [stored(parts.withColumn("inside", F.coalesce(F.sum("bytes").over(before), F.lit(0))), "warc-nodes")]
    node = found[0].groupBy(F.col("range").alias("id")).agg(*_node("inside", F.col("bytes"), "part"))
    for _ in range(cut.height):
        before = Window.partitionBy(F.expr(f"id DIV {FANOUT}L")).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        found.append(stored(node.withColumn("inside", F.coalesce(F.sum("bytes").over(before), F.lit(0))), "warc-nodes"))
        node = found[-1].groupBy(F.expr(f"id DIV {FANOUT}L").alias("id")).agg(*_node("inside", F.col("bytes"), "id"))
    found.append(stored(node.withColumn("inside", F.lit(0).cast("long")), "warc-nodes"))
    return found


def root_of(levels: list[DataFrame]) -> str | None:
    top = levels[-1].first()
    return top["hash"] if top else None


def suspects(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """range and part where two trees differ; children are compared only below a node that differs."""
    found = None
    for a, b in zip(reversed(one), reversed(other), strict=True):
        keys = [c for c in ("id", "range", "part") if c in a.columns]
        if found is not None:
            parent = F.col("range") if "range" in keys else F.expr(f"id DIV {FANOUT}L")
            narrow = _few(found.select(F.col("id").alias("suspect")))
            a, b = (x.join(narrow, parent == F.col("suspect"), "left_semi") for x in (a, b))
        pair = a.select(*keys, "hash").join(b.select(*keys, F.col("hash").alias("other")), keys, "full")
        found = stored(pair.where(~F.col("hash").eqNullSafe(F.col("other"))).select(*keys), "warc-suspects")
    return found


def offsets(levels: list[DataFrame]) -> DataFrame:
    """range, part and the offset in the file at which each part begins, down the tree."""
    above = levels[-1].select("id", F.col("inside").alias("at"))
    for level in reversed(levels[1:-1]):
        parent = above.select(F.col("id").alias("parent"), F.col("at").alias("base"))
        above = stored(level.join(parent, F.expr(f"id DIV {FANOUT}L") == F.col("parent")).select("id", (F.col("base") + F.col("inside")).alias("at")), "warc-offsets")
    return levels[0].join(above, F.col("range") == F.col("id")).select("range", "part", (F.col("at") + F.col("inside")).alias("at"))


def differences(ours: DataFrame, theirs: DataFrame, where: DataFrame) -> DataFrame:
    """key, url, hash, status and number of the entries that differ, in the ranges of `where`; hash is the primary's, or that
    of an extra record."""
    a, b = (x.join(_few(where), ["range", "part"], "left_semi").select("key", "url", "hash", "copies") for x in (ours, theirs))
    b = b.select(F.col("key").alias("k"), F.col("url").alias("u"), F.col("hash").alias("h"), F.col("copies").alias("c"))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("url") == F.col("u")) & (F.col("hash") == F.col("h"))
    pair = a.join(b, same, "full").withColumn("more", F.coalesce("copies", F.lit(0)) - F.coalesce("c", F.lit(0))).where("more <> 0")
    pair = stored(pair.select(F.coalesce("key", "k").alias("key"), F.coalesce("url", "u").alias("url"), F.coalesce("hash", "h").alias("hash"), "more"), "warc-pairs")
    # copies of one id and URL that only the primary has meet those that only the replica has, as many as both have
    before = Window.partitionBy("key", "url", "lost").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    per_page = Window.partitionBy("key", "url")
    sums = pair.withColumn("lost", F.col("more") > 0).withColumn("before", F.coalesce(F.sum(F.abs("more")).over(before), F.lit(0)))
    sums = sums.withColumn("both", F.least(F.sum(F.when(F.col("lost"), F.col("more")).otherwise(0)).over(per_page), F.sum(F.when(~F.col("lost"), -F.col("more")).otherwise(0)).over(per_page)))
    changed = F.greatest(F.lit(0), F.least(F.abs("more"), F.col("both") - F.col("before")))
    split = sums.withColumn("changed", changed).select("key", "url", "hash", F.explode(F.array(
        F.struct(F.lit("corrupt").alias("status"), F.when(F.col("lost"), F.col("changed")).otherwise(0).alias("number")),
        F.struct(F.when(F.col("lost"), "missing").otherwise("extra").alias("status"), (F.abs("more") - F.col("changed")).alias("number")),
    )).alias("d"))
    return stored(split.select("key", "url", "hash", "d.*").where("number > 0"), "warc-differences")


def audit(primary: DataFrame, replica: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Each record of the primary with its offset range, its hash and its status in the replica, and each extra record of the
    replica, without offset; both roots stand in every row."""
    mine = entries(primary, key, url, html)
    cut = cut_of(mine)
    ours, theirs = placed(mine, cut), placed(entries(replica, key, url, html), cut)
    trees = tree(ours, cut), tree(theirs, cut)
    wrong = differences(ours, theirs, suspects(*trees))
    roots = [F.lit(root_of(t)).cast("string").alias(n) for t, n in zip(trees, ("primary_root", "replica_root"), strict=True)]
    bad = wrong.where("status <> 'extra'").groupBy(F.col("key").alias("k"), F.col("url").alias("u"), F.col("hash").alias("h")).agg(
        F.sum(F.when(F.col("status") == "corrupt", F.col("number")).otherwise(0)).alias("corrupt"), F.sum(F.when(F.col("status") == "missing", F.col("number")).otherwise(0)).alias("missing"))
    rows = ours.join(offsets(trees[0]), ["range", "part"]).join(_few(bad), F.col("key").eqNullSafe(F.col("k")) & (F.col("url") == F.col("u")) & (F.col("hash") == F.col("h")), "left")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    status = F.when(F.col("i") < F.col("corrupt"), "corrupt").when(F.col("i") < F.col("corrupt") + F.col("missing"), "missing").otherwise("ok")
    found = rows.select(F.col("key").alias(key), F.col("url").alias(url), (F.col("at") + F.col("inside") + F.col("i") * F.col("length")).alias("record_offset"), F.col("length").alias("record_length"), F.col("hash").alias("leaf_sha256"), status.alias("status"), *roots)
    none = F.lit(None).cast("long")
    extra = wrong.where("status = 'extra'").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("number"))))
    extra = extra.select(F.col("key").alias(key), F.col("url").alias(url), none.alias("record_offset"), none.alias("record_length"), F.col("hash").alias("leaf_sha256"), "status", *roots)
    drop_stored(mine, *trees[0][1:-1], *trees[1])
    return found.unionByName(extra)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica for trials, by a hash of the id: of some pages the first character is lost, some are missing, some stand
    there once more under an id of their own."""
    digest = F.sha2(F.concat(F.lit("rot:"), F.col("page_id").cast("string")), 256)
    rot = F.when(digest.startswith("00"), F.concat(F.lit("#"), F.substr(F.col("html"), F.lit(2)))).otherwise(F.col("html"))
    kept = pages.where(F.coalesce(~digest.startswith("01"), F.lit(True))).withColumn("html", rot)
    more = pages.where(digest.startswith("02")).withColumn("page_id", -F.col("page_id") - 1)
    return kept.unionByName(more)


def _sql() -> str:
    """For ids that aren't null, without repeated rows, and at most 16 ** 6 of them."""
    body, crlf = "coalesce(html, '')", "chr(13) || chr(10)"
    digest = "md5(coalesce(page_id::VARCHAR, 'null') || '|' || coalesce(url, ''))"
    uuid = " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    head = ["'WARC/1.0'", "'WARC-Type: resource'", f"'WARC-Record-ID: <urn:uuid:' || {uuid} || '>'", f"'WARC-Date: {DATE}'", "'WARC-Target-URI: ' || coalesce(url, '')", "'Content-Type: text/html'", f"'Content-Length: ' || strlen({body})::VARCHAR"]
    record = f" || {crlf} || ".join(head) + f" || {crlf} || {crlf} || {body} || {crlf} || {crlf}"
    rot = "sha256('rot:' || page_id::VARCHAR)"
    parts = [
        f"damaged AS (SELECT page_id, url, CASE WHEN {rot} LIKE '00%' THEN '#' || substr(html, 2) ELSE html END AS html FROM pages WHERE coalesce({rot} NOT LIKE '01%', true) UNION ALL SELECT -page_id - 1, url, html FROM pages WHERE {rot} LIKE '02%')",
        *(f"{n}_rows AS (SELECT page_id, coalesce(url, '') AS url, strlen({record})::BIGINT AS length, sha256({record}) AS hash FROM {t})" for n, t in (("a", "pages"), ("b", "damaged"))),
        f"cut AS (SELECT *, greatest(1, {FANOUT} ** height - 1)::BIGINT AS ranges FROM (SELECT count(*) AS n, min(page_id) AS low, max(page_id) AS high, {' + '.join(f'({FANOUT ** (k + 1)} < count(*))::INT' for k in range(6))} AS height FROM a_rows))",
    ]
    for n in "ab":
        at = "greatest(1, least(16 ** height - 1, (page_id - low) // ((high - low + ranges) // ranges) + 1))::BIGINT"
        parts.append(f"{n}_placed AS (SELECT r.*, height, {at} AS id, coalesce(sum(length) OVER (PARTITION BY {at} ORDER BY page_id, url, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS inside FROM {n}_rows r, cut)")
        parts.append(f"{n}_p AS (SELECT id, height, sha256(string_agg(inside || ':' || (inside + length) || ':' || hash, ',' ORDER BY inside)) AS part, sum(length)::BIGINT AS bytes FROM {n}_placed GROUP BY ALL)")
        parts.append(f"{n}_0 AS (SELECT id, height, sha256('0:' || bytes || ':' || part) AS hash, bytes FROM {n}_p)")
        for k in range(6):
            parts.append(f"{n}_{k}o AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY id // {FANOUT} ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS inside FROM {n}_{k})")
            parts.append(f"{n}_{k + 1} AS (SELECT id // {FANOUT} AS id, height, CASE WHEN height > {k} THEN sha256(string_agg(inside || ':' || (inside + bytes) || ':' || hash, ',' ORDER BY id)) ELSE min(hash) END AS hash, sum(bytes)::BIGINT AS bytes FROM {n}_{k}o GROUP BY id // {FANOUT}, height)")
    return (
        "WITH " + ",\n".join(parts) + """,
paired AS (SELECT a.page_id AS a_id, b.page_id AS b_id, a.url AS a_url, b.url AS b_url, a.length, a.hash AS a_hash, b.hash AS b_hash,
    CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra' WHEN a.hash <> b.hash THEN 'corrupt' ELSE 'ok' END AS status
  FROM a_rows a FULL JOIN b_rows b ON a.page_id = b.page_id AND a.url = b.url)
SELECT coalesce(a_id, b_id) AS page_id, coalesce(a_url, b_url) AS url,
  CASE WHEN status <> 'extra' THEN (sum(length) OVER (ORDER BY a_id NULLS LAST, a_url, a_hash ROWS UNBOUNDED PRECEDING) - length)::BIGINT END AS record_offset,
  length AS record_length, coalesce(a_hash, b_hash) AS leaf_sha256, status, (SELECT hash FROM a_6) AS primary_root, (SELECT hash FROM b_6) AS replica_root FROM paired"""
    )


SQL = _sql()
