"""Near duplicates by improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

A text is the weighted set of its five-word shingles (lower case, split at white space). The weight of a shingle is
(1 + 0.1 ln tf) * (1 - STRENGTH * (1 - idf)), where idf is ln(N / df) / ln(1 / COMMON) and 1 at most; N and df count
different texts, all of them. A shingle is common from a share of COMMON on; as a text has a bounded number of shingles on
average, so has the table of common ones, however many texts there are, and df is counted for each of them exactly.
STRENGTH keeps a group of near copies that holds a third of the corpus from making its own text light and its edits heavy.

Steps: (1) texts with equal words collapse by a 128-bit hash, so exact copies of any number cost one row. (2) Document
frequencies: a shingle that is common is so in some partition too, so candidates come from single partitions and are then
counted over all. (3) Each text gets BANDS x ROWS samples. (4) Texts that agree on one of the first bands meet, in chunks of
CHUNK, and links that hold by weighted Jaccard of the whole shingle sets make components. (5) Texts of different components
that agree on two bands meet, all of them: a bucket of several chunks is compared chunk by chunk, so no task holds more than
two. Work in a chunk is done where it lies: pairs are bounded by a matrix product and the rest compared exactly; only links
leave it, of a component as many as hold it together. Buckets with the same texts count once. (6) Components of all links,
by alternating large-star and small-star steps, are the classes.

A pair of similarity 0.8 shares two of 14 bands with probability 0.9933, of 0.85 with 0.9995; nothing depends on the size
of a bucket. Texts that lie just below the threshold of each other, in a group of n, cost n^2 / CHUNK rows.

Nulls: a text without words (null, empty, blank) is in no group; its class is its own id, and keep_one keeps it. A null id
is the last of all ids. Repeated rows, and different texts under one id, have the classes of their texts; keep_one goes by
texts. Very long texts count into chunks by their shingles. An empty table gives no row. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, map_batches, of_text, shingle_hashes, small_batches, stored, text_of

WIDTH = 5
THRESHOLD = 0.8
BANDS = 14
ROWS = 4
#: Bands by which texts meet for the first links.
FIRST = 4
#: Texts, and shingles, of a chunk.
CHUNK = 256
CHUNK_SHINGLES = 1 << 22
#: A shingle is common if so large a share of texts has it; the weight of one that all texts have is less by STRENGTH.
COMMON = 1 / 256
STRENGTH = 0.25
TF_STRENGTH = 0.1
#: What share of COMMON makes a shingle a candidate in a partition, and the least number of texts of such a partition.
SLACK = 0.25
LEAST_TEXTS = 4096
#: Rows of a few numbers are broadcast up to this many (some 40 MB); beyond it the join shuffles.
BROADCAST_IDS = 500_000

#: Quantiles of the Gamma distribution in a table; three tables of this size stay in a core's first cache.
_POOL = 1 << 11


def words_of(text: str) -> list[str]:
    return text.lower().split()


def hash_of(words: list[str]) -> bytes | None:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")) if words else None


def weighted_set(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit keys of the shingles, and how often each occurs."""
    h = shingle_hashes(words_of(text), WIDTH)
    return np.unique((h ^ (h >> np.uint64(32))).astype("<u4"), return_counts=True)


class Weights:
    """Weights of shingles, from the sorted keys of the common ones and their factors."""

    def __init__(self, common: np.ndarray, factors: np.ndarray) -> None:
        self.common, self.factors = np.append(common.astype(np.uint32), np.uint32(0)), np.append(factors.astype(np.float32), np.float32(1))

    def of(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.common[:-1], keys)
        idf = np.where(self.common[at] == keys, self.factors[at], np.float32(1))
        return (idf * (1 + TF_STRENGTH * np.log(counts))).astype(np.float32)


class Sampler:
    """ICWS: for each of k samples and each shingle, r and c are Gamma(2, 1) and b uniform, all by hash of the shingle."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2.0, 1.0, _POOL).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, _POOL)).astype(np.float32)
        self.xor = rng.integers(0, 1 << 63, samples, dtype=np.uint64)[:, None]
        self.odd = rng.integers(0, 1 << 63, samples, dtype=np.uint64)[:, None] | np.uint64(1)

    def sample(self, keys: np.ndarray, weights: np.ndarray, step: int = 512) -> np.ndarray:
        """One 32-bit value for each sample; equal with the probability of the weighted Jaccard similarity."""
        hashes = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
        log_w = np.log(weights).astype(np.float32)
        k = len(self.xor)
        best, out = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64)
        every = np.arange(k)
        for i in range(0, len(hashes), step):
            x = (hashes[None, i : i + step] ^ self.xor) * self.odd
            lanes = x.view("<u2").reshape(*x.shape, 4)  # the lowest 16 bits of a product mix worst and aren't used
            at_r = (lanes[..., 1] & np.uint16(_POOL - 1)).astype(np.intp)
            b = lanes[..., 3].astype(np.float32)
            b *= np.float32(1 / 65536)
            t = self.inverse.take(at_r)
            t *= log_w[None, i : i + step]
            t += b
            np.floor(t, out=t)
            a = self.r.take(at_r)
            b -= np.float32(1)
            a *= b - t
            a += self.log_c.take((lanes[..., 2] & np.uint16(_POOL - 1)).astype(np.intp))
            j = a.argmin(axis=1)
            low = a[every, j]
            less = low < best
            best[less] = low[less]
            chosen = hashes[i + j] + t[every, j].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out[less] = chosen[less]
        out ^= out >> np.uint64(31)
        return (out & np.uint64(0xFFFFFFFF)).astype("<u4")

    def bands(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each band's number and samples."""
        rows = self.sample(keys, weights).reshape(-1, ROWS).astype(np.uint64)
        out = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(ROWS):
            out = ((out ^ rows[:, k]) * np.uint64(0xBF58476D1CE4E5B9)) ^ (out >> np.uint64(30))
            out ^= out >> np.uint64(27)
        return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two weighted sets (sorted keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    total = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - shared
    return float(shared / total) if total else 0.0


def at_least(sets: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs of sets, the likeliest first, that may reach the threshold: the sum of minima is at most that of geometric
    means, a scalar product, which only grows where keys share a column of a smaller matrix."""
    n = len(sets)
    if n < 8:
        yield from ((i, j) for i in range(n) for j in range(i))
        return
    columns = 1 << int(np.clip(np.ceil(np.log2(16 * np.median([len(k) for k, _ in sets]) + 1)), 10, 15))
    m = np.zeros((n, columns), np.float32)
    for row, (k, w) in zip(m, sets, strict=True):
        row += np.bincount((k % np.uint32(columns)).astype(np.int64), np.sqrt(w), columns)
    shared, total = m @ m.T, np.array([w.sum(dtype=np.float64) for _, w in sets])
    bound = shared / np.maximum(total[:, None] + total[None, :] - shared, 1e-9)
    bound[shared >= (total[:, None] + total[None, :]) / 2] = 1
    i, j = np.nonzero(np.tril(bound >= threshold - 1e-3, -1))
    for p in np.argsort(-bound[i, j], kind="stable"):
        yield int(i[p]), int(j[p])


def links_within(sets: list[tuple[np.ndarray, np.ndarray]], labels: list[int], parts: list[int], threshold: float) -> list[tuple[int, int]]:
    """Pairs that are similar enough, as many as hold their components together. Texts of one label are linked already;
    where there are two parts, only pairs across them count."""
    above: dict = {}

    def root(x):
        while x in above:
            x = above[x]
        return x

    out, two = [], len(set(parts)) > 1
    for i, j in at_least(sets, threshold):
        if two and parts[i] == parts[j]:
            continue
        a, b = root(labels[i]), root(labels[j])
        if a != b and similarity(sets[i], sets[j]) >= threshold:
            above[a] = b
            out.append((i, j))
    return out


def vectors(docs: DataFrame) -> DataFrame:
    """key, words (their hash; null without words), shingle keys and counts of each row."""

    def run(b: dict) -> dict:
        out: dict = {"key": b["__key"], "words": [], "keys": [], "counts": []}
        for x in b["__text"].to_pylist():
            words = hash_of(words_of(x))
            k, n = weighted_set(x) if words else (None, None)
            out["words"].append(words)
            out["keys"].append(k.tobytes() if words else None)
            out["counts"].append((n.astype("<u4").tobytes() if n.max() > 1 else b"") if words else None)
        return out

    return map_batches(docs, run, "key long, words binary, keys binary, counts binary")


def _set(keys: bytes, counts: bytes, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, "<u4")
    return k, weights.of(k, np.frombuffer(counts, "<u4") if counts else np.ones(len(k), np.uint32))


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")


def weights_of(nodes: DataFrame) -> Weights:
    """Weights by document frequency over all nodes.

    A partition tells the keys that SLACK * COMMON of its texts have, with their number and that of its texts. Elsewhere a
    key is rarer than that, so a common key's numbers, less the share that these partitions would be allowed, still reach
    the rest of the whole; the keys that do are at most some shingles of a text / COMMON, and are then counted exactly.
    """
    small_batches(nodes.sparkSession)
    total = nodes.count()
    if total < 2:
        return Weights(np.empty(0, np.uint32), np.empty(0, np.float32))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held, keys, n, size = 0, [], np.empty(0, np.uint32), np.empty(0, np.int64), 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([n, *(np.ones(len(h), np.int64) for h in held)]), len(every)).astype(np.int64)

        for batch in batches:
            texts += len(batch)
            held.append(_keys(batch))
            size += len(held[-1])
            if size > 1 << 21:
                (keys, n), held, size = merged(), [], 0
        keys, n = merged()
        kept = n >= SLACK * COMMON * texts
        yield pa.RecordBatch.from_arrays([pa.array(keys[kept], pa.int64()), pa.array(n[kept]), pa.array(np.full(kept.sum(), texts))], names=["k", "n", "texts"])

    parts = max(1, min(nodes.rdd.getNumPartitions(), total // LEAST_TEXTS))
    sums = nodes.select("keys").coalesce(parts).mapInArrow(local, "k long, n long, texts long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    likely = sums.where((F.col("n") - SLACK * COMMON * F.col("texts") >= (1 - SLACK) * COMMON * total - 1e-6) & (F.col("n") > 1))
    found = np.sort(likely.select("k").toArrow()["k"].to_numpy()).astype(np.uint32)
    shared = nodes.sparkSession.sparkContext.broadcast(found)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.append(shared.value, np.uint32(0))
        out = np.zeros(len(wanted), np.int64)
        for batch in batches:
            k = _keys(batch)
            at = np.searchsorted(wanted[:-1], k)
            at[wanted[at] != k] = len(found)
            out += np.bincount(at, minlength=len(out))
        seen = np.flatnonzero(out[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(wanted[seen], pa.int64()), pa.array(out[seen])], names=["k", "n"])

    counted = nodes.select("keys").mapInArrow(exact, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    counted = counted.where(F.col("n") >= max(2, COMMON * total)).orderBy("k").toArrow()
    idf = np.minimum(1, np.log(total / counted["n"].to_numpy()) / np.log(1 / COMMON))
    return Weights(counted["k"].to_numpy(), 1 - STRENGTH * (1 - idf))


def signatures(nodes: DataFrame, weights: Weights) -> DataFrame:
    """node, number of shingles and the hashes of the bands."""
    shared = nodes.sparkSession.sparkContext.broadcast((weights, Sampler()))

    def run(b: dict) -> dict:
        w, sampler = shared.value
        sets = [_set(k, c, w) for k, c in zip(b["keys"].to_pylist(), b["counts"].to_pylist(), strict=True)]
        flat = np.concatenate([sampler.bands(*s) for s in sets]) if sets else np.empty(0, np.int64)
        return {"node": b["node"], "n_keys": [len(k) for k, _ in sets], "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(flat, pa.int64()))}

    return map_batches(nodes, run, "node long, n_keys long, bands array<long>")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast df if its row count, which is read here, is within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _groups(places: DataFrame, whole: bool) -> DataFrame:
    """group, part, node, label of places (bucket, node, label, n_keys), for buckets with texts of several labels. A bucket
    has as many chunks as its texts and shingles need. Every chunk is a group; if whole, so is every two chunks of a bucket.
    Of groups with the same texts one stays."""
    open_ = F.min("label") != F.max("label")
    sums = places.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_keys").alias("n_keys"), open_.alias("open")).where("open")
    sizes = sums.select("bucket", F.ceil(F.greatest(F.col("n") / CHUNK, F.col("n_keys") / CHUNK_SHINGLES)).alias("chunks"))
    cut = places.join(_few(stored(sizes, "near-sizes")), "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("chunks")))
    if whole:
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        cut = cut.withColumn("group", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")))
    else:
        cut = cut.withColumn("group", F.xxhash64("bucket", "part"))
    cut = stored(cut.select("group", "part", "node", "label"), "near-cut")
    alike = cut.groupBy("group").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64("part", "node")).alias("p"), open_.alias("open"))
    kept = alike.where("open").groupBy("n", "s", "p").agg(F.min("group").alias("group")).select("group")
    return cut.join(kept, "group")


def _linked(groups: DataFrame, nodes: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """a, b: links found in the groups."""
    groups = stored(groups, "near-groups")
    shared = nodes.sparkSession.sparkContext.broadcast(weights)
    rows = nodes.join(_few(groups), "node").select("group", "part", "node", "label", "keys", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[tuple]) -> pa.RecordBatch:
            found = links_within([_set(r[4], r[5], shared.value) for r in rows], [r[3] for r in rows], [r[1] for r in rows], threshold) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([rows[p[k]][2] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        at, held = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[0] != at:
                    if held:
                        yield solved(held)
                    at, held = r[0], []
                held.append(r)
        if held:
            yield solved(held)

    out = stored(rows.repartition("group").sortWithinPartitions("group", "node").mapInArrow(run, "a long, b long"), "near-links")
    drop_stored(groups)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, of every node that has an edge (a, b)."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-stars")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct(), "near-stars")
        if after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty():
            drop_stored(now)
            return after.select(F.col("u").alias("node"), F.col("v").alias("label"))
        drop_stored(now)
        now = after


def links(nodes: DataFrame, signed: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: links that hold the classes together. nodes: node, keys, counts; signed: node, n_keys, bands."""
    every = signed.select("node", "n_keys", F.posexplode("bands").alias("band", "bucket"))
    shared = stored(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "near-shared")
    places = stored(every.join(_few(shared), "bucket"), "near-places")
    first = places.where(F.col("band") < FIRST).withColumn("label", F.col("node"))
    edges = _linked(_groups(first, whole=False), nodes, weights, threshold)
    named = places.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = stored(named.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("bucket"), "near-open")
    bands = named.join(_few(several), "bucket").groupBy("node", "label", "n_keys").agg(F.array_sort(F.collect_list("bucket")).alias("bands"))
    two = F.flatten(F.transform("bands", lambda x, i: F.transform(F.slice("bands", i + 2, BANDS), lambda y: F.xxhash64(x, y))))
    second = stored(bands.select("node", "label", "n_keys", F.explode(two).alias("bucket")), "near-pairs")
    more = _linked(_groups(second, whole=True), nodes, weights, threshold)
    drop_stored(shared, places, second)
    return edges.unionByName(more)


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows (key, words) of docs, and of each different text its words' hash, node (the first row), label, least key and number
    of rows."""
    frame = docs.select(F.col(f"`{key}`").cast("long").alias("__key"), text_of(text).alias("__text"))
    rows = stored(vectors(frame).withColumn("row", F.monotonically_increasing_id()), "near-vectors")
    sums = rows.where("words is not null").groupBy("words").agg(F.min("key").alias("key"), F.min("row").alias("node"), F.count("*").alias("rows"))
    ids = stored(sums, "near-ids")
    copies = rows.select("words", "row").join(ids.where("rows > 1").select("words", "node"), "words").where("row <> node").select("row")
    copies = stored(copies, "near-copies")
    nodes = rows.where("words is not null")
    if copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        nodes = nodes.join(F.broadcast(copies), "row", "left_anti")
    else:
        nodes = stored(nodes.join(copies, "row", "left_anti"), "near-nodes")
    nodes = nodes.select(F.col("row").alias("node"), "keys", "counts")
    weights = weights_of(nodes)
    signed = stored(signatures(nodes, weights), "near-signed")
    edges = links(nodes, signed, weights, threshold)
    label = stored(ids.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node")), "near-labels")
    drop_stored(ids, copies, signed, edges)
    return rows.select("key", "words"), label


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key and class_id, the least key of its class, of each row."""
    rows, label = labelled(docs, key, text, threshold)
    least = label.groupBy("label").agg(F.min("key").alias("class_id"))
    of_text = label.join(least, "label").select("words", "class_id")
    return rows.join(of_text, "words", "left").select(F.col("key").alias(key), F.when(F.col("words").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without those whose class has a row of a lesser id (nulls last, then by hash of the words), with all
    their columns; of rows with equal words and ids one stays."""
    rows, label = labelled(docs, key, text, threshold)
    best = label.groupBy("label").agg(F.min(F.struct(F.col("key").isNull(), "key", "words")).alias("best"))
    judged = label.join(best, "label").select("words", (F.col("best.words") == F.col("words")).alias("best"), F.col("key").alias("least"), "rows")
    # texts that stand alone in their class and in the table aren't looked up
    judged = stored(judged.where("NOT best OR rows > 1").drop("rows"), "near-judged")
    small_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = docs.select(row, F.col(f"`{key}`").cast("long").alias("key"), of_text(lambda x: hash_of(words_of(x)), "binary", text).alias("of"))
    found = found.join(_few(judged), F.col("of") == F.col("words"), "left").where(F.col("words").isNull() | (F.col("best") & F.col("key").eqNullSafe(F.col("least"))))
    again = rows.where("words is not null").groupBy("words", "key").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return found.select("row.*")
    once = found.where("words is not null").dropDuplicates(["words"])
    return found.where("words is null").unionByName(once).select("row.*")
