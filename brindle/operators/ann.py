"""Vector search for many queries at once: exact in blocks, and an inverted file with product codes.

Exact: rows and queries are parted into groups; a pair of groups is a task's matrix products, of which each query keeps its k
best, and these are merged. What is sent on grows with groups times queries, not with pairs.

Index: cells are the nearest of some centroids, and what is left of a vector is written as one byte for each of some
subspaces. Both are trained by k-means on a sample of at most `sample` rows, those whose ids hash lowest; every row is indexed.
The index is partitioned by cell, so a search reads the files of the cells that its queries look into. Within a cell, rows
stand in blocks of at most BLOCK, so that a cell full of copies is many tasks' work. A query scores a block's codes by a table
look-up for each subspace, keeps its best, and the best of all its cells are scored again with the vectors themselves. Rows of
equal codes score alike; of these a query keeps the k first by id, so that copies of one vector don't crowd out the others.

How many cells a query looks into is found on the sample: the least number that holds `target` of the nearest neighbours there.

Vectors are compared by cosine. Rows without a vector, with a zero one or one of another length than most are left out. Ties go
by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.resolve import dropped, saved

BLOCK = 4096
ROWS, QUERIES = 32_768, 8192
SAMPLE = 20_000
HITS = "case_id long, parent_id long, score double"


def unit_vectors(rows: DataFrame, ident: str, vector: str = "embedding") -> DataFrame:
    """id and the vector as bytes of doubles of length 1."""
    found = rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
    width = found.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                norm = np.linalg.norm(x, axis=1)
                yield pd.DataFrame({"id": b["id"], "v": [r.tobytes() for r in x / np.where(norm > 0, norm, 1)[:, None]]})[norm > 0]

    return found.where(F.size("v") == (width.d if width else 0)).mapInPandas(run, "id long, v binary")


def _matrix(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row of scores, the places of its k best, ties by id."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores))
    return order[:, :k]


def ranked_hits(hits: DataFrame, k: int) -> DataFrame:
    """case_id, parent_id, score, rank of the k best of each case; ties by parent."""
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), "parent_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the k best of each row, ties by place; only what reaches the kth score is sorted."""
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else scores.min(axis=1)
    row, at = np.nonzero(scores >= least[:, None])
    order = np.lexsort((at, -scores[row, at], row))
    row, at = row[order], at[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], at[kept]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """The k nearest rows of every query; both as of unit_vectors(). Scores are rounded before they are ranked.

    Rows and queries are parted by hash into groups of some ROWS and QUERIES; a group of each meets in one task, which holds
    no others. Rows are sent once for each group of queries, and queries once for each group of rows."""
    rows, asked = saved(vectors.select("id", "v")), saved(queries.select("id", "v"))
    n, m = max(1, -(-rows.count() // ROWS)), max(1, -(-asked.count() // QUERIES))

    def sent(side: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(own)
        return side.select("id", "v", part, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)).groupBy("r", "q")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"case_id": [], "parent_id": [], "score": []})
        left = left.sort_values("id", kind="stable")
        ids, cases, x, y = left["id"].to_numpy(), right["id"].to_numpy(), _matrix(left["v"].tolist()).T, _matrix(right["v"].tolist())
        out = []
        for start in range(0, len(y), 64):
            scores = np.round(y[start : start + 64] @ x, digits)
            q, at = _top(scores, k)
            out.append((cases[start + q], ids[at], scores[q, at]))
        return pd.DataFrame(dict(zip(("case_id", "parent_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return ranked_hits(sent(rows, "r", n, "q", m).cogroup(sent(asked, "q", m, "r", n)).applyInPandas(run, HITS), k)


def _leading(scores: np.ndarray, ids: np.ndarray, values: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and place of the rows that have one of the best `values` different scores, at most k of each, by id."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores))
    ranked = np.take_along_axis(scores, order, axis=1)
    place = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    new = np.concatenate([np.zeros((len(scores), 1), bool), ranked[:, 1:] != ranked[:, :-1]], axis=1)
    kept = (new.cumsum(axis=1) < values) & (place - np.maximum.accumulate(np.where(new, place, 0), axis=1) < k)
    q, at = np.nonzero(kept)
    return q, order[q, at]


class Model(NamedTuple):
    """Centroids of the cells, the codes' values (subspace, code, dimension) and the cells that a query looks into."""

    centroids: np.ndarray
    codes: np.ndarray
    probes: int


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(part @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1) for part in np.array_split(x, -(-len(x) // 4096) or 1)]) if len(x) else np.empty(0, np.int64)


def train(vectors: DataFrame, cells: int | None = None, subspaces: int = 16, sample: int = SAMPLE, target: float = 0.97, k: int = 10, seed: int = 5) -> Model | None:
    """Centroids, codes and probes from the sample, which alone comes to the driver; None for an empty table."""
    rows = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").collect()
    if not rows:
        return None
    x, rng = np.unique(_matrix([r.v for r in rows]), axis=0), np.random.default_rng(seed)
    d = x.shape[1]
    subspaces = next(m for m in range(min(subspaces, d), 0, -1) if d % m == 0)
    centroids = _means(x, cells or max(1, int(len(x) ** 0.5)), 12, rng)
    at = _nearest(x, centroids)
    rest = (x - centroids[at]).reshape(len(x), subspaces, -1)
    codes = np.stack([_means(rest[:, s], 256, 8, rng) for s in range(subspaces)])
    asked = rng.choice(len(x), min(200, len(x)), replace=False)
    near = _best(np.round(x[asked] @ x.T, 9), np.arange(len(x)), k)
    order = np.argsort(-(x[asked] @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centroids)), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, at[near], axis=1).reshape(-1)) + 1
    return Model(centroids, codes, int(needed[min(len(needed) - 1, int(target * len(needed)))]))


def index(vectors: DataFrame, model: Model, folder: str) -> DataFrame:
    """Write every row's cell, code and vector, partitioned by cell, and read them back."""
    spark = vectors.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["v"].tolist())
                at = _nearest(x, model.centroids)
                rest = (x - model.centroids[at]).reshape(len(x), len(model.codes), -1)
                code = np.stack([_nearest(rest[:, s], c) for s, c in enumerate(model.codes)], axis=1).astype(np.uint8)
                yield pd.DataFrame({"id": b["id"], "code": [c.tobytes() for c in code], "v": b["v"], "cell": at.astype(np.int32)})

    coded = vectors.mapInPandas(run, "id long, code binary, v binary, cell int")
    # a cell of many rows is written by several tasks
    coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(folder)
    return spark.read.schema("id long, code binary, v binary, cell int").parquet(folder)


def search(stored: DataFrame, model: Model, queries: DataFrame, k: int = 10, again: int = 10, digits: int = 6) -> DataFrame:
    """case_id, parent_id, score, rank: the k best, by their vectors, of the rows whose codes have the `again` * k best scores."""
    values = again * k

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["v"].tolist())
                order = np.argsort(-(x @ model.centroids.T), axis=1, kind="stable")[:, : model.probes]
                yield pd.DataFrame({"case_id": np.repeat(b["id"].to_numpy(), order.shape[1]), "q": np.repeat(b["v"].to_numpy(), order.shape[1]), "cell": order.reshape(-1).astype(np.int32)})

    sizes = saved(stored.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    asked = saved(queries.mapInPandas(cells, "case_id long, q binary, cell int").join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    rows = stored.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def score(key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame(columns=["case_id", "parent_id", "score"])
        code = np.frombuffer(b"".join(r["code"]), np.uint8).reshape(len(r), -1)
        ids, out = r["id"].to_numpy(), []
        for start in range(0, len(q), 64):
            part = q.iloc[start : start + 64]
            x = _matrix(part["q"].tolist())
            tables = np.einsum("qsd,scd->qsc", x.reshape(len(x), len(model.codes), -1), model.codes)
            scores = np.repeat((x @ model.centroids[key[0]])[:, None], len(r), axis=1)
            for s in range(code.shape[1]):
                scores += tables[:, s, code[:, s]]
            at, row = _leading(scores, ids, values, k)
            out.append(pd.DataFrame({"case_id": part["case_id"].to_numpy()[at], "parent_id": ids[row], "score": scores[at, row]}))
        return pd.concat(out)

    met = asked.select("cell", "part", "case_id", "q").groupBy("cell", "part").cogroup(rows.select("cell", "part", "id", "code").groupBy("cell", "part")).applyInPandas(score, HITS)
    best = F.dense_rank().over(Window.partitionBy("case_id").orderBy(F.desc("score")))
    first = F.row_number().over(Window.partitionBy("case_id", "score").orderBy("parent_id"))
    few = saved(met.withColumns({"best": best, "first": first}).where((F.col("best") <= values) & (F.col("first") <= k)).select("case_id", "parent_id"))
    both = few.join(stored.select(F.col("id").alias("parent_id"), F.col("v").alias("r")), "parent_id").join(queries.select(F.col("id").alias("case_id"), F.col("v").alias("q")), "case_id")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"case_id": b["case_id"], "parent_id": b["parent_id"], "score": np.round((_matrix(b["q"].tolist()) * _matrix(b["r"].tolist())).sum(axis=1), digits)})

    out = saved(ranked_hits(both.select("case_id", "parent_id", "q", "r").mapInPandas(exact, HITS), k))
    dropped(sizes, asked, few)
    return out
