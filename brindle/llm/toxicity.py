"""Toxicity scores from a factorization machine over hashed terms.

Terms are lower-cased words, stripped of surrounding punctuation, and their first three to five letters, so that an
inflected insult shares a term with its stem. Terms are hashed; a text is the set of its terms. The second-order part of the
machine scores pairs of terms (an insult beside the name of a group), which additive weights can't.

Learning uses a bounded, hash-ordered sample of labelled rows (``sample_rows``); scoring reads every whole text.
Nulls: a null or empty text has no term and gets the score of the bias; a row without label is never learned from.
Repeated rows are scored alike; of a label given twice the larger counts. Very long texts are sets of terms like others. An
empty label table gives the neutral model, whose score is next to 0 (4e-18) for every text. Other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of, where_text

BITS = 20
PREFIXES = (3, 4, 5)
STRIP = ".,;:!?\"'()[]{}*#$%&-_"
_WIDTH = 1 + len(PREFIXES)


class _Terms(dict):
    """Word to a row of term ids; the rows of a bounded number of words are kept."""

    LIMIT = 1 << 16

    def __missing__(self, word: str) -> tuple[int, ...]:
        core = word.strip(STRIP) or word
        terms = [core, *("^" + core[:k] if len(core) > k else core for k in PREFIXES)]
        ids = tuple(xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for t in terms)
        if len(self) < self.LIMIT:
            self[word] = ids
        return ids


_terms = _Terms()


def term_ids(text: str) -> np.ndarray:
    """Sorted distinct hashed terms of a text."""
    words = set(text.lower().split())
    flat = np.fromiter((i for ids in map(_terms.__getitem__, words) for i in ids), dtype=np.int32, count=len(words) * _WIDTH)
    return np.unique(flat)


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the terms of a text; other terms weigh nothing."""

    terms: np.ndarray  # sorted ids
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # terms x k

    def lookup(self) -> np.ndarray:
        at = np.full(1 << BITS, -1, np.int32)
        at[self.terms] = np.arange(len(self.terms), dtype=np.int32)
        return at

    def margin(self, positions: np.ndarray) -> float:
        v = self.factors[positions]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[positions].sum() + 0.5 * ((total * total).sum() - (v * v).sum()))

    def score(self, positions: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(positions), -40.0, 40.0))))


def neutral() -> FactorizationMachine:
    return FactorizationMachine(np.empty(0, np.int32), -40.0, np.empty(0, np.float32), np.empty((0, 1), np.float32))


def select_terms(docs: list[np.ndarray], labels: np.ndarray, keep: int, least_df: int = 3) -> np.ndarray:
    """The terms whose document frequency differs most between the classes, by a two-proportion z statistic."""
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    count = [np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)]
    for ids, y in zip(docs, labels, strict=True):
        count[int(y)][ids] += 1
    c0, c1 = count[0].astype(np.float64), count[1].astype(np.float64)
    pooled = (c0 + c1) / (n0 + n1)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    z[(c0 + c1 < least_df) | ~np.isfinite(z)] = 0
    best = np.argsort(-z, kind="stable")[:keep]
    return np.sort(best[z[best] > 2.5]).astype(np.int32)


def fit(docs: list[np.ndarray], labels: np.ndarray, factors: int = 4, keep: int = 4096, epochs: int = 20, rate: float = 0.05, decay: float = 1e-4, batch: int = 256, seed: int = 7) -> FactorizationMachine:
    """Logistic loss, minibatch Adam; deterministic for the same rows in the same order."""
    labels = labels.astype(np.int64)
    if len(docs) == 0 or labels.min() == labels.max():
        return neutral()
    terms = select_terms(docs, labels, keep)
    lookup = np.full(1 << BITS, -1, np.int32)
    lookup[terms] = np.arange(len(terms), dtype=np.int32)
    rows = [p[p >= 0] for p in (lookup[d] for d in docs)]
    rng = np.random.default_rng(seed)
    m = len(terms)
    params = np.zeros((m, 1 + factors))
    params[:, 1:] = rng.normal(0, 0.02, (m, factors))
    bias = np.array([np.log(labels.mean() / (1 - labels.mean()))])
    moments = [np.zeros_like(params), np.zeros_like(params), np.zeros(1), np.zeros(1)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            sizes = np.array([len(rows[i]) for i in part])
            flat = np.concatenate([rows[i] for i in part]) if sizes.sum() else np.empty(0, np.int32)
            owner = np.repeat(np.arange(len(part)), sizes)
            w, v = params[flat, 0], params[flat, 1:]
            totals = np.stack([np.bincount(owner, v[:, f], len(part)) for f in range(factors)], axis=1)
            squares = np.bincount(owner, (v * v).sum(axis=1), len(part))
            margin = bias[0] + np.bincount(owner, w, len(part)) + 0.5 * ((totals**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)
            grad = np.zeros_like(params)
            grad[:, 0] = np.bincount(flat, error[owner], m)
            pull = error[owner][:, None] * (totals[owner] - v)
            for f in range(factors):
                grad[:, 1 + f] = np.bincount(flat, pull[:, f], m)
            grad += decay * params
            step += 1
            for value, g, m1, m2 in ((params, grad, moments[0], moments[1]), (bias, np.array([error.sum()]), moments[2], moments[3])):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                value -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(terms, float(bias[0]), params[:, 0].astype(np.float32), params[:, 1:].astype(np.float32))


def learnable(labels: DataFrame, key: str = "doc_id", label: str = "toxic", fold: int = 2) -> DataFrame:
    """Labelled keys outside the held-out fold, crc32(key as text) mod 4; of repeated labels the largest counts."""
    return (
        labels.select(F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{label}`").cast("int").alias("__y"))
        .where(F.col("__key").isNotNull() & F.col("__y").isin(0, 1) & (F.crc32(F.col("__key").cast("string")) % 4 != fold))
        .groupBy("__key")
        .agg(F.max("__y").alias("__y"))
    )


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 12_000) -> FactorizationMachine:
    """Fit on the first `sample_rows` labelled keys in the order of a hash of the key; of several texts of a key the first by
    code point counts, so that as many rows at most are learned from. Only hashed terms reach the driver, in Arrow's form.
    """
    wanted = learnable(labels, key).orderBy(F.xxhash64("__key"), "__key").limit(sample_rows)
    # sample_rows bounds the broadcast side
    joined = docs.select(F.col(f"`{key}`").cast("long").alias("__key"), text_of(text).alias("__text")).join(F.broadcast(wanted), "__key").groupBy("__key", "__y").agg(F.min("__text").alias("__text"))
    table = map_batches(joined, lambda b: {"k": b["__key"], "y": b["__y"], "t": [term_ids(x) for x in b["__text"].to_pylist()]}, "k long, y int, t array<int>").toArrow().combine_chunks()
    if not len(table):
        return neutral()
    terms = table["t"].chunk(0)
    flat, ends = terms.values.to_numpy(), terms.offsets.to_numpy()
    order = np.argsort(table["k"].to_numpy(), kind="stable")
    return fit([flat[ends[i] : ends[i + 1]] for i in order], table["y"].to_numpy()[order].astype(np.int64))


def score(docs: DataFrame, model: FactorizationMachine, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: its key, score and prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict[str, np.ndarray] = {}

    def run(b: dict) -> dict:
        m = shared.value
        if "at" not in state:
            state["at"] = m.lookup()
        at = state["at"]
        found = (at[term_ids(x)] for x in b["__text"].to_pylist())
        scores = np.array([m.score(p[p >= 0]) for p in found])
        return {"__key": b["__key"], "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    frame = docs.select(F.col(f"`{key}`").cast("long").alias("__key"), text_of(text).alias("__text"))
    return map_batches(frame, run, "__key long, score double, predicted int").withColumnRenamed("__key", key)


def reject(docs: DataFrame, model: FactorizationMachine, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict[str, np.ndarray] = {}

    def accepted(text: str) -> bool:
        if "at" not in state:
            state["at"] = shared.value.lookup()
        p = state["at"][term_ids(text)]
        return shared.value.score(p[p >= 0]) < threshold

    return where_text(docs, accepted, text)
