"""Vector search in blocks and by the index against brute force."""

import uuid

import numpy as np
import pytest

from brindle.operators import ann
from brindle.operators.resolve import shared_folder
from brindle.plans import catalog

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def nearest(rows, cases, k):
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in rows:
        if i in cases:
            q = np.array(v, np.float32).astype(float)
            scores = np.round(x @ (q / np.linalg.norm(q)), 6)
            out[i] = [(int(ids[j]), scores[j]) for j in np.lexsort((ids, -scores))[:k]]
    return out


def test_recall_of_the_index(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    wanted = nearest(rows, {i for i, _ in rows if i % 20 == 0}, 10)
    got = {}
    for r in catalog.QUERIES["ann_topk"](spark, SF).collect():
        got.setdefault(r.case_id, {})[r.parent_id] = r.score
    assert got.keys() == wanted.keys() and all(len(g) == 10 for g in got.values())
    assert np.mean([len(got[i].keys() & {j for j, _ in w}) / 10 for i, w in wanted.items()]) >= 0.9
    for i, w in wanted.items():
        for j, score in w:
            assert got[i].get(j, score) == pytest.approx(score, abs=2e-6)


def test_clusters_copies_and_odd_rows(spark, monkeypatch):
    """A third of the rows are one vector; blocks are small, so that its cell is several tasks' work."""
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERIES", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12)) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=12)).tolist()) for i in range(400)] + [(1000 + i, centres[0].tolist()) for i in range(200)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 12), (5003, [1.0, 2.0]), (5004, [float("nan")] * 12)]
    vectors = ann.unit_vectors(spark.createDataFrame(rows + odd, SCHEMA), "vec_id")
    queries = vectors.where("id % 20 = 0")
    cases = {i for i, _ in rows if i % 20 == 0}
    wanted = nearest(rows, cases, 5)
    exact = {}
    for r in ann.exact_topk(vectors, queries, 5).orderBy("rank").collect():
        exact.setdefault(r.case_id, []).append((r.parent_id, r.score))
    assert {i: [j for j, _ in v] for i, v in exact.items()} == {i: [j for j, _ in v] for i, v in wanted.items()}
    model = ann.train(vectors, cells=8, subspaces=6)
    stored = ann.index(vectors, model, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    assert stored.count() == len(rows)
    found = {}
    for r in ann.search(stored, model, queries, 5).collect():
        found.setdefault(r.case_id, set()).add((r.score))
    assert np.mean([np.mean([round(s, 5) in {round(x, 5) for x in found[i]} for _, s in w]) for i, w in wanted.items()]) >= 0.9
    assert ann.train(vectors.where("false")) is None


def test_groups_of_rows_and_queries_meet(spark, monkeypatch):
    """Every group of rows meets every group of queries, none as a whole; copies are ranked by id across groups."""
    monkeypatch.setattr(ann, "ROWS", 30)
    monkeypatch.setattr(ann, "QUERIES", 4)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) if i % 3 else np.ones(6)).tolist()) for i in range(300)]
    vectors = ann.unit_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id")
    got = {}
    for r in ann.exact_topk(vectors, vectors.where("id % 20 = 0"), 7).orderBy("rank").collect():
        got.setdefault(r.case_id, []).append(r.parent_id)
    assert got == {i: [j for j, _ in v] for i, v in nearest(rows, {i for i, _ in rows if i % 20 == 0}, 7).items()}


def test_most_rows_of_a_score_are_not_sorted():
    scores = np.array([[1.0, 3.0, 3.0, 2.0, 3.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    row, at = ann._top(scores, 2)
    assert row.tolist() == [0, 0, 1, 1] and at.tolist() == [1, 2, 0, 1]
    assert ann._top(scores[:, :1], 2)[1].tolist() == [0, 0]
