"""Whitening against numpy's eigenvectors."""

import numpy as np
import pytest

pytest.importorskip("brindle.llm.common")

from brindle.llm import queries, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def by_numpy(vectors, k=4):
    """n, sums, eigenvalues, components as columns, trace of the distinct integer vectors."""
    fit = sorted({tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for v in vectors})
    x = np.array(fit, np.int64)
    c = x - x.sum(axis=0) / len(x)
    cov = c.T @ c / len(x)
    e, u = np.linalg.eigh(cov)
    return len(x), x.sum(axis=0), e[::-1][:k], u[:, ::-1][:, :k], np.trace(cov)


def held(rows, vectors, k=4):
    """rows: of the result; vectors: (id, vector) of the rows that remain."""
    n, sums, e, u, trace = by_numpy([v for _, v in vectors], k)
    assert len(rows) == len(vectors) * k
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-10 and 0 <= r.identity_error < 1e-9
    signs = np.zeros(k)
    for i, v in vectors:
        x = np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)
        assert {r.deviation for r in found[i].values()} == {int(((n * x.astype(object) - sums.astype(object)) ** 2).sum())}
        want = (x - sums / n) @ u / np.sqrt(e)
        got = np.array([found[i][j + 1].whitened for j in range(k)])
        signs = np.where(signs == 0, np.sign(want * got), signs)
        assert np.allclose(got * signs, want, rtol=1e-7, atol=1e-7)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    held(queries.QUERIES["op11_embedding_whitening"](spark, SF).collect(), [(r.vec_id, r.embedding) for r in rows])


def test_nulls_copies_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5]).astype(np.float32).tolist()) for i in range(90)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies count once
    odd = [(1, None), (2, []), (3, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (4, [float("nan")] * 6), (5, [float("inf")] + [0.0] * 5), (6, [1.0, 2.0])]
    table = spark.createDataFrame(rows + [(9000 + i, v) for i, v in odd], SCHEMA).selectExpr("*", "1 AS key", "2 AS x", "3 AS n", "4 AS component", "5 AS __v")
    held(whitening.whitened(table).collect(), rows)
    again = {(r.vec_id, r.component): r.whitened for r in whitening.whitened(table).collect()}
    assert again == {(r.vec_id, r.component): r.whitened for r in whitening.whitened(table).collect()}
    null = spark.createDataFrame([(None, rows[0][1]), (None, rows[0][1])], SCHEMA).union(table.select("vec_id", "embedding"))
    assert whitening.whitened(null).where("vec_id IS NULL").count() == 8


def test_few_distinct_vectors(spark):
    """No component without variance."""
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    assert whitening.whitened(one).count() == 0 and whitening.whitened(one.where("false")).count() == 0
    assert whitening.whitened(one.where("false")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    three = [(i, v) for i, v in enumerate([[1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 0.0, 1.0, 3.0, 9.0], [0.5, 7.0, 3.0, 1.0, 2.0]])]
    held(whitening.whitened(spark.createDataFrame(three, SCHEMA)).collect(), three, 2)
    held(whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [4.0])], SCHEMA)).collect(), [(1, [1.0]), (2, [4.0])], 1)


@pytest.mark.parametrize(("d", "block", "space"), [(40, 4, 12), (40, 16, 160), (300, 8, 48), (3, 16, 160), (60, 64, 160)])
def test_flat_spectra_with_restarts(d, block, space):
    rng = np.random.default_rng(d)
    u = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = np.sort(1 + rng.random(d))[::-1]
    e[:1] *= 1.5
    v = (u * e) @ u.T
    vectors, values, residuals = whitening.leading(lambda q: v @ q, d, 4, block, space)
    assert np.allclose(values, e[:4], rtol=1e-11) and residuals.max() <= whitening.TOLERANCE
    assert np.allclose(np.abs((vectors * u[:, : len(values)]).sum(axis=0)), 1, atol=1e-6)


def test_operators_of_low_rank():
    v = np.diag([5.0, 5.0, 1.0, *[0.0] * 37])
    vectors, values, _ = whitening.leading(lambda q: v @ q, 40, 4, 4, 12)
    assert np.allclose(values, [5, 5, 1, 0]) and np.allclose(vectors.T @ vectors, np.eye(4))
    assert whitening.leading(lambda q: 0 * q, 40, 4)[1].shape == (0,)


def test_exact_deviations():
    x, sums = np.array([[2**31 - 1, -5], [3, 4]], np.int32), np.array([7 * 10**9, -9], np.int64)
    assert whitening.deviations(x, 10**6, sums) == [None, (3 * 10**6 - 7 * 10**9) ** 2 + (4 * 10**6 + 9) ** 2] or (3 * 10**6 - 7 * 10**9) ** 2 >= 1 << 63
    assert whitening.deviations(np.array([[3, 4]], np.int32), 5, np.array([1, 2])) == [14**2 + 18**2]
