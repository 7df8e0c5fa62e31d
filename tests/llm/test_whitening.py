"""Shifted CholeskyQR, against the eigenvectors of the exact covariance."""

from fractions import Fraction

import numpy as np
import pytest

from postlens.llm import whitening as W
from postlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame(list(enumerate(vectors)), f"vec_id long, embedding array<{kind}>")


def exact(vectors):
    """x of each vector, count, sums and covariance of the distinct ones, all exact before the last division."""
    xs = [tuple(int(np.floor(64.0 * float(c))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    rows = [[n * c - s for c, s in zip(x, sums)] for x in fit]
    d = len(sums)
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in rows), n**3)) for j in range(d)] for i in range(d)])
    return xs, n, sums, cov


def held(df, vectors, ids=None):
    rows = df.collect()
    xs, n, sums, cov = exact(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(16, len(sums))
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(by) == len(rows) == k * len(xs)
    for i, x in zip(ids or range(len(xs)), xs):
        for c in range(k):
            r = by[i, c + 1]
            assert r["n"] == n and r["deviation"] == sum((n * a - s)**2 for a, s in zip(x, sums))
            assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-4, abs=1e-12)
            assert r["identity_error"] < 1e-4
    for c in range(k):
        if values[c] > 1e-12 * values[0] and all(abs(values[c] - values[o]) > 1e-6 * values[0] for o in range(len(values)) if o != c):
            want = np.array([float(sum(Fraction(n * a - s, n) * Fraction(w) for a, s, w in zip(x, sums, axes[:, c]))) for x in xs]) / np.sqrt(values[c])
            got = np.array([by[i, c + 1]["whitened"] for i in ids or range(len(xs))])
            if want @ got < 0:
                want = -want
            np.testing.assert_allclose(got, want, atol=1e-6)


def test_query_on_the_given_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    out = QUERIES["op11_embedding_whitening"](spark, SMALL)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held(out, [r["embedding"] for r in df], [r["vec_id"] for r in df])


def test_repeated_vectors_count_once(spark):
    rand = np.random.default_rng(3)
    vectors = rand.normal(0, [3, 1, 0.5, 9], (40, 4)).tolist()
    held(W.whiten(frame(spark, vectors + vectors[:1] * 500 + vectors[5:9])), vectors + vectors[:1] * 500 + vectors[5:9])


def test_far_off_centre_and_ill_conditioned(spark):
    rand = np.random.default_rng(4)
    base = rand.normal(0, 1, (300, 6)) * [3e4, 3e3, 300, 30, 3, 0.3] + 1e5
    turn, _ = np.linalg.qr(rand.normal(0, 1, (6, 6)))
    vectors = (base @ turn).tolist()
    held(W.whiten(frame(spark, vectors, "double")), vectors)


def test_directions_without_variance(spark):
    vectors = [[float(i), 2.0 * i, 5.0, float(i * i % 7)] for i in range(30)]  # two of four directions
    rows = W.whiten(frame(spark, vectors)).collect()
    assert {r["component"] for r in rows if r["whitened"] is None} == {3, 4}
    assert all(r["identity_error"] < 1e-9 for r in rows)
    one = W.whiten(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(one) == 6 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in one)


def test_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [[1.0, 2.0], None, [1.0, None], [nan, 1.0], [inf, 1.0], [-inf, 1.0], [], [1.0], [1.0, 2.0, 3.0], [3.0, 1.0], [0.0, 0.5]]
    rows = W.whiten(frame(spark, vectors)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in rows) == [(0, 1), (0, 2), (9, 1), (9, 2), (10, 1), (10, 2)]


def test_empty_tables_clashing_columns_and_null_ids(spark):
    empty = frame(spark, [[1.0, 2.0]]).where("false")
    assert W.whiten(empty).collect() == [] and W.whiten(empty).columns[0] == "vec_id"
    assert W.whiten(frame(spark, [None])).collect() == []
    df = spark.createDataFrame([(None, [1.0, 5.0], 1, 2), (None, [2.0, 4.0], 1, 2), (7, [9.0, 9.0], 1, 2)], "vec_id long, embedding array<float>, x int, n int")
    assert sorted(str(r["vec_id"]) for r in W.whiten(df).collect()) == ["7", "7", "None", "None", "None", "None"]


def test_entries_beyond_long(spark):
    rows = W.whiten(frame(spark, [[1e30, 0.0], [-1e30, 1.0], [0.0, 2.0]], "double")).collect()
    assert len(rows) == 6 and all(r["deviation"] is None for r in rows if r["vec_id"] != 2)
    big = [[2.0**40, 0.0], [0.0, 2.0**39], [1.0, 1.0]]
    xs, n, sums, _ = exact(big)
    for r in W.whiten(frame(spark, big, "double")).collect():
        d = sum((n * a - s)**2 for a, s in zip(xs[r["vec_id"]], sums))
        assert r["deviation"] == (d if d < 2**63 else None)
