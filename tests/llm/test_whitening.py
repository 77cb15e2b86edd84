"""The whitening operator against exact and plain numpy figures."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from hazeline.llm import whitening
from hazeline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, w double, place long, key string, n long"
NAN, INF = float("nan"), float("inf")


def vectors(n=300, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((dim, dim))
    return (rng.standard_normal((n, dim)) @ mix).astype(np.float32)


def frame(spark, rows, parts=3):
    floats = lambda v: v and [c if c is None else float(c) for c in v]
    return spark.createDataFrame([(i, floats(v), 1, 0.5, 7, "k", 3) for i, v in rows], SCHEMA).repartition(parts)


def check(got, fit, k=8):
    """Rows of the operator against ``fit``: key -> the floats of its vector."""
    keys = list(fit)
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in fit[i]] for i in keys], object)
    n, s = len(keys), [sum(col) for col in x.T.tolist()]
    centred = np.array([[float(Fraction(n * v - t, n)) for v, t in zip(row, s)] for row in x.tolist()])
    cov = centred.T @ centred / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(keys)
    k = min(k, len(s))
    for row, i, c in zip(x.tolist(), keys, centred):
        assert sorted(by[i]) == list(range(1, k + 1))
        exact = sum((n * v - t) ** 2 for v, t in zip(row, s))
        for j in range(1, k + 1):
            r = by[i][j]
            assert r.n == n and r.deviation_exact == str(exact)
            assert r.deviation == (exact if exact < 1 << 63 else None)
            assert r.explained == pytest.approx(e[j - 1] / e.sum(), rel=1e-9)
            assert r.identity_error <= 1e-9
    want = centred @ vec[:, :k] / np.sqrt(e[:k])
    found = np.array([[by[i][j].whitened for j in range(1, k + 1)] for i in keys])
    sign = np.sign((want * found).sum(0))
    assert np.abs(found * sign - want).max() < 1e-6


def test_whitening(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors())]
    odd = [(900, None), (901, []), (902, [0.0, NAN, 0, 0, 0, 0]), (903, [INF] * 6), (904, [1.0, None, 0, 0, 0, 0])]
    odd += [(905, [1.0, 2.0]), (906, [0.0] * 7), (907, [3e30, 0, 0, 0, 0, 0])]
    check(whitening.whiten(frame(spark, rows + odd)).collect(), dict(rows))


def test_deviation_beyond_64_bits(spark):
    values = vectors(200, 9) * np.float32(2e7)
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    got = whitening.whiten(frame(spark, rows), components=4).collect()
    assert any(r.deviation is None for r in got)
    check(got, dict(rows), 4)


def test_repeats_ties_and_no_variance(spark):
    rows = [(5, [0.25, 0.5]), (5, [0.25, 0.5]), (None, [0.25, 0.5]), (7, [1.25, 0.5])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 8 and {r.n for r in got} == {4}
    assert sorted((r.vec_id is None, r.vec_id) for r in got if r.component == 1)[-1][0]
    first = {(r.vec_id, r.whitened) for r in got if r.component == 1}
    assert len(first) == 3 and all(abs(abs(w) - (3 if i == 7 else 1) / 3**0.5) < 1e-12 for i, w in first)
    assert {r.whitened for r in got if r.component == 2} == {None}
    assert {r.identity_error <= 1e-12 for r in got} == {True}
    alone = whitening.whiten(frame(spark, [(1, [0.5, 0.5])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [
        (1, 0, None, None, None), (2, 0, None, None, None),
    ]
    for nothing in ([], [(1, None), (2, [])]):
        assert whitening.whiten(frame(spark, nothing)).collect() == []


@pytest.mark.parametrize("dim", [1, 8, 40])
def test_eigenvectors_of_clusters(dim):
    """Eigenvalues that differ in the twelfth digit, or not at all: vectors of apart ones
    are right to float64, clusters span the right space."""
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.longdouble)
    for _ in range(4):  # orthogonal to the last digit of extended precision
        q = q @ (1.5 * np.eye(dim, dtype=np.longdouble) - 0.5 * q.T @ q)
    e = np.sort(np.r_[rng.random(dim - min(dim, 5)) * 9, [3.0, 3.0 + 1e-12, 3.0 + 2e-12, 1.0, 1.0][: min(dim, 5)]])[::-1]
    e = e.astype(np.longdouble)
    found, x = whitening.eigen((q * e) @ q.T)
    assert np.abs(found - e).max() < 1e-16 * dim
    assert np.abs(x.T @ x - np.eye(dim)).max() < 1e-16 * dim
    for group in whitening.clusters(e, np.longdouble(1e-14)):
        turn = q[:, group].T @ x[:, group]
        assert np.abs(turn.T @ turn - np.eye(len(group))).max() < 1e-5
        if len(group) == 1:
            other = min((abs(e[j] - e[group[0]]) for j in range(dim) if j != group[0]), default=1)
            assert 1 - abs(turn[0, 0]) < 1e-18 / other**2 * 1e-15 + 1e-11 * (other < 1e-9) + 1e-17


def test_query_takes_the_whole_table(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, sf).collect(), dict(rows))
