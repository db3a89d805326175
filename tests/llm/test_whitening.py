"""op12 against exact sums and another eigensolver."""

from collections import defaultdict
from decimal import Decimal, getcontext
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsift.llm import whitening
from docsift.llm.q_whitening import op12_jacobi_whitening
from docsift.llm.whitening import jacobi, whitened

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)


def checked(rows, got, most=16):
    """Compare rows (id, vector) with the result, by exact sums and numpy's solver; returns the eigenvalues."""
    xs = [(i, [floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    z = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in fit])
    v = np.array([[float(sum(Fraction((n * x[i] - sums[i]) * (n * x[j] - sums[j]), n * n) for x in fit) / n) for j in range(d)] for i in range(d)]) if n * d * d < 20_000 else z.T @ z / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, d)
    assert len(got) == len(rows) * k
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"], r["component"]].append(r)
    assert set(by) == {(i, c) for i, _ in xs for c in range(1, k + 1)}
    for c in range(k):
        sound = values[c] > 1e-12 * values[0]
        want = []
        for i, x in xs:
            dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
            rs = by[i, c + 1]
            assert {(r["n"], r["deviation"]) for r in rs} == {(n, dev)} or sum(1 for j, _ in xs if j == i) > 1
            if sound:
                assert abs(rs[0]["explained"] - values[c] / np.trace(v)) <= 1e-9 * rs[0]["explained"]
                want.append((rs[0]["whitened"], centred @ vectors[:, c] / np.sqrt(values[c])))
            else:
                assert rs[0]["whitened"] is None and rs[0]["explained"] < 1e-12
        apart = [abs(values[c] - values[o]) for o in range(d) if o != c]
        if sound and min(apart, default=1) > 1e-6 * values[0] and len({i for i, _ in xs}) == len(xs):
            a, b = np.array(want).T
            sign = 1 if a @ b >= 0 else -1
            assert np.allclose(a, sign * b, rtol=1e-7, atol=1e-8)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and all(e is None or e < 1e-9 for e in errors)
    return values


def test_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = op12_jacobi_whitening(spark, SF)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    checked(rows, df.collect())


def test_copies_count_once_and_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(1)
    some = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows = some + [(100 + i, some[0][1]) for i in range(30)]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [nan] * 5), (903, [inf] * 5), (904, []), (None, None)]
    checked(rows, whitened(table(spark, rows + odd)).collect())


def test_constant_and_repeated_dimensions_are_null(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 2))
    rows = [(i, [a, b, a, 0.5]) for i, (a, b) in enumerate(base.tolist())]
    values = checked(rows, whitened(table(spark, rows)).collect())
    assert sum(values > 1e-9) == 2
    one = whitened(table(spark, [(1, [0.1, 0.2]), (2, [0.1, 0.2])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in one)


def test_lengths_are_fitted_apart_and_ids_repeat(spark):
    rng = np.random.default_rng(3)
    a = [(i, rng.normal(size=3).tolist()) for i in range(20)]
    b = [(i, rng.normal(size=20).tolist()) for i in range(60)]
    got = whitened(table(spark, a + b)).collect()
    three = [r for r in got if r["n"] == 20]
    checked(a, three)
    checked(b, [r for r in got if r["n"] == 60])
    twice = whitened(table(spark, a + [(None, a[0][1]), (0, a[1][1])])).collect()
    assert len(twice) == 22 * 3 and sum(r["vec_id"] is None for r in twice) == 3
    assert whitened(table(spark, [])).collect() == []


def test_clashing_columns(spark):
    rows = [(1, [0.0, 1.0]), (2, [1.0, 0.5]), (3, [0.2, 0.9])]
    df = table(spark, rows).selectExpr("*", "1 as x", "2 as n", "3 as component")
    checked(rows, whitened(df).collect())


@pytest.mark.parametrize("held", [1, 1 << 22])
def test_large_numbers(spark, monkeypatch, held):
    monkeypatch.setattr(whitening, "HELD", held)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * [1e5, 1.0, 1e3] + 1e7).tolist()) for i in range(25)]
    got = whitened(table(spark, rows)).collect()
    checked(rows, [r for r in got])
    far = whitened(table(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 7.0])])).collect()
    assert len(far) == 6 and max(r["deviation"] for r in far) == (1 << 63) - 1


def test_small_eigenvalues_are_accurate_relative_to_themselves():
    """Two dimensions of very different size: their eigenvalues are the roots of a quadratic."""
    getcontext().prec = 60
    a, b, c = 1e16, 1e3, 1e-6
    v = np.array([[a, b], [b, c + b * b / a]])
    values, _ = jacobi(v)
    t, det = Decimal(v[0, 0]) + Decimal(v[1, 1]), Decimal(v[0, 0]) * Decimal(v[1, 1]) - Decimal(v[0, 1]) ** 2
    root = (t * t - 4 * det).sqrt()
    for got, want in zip(values, ((t + root) / 2, (t - root) / 2)):
        assert abs(Decimal(got) - want) <= Decimal(1e-12) * want


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6))
def test_jacobi_diagonalises(d, seed):
    m = np.random.default_rng(seed).normal(size=(d + 2, d))
    v = m.T @ m
    e, u = jacobi(v)
    assert np.allclose(u.T @ u, np.eye(d), atol=1e-12) and np.allclose(u * e @ u.T, v, atol=1e-10 * max(1, e[0]))
    assert np.all(np.diff(e) <= 0)
