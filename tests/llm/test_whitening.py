"""Whitening against exact fractions and a plain double-precision solve."""

import math
from fractions import Fraction

import numpy as np
import pytest

from factloom.llm import whitening


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x int, n string, width int")


def vectors(n, width, seed=1, scale=1.0):
    return (np.random.default_rng(seed).standard_normal((n, width)) * scale).astype(np.float32)


def rows_of(matrix):
    return [(at, [float(c) for c in row], 1, 2, "z", 3) for at, row in enumerate(matrix)]


def test_equals_exact_sums_and_plain_solve(spark):
    matrix = vectors(300, 6)
    got = whitening.whitened(frame(spark, rows_of(matrix)).repartition(7), 4).collect()
    x = np.floor(64 * matrix.astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    values, turn = np.linalg.eigh(np.cov((x - 1_000_000).T, bias=True))
    values, turn = values[::-1], turn[:, ::-1]
    z = (x - 1_000_000) - (s - n * 1_000_000) / n
    assert len(got) == 300 * 4 and {r["component"] for r in got} == {1, 2, 3, 4}
    table = np.full((300, 4), np.nan)
    for row in got:
        table[row["vec_id"], row["component"] - 1] = row["whitened"]
        assert row["n"] == n
        assert row["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[row["vec_id"]], s))
        assert math.isclose(row["explained"], values[row["component"] - 1] / values.sum(), rel_tol=1e-9)
        assert row["identity_error"] < 1e-9
    plain = z @ turn[:, :4] / np.sqrt(values[:4])
    for at in range(4):
        assert np.abs(np.abs(table[:, at]) - np.abs(plain[:, at])).max() < 1e-8


def test_odd_rows(spark):
    rows = rows_of(vectors(40, 3))
    good = len(rows)
    rows += [rows[0], (None, rows[1][1], None, None, None, None)]
    rows += [(100, None, 1, 1, "", 1), (101, [1.0, None, 2.0], 1, 1, "", 1), (102, [math.nan, 1.0, 1.0], 1, 1, "", 1)]
    rows += [(103, [math.inf, 1.0, 1.0], 1, 1, "", 1), (104, [1e30, 1.0, 1.0], 1, 1, "", 1), (105, [], 1, 1, "", 1)]
    rows += [(106, [1.0, 2.0], 1, 1, "", 1), (107, [1.5, 2.0], 1, 1, "", 1), (108, [7.0], 1, 1, "", 1)]
    got = whitening.whitened(frame(spark, rows)).collect()
    by_id = {}
    for row in got:
        by_id.setdefault(row["vec_id"], []).append(row)
    assert set(by_id) == {*range(good), None, 106, 107, 108}
    assert len(by_id[0]) == 6 and by_id[0][0]["n"] == good + 2 and by_id[106][0]["n"] == 2
    # Two vectors that differ in one dimension: one component has variance.
    first, second = sorted(by_id[106], key=lambda r: r["component"])
    assert math.isclose(abs(first["whitened"]), 1) and first["explained"] == 1 and first["identity_error"] < 1e-9
    assert second["whitened"] is None and second["explained"] < 1e-15
    assert by_id[108][0]["whitened"] is None and by_id[108][0]["explained"] == 0 and by_id[108][0]["identity_error"] is None
    assert whitening.whitened(frame(spark, rows).limit(0)).collect() == []


def test_large_entries_stay_exact(spark):
    matrix = vectors(20, 3, scale=1e8)
    got = whitening.whitened(frame(spark, rows_of(matrix)).repartition(3)).collect()
    x = np.floor(64 * matrix.astype(float)).astype(np.int64) + 1_000_000
    s = [sum(map(int, column)) for column in x.T]
    for row in got:
        deviation = sum((20 * int(a) - b) ** 2 for a, b in zip(x[row["vec_id"]], s))
        assert row["deviation"] == (deviation if deviation < 2**63 else None)
        assert row["identity_error"] < 1e-9


def test_covariance_is_rounded_once():
    random = np.random.default_rng(4)
    x = random.integers(-5000, 5000, (500, 8)) + 10**9
    sums = x.sum(axis=0, dtype=object)
    centre, rest = whitening.centred(len(x), sums)
    v = whitening.covariance(len(x), rest, whitening.products(x - centre, 10_001))
    n = len(x)
    for i in range(8):
        for j in range(8):
            exact = sum(Fraction(int(a)) * int(b) for a, b in zip(x[:, i], x[:, j])) / n - Fraction(int(sums[i]), n) * Fraction(int(sums[j]), n)
            assert abs(float(v[i, j]) - float(exact)) <= 4e-16 * abs(float(exact))


def spectrum(values, seed=2):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to extended precision
        q = q @ (np.eye(len(q)) * np.longdouble(1.5) - q.T @ q / 2)
    return (q * np.array(values, dtype=np.longdouble)) @ q.T, q


@pytest.mark.parametrize(
    "values",
    [
        [5, 4, 3, 2, 1, 0.5],
        [1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.5, 0.1],
        [1, 1, 1, 1, 1, 1],
        [1e6, 1 + 1e-7, 1, 1e-6, 1e-7, 0],
        [3, 1e-3 + 1e-12, 1e-3, 1e-3 - 1e-12, 1e-8, 2e-8],
        [2, 2 - 1e-13, 2 - 2e-13, 1, 1, 1],
    ],
)
def test_refinement_of_clusters(values):
    a, q = spectrum(sorted(values, reverse=True))
    found, x = whitening.eigen(a)
    wanted = sorted(values, reverse=True)
    assert np.abs(found - np.array(wanted)).max() <= 1e-16 * max(wanted)
    assert np.abs(x.T @ x - np.eye(len(x))).max() < 1e-16
    assert np.abs(a @ x - x * found).max() <= 1e-16 * max(wanted)
    for at, value in enumerate(wanted):  # a vector by itself has its direction to double precision
        gap = min((abs(value - other) for k, other in enumerate(wanted) if k != at), default=1)
        if gap > 1e-2 * max(wanted):
            assert abs(abs(float(x[:, at] @ q[:, at])) - 1) < 1e-15


def test_single_precision_alone_would_not_do():
    a, _ = spectrum([1 - 1e-3 * k for k in range(64)])
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    found, x = whitening.eigen(a)
    plain = a.astype(float)
    residual = lambda v: np.abs(plain @ v - v * np.diag(v.T @ plain @ v)).max()
    assert residual(rough) > 1e-8 and residual(x.astype(float)) < 1e-15


def test_many_states_reach_the_driver_merged(spark):
    rows = whitening.whole_vectors(frame(spark, rows_of(vectors(500, 3))).repartition(60))
    states = whitening.gathered(rows, whitening.totals, whitening.merged_totals)
    assert states[3][0] == 500
