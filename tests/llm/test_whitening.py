import random
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from evidoc.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, "c") for i, v in rows], SCHEMA).repartition(3)


def rows_of(seed, n, width, scales):
    r = random.Random(seed)
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    made = [(np.array([r.gauss(0, s) for s in scales]) @ turn + 0.3).astype(np.float32).tolist() for _ in range(n)]
    rows = [(k, v) for k, v in enumerate(made)]
    rows += [(n, None), (n + 1, [nan] * width), (n + 2, [-inf] * width), (n + 3, [None] * width), (n + 4, [0.1])]
    return rows + [(k, made[5]) for k in range(1000, 1060)] + [rows[7], (None, made[8])]


@pytest.mark.parametrize("scales", [[0.3, 0.2, 0.1, 0.05] + [0.02] * 8, [3.0, 1.0, 0.03, 0.004] + [0.0] * 8])
def test_report_equals_a_plain_computation(spark, scales):
    rows = rows_of(1, 300, len(scales), scales)
    got = whitening.report(frame(spark, rows)).collect()
    kept = [(i, [floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == len(scales) and all(x is not None and abs(x) < inf for x in v)]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * len(kept)
    by = {(r["vec_id"], r["component"]): r for r in got}
    signs = {}
    for i, v in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        for k in range(4):
            r = by[i, k + 1]
            want = float((np.array(v) - np.array([s / n for s in sums])) @ vectors[:, k] / np.sqrt(values[k]))
            signs.setdefault(k, np.sign(want) * np.sign(r["whitened"]))
            assert (r["n"], r["deviation"]) == (n, dev)
            assert abs(r["whitened"] * signs[k] - want) < 1e-6 * max(1, abs(want)) + 1e-7
            assert abs(r["explained"] / (values[k] / np.trace(x.T @ x / n)) - 1) < 1e-9
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_small_eigenvalues_are_accurate():
    """A graded matrix, whose smallest eigenvalue is far below the rounding of the largest."""
    grade = np.diag([1.0, 1e-7, 1e-14])
    inner = np.array([[1, 0.3, 0.2], [0.3, 1, 0.4], [0.2, 0.4, 1]])
    values, vectors = whitening.jacobi(grade @ inner @ grade)
    d = [[Fraction(float((grade @ inner @ grade)[i, j])) for j in range(3)] for i in range(3)]
    det = d[0][0] * (d[1][1] * d[2][2] - d[1][2] * d[2][1]) - d[0][1] * (d[1][0] * d[2][2] - d[1][2] * d[2][0]) + d[0][2] * (d[1][0] * d[2][1] - d[1][1] * d[2][0])
    assert abs(float(Fraction(float(np.prod(values[:2]))) * Fraction(float(values[2])) / det) - 1) < 1e-12
    assert np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-14)


def test_equal_eigenvalues_and_flat_directions(spark):
    cross = [(k, [float(v) for v in row]) for k, row in enumerate([*np.eye(4), *-np.eye(4)])]
    got = whitening.report(frame(spark, cross)).collect()
    assert {round(r["explained"], 9) for r in got} == {0.25} and got[0]["identity_error"] < 1e-12
    line = [(k, [k / 4, k / 2, -k / 4, 1.0, 0.0]) for k in range(9)]
    got = whitening.report(frame(spark, line)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got) and got[0]["identity_error"] < 1e-12
    one = whitening.report(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one) == [(i, k, 1, 0, None, None, 0.0) for i in (1, 2) for k in (1, 2)]


def test_deviations_are_exact_beyond_floats():
    model = whitening.Whitening(10**9, (123_456_789_012, -7), np.ones(2), np.eye(2), 2.0)
    x = np.array([[130, 0], [-(2**31), 2**31], [124, 0]])
    exact = [sum((10**9 * int(v) - s) ** 2 for v, s in zip(row, model.sums, strict=True)) for row in x]
    assert model.deviation(x) == [v if v < 2**63 else None for v in exact] and None in model.deviation(x) and model.deviation(x)[2] is not None


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(2, [])]):
        out = whitening.report(frame(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
