"""Whitening against numpy's eigensolver and Python's integers."""

import numpy as np
import pytest

from loglathe.llm import whitening


def symmetric(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    m = (q * np.array(values, float)) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        list(range(1, 41)),
        [5.0] * 10 + [1.0] * 30,
        [1e6, 1e6 - 1e-4, 1e3, 1.0, 1e-3] + [1e-9] * 20,
        [2.0**-k for k in range(30)],
        [7.0] + [0.0] * 12,
        [3.0],
        [4.0, 4.0],
        [10 + 1e-7 * k for k in range(20)],
        list(np.random.default_rng(5).random(70)),
    ],
)
def test_leading_pairs(values):
    matrix = symmetric(values, len(values))
    got, axes = whitening.leading(matrix, 32)
    want = [v for v in sorted(np.linalg.eigvalsh(matrix), reverse=True) if v > 1e-12 * np.trace(matrix)][:32]
    scale = max(values)
    assert len(got) == len(want) and np.allclose(got, want, rtol=0, atol=1e-12 * scale)
    assert np.abs(axes @ axes.T - np.eye(len(got))).max() < 1e-10
    assert np.abs(matrix @ axes.T - axes.T * got).max() < 1e-10 * scale


def test_counts_and_their_certificate():
    matrix = symmetric([9.0, 4.0, 4.0, 1.0, -2.0], 3)
    diagonal, beside = whitening.tridiagonal(matrix)
    assert np.allclose(np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)), np.linalg.eigvalsh(matrix))
    assert list(whitening.above(diagonal, beside, [-3, 0, 2, 5, 10])) == [5, 4, 3, 1, 0]
    whitening.certified(diagonal, beside, np.array([9.0, 4.0, 4.0]), 1e-6)
    with pytest.raises(ArithmeticError):  # the second is missing
        whitening.certified(diagonal, beside, np.array([9.0, 1.0]), 1e-6)


def plain(rows, most=32):
    """(x of usable rows, n, S) in Python's integers."""
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in fine), default=0)
    x = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in [*map(float, v), *[0.0] * (width - len(v))]]) for i, v in fine]
    return x, len(x), [sum(v[k] for _, v in x) for k in range(width)]


SCHEMA = "vec_id long, embedding array<float>, vector string, n int"


def test_rows_against_plain_numbers(spark):
    r = np.random.default_rng(2)
    base = (r.standard_normal((300, 10)) * np.linspace(5, 0.3, 10)) @ np.linalg.qr(r.standard_normal((10, 10)))[0]
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(base)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (900, None), (901, [1.0, None] + [0.0] * 8), (902, [float("nan")] * 10), (903, [float("inf")] + [0.0] * 9), (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    got = whitening.whitened(df).collect()
    x, n, sums = plain(rows)
    assert len(got) == len(x) * 10 and {g["n"] for g in got} == {n}
    deviation = sorted((i is None, i or 0, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for i, v in x)
    assert sorted((g["vec_id"] is None, g["vec_id"] or 0, g["deviation"]) for g in got if g["component"] == 1) == deviation
    centred = np.array([[a - s / n for a, s in zip(v, sums)] for _, v in x])
    cov = centred.T @ centred / n
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    for g in got:
        assert g["identity_error"] < 1e-4 and abs(g["explained"] * np.trace(cov) / values[g["component"] - 1] - 1) < 1e-4
    white = np.array([[g["whitened"] for g in sorted(got, key=lambda g: g["component"]) if g["vec_id"] == i] for i in range(300) if i != 7])
    axes = np.linalg.eigh(cov)[1][:, ::-1]
    want = np.array([(centred[k] @ axes) / np.sqrt(values) for k, (i, _) in enumerate(x) if i is not None and i < 300 and i != 7])
    assert np.abs(np.abs(white) - np.abs(want)).max() < 1e-8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (1, [1.0])], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitened(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)).collect() == []


def test_large_entries_and_exact_deviations(spark):
    rows = [(1, [1e10, 1.0]), (2, [-1e10, 0.5]), (3, [5.0, 3e38])]
    got = {g["vec_id"]: g["deviation"] for g in whitening.whitened(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)).where("component = 1").collect()}
    assert got == {1: None, 2: None, 3: None}
    x = np.array([[10**13, 3], [5, -(10**12)]], dtype=np.int64)
    assert whitening._exact(x, 10**7, np.array([7, -(10**15)], dtype=object)).tolist() == [[10**20 - 7, 3 * 10**7 + 10**15], [5 * 10**7 - 7, -(10**19) + 10**15]]
