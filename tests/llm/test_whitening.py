"""Whitening and the exact spectrum against NumPy and plain versions."""

import math
import random

import numpy as np
import pytest

from photolake.llm import exact_spectrum, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, c int, place long"


def run(spark, vectors):
    rows = [(i, v, 1, "x", 2, 3) for i, v in enumerate(vectors)]
    return whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()


def plain(vectors):
    """n, and of each kept row: id, deviation, projections on NumPy's components."""
    kept = {i: [math.floor(256 * float(np.float32(e))) for e in v] for i, v in enumerate(vectors) if v is not None and all(e is not None and math.isfinite(e) for e in v)}
    fitted = np.array(sorted({tuple(x) for x in kept.values()}), object)
    n, sums = len(fitted), fitted.sum(axis=0)
    centred = fitted.astype(float) - (sums / n).astype(float)
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    return n, kept, sums, values[::-1], vecs[:, ::-1], {i: int(((n * np.array(x, object) - sums) ** 2).sum()) for i, x in kept.items()}


def test_against_numpy(spark):
    draw = np.random.default_rng(3)
    vectors = (draw.normal(size=(300, 12)) * np.linspace(1, 3, 12)).astype("float32").tolist()
    vectors += vectors[:40] + [None, [None] + [0.0] * 11, [math.nan] * 12, [math.inf] + [0.0] * 11, [0.1] * 5, []]
    got = run(spark, vectors)
    n, kept, sums, values, vecs, deviations = plain([v if v is None or len(v) == 12 else None for v in vectors])
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    assert all(r.deviation == deviations[r.vec_id] for r in got)
    assert max(r.identity_error for r in got) < 1e-9
    for k in range(4):
        mine = {r.vec_id: r for r in got if r.component == k + 1}
        want = {i: float((np.array(x, float) - (sums / n).astype(float)) @ vecs[:, k] / math.sqrt(values[k])) for i, x in kept.items()}
        sign = np.sign(sum(mine[i].whitened * want[i] for i in kept))
        assert max(abs(mine[i].whitened * sign - want[i]) for i in kept) < 1e-9
        assert abs(mine[0].explained - values[k] / values.sum()) < 1e-12


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[0.5, 0.25]], [[0.5, 0.25]] * 7])
def test_nothing_varies(spark, vectors):
    assert run(spark, vectors) == []


def test_few_dimensions_and_equal_eigenvalues(spark):
    got = run(spark, [[1.0, 0.0, 2.0], [-1.0, 0.0, 2.0], [0.0, 1.0, 2.0], [0.0, -1.0, 2.0], [0.0, -1.0, 2.0]])
    assert len(got) == 10 and {r.component for r in got} == {1, 2} and got[0].n == 4
    assert all(abs(r.explained - 0.5) < 1e-12 and r.identity_error < 1e-12 for r in got)
    assert len(run(spark, [[1.0], [2.0], [2.0]])) == 3


def test_huge_entries(spark):
    vectors = [[1e13, 1.0], [-1e13, 2.0], [2e12, -3.0], [5e12, 4.0]]
    got = run(spark, vectors)
    n, kept, sums, values, vecs, deviations = plain(vectors)
    assert len(got) == 8 and all(r.deviation is None or r.deviation == deviations[r.vec_id] for r in got)
    assert max(r.identity_error for r in got) < 1e-9


def determinant(m):
    """By cofactors, exactly."""
    return m[0][0] if len(m) == 1 else sum((-1) ** j * m[0][j] * determinant([r[:j] + r[j + 1 :] for r in m[1:]]) for j in range(len(m)))


def test_polynomial_is_exact(spark):
    draw = random.Random(7)
    for d in (1, 2, 5):
        b = [[draw.randrange(-(10**6), 10**6) if draw.random() < 0.7 else 0 for _ in range(d)] for _ in range(d + 1)]
        m = [[sum(r[i] * r[j] for r in b) for j in range(d)] for i in range(d)]
        poly = exact_spectrum.characteristic_polynomial(spark, m)
        for at in (-3, 0, 1, 17, 10**12):
            shifted = [[(at if i == j else 0) - m[i][j] for j in range(d)] for i in range(d)]
            assert sum(c * at ** (d - k) for k, c in enumerate(poly)) == determinant(shifted)


def test_close_and_repeated_roots():
    close = [[10**15, 0, 0, 0], [0, 10**15 + 1, 0, 0], [0, 0, 5, 0], [0, 0, 0, 0]]
    poly = [1]
    for i in range(4):
        poly = [a - close[i][i] * b for a, b in zip([*poly, 0], [0, *poly], strict=True)]
    roots = exact_spectrum.largest_roots(poly, 2 * 10**15 + 6, 4)
    assert [round(a / 2**b) for a, b in roots] == [10**15 + 1, 10**15, 5]
    vectors = exact_spectrum.eigenvectors(close, roots)
    assert np.allclose(np.abs(vectors), np.eye(4)[[1, 0, 2]], atol=1e-15)
