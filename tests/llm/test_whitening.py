import math

import numpy as np
import pytest

from recallgrid.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string"


def held(spark, rows, top=16):
    """Against plain numpy over all rows."""
    lengths = [len(v) for _, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fitted = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fitted), fitted.sum(axis=0)
    centred = fitted - sums / n
    v = centred.T @ centred / n
    e, q = (a[..., ::-1] for a in np.linalg.eigh(v))
    count = min(top, int((e > d * 1e-14 * e[0]).sum()))
    got = {}
    for r in whitening.whitened(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA), top).collect():
        got.setdefault(r.vec_id, []).append(r)
    sign = {}
    for i, x in kept:
        assert sorted(r.component for r in got[i]) == [k for k in range(1, count + 1) for _ in range([j for j, _ in kept].count(i))]
        dev = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))
        for r in got[i]:
            k = r.component - 1
            expected = (np.array(x) - sums / n) @ q[:, k] / e[k] ** 0.5
            assert r.n == n and r.deviation == dev and abs(r.explained - e[k] / np.trace(v)) < 1e-9 and r.identity_error < 1e-6
            if abs(expected) > 1e-6:
                sign.setdefault(k, np.sign(r.whitened * expected))
            assert abs(r.whitened * sign.get(k, 1) - expected) < 1e-6
    assert set(got) == {i for i, _ in kept}


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    mix = rng.standard_normal((20, 20))
    rows = [(i, [float(c) for c in rng.standard_normal(20) @ mix / 9]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a vector that many rows hold counts once
    rows += [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [1.0] * 19 + [float("inf")]), (2004, []), (2005, [1.0] * 7)]
    held(spark, rows)


def test_few_dimensions_and_rank(spark):
    rng = np.random.default_rng(2)
    held(spark, [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(50)])
    held(spark, [(i, [float(a), float(2 * a), float(b), float(-b)]) for i, (a, b) in enumerate(rng.integers(0, 50, (60, 2)))])  # rank 2
    held(spark, [(i, [float(c) for c in rng.standard_normal(5)]) for i in range(30)], top=2)


def test_defined_cases(spark, empty):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whitened(frame([])).count() == 0
    assert whitening.whitened(frame([(1, None, 1, None), (2, [None], 1, None)])).count() == 0
    assert whitening.whitened(frame([(1, [1.0, 2.0], 1, None), (2, [1.0, 2.0], 1, None)])).count() == 0  # no variance
    got = whitening.whitened(frame([(None, [1.0, 2.0], 1, None), (7, [3.0, 2.0], 1, None), (7, [3.0, 2.0], 1, None), (8, [1e20, 1.0], 1, None)])).collect()
    assert sorted(str(r.vec_id) for r in got) == ["7", "7", "None"] and {r.n for r in got} == {2}
    # sums and deviations beyond a long
    big = whitening.whitened(frame([(i, [float(2**44 * (i % 4)), float(i)], 1, None) for i in range(3000)])).collect()
    assert {r.n for r in big} == {3000} and any(r.deviation is None for r in big)


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "pairs", "low rank", "zero", "diagonal"])
def test_division(kind, monkeypatch):
    """The division alone, without the polish at its end, is as good as numpy's solver."""
    monkeypatch.setattr(whitening, "_polished", lambda v, q: q)
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    m = rng.standard_normal((100, 40))
    v = {
        "random": m.T @ m, "graded": q * 10.0 ** np.linspace(3, -10, 40) @ q.T, "equal": 3 * np.eye(40), "pairs": q * np.repeat(np.arange(20.0), 2) @ q.T,
        "low rank": m[:7].T @ m[:7], "zero": np.zeros((40, 40)), "diagonal": np.diag(np.arange(40.0)),
    }[kind]
    e, found = whitening.eigen(v)
    size = max(np.abs(v).max(), 1e-300)
    assert np.abs(found.T @ found - np.eye(40)).max() < 1e-12
    assert np.abs(v @ found - found * e).max() < 1e-11 * size
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() < 1e-11 * size


def test_polar_factor():
    rng = np.random.default_rng(4)
    m = rng.standard_normal((30, 30))
    a = m + m.T
    u = whitening.polar(a, 0.9 / np.linalg.cond(a))
    assert np.abs(u @ u - np.eye(30)).max() < 1e-12 and np.linalg.eigvalsh((u @ a + a @ u) / 2).min() > 0
