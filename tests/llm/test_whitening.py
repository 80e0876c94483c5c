import math

import numpy as np
import pytest

from recordwell.llm import whitening

VEC = "vec_id long, embedding array<float>, label int, x binary, component int"


def rows_of(spark, vectors):
    return spark.createDataFrame([(k, v, 1, b"x", 7) for k, v in vectors], VEC)


def brute(vectors, components=4):
    """Straight from the definition, by exact integers and one covariance."""
    x = {k: [math.floor(256 * float(np.float32(c))) for c in v] for k, v in vectors}
    distinct = sorted(set(map(tuple, x.values())))
    n, total = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array(distinct, float) - np.array([s / n for s in total])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    out = {}
    for k, v in x.items():
        w = (np.array(v) - np.array([s / n for s in total])) @ vector / np.sqrt(np.where(value > 1e-9, value, np.nan))
        out[k] = (n, sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True)), w, value / np.trace(centred.T @ centred / n))
    return out


def test_equals_brute_force_with_copies_and_odd_rows(spark):
    random = np.random.default_rng(3)
    vectors = [(k, random.normal(0, [3, 2, 1, 0.5, 0.1, 0.1]).tolist()) for k in range(60)]
    vectors += [(100 + k, vectors[0][1]) for k in range(40)]  # a third of all rows is one vector
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, [1.0, 2.0]), (205, [])]
    got = whitening.whitened(rows_of(spark, vectors + odd)).collect()
    want = brute(vectors)
    assert {r.vec_id for r in got} == set(want) and len(got) == 4 * len(vectors)
    sign = {}
    for r in got:
        n, deviation, w, explained = want[r.vec_id]
        k = r.component - 1
        sign.setdefault(k, 1 if r.whitened * w[k] >= 0 else -1)
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(sign[k] * w[k], abs=1e-8) and r.explained == pytest.approx(explained[k], rel=1e-9)
        assert r.identity_error < 1e-9


def test_few_dimensions_constant_vectors_and_huge_entries(spark):
    got = whitening.whitened(rows_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 4.0])])).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component, r.whitened) for r in got] == [(1, 1, pytest.approx(-1.0)), (1, 2, None), (2, 1, pytest.approx(1.0)), (2, 2, None)]
    one = whitening.whitened(rows_of(spark, [(1, [0.5, 0.5])])).collect()
    assert [(r.whitened, r.deviation, r.explained, r.identity_error) for r in one] == [(None, 0, None, None)] * 2
    huge = whitening.whitened(rows_of(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (None, [0.0, 0.0])])).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id == 1} == {None}
    assert whitening.whitened(rows_of(spark, [])).count() == 0 and whitening.whitened(rows_of(spark, [(1, None)])).count() == 0


def test_packing_keeps_vectors_apart():
    x = [np.array(v) for v in ([1, -1], [1 << 15, 0], [-(1 << 15), 0], [1, 0])]
    assert len({whitening.packed(v) for v in x}) == 4
    assert all((whitening.unpacked(__import__("pyarrow").array([whitening.packed(v)]))[0] == v).all() for v in x)
