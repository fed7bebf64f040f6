"""Whitening against numpy over the distinct vectors, and over odd tables."""

import math

import numpy as np
import pytest

from twinlens.llm import whitening

TABLE = "vec_id long, embedding array<float>, n long, component int, x array<long>, d int"


def rows_of(vectors):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, [3], 4) for i, v in vectors]


@pytest.mark.parametrize("dims", [3, 24])
def test_whitening_by_numpy(spark, dims):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(400, dims)) @ rng.normal(size=(dims, dims))).astype(np.float32)
    vectors = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[0]) for i in range(300)] + [(None, base[1]), (7, base[7])]
    got = whitening.whiten(spark.createDataFrame(rows_of(vectors), TABLE).repartition(3)).toPandas()
    x = np.floor(64 * np.stack([v for _, v in vectors]).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v, k = e[::-1], v[:, ::-1], min(16, dims)
    assert len(got) == k * len(vectors) and set(got["n"]) == {n} and got["component"].tolist() == [*range(1, k + 1)] * len(vectors)
    want = {}
    for (i, _), row in zip(vectors, x, strict=True):
        want.setdefault(i, []).append((int(((n * row - sums) ** 2).sum()), ((n * row - sums) / n) @ v[:, :k] / np.sqrt(e[:k])))
    sign = None
    for start in range(0, len(got), k):
        own = got.iloc[start : start + k]
        i = own["vec_id"].iloc[0]
        deviation, white = want[None if i is None or math.isnan(i) else int(i)][0]
        assert set(own["deviation"]) == {deviation}
        sign = np.sign(white * own["whitened"]) if sign is None else sign
        assert np.allclose(white * sign, own["whitened"], rtol=1e-8, atol=1e-9)
        assert np.allclose(own["explained"], e[:k] / e.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_odd_vectors(spark):
    rows = rows_of([(1, [1, 2]), (2, [1, 2]), (3, None), (4, [1, None]), (5, [math.nan, 1]), (6, [math.inf, 1]), (7, []), (8, [1, 2, 3]), (9, [2, 2, 3]), (None, [2, 2, 3])])
    got = {(r["vec_id"], r["component"]): tuple(r)[2:] for r in whitening.whiten(spark.createDataFrame(rows, TABLE)).collect()}
    assert set(got) == {(i, k) for i, ks in ((1, 2), (2, 2), (8, 3), (9, 3), (None, 3)) for k in range(1, ks + 1)}
    assert got[1, 1] == got[2, 2] == (1, 0, None, None, None)  # one distinct vector: no variance
    assert got[8, 1][:2] == (2, 64 * 64) and abs(got[8, 1][2]) == pytest.approx(1) and got[8, 1][3] == pytest.approx(1) and got[8, 2][2] is None
    assert got[9, 1] == got[None, 1] and got[9, 1][2] == -got[8, 1][2]
    assert whitening.whiten(spark.createDataFrame([], TABLE)).collect() == []


def test_long_ids_beside_null_ones(spark):
    rows = rows_of([(2**62 + 1, [1, 2]), (None, [3, 5]), (2**62 + 3, [0, 0])])
    got = whitening.whiten(spark.createDataFrame(rows, TABLE).coalesce(1))
    assert sorted((r["vec_id"] or 0) for r in got.where("component = 1").collect()) == [0, 2**62 + 1, 2**62 + 3] and dict(got.dtypes)["vec_id"] == "bigint"


def test_sums_beyond_64_bits():
    space = whitening.Space(1 << 31, np.array([0]), np.ones((1, 1)), np.ones(1))
    y = space.centred(np.array([[1], [1 << 40]]))
    assert y.tolist() == [[1 << 31], [1 << 71]]
    assert space.deviations(y) == [1 << 62, None]
