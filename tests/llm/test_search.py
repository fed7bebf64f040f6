"""Top-k search over several centres, odd vectors, and how much the bounds and the stopping test leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.llm import search


def clusters(n=3000, dims=32, centres=30, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * 4
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * 0.4


def test_projection_stops_on_clusters_and_finds_them():
    rows = clusters()
    queries, seen = rows[::40], []
    place, dist = search.projected_neighbours(queries, rows, 10, tally=seen)
    true = np.sqrt(((queries[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2))
    want = np.argsort(true, axis=1, kind="stable")[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(place.tolist(), want.tolist(), strict=True)]) >= 0.9
    verified, read, possible = (sum(x) for x in zip(*seen, strict=True))
    assert verified < 0.25 * possible and read < 0.6 * possible
    assert np.allclose(dist, np.take_along_axis(true, place, 1), rtol=1e-12)


def test_a_known_distance_leaves_out_more():
    rows, seen, again = clusters(), [], []
    queries = rows[::40]
    _, dist = search.projected_neighbours(queries, rows, 10, tally=seen)
    search.projected_neighbours(queries, rows, 10, known=dist[:, -1], tally=again)
    assert sum(x[0] for x in again) < sum(x[0] for x in seen)


def test_chi_square_quantile():
    assert search.chi_square_at(0.95, 8) == pytest.approx(15.507313, rel=1e-6)


@pytest.mark.parametrize("whole", [True, False])
def test_blocks_of_several_centres(spark, whole):
    rows = clusters(900, 8, 12)
    if whole:
        rows = np.floor(rows * 256).astype(np.int64)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], f"id long, vec array<{'long' if whole else 'double'}>").repartition(4)
    measure = search.Products() if whole else search.Distances(confidence=0.999999, ratio=1.0)
    got = search.block_search(df, 30, 4, measure, index_block=60, query_block=3)
    known = rows @ rows.T if whole else np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2))
    want = set()
    for q in range(0, 900, 30):
        ranked = sorted(((-known[q, i] if whole else known[q, i]), i) for i in range(900) if i != q)[:4]
        want |= {(q, r + 1, i) for r, (_, i) in enumerate(ranked)}
    assert {(r.query_id, r["rank"], r.vec_id) for r in got.collect()} == want


def test_centres_drop_blocks():
    far = search.Distances()
    a, b = np.zeros(search.DIMS), np.full(search.DIMS, 100.0)
    assert not far.may_hold(a, 1.0, b, 1.0, 1.0) and far.may_hold(a, 1.0, a, 1.0, 1.0) and far.may_hold(a, 1.0, b, 1.0, np.inf)
    top = search.Products()
    assert not top.may_hold(np.array([1.0, 0]), 0.1, np.array([-1.0, 0]), 0.1, 0.5) and top.may_hold(np.array([1.0, 0]), 0.1, np.array([1.0, 0]), 0.1, 0.5)


def test_large_components_are_exact():
    rng = np.random.default_rng(3)
    for size in (10**6, 2**30, 2**61):
        rows = rng.integers(-size, size, (300, 64))
        place, score = search.dual_tree_products(rows[:5], rows, 3)
        for q in range(5):
            exact = [min(max(sum(int(x) * int(y) for x, y in zip(rows[q], r, strict=True)), -(2**63)), 2**63 - 1) for r in rows]
            order = sorted(range(300), key=lambda i: (-exact[i], i))[:3]
            assert score[q].tolist() == [exact[i] for i in order] and place[q].tolist() == order


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0, 3.0]), (1, [2.0, 2.0]), (2, [0.5, 0.5, 0.5]), (3, [1e30, 1.0]), (4, [2.0, 2.0]), (4, [-1.0, 0.0]), (100, []), (5, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id) for r in search.exact_top_products(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 1), (0, 3, 5), (0, 4, 4), (50, 1, 2)]  # of the two vectors of 4 the least counts
    near = [(r.query_id, r["rank"], r.vec_id) for r in search.nearest_by_projection(df).orderBy("query_id", "rank").collect()]
    assert near == [(0, 1, 5), (0, 2, 1), (0, 3, 4), (0, 4, 3)]
