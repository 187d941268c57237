"""Density clusters against plain ones: all neighbours count, copies and crowds too."""

from collections import Counter

import numpy as np
import pytest

from corpuslab.operators import neighbours as near
from corpuslab.operators import topics


def plain(x, reach, min_samples, min_cluster_size):
    """``topic, probability`` by definition, from all pairs."""
    n, limit = len(x), reach * (1 + 1e-12)
    close = np.stack([np.sqrt(((x - one) ** 2).sum(1)) <= limit for one in x])
    k = close.sum(1)
    dense, root = k >= min_samples, list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in np.argwhere(close & dense[:, None] & dense[None]).tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    own = [find(a) if dense[a] else -1 for a in range(n)]
    for a in np.flatnonzero(~dense & (close & dense[None]).any(1)).tolist():
        own[a] = min((-k[b], find(b)) for b in np.flatnonzero(close[a] & dense).tolist())[1]
    size = Counter(r for r in own if r >= 0)
    most = {r: max(k[a] for a in range(n) if own[a] == r) for r in size}
    number = {r: t for t, r in enumerate(sorted((r for r in size if size[r] >= min_cluster_size), key=lambda r: (-size[r], r)))}
    return [(number[r], float(k[a] / most[r])) if r in number else (-1, 0.0) for a, r in enumerate(own)]


def found(spark, x, kind="double", **settings):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], f"i int, v array<{kind}>").coalesce(1)
    return [(r.topic_id, pytest.approx(r.probability)) for r in sorted(topics.density_clusters(df, "v", **settings).collect(), key=lambda r: r.i)]


@pytest.mark.parametrize("cell", [512, 40])
def test_every_neighbour_counts(spark, monkeypatch, cell):
    """Evenly spread vectors, which no hash tells apart, and clusters of which most are ruled out unseen."""
    monkeypatch.setattr(near, "CELL_POINTS", cell)
    monkeypatch.setattr(near, "ROWS", 16)
    monkeypatch.setattr(near, "COLUMNS", 100)
    rng = np.random.default_rng(1)
    even = rng.normal(size=(700, 64))
    even = (even / np.sqrt((even**2).sum(1))[:, None]).astype(np.float32).astype(float)
    far = np.sort(np.sqrt(((even[:, None] - even[None]) ** 2).sum(2)), 1)
    for reach in (float(np.quantile(far[:, 3], 0.6)), float(np.quantile(far[:, 3], 0.2))):
        assert found(spark, even, "float", min_cluster_size=3, min_samples=4, reach=reach) == plain(even, reach, 4, 3)
    groups = rng.normal(size=(900, 3)) * rng.choice([0.1, 0.4, 2.0], 900)[:, None] + 50 + rng.integers(0, 4, (900, 3)) * 8
    for reach in (0.15, 0.7):
        assert found(spark, groups, min_cluster_size=4, min_samples=5, reach=reach) == plain(groups, reach, 5, 4)


def test_reach_on_the_very_distance(spark):
    """Far from the origin, where a product of 32-bit numbers tells nothing, and with pairs just at the reach."""
    grid = np.array([(a, b) for a in range(20) for b in range(20)], float) / 8 + 4000
    for reach, samples in ((1 / 8, 5), (1 / 8 - 1e-9, 2), (2**0.5 / 8, 9)):
        assert found(spark, grid, min_cluster_size=1, min_samples=samples, reach=reach) == plain(grid, reach, samples, 1)


def test_copies(spark):
    """Copies are points of their own, though only one of them is compared; also where all the reach is 0."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 2)), 1)
    x = np.concatenate([x, x[:40], np.repeat(x[:2], 30, 0)])
    assert found(spark, x, min_cluster_size=3, min_samples=6, reach=0.15) == plain(x, 0.15, 6, 3)
    same = np.concatenate([np.repeat([[1.0, 2.0]], 60, 0), np.repeat([[5.0, 5.0]], 40, 0), [[9.0, 9.0]]])
    assert found(spark, same, min_cluster_size=30, min_samples=5) == [(0, 1.0)] * 60 + [(1, 1.0)] * 40 + [(-1, 0.0)]


def test_a_crowd_costs_no_pairs(spark):
    """3,000 points in reach of one another: 4.5 million pairs, but a few rows a point."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 0.1, (3000, 2))
    points = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "u long, w long, x array<double>")
    rows = near.neighbours(points, x[:50], 1.0, 4).collect()
    assert Counter(r.u for r in rows if r.v is None).keys() == set(range(3000)) and len(rows) < 3000 * 3 * near.GROUPS
    assert sum(r.k for r in rows if r.v is None) == 3000 * 2999
    assert found(spark, x, min_cluster_size=5, min_samples=4, reach=1.0) == [(0, 1.0)] * 3000


def test_vectors_that_are_none(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(20)] + [(20, None), (21, []), (22, [None, 1.0]), (23, [float("nan"), 1.0]), (24, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    out = {r.i: r.topic_id for r in topics.density_clusters(df, "v", min_cluster_size=5, min_samples=4, reach=0.5).collect()}
    assert all(out[i] == i % 2 for i in range(20)) and {out[i] for i in range(20, 25)} == {-1}
    with pytest.raises(ValueError, match="2 to 3 components"):
        topics.density_clusters(spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "v array<double>"), "v")
