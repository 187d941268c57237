"""What part of the entries a search collects, and what it finds there, on thousands of vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import imi, queries


def vectors(kind, n=4000, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        x = rng.normal(size=(40, dim))[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, dim))
    else:
        x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(rows, found, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        near = ids[np.lexsort((ids, d))[:k]]
        hits += len(set(near.tolist()) & found[ids[q]])
        total += k
    return hits / total


@pytest.mark.parametrize("kind, most", [("clusters", 0.1), ("even", 1.0)])
def test_recall_and_share(spark, kind, most):
    x = vectors(kind)
    index = imi.fit(x, 63)
    assert index.share <= most
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumns({n: F.lit(n) for n in ("id", "v", "q", "h", "score", "rank")})
    found: dict = {}
    for r in imi.nearest(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(found) == 40 and recall(list(enumerate(x)), found) >= 0.9


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found: dict = {}
    for r in queries.op4_nearest(spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert recall(rows, found) >= 0.9


def test_walk_takes_cells_in_order():
    """The heap gives the cells of least summed distance, until enough entries are collected."""
    x = vectors("even", 500, 8)
    index = imi.fit(x, 6)
    one, two = index.cells(x)
    counts = np.zeros((6, 6), np.int64)
    np.add.at(counts, (one, two), 1)
    for q in x[:20]:
        sums = imi.squared(q[None, :4], index.first)[0][:, None] + imi.squared(q[None, 4:], index.second)[0][None]
        for wanted in (1, 50, 200, 10_000):
            flags, left, expected = index.traverse(q, counts, wanted), wanted, np.zeros((6, 6), bool)
            for c in np.argsort(sums.ravel(), kind="stable"):
                i, j = divmod(int(c), 6)
                if left <= 0:
                    break
                if counts[i, j]:
                    expected[i, j], left = True, left - counts[i, j]
            assert (flags == expected).all()


def test_only_visited_cells_are_compared(monkeypatch):
    import pandas as pd

    x = vectors("even", 60, 6)
    entries = pd.DataFrame({"v": [v.tobytes() for v in x], "c2": np.arange(60) % 3, "ids": [[i] for i in range(60)]})
    seen = np.array([[True, False, False], [False, True, True]])
    asked = pd.DataFrame({"id": [100, 200], "v": [x[0].tobytes(), x[1].tobytes()], "seen": [s.tobytes() for s in seen]})
    pairs, real = [], imi.squared
    monkeypatch.setattr(imi, "squared", lambda a, b: pairs.append(len(a) * len(b)) or real(a, b))
    out = imi._rerank(3)(entries, asked)
    assert sum(pairs) == 60
    for q, cells in ((100, {0}), (200, {1, 2})):
        got = out[out["query_id"] == q]
        own = [(float(np.sqrt(((x[i] - x[0 if q == 100 else 1]) ** 2).sum())), i) for i in range(60) if i % 3 in cells]
        assert [(round(s, 12), v) for s, v in zip(got["score"], got["vec_id"])] == [(round(s, 12), v) for s, v in sorted(own)[:3]]
