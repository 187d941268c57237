"""Sharding, mixing and nearest neighbours."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import imi, mixing, queries, sharding

DOCS = "doc_id long, text string"


def test_sharding_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op3_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    slots = defaultdict(list)
    for r in out:
        body = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key") and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rendezvous(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    shards = keys.select("k", *[sharding.rendezvous(F.col("k"), [1.0] * n).alias(f"s{n}") for n in (7, 8)], sharding.rendezvous(F.col("k"), [1, 0, 3]).alias("w")).collect()
    moved = [r for r in shards if r.s7 != r.s8]
    assert all(r.s8 == 7 for r in moved) and abs(len(moved) / 20_000 - 1 / 8) < 0.02
    counts = Counter(r.w for r in shards)
    assert set(counts) == {0, 2} and abs(counts[2] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("k"), [0.0])


def test_sharding_edges(spark):
    rows = [(1, "é"), (1, "é"), (2, None), (None, ""), (None, None), (3, "x" * 100_000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("own")).withColumn("shard", F.lit(-1))
    for buckets in (1, 500_000):
        out = sharding.assign_shards(df, 3, rows_per_bucket=buckets).collect()
        assert len(out) == 6 and Counter(r.size for r in out) == {10: 2, 8: 3, 100_008: 1}
        by = defaultdict(list)
        for r in out:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.assign_shards(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(df, 3, weights=[1.0])


def slow_targets(sizes, weights, share=1.5, cap=2.0):
    """The water level by bisection."""
    low, high = 0.0, 1e15
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights)) < share * sum(sizes) else (low, mid)
    return [min(cap * s, high * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("seed", range(6))
def test_targets(seed):
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.integers(0, 10_000, 9)]
    weights = [(3, 1, 2)[i % 3] for i in range(9)]
    assert mixing.targets(sizes, weights) == pytest.approx(slow_targets(sizes, weights), rel=1e-6, abs=1e-6)


def test_tree_deals_everything():
    rng = np.random.default_rng(0)
    out = mixing.splitting_tree(np.array([100, 0, 7, 1]), 6, rng)
    assert out.sum(0).tolist() == [100, 0, 7, 1] and (out >= 0).all() and np.ptp(out.sum(1)) <= 3


def test_mixing_query(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op5_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    sizes, taken = Counter(), Counter()
    for r in out:
        assert r.size == len(docs[r.doc_id].text.encode().split()) and 0 <= r.taken <= 2 * r.size and len(r.shards) == r.copies
        sizes[docs[r.doc_id].source] += r.size
        taken[docs[r.doc_id].source] += r.taken
    names = sorted(sizes)
    wanted = dict(zip(names, slow_targets([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])))
    for r in out:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(wanted[s])
    assert all(abs(taken[n] - wanted[n]) <= 0.02 * wanted[n] for n in names)
    again = queries.op5_mixing(spark, sf_dir).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixing_edges(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "c", None), (None, "d e f", None), (4, "", ""), (5, "w " * 50_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit(0)).withColumn("_h", F.lit(0))
    out = mixing.mix_sources(df, docs_per_block=1).collect()
    assert len(out) == 7 and all(r.taken <= 2 * r.size for r in out)
    assert sorted(r.size for r in out) == [0, 0, 1, 2, 2, 3, 50_000]
    assert mixing.mix_sources(df.limit(0)).count() == 0
    twice = mixing.mixture_rows(df)
    assert twice.columns == df.columns


def test_shards_are_written(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixing.write_shards(docs, str(tmp_path / "mix"), mixing.Mixture(shards=4))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == mixing.mix_sources(docs).agg(F.sum("copies")).first()[0]


def brute(rows, k=10):
    """All distances, exactly."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    good = list({(i, v.tobytes()): (i, v) for i, v in good}.values())
    out = {}
    for q, x in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in good if i != q)[:k]
            out[q] = near
    return out


def test_nearest_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    truth, found = brute(rows), defaultdict(list)
    for r in queries.op4_nearest(spark, sf).collect():
        found[r.query_id].append((r.rank, r.score, r.vec_id))
    hits = 0
    for q, near in truth.items():
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 11)) and [(s, i) for _, s, i in got] == sorted((s, i) for _, s, i in got)
        hits += len({i for _, i in near} & {i for _, _, i in got})
    assert hits >= 0.9 * 10 * len(truth)


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0, 3.0]), (700, [])]
    rows += [(i, [1.0, 0.0]) for i in range(1, 40)] + [(i, [2.0, float(i)]) for i in range(50, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    out = defaultdict(list)
    for r in imi.nearest(df, F.col("vec_id") % 100 == 0, recall=1.0).collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(out) == [0, 100]
    assert sorted(out[0]) == [(i, i, 0.0) for i in range(1, 11)]
    assert sorted(out[100]) == [(i + 1, i, 0.0) for i in range(10)]
    few = imi.nearest(df.filter("vec_id in (0, 50, 51)"), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in few] == [(50, np.sqrt(2501.0)), (51, np.sqrt(2602.0))]
    assert imi.nearest(df.limit(0), F.lit(True)).count() == 0
    assert imi.nearest(df.filter("vec_id = 100"), F.lit(True)).count() == 0
