"""Shards by an independent hash, slots under hot keys, and clashing names."""

import math
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslab.llm import sharding


def plain_shard(key, weights):
    """The greatest -w / ln(u), with u from XXH64 of the shard's name seeded by that of the key."""
    best = []
    for i, w in enumerate(weights):
        if w > 0:
            h = xxhash.xxh64(f"|{i}".encode(), seed=xxhash.xxh64(("null" if key is None else key).encode(), seed=42).intdigest()).intdigest()
            best.append((-w / math.log(((h >> 12) + 0.5) / 2**52), -i))
    return -max(best)[1]


@pytest.mark.parametrize("weights", [[1.0] * 24, [1.0, 0.0, 2.5], [1.0]])
def test_shards_by_brute_force(spark, weights):
    keys = [None, "", "é", *map(str, range(3000))]
    df = spark.createDataFrame([(k, "t") for k in keys], "k string, text string")
    rows = sharding.assign_shards(df, len(weights), key="k", weights=weights).collect()
    assert all(r.shard == plain_shard(r.k, weights) and r.grown_shard == plain_shard(r.k, [*weights, sum(weights) / len(weights)]) for r in rows)


@pytest.mark.parametrize("bucket", [20, 500_000])
def test_hot_keys(spark, bucket):
    """A third of the rows share a key and text, another third a null key."""
    rows = [(7, "hot")] * 400 + [(None, f"t{i}") for i in range(400)] + [(i, "x" * (i % 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    slots = defaultdict(list)
    for r in sharding.assign_shards(df, 5, rows_per_bucket=bucket).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 1200 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_clashing_names(spark):
    names = ["_bucket", "_first", "_best", "_part", "_n", "_key", "row", "n", "slot", "a.b"]
    df = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    out = sharding.assign_shards(df, 3)
    assert out.columns == [c for c in df.columns if c != "slot"] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert all(r["_bucket"] == "_bucket" and r["row"] == "row" and r["a.b"] == "a.b" for r in out.collect()) and out.count() == 30
