"""Rows with null or repeated ids are mixed like others, and the rows of the mix are those that the tree's shards draw."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def test_repeated_ids_of_two_sources(spark):
    """Each input row comes out once, whatever block it lies in."""
    rows = [(i, " ".join(["w"] * (3 + (i * 7 + k) % 11)), s) for i in range(40) for k, s in enumerate("ab")]
    out = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), mixing.Mixture()).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((i, s, len(t.split())) for i, t, s in rows)


def test_null_ids_of_two_sources(spark):
    rows = [(None, " ".join([f"w{k}"] * (3 + i)), s) for i in range(30) for k, s in enumerate("ab")]
    out = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), mixing.Mixture()).collect()
    assert Counter((r["source"], r["size"]) for r in out) == Counter((s, len(t.split())) for _, t, s in rows)


def messy(seed, n=900):
    """Null ids, ids repeated with the same and other texts, in one source and several; a third of all rows are one row."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, rng.randrange(60), i]), f"t{rng.randrange(400)} " + "w " * rng.randrange(14), rng.choice(["a", "b", None, ""])) for i in range(n)]
    return rows + [(7, "hot row " * 3, "b")] * (n // 2)


@pytest.mark.parametrize("seed, block", [(1, 2048), (2, 64)])
def test_messy_rows(spark, seed, block):
    rows = messy(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = mixing.mix_sources(docs, docs_per_block=block).collect()
    words = lambda t: len(t.split())
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((i, s, words(t)) for i, t, s in rows)
    taken, goal = Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] and len(r["shards"]) == r["copies"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert set(goal) == {"a", "b", None, ""} and all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] for s in goal)
    # the rows of the mix are the same draw
    mixed = mixing.mixture_rows(docs, docs_per_block=block)
    assert mixed.columns == docs.columns
    got, wanted = Counter((r["doc_id"], r["source"], words(r["text"])) for r in mixed.collect()), Counter()
    for r in out:
        wanted[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert {k: n for k, n in got.items() if k[2]} == {k: n for k, n in wanted.items() if k[2] and n}


def test_plan_shards_are_the_trees():
    """Shards draw disjoint runs of the offered blocks, as many of each source as their leaf holds."""
    sizes, n_blocks = [1000, 300], [10, 3]
    totals = pd.DataFrame([(0, b, 100) for b in range(10)] + [(1, b, 100) for b in range(3)], columns=["_src", "_block", "words"])
    mixture = mixing.Mixture(shards=4)
    blocks, gaps = mixing._plan(sizes, n_blocks, [1450.0, 600.0], totals, mixture)
    quota = blocks.groupby("_src")["_shards"].apply(lambda s: sum(map(len, s))).tolist()
    assert quota == [15, 6] and gaps[["_src", "_gap"]].values.tolist() == [[0, 50.0]]
    drawn = Counter((s, r["_src"]) for _, r in blocks.iterrows() for s in r["_shards"])
    per_shard = [drawn[s, 0] + drawn[s, 1] for s in range(4)]
    assert max(per_shard) - min(per_shard) <= 1
    assert blocks["_open"].sum() == 1 and blocks["_shards"].apply(len).max() == 2


def test_fill_ends_near():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(0, 400, 60)
        part = pd.DataFrame({"_src": 0, "_h": np.arange(60), "_c": 1, "_words": sizes, "_gap": float(rng.integers(100, 5000))})
        out = mixing._fill(part)
        assert abs(sizes[out["_h"]].sum() - part["_gap"][0]) <= 3


def test_splits_a_repeated_row(spark):
    """Of a thousand equal rows that are all a source has, as many are taken as the target says."""
    docs = spark.createDataFrame([(1, "a b", "x")] * 1000 + [(2, "c d e", "y")] * 3000, SCHEMA).repartition(5)
    out = mixing.mix_sources(docs).collect()
    taken, goal = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) < 5 for s in goal)
    assert Counter(r["source"] for r in mixing.mixture_rows(docs).collect()) == {"x": taken["x"] // 2, "y": taken["y"] // 3}


def test_clashing_names_and_empty_tables(spark):
    names = ["row", "_key", "_h", "_src", "_block", "_shards", "_open", "_shard", "_order", "shard", "a.b"]
    docs = spark.createDataFrame([(i, f"t{i} x", "ab"[i % 2]) for i in range(50)], SCHEMA).withColumns({n: F.lit(n) for n in names})
    mixed = mixing.mixture_rows(docs)
    assert mixed.columns == docs.columns and all(r["row"] == "row" and r["a.b"] == "a.b" for r in mixed.collect())
    assert mixing.mix_sources(docs).count() == 50
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixture_rows(docs.limit(0)).count() == 0
