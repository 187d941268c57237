"""Near-duplicates without loss, of repeated ids, and of buckets that are compared in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import common, neardup
from tests.llm.test_text_matching import DOCS, components, family, found


def apart(rng, size, share, words=80, start=0):
    """Variants of one text that are mostly below the threshold to one another."""
    base = [f"a{start}w{i}" for i in range(words)]
    return [(start + k, " ".join(f"e{start}_{rng.randrange(10**6)}" if rng.random() < share else w for w in base)) for k in range(size)]


@pytest.mark.parametrize("exact", [False, True])
def test_blocks_of_a_bucket(spark, monkeypatch, exact):
    monkeypatch.setattr(neardup, "ROWS_A_CELL", 7)
    rng = random.Random(5)
    rows = apart(rng, 70, 0.02) + apart(rng, 50, 0.012, 90, 1000) + family(rng, 30, 3, 60, 2000)
    df = spark.createDataFrame(rows, DOCS)
    for percent in (80, 85):
        out = neardup.near_duplicates(df, percent=percent, exact=exact).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == components(rows, percent)


def test_exact_at_low_similarity(spark):
    """At 30 hundredths bands are of one coordinate, and only the exact way proves that nothing is lost."""
    rng = random.Random(6)
    rows = apart(rng, 40, 0.12) + apart(rng, 40, 0.2, 40, 1000) + [(5000, "one"), (5001, "ONE"), (5002, None), (5003, "")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), percent=30, exact=True).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == components(rows, 30)


def test_ids_that_repeat_with_other_texts(spark):
    """Each row is in the component of its own text, and goes or stays with it."""
    rng = random.Random(7)
    a, b, c = (family(rng, 6, 2, 60, s) for s in (100, 200, 300))
    rows = [(i, t) for i, t in a + b + c] + [(100, b[0][1]), (100, c[0][1]), (305, a[3][1]), (1, "alone in the world of texts"), (1, "another text of the same id")]
    assert found(spark, rows) == components(rows)
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    least = {}
    for (i, _), (_, _, name) in zip(sorted(rows, key=lambda r: str((r[0], len(r[1])))), components(rows)):
        least.setdefault(name, i)
    out = {(r.doc_id, r.text) for r in kept.collect()}
    assert {(1, "alone in the world of texts"), (1, "another text of the same id")} <= out
    assert all(i == 100 or i in least for i, _ in out) and (305, a[3][1]) not in out and (100, c[0][1]) in out


@pytest.mark.parametrize("small", [1 << 30, 0])
def test_kept_rows_and_clashing_names(spark, monkeypatch, small):
    """The same rows, whether ids are broadcast or meet the rows behind a bitmap."""
    monkeypatch.setattr(common, "MAX_BROADCAST_BYTES", small)
    rng = random.Random(8)
    rows = family(rng, 20, 2) + [(None, "null id"), (900, "x y z")]
    names = ["_gone", "_id", "_key", "_maybe", "_piece", "_bits", "row", "h", "node", "key"]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(n) for n in names})
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i, _, n in components(rows) if i == n])


def test_bitmap_tells_ids_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_BROADCAST_BYTES", 0)
    df = spark.range(5000).select("id", F.col("id").cast("string").alias("x"))
    ids = spark.range(0, 10_000, 7).select(F.col("id").alias("gone"))
    rows = common.packed(df, _key=F.col("id"))
    marked = common._marked(rows, ids.select(F.col("gone").alias("_id")))
    assert marked.filter("_key % 7 = 0 and not _maybe").count() == 0 and marked.filter("_key % 7 <> 0 and _maybe").count() < 5
    assert common.without(df, F.col("id"), ids).count() == 5000 - 715
    assert common.among(df, F.col("id"), ids.select(F.col("gone").alias("_id"))).count() == 715
    monkeypatch.setattr(common, "BITMAP_IDS", 0)
    assert common.without(df, F.col("id"), ids).count() == 5000 - 715
    assert not common.fits(ids) and common.fits(ids, 10**9)
