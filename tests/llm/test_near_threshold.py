"""The near-duplicates stage takes similarities from 0.80, and its banding follows the threshold."""

import math

import pytest

import corpus_pipeline
from corpuslab.llm import neardup


def text(start, end=0):
    words = [f"w{start}_{i}" for i in range(60)]
    return " ".join(words[: 60 - end] + [f"x{start}_{end}_{i}" for i in range(end)])


def test_stage(spark):
    """Of 56 shingles a document, 50 of 62 (0.806) and 51 of 61 (0.836) are common; 49 of 63 (0.778) are too few."""
    rows = [(i * 10 + j, text(i, end)) for i, e in enumerate((5, 6, 7)) for j, end in enumerate((0, e))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 10, 20, 21]
    assert {r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {0, 1, 10, 11, 20, 21}


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 90, 95])
def test_banding(percent):
    bands, rows, least = neardup.banding(percent)
    p, n = percent / 100, bands * rows
    assert (1 - p**rows) ** bands <= neardup.BAND_LOSS
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least)) <= neardup.AGREEING_LOSS


def test_banding_of_the_query():
    assert neardup.banding(85) == (26, 5, 90)
