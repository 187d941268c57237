"""Queries see the documents of all languages."""

import pytest
from pyspark.sql import functions as F

from corpuslab.plans import catalog

TEXTS = {1: ("en", "The quick cat saw the quick dog."), 2: ("de", "Die Äpfel und die Äpfel sind grün."), 3: ("en", "A naïve café, a naïve view."), 4: ("el", "Η γάτα και η γάτα.")}


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("few")
    docs = spark.createDataFrame([(i, t, lang, "web", len(t)) for i, (lang, t) in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, [0.0, 1.0], 3), (2, [1.0, 0.0], 4), (3, [1.0, 1.0], 5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_topic_docs(spark, few):
    rows = {r["doc_id"]: r for r in catalog.topic_docs(spark, few).collect()}
    assert {i: r["topic_id"] for i, r in rows.items()} == {1: 3, 2: 4, 3: 5, 4: -1}
    assert rows[2]["tokens"] == "die äpfel und die äpfel sind grün".split() and rows[3]["tokens"] == "a naïve café a naïve view".split()


def test_embed(spark, few):
    assert {r["doc_id"] for r in catalog.q_embed(spark, few).collect()} == set(TEXTS)


def test_spans(spark, few):
    """Noise has no keywords, hence no spans."""
    assert {r["doc_id"] for r in catalog.q_spans(spark, few).collect()} == {1, 2, 3}


def test_coherence(spark, few):
    assert {r["topic_id"] for r in catalog.q_c_v_coherence(spark, few).collect()} == {3, 4, 5}


def test_draws(spark, few):
    found = {r["prev"] for r in catalog.q_fill_top_k_top_p(spark, few).collect()}
    assert found == {w for _, t in TEXTS.values() for w in ["<s>", *t.lower().split()[:-1]]}


def test_infill(spark, few):
    pairs = catalog.masked_pairs(spark, few)
    other = [r["original"] for r in pairs.filter(F.col("topic_id") == 4).collect()]
    assert any("pfel" in t for t in other)
    assert {r["pair_id"] for r in catalog.q_infill(spark, few).collect()} == {r["pair_id"] for r in pairs.collect()}
