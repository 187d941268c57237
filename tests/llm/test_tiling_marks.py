"""Both paths of the decontamination see the same words in text with combining marks."""

import pytest

from corpuslab.llm import tiling

ITEMS = [
    (1, "Le café de la région était fermé ce matin de février"),
    (2, "हिन्दी भाषा में लिखा हुआ यह एक परीक्षण वाक्य है"),
    (3, "كَتَبَ الطَّالِبُ الدَّرْسَ فِي البَيْتِ ثُمَّ خَرَجَ"),
    (4, "plain words of a question that has no marks at all"),
]


@pytest.mark.parametrize("limit", [tiling.MAX_BROADCAST_BYTES, 0])
def test_paths(spark, limit):
    docs = spark.createDataFrame([(10 + i, f"before it {t} and after it") for i, t in ITEMS], "doc_id long, text string")
    found = tiling.find_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), max_broadcast_bytes=limit).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"], r["matched"]) for r in found) == [(10 + i, i, 1.0, len(tiling.tokens(t))) for i, t in ITEMS]
