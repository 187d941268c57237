"""Decontamination gives the same rows whatever the benchmark's size, and lets each row go by its text."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import common, tiling
from tests.llm.test_text_matching import slow_tiles

SCRIPTS = ["le café de la région était fermé", "हिन्दी भाषा में लिखा हुआ यह", "كَتَبَ الطَّالِبُ الدَّرْسَ", "10 m² and 5 km² Ⅻ times", "ǅ ß İstanbul ſ", "plain old words"]


def tables(seed=3):
    rng = random.Random(seed)
    words = " ".join(SCRIPTS).split() + [f"q{i}" for i in range(40)]
    items = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 20, 30]))) for _ in range(30)]
    items += [items[0].upper(), " ".join(["ha"] * 12), "!? ...", ""]
    docs = []
    for _ in range(60):
        parts = [" ".join(f"z{rng.randrange(99)}" for _ in range(rng.randrange(9)))]
        for t in rng.sample(items, 2):
            w = t.split()
            cut = rng.randrange(len(w) + 1)
            parts += [" ".join(w[cut:]), " ".join(w[:cut])]
        docs.append(" ".join(parts))
    docs += [docs[0], "ha " * 300, None, "", "plain old words"]
    return [(None if i % 9 == 0 else i % 50, t) for i, t in enumerate(docs)], list(enumerate(items))


def brute(docs, items, least=5):
    """All pairs by the definition; items of the same words count once."""
    named = {}
    for i, t in items:
        if tiling.tokens(t):
            named.setdefault(tuple(tiling.tokens(t)), []).append(i)
    out = []
    for doc, text in docs:
        a = tiling.tokens(text)
        for b, ids in named.items():
            tiles = slow_tiles(a, list(b), min(least, len(b))) if set(a) & set(b) else []
            covered = sum(n for _, _, n in tiles)
            if tiles and covered >= 0.5 * len(b):
                out.append((doc, ids[0], tuple(ids), covered))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_both_ways(spark, limit):
    docs, items = tables()
    found = tiling.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_broadcast_bytes=limit).collect()
    wanted = [x for x in brute(docs, items) if x[0] is not None]
    assert Counter((r.doc_id, r.item_id, tuple(r.item_copies), r.matched) for r in found) == Counter(wanted)


@pytest.mark.parametrize("limit, small", [(1 << 20, 1 << 30), (0, 1 << 30), (0, 0)])
def test_rows_go_by_their_text(spark, monkeypatch, limit, small):
    monkeypatch.setattr(common, "MAX_BROADCAST_BYTES", small)
    docs, items = tables(4)
    names = ["hits", "h", "item_id", "row", "_id", "_key", "words", "ids", "seed"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    kept = tiling.drop_leaks(df, spark.createDataFrame(items, "item_id long, text string"), max_broadcast_bytes=limit)
    gone = {t for _, t in docs if brute([(0, t)], items)}
    assert kept.columns == df.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(d for d in docs if d[1] not in gone)
    assert any(i is None for i, t in docs if t in gone) and any(i is None for i, t in docs if t not in gone)


def test_repetitive_texts_take_little_memory():
    """A million agreeing pairs of positions, of which a few thousand runs are kept."""
    index = tiling.TestIndex([([1], ["ha"] * 400)], 5)
    seeds = index._pairs(*[(doc := __import__("numpy").ones(3000, "int64"))], 0, index._seeds(doc)[0])
    assert next(seeds) == (0, 0)
    found = index.find("ha " * 3000, 0.5)
    assert [(h["coverage"], h["tiles"]) for h in found] == [(1.0, 1)]
