"""Operators against plain versions of themselves."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import graph, infill, masking, probing, quality, splits, topics
from corpuslab.sources import io


def test_rounding_is_pythons(spark):
    values = sorted({a / b for b in range(1, 200) for a in range(b + 1)} | {1 / 16, 7 / 80, 0.0625, 2.5, 12.345, 0.0005, 0.0015})
    for digits in (2, 3):
        rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", T.round_half_even(F.col("x"), digits).alias("r")).collect()
        assert all(r.r == round(r.x, digits) for r in rows)


TEXT = ["the red ship", "the red sea", "the old ship", "a ship", "the a", "red a b c d e f g"]


def plain_cut(counts, strategy, top_k=10, top_p=0.9, temperature=1.0):
    """Temperature, top-k, nucleus, over all candidates."""
    order = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    w = [(t, c ** (1 / temperature)) for t, c in order]
    if strategy == "greedy":
        return [(order[0][0], order[0][1] / sum(counts.values()))]
    if "top_k" in strategy:
        w = w[:top_k]
    if "top_p" in strategy:
        total, kept, s = sum(x for _, x in w), [], 0.0
        for t, x in w:
            if s / total >= top_p - 1e-12:
                break
            kept.append((t, x))
            s += x
        w = kept
    total = sum(x for _, x in w)
    return [(t, x / total) for t, x in w]


@pytest.mark.parametrize("strategy, params", [("greedy", {}), ("top_k", {"top_k": 2}), ("top_p", {"top_p": 0.6}), ("top_k_top_p", {"top_k": 3, "top_p": 0.5, "temperature": 0.7}), ("temperature", {"temperature": 2.0})])
def test_distributions(spark, strategy, params):
    model = defaultdict(Counter)
    for s in TEXT:
        for a, b in zip(["<s>", *s.split()], s.split()):
            model[a][b] += 1
    df = spark.createDataFrame([(s,) for s in TEXT], "sentence string")
    found = defaultdict(list)
    for r in infill.distribution(infill.bigram_model(df), strategy, **params).orderBy("prev", "rank").collect():
        found[r.prev].append((r.token, r.p, r.lo, r.hi))
    assert set(found) == set(model)
    for prev, counts in model.items():
        wanted, at = plain_cut(counts, strategy, **params), 0.0
        assert [t for t, *_ in found[prev]] == [t for t, _ in wanted]
        for (_, p, lo, hi), (_, q) in zip(found[prev], wanted):
            assert p == pytest.approx(q) and lo == pytest.approx(at if strategy != "greedy" else 0.0)
            at += q
        assert found[prev][-1][3] == 2.0


@pytest.mark.parametrize("strategy, params", [("greedy", {}), ("top_k", {"top_k": 3}), ("top_p", {"top_p": 0.8}), ("temperature", {"temperature": 1.5})])
def test_fills(spark, strategy, params):
    import hashlib

    df = spark.createDataFrame([(s,) for s in TEXT], "sentence string")
    pairs = [(f"p{i}", t) for i, t in enumerate(["the <mask> ship", "<mask> <mask>", "no", "unknown <mask> red <mask> x", "<mask>"] * 6)]
    model, words = defaultdict(Counter), Counter()
    for s in TEXT:
        words.update(s.split())
        for a, b in zip(["<s>", *s.split()], s.split()):
            model[a][b] += 1
    out = {r.pair_id: r for r in infill.fill_masks(spark.createDataFrame(pairs, "pair_id string, masked string"), infill.bigram_model(df), infill.unigram_model(df), strategy=strategy, **params).collect()}
    for name, masked in pairs:
        tokens, new, logs = ["<s>", *masked.split()], [], []
        for i in range(1, len(tokens)):
            if tokens[i] != "<mask>":
                new.append(tokens[i])
                continue
            u = int(hashlib.md5(f"42|{name}|{i}".encode()).hexdigest()[:8], 16) / 2**32
            left = plain_cut(model.get(tokens[i - 1].lower()) or words, strategy, **params)
            cum = 0.0
            for token, p in left:
                cum += p
                if u < cum:
                    break
            new.append(token)
            logs.append(math.log(p))
        assert out[name].infilled == " ".join(new)
        assert out[name].infill_score == (pytest.approx(sum(logs) / len(logs), abs=2e-6) if logs else None)


def test_global_rank(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randrange(50), i) for i in range(700)]
    df = spark.createDataFrame(rows, "y int, m int, i int").repartition(5)
    out = splits.global_rank(df, ["y"], ["m", "i"]).collect()
    wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert [(r.y, r.m, r.i) for r in sorted(out, key=lambda r: r["rank"])] == wanted and sorted(r["rank"] for r in out) == list(range(1, 701))
    assert splits.global_rank(df.limit(0), ["y"], ["m"]).count() == 0


def test_phrases_are_found_alike(spark, monkeypatch):
    rng = random.Random(2)
    words = ["Star", "ship", "sea", "moon,", "the", "of!"]
    docs = spark.createDataFrame([(i, i % 3, " ".join(rng.choice(words) for _ in range(30))) for i in range(40)], "paragraph_id int, topic_id int, paragraph_text string")
    kw = spark.createDataFrame([(0, "star ship"), (0, "sea"), (1, "moon"), (1, "the star"), (2, "moon , the"), (2, "")], "topic_id int, word string")
    one = sorted(map(tuple, masking.match_phrases(docs, kw).collect()))
    monkeypatch.setattr(masking, "MAX_PHRASES", 0)
    assert one == sorted(map(tuple, masking.match_phrases(docs, kw).collect())) and len(one) > 50


def test_vocabulary(spark):
    rng = random.Random(3)
    docs = [(i, [rng.choice("abcdef") for _ in range(rng.randrange(0, 12))]) for i in range(60)] + [(99, None)]
    df, tf = Counter(), Counter()
    for _, tokens in docs:
        t = [x for x in tokens or [] if x != "c"]
        grams = [" ".join(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)]
        tf.update(grams)
        df.update(set(grams))
    out = topics.term_vocabulary(spark.createDataFrame(docs, "i int, tokens array<string>"), stop_words=["c"], max_df=0.9)
    assert {r.term: (r.df, r.tf) for r in out.collect()} == {g: (df[g], tf[g]) for g in df if 3 <= df[g] <= 0.9 * len(docs)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    nodes = {x for u, v in edges if u != v for x in (u, v)}
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert out == {x: find(x) for x in nodes}


def test_density_clusters(spark):
    rng = np.random.default_rng(5)
    centres = [(0, 0), (10, 0), (0, 10)]
    rows = [(i, [float(x) for x in rng.normal(centres[i % 3], 0.5)]) for i in range(300)] + [(900 + i, [float(30 + 7 * i), -40.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    out = {r.i: (r.topic_id, r.probability) for r in topics.cluster(df, "v", clusterer="density", min_cluster_size=30, min_samples=5).collect()}
    assert len(out) == 305 and all(out[900 + i] == (-1, 0.0) for i in range(5))
    for k in range(3):
        own = Counter(out[i][0] for i in range(k, 300, 3))
        assert own.most_common(1)[0][1] >= 80
    assert {t for t, _ in out.values()} == {-1, 0, 1, 2}
    # by definition, with a reach that is given
    x, reach = np.array([v for _, v in rows]), 0.4
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= reach
    dense = near.sum(1) >= 5
    comp = list(range(len(x)))
    for a, b in np.argwhere(near & dense[:, None] & dense[None]).tolist():
        while comp[a] != a:
            a = comp[a]
        while comp[b] != b:
            b = comp[b]
        comp[max(a, b)] = min(a, b)

    def top(a):
        while comp[a] != a:
            a = comp[a]
        return a

    found = {r.i: r.topic_id for r in topics.density_clusters(df, "v", min_cluster_size=1, min_samples=5, reach=reach).collect()}
    labels = {}
    for j, (i, _) in enumerate(rows):
        if dense[j]:
            assert labels.setdefault(top(j), found[i]) == found[i] >= 0
        else:
            assert (found[i] >= 0) == bool((near[j] & dense).any())
    assert len(set(labels.values())) == len(labels)
    assert topics.density_clusters(df.limit(0), "v").count() == 0


def test_kmeans_stands_still(spark):
    """A fitted model's centres are the means of what they are nearest to, and each point's topic is that of its nearest centre."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal([(0, 0), (9, 9)][i % 2], 1)]) for i in range(200)], "i int, v array<double>")
    model = topics.fit_clusters(df, "v", k=2)
    centres = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.stages[-1].clusterCenters())], "topic_id int, v array<double>")
    own, again = topics.lloyd_step(df, centres, "v")
    assert {r.i: r.topic_id for r in own.collect()} == {r.i: r.topic_id for r in topics.apply_clusters(model, df, "v").collect()}
    new = {r.topic_id: r.vector for r in again.collect()}
    assert all(new[r.topic_id] == pytest.approx(r.v, abs=1e-3) for r in centres.collect())


def test_models_are_stored(spark, tmp_path):
    df = spark.createDataFrame([([float(i), float(i % 5)],) for i in range(50)], "v array<double>")
    for kind in ("kmeans", "gmm"):
        model = topics.fit_clusters(df, "v", clusterer=kind, k=2)
        for _ in range(2):
            io.write_model(model, str(tmp_path / kind))
        assert io.stored(spark, str(tmp_path / kind)) and not io.stored(spark, str(tmp_path / "none"))
        again = topics.apply_clusters(io.read_model(str(tmp_path / kind)), df, "v").collect()
        assert sorted(map(str, again)) == sorted(map(str, topics.apply_clusters(model, df, "v").collect())) and all(0 < r.probability <= 1 for r in again)


def test_merged_topics(spark):
    given = spark.createDataFrame([(0,)] * 5 + [(1,)] * 4 + [(2,)] * 2 + [(-1,)] * 9, "topic_id int")
    terms = spark.createDataFrame([(0, "a", 1.0), (0, "b", 1.0), (1, "c", 1.0), (2, "c", 2.0), (2, "a", 0.1), (-1, "c", 9.0)], "topic_id int, word string, score double")
    assert {r.topic_id: r.merged for r in topics.merge_topics(given, terms, 2).collect()} == {0: 0, 1: 1, 2: 1}
    assert {r.merged for r in topics.merge_topics(given, terms, 1).collect()} == {0} or {r.merged for r in topics.merge_topics(given, terms, 1).collect()} == {1}


def test_members_and_points(spark):
    df = spark.createDataFrame([(i, i % 4 - 1, [float(i), float(i % 3), 1.0]) for i in range(40)] + [(99, None, [0.0, 0.0, 1.0])], "i int, topic_id int, embedding array<double>")
    top = topics.first_topics(topics.topic_sizes(df.filter("topic_id <> -1")), 2)
    assert {r.topic_id for r in topics.topic_members(df, top).collect()} == {0, 1} and topics.topic_members(df, top, member=False).count() == 41 - 20
    points = topics.vis_points(df.withColumn("probability", F.lit(0.5)), "embedding")
    assert points.columns == ["x", "y", "topic", "probability"] and points.count() == 41


def test_cosine(spark):
    rows = [("a b b", "b c"), ("", "x"), ("A", "a"), ("x y", "z")]
    out = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(infill.text_cosine(F.col("a"), F.col("b"))).collect()]
    assert out == pytest.approx([2 / math.sqrt(10), 0.0, 1.0, 0.0])


def test_balanced_sets(spark):
    rows = spark.createDataFrame([(i, f"w{i % 7} b{i % 11}, c and d e f g{i % 5}") for i in range(300)], "sentence_id long, sentence string")
    counts = Counter((r.task, r.label) for r in probing.balanced_sets(rows, 20).collect())
    per = defaultdict(set)
    for (task, _), n in counts.items():
        per[task].add(n)
    assert {"bigram_shift", "odd_word", "coordinate_inversion", "clause_depth"} <= set(per) <= set(probing.TASKS) and per["bigram_shift"] == {10}


def test_reports():
    assert quality.statistics_text({"a": 1, "long name": 2.5}) == "a          1\nlong name  2.5"
    assert '"k": 3' in quality.model_card({"k": 3}, {"c_v": 0.5}, 10)
