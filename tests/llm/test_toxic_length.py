"""A text's length alone makes it no more toxic."""

import numpy as np
import pytest

from corpuslab.llm import toxicity


def sample(seed=4, n=600):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    texts, labels = [], []
    for i in range(n):
        s = [" ".join(rng.choice(words, 8)) + "." for _ in range(rng.integers(1, 12))]
        if i % 5 == 0:
            s[rng.integers(len(s))] += " grumbo" + ("lak", "ter", "")[i % 3] + " here."
        texts.append(" ".join(s))
        labels.append(int(i % 5 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*sample())


def test_joined_clean_texts_stay_clean(model):
    texts, labels = sample(9, 1000)
    clean = [t for t, y in zip(texts, labels) if not y]
    for n in (1, 50, 200, len(clean)):
        for at in range(0, len(clean), n):
            score, where = model.score("\n".join(clean[at : at + n]))
            assert score < 0.3 and not where
    assert model.score("waa wab. " * 100_000)[0] < 0.3


def test_one_bad_sentence_is_found_in_a_long_text(model):
    texts, labels = sample(9, 1000)
    clean = [t for t, y in zip(texts, labels) if not y]
    score, where = model.score("\n".join([*clean[:300], "Some grumbolak here.", *clean[300:600]]))
    assert score >= 0.3 and len(where) == 1


def slow_score(model, text):
    """The definition, sentence by sentence."""
    odds, top = [], 1 / (1 + np.exp(-model.bias))
    for part in toxicity._BREAK.split(text):
        found = {f for w in toxicity._WORD.findall(part.lower()) for f in toxicity.word_features(w) if f in model.weights}
        if found:
            odds.append(1 / (1 + np.exp(-model.bias - sum(model.weights[f] for f in found))))
    return max([top, *odds, 1 - np.prod([1 - p for p in odds if p >= toxicity.FLOOR])])


def test_scores_by_brute_force(model):
    texts, _ = sample(11, 300)
    for text in [*texts, "", " \n", "\n".join(texts)]:
        assert model.score(text)[0] == pytest.approx(slow_score(model, text), rel=1e-9, abs=1e-12)


def test_several_weak_sentences_are_named():
    model = toxicity.ToxicityModel({"mild": 3.0}, -4.0)
    score, where = model.score("mild one. plain. mild two.")
    assert score >= 0.3 and [w["start"] for w in where] == [0, 17]


def test_repeated_ids_fit_alike(spark):
    docs = spark.createDataFrame([(i % 50, f"t{i} " + ("bad " if i % 3 == 0 else "good ") * 3) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    one, two = (toxicity.train(d, labels) for d in (docs, docs.repartition(5)))
    assert (one.weights, one.bias) == (two.weights, two.bias)
