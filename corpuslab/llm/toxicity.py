"""Toxicity by multiple-instance learning: documents are noisy-ors of their sentences."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_bucket, map_rows, row_test
from .learning import labelled_sample

#: Bounds of the sample that a model is fitted on: documents, and bytes of text.
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES = 6000, 20_000_000
_BREAK = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 150_000
#: The probability below which a sentence counts as clean, so that clean sentences never add up with a text's length.
FLOOR = 0.05


def word_features(word: str) -> tuple[str, ...]:
    """A word and its beginnings of four to six letters, which catch inflected and compound forms."""
    return (word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n))


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence; line ends and ``. ! ?`` before white space end one."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


@dataclass
class ToxicityModel:
    """Weights of words and beginnings of words, and the bias: of a sentence with such words, and once of the document."""

    weights: dict[str, float]
    bias: float
    _cache: dict = field(default_factory=dict, repr=False)

    def _found(self, word: str) -> tuple[str, ...]:
        found = tuple(f for f in word_features(word) if f in self.weights)
        if len(self._cache) >= _CACHE_WORDS:
            self._cache.clear()
        self._cache[word] = found
        return found

    def score(self, text: str | None, least: float = 0.3) -> tuple[float, list[dict]]:
        """The document's probability, and the sentences that make it toxic.

        A noisy-or of the sentences of at least ``FLOOR``; where there is none,
        the probability of the strongest sentence, or the document's own leak.
        Sentences of at least ``least`` are listed; where only several weaker
        ones together reach it, these.
        """
        total, worst, weak, cache, top, floor = 0.0, [], [], self._cache, _softplus(self.bias), -math.log1p(-FLOOR)
        for start, end in sentences(text or ""):
            hits: set[str] = set()
            for word in _WORD.findall(text[start:end].lower()):
                found = cache.get(word)
                if found is None:
                    found = self._found(word)
                if found:
                    hits.update(found)
            if not hits:
                continue
            s = _softplus(self.bias + sum(self.weights[f] for f in sorted(hits)))
            top = max(top, s)
            if s >= floor:
                total += s
                p = -math.expm1(-s)
                (worst if p >= least else weak).append({"start": start, "end": end, "score": p})
        score = -math.expm1(-max(total, top))
        return score, worst or (weak if score >= least else [])

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "_cache": {}}


def _softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def fit(texts: list[str], labels: list[int], *, n_features: int = 3000, least_docs: int = 3, steps: int = 200, rate: float = 0.1, noise: float = 0.01, penalty: float = 1e-4) -> ToxicityModel:
    """Learn sentence weights from document labels alone.

    A document is toxic with ``1 - (1 - leak) prod(1 - p)`` over the sentences
    that hold any feature; one leak a document, whatever its length.  The
    features are those whose document counts differ most between the labels.
    ``noise`` is the share of labels taken to be wrong.
    """
    y = np.array(labels, float)
    n, base = len(y), (y.sum() + 0.5) / (len(y) + 1)
    if not n or y.min() == y.max():
        return ToxicityModel({}, math.log(base / (1 - base)) - 3)
    seen, toxic = Counter(), Counter()
    known: dict[str, tuple[str, ...]] = {}
    for text, label in zip(texts, labels):
        own: set[str] = set()
        for word in set(_WORD.findall(text.lower())):
            own.update(known.get(word) or known.setdefault(word, word_features(word)))
        seen.update(own)
        if label:
            toxic.update(own)
    rated = []
    for f, c in seen.items():
        if c >= least_docs:
            z = (toxic[f] - c * base) / math.sqrt(c * base * (1 - base) * max(1e-9, 1 - c / (n + 1)))
            if z > 3 or z < -4:
                rated.append((-abs(z), f))
    rated.sort()
    names = [f for _, f in rated[:n_features]]
    if not names:
        return ToxicityModel({}, math.log(base / (1 - base)) - 3)
    index = {f: i for i, f in enumerate(names)}
    cols, rows, of = [], [], []  # features, their sentences, the sentences' documents
    for d, text in enumerate(texts):
        for start, end in sentences(text):
            hits = {index[f] for w in set(_WORD.findall(text[start:end].lower())) for f in known.get(w) or word_features(w) if f in index}
            if hits:
                cols.extend(hits)
                rows.extend([len(of)] * len(hits))
                of.append(d)
    cols, rows, of = np.array(cols, np.int64), np.array(rows, np.int64), np.array(of, np.int64)
    count = np.array([seen[f] for f in names], float)
    rate0 = (np.array([toxic[f] for f in names]) + 0.5 * base) / (count + 0.5)
    w = np.clip(np.log(np.clip(rate0, 1e-3, 1 - 1e-3) / (1 - np.clip(rate0, 1e-3, 1 - 1e-3))) - math.log(base / (1 - base)), -2, 4)
    per = max(1.0, len(of) / n)
    theta = np.append(w, math.log(base / (1 - base)) - math.log(per) - 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(rows, theta[cols], len(of)) + theta[-1]
        total = np.bincount(of, np.logaddexp(0, z), n) + np.logaddexp(0, theta[-1])
        p = noise + (1 - 2 * noise) * -np.expm1(-total)
        back = (p - y) / (p * (1 - p)) * (1 - 2 * noise) * np.exp(-total)
        dz = back[of] / (1 + np.exp(-np.clip(z, -60, 60)))
        leak = back.sum() / (1 + math.exp(-theta[-1]))
        grad = np.append(np.bincount(cols, dz[rows], len(w)), dz.sum() + leak) / n + penalty * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * min(1, 2 * (1 - step / (steps + 1)))
    return ToxicityModel({f: float(x) for f, x in zip(names, theta) if abs(x) > 1e-3}, float(theta[-1]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that a model is never fitted on: crc32 of the id modulo 4 is 2."""
    return F.coalesce(crc_bucket(id_col, 4) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on labelled documents that aren't held out: the first by a hash of
    their ids, up to ``MAX_TRAIN_DOCS`` and ``MAX_TRAIN_BYTES`` of whole texts.

    A text that doesn't fit what is left of the bytes is passed over, so texts
    of many megabytes are missing from the fit.  Of the texts of a repeated id
    the least takes part.  Without labels, or with one kind of them only, the
    model has no words and all texts get its leak.
    """
    sample = labelled_sample(docs, labels, label, ~held_out(id_col), MAX_TRAIN_DOCS, id_col=id_col, text_col=text_col)
    sample = checkpoint(sample.groupBy("_id", "_y", "_rank").agg(F.min("text").alias("text")))
    left, ids = MAX_TRAIN_BYTES, []
    for r in sorted(sample.select("_id", "_rank", F.octet_length("text").alias("n")).collect(), key=lambda r: (r["_rank"], r["_id"])):
        if (r["n"] or 0) <= left:
            left -= r["n"] or 0
            ids.append((r["_id"],))
    chosen = sample.sparkSession.createDataFrame(ids, f"_id {dict(sample.dtypes)['_id']}") if ids else sample.select("_id").limit(0)
    rows = sorted(sample.join(F.broadcast(chosen), "_id").collect(), key=lambda r: (r["_rank"], r["_id"]))
    return fit([r["text"] or "" for r in rows], [r["_y"] for r in rows])


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending`` for each row.

    ``offending`` lists start, end and score of the sentences that reach the
    threshold alone, or where none does, of those that together make the
    document reach it; it is never empty where ``predicted`` is 1 on account of
    words.  Null and empty texts have no sentence and score the model's leak;
    a text of any length is scored whole; null ids aren't held out; repeated
    rows are scored each; an empty table gives no rows.  Columns of ``docs``
    beside id and text, whatever their names, are ignored.  There is no shuffle.
    """
    kind = dict(docs.dtypes)[id_col]
    context = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: list) -> list:
        found = [context.value.score(text, threshold) for text in columns[2]]
        return [columns[0], columns[1], [p for p, _ in found], [int(p >= threshold) for p, _ in found], [w for _, w in found]]

    return map_rows(
        docs.select(F.col(id_col), held_out(id_col), F.col(text_col)), run, f"doc_id {kind}, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>"
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose whole text scores below the threshold, each judged by itself: nothing is joined or shuffled."""
    context = docs.sparkSession.sparkContext.broadcast(model)
    return docs.filter(row_test(docs.sparkSession, lambda texts: [context.value.score(t, threshold)[0] < threshold for t in texts], F.col(text_col)))
