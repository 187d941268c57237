"""Text quality by an additive model with pairwise interactions, boosted cyclically."""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_rows
from .learning import labelled_sample

#: Bound of the sample that a model is fitted on; of each document it holds the features alone.
MAX_TRAIN_DOCS = 20_000
FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_words", "upper", "digits", "symbols", "bars", "exclaims", "stops",
    "commas", "log_lines", "words_a_line", "distinct_lines", "short_words", "capitalised", "long_words", "other_letters",
)
_LETTERS = [*range(65, 91), *range(97, 123)]
_SYMBOLS = [ord(c) for c in "#$%&*+/<=>@\\^_`~{}[]"]


def features(text: str | None) -> list[float]:
    """The numbers that a text is judged by, all of them shares or logarithms (zeros without words)."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip()]
    ascii_letters, other = int(count[_LETTERS].sum()), int(count[0xC0:].sum())
    letters, chars = ascii_letters + other, len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        math.log1p(n), float(lengths.mean()), len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n,
        float(count[65:91].sum()) / max(1, ascii_letters), float(count[48:58].sum()) / chars, float(count[_SYMBOLS].sum()) / n,
        float(count[124]) / n, float(count[33]) / n, float(count[46] + count[63]) / n, float(count[44] + count[58] + count[59]) / n,
        math.log1p(len(lines)), n / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), float((lengths <= 3).mean()),
        sum(map(str.istitle, words)) / n, float((lengths > 20).mean()), other / max(1, letters),
    ]


@dataclass
class AdditiveModel:
    """A lookup table for each feature and each chosen pair of features, over quantile bins."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best cut of a row of bins (bins before it go left) and its gain."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """A shallow tree over bins: its value in each of them."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, cut, part = max((*_split(g[a:b], h[a:b], ridge), (a, b)) for a, b in parts)
        if gain <= 1e-9:
            break
        a, b = part
        parts = [p for p in parts if p != part] + [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best two crossing cuts of a table of bins: gain, and the value in each bin."""
    def corner(t: np.ndarray) -> list[np.ndarray]:
        c = t.cumsum(0).cumsum(1)
        a = c[:-1, :-1]
        return [a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a]

    gs, hs = corner(g), corner(h)
    gain = sum(x**2 / (y + ridge) for x, y in zip(gs, hs))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [float(x[i, j] / (y[i, j] + ridge)) for x, y in zip(gs, hs)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def fit(x: np.ndarray, labels: Sequence[int], *, n_bins: int = 32, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.15, ridge: float = 5.0) -> AdditiveModel:
    """Boost one shallow tree for each feature in turn, round after round; then
    the pairs whose crossing cuts explain most of what is left, likewise."""
    y = np.asarray(labels, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    x = np.asarray(x, float).reshape(len(y), -1)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(y) else np.empty(0) for j in range(x.shape[1] or len(FEATURES))]
    model = AdditiveModel(edges, math.log(share / (1 - share)), [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    f = np.full(len(y), model.base)
    sums = lambda j, v: np.bincount(b[:, j], v, len(edges[j]) + 1)
    for _ in range(rounds):
        for j in range(len(edges)):
            p = 1 / (1 + np.exp(-f))
            step = rate * _tree(sums(j, y - p), sums(j, p * (1 - p)), ridge)
            model.tables[j] += step
            f += step[b[:, j]]
    flat = lambda i, j, v: np.bincount(b[:, i] * (len(edges[j]) + 1) + b[:, j], v, (len(edges[i]) + 1) * (len(edges[j]) + 1)).reshape(len(edges[i]) + 1, -1)
    p = 1 / (1 + np.exp(-f))
    rated = [(_quadrants(flat(i, j, y - p), flat(i, j, p * (1 - p)), ridge)[0], (i, j)) for i, j in combinations(range(len(edges)), 2) if len(edges[i]) and len(edges[j])]
    model.pairs = [ij for _, ij in sorted(rated, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((len(edges[i]) + 1, len(edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-f))
            step = rate * _quadrants(flat(i, j, y - p), flat(i, j, p * (1 - p)), ridge)[1]
            model.pair_tables[k] += step
            f += step[b[:, i], b[:, j]]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that a model is never fitted on: crc32 of the id modulo 5 is 0."""
    return F.coalesce(crc_bucket(id_col, 5) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on the features of at most ``MAX_TRAIN_DOCS`` labelled documents that
    aren't held out, the first by a hash of their ids."""
    sample = labelled_sample(docs, labels, label, ~held_out(id_col), MAX_TRAIN_DOCS, id_col=id_col, text_col=text_col)
    kind = dict(sample.dtypes)["_id"]
    rows = map_rows(sample, lambda c: [c[0], c[1], c[2], [features(t) for t in c[3]]], f"_id {kind}, _y int, _rank long, x array<double>").collect()
    rows = sorted({r["_id"]: r for r in sorted(rows, key=lambda r: r["x"])}.values(), key=lambda r: (r["_rank"], r["_id"]))
    return fit(np.array([r["x"] for r in rows]), [r["_y"] for r in rows])


def score_quality(docs: DataFrame, model: AdditiveModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row.

    Null, empty and blank texts have zero features and the score of those;
    null ids aren't held out; repeated rows are scored each.  A batch is
    scored by one table lookup and addition for each feature and pair, without
    a shuffle.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(columns: list) -> list:
        p = model.score(np.array([features(t) for t in columns[2]]).reshape(-1, len(FEATURES)))
        return [columns[0], columns[1], p.tolist(), (p >= threshold).astype(int).tolist()]

    return map_rows(docs.select(F.col(id_col), held_out(id_col), F.col(text_col)), run, f"doc_id {kind}, held_out boolean, score double, predicted int")
