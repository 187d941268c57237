"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, checkpoint, map_rows, mix, row_test, without

_TOKEN = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_FILTER_BITS = 20

#: Bytes of benchmark text up to which its index goes to every task; beyond, documents and items are joined by their seeds.
MAX_BROADCAST_BYTES = 16 << 20
#: Pairs of positions of one window that are at hand at once.
_PAIRS = 1 << 16


def tokens(text: str | None) -> list[str]:
    """Lower-cased words, without punctuation."""
    return _TOKEN.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` token ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, ids = np.zeros(n, np.uint64), ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * _BASE + ids[k : k + n]
        return mix(h)


def tile(a: Sequence, b: Sequence, seeds: Iterable[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), longest first.

    ``seeds`` are the pairs of positions where windows of ``least`` tokens
    agree, in order; they are taken one by one, and only their runs are kept,
    at most one for each diagonal and gap in it.  Successive seeds on a diagonal make a maximal match.  The longest
    match is marked; matches that meet marked tokens are cut to what is free
    and go back to the queue, until none has ``least`` tokens.  Of equally long
    ones that with the smaller positions comes first.
    """
    runs: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    for i, j in seeds:
        run = open_.get(i - j)
        if run and run[0] + run[2] - least + 1 >= i:
            run[2] = i + least - run[0]
        else:
            run = open_[i - j] = [i, j, least]
            runs.append(run)
    queue = [(-n, j, i) for i, j, n in runs]
    heapq.heapify(queue)
    used_a, used_b, tiles = set(), set(), []
    while queue:
        n, j, i = heapq.heappop(queue)
        free, start = [], None
        for k in range(-n + 1):
            taken = k == -n or i + k in used_a or j + k in used_b
            if taken and start is not None:
                free.append((start, k - start))
                start = None
            elif not taken and start is None:
                start = k
        if free == [(0, -n)]:
            used_a.update(range(i, i - n))
            used_b.update(range(j, j - n))
            tiles.append((i, j, -n))
        else:
            for k, m in free:
                if m >= least:
                    heapq.heappush(queue, (-m, j + k, i + k))
    return tiles


@dataclass
class TestIndex:
    """The distinct items' tokens, and where each window of ``least`` of them occurs.

    An item of fewer tokens has one window, all of it.
    """

    items: list[tuple[list[int], list[str]]]
    least: int

    def __post_init__(self) -> None:
        self.vocabulary: dict[str, int] = {}
        add = self.vocabulary.setdefault
        self.ids = [np.array([add(t, len(self.vocabulary) + 1) for t in words], np.int64) for _, words in self.items]
        self.names = [ids for ids, _ in self.items]
        self.items = []  # the words themselves aren't needed any more
        self.windows = {}
        for width in sorted({min(self.least, len(x)) for x in self.ids}):
            own = [(k, x) for k, x in enumerate(self.ids) if min(self.least, len(x)) == width]
            hashes = [rolling(x, width) for _, x in own]
            flat = np.concatenate(hashes)
            item = np.repeat(np.array([k for k, _ in own], np.int32), [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes])
            order = np.argsort(flat, kind="stable")
            bits = np.zeros(1 << min(_FILTER_BITS, max(10, 4 + len(flat).bit_length())), bool)
            bits[self._slot(flat, len(bits))] = True
            self.windows[width] = (flat[order], item[order], place[order], bits)

    @staticmethod
    def _slot(hashes: np.ndarray, size: int) -> np.ndarray:
        return (hashes >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64)

    def _seeds(self, doc: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each item that shares a window: (position in the text, first and last place in the index)."""
        out: dict[int, list] = {}
        for width, (hashes, item, _, bits) in self.windows.items():
            h = rolling(doc, width)
            at = np.flatnonzero(bits[self._slot(h, len(bits))]) if len(h) else np.empty(0, np.int64)
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            for p, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
                while a < b:  # a window's places stand item by item
                    k = int(item[a])
                    end = a + int(np.searchsorted(item[a:b], k, "right"))
                    out.setdefault(k, []).append((p, a, end))
                    a = end
        return out

    def _pairs(self, doc: np.ndarray, k: int, found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
        """The pairs of positions where text and item really agree, in order."""
        own, width = self.ids[k], min(self.least, len(self.ids[k]))
        place = self.windows[width][2]
        for p, a, b in found:
            window = doc[p : p + width]
            for start in range(a, b, _PAIRS):
                for q in place[start : min(b, start + _PAIRS)].tolist():
                    if np.array_equal(window, own[q : q + width]):
                        yield p, q

    def find(self, text: str | None, threshold: float, any_item: bool = False) -> list[dict]:
        """The items of which tiles in this text cover ``threshold`` or more (one of them, if ``any_item``)."""
        get = self.vocabulary.get
        doc = np.array([get(w, 0) for w in tokens(text)], np.int64)
        out = []
        for k, found in self._seeds(doc).items():
            size = len(self.ids[k])
            width, place = min(self.least, size), self.windows[min(self.least, size)][2]
            reach = np.zeros(size + 1, np.int64)
            for _, a, b in found:
                reach[place[a:b]] = 1
            if np.count_nonzero(np.convolve(reach[:size], np.ones(width, np.int64))[:size]) < threshold * size:
                continue  # tiles can't cover more than the seeds do
            tiles = tile(doc, self.ids[k], self._pairs(doc, k, found), width)
            covered = sum(n for _, _, n in tiles)
            if tiles and covered >= threshold * size:
                out.append({"item_id": self.names[k][0], "item_copies": self.names[k], "coverage": covered / size, "matched": covered, "tiles": len(tiles), "first_word": min(i for i, _, _ in tiles)})
                if any_item:
                    break
        return sorted(out, key=lambda x: (-x["coverage"], x["item_id"]))


_HIT = "item_id long, item_copies array<long>, coverage double, matched int, tiles int, first_word int"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")


def _index(items: DataFrame, least: int, max_broadcast_bytes: int) -> Callable[[], TestIndex] | None:
    """What gives a task its index of all items; None where their texts are more than may be broadcast."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > max_broadcast_bytes:
        return None
    grouped: dict[tuple[str, ...], set[int]] = {}
    for r in items.collect():
        words = tuple(tokens(r["text"]))
        if words:
            grouped.setdefault(words, set()).add(r["item_id"])
    rows = items.sparkSession.sparkContext.broadcast([(sorted(ids), list(words)) for words, ids in sorted(grouped.items(), key=lambda x: min(x[1]))])
    state: list[TestIndex] = []

    def get() -> TestIndex:
        if not state:
            state.append(TestIndex(rows.value, least))
        return state[0]

    return get


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    threshold: float = 0.5,
    least: int = 5,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pairs of a document and a benchmark item whose words it covers.

    ``doc_id, item_id, item_copies, coverage, matched, tiles, first_word``, a
    row for each pair where tiles of at least ``least`` words cover
    ``threshold`` or more of the item, in whatever order they stand.  Items of
    the same words count as one, with the smallest id and the list of all.
    An item of fewer than ``least`` words is one seed: it is found where it
    stands as a whole.  Items without words and null ids are left out; null and
    empty texts have no pair; texts of any length are searched whole; repeated
    rows are searched each; other columns, whatever their names, play no part;
    an empty benchmark or table gives no rows.

    A benchmark of measured, bounded size is indexed in every task and documents
    aren't shuffled.  A larger one is joined to them by the seeds' hashes, with
    the same result.  Memory follows text and item; the time of a text that
    repeats a window of an item which repeats it too is their product.
    """
    items = _items(benchmark)
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, hits array<struct<{', '.join(x.replace(' ', ':', 1) for x in _HIT.split(', '))}>>"
    narrow = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = _index(items, least, max_broadcast_bytes)
    if index is not None:

        def run(columns: list) -> list:
            found = [(i, hits) for i, text in zip(*columns) if (hits := index().find(text, threshold))]
            return [[i for i, _ in found], [h for _, h in found]]

        hits = map_rows(narrow, run, schema)
    else:
        hits = _by_seeds(narrow, items, threshold, least, kind, schema)
    return hits.select("doc_id", F.inline("hits"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.5, least: int = 5, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item; see ``find_leaks``.

    A row is judged by its text alone, whatever its id.  With a benchmark of
    bounded size nothing is joined or shuffled; else texts are named by their md5.
    """
    index = _index(_items(benchmark), least, max_broadcast_bytes)
    if index is None:
        texts = docs.select(F.md5(text_col).alias("doc_id"), F.col(text_col).alias("text"))
        return without(docs, F.md5(text_col), find_leaks(texts, benchmark, threshold=threshold, least=least, max_broadcast_bytes=max_broadcast_bytes).select("doc_id"))
    return docs.filter(row_test(docs.sparkSession, lambda texts: [not index().find(t, threshold, any_item=True) for t in texts], F.col(text_col)))


def _words(columns: list) -> list:
    return [*columns[:-1], [" ".join(tokens(t)) for t in columns[-1]]]


def _windows(width: int) -> Callable[[list], list]:
    """The distinct hashes of the windows of ``width`` tokens of each text."""
    from .common import word_hashes

    def run(columns: list) -> list:
        out = [np.unique(rolling(word_hashes(" ".join(tokens(t)).encode()), width)).view(np.int64).tolist() for t in columns[-1]]
        return [*columns[:-1], out]

    return run


def _by_seeds(docs: DataFrame, items: DataFrame, threshold: float, least: int, kind: str, schema: str) -> DataFrame:
    """The way for benchmarks of any size: only texts and items that share a seed meet."""
    same = map_rows(items.select("item_id", "text"), _words, "item_id long, words string").filter("words <> ''")
    classes = same.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    named = checkpoint(classes.select(F.col("ids")[0].alias("item_id"), "ids", "words", F.least(F.lit(least), F.size(F.split("words", " "))).alias("width")))
    pairs = docs.sparkSession.createDataFrame([], "h long, item_id long")
    for (width,) in named.select("width").distinct().collect():
        marks = map_rows(named.filter(F.col("width") == width).select("item_id", "words"), _windows(width), "item_id long, seeds array<long>").select("item_id", F.explode("seeds").alias("seed"))
        windows = map_rows(docs.select(F.xxhash64("doc_id", "text"), "text"), _windows(width), "h long, seeds array<long>").select("h", F.explode("seeds").alias("seed"))
        pairs = pairs.unionByName(windows.join(marks, "seed").select("h", "item_id").distinct())
    # of what shares a seed the words themselves decide, so a hash that two texts share only costs a comparison
    rows = among(docs, F.xxhash64("doc_id", "text"), checkpoint(pairs.select(F.col("h").alias("_id"), "item_id"))).join(named, "item_id").select("row.doc_id", "row.text", "ids", "words")

    def run(columns: list) -> list:
        out = [(i, TestIndex([(ids, words.split(" "))], least).find(text, threshold)) for i, text, ids, words in zip(*columns)]
        return [[i for i, h in out if h], [h for _, h in out if h]]

    return map_rows(rows, run, schema)
