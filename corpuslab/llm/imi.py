"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, ship, slices

#: The sample that codebooks and the candidate share are fitted on.
MAX_SAMPLE, MAX_SAMPLE_VALUES, SAMPLE_QUERIES = 20_000, 8_000_000, 200
#: Rows of one side that a unit of reranking may hold, and queries of one task of the walk.
ENTRIES_A_UNIT, QUERIES_A_UNIT, QUERIES_A_WALK = 4096, 8192, 64
#: Centres of a codebook: the root of the entries' number, within these bounds.
CENTRES = (4, 128)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``, by one matrix product."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        own = squared(x, centres).argmin(1)
        for j in np.unique(own):
            centres[j] = x[own == j].mean(0)
    return centres


@dataclass
class MultiIndex:
    """Two codebooks, one for each half of the vectors, and what fraction of the entries a search collects."""

    first: np.ndarray
    second: np.ndarray
    share: float = 1.0

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.first).argmin(1), squared(x[:, self.half :], self.second).argmin(1)

    def traverse(self, x: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
        """The multi-sequence walk of one query: cells in the order of their summed
        distances, until they hold ``wanted`` entries.  A table of flags."""
        a, b = squared(x[None, : self.half], self.first)[0], squared(x[None, self.half :], self.second)[0]
        oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, count = a[oa].tolist(), b[ob].tolist(), counts[np.ix_(oa, ob)].tolist()
        flags, seen, left = np.zeros(counts.shape, bool), {(0, 0)}, wanted
        queue = [(a[0] + b[0], 0, 0)]
        while queue and left > 0:
            _, i, j = heapq.heappop(queue)
            if count[i][j]:
                flags[oa[i], ob[j]] = True
                left -= count[i][j]
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(a) and q < len(b) and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(queue, (a[p] + b[q], p, q))
        return flags


def fit(sample: np.ndarray, k: int, *, neighbours: int = 10, recall: float = 0.95, seed: int = 42) -> MultiIndex:
    """Codebooks of ``k`` centres, and the share of entries with which a search
    inside the sample finds ``recall`` of the true neighbours on average.

    The share follows the data: small where vectors form clusters, large where
    they are spread evenly and no index can tell near from far.
    """
    rng = np.random.default_rng(seed)
    half = max(1, sample.shape[1] // 2)
    k = min(k, len(sample))
    index = MultiIndex(kmeans(sample[:, :half], k, rng), kmeans(sample[:, half:], k, rng))
    one, two = index.cells(sample)
    counts = np.zeros((k, k), np.int64)
    np.add.at(counts, (one, two), 1)
    found = []
    for q in rng.permutation(len(sample))[:SAMPLE_QUERIES]:
        d = squared(sample[q : q + 1], sample)[0]
        d[q] = np.inf
        near = np.argsort(d)[:neighbours]
        sums = squared(sample[q : q + 1, :half], index.first)[0][:, None] + squared(sample[q : q + 1, half:], index.second)[0][None]
        order = np.argsort(sums.ravel(), kind="stable")
        reach = np.empty(k * k, np.int64)
        reach[order] = np.cumsum(counts.ravel()[order])
        found += reach[(one * k + two)[near]].tolist()
    index.share = min(1.0, float(np.quantile(found, recall)) / len(sample)) if found else 1.0
    return index


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    centres: int | None = None,
    recall: float = 0.95,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query row.

    ``score`` is the Euclidean distance in double precision; ties go to the
    smaller id; a query's own id is no candidate, and rows that repeat an id
    with the same vector count once (with different vectors each is a
    candidate, and the smallest vector is the query).  Null ids and vectors,
    vectors that are empty, zero or hold null or non-finite components, and
    those of another length than most take no part.  Other columns, whatever
    their names, play no part; an empty table, or one without queries, gives no rows.

    Equal vectors are one entry with their ``k + 1`` smallest ids, which no
    search can exceed.  The index is fitted on a bounded sample and holds all
    entries.  The queries are dealt among tasks that walk the cells.  They meet
    entries by the first half's centre, in units of
    bounded size on both sides, where distances are taken to the entries of visited cells only;
    each unit gives at most ``k`` rows a query.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("q"))
    usual = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema)
    base = base.filter(F.size("v") == usual["n"])
    in_group = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    entries = checkpoint(
        base.select("id", "v").withColumn("n", F.dense_rank().over(in_group)).filter(F.col("n") <= k + 1).groupBy(F.xxhash64("v").alias("h"), "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    )
    n = entries.count()
    rows = entries.orderBy("h", "v").select("v").limit(max(1, min(MAX_SAMPLE, MAX_SAMPLE_VALUES // usual["n"]))).collect()
    index = fit(np.array([r["v"] for r in rows], float), centres or int(np.clip(round(n**0.5), *CENTRES)), neighbours=k, recall=recall)
    shared = spark.sparkContext.broadcast(index)

    def assign(x: np.ndarray, batch: pa.RecordBatch) -> dict:
        one, two = shared.value.cells(x)
        return {"c1": pa.array(one, pa.int32()), "c2": pa.array(two, pa.int32()), "v": _blobs(x), "ids": batch.column("ids")}

    cells = checkpoint(_per_batch(entries.select("v", "ids"), assign, "c1 int, c2 int, v binary, ids array<long>"))
    counts = np.zeros((len(index.first), len(index.second)), np.int64)
    for r in cells.groupBy("c1", "c2").count().collect():  # at most the product of the codebooks' sizes
        counts[r["c1"], r["c2"]] = r["count"]
    wanted = max(4 * k, int(np.ceil(index.share * n)))
    walk = spark.sparkContext.broadcast((counts, wanted))

    def visit(x: np.ndarray, batch: pa.RecordBatch) -> dict:
        ids, out = batch.column("id").to_pylist(), {"id": [], "c1": [], "v": [], "seen": []}
        for i, row in zip(ids, x):
            flags = shared.value.traverse(row, *walk.value)
            for c in np.flatnonzero(flags.any(1)).tolist():
                for name, value in (("id", i), ("c1", c), ("v", row.tobytes()), ("seen", flags[c].tobytes())):
                    out[name].append(value)
        return out

    asked = checkpoint(base.filter("q").groupBy("id").agg(F.min("v").alias("v")))
    n_asked = asked.count()
    walks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_asked // QUERIES_A_WALK)))
    visits = _per_batch(asked.repartition(walks, "id"), visit, "id long, c1 int, v binary, seen binary")
    parts_e = np.maximum(1, -(-counts.sum(1) // ENTRIES_A_UNIT)).tolist()
    parts_q = max(1, -(-n_asked // QUERIES_A_UNIT))
    of = F.element_at(F.array(*[F.lit(int(x)) for x in parts_e]), F.col("c1") + 1)
    left = cells.withColumn("e", F.pmod(F.xxhash64("v"), of).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(parts_q - 1))))
    right = visits.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(parts_q)).cast("int")).withColumn("e", F.explode(F.sequence(F.lit(0), of - 1)))
    near = left.groupBy("c1", "e", "g").cogroup(right.groupBy("c1", "e", "g")).applyInPandas(_rerank(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def _per_batch(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    from .common import _arrow, _fields

    names, kinds = [f.name for f in _fields(schema)], _arrow(schema)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 4 << 20):
                if batch.num_rows:
                    col = batch.column("v")
                    out = fn(col.flatten().to_numpy().astype(float).reshape(batch.num_rows, -1), batch)
                    yield pa.RecordBatch.from_arrays([out[m] if isinstance(out[m], pa.Array) else pa.array(out[m], t) for m, t in zip(names, kinds)], names)

    return df.mapInArrow(run, schema)


def _rerank(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(entries) and len(queries):
            entries = entries.sort_values("c2", kind="stable")
            x = np.frombuffer(b"".join(entries["v"]), float).reshape(len(entries), -1)
            c2, ids = entries["c2"].to_numpy(), [list(i) for i in entries["ids"]]
            starts = np.flatnonzero(np.append(True, np.diff(c2) != 0))
            cells = list(zip(c2[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(c2)]))
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                q = np.frombuffer(b"".join(part["v"]), float).reshape(len(part), -1)
                seen = np.frombuffer(b"".join(part["seen"]), bool).reshape(len(part), -1)
                d = np.full((len(q), len(x)), np.inf)
                for cell, a, b in cells:  # only who visited a cell is compared with its entries
                    who = np.flatnonzero(seen[:, cell])
                    if len(who):
                        d[who, a:b] = squared(q[who], x[a:b])
                keep = min(k + 1, d.shape[1])
                edge = np.partition(d, keep - 1, axis=1)[:, keep - 1]
                for i, own in enumerate(part["id"].tolist()):
                    # the product form is off by rounding: all near its edge are measured exactly
                    some = np.flatnonzero(d[i] <= edge[i] + 1e-9 * (1 + edge[i]) + 1e-9 * float(q[i] @ q[i])) if np.isfinite(edge[i]) else np.flatnonzero(np.isfinite(d[i]))
                    exact = np.sqrt(((x[some] - q[i]) ** 2).sum(1))
                    found = sorted((s, v) for s, j in zip(exact.tolist(), some.tolist()) for v in ids[j] if v != own)[:k]
                    out += [(own, v, s) for s, v in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run
