"""Mixing sources to target weights by a hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fits, ship, sized

#: Most sources, and most blocks over all sources, that the plan may hold; both bound what the driver receives and what is broadcast.
MAX_SOURCES, MAX_BLOCKS = 100_000, 262_144
#: Documents that a block should hold.
DOCS_PER_BLOCK = 2048
#: Permutations of an open block that are tried for one that ends within a word of the target.
_TRIES = 64


def count_words(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` (a null text has none)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[float], weights: Sequence[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Words that each source should give: ``share`` of all by weight, none above ``cap`` times its size.

    What a capped source leaves is shared again by weight among the others.
    """
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        for i in full or open_:
            out[i] = cap * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Deal the quotas of all sources among ``shards``: a (shards, sources) table.

    A node holds the quotas of a range of shards.  Its left half receives its
    share of the blocks, drawn without replacement, hence a multivariate
    hypergeometric number of each source; the rest goes right.  Sums are exact.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        low, high, own = todo.pop()
        if high - low == 1:
            out[low] = own
            continue
        mid = (low + high) // 2
        n = int(own.sum())
        take = n * (mid - low) // (high - low)
        left = rng.multivariate_hypergeometric(own, take, method="marginals") if n else own
        todo += [(low, mid, left), (mid, high, own - left)]
    return out


@dataclass(frozen=True)
class Mixture:
    """``share`` of all words, by ``weights`` over sources in code point order (null last)."""

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    cap: float = 2.0
    shards: int = 16
    seed: int = 42


@dataclass(frozen=True)
class _Draw:
    """What the tree decided: sources and blocks of bounded number, and in each source's open block the units that one more copy is drawn of."""

    sources: DataFrame  # _key, _src, _blocks, source_size, target
    blocks: DataFrame  # _src, _block, _shards, _open
    units: DataFrame  # _src, _h, _c (rows), _m (further copies, 1 to _c)
    split: bool  # whether any unit gives a copy of some of its rows only


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _hash(seed: int, id_col: str, text_col: str) -> Column:
    """A hash of id and text: rows that share it are repeats of one another."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col).cast("string"))


def _block(sources: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(sources), "_key").withColumn("_block", F.pmod("_h", "_blocks").cast("int"))


def _sizes(docs: DataFrame, mixture: Mixture, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows without their texts, each with the partition that it was read in."""
    return checkpoint(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _key(F.col(source_col)).alias("_key"), count_words(F.col(text_col)).alias("size"),
            _hash(mixture.seed, id_col, text_col).alias("_h"), F.spark_partition_id().alias("_part"),
        )
    )


def _draw(narrow: DataFrame, mixture: Mixture, docs_per_block: int) -> _Draw:
    spark = narrow.sparkSession
    ship(spark)
    per_source = narrow.groupBy("_key").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    rows = per_source.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    rows.sort(key=lambda r: (r["_key"] == "n", r["_key"]))
    most = max(1, MAX_BLOCKS // max(1, len(rows)))
    n_blocks = [max(1, min(most, -(-r["n"] // docs_per_block))) for r in rows]
    goal = targets([r["words"] for r in rows], [mixture.weights[i % len(mixture.weights)] for i in range(len(rows))], mixture.share, mixture.cap)
    sources = spark.createDataFrame(
        pd.DataFrame({"_key": [r["_key"] for r in rows], "_src": range(len(rows)), "_blocks": n_blocks, "source_size": [r["words"] for r in rows], "target": goal}),
        "_key string, _src int, _blocks int, source_size long, target double",
    )
    placed = _block(sources, narrow)
    totals = placed.groupBy("_src", "_block").agg(F.sum("size").alias("words")).toPandas()
    blocks, gaps = _plan([int(r["words"]) for r in rows], n_blocks, goal, totals, mixture)
    blocks = spark.createDataFrame(blocks, "_src int, _block int, _shards array<int>, _open boolean")
    gaps = spark.createDataFrame(gaps, "_src int, _block int, _gap double")
    # of one block a source at most, units are drawn one by one
    units = placed.join(F.broadcast(gaps), ["_src", "_block"]).groupBy("_src", "_h").agg(F.count("*").alias("_c"), F.sum("size").alias("_words"), F.first("_gap").alias("_gap"))
    units = checkpoint(units.groupBy("_src").applyInPandas(_fill, "_src int, _h long, _c long, _m long"))
    return _Draw(sources, blocks, units, not units.filter("_m < _c").isEmpty())


def _plan(sizes: list[int], n_blocks: list[int], goal: list[float], totals: pd.DataFrame, mixture: Mixture) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The shards that receive each block, and what each source's open block should still give.

    A source offers its blocks pass after pass, each pass permuted anew, as
    long as they fit its target; the block that doesn't is its open one.  The
    tree deals these quotas among the shards, and each shard draws the next run.
    """
    rng = np.random.default_rng(mixture.seed)
    words = {int(k): dict(zip(g["_block"], g["words"])) for k, g in totals.groupby("_src")}
    offers, gaps = [], []
    for i, (size, n, t) in enumerate(zip(sizes, n_blocks, goal)):
        whole = int(t // size) if size else 0
        offer, gap = [rng.permutation(n) for _ in range(whole)], t - whole * size
        own, last = words.get(i, {}), []
        for b in rng.permutation(n).tolist():
            have = own.get(b, 0)
            if have > gap + 1e-6:
                if gap >= 0.5:
                    last.append(b)
                    gaps.append((i, b, gap))
                break
            if have:
                last.append(b)
                gap -= have
        offers.append(np.concatenate([*offer, np.array(last, np.int64)]))
    quotas = np.array([len(o) for o in offers], np.int64)
    leaves = splitting_tree(quotas, mixture.shards, rng) if len(quotas) else np.zeros((mixture.shards, 0), np.int64)
    out, opened = [], {(i, b) for i, b, _ in gaps}
    for i, (offer, n) in enumerate(zip(offers, n_blocks)):
        shards: list[list[int]] = [[] for _ in range(n)]
        for b, s in zip(offer.tolist(), np.repeat(np.arange(mixture.shards), leaves[:, i]).tolist()):
            shards[b].append(s)
        out += [(i, b, s, (i, b) in opened) for b, s in enumerate(shards)]
    return pd.DataFrame(out, columns=["_src", "_block", "_shards", "_open"]), pd.DataFrame(gaps, columns=["_src", "_block", "_gap"])


def _fill(part: pd.DataFrame) -> pd.DataFrame:
    """Draw units in permuted order while they fit the gap, then add or swap some to end nearest.

    A unit is the rows that repeat one document; of its rows as many as fit are
    taken.  Further permutations are tried while the best one misses the gap by a word or more.
    """
    part = part.sort_values("_h").reset_index(drop=True)
    words, rows, goal = part["_words"].to_numpy(np.int64), part["_c"].to_numpy(np.int64), float(part["_gap"].iloc[0])
    once = words % rows != 0  # rows of unlike size share a hash: all of them or none
    most = np.where(once, 1, rows)
    sizes = (words // most).astype(np.float64)
    rng, order, best = np.random.default_rng(len(part)), np.arange(len(part)), None
    for _ in range(_TRIES):
        taken, gap = _near(sizes, most, order, goal)
        if best is None or abs(gap) < best[0] - 1e-9:
            best = (abs(gap), taken)
        if best[0] < 1:
            break
        order = rng.permutation(len(part))
    part["_m"] = np.where(once, best[1] * rows, best[1])
    return part.loc[part["_m"] > 0, ["_src", "_h", "_c", "_m"]]


def _near(sizes: np.ndarray, most: np.ndarray, order: np.ndarray, gap: float) -> tuple[np.ndarray, float]:
    """How many of each unit to take, and what is left of the gap then."""
    taken = np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        taken[i] = most[i] if not sizes[i] else min(most[i], int(gap // sizes[i]))
        gap -= taken[i] * sizes[i]
    for _ in range(16):
        # a unit of size 0 stands for none, so that one pass finds additions, removals and swaps
        out, into = np.append(-1, np.flatnonzero(taken > 0)), np.append(-1, np.flatnonzero(taken < most))
        given, found = np.where(out < 0, 0, sizes[out]), np.where(into < 0, 0, sizes[into])
        rank = np.argsort(found, kind="stable")
        at = np.searchsorted(found[rank], given + gap)
        best = min(((abs(gap + g - found[rank[k]]), o, into[rank[k]]) for o, g, j in zip(out, given, at) for k in (j - 1, j) if 0 <= k < len(rank)), key=lambda x: x[0])
        if best[0] >= abs(gap) - 1e-9:
            break
        for i, step in ((best[1], -1), (best[2], 1)):
            if i >= 0:
                taken[i] += step
                gap -= step * sizes[i]
    return taken, gap


def mix_sources(
    docs: DataFrame,
    mixture: Mixture = Mixture(),
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    docs_per_block: int = DOCS_PER_BLOCK,
) -> DataFrame:
    """How often the mix takes each row, and which output shards receive it.

    Returns ``doc_id, source, size, source_size, target, taken, copies, shards,
    local_order``, a row for each input row; ``taken = copies * size``, ``shards`` has a shard
    for each copy.  Documents are dealt into blocks by a hash of id and text, so a
    source's blocks are random parts of it.  A source offers whole passes over
    all its blocks, then whole blocks in a permuted order, then of one open
    block the documents, in permuted order, that still fit.  The splitting tree
    deals these offers among the shards, which draw disjoint runs of them.

    Null sources are a source of their own, null and empty texts have size 0 and
    are taken as their block is.  Null and repeated ids are like any other: a
    row counts with its own text, and of rows that repeat id, text and source
    any may be the ones taken.  Other columns, whatever their names, play no
    part; an empty table gives no rows.

    The text is read once, for the word counts.  The driver receives the totals
    of at most ``MAX_BLOCKS`` blocks, however large the table.
    """
    narrow = _sizes(docs, mixture, id_col, text_col, source_col)
    draw = _draw(narrow, mixture, docs_per_block)
    dealt = _block(draw.sources, narrow).join(F.broadcast(draw.blocks), ["_src", "_block"])
    whole = dealt.filter("not _open").withColumn("copies", F.size("_shards"))
    some = dealt.filter("_open").join(sized(draw.units), ["_src", "_h"], "left")
    drawn = F.when(F.col("_m") >= F.col("_c"), 0).otherwise(-1)
    if draw.split:
        some, drawn = _numbered(some), F.when(F.col("_nth") <= F.col("_m"), 0).otherwise(-1)
    some = some.withColumn("copies", F.size("_shards") + drawn).select(*whole.columns)
    return whole.unionByName(some).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies",
        F.slice("_shards", F.lit(1), F.col("copies")).alias("shards"), F.xxhash64(F.lit(mixture.seed + 1), "_h").alias("local_order"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Number the rows of each unit from 1: inside a partition, after those of the partitions before.  No task sees more of a unit than one partition held."""
    counts = rows.groupBy("_src", "_h", "_part").agg(F.count("*").alias("_here"))
    before = F.sum("_here").over(Window.partitionBy("_src", "_h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("_src", "_h", "_part", F.coalesce(before, F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_src", "_h", "_part").orderBy("size"))
    return rows.withColumn("_nth", inside).join(first, ["_src", "_h", "_part"]).withColumn("_nth", F.col("_nth") + F.col("_first"))


def _drawn(docs: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """``row, _shard, _order``: the rows of ``docs`` as often as shards draw them.

    A row's hash and the plan say which shards take it, so no ids are joined:
    only the rows of open blocks meet a table, that of the units drawn there.
    """
    draw = _draw(_sizes(docs, mixture, id_col, text_col, source_col), mixture, docs_per_block)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(F.col(source_col)).alias("_key"), _hash(mixture.seed, id_col, text_col).alias("_h"))
    dealt = _block(draw.sources, rows).join(F.broadcast(draw.blocks), ["_src", "_block"]).select("row", "_src", "_h", "_shards", "_open")
    less = F.slice("_shards", F.lit(1), F.size("_shards") - 1)
    own = F.when(~F.col("_open") | (F.col("_m") >= F.col("_c")), F.col("_shards")).otherwise(less).alias("_shards")
    if fits(draw.units):  # all rows in one pass; units lie in open blocks only
        some = dealt.join(F.broadcast(draw.units), ["_src", "_h"], "left")
        parts = [some.select("row", "_h", own)]
    else:
        some = dealt.filter("_open").join(draw.units, ["_src", "_h"], "left")
        parts = [dealt.filter("not _open").select("row", "_h", "_shards"), some.select("row", "_h", own)]
    if draw.split:
        # all rows of a unit are alike, so that one of them stands for the copies of some
        one = some.filter("_m < _c").groupBy("_src", "_h").agg(F.first(F.struct("row", "_shards", "_m")).alias("x")).select("x.row", "_h", "x._shards", "x._m")
        parts.append(one.select("row", "_h", F.array_repeat(F.element_at("_shards", -1), F.col("_m").cast("int")).alias("_shards")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select("row", "_h", F.posexplode("_shards").alias("_pass", "_shard")).select("row", "_shard", F.xxhash64(F.lit(mixture.seed + 1), "_pass", "_h").alias("_order"))


def mixture_rows(docs: DataFrame, mixture: Mixture = Mixture(), **columns: str) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as shards draw it, with the same columns.

    A partition's rows stand in the order of their output shards, shuffled
    inside each.  Rows, ids and texts may be null or repeated; see ``mix_sources``.
    """
    return _drawn(docs, mixture, **columns).sortWithinPartitions("_shard", "_order").select("row.*")


def write_shards(docs: DataFrame, path: str, mixture: Mixture = Mixture(), **columns: str) -> None:
    """Write the mix as one folder a shard, each file shuffled by a keyed order; an own column ``shard`` is left out."""
    rows = _drawn(docs, mixture, **columns)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("_order"), F.lit(max(1, n // mixture.shards)))
    own = [F.col(f"row.`{c}`") for c in docs.columns if c != "shard"]
    rows.repartition(n, "_shard", part).sortWithinPartitions("_shard", "_order").select(*own, F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)
