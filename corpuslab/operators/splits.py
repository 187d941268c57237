"""Time splits, caps and reproducible samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.session import checkpoint

def global_rank(df: DataFrame, coarse: Sequence[str], fine: Sequence[str], name: str = "rank") -> DataFrame:
    """Number all rows from 1 in the order of ``coarse + fine`` without one task seeing them all.

    The rows are sorted by ranges and checkpointed with their place in a
    partition; the partitions' counts, one row each, are summed up before it.
    """
    place = F.monotonically_increasing_id()
    ordered = checkpoint(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate([*coarse, *fine])]).orderBy(*[f"_{i}" for i in range(len(coarse) + len(fine))]).select("_row", place.alias("_m")))
    part = F.shiftright("_m", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))
    before = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return ordered.withColumn("_part", part).join(F.broadcast(before), "_part").select("_row.*", rank.cast("long").alias(name))


def time_split(df: DataFrame, year: str = "publication_year", month: str = "publication_month", order: Sequence[str] = (), train: float = 0.65, dev: float = 0.8) -> DataFrame:
    """Add ``split``: the oldest rows train, then dev, the newest test, cut at whole percentiles."""
    ranked = global_rank(df, [year, month], list(order) or [year, month], "_rank")
    n = df.groupBy().agg(F.count("*").alias("_total"))
    cut = lambda share: F.floor(F.col("_total") * F.lit(float(share)))
    split = F.when(F.col("_rank") <= cut(train), "train").when(F.col("_rank") <= cut(dev), "dev").otherwise("test")
    return ranked.join(F.broadcast(n)).withColumn("split", split).drop("_rank", "_total")


def md5_order(seed: int, *parts: str) -> Column:
    """The order of a draw: the md5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def cap_per_group(df: DataFrame, group: str, cap: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each group, drawn by hash."""
    w = Window.partitionBy(group).orderBy(md5_order(seed, key), key)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def stratified_sample(df: DataFrame, total: int = 250, score: str = "score", key: str = "id", seed: int = 42, low: int = 1, high: int = 5) -> DataFrame:
    """An equal number of rows of each whole score between ``low`` and ``high``.

    The remainder goes to the first scores; a score with too few rows gives all
    of them and the shortfall is not made up.  No valid score gives no rows.
    """
    s = F.col(score)
    valid = df.filter(s.isNotNull() & ~F.isnan(s.cast("double")) & s.between(low, high) & (s == F.floor(s)))
    strata = valid.select(score).distinct().withColumn("_i", F.row_number().over(Window.orderBy(score))).withColumn("_k", F.count("*").over(Window.partitionBy()))
    strata = strata.withColumn("_quota", F.floor(F.lit(total) / F.col("_k")) + F.when(F.col("_i") <= F.lit(total) % F.col("_k"), 1).otherwise(0)).select(score, "_quota")
    ranked = valid.withColumn("_n", F.row_number().over(Window.partitionBy(score).orderBy(md5_order(seed, key), key)))
    # no score gives more than the total, so that a task needn't sort more than that
    return ranked.filter(F.col("_n") <= total).join(F.broadcast(strata), score).filter("_n <= _quota").select(*df.columns)


def shuffled(df: DataFrame, key: str, seed: int = 42, name: str = "sample_id") -> DataFrame:
    """Number the rows from 1 in the order of their hashes."""
    hashed = df.withColumn("_md5", md5_order(seed, key)).withColumn("_coarse", F.substring("_md5", 1, 3))
    return global_rank(hashed, ["_coarse"], ["_md5", key], name).drop("_md5", "_coarse")
