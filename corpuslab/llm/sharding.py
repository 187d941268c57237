"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Rows that one slot bucket should hold; the number of buckets follows the table.  A bucket of so many times as many is crowded.
ROWS_PER_BUCKET, CROWDED = 500_000, 4


def uniform(key: Column, shard: int, salt: str = "") -> Column:
    """A number in (0, 1) that key and shard decide: 52 bits of a 64-bit hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{salt}|{shard}")), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float], salt: str = "") -> Column:
    """The shard whose score ``-weight / ln(u)`` is the highest for this key.

    A shard's score does not depend on the others, so that a further shard only
    takes keys into itself and a lost one only gives its own away.  Shards of
    weight 0 receive nothing.  A null key counts as the text ``null``.
    """
    return (-best_score(key, enumerate(weights), salt)["low"]).cast("int")


def best_score(key: Column, shards: Iterable[tuple[int, float]], salt: str = "") -> Column:
    """The greatest ``(score, -shard)`` of these weighted shards."""
    live = [(i, float(w)) for i, w in shards if w > 0]
    if not live:
        raise ValueError("at least one shard needs a positive weight")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [F.struct((F.lit(-w) / F.ln(uniform(key, i, salt))).alias("score"), F.lit(-i).alias("low")) for i, w in live]
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def assign_shards(
    df: DataFrame,
    n_shards: int,
    *,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``size, text_crc32, law, shard, slot, grown_shard`` to every row.

    Law ``key``: key and shard count alone decide.  ``size`` is the text's UTF-8
    bytes plus 8 (a null text has none, and its crc32 is that of no bytes).
    ``grown_shard`` is the shard when one more of the mean weight is added.
    Null keys all go to one shard, like any other key.  Own columns of the six
    names are replaced, others stay whatever their names; texts may be of any
    length; an empty table gives no rows.

    ``slot`` numbers a shard's rows without gaps, by bucket, then key, size
    and crc; rows that agree in all of these are told apart arbitrarily.  The
    buckets are hashes of the key and their number follows the table, so no
    task sees a whole shard; the counts of them need the keys alone.  Where one
    key has so many rows that its bucket is crowded, buckets are hashes of key,
    size and crc instead, each counted partition by partition of a checkpoint.
    """
    weights = [1.0] * n_shards if weights is None else list(weights)
    if len(weights) != n_shards:
        raise ValueError("one weight for each shard")
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    old = [c for c in df.columns if c not in added]
    body, k = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")), F.col(f"`{key}`")
    n_buckets = max(1, min(65_536, -(-df.count() // (n_shards * rows_per_bucket)) * 4))
    bucket = lambda *c: F.pmod(F.xxhash64(*c, F.lit(7)), F.lit(n_buckets)).cast("int")
    counts = checkpoint(df.select(rendezvous(k, weights).alias("shard"), bucket(k).alias("_bucket"), F.lit(0).alias("_part")).groupBy("shard", "_bucket", "_part").agg(F.count("*").alias("n")))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in old]).alias("row") if old else F.struct(F.lit(None).alias("_")).alias("row"), k.alias("_key"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), best_score(k, enumerate(weights)).alias("_best"),
    )
    placed = rows.select(
        "row", "_key", "size", "text_crc32", F.lit("key").alias("law"), (-F.col("_best.low")).cast("int").alias("shard"),
        (-F.greatest("_best", best_score(F.col("_key"), [(n_shards, sum(weights) / n_shards)]))["low"]).cast("int").alias("grown_shard"),
        bucket(F.col("_key")).alias("_bucket"), F.lit(0).alias("_part"),
    )
    if (counts.agg(F.max("n")).first()[0] or 0) > CROWDED * rows_per_bucket:
        placed = checkpoint(placed.withColumn("_bucket", bucket(F.col("_key"), F.col("size"), F.col("text_crc32"))).withColumn("_part", F.spark_partition_id()))
        counts = placed.groupBy("shard", "_bucket", "_part").agg(F.count("*").alias("n"))
    return _slotted(placed, counts).select("row.*", *added)


def _slotted(placed: DataFrame, counts: DataFrame) -> DataFrame:
    """``placed`` with ``slot``: a shard's (bucket, partition) pairs stand one after the other, and rows are numbered inside a pair."""
    before = lambda w, by: F.coalesce(F.sum("n").over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = counts.withColumn("_within", before(Window.partitionBy("shard", "_bucket"), "_part"))
    whole = counts.groupBy("shard", "_bucket").agg(F.sum("n").alias("n"))
    whole = whole.select("shard", "_bucket", before(Window.partitionBy("shard"), "_bucket").alias("_before"))
    first = inside.join(whole, ["shard", "_bucket"]).select("shard", "_bucket", "_part", (F.col("_within") + F.col("_before")).alias("_first"))
    own = Window.partitionBy("shard", "_bucket", "_part").orderBy(F.col("_key").asc_nulls_first(), "size", "text_crc32")
    return placed.withColumn("_n", F.row_number().over(own).cast("long") - 1).join(first, ["shard", "_bucket", "_part"]).withColumn("slot", F.col("_n") + F.col("_first"))
