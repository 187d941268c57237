"""Sentence pairs of originals and masked variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab import providers
from corpuslab.functions import text as T


def zip_sentences(original: Column, masked: Column, split: Callable[[Column], Column] = T.split_sentences) -> Column:
    """Sentences side by side, as far as the shorter text goes."""
    a, b = split(original), split(masked)
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(T.strip(x).alias("original"), T.strip(y).alias("masked")))


def text_column(columns: list[str]) -> str | None:
    return next((c for c in ("paragraph_text", "original_text") if c in columns), None)


def sentence_pairs(
    variants: DataFrame,
    vocabulary: DataFrame | None = None,
    *,
    order: list[str],
    min_tokens: int = 4,
    mask_min: float = 0.05,
    mask_max: float = 0.40,
    has_verb: Callable[[Column], Column] | None = providers.verb_test(),
    count: Callable[[Column], Column] = T.token_count,
) -> DataFrame:
    """``pair_id, topic_id, original, masked, mask_ratio, length`` of the usable pairs.

    A pair needs a mask, enough tokens, a verb (``has_verb`` tests for it; None: no such rule), a
    mask ratio within bounds, no heading and no short line in capitals.  With a
    ``vocabulary`` (``topic_id, word``), a topic in it needs one of its words
    among the original's tokens.  Equal pairs count once, the first by ``order``.
    """
    source = text_column(variants.columns)
    if source is None:
        raise ValueError("needs paragraph_text or original_text")
    topic = F.coalesce(F.col("topic_id").try_cast("int"), F.lit(-1)) if "topic_id" in variants.columns else F.lit(-1)
    rows = variants.select(*order, topic.alias("topic_id"), F.posexplode(zip_sentences(F.col(source), F.col("masked_text"))).alias("sent_idx", "p"))
    rows = rows.select(*order, "topic_id", "sent_idx", "p.original", "p.masked").filter(F.contains("masked", F.lit(T.MASK)))
    o = F.col("original")
    rows = rows.withColumn("length", count(o)).withColumn("_r", T.mask_ratio(F.col("masked")))
    rows = rows.filter((F.col("length") >= min_tokens) & F.col("_r").between(mask_min, mask_max) & ~T.is_heading(o) & ~T.is_all_caps_short(o))
    if has_verb is not None:
        rows = rows.filter(has_verb(o))
    if vocabulary is not None:
        words = vocabulary.groupBy(F.col("topic_id").cast("int").alias("topic_id")).agg(F.collect_set(F.lower("word")).alias("_v"))
        tokens = F.regexp_extract_all(F.lower(o), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
        rows = rows.join(words, "topic_id", "left").filter(F.col("_v").isNull() | F.arrays_overlap(tokens, F.col("_v"))).drop("_v")
    first = F.row_number().over(Window.partitionBy("original", "masked").orderBy(*order, "sent_idx"))
    rows = rows.withColumn("_n", first).filter("_n = 1")
    return rows.select(T.content_id(F.col("original"), F.col("masked")).alias("pair_id"), "topic_id", "original", "masked", T.round_half_even(F.col("_r"), 3).alias("mask_ratio"), F.col("length").cast("int").alias("length"))


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Pairs, mean length (2 digits), masks by tokens (3 digits), and removed repeats, which are none by definition."""
    masks = F.size(F.filter(T.whitespace_tokens(F.col("masked")), lambda w: w == T.MASK))
    a = pairs.agg(F.count("*").alias("total_pairs"), F.sum("length").alias("t"), F.sum(masks).alias("m"))
    return a.select(
        "total_pairs", T.round_half_even(F.coalesce(F.col("t") / F.greatest("total_pairs", F.lit(1)), F.lit(0.0)), 2).alias("avg_len"),
        T.round_half_even(F.coalesce(F.col("m") / F.greatest("t", F.lit(1)), F.lit(0.0)), 3).alias("avg_mask_ratio"), F.lit(0).cast("long").alias("unique_pairs_removed"),
    )
