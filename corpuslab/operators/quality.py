"""Quality filters, score statistics and annotation sets of sentence pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import splits

# ---- Fixed values: aliases of the pair and score columns, by priority.
SENT1, SENT2, SCORE = ("sent1", "sentence1", "original_text", "text1"), ("sent2", "sentence2", "infilled_text", "text2"), ("similarity_score", "score")
#: What a missing infill score counts as.
NO_SCORE = -9.9


def rule_columns(th_lp: float = -3.0, th_hyb: float = 0.3, min_len: int = 4, max_len: int = 180) -> dict[str, Column]:
    """The four row rules; a null makes a rule fail, but for a missing infill score."""
    no = F.lit(False)
    return {
        "no_mask": F.coalesce(~T.has_residual_mask(F.col("infilled")), no),
        "likely": F.coalesce(T.not_nan(F.col("infill_score")), F.lit(NO_SCORE)) >= F.lit(th_lp),
        "similar": F.coalesce(T.not_nan(F.col("hybrid_score")) >= F.lit(th_hyb), no),
        "length_ok": F.coalesce(F.col("length").between(min_len, max_len), no),
    }


def filter_pairs(df: DataFrame, *, tiebreak: Sequence[str] = (), ordered: bool = True, **thresholds: float) -> DataFrame:
    """The rows that pass all rules, the highest hybrid scores first; of each pair id the one with the highest."""
    kept = df
    for rule in rule_columns(**thresholds).values():
        kept = kept.filter(rule)
    w = Window.partitionBy("pair_id").orderBy(F.desc("hybrid_score"), *tiebreak)
    best = kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return best.orderBy(F.desc("hybrid_score"), "pair_id") if ordered else best


def attrition(df: DataFrame, **thresholds: float) -> DataFrame:
    """Rows left after each rule in turn, and pairs after the last."""
    out, passed = [F.count("*").alias("original")], F.lit(True)
    for name, rule in rule_columns(**thresholds).items():
        passed = passed & rule
        out.append(F.count_if(passed).alias(f"after_{name}"))
    return df.agg(*out, F.countDistinct(F.when(passed, F.col("pair_id"))).alias("after_dedup"))


def hybrid_histogram(df: DataFrame, bins: Sequence[float] = (0.0, 0.3, 0.7, 1.01), labels: Sequence[str] = ("low", "mid", "high"), score: str = "hybrid_score") -> DataFrame:
    """Rows in each half-open bucket ``(low, high]``, empty ones too."""
    value = T.not_nan(F.col(score))
    counts = [F.count_if((value > a) & (value <= b)).alias(x) for a, b, x in zip(bins, bins[1:], labels)]
    return df.agg(*counts).select(F.explode(F.array(*[F.struct(F.lit(i).alias("bucket_no"), F.lit(x).alias("bucket"), F.col(x).alias("n")) for i, x in enumerate(labels)])).alias("b")).select("b.*")


def score_stats(df: DataFrame, score: str = "score") -> DataFrame:
    s = T.not_nan(F.col(score).cast("double"))
    return df.agg(
        F.count("*").alias("n_rows"), F.count(s).alias("n_valid"), F.round(F.avg(s), 6).alias("mean"), F.round(F.percentile(s, 0.5), 6).alias("median"), F.round(F.stddev_samp(s), 6).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"),
    )


def score_histogram(df: DataFrame, score: str = "score", compat: bool = True) -> DataFrame:
    """Five buckets ``[lo, lo + 1)`` from 0 with their percentages; ``compat`` leaves 5 out, else the last one holds it."""
    s = T.not_nan(F.col(score).cast("double"))
    inside = lambda lo: (s >= lo) & ((s < lo + 1) if compat or lo < 4 else (s <= lo + 1))
    counts = df.agg(F.count(s).alias("n_valid"), *[F.count_if(inside(lo)).alias(f"b{lo}") for lo in range(5)])
    pct = lambda lo: F.round(F.coalesce(100.0 * F.col(f"b{lo}") / F.nullif(F.col("n_valid"), F.lit(0)), F.lit(0.0)), 4)
    rows = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(lo + 1).alias("hi"), F.col(f"b{lo}").alias("n"), pct(lo).alias("pct")) for lo in range(5)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def value_counts(df: DataFrame, col: str = "score") -> DataFrame:
    """Each non-null value's count and percentage."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).select(col, "n", F.round(100.0 * F.col("n") / F.col("_t"), 4).alias("pct"))


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls (and NaNs) of each column."""
    kinds = dict(df.dtypes)
    missing = lambda c: F.count_if(F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)))
    return df.agg(*[missing(c).alias(c) for c in df.columns])


def valid_scores(df: DataFrame, score: str = "score", valid: bool = True) -> DataFrame:
    ok = T.not_nan(F.col(score).cast("double")).isNotNull()
    return df.filter(ok if valid else ~ok)


def restructure(df: DataFrame) -> DataFrame:
    """``sent1, sent2, pair, score`` from whatever the columns are called."""
    a, b, s = (T.resolve_column(df.columns, names) for names in (SENT1, SENT2, SCORE))
    return df.select(F.col(a).alias("sent1"), F.col(b).alias("sent2"), T.pair_string(F.col(a), F.col(b)).alias("pair"), F.col(s).alias("score"))


def annotation_rules() -> dict[str, Column]:
    """Usable annotation rows, rule by rule."""
    original, modified, no = F.col("original_text"), F.col("modified_text"), F.lit(False)
    return {
        "no_error": ~T.starts_with_error(modified),
        "no_chapter": ~T.mentions_chapter(original),
        "long_enough": F.coalesce((F.length(original) >= 10) & (F.length(modified) >= 10), no),
        "words": F.coalesce(F.size(T.whitespace_tokens(modified)) > 1, no),
    }


def filter_annotations(df: DataFrame) -> DataFrame:
    for rule in annotation_rules().values():
        df = df.filter(rule)
    return df


def annotation_attrition(df: DataFrame) -> DataFrame:
    out, passed = [F.count("*").alias("original")], F.lit(True)
    for name, rule in annotation_rules().items():
        passed = passed & rule
        out.append(F.count_if(passed).alias(f"after_{name}"))
    return df.agg(*out)


def annotation_set(df: DataFrame, total: int = 250, key: str = "id", seed: int = 42) -> DataFrame:
    """A shuffled, equally stratified sample with empty columns for the experts."""
    sample = splits.shuffled(splits.stratified_sample(df, total, "score", key, seed), key, seed)
    empty = [F.lit("").alias(c) for c in ("expert_score", "expert_comments", "annotation_date", "annotator_id")]
    return sample.select(F.col("sample_id").cast("int").alias("sample_id"), "original_text", "modified_text", "score", *empty)


ANNOTATION_GUIDE = """# Annotation guide

Score each pair from 1 (unrelated) to 5 (same meaning) in `expert_score`; say why in `expert_comments`.
Fill in `annotation_date` and `annotator_id`.  Leave `sample_id` and the texts as they are.
"""


def statistics_text(values: dict[str, object]) -> str:
    """A statistics file: one aligned line for each value."""
    width = max((len(k) for k in values), default=0)
    return "\n".join(f"{k.ljust(width)}  {v}" for k, v in values.items())


def model_card(parameters: dict[str, object], metrics: dict[str, object], input_size: int) -> str:
    """A JSON card of what a topic model was fitted on, with what settings, and how it turned out."""
    import json

    return json.dumps({"input_size": input_size, "parameters": parameters, "metrics": metrics}, indent=2, default=str)
