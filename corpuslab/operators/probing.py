"""Probing-task items from sentences (``id_col``, ``sentence``), drawn by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import splits

COORDINATORS = ("and", "but", "or")


def _flag(seed: int, id_col: str) -> Column:
    """Whether an item is changed: one bit of the hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}f"), F.col(id_col).cast("string"))), 1, 1), 16, 10).cast("int") < 8


def _at(seed: int, id_col: str, n: Column) -> Column:
    """A position from 1 to n that the hash decides."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}p"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return (F.pmod(h, n) + 1).cast("int")


def bigram_shift(sentences: DataFrame, *, id_col: str = "sentence_id", seed: int = 42, min_tokens: int = 5) -> DataFrame:
    """Two neighbouring tokens swapped (label I) or not (O)."""
    t = sentences.withColumn("_t", T.whitespace_tokens(F.col("sentence"))).filter(F.size("_t") >= min_tokens).withColumn("_i", _at(seed, id_col, F.size("_t") - 1))
    swapped = F.concat(F.slice("_t", F.lit(1), F.col("_i") - 1), F.slice("_t", F.col("_i") + 1, F.lit(1)), F.slice("_t", F.col("_i"), F.lit(1)), F.slice("_t", F.col("_i") + 2, F.size("_t")))
    changed = _flag(seed, id_col)
    return t.select(id_col, F.when(changed, F.array_join(swapped, " ")).otherwise(F.array_join("_t", " ")).alias("item"), F.when(changed, "I").otherwise("O").alias("label"))


def word_contents(sentences: DataFrame, *, id_col: str = "sentence_id", n_words: int = 50, skip: int = 50) -> DataFrame:
    """Sentences that hold exactly one of the mid-frequency target words, once; the label is that word."""
    words = sentences.select(id_col, "sentence", F.explode(T.word_tokens(F.lower("sentence"))).alias("w"))
    ranked = words.groupBy("w").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").limit(skip + n_words)
    targets = ranked.orderBy("c", F.desc("w")).limit(n_words).select("w")
    hits = words.join(F.broadcast(targets), "w").groupBy(id_col, "sentence").agg(F.count("*").alias("n"), F.min("w").alias("label"))
    return hits.filter("n = 1").select(id_col, F.col("sentence").alias("item"), "label")


def odd_word_out(sentences: DataFrame, *, id_col: str = "sentence_id", seed: int = 42, min_tokens: int = 5) -> DataFrame:
    """One word replaced by the next one of the same frequency band (label C) or not (O)."""
    from pyspark.sql import Window

    words = sentences.select(F.explode(T.whitespace_tokens(F.col("sentence"))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    band = words.withColumn("band", F.floor(F.log2("c")).cast("int"))
    part = F.substring(F.md5("w"), 1, 2)
    swaps = band.withColumn("other", F.lead("w").over(Window.partitionBy("band", part).orderBy("w"))).select("w", "other")
    t = sentences.withColumn("_t", T.whitespace_tokens(F.col("sentence"))).filter(F.size("_t") >= min_tokens).withColumn("_i", _at(seed, id_col, F.size("_t")))
    t = t.withColumn("w", F.element_at("_t", F.col("_i"))).join(swaps, "w", "left")
    changed = _flag(seed, id_col) & F.col("other").isNotNull()
    new = F.concat(F.slice("_t", F.lit(1), F.col("_i") - 1), F.array("other"), F.slice("_t", F.col("_i") + 1, F.size("_t")))
    return t.select(id_col, F.when(changed, F.array_join(new, " ")).otherwise(F.array_join("_t", " ")).alias("item"), F.when(changed, "C").otherwise("O").alias("label"))


def coordinate_inversion(sentences: DataFrame, *, id_col: str = "sentence_id", seed: int = 42) -> DataFrame:
    """Sentences with one coordinator, the clauses around it swapped (I) or not (O)."""
    t = sentences.withColumn("_t", T.whitespace_tokens(F.col("sentence")))
    t = t.withColumn("_k", F.filter(F.transform("_t", lambda w, i: F.when(F.lower(w).isin(*COORDINATORS), i + 1)), lambda i: i.isNotNull())).filter(F.size("_k") == 1)
    t = t.withColumn("_i", F.get("_k", F.lit(0))).filter((F.col("_i") > 1) & (F.col("_i") < F.size("_t")))
    new = F.concat(F.slice("_t", F.col("_i") + 1, F.size("_t")), F.slice("_t", F.col("_i"), F.lit(1)), F.slice("_t", F.lit(1), F.col("_i") - 1))
    changed = _flag(seed, id_col)
    return t.select(id_col, F.when(changed, F.array_join(new, " ")).otherwise(F.array_join("_t", " ")).alias("item"), F.when(changed, "I").otherwise("O").alias("label"))


def clause_depth(sentences: DataFrame, *, id_col: str = "sentence_id", most: int = 7) -> DataFrame:
    """A stand-in for tree depth where no parser is given: clause marks plus one, at most ``most``."""
    depth = F.least(F.regexp_count("sentence", F.lit(r"[,;:(]")) + 1, F.lit(most))
    return sentences.select(id_col, F.col("sentence").alias("item"), depth.cast("int").alias("label"))


def balanced(items: DataFrame, total: int = 1000, *, id_col: str = "sentence_id", seed: int = 42) -> DataFrame:
    """An equal number of items of each label."""
    from pyspark.sql import Window

    labels = items.select("label").distinct().agg(F.count("*").alias("_k"))
    ranked = items.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(splits.md5_order(seed, id_col), id_col)))
    return ranked.filter(F.col("_n") <= total).join(F.broadcast(labels)).filter(F.col("_n") <= F.floor(F.lit(total) / F.col("_k"))).drop("_n", "_k")


#: The five tasks, each from ``(id_col, sentence)`` to ``(id_col, item, label)``.
TASKS = {"bigram_shift": bigram_shift, "word_contents": word_contents, "odd_word": odd_word_out, "coordinate_inversion": coordinate_inversion, "clause_depth": clause_depth}


def balanced_sets(sentences: DataFrame, total: int = 1000, *, id_col: str = "sentence_id", seed: int = 42) -> DataFrame:
    """``task, id, item, label``: of each task an equal number of items of each label, ``total`` at most."""
    out = None
    for name, task in TASKS.items():
        items = task(sentences, id_col=id_col).withColumn("label", F.col("label").cast("string"))
        rows = balanced(items, total, id_col=id_col, seed=seed).select(F.lit(name).alias("task"), id_col, "item", "label")
        out = rows if out is None else out.unionByName(rows)
    return out
