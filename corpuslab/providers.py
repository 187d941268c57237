"""Pluggable language tools, each with a built-in default.

A tokenizer, sentence splitter, counter, lemmatizer or tagger is any function
from column to column.  Models that need Python can be wrapped by
``batch_provider``, which loads them once in each worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as T

#: A few common verbs of four languages, without forms that mean something else in another: the default test for a verb.
VERBS = (
    "is are was were be been has have had do does did go goes went gone come came see saw seen say said make made take took give gave know knew think thought "
    "get got find found tell told ask asked seem seemed feel felt leave left call called run ran stand stood hold held turn turned look looked move moved "
    "ist sind waren haben hatte wird werden wurde kann konnte est sont était étaient avait avaient ont fait peut está están era eran fue tiene tienen puede"
).split()


def verb_test(lexicon: list[str] | None = None) -> Callable[[Column], Column]:
    return lambda sentence: T.has_word_of(sentence, lexicon or VERBS)


def batch_provider(load: Callable[[], Callable[[list[str]], list]], returns: str) -> Callable[[Column], Column]:
    """A provider from ``load``, which returns a function over a batch of texts."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()))

    return run


def hashing_embedder(docs: DataFrame, tokens: str = "tokens", dim: int = 256) -> DataFrame:
    """Add ``embedding``: hashed, idf-weighted and normalised term counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    steps = [HashingTF(numFeatures=dim, inputCol=tokens, outputCol="_tf"), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_v")]
    return Pipeline(stages=steps).fit(docs).transform(docs).withColumn("embedding", vector_to_array("_v", "float32")).drop("_tf", "_idf", "_v")
