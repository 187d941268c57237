"""Row-level operators over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators import quality


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def clean_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the cleaned text; stateless, so it is the batch expression."""
    return stream.withColumn("clean_text", T.preprocess_text(F.col(text_col)))


def filter_stream(stream: DataFrame, time_col: str, watermark: str = "1 hour", **thresholds: float) -> DataFrame:
    """The batch quality rules, then the first row of each pair id within the watermark."""
    for rule in quality.rule_columns(**thresholds).values():
        stream = stream.filter(rule)
    return stream.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["pair_id"])
