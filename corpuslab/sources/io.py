"""Readers and writers; every reader has an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions import text as fn
from corpuslab.operators import extract

# --- sources -----------------------------------------------------------------


def read_files(spark: SparkSession, folder: str, pattern: str = extract.FILE_PATTERN, strict: bool = True) -> DataFrame:
    """Issue files with their parsed names and whole text, equal contents once (the oldest).

    ``strict`` fails on bytes that aren't UTF-8; otherwise such files are left out.
    """
    raw = spark.read.format("binaryFile").load(folder).select("path", "content")
    files = extract.file_entries(raw, "path", pattern)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    files = files.withColumn("_ok", F.when(valid, True).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path"))) if strict else valid).filter("_ok").drop("_ok")
    files = extract.dedup_by_content(files, "content", ["year", "month", "volume", "issue", "path"])
    return files.select(
        "path", F.col("volume").alias("volume_number"), F.col("issue").alias("issue_number"), F.col("year").alias("publication_year"), F.col("month").alias("publication_month"), "raw_hash", F.col("content").cast("string").alias("text")
    )


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; blank ones don't count.  ``strict`` fails on malformed lines."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_topic_keywords(spark: SparkSession, path: str) -> DataFrame:
    """``topic_id, rank, word`` of a JSON object of lists."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(_keyword_map(F.col("value")))).select(F.col("key").alias("topic_id"), F.posexplode("value").alias("rank", "word")).withColumn("rank", F.col("rank") + 1)


def _keyword_map(text):
    from corpuslab.operators.topics import keywords_from_json

    return keywords_from_json(text)


def read_annotation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Four columns without a header; scores that aren't numbers become null."""
    df = spark.read.schema("original_text string, modified_text string, combined_text string, score string").csv(path, header=False, multiLine=True, escape='"')
    return df.withColumn("score", fn.to_number(F.col("score")))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("inferSchema", True)
    return reader.csv(path, header=True, multiLine=True, escape='"')


def read_stopwords(spark: SparkSession, path: str) -> list[str]:
    """One word a line, trimmed and in small letters, without blanks; all of them, as a list that plans hold."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).filter("w <> ''").distinct()
    return sorted(r["w"] for r in lines.collect())


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("paragraph_id long, embedding array<float>").parquet(path)


def read_model(path: str):
    """A fitted pipeline of ``pyspark.ml``, as ``write_model`` stored it."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, wherever it is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def spread(df: DataFrame, key: str, most: int = 1 << 30) -> DataFrame:
    """Deal the rows of a small input, such as a single file, to all cores.

    An input of more than ``most`` bytes, by the plan's own statistics, or of at
    least as many partitions as there are cores stays as it is, so large tables
    are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most:
        return df
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


# --- sinks -------------------------------------------------------------------


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, which CSV can hold."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    flat(df).write.mode(mode).option("escape", '"').csv(path, header=True, compression=compression)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_model(model, path: str) -> None:
    """Store a fitted pipeline, over an older one."""
    model.write().overwrite().save(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text, such as a guide or a report."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, folder: str) -> None:
    """``train``, ``dev`` and ``test`` of a time split, one folder each."""
    df.write.mode("overwrite").partitionBy("split").json(folder)


def write_keywords(keywords: DataFrame, path: str, counts: DataFrame | None = None) -> None:
    """The keyword map, or with topic counts the detailed list, as JSON."""
    from corpuslab.operators.topics import keyword_map, topic_info

    if counts is None:
        keyword_map(keywords).write.mode("overwrite").json(path)
        return
    words = keywords.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word", "score"))), lambda x: F.struct(x["word"].alias("word"), x["score"].alias("score"))).alias("keywords"))
    topic_info(counts, keywords).join(words, "topic_id").write.mode("overwrite").json(path)
