"""From raw files to stories and paragraphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T

#: The parts of an issue's file name: volume, issue, year, month.
ISSUE_FIELDS = ("volume_number", "issue_number", "publication_year", "publication_month")
# ---- Fixed value: file names of magazine issues, matched from their start.
FILE_PATTERN = r"^amazing_stories-(\d+)\.(\d+)\((\d+)\.(\d+)\)"


def file_entries(files: DataFrame, path_col: str = "path", pattern: str = FILE_PATTERN) -> DataFrame:
    """Files whose names match, with ``year, month, volume, issue``; others are left out."""
    name = F.regexp_extract(path_col, r"[^/]*$", 0)
    parts = {f: F.regexp_extract(name, pattern, i).cast("int") for i, f in enumerate(("volume", "issue", "year", "month"), 1)}
    return files.filter(name.rlike(pattern)).select("*", *[c.alias(f) for f, c in parts.items()])


def sorted_entries(files: DataFrame, path_col: str = "path", pattern: str = FILE_PATTERN) -> DataFrame:
    return file_entries(files, path_col, pattern).orderBy("year", "month", "volume", "issue", path_col)


def dedup_by_content(files: DataFrame, content_col: str, order: list[str]) -> DataFrame:
    """One row for each content, the first by ``order``; adds ``raw_hash``, the content's SHA-256."""
    hashed = files.withColumn("raw_hash", F.sha2(F.col(content_col).cast("binary"), 256))
    w = Window.partitionBy("raw_hash").orderBy(*order)
    return hashed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def story_blocks(html: Column, open_tag: str = r'<div\s+type="story"[^>]*>', close_tag: str = "</div>") -> Column:
    """The bodies between an opening tag and the first closing one."""
    return F.regexp_extract_all(html, F.lit(f"(?is){open_tag}(.*?){close_tag}"), F.lit(1))


def story_title(block: Column) -> Column:
    return T.strip(F.regexp_extract(block, r"(?is)<title[^>]*>(.*?)</title>", 1))


def story_authors(block: Column, tag: str = "author") -> Column:
    return F.transform(F.regexp_extract_all(block, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1)), T.strip)


def story_content(block: Column) -> Column:
    """The block without its head, markup kept."""
    return T.strip(F.regexp_replace(block, r"(?is)<head>.*?</head>", ""))


def extract_stories(files: DataFrame, html_col: str = "text", **tags: str) -> DataFrame:
    """``title, authors, full_text`` of each story with a title and content, beside the file's other columns."""
    keep = [c for c in files.columns if c != html_col]
    blocks = files.select(*keep, F.posexplode(story_blocks(F.col(html_col), **tags)).alias("block_index", "_block"))
    out = blocks.select(*keep, "block_index", story_title(F.col("_block")).alias("title"), story_authors(F.col("_block")).alias("authors"), story_content(F.col("_block")).alias("full_text"))
    return out.filter("title <> '' and full_text <> ''")


def blank_line_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n+"), T.strip), lambda p: p != "")


def segment_paragraphs(stories: DataFrame, text_col: str = "full_text") -> DataFrame:
    """A row for each paragraph between blank lines, numbered from 1."""
    keep = [c for c in stories.columns if c != text_col]
    return stories.select(*keep, F.posexplode(blank_line_paragraphs(F.col(text_col))).alias("_i", "paragraph_text")).select(*keep, (F.col("_i") + 1).alias("paragraph_index"), "paragraph_text")


def pack_sentences(sentences: Column, max_tokens: int, count: Callable[[Column], Column]) -> Column:
    """Successive sentences packed into chunks of at most ``max_tokens``; a longer one is a chunk of its own."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))
    sized = F.transform(sentences, lambda s: F.struct(s.alias("s"), count(s).cast("int").alias("k")))

    def add(acc: Column, x: Column) -> Column:
        full = (acc["cur"] != "") & (acc["n"] + x["k"] > max_tokens)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["cur"] == ""), x["s"]).otherwise(F.concat(acc["cur"], F.lit(" "), x["s"])).alias("cur"),
            F.when(full, x["k"]).otherwise(acc["n"] + x["k"]).alias("n"),
        )

    return F.aggregate(F.filter(sized, lambda x: x["s"] != ""), zero, add, lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))


def chunk_paragraphs(stories: DataFrame, text_col: str = "full_text", max_tokens: int = 400, split: Callable[[Column], Column] = T.split_sentences, count: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """A row for each chunk within the token budget, numbered from 0; stories without text give none."""
    keep = [c for c in stories.columns if c != text_col]
    chunks = pack_sentences(split(F.col(text_col)), max_tokens, count)
    return stories.filter(F.col(text_col).isNotNull()).select(*keep, F.posexplode(chunks).alias("paragraph_index", "paragraph_text"))


def validate_paragraphs(df: DataFrame, required: tuple[str, ...] = ("paragraph_text", "paragraph_index", "publication_year", "publication_month")) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
