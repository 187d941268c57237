"""The corpus operators' queries: ``name -> f(spark, sf_dir)``, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmlblocks import extract_main_text

    return extract_main_text(read(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, train(docs, read(spark, sf_dir, "labels")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs, 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imi import nearest

    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_gam import score_quality, train

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, train(docs, read(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiling import find_leaks

    return find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


#: Surrogates are a function of this key; a production run passes a secret one.
SURROGATE_KEY = b"corpuslab example key"


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import pseudonymise

    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    part = lambda c: F.concat(F.lit("/"), F.coalesce(F.col(c), F.lit("-")))
    return scan_licences(docs, F.concat(part("source"), part("lang"), F.lit("/"), F.col("doc_id").cast("string")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_main_text, op2_toxicity, op3_sharding, op4_nearest, op5_mixing, op6_quality, op7_decontamination, op8_surrogates, op9_near_duplicates, op10_licences)}


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS sh
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc),
c AS (SELECT doc, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.doc = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_near_duplicates": OP9_SQL}
