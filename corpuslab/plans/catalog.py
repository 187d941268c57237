"""Registered queries of the curation operators, each with its SQL where SQL can express it.

The tables are synthetic prose, so that several rules would never fire on them;
the inputs below inject what they look for, in the same way for both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab import providers
from corpuslab.config import PIPELINE
from corpuslab.functions import text as T
from corpuslab.operators import extract, infill, masking, pairs, probing, quality, splits, topics
from corpuslab.session import checkpoint
from corpuslab.sources import io

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Tables of texts, whose rows are costly, and their keys.
_KEYS = {"documents": "doc_id", "pages": "page_id"}

# --- inputs ------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return io.spread(df, _KEYS[name]) if name in _KEYS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


EN = "en AS (SELECT doc_id, text, source FROM documents)"
# What Spark's (?U)\w and its complement match, in DuckDB's patterns; and a sentence's words and single signs.
_W, _NW = "[\\p{L}\\p{M}\\p{N}_]", "[^\\p{L}\\p{M}\\p{N}_\\s]"
_SIGNS = f"{_W}+|{_NW}"


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    mark = F.when(F.expr("doc_id % 13 = 0"), " <mask>").when(F.expr("doc_id % 17 = 0"), " <task>").when(F.expr("doc_id % 19 = 0"), " <extra_id_3>").otherwise("")
    return d.select(
        "doc_id", F.expr("doc_id % 400").alias("pair_id"), F.concat("text", mark).alias("infilled"), F.expr("if(doc_id % 7 = 0, null, -(doc_id % 50) / 10D)").alias("infill_score"),
        F.expr("(doc_id % 101) / 100D").alias("hybrid_score"), F.size(T.whitespace_tokens(F.col("text"))).alias("length"),
    )


PAIRS = """src AS (
  SELECT doc_id, doc_id % 400 AS pair_id, text || CASE WHEN doc_id % 13 = 0 THEN ' <mask>' WHEN doc_id % 17 = 0 THEN ' <task>' WHEN doc_id % 19 = 0 THEN ' <extra_id_3>' ELSE '' END AS infilled,
         CASE WHEN doc_id % 7 = 0 THEN NULL ELSE -(doc_id % 50) / 10::DOUBLE END AS infill_score, (doc_id % 101) / 100::DOUBLE AS hybrid_score, len(regexp_extract_all(text, '\\S+')) AS length
  FROM documents
), ok AS (
  SELECT *, NOT regexp_matches(infilled, '(?i)<mask>|<extra_id_\\d+>|<\\w*mask\\w*>|<\\w*sk\\w*>') AS a, coalesce(infill_score, -9.9) >= -3.0 AS b, hybrid_score >= 0.3::DOUBLE AS c, length BETWEEN 4 AND 180 AS d FROM src
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.expr("if(doc_id % 11 = 0, null, cast(doc_id % 7 - 1 as double) + if(doc_id % 23 = 0, 0.5D, 0D))").alias("score"), "source")


SCORES = "s AS (SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 7 - 1)::DOUBLE + CASE WHEN doc_id % 23 = 0 THEN 0.5::DOUBLE ELSE 0 END END AS score FROM documents)"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.expr("case doc_id % 29 when 0 then 'Answer: ' when 1 then 'Sentence: ' when 2 then 'The most appropriate ' when 3 then 'Rewritten sentence: ' else '' end")
    original = F.expr("case when doc_id % 31 = 0 then concat('Chapter ', text) when doc_id % 37 = 0 then null when doc_id % 41 = 0 then 'short' else text end")
    modified = F.when(F.expr("doc_id % 43 = 0"), "Singlewordonly").otherwise(F.concat(head, F.col("text")))
    return scores(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", original.alias("original_text"), modified.alias("modified_text")), "doc_id").withColumnRenamed("doc_id", "id")


ANNOTATIONS = f"""{SCORES}, ann AS (
  SELECT d.doc_id AS id, s.score, CASE WHEN d.doc_id % 31 = 0 THEN 'Chapter ' || text WHEN d.doc_id % 37 = 0 THEN NULL WHEN d.doc_id % 41 = 0 THEN 'short' ELSE text END AS original_text,
         CASE WHEN d.doc_id % 43 = 0 THEN 'Singlewordonly' ELSE (CASE d.doc_id % 29 WHEN 0 THEN 'Answer: ' WHEN 1 THEN 'Sentence: ' WHEN 2 THEN 'The most appropriate ' WHEN 3 THEN 'Rewritten sentence: ' ELSE '' END) || text END AS modified_text
  FROM documents d JOIN s ON s.doc_id = d.doc_id
), rules AS (
  SELECT *, NOT (starts_with(modified_text, 'Answer:') OR starts_with(modified_text, 'Sentence:') OR starts_with(modified_text, 'The most appropriate') OR starts_with(modified_text, 'Rewritten sentence:')) AS a,
         NOT coalesce(contains(lower(original_text), 'chapter'), false) AS b, coalesce(length(original_text) >= 10 AND length(modified_text) >= 10, false) AS c, len(regexp_extract_all(modified_text, '\\S+')) > 1 AS d
  FROM ann
)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("sentence_id", F.col("doc_id") * 100_000 + F.col("pos"))


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SENTENCES = f"""{EN}, sl AS (SELECT doc_id, string_split(regexp_replace({STRIP.format('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM en),
sent AS (SELECT doc_id, pos, sentence, doc_id * 100000 + pos AS sentence_id FROM (SELECT doc_id, unnest(l) AS sentence, unnest(range(len(l))) AS pos FROM sl))"""


def topic_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their words and topic, -1 where they have no label."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("int").alias("topic_id"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))
    return documents(spark, sf_dir).join(labels, "doc_id", "left").select("doc_id", F.coalesce("topic_id", F.lit(-1)).alias("topic_id"), "text", words.alias("tokens"))


def keywords(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """Each topic's best words and pairs of words, without stop words; a small table, made once."""
    words = topics.without_stopwords(F.col("tokens"), T.stopwords())
    grams = T.let(words, lambda w: F.concat(w, topics.ngrams(w, 2)))
    return checkpoint(topics.top_keywords(topics.class_tf_idf(topic_docs(spark, sf_dir).select("topic_id", F.explode(grams).alias("word"))), n))


_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.stopwords()) + "]"
TOKENS = f"""{EN}, raw AS (SELECT d.doc_id, coalesce(e.label, -1)::INTEGER AS topic_id, d.text, regexp_extract_all(lower(d.text), '\\p{{L}}[\\p{{L}}\\p{{M}}]*') AS ws FROM en d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
tok AS (SELECT doc_id, topic_id, text, ws, list_filter(ws, lambda w: NOT list_contains({_STOP_SQL}, w)) AS cs FROM raw)"""
KEYWORDS = f"""{TOKENS}, terms AS (
  SELECT topic_id, unnest(cs) AS word FROM tok UNION ALL SELECT topic_id, unnest(list_transform(range(1, len(cs)), lambda i: cs[i] || ' ' || cs[i + 1])) FROM tok
), tf AS (SELECT topic_id, word, count(*) AS tf FROM terms GROUP BY ALL), fr AS (SELECT word, sum(tf) AS f FROM tf GROUP BY 1),
av AS (SELECT avg(s)::DOUBLE AS a FROM (SELECT sum(tf)::DOUBLE AS s FROM tf GROUP BY topic_id)),
sc AS (SELECT topic_id, tf.word, round(tf * ln(1 + a / f::DOUBLE), 6) AS score FROM tf JOIN fr USING (word), av WHERE topic_id <> -1),
kw AS (SELECT topic_id, (row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, word))::INTEGER AS rank, word, score FROM sc QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, word) <= 10)"""


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as topics; every ninth vector is noise."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr("if(vec_id % 9 = 0, -1, label)").cast("int").alias("topic_id"), "embedding")


ASSIGN = "asg AS (SELECT vec_id, (CASE WHEN vec_id % 9 = 0 THEN -1 ELSE label END)::INTEGER AS topic_id, embedding FROM embeddings), sizes AS (SELECT topic_id, count(*) AS n FROM asg GROUP BY 1)"


# --- pair quality --------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT doc_id, pair_id, infill_score, hybrid_score, length::INTEGER AS length FROM ok WHERE a AND b AND c AND d QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY hybrid_score DESC, doc_id) = 1")
def q_filter_pairs(spark, sf_dir):
    return quality.filter_pairs(scored_pairs(spark, sf_dir), tiebreak=["doc_id"]).drop("infilled")


@query(f"""WITH {PAIRS} SELECT count(*) AS original, count_if(a)::BIGINT AS after_no_mask, count_if(a AND b)::BIGINT AS after_likely, count_if(a AND b AND c)::BIGINT AS after_similar, count_if(a AND b AND c AND d)::BIGINT AS after_length_ok,
count(DISTINCT CASE WHEN a AND b AND c AND d THEN pair_id END) AS after_dedup FROM ok""")
def q_attrition(spark, sf_dir):
    return quality.attrition(scored_pairs(spark, sf_dir))


@query(f"""WITH {PAIRS} SELECT 0 AS bucket_no, 'low' AS bucket, count_if(hybrid_score > 0 AND hybrid_score <= 0.3::DOUBLE)::BIGINT AS n FROM src UNION ALL SELECT 1, 'mid', count_if(hybrid_score > 0.3::DOUBLE AND hybrid_score <= 0.7::DOUBLE)::BIGINT FROM src
UNION ALL SELECT 2, 'high', count_if(hybrid_score > 0.7::DOUBLE AND hybrid_score <= 1.01::DOUBLE)::BIGINT FROM src""")
def q_hybrid_hist(spark, sf_dir):
    return quality.hybrid_histogram(scored_pairs(spark, sf_dir))


@query(f"WITH {SCORES} SELECT count(*) AS n_rows, count(score) AS n_valid, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5::DOUBLE), 6) AS median, round(stddev_samp(score), 6) AS std, min(score) AS min, max(score) AS max FROM s")
def q_score_stats(spark, sf_dir):
    return quality.score_stats(scores(spark, sf_dir))


@query(f"""WITH {SCORES} SELECT lo::INTEGER AS lo, (lo + 1)::INTEGER AS hi, count_if(score >= lo AND score < lo + 1)::BIGINT AS n, round(100::DOUBLE * count_if(score >= lo AND score < lo + 1) / count(score), 4) AS pct
FROM s, range(5) t(lo) GROUP BY lo""")
def q_score_hist(spark, sf_dir):
    return quality.score_histogram(scores(spark, sf_dir))


@query(f"WITH {SCORES} SELECT score, count(*) AS n, round(100::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM s WHERE score IS NOT NULL GROUP BY score")
def q_score_counts(spark, sf_dir):
    return quality.value_counts(scores(spark, sf_dir))


@query(f"WITH {ANNOTATIONS} SELECT count_if(id IS NULL)::BIGINT AS id, count_if(score IS NULL)::BIGINT AS score, 0::BIGINT AS source, count_if(original_text IS NULL)::BIGINT AS original_text, count_if(modified_text IS NULL)::BIGINT AS modified_text FROM ann")
def q_missing_counts(spark, sf_dir):
    return quality.missing_counts(annotations(spark, sf_dir))


@query(f"WITH {SCORES} SELECT doc_id, score, score IS NOT NULL AS valid FROM s")
def q_valid_split(spark, sf_dir):
    s = scores(spark, sf_dir).drop("source")
    return quality.valid_scores(s).withColumn("valid", F.lit(True)).unionByName(quality.valid_scores(s, valid=False).withColumn("valid", F.lit(False)))


@query(f"WITH {ANNOTATIONS} SELECT id, original_text, modified_text, score FROM rules WHERE a AND b AND c AND d")
def q_annotation_filter(spark, sf_dir):
    return quality.filter_annotations(annotations(spark, sf_dir)).drop("source")


@query(f"""WITH {ANNOTATIONS} SELECT count(*) AS original, count_if(a)::BIGINT AS after_no_error, count_if(a AND b)::BIGINT AS after_no_chapter, count_if(a AND b AND c)::BIGINT AS after_long_enough, count_if(a AND b AND c AND d)::BIGINT AS after_words FROM rules""")
def q_annotation_attrition(spark, sf_dir):
    return quality.annotation_attrition(annotations(spark, sf_dir))


SAMPLE = f"""WITH {ANNOTATIONS}, v AS (SELECT * FROM rules WHERE a AND b AND c AND d AND score BETWEEN 1 AND 5 AND score = floor(score)),
st AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT score FROM v)),
smp AS (SELECT v.*, md5('42|' || id) AS h FROM v JOIN st USING (score) QUALIFY row_number() OVER (PARTITION BY score ORDER BY md5('42|' || id), id) <= 252 // k + CASE WHEN i <= 252 % k THEN 1 ELSE 0 END)"""


@query(f"{SAMPLE} SELECT id, score FROM smp")
def q_stratified_sample(spark, sf_dir):
    return splits.stratified_sample(quality.filter_annotations(annotations(spark, sf_dir)), 252).select("id", "score")


@query(f"{SAMPLE} SELECT (row_number() OVER (ORDER BY h, id))::INTEGER AS sample_id, original_text, modified_text, score, '' AS expert_score, '' AS expert_comments, '' AS annotation_date, '' AS annotator_id FROM smp")
def q_annotation_set(spark, sf_dir):
    return quality.annotation_set(quality.filter_annotations(annotations(spark, sf_dir)), 252)


@query(f"WITH {ANNOTATIONS} SELECT original_text AS sent1, modified_text AS sent2, coalesce(original_text, 'nan') || ' [SEP] ' || coalesce(modified_text, 'nan') AS pair, score FROM ann")
def q_final_pairs(spark, sf_dir):
    return quality.restructure(annotations(spark, sf_dir).withColumnRenamed("modified_text", "infilled_text"))


@query("SELECT doc_id, TRY_CAST(trim(CASE doc_id % 5 WHEN 0 THEN 'score' WHEN 1 THEN ' 3 ' WHEN 2 THEN '4.5' WHEN 3 THEN '' ELSE doc_id::VARCHAR END) AS DOUBLE) AS score FROM documents")
def q_to_number(spark, sf_dir):
    raw = F.expr("case doc_id % 5 when 0 then 'score' when 1 then ' 3 ' when 2 then '4.5' when 3 then '' else cast(doc_id as string) end")
    return table(spark, sf_dir, "documents").select("doc_id", T.to_number(raw).alias("score"))


# --- text ------------------------------------------------------------------------


def _contractions_sql(x: str) -> str:
    for short, long in T.CONTRACTIONS.items():
        quoted = short.replace("'", "''")
        x = f"regexp_replace({x}, '({_W}){quoted}\\b', '\\1{long}', 'g')" if short[0] == "'" else f"regexp_replace({x}, '{quoted}\\b', '{long}', 'g')"
    return x


def _hyphens_sql(x: str) -> str:
    for old, new in T.KNOWN_HYPHENS.items():
        x = f"regexp_replace({x}, '(?i)\\b{old}\\b', '{new}', 'g')"
    return f"regexp_replace({x}, '\\b([a-zA-Z]{{3,}})-([a-zA-Z]{{3,}})\\b', '\\1\\2', 'g')"


_SHORTENED = "replace(replace(replace(text, ' the ', ' don''t '), ' it ', ' it''s '), ' to ', ' won''t ')"
_HYPHENED = "replace(replace(replace(text, ' to ', ' To-morrow '), ' that ', ' well-known-fact '), ' in ', ' no-one ')"
_SPARK_SHORTENED, _SPARK_HYPHENED = (x.replace("''", "\\'") for x in (_SHORTENED, _HYPHENED))


@query(f"WITH {EN} SELECT doc_id, md5({_contractions_sql(_SHORTENED)}) AS h FROM en")
def q_contractions(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.expand_contractions(F.expr(_SPARK_SHORTENED))).alias("h"))


@query(f"WITH {EN} SELECT doc_id, md5({_hyphens_sql(_HYPHENED)}) AS h FROM en")
def q_hyphens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.normalize_hyphens(F.expr(_SPARK_HYPHENED))).alias("h"))


_NORMAL = f"trim(regexp_replace({_hyphens_sql(_contractions_sql(_HYPHENED))}, '\\s+', ' ', 'g'))"


@query(f"WITH {EN} SELECT doc_id, {_NORMAL} AS normal FROM en")
def q_normalize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.normalize_text(F.expr(_SPARK_HYPHENED)).alias("normal"))


def _valid_sql(w: str, least: int, ratio: float) -> str:
    letters = f"length(regexp_replace({w}, '\\P{{L}}', '', 'g'))"
    return (
        f"(length({w}) >= {least} AND (length({w}) <> 1 OR lower({w}) IN ('a', 'i')) AND {letters} / length({w})::DOUBLE >= {ratio}::DOUBLE AND (length({w}) <= 1 OR length({w}) - {letters} <= length({w}) * 0.5::DOUBLE)"
        f" AND (len(list_distinct(string_split(lower({w}), ''))) > 2 OR length({w}) <= 3))"
    )


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \\n]+')) AS word FROM documents) SELECT word, {_valid_sql('word', 2, 0.5)} AS valid, {_valid_sql('word', 3, 0.7)} AS valid_strict FROM w")
def q_valid_words(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[^ \\n]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", T.is_valid_word(F.col("word")).alias("valid"), T.is_valid_word(F.col("word"), PIPELINE).alias("valid_strict"))


_CLEAN = f"list_filter(regexp_extract_all(lower({_NORMAL}), '[\\p{{L}}\\p{{N}}]+'), lambda w: regexp_matches(w, '^\\p{{L}}+$') AND {_valid_sql('w', 3, 0.7)} AND NOT list_contains({_STOP_SQL}, w))"


@query(f"WITH {EN}, c AS (SELECT doc_id, {_CLEAN} AS ws FROM en) SELECT doc_id, array_to_string(ws, ' ') AS clean, len(ws)::INTEGER AS n FROM c WHERE len(ws) >= 10")
def q_clean_text(spark, sf_dir):
    c = documents(spark, sf_dir).select("doc_id", T.clean_tokens(F.expr(_SPARK_HYPHENED), PIPELINE).alias("ws"))
    return c.filter(F.size("ws") >= 10).select("doc_id", F.array_join("ws", " ").alias("clean"), F.size("ws").alias("n"))


@query(f"SELECT word, list_contains({_STOP_SQL}, word) AS stop FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)")
def q_stopwords(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", F.array_contains(F.array(*[F.lit(x) for x in T.stopwords()]), F.col("word")).alias("stop"))


@query(f"WITH {SENTENCES} SELECT doc_id, pos::INTEGER AS pos, sentence FROM sent")
def q_sentences(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", "pos", "sentence")


_FLAGGED = "CASE WHEN sentence_id % 11 = 0 THEN 'CHAPTER 12.' WHEN sentence_id % 11 = 1 THEN 'CHAPTER I' WHEN sentence_id % 11 = 2 THEN 'The End.' WHEN sentence_id % 11 = 3 THEN upper(substr(sentence, 1, 20)) ELSE sentence END"
_VERBS = "[" + ", ".join(f"'{v}'" for v in providers.VERBS) + "]"


@query(f"""WITH {SENTENCES}, f AS (SELECT sentence_id, {_FLAGGED} AS s FROM sent)
SELECT sentence_id, regexp_matches({STRIP.format('s')}, '(?i)^(CHAPTER|BOOK|PART|SECTION|THE END|END)\\b[\\s\\W\\d]*$') AS heading, len(regexp_extract_all(s, '\\S+')) <= 6 AND upper({STRIP.format('s')}) = {STRIP.format('s')} AND lower({STRIP.format('s')}) <> {STRIP.format('s')} AS caps,
len(list_intersect(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+'), {_VERBS})) > 0 AS verb, len(regexp_extract_all(s, '{_SIGNS}'))::INTEGER AS n_tokens FROM f""")
def q_sentence_flags(spark, sf_dir):
    s = sentences(spark, sf_dir).select("sentence_id", F.expr(_FLAGGED).alias("s"))
    c = F.col("s")
    return s.select("sentence_id", T.is_heading(c).alias("heading"), T.is_all_caps_short(c).alias("caps"), F.coalesce(providers.verb_test()(c), F.lit(False)).alias("verb"), T.token_count(c).alias("n_tokens"))


_MASKED = "replace(replace(sentence, ' the ', ' <mask> '), ' and ', ' <mask>, ')"


@query(f"""WITH {SENTENCES}, m AS (SELECT sentence_id, regexp_extract_all({_MASKED}, '\\S+') AS w FROM sent)
SELECT sentence_id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x = '<mask>')) / len(w)::DOUBLE ELSE 0 END, 3) AS ratio, len(w) >= 4 AND list_contains(w, '<mask>') AS usable FROM m""")
def q_mask_ratio(spark, sf_dir):
    m = sentences(spark, sf_dir).select("sentence_id", F.expr(_MASKED).alias("m"))
    w = T.whitespace_tokens(F.col("m"))
    return m.select("sentence_id", F.round(T.mask_ratio(F.col("m")), 3).alias("ratio"), ((F.size(w) >= 4) & F.array_contains(w, T.MASK)).alias("usable"))


@query(f"WITH {EN} SELECT doc_id, replace('<mask>' || substr(text, 6, 4) || ' <mask> <mask> <mask>' || substr(text, 31), '<mask> <mask>', '<mask>') AS masked FROM en WHERE length(text) > 40")
def q_apply_mask(spark, sf_dir):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 5), (10, 13), (14, 20), (21, 30))])
    text = F.concat(F.substring("text", 1, 9), F.lit(" abc abcdef abcdefghi"), F.substring(F.col("text"), F.lit(31), F.length("text")))
    return documents(spark, sf_dir).filter("length(text) > 40").select("doc_id", T.apply_mask(text, spans).alias("masked"))


@query(f"WITH {PAIRS} SELECT doc_id, NOT a AS residual FROM ok")
def q_residual_mask(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("doc_id", T.has_residual_mask(F.col("infilled")).alias("residual"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, printf('story_%05d', doc_id) AS story_id, md5(doc_id || chr(1) || text) AS content_id, sha256(text) AS raw_hash FROM documents")
def q_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.story_id(F.col("doc_id")).alias("story_id"), T.content_id(F.col("doc_id").cast("string"), F.col("text")).alias("content_id"), F.sha2(F.col("text").cast("binary"), 256).alias("raw_hash"))


# --- extraction ------------------------------------------------------------------


@query("""SELECT page_id, regexp_extract_all(html, '(?is)<article[^>]*>(.*?)</article>', 1)[1] AS body, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, array_to_string(list_transform(regexp_extract_all(html, '(?is)<a [^>]*>(.*?)</a>', 1), lambda x: trim(x)), '|') AS links
FROM pages WHERE len(regexp_extract_all(html, '(?is)<article[^>]*>(.*?)</article>', 1)) > 0""")
def q_page_stories(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    body = F.get(extract.story_blocks(F.col("html"), "<article[^>]*>", "</article>"), F.lit(0))
    links = F.transform(F.regexp_extract_all("html", F.lit("(?is)<a [^>]*>(.*?)</a>"), F.lit(1)), T.strip)
    return p.select("page_id", body.alias("body"), extract.story_title(F.col("html")).alias("title"), F.array_join(links, "|").alias("links")).filter("body is not null")


_ISSUE = """'<div type="story" n="1"><head>x</head><title>' || source || '</title><author>' || lang || '</author><author> B </author>' || text || '</div><div type="story"><title></title>none</div>'"""


@query(f"""WITH b AS (SELECT doc_id, unnest(regexp_extract_all({_ISSUE}, '(?is)<div\\s+type="story"[^>]*>(.*?)</div>', 1)) AS b FROM documents)
SELECT doc_id, trim(regexp_extract(b, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, array_to_string(list_transform(regexp_extract_all(b, '(?is)<author[^>]*>(.*?)</author>', 1), lambda x: trim(x)), '|') AS authors, {STRIP.format("regexp_replace(b, '(?is)<head>.*?</head>', '', 'g')")} AS full_text
FROM b WHERE trim(regexp_extract(b, '(?is)<title[^>]*>(.*?)</title>', 1)) <> ''""")
def q_stories(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_ISSUE).alias("text"))
    return extract.extract_stories(d).select("doc_id", "title", F.array_join("authors", "|").alias("authors"), "full_text")


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\\n\\s*\\n+'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, (unnest(range(len(l))) + 1)::INTEGER AS paragraph_index, unnest(l) AS paragraph_text FROM p""")
def q_line_paragraphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("replace(text, chr(10), concat(chr(10), ' ', chr(10)))").alias("full_text"))
    return extract.segment_paragraphs(d)


@query(f"""WITH RECURSIVE {SENTENCES}, ss AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sentence AS s, len(regexp_extract_all(sentence, '{_SIGNS}')) AS k FROM sent WHERE sentence <> ''),
pack(doc_id, i, chunk, n) AS (SELECT doc_id, i, 0, k FROM ss WHERE i = 1 UNION ALL SELECT ss.doc_id, ss.i, CASE WHEN n + k > 100 THEN chunk + 1 ELSE chunk END, CASE WHEN n + k > 100 THEN k ELSE n + k END FROM pack JOIN ss ON ss.doc_id = pack.doc_id AND ss.i = pack.i + 1)
SELECT doc_id, chunk::INTEGER AS paragraph_index, string_agg(s, ' ' ORDER BY i) AS paragraph_text FROM pack JOIN ss USING (doc_id, i) GROUP BY ALL""")
def q_token_chunks(spark, sf_dir):
    return extract.chunk_paragraphs(documents(spark, sf_dir).select("doc_id", F.col("text").alias("full_text")), max_tokens=100)


_FILE = "CASE WHEN doc_id % 10 = 9 THEN 'notes-' || doc_id ELSE 'amazing_stories-' || (doc_id % 7 + 1) || '.' || (doc_id % 12 + 1) || '(' || (1926 + doc_id % 7) || '.' || (doc_id % 12 + 1) || ').html' END"


@query("SELECT doc_id, (1 + doc_id % 7)::INTEGER AS volume, (1 + doc_id % 12)::INTEGER AS issue, (1926 + doc_id % 7)::INTEGER AS year, (1 + doc_id % 12)::INTEGER AS month FROM documents WHERE doc_id % 10 <> 9")
def q_file_entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_FILE).alias("path"))
    return extract.file_entries(d).select("doc_id", "volume", "issue", "year", "month")


@query("SELECT doc_id, sha256(text) AS raw_hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id % 10, doc_id % 12, doc_id) = 1")
def q_file_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("doc_id % 10").alias("year"), F.expr("doc_id % 12").alias("month"))
    return extract.dedup_by_content(d, "text", ["year", "month", "doc_id"]).select("doc_id", "raw_hash")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY 1926 + doc_id % 10, 1 + doc_id % 12, doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= floor(n * 0.65::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM r""")
def q_time_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("1926 + doc_id % 10").alias("publication_year"), F.expr("1 + doc_id % 12").alias("publication_month"))
    return splits.time_split(d, order=["doc_id"]).select("doc_id", "split")


@query("SELECT doc_id, row_number() OVER (ORDER BY 1926 + doc_id % 10, 1 + doc_id % 12, doc_id) AS rank FROM documents")
def q_global_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("1926 + doc_id % 10").alias("y"), F.expr("1 + doc_id % 12").alias("m"))
    return splits.global_rank(d, ["y", "m"], ["doc_id"]).select("doc_id", "rank")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) <= 10")
def q_author_cap(spark, sf_dir):
    return splits.cap_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 10, "doc_id")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN 'Unknown' ELSE 'A' END AS author FROM documents")
def q_first_author(spark, sf_dir):
    authors = F.expr("case doc_id % 3 when 0 then array(source, 'x') when 1 then cast(array() as array<string>) else array('A') end")
    return table(spark, sf_dir, "documents").select("doc_id", T.first_author(authors).alias("author"))


@query(f"WITH {EN}, f AS (SELECT len(regexp_extract_all(text, '{_SIGNS}')) AS n FROM en ORDER BY doc_id LIMIT 100) SELECT round(avg(n), 6) AS avg_tokens FROM f")
def q_avg_tokens(spark, sf_dir):
    first = documents(spark, sf_dir).orderBy("doc_id").limit(100)
    return first.agg(F.round(F.avg(T.token_count(F.col("text"))), 6).alias("avg_tokens"))


# --- topics -----------------------------------------------------------------------


@query(f"""WITH {TOKENS}, g AS (SELECT doc_id, unnest(cs) AS term FROM tok UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(cs)), lambda i: cs[i] || ' ' || cs[i + 1])) FROM tok
UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(cs) - 1), lambda i: cs[i] || ' ' || cs[i + 1] || ' ' || cs[i + 2])) FROM tok)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM g GROUP BY term HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) <= 0.95::DOUBLE * (SELECT count(*) FROM tok) ORDER BY tf DESC, term LIMIT 1000""")
def q_ngram_vocabulary(spark, sf_dir):
    return topics.term_vocabulary(topic_docs(spark, sf_dir), stop_words=T.stopwords(), max_features=1000)


@query(f"WITH {KEYWORDS} SELECT topic_id, rank, word, score FROM kw")
def q_ctfidf_keywords(spark, sf_dir):
    return keywords(spark, sf_dir)


@query(f"WITH {KEYWORDS} SELECT topic_id, string_agg(word, ',' ORDER BY rank) AS words FROM kw GROUP BY 1")
def q_keyword_map(spark, sf_dir):
    one = topics.keyword_map(keywords(spark, sf_dir))
    text = one.select(F.to_json("topic_keywords").alias("j"))
    return text.select(F.explode(topics.keywords_from_json(F.col("j"))).alias("topic_id", "w")).select("topic_id", F.array_join("w", ",").alias("words"))


@query(f"WITH {ASSIGN} SELECT topic_id, n FROM sizes")
def q_topic_sizes(spark, sf_dir):
    return topics.topic_sizes(assignments(spark, sf_dir))


@query(f"WITH {ASSIGN} SELECT count_if(topic_id <> -1)::BIGINT AS n_topics, round(sum(CASE WHEN topic_id = -1 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS noise_ratio, round(max(n) / min(n), 6) AS size_ratio, round(stddev_pop(n), 6) AS size_std FROM sizes")
def q_topic_metrics(spark, sf_dir):
    return topics.topic_metrics(assignments(spark, sf_dir))


@query(f"WITH {ASSIGN} SELECT (SELECT topic_id FROM sizes ORDER BY n DESC, topic_id LIMIT 1) AS largest, (SELECT topic_id FROM sizes ORDER BY n, topic_id LIMIT 1) AS smallest, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std FROM sizes")
def q_topic_size_stats(spark, sf_dir):
    return topics.topic_size_stats(topics.topic_sizes(assignments(spark, sf_dir)))


@query(f"WITH {ASSIGN}, e AS (SELECT min(n) AS lo, max(n) AS hi FROM sizes) SELECT least(floor((n - lo) / ((hi - lo) / 10::DOUBLE))::INTEGER, 9) AS bin, count(*) AS topics FROM sizes, e GROUP BY 1")
def q_size_histogram(spark, sf_dir):
    return topics.size_histogram(topics.topic_sizes(assignments(spark, sf_dir)))


@query(f"WITH {ASSIGN} (SELECT 'lowest' AS kind, topic_id, n FROM sizes ORDER BY topic_id LIMIT 5) UNION ALL (SELECT 'largest', topic_id, n FROM sizes ORDER BY n DESC, topic_id LIMIT 5)")
def q_first_topics(spark, sf_dir):
    s = topics.topic_sizes(assignments(spark, sf_dir))
    named = lambda k, df: df.select(F.lit(k).alias("kind"), "topic_id", "n")
    return named("lowest", topics.first_topics(s, compat=True)).unionByName(named("largest", topics.first_topics(s)))


@query(f"WITH {KEYWORDS} SELECT round(count(DISTINCT word) / (5 * count(DISTINCT topic_id))::DOUBLE, 6) AS diversity FROM kw WHERE rank <= 5")
def q_topic_diversity(spark, sf_dir):
    return topics.topic_diversity(keywords(spark, sf_dir), 5)


@query(f"WITH {KEYWORDS}, c AS (SELECT topic_id, count(*) AS count FROM tok GROUP BY 1) SELECT topic_id, count, topic_id || '_' || w AS name FROM (SELECT topic_id, string_agg(word, '_' ORDER BY rank) AS w FROM kw WHERE rank <= 4 GROUP BY 1) JOIN c USING (topic_id)")
def q_topic_info(spark, sf_dir):
    return topics.topic_info(topic_docs(spark, sf_dir), keywords(spark, sf_dir))


@query(f"""WITH {ASSIGN}, p AS (SELECT topic_id AS topic, unnest(range(32))::INTEGER AS pair, embedding FROM asg WHERE topic_id <> -1)
SELECT topic, pair, round(avg(embedding[2 * pair + 1]::DOUBLE), 6) AS cx, round(avg(embedding[2 * pair + 2]::DOUBLE), 6) AS cy, count(*) AS n FROM p GROUP BY 1, 2""")
def q_centroids(spark, sf_dir):
    """The centroids of the points that any two neighbouring components make."""
    points = assignments(spark, sf_dir).select("topic_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("x"), F.get("embedding", 2 * i + 1).cast("double").alias("y")))).alias("pair", "p"))
    named = points.filter("topic_id <> -1").select(F.struct("topic_id", "pair").alias("topic"), "p.x", "p.y")
    parts = named.groupBy("topic").agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"), F.count("*").alias("n"))
    return parts.select(F.col("topic.topic_id").alias("topic"), F.col("topic.pair").alias("pair"), "cx", "cy", "n")


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS topic_id, round(list_max(embedding)::DOUBLE, 6) AS probability FROM embeddings")
def q_argmax_topics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", topics.argmax_topic(F.col("embedding")).alias("topic_id"), F.round(topics.document_probability(F.col("embedding")).cast("double"), 6).alias("probability"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.alias("a").join(e.alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select("a.vec_id", F.round(topics.cosine(F.col("a.embedding"), F.col("b.embedding")), 5).alias("sim"))


@query(f"""WITH {KEYWORDS}, c AS (SELECT label::INTEGER AS topic_id, list(v ORDER BY i) AS t FROM (SELECT label, i, avg(x) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1),
gr AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(ws) AS word FROM tok UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM tok) WHERE word IN (SELECT word FROM kw)),
wv AS (SELECT word, list(v ORDER BY i) AS v FROM (SELECT word, i, avg(x) AS v FROM (SELECT word, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM gr JOIN embeddings e ON e.vec_id = gr.doc_id) GROUP BY ALL) GROUP BY 1),
s AS (SELECT topic_id, word, round(list_cosine_similarity(v, t), 6) AS score FROM kw JOIN wv USING (word) JOIN c USING (topic_id))
SELECT topic_id, (row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, word))::INTEGER AS rank, word, score FROM s""")
def q_keyword_rerank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("int").alias("topic_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    words = keywords(spark, sf_dir)
    docs = topic_docs(spark, sf_dir).select("doc_id", "tokens").join(e.select("doc_id", "embedding"), "doc_id")
    return topics.rerank_keywords(words, topics.word_vectors(docs, words), topics.centroid_vectors(e, "topic_id", "embedding"), 10)


@query(f"""WITH {KEYWORDS}, w5 AS (SELECT topic_id, word FROM kw WHERE rank <= 10 AND NOT contains(word, ' ')), n AS (SELECT count(*) AS n FROM tok), o AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(ws) AS word FROM tok) WHERE word IN (SELECT word FROM w5)),
df AS (SELECT word, count(*) AS d FROM o GROUP BY 1), co AS (SELECT a.word AS w1, b.word AS w2, count(*) AS c FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY 1, 2),
p AS (SELECT a.topic_id, a.word AS w1, b.word AS w2 FROM w5 a JOIN w5 b ON a.topic_id = b.topic_id AND a.word < b.word)
SELECT p.topic_id, round(avg(CASE WHEN c IS NULL THEN -1 WHEN c = n THEN 1 ELSE ln((c / n::DOUBLE) / ((x.d / n::DOUBLE) * (y.d / n::DOUBLE))) / -ln(c / n::DOUBLE) END), 6) AS npmi
FROM p LEFT JOIN co USING (w1, w2) JOIN df x ON x.word = p.w1 JOIN df y ON y.word = p.w2, n GROUP BY 1""")
def q_npmi_coherence(spark, sf_dir):
    return topics.npmi_coherence(topic_docs(spark, sf_dir), keywords(spark, sf_dir).filter("not contains(word, ' ')"))


@query(f"""WITH {KEYWORDS}, kv AS (SELECT topic_id, word FROM kw WHERE NOT contains(word, ' ')), ds AS (SELECT doc_id, ws, greatest(len(ws) - 109, 1) AS m FROM tok), tn AS (SELECT sum(m)::DOUBLE AS n FROM ds),
ox AS (SELECT doc_id, m, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM ds), oc AS (SELECT * FROM ox WHERE word IN (SELECT word FROM kv)),
wn AS (SELECT DISTINCT doc_id, word, unnest(range(greatest(1, pos - 109), least(pos, m) + 1)) AS i FROM oc),
co AS (SELECT x.word AS a, y.word AS b, count(*) AS c FROM wn x JOIN wn y ON x.doc_id = y.doc_id AND x.i = y.i GROUP BY 1, 2), si AS (SELECT a, c AS ca FROM co WHERE a = b),
pa AS (SELECT x.topic_id, x.word AS a, y.word AS b FROM kv x JOIN kv y ON x.topic_id = y.topic_id),
ra AS (SELECT pa.topic_id, pa.a, pa.b, coalesce(co.c, 0) / n AS p, sa.ca / n AS pa, sb.ca / n AS pb FROM pa LEFT JOIN co ON co.a = pa.a AND co.b = pa.b JOIN si sa ON sa.a = pa.a JOIN si sb ON sb.a = pa.b, tn),
ve AS (SELECT topic_id, a, b, ln((p + 1e-12::DOUBLE) / (pa * pb)) / -ln(p + 1e-12::DOUBLE) AS v FROM ra), su AS (SELECT topic_id, b, sum(v) AS s FROM ve GROUP BY 1, 2),
ea AS (SELECT topic_id, a, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))) AS m FROM ve JOIN su USING (topic_id, b) GROUP BY 1, 2)
SELECT topic_id, round(avg(m), 6) AS c_v FROM ea GROUP BY 1""")
def q_c_v_coherence(spark, sf_dir):
    return topics.c_v_coherence(topic_docs(spark, sf_dir), keywords(spark, sf_dir).filter("not contains(word, ' ')"))


@query("""WITH c AS (SELECT label::INTEGER AS topic_id, list(v ORDER BY i) AS t FROM (SELECT label, i, avg(x) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1),
n AS (SELECT e.vec_id, e.embedding, c.topic_id FROM embeddings e, c QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], c.t), c.topic_id) = 1),
m AS (SELECT topic_id, i, avg(x) AS v FROM (SELECT topic_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM n) GROUP BY ALL)
SELECT topic_id, i::INTEGER AS i, round(v, 6) AS v, k.n FROM m JOIN (SELECT topic_id, count(*) AS n FROM n GROUP BY 1) k USING (topic_id)""")
def q_lloyd_step(spark, sf_dir):
    """One step of k-means from the labels' means."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("topic_id"), F.col("embedding").cast("array<double>").alias("vector"))
    own, centres = topics.lloyd_step(e, topics.centroid_vectors(e, "topic_id", "vector"), "vector")
    return centres.select("topic_id", F.posexplode("vector").alias("i", "v")).join(topics.topic_sizes(own), "topic_id").select("topic_id", "i", F.round("v", 6).alias("v"), "n")


@query()
def q_kmeans(spark, sf_dir):
    return topics.cluster(table(spark, sf_dir, "embeddings"), "embedding", clusterer="kmeans", k=10).select("vec_id", "topic_id", "probability")


@query()
def q_density_clusters(spark, sf_dir):
    return topics.cluster(table(spark, sf_dir, "embeddings"), "embedding", clusterer="density", min_cluster_size=5, min_samples=4).select("vec_id", "topic_id", "probability")


@query()
def q_gaussian_mixture(spark, sf_dir):
    small = topics.reduce_dimensions(table(spark, sf_dir, "embeddings"), "embedding", 5)
    return topics.cluster(small, "reduced", clusterer="gmm", k=5).select("vec_id", "topic_id", "probability")


@query(f"WITH {ASSIGN}, top AS (SELECT topic_id FROM sizes WHERE topic_id <> -1 ORDER BY n DESC, topic_id LIMIT 5) SELECT vec_id, topic_id, topic_id IN (SELECT topic_id FROM top) AS member FROM asg")
def q_top_members(spark, sf_dir):
    given = assignments(spark, sf_dir).select("vec_id", "topic_id")
    top = topics.first_topics(topics.topic_sizes(given.filter("topic_id <> -1")))
    return topics.topic_members(given, top).withColumn("member", F.lit(True)).unionByName(topics.topic_members(given, top, member=False).withColumn("member", F.lit(False)))


@query()
def q_vis_points(spark, sf_dir):
    given = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("topic_id"), "embedding", F.lit(1.0).alias("probability"))
    return topics.vis_points(given, "embedding")


@query()
def q_embed(spark, sf_dir):
    return providers.hashing_embedder(topic_docs(spark, sf_dir)).select("doc_id", "embedding")


def _exact(x: str, digits: int) -> str:
    """Rounding as ``text.round_half_even`` does it."""
    big, scale = f"(({x}) * 134217729::DOUBLE)", f"{10**digits}::DOUBLE"
    high, whole = f"({big} - ({big} - ({x})))", f"floor(({x}) * {scale})"
    beyond = f"(({high} * {scale} - {whole} - 0.5::DOUBLE) + (({x}) - {high}) * {scale})"
    return f"(({whole} + CASE WHEN {beyond} > 0 THEN 1 WHEN {beyond} < 0 THEN 0 ELSE {whole} % 2 END) / {scale})"


# --- masking and pairs ---------------------------------------------------------------

MATCHES = f"""{KEYWORDS}, pc AS (SELECT doc_id, topic_id, text, regexp_extract_all(text, '{_SIGNS}|\\s+') AS ps FROM tok),
po AS (SELECT doc_id, topic_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM pc),
pe AS (SELECT *, (sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i))::INTEGER AS e FROM po),
tk AS (SELECT doc_id, topic_id, lower(p) AS p, e - length(p) AS s, e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM pe WHERE NOT regexp_matches(p, '^\\s')),
wn AS (SELECT doc_id, topic_id, p AS phrase, s, e FROM tk UNION ALL SELECT a.doc_id, a.topic_id, a.p || ' ' || b.p, a.s, b.e FROM tk a JOIN tk b ON b.doc_id = a.doc_id AND b.k = a.k + 1),
mt AS (SELECT DISTINCT wn.doc_id, wn.topic_id, s::INTEGER AS s, e::INTEGER AS e FROM wn JOIN kw ON kw.topic_id = wn.topic_id AND kw.word = wn.phrase)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.match_phrases(topic_docs(spark, sf_dir), keywords(spark, sf_dir), id_col="doc_id", text_col="text", lengths=(1, 2))


@query(f'WITH {MATCHES} SELECT mt.doc_id, mt.topic_id, s AS start, e AS "end", substr(tok.text, s + 1, e - s) AS text FROM mt JOIN tok ON tok.doc_id = mt.doc_id')
def q_phrase_match(spark, sf_dir):
    return matches(spark, sf_dir)


#: Single-word keywords can't overlap, so SQL needs no greedy choice for them.
ONE_WORD = MATCHES.replace("kw.word = wn.phrase)", "kw.word = wn.phrase AND NOT contains(kw.word, ' '))")


def masked(spark: SparkSession, sf_dir: str, variants: int = 6, given: DataFrame | None = None) -> DataFrame:
    rows = topic_docs(spark, sf_dir).select("doc_id", "topic_id", F.col("text").alias("paragraph_text"))
    words = (keywords(spark, sf_dir) if given is None else given).filter("not contains(word, ' ')")
    found = masking.collect_spans(masking.match_phrases(rows, words, id_col="doc_id", lengths=(1,)), "doc_id")
    spans = found.select("doc_id", masking.choose_spans(F.col("spans")).alias("spans"))
    return masking.mask_variants(rows.join(spans, "doc_id", "left"), id_col="doc_id", variants=variants)


VARIANTS = f"""{ONE_WORD}, cn AS (SELECT tok.doc_id, tok.topic_id, tok.text, count(mt.s) AS ns FROM tok LEFT JOIN mt ON mt.doc_id = tok.doc_id GROUP BY tok.doc_id, tok.topic_id, tok.text),
cnt AS (SELECT *, least(greatest(1, round(sqrt(len(regexp_extract_all(text, '\\S+'))))::INTEGER), ns) AS most FROM cn),
vr AS (SELECT doc_id, topic_id, text, v.v::INTEGER AS variant_no, ns, 1 + ('0x' || substr(md5('42|' || doc_id || '|' || v.v || '|k'), 1, 8))::BIGINT % greatest(most, 1) AS k FROM cnt, range(1, 7) v(v) WHERE ns > 0 OR v.v = 1),
ch AS (SELECT vr.doc_id, vr.variant_no, mt.s, mt.e FROM vr JOIN mt ON mt.doc_id = vr.doc_id QUALIFY row_number() OVER (PARTITION BY vr.doc_id, vr.variant_no ORDER BY md5('42|' || vr.doc_id || '|' || vr.variant_no || '|' || mt.s)) <= vr.k),
gp AS (SELECT doc_id, variant_no, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id, variant_no ORDER BY s), 0) AS b FROM ch),
mx AS (SELECT gp.doc_id, gp.variant_no, string_agg(substr(vr.text, b + 1, s - b) || '<mask>', '' ORDER BY s) AS h, max(e) AS e, count(*) AS n FROM gp JOIN vr USING (doc_id, variant_no) GROUP BY ALL),
vm AS (SELECT vr.doc_id, vr.topic_id, vr.variant_no, vr.text, coalesce(n, 0)::INTEGER AS n_masks, CASE WHEN n IS NULL THEN text ELSE replace(h || substr(text, e + 1), '<mask> <mask>', '<mask>') END AS masked_text FROM vr LEFT JOIN mx USING (doc_id, variant_no))"""


@query(f"WITH {VARIANTS} SELECT doc_id, variant_no, n_masks, masked_text, md5('42' || chr(1) || doc_id || chr(1) || variant_no) AS variant_id FROM vm")
def q_mask_variants(spark, sf_dir):
    return masked(spark, sf_dir).select("doc_id", "variant_no", F.size("masked_tokens").alias("n_masks"), "masked_text", "variant_id")


@query(f"WITH {VARIANTS} SELECT count(DISTINCT CASE WHEN n_masks > 0 THEN doc_id END) AS paragraphs_processed, count(*) AS variants, {_exact('sum(n_masks)::DOUBLE / count(*)', 2)} AS avg_masks FROM vm")
def q_masking_report(spark, sf_dir):
    return masking.masking_report(masked(spark, sf_dir), "doc_id")


def _greedy_sql(clash: str) -> str:
    """The longest spans first, each kept if it meets none kept before."""
    return f"len(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {clash})) > 0 THEN acc ELSE list_concat(acc, x) END))"


@query(f"""WITH {MATCHES}, sl AS (SELECT doc_id, topic_id, list({{'s': s, 'e': e}} ORDER BY e - s DESC, s) AS l FROM mt GROUP BY 1, 2)
SELECT doc_id, topic_id, len(l)::INTEGER AS n, ({_greedy_sql('k.s < x[1].e AND x[1].s < k.e')})::INTEGER AS strict, ({_greedy_sql('(x[1].s < k.s AND k.s < x[1].e) OR (x[1].s < k.e AND k.e < x[1].e)')})::INTEGER AS compat FROM sl""")
def q_spans(spark, sf_dir):
    found = masking.collect_spans(matches(spark, sf_dir), "doc_id")
    return found.select("doc_id", "topic_id", F.size("spans").alias("n"), F.size(masking.choose_spans(F.col("spans"))).alias("strict"), F.size(masking.choose_spans(F.col("spans"), compat=True)).alias("compat"))


def _split_sql(x: str) -> str:
    return f"string_split(regexp_replace({STRIP.format(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


PAIRED = f"""{VARIANTS}, zz AS (SELECT doc_id, topic_id, variant_no, {_split_sql('text')} AS a, {_split_sql('masked_text')} AS b FROM vm),
zi AS (SELECT doc_id, topic_id, variant_no, unnest(range(1, least(len(a), len(b)) + 1)) AS i, a, b FROM zz),
zs AS (SELECT doc_id, topic_id, variant_no, i, {STRIP.format('a[i]')} AS original, {STRIP.format('b[i]')} AS masked FROM zi WHERE contains(b[i], '<mask>')),
zt AS (SELECT *, len(regexp_extract_all(original, '{_SIGNS}')) AS length, regexp_extract_all(masked, '\\S+') AS mw FROM zs),
zr AS (SELECT *, len(list_filter(mw, lambda w: w = '<mask>')) / len(mw)::DOUBLE AS r FROM zt),
pr AS (SELECT md5(original || chr(1) || masked) AS pair_id, topic_id, original, masked, {_exact('r', 3)} AS mask_ratio, length::INTEGER AS length, len(list_filter(mw, lambda w: w = '<mask>')) AS nm FROM zr
  WHERE length >= 4 AND r BETWEEN 0.05::DOUBLE AND 0.4::DOUBLE AND NOT regexp_matches(original, '(?i)^(CHAPTER|BOOK|PART|SECTION|THE END|END)\\b[\\s\\W\\d]*$')
    AND NOT (len(regexp_extract_all(original, '\\S+')) <= 6 AND upper(original) = original AND lower(original) <> original)
    AND len(list_intersect(regexp_extract_all(lower(original), '[\\p{{L}}\\p{{N}}]+'), {_VERBS})) > 0
    AND (topic_id NOT IN (SELECT topic_id FROM kw) OR EXISTS (SELECT 1 FROM kw WHERE kw.topic_id = zr.topic_id AND list_contains(regexp_extract_all(lower(original), '{_SIGNS}'), kw.word)))
  QUALIFY row_number() OVER (PARTITION BY original, masked ORDER BY doc_id, variant_no, i) = 1)"""


def masked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = keywords(spark, sf_dir)
    return pairs.sentence_pairs(masked(spark, sf_dir, given=words), words, order=["doc_id", "variant_no"])


@query(f"WITH {PAIRED} SELECT pair_id, topic_id, original, masked, mask_ratio, length FROM pr")
def q_sentence_pairs(spark, sf_dir):
    return masked_pairs(spark, sf_dir)


@query(f"WITH {PAIRED} SELECT count(*) AS total_pairs, {_exact('sum(length)::DOUBLE / count(*)', 2)} AS avg_len, {_exact('sum(nm)::DOUBLE / sum(length)', 3)} AS avg_mask_ratio, 0::BIGINT AS unique_pairs_removed FROM pr")
def q_pair_stats(spark, sf_dir):
    return pairs.pair_stats(masked_pairs(spark, sf_dir))


# --- infilling ----------------------------------------------------------------------

BIGRAMS = f"""{SENTENCES}, bt AS (SELECT list_concat(['<s>'], regexp_extract_all(lower(sentence), '\\S+')) AS t FROM sent WHERE regexp_matches(sentence, '\\S')),
bg AS (SELECT t[i] AS prev, t[i + 1] AS token FROM (SELECT t, unnest(range(1, len(t))) AS i FROM bt)), bc AS (SELECT prev, token, count(*) AS c FROM bg GROUP BY ALL),
lm AS (SELECT prev, token, c::DOUBLE AS c, c / (sum(c) OVER (PARTITION BY prev))::DOUBLE AS p, row_number() OVER (PARTITION BY prev ORDER BY c DESC, token) AS r FROM bc)"""
DRAW = "('0x' || substr(md5('7|' || prev), 1, 8))::BIGINT / 4294967296::DOUBLE"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).filter(F.col("sentence").rlike(r"\S"))


def _draws(spark: SparkSession, sf_dir: str, strategy: str, **params) -> DataFrame:
    left = infill.distribution(infill.bigram_model(_texts(spark, sf_dir)), strategy, **params)
    u = T.hash_unit(F.lit("7"), F.col("prev"))
    return left.filter((F.col("lo") <= u) & (u < F.col("hi"))).select("prev", "token", F.round("p", 6).alias("p"))


def _cut_sql(weight: str = "c", best: str = "true", nucleus: str = "true", model: str = "lm") -> str:
    """What is left of each word's candidates, with the running sums of their shares."""
    before = "coalesce(sum(w) OVER (PARTITION BY prev ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"""w AS (SELECT prev, token, r, {weight} AS w FROM {model} WHERE {best}), ru AS (SELECT *, {before} / sum(w) OVER (PARTITION BY prev) AS cum FROM w), kp AS (SELECT * FROM ru WHERE {nucleus}),
fc AS (SELECT *, w / sum(w) OVER (PARTITION BY prev) AS f, ({before} + w) / sum(w) OVER (PARTITION BY prev) AS fcum, max(r) OVER (PARTITION BY prev) AS last FROM kp)"""


def _drawn_sql(*cuts: str) -> str:
    """The first candidate whose running sum passes the draw."""
    return f"""WITH {BIGRAMS}, {_cut_sql(*cuts)}
SELECT prev, token, round(f, 6) AS p FROM fc WHERE fcum > {DRAW} OR r = last QUALIFY row_number() OVER (PARTITION BY prev ORDER BY r) = 1"""


@query(f"WITH {BIGRAMS} SELECT prev, r::INTEGER AS rank, token, round(p, 6) AS p FROM lm")
def q_bigram_model(spark, sf_dir):
    return infill.distribution(infill.bigram_model(_texts(spark, sf_dir)), "temperature").select("prev", "rank", "token", F.round("p", 6).alias("p"))


@query(f"WITH {BIGRAMS} SELECT prev, token, round(p, 6) AS p FROM lm WHERE r = 1")
def q_fill_greedy(spark, sf_dir):
    return _draws(spark, sf_dir, "greedy")


@query(_drawn_sql("c", "r <= 5"))
def q_fill_top_k(spark, sf_dir):
    return _draws(spark, sf_dir, "top_k", top_k=5)


@query(_drawn_sql("c", "true", "cum < 0.7::DOUBLE - 1e-12::DOUBLE"))
def q_fill_top_p(spark, sf_dir):
    return _draws(spark, sf_dir, "top_p", top_p=0.7)


@query(_drawn_sql("pow(c, 1.25::DOUBLE)", "r <= 8", "cum < 0.7::DOUBLE - 1e-12::DOUBLE"))
def q_fill_top_k_top_p(spark, sf_dir):
    return _draws(spark, sf_dir, "top_k_top_p", top_k=8, top_p=0.7, temperature=0.8)


@query(_drawn_sql("pow(c, 2)"))
def q_fill_temperature(spark, sf_dir):
    return _draws(spark, sf_dir, "temperature", temperature=0.5)


_JACCARD = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))::DOUBLE ELSE 0 END"
_DOT = "list_sum(list_transform(list_distinct({0}), lambda w: len(list_filter({0}, lambda v: v = w)) * len(list_filter({1}, lambda v: v = w))))"
_COSINE = f"CASE WHEN len({{0}}) > 0 AND len({{1}}) > 0 THEN {_DOT} / (sqrt({_DOT.replace('{1}', '{0}')}::DOUBLE) * sqrt({_DOT.replace('{0}', '{1}')}::DOUBLE)) ELSE 0 END"


def _scores(a: Column, b: Column) -> dict[str, Column]:
    """Semantic, lexical and structural similarity, and what they make together."""
    parts = {"sim_score": infill.text_cosine(a, b), "jaccard": infill.token_jaccard(a, b), "len_ratio": infill.length_ratio(a, b)}
    return parts | {"hybrid_score": infill.hybrid_score(*parts.values())}


# (The pairs, then each mask's draw from its word's five best, or from those of all words where the one before is unknown.)
INFILL = f"""{PAIRED}, {BIGRAMS.removeprefix(EN + ', ')}, uni AS (SELECT token, count(*) AS c FROM (SELECT unnest(t[2:]) AS token FROM bt) GROUP BY 1),
both_ AS (SELECT prev, token, c, r FROM lm UNION ALL SELECT chr(1), token, c::DOUBLE, row_number() OVER (ORDER BY c DESC, token) FROM uni), {_cut_sql("c", "r <= 5", "true", "both_")},
tl AS (SELECT pair_id, list_concat(['<s>'], regexp_extract_all(masked, '\\S+')) AS t FROM pr), tt AS (SELECT pair_id, unnest(range(len(t))) AS i, unnest(t) AS token FROM tl),
ho AS (SELECT pair_id, i, lower(t[i]) AS prev, ('0x' || substr(md5('42|' || pair_id || '|' || i), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM (SELECT pair_id, t, unnest(range(1, len(t))) AS i FROM tl) WHERE t[i + 1] = '<mask>'),
hk AS (SELECT pair_id, i, u, CASE WHEN prev IN (SELECT prev FROM lm) THEN prev ELSE chr(1) END AS prev FROM ho),
hc AS (SELECT pair_id, i, token, f FROM hk JOIN fc USING (prev) WHERE fcum > u OR r = last QUALIFY row_number() OVER (PARTITION BY pair_id, i ORDER BY r) = 1),
fl AS (SELECT pair_id, string_agg(coalesce(hc.token, tt.token), ' ' ORDER BY i) AS infilled, round(avg(ln(f)), 6) AS infill_score FROM tt LEFT JOIN hc USING (pair_id, i) WHERE i > 0 GROUP BY 1),
fs AS (SELECT pair_id, infilled, infill_score, regexp_extract_all(lower(original), '\\S+') AS a, regexp_extract_all(lower(infilled), '\\S+') AS b FROM fl JOIN pr USING (pair_id)),
sc2 AS (SELECT pair_id, infilled, infill_score, {_COSINE.format('a', 'b')} AS sim, {_JACCARD.format('a', 'b')} AS jac, least(len(a), len(b)) / greatest(len(a), len(b))::DOUBLE AS rat FROM fs)"""


@query(f"WITH {INFILL} SELECT pair_id, infilled, infill_score, round(sim, 6) AS sim_score, round(0.5::DOUBLE * sim + 0.3::DOUBLE * jac + 0.2::DOUBLE * rat, 6) AS hybrid_score, 'top_k' AS sampling_strategy FROM sc2")
def q_infill(spark, sf_dir):
    text = _texts(spark, sf_dir)
    out = infill.fill_masks(masked_pairs(spark, sf_dir), infill.bigram_model(text), infill.unigram_model(text), strategy="top_k", top_k=5)
    parts = _scores(F.col("original"), F.col("infilled"))
    return out.select("pair_id", "infilled", "infill_score", *[F.round(parts[n], 6).alias(n) for n in ("sim_score", "hybrid_score")], "sampling_strategy")


@query(f"""WITH {SENTENCES}, x AS (SELECT a.sentence_id, regexp_extract_all(lower(a.sentence), '\\S+') AS s, regexp_extract_all(lower(b.sentence), '\\S+') AS t FROM sent a JOIN sent b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1),
y AS (SELECT sentence_id, {_COSINE.format('s', 't')} AS sim, {_JACCARD.format('s', 't')} AS jac, CASE WHEN greatest(len(s), len(t)) > 0 THEN least(len(s), len(t)) / greatest(len(s), len(t))::DOUBLE ELSE 0 END AS rat FROM x)
SELECT sentence_id, round(sim, 6) AS sim_score, round(jac, 6) AS jaccard, round(rat, 6) AS len_ratio, round(0.5::DOUBLE * sim + 0.3::DOUBLE * jac + 0.2::DOUBLE * rat, 6) AS hybrid_score FROM y""")
def q_hybrid_score(spark, sf_dir):
    s = sentences(spark, sf_dir)
    x = s.alias("a").join(s.alias("b"), F.expr("b.doc_id = a.doc_id and b.pos = a.pos + 1")).select("a.sentence_id", F.col("a.sentence").alias("s"), F.col("b.sentence").alias("t"))
    return x.select("sentence_id", *[F.round(c, 6).alias(n) for n, c in _scores(F.col("s"), F.col("t")).items()])


# --- probing -----------------------------------------------------------------------

_FLAG = "('0x' || substr(md5('42f|' || sentence_id), 1, 1))::INTEGER < 8"
_POS = "1 + ('0x' || substr(md5('42p|' || sentence_id), 1, 8))::BIGINT % {0}"


@query(f"""WITH {SENTENCES}, t AS (SELECT sentence_id, regexp_extract_all(sentence, '\\S+') AS t FROM sent), u AS (SELECT *, {_POS.format('(len(t) - 1)')} AS i FROM t WHERE len(t) >= 5)
SELECT sentence_id, CASE WHEN {_FLAG} THEN array_to_string(list_concat(t[1:i-1], [t[i+1], t[i]], t[i+2:]), ' ') ELSE array_to_string(t, ' ') END AS item, CASE WHEN {_FLAG} THEN 'I' ELSE 'O' END AS label FROM u""")
def q_probe_bigram_shift(spark, sf_dir):
    return probing.bigram_shift(sentences(spark, sf_dir))


@query(f"""WITH {SENTENCES}, w AS (SELECT sentence_id, sentence, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+')) AS w FROM sent), k AS (SELECT w, count(*) AS c FROM w GROUP BY 1 ORDER BY c DESC, w LIMIT 100), tg AS (SELECT w FROM k ORDER BY c, w DESC LIMIT 50)
SELECT sentence_id, sentence AS item, min(w.w) AS label FROM w JOIN tg ON tg.w = w.w GROUP BY 1, 2 HAVING count(*) = 1""")
def q_probe_word_contents(spark, sf_dir):
    return probing.word_contents(sentences(spark, sf_dir))


@query(f"""WITH {SENTENCES}, t AS (SELECT sentence_id, regexp_extract_all(sentence, '\\S+') AS t FROM sent), k AS (SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM t) GROUP BY 1),
sw AS (SELECT w, lead(w) OVER (PARTITION BY floor(log2(c)), substr(md5(w), 1, 2) ORDER BY w) AS other FROM k), u AS (SELECT *, {_POS.format('len(t)')} AS i FROM t WHERE len(t) >= 5), v AS (SELECT u.*, other FROM u LEFT JOIN sw ON sw.w = u.t[u.i])
SELECT sentence_id, CASE WHEN {_FLAG} AND other IS NOT NULL THEN array_to_string(list_concat(t[1:i-1], [other], t[i+1:]), ' ') ELSE array_to_string(t, ' ') END AS item, CASE WHEN {_FLAG} AND other IS NOT NULL THEN 'C' ELSE 'O' END AS label FROM v""")
def q_probe_odd_word(spark, sf_dir):
    return probing.odd_word_out(sentences(spark, sf_dir))


@query(f"""WITH {SENTENCES}, t AS (SELECT sentence_id, regexp_extract_all(sentence, '\\S+') AS t FROM sent), u AS (SELECT *, list_filter(range(1, len(t) + 1), lambda j: lower(t[j]) IN ('and', 'but', 'or')) AS k FROM t),
v AS (SELECT *, k[1] AS i FROM u WHERE len(k) = 1 AND k[1] > 1 AND k[1] < len(t))
SELECT sentence_id, CASE WHEN {_FLAG} THEN array_to_string(list_concat(t[i+1:], [t[i]], t[1:i-1]), ' ') ELSE array_to_string(t, ' ') END AS item, CASE WHEN {_FLAG} THEN 'I' ELSE 'O' END AS label FROM v""")
def q_probe_inversion(spark, sf_dir):
    return probing.coordinate_inversion(sentences(spark, sf_dir))


@query(f"""WITH {SENTENCES}, d AS (SELECT sentence_id, least(len(regexp_extract_all(sentence, '[,;:(]')) + 1, 7)::INTEGER AS label FROM sent), k AS (SELECT count(DISTINCT label) AS k FROM d)
SELECT sentence_id, label FROM d, k QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42|' || sentence_id), sentence_id) <= 1000 // k""")
def q_probe_depth_balanced(spark, sf_dir):
    return probing.balanced(probing.clause_depth(sentences(spark, sf_dir))).select("sentence_id", "label")


def _task_sql(name: str) -> str:
    return _SQL[f"q_probe_{name}"].partition("WITH")[2].strip()


_BALANCED = "SELECT '{1}' AS task, sentence_id, label FROM (SELECT sentence_id, label::VARCHAR AS label, count(*) OVER (PARTITION BY label) AS c FROM {0}), (SELECT count(DISTINCT label) AS k FROM {0}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42|' || sentence_id), sentence_id) <= 1000 // k"
_DEPTHS = f"WITH {SENTENCES} SELECT sentence_id, least(len(regexp_extract_all(sentence, '[,;:(]')) + 1, 7)::INTEGER AS label FROM sent"


@query("WITH " + ", ".join(f"t{i} AS (WITH {_task_sql(n)})" for i, n in enumerate(("bigram_shift", "word_contents", "odd_word", "inversion"))) + f", t4 AS ({_DEPTHS}) "
       + " UNION ALL ".join(f"({_BALANCED.format(f't{i}', n)})" for i, n in enumerate(("bigram_shift", "word_contents", "odd_word", "coordinate_inversion", "clause_depth"))))
def q_probe_balanced_sets(spark, sf_dir):
    return probing.balanced_sets(sentences(spark, sf_dir)).select("task", "sentence_id", "label")
