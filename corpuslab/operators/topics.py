"""Topic vocabulary, keywords, metrics and clustering."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.operators.graph import components
from corpuslab.operators.neighbours import matrix, neighbours, squared
from corpuslab.operators.splits import global_rank
from corpuslab.session import checkpoint

NOISE = -1


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array, in order."""
    return T.let(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>")))


def without_stopwords(tokens: Column, stop_words: Sequence[str]) -> Column:
    """The tokens that are no stop words; n-grams then reach over the gaps."""
    return F.filter(tokens, lambda t: ~t.isin(*stop_words)) if stop_words else tokens


def term_vocabulary(
    docs: DataFrame, tokens: str = "tokens", *, ngram_range: tuple[int, int] = (1, 3), stop_words: Sequence[str] = (), min_df: int = 3, max_df: float = 0.95, max_features: int = 10_000
) -> DataFrame:
    """``term, df, tf`` of the most frequent n-grams within the document frequency bounds, made of what are no stop words.

    A document's n-grams are sorted, so that each is marked where it stands
    first; one pass then counts both occurrences and documents.
    """
    total = docs.agg(F.count("*").alias("_n"))

    def marked(grams: Column) -> Column:
        before = lambda g: F.concat(F.array(F.lit(None).cast("string")), F.slice(g, F.lit(1), F.greatest(F.size(g) - 1, F.lit(0))))
        return T.let(F.array_sort(grams), lambda g: F.when(F.size(g) > 0, F.zip_with(g, before(g), lambda x, y: F.struct(x.alias("term"), F.when(x.eqNullSafe(y), 0).otherwise(1).alias("first")))))

    words = without_stopwords(F.col(tokens), stop_words)
    grams = T.let(words, lambda w: marked(F.flatten(F.array(*[ngrams(w, n) for n in range(ngram_range[0], ngram_range[1] + 1)]))))
    counts = docs.select(F.inline(grams)).groupBy("term").agg(F.sum("first").alias("df"), F.count("*").alias("tf"))
    kept = counts.join(F.broadcast(total)).filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * F.col("_n"))).drop("_n")
    return kept.orderBy(F.desc("tf"), "term").limit(max_features)


def class_tf_idf(terms: DataFrame, topic: str = "topic_id", word: str = "word") -> DataFrame:
    """``topic, word, tf, score``: tf in the topic times ``ln(1 + A / f)``, with f the word's count and A the words a topic."""
    tf = terms.groupBy(topic, word).agg(F.count("*").alias("tf"))
    f = tf.groupBy(word).agg(F.sum("tf").alias("_f"))
    a = tf.groupBy(topic).agg(F.sum("tf").alias("s")).agg(F.avg("s").alias("_a"))
    return tf.join(f, word).join(F.broadcast(a)).select(topic, word, "tf", (F.col("tf") * F.ln(1 + F.col("_a") / F.col("_f"))).alias("score"))


def top_keywords(scores: DataFrame, n: int = 50, topic: str = "topic_id", word: str = "word", score: str = "score", digits: int = 6) -> DataFrame:
    """``topic, rank, word, score`` of each topic's best words, noise left out; ties by word."""
    rounded = scores.filter(F.col(topic) != NOISE).withColumn(score, F.round(score, digits))
    w = Window.partitionBy(topic).orderBy(F.desc(score), word)
    return rounded.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(topic, "rank", word, score)


def keyword_map(keywords: DataFrame, topic: str = "topic_id", word: str = "word") -> DataFrame:
    """One row: a map from topic to its words in rank order."""
    lists = keywords.groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", word))), lambda x: x[word]).alias("w"))
    return lists.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(topic), F.col("w"))))).alias("topic_keywords"))


def keywords_from_json(text: Column) -> Column:
    """A JSON object of word lists as a map of topic ids to distinct small-lettered words."""
    raw = F.from_json(text, "map<string,array<string>>")
    return F.map_from_entries(F.transform(F.map_entries(raw), lambda e: F.struct(e["key"].cast("int").alias("key"), F.array_distinct(F.transform(e["value"], F.lower)).alias("value"))))


def cache_is_usable(keywords: DataFrame, topic: str = "topic_id", least: int = 30) -> bool:
    """Whether the first topic has enough words to keep cached keywords."""
    first = keywords.agg(F.min(topic)).first()[0]
    return first is not None and keywords.filter(F.col(topic) == first).limit(least).count() >= least


def topic_sizes(assignments: DataFrame, topic: str = "topic_id") -> DataFrame:
    return assignments.groupBy(topic).agg(F.count("*").alias("n"))


def topic_metrics(assignments: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Topics and noise: ``n_topics, noise_ratio, size_ratio, size_std`` (noise counts as a size)."""
    sizes = topic_sizes(assignments, topic)
    return sizes.agg(
        F.count_if(F.col(topic) != NOISE).alias("n_topics"),
        F.round(F.coalesce(F.sum(F.when(F.col(topic) == NOISE, F.col("n")).otherwise(0)) / F.sum("n"), F.lit(0.0)), 6).alias("noise_ratio"),
        F.round(F.coalesce(F.max("n") / F.min("n"), F.lit(0.0)), 6).alias("size_ratio"), F.round(F.coalesce(F.stddev_pop("n"), F.lit(0.0)), 6).alias("size_std"),
    )


def topic_diversity(keywords: DataFrame, k: int = 20, topic: str = "topic_id", word: str = "word") -> DataFrame:
    """Distinct words of the top-k lists by k times the topics."""
    top = keywords.filter(F.col("rank") <= k)
    return top.agg(F.round(F.coalesce(F.countDistinct(word) / (F.lit(k) * F.countDistinct(topic)), F.lit(0.0)), 6).alias("diversity"))


def topic_size_stats(sizes: DataFrame, topic: str = "topic_id") -> DataFrame:
    """The largest and smallest topic, mean and sample deviation of sizes (ties: the least id)."""
    return sizes.agg(
        F.min(F.struct((-F.col("n")).alias("k"), topic))[topic].alias("largest"), F.min(F.struct(F.col("n").alias("k"), topic))[topic].alias("smallest"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"),
    )


def size_histogram(sizes: DataFrame, bins: int = 10) -> DataFrame:
    """Topics in equal-width bins of their sizes; the last bin is closed."""
    ends = sizes.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / F.lit(bins), F.lit(1e-12))
    binned = sizes.join(F.broadcast(ends)).select(F.least(F.floor((F.col("n") - F.col("lo")) / width).cast("int"), F.lit(bins - 1)).alias("bin"))
    return binned.groupBy("bin").agg(F.count("*").alias("topics"))


def first_topics(sizes: DataFrame, k: int = 5, compat: bool = False, topic: str = "topic_id") -> DataFrame:
    """The k largest topics; ``compat`` gives the k lowest ids instead."""
    return sizes.orderBy(*([topic] if compat else [F.desc("n"), topic])).limit(k)


def topic_info(assignments: DataFrame, keywords: DataFrame, topic: str = "topic_id", word: str = "word") -> DataFrame:
    """``topic, count, name``: the name joins the id and the four best words."""
    names = keywords.filter("rank <= 4").groupBy(topic).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", word))), lambda x: x[word]), "_").alias("w"))
    return topic_sizes(assignments, topic).join(names, topic).select(topic, F.col("n").alias("count"), F.concat_ws("_", F.col(topic).cast("string"), "w").alias("name"))


def centroids(points: DataFrame, topic: str = "topic", x: str = "x", y: str = "y") -> DataFrame:
    return points.filter(F.col(topic) != NOISE).groupBy(topic).agg(F.round(F.avg(x), 6).alias("cx"), F.round(F.avg(y), 6).alias("cy"), F.count("*").alias("n"))


def argmax_topic(probs: Column) -> Column:
    """The position of the greatest probability, from 0; noise where there is none."""
    return F.coalesce((F.array_position(probs, F.array_max(probs)) - 1).cast("int"), F.lit(NOISE))


def document_probability(probs: Column) -> Column:
    return F.coalesce(F.array_max(probs), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def npmi_coherence(docs: DataFrame, keywords: DataFrame, *, tokens: str = "tokens", top: int = 10, topic: str = "topic_id", word: str = "word") -> DataFrame:
    """Mean NPMI of each topic's pairs of top words over documents (-1 for words that never meet)."""
    words = keywords.filter(F.col("rank") <= top).select(topic, word)
    n = docs.agg(F.count("*").alias("_n"))
    vocabulary = words.agg(F.collect_set(word).alias("_v"))
    sets = docs.join(F.broadcast(vocabulary)).select(F.array_sort(F.array_intersect(tokens, "_v")).alias("s"))
    df = sets.select(F.explode("s").alias(word)).groupBy(word).agg(F.count("*").alias("df"))
    pairs = words.alias("a").join(words.alias("b"), F.col(f"a.{topic}") == F.col(f"b.{topic}")).filter(F.col(f"a.{word}") < F.col(f"b.{word}")).select(F.col(f"a.{topic}").alias(topic), F.col(f"a.{word}").alias("w1"), F.col(f"b.{word}").alias("w2"))
    both = sets.select(F.explode("s").alias("w1"), "s").select("w1", F.explode(F.filter("s", lambda x: x > F.col("w1"))).alias("w2")).groupBy("w1", "w2").agg(F.count("*").alias("c"))
    rated = (
        pairs.join(both, ["w1", "w2"], "left").join(df.select(F.col(word).alias("w1"), F.col("df").alias("d1")), "w1").join(df.select(F.col(word).alias("w2"), F.col("df").alias("d2")), "w2").join(F.broadcast(n))
    )
    p, p1, p2 = (F.col(c) / F.col("_n") for c in ("c", "d1", "d2"))
    npmi = F.when(F.col("c").isNull(), -1.0).when(F.col("c") == F.col("_n"), 1.0).otherwise(F.ln(p / (p1 * p2)) / -F.ln(p))
    return rated.withColumn("_v", npmi).groupBy(topic).agg(F.round(F.avg("_v"), 6).alias("npmi"))


def c_v_coherence(docs: DataFrame, keywords: DataFrame, *, tokens: str = "tokens", top: int = 10, window: int = 110, topic: str = "topic_id", word: str = "word") -> DataFrame:
    """The c_v measure of each topic: cosines of the words' NPMI vectors with their sum, over sliding windows."""
    eps = 1e-12
    words = keywords.filter(F.col("rank") <= top).select(topic, word)
    vocabulary = words.agg(F.collect_set(word).alias("_v"))
    windows = T.let(F.col(tokens), lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (window - 1), F.lit(1))), lambda i: F.array_sort(F.array_intersect(F.slice(t, i, window), "_v"))))
    sets = docs.join(F.broadcast(vocabulary)).select(windows.alias("w"))
    total = sets.agg(F.sum(F.size("w")).alias("_n"))
    kept = sets.select(F.explode("w").alias("s")).filter(F.size("s") > 0).groupBy("s").agg(F.count("*").alias("c"))
    one = kept.select(F.explode("s").alias("a"), "s", "c")
    both = one.select("a", F.explode("s").alias("b"), "c").groupBy("a", "b").agg(F.sum("c").alias("c"))
    single = both.filter("a = b").select("a", F.col("c").alias("ca"))
    pairs = words.alias("x").join(words.alias("y"), F.col(f"x.{topic}") == F.col(f"y.{topic}")).select(F.col(f"x.{topic}").alias(topic), F.col(f"x.{word}").alias("a"), F.col(f"y.{word}").alias("b"))
    rated = pairs.join(both, ["a", "b"], "left").join(single, "a").join(single.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b").join(F.broadcast(total))
    p = F.coalesce("c", F.lit(0)) / F.col("_n")
    npmi = F.ln((p + eps) / (F.col("ca") / F.col("_n") * F.col("cb") / F.col("_n"))) / -F.ln(p + eps)
    vectors = rated.withColumn("v", npmi)
    sums = vectors.groupBy(topic, "b").agg(F.sum("v").alias("s"))
    each = vectors.join(sums, [topic, "b"]).groupBy(topic, "a").agg((F.sum(F.col("v") * F.col("s")) / (F.sqrt(F.sum(F.col("v") ** 2)) * F.sqrt(F.sum(F.col("s") ** 2)))).alias("m"))
    return each.groupBy(topic).agg(F.round(F.coalesce(F.avg("m"), F.lit(-1.0)), 6).alias("c_v"))


def rerank_keywords(keywords: DataFrame, word_vectors: DataFrame, topic_vectors: DataFrame, n: int = 50, topic: str = "topic_id", word: str = "word") -> DataFrame:
    """Keywords in the order of their cosine to the topic's vector (``vector`` columns on both sides)."""
    rows = keywords.join(word_vectors.select(word, F.col("vector").alias("_w")), word).join(topic_vectors.select(topic, F.col("vector").alias("_t")), topic)
    scored = rows.select(topic, word, F.round(cosine(F.col("_w"), F.col("_t")), 6).alias("score"))
    return top_keywords(scored, n, topic, word)


def centroid_vectors(embeddings: DataFrame, topic: str, vector: str) -> DataFrame:
    """The mean vector of each topic."""
    parts = embeddings.select(topic, F.posexplode(vector).alias("i", "x")).groupBy(topic, "i").agg(F.avg("x").alias("m"))
    return parts.groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("vector"))


def _with_vectors(df: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))


def fit_reduction(embeddings: DataFrame, vector: str, n_components: int):
    """A saveable ``PipelineModel`` of the principal components."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA

    return Pipeline(stages=[PCA(k=n_components, inputCol="_v", outputCol="_p")]).fit(_with_vectors(embeddings, vector))


def reduce_dimensions(embeddings: DataFrame, vector: str, n_components: int, model=None) -> DataFrame:
    """Principal components as ``reduced``, an array of doubles."""
    from pyspark.ml.functions import vector_to_array

    model = model or fit_reduction(embeddings, vector, n_components)
    return model.transform(_with_vectors(embeddings, vector)).withColumn("reduced", vector_to_array("_p")).drop("_v", "_p")


def fit_clusters(embeddings: DataFrame, vector: str, *, clusterer: str = "kmeans", k: int | None = None, seed: int = 42):
    """A saveable ``PipelineModel``: k-means or a Gaussian mixture of ``k`` (20) topics."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import GaussianMixture, KMeans

    if clusterer not in ("kmeans", "gmm"):
        raise ValueError(f"unknown clusterer: {clusterer}")
    kind = KMeans if clusterer == "kmeans" else GaussianMixture
    return Pipeline(stages=[kind(k=k or 20, seed=seed, featuresCol="_v", predictionCol="topic_id")]).fit(_with_vectors(embeddings, vector))


def distance(a: Column, b: Column) -> Column:
    """The Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def apply_clusters(model, embeddings: DataFrame, vector: str) -> DataFrame:
    """Add ``topic_id`` and ``probability``."""
    from pyspark.ml.functions import vector_to_array

    last, out = model.stages[-1], model.transform(_with_vectors(embeddings, vector))
    if hasattr(last, "clusterCenters"):
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in last.clusterCenters()])
        return out.withColumn("probability", 1 / (1 + distance(F.col(vector), F.element_at(centres, F.col("topic_id") + 1)))).drop("_v")
    return out.withColumn("probability", document_probability(vector_to_array("probability"))).drop("_v")


def cluster(embeddings: DataFrame, vector: str, *, clusterer: str = "kmeans", k: int | None = None, seed: int = 42, min_cluster_size: int = 50, min_samples: int = 10) -> DataFrame:
    """Add ``topic_id`` and ``probability``.

    ``kmeans`` and ``gmm`` need k (20 by default); ``density`` finds the number
    of topics itself, see ``density_clusters``.
    """
    if clusterer == "density":
        return density_clusters(embeddings, vector, min_cluster_size=min_cluster_size, min_samples=min_samples, seed=seed)
    return apply_clusters(fit_clusters(embeddings, vector, clusterer=clusterer, k=k, seed=seed), embeddings, vector)


def lloyd_step(points: DataFrame, centres: DataFrame, vector: str, topic: str = "topic_id") -> tuple[DataFrame, DataFrame]:
    """The points with their nearest centre as ``topic`` (ties: the least), and the centres' next places; ``centres`` is a few rows of ``topic, vector``."""
    known = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(topic).alias("t"), F.col(vector).cast("array<double>").alias("c")))).alias("_all"))
    near = points.drop(topic).crossJoin(F.broadcast(known)).withColumn("_best", F.array_min(F.transform("_all", lambda x: F.struct(distance(F.col(vector), x["c"]).alias("d"), x["t"].alias("t")))))
    own = near.withColumn(topic, F.col("_best.t")).drop("_all", "_best")
    return own, centroid_vectors(own, topic, vector)


#: Rows by whose neighbours the reach of a density clustering is fitted, and what part of them lies in it.
REACH_SAMPLE, REACH_SHARE = 1000, 0.8


def density_clusters(embeddings: DataFrame, vector: str, *, min_cluster_size: int = 50, min_samples: int = 10, reach: float | None = None, seed: int = 42) -> DataFrame:
    """Add ``topic_id`` and ``probability``: clusters of dense points, numbered by size, noise -1.

    Points with ``min_samples`` or more within ``reach`` (themselves included)
    are dense; dense points within it of one another are one cluster, and other points
    belong to the densest one in their reach.  Clusters of fewer than
    ``min_cluster_size`` points are noise, and so are vectors that are null,
    empty or hold null or non-finite components.  Without ``reach`` it is fitted so that
    ``REACH_SHARE`` of a bounded sample of points are dense.  Neighbours are
    exact (``neighbours``); equal vectors are one point with their number as weight.
    A row's probability is its part of the largest neighbourhood in its cluster; noise has 0.
    """
    kind = embeddings.schema[vector].dataType.elementType.simpleString()
    x = F.col(vector).cast(f"array<{'float' if kind == 'float' else 'double'}>")
    finite = F.coalesce((F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = checkpoint(embeddings.select(F.struct(*[F.col(f"`{c}`") for c in embeddings.columns if c not in ("topic_id", "probability")]).alias("_row"), F.when(finite, x).alias("_x"), F.monotonically_increasing_id().alias("_n")))
    real = rows.filter("_x is not null")
    seen = real.agg(F.count("*").alias("n"), F.min(F.size("_x")).alias("least"), F.max(F.size("_x")).alias("most")).first()
    if seen["least"] != seen["most"]:
        raise ValueError(f"vectors of {seen['least']} to {seen['most']} components")
    if not seen["n"]:
        return rows.select("_row.*", F.lit(NOISE).alias("topic_id"), F.lit(0.0).alias("probability"))
    sample = _sample(real, seed)
    reach = _fit_reach(real, sample, min_samples) if reach is None else reach
    points = checkpoint(real.groupBy(F.col("_x").alias("x")).agg(F.min("_n").alias("u"), F.count("*").alias("w")))
    near = checkpoint(neighbours(points, sample, reach, min_samples))
    parts = points.select("u", "w", F.col("w").alias("k")).unionByName(near.filter("v is null").select("u", F.lit(0).alias("w"), "k"))
    degree = checkpoint(parts.groupBy("u").agg(F.sum("w").alias("w"), F.sum("k").alias("k")))
    dense = degree.filter(F.col("k") >= min_samples)
    at = lambda c: degree.select(F.col("u").alias(c), F.col("k").alias(f"k{c}"))
    rated = checkpoint(near.filter("v is not null").select("u", "v").join(at("u"), "u").join(at("v"), "v").filter(F.greatest("ku", "kv") >= min_samples))
    roots = components(rated.filter(F.least("ku", "kv") >= min_samples).select("u", "v"))
    lone = dense.join(roots, dense["u"] == roots["node"], "left_anti").select(F.col("u").alias("node"), F.col("u").alias("root"))
    core = checkpoint(roots.unionByName(lone))
    edge = rated.filter(F.least("ku", "kv") < min_samples).select(F.when(F.col("ku") < F.col("kv"), F.col("u")).otherwise(F.col("v")).alias("u"), F.when(F.col("ku") < F.col("kv"), F.col("v")).otherwise(F.col("u")).alias("node"), F.greatest("ku", "kv").alias("kv"))
    edge = edge.join(core, "node").groupBy("u").agg(F.max(F.struct("kv", (-F.col("root")).alias("r"))).alias("x")).select(F.col("u").alias("node"), (-F.col("x.r")).alias("root"))
    member = checkpoint(core.unionByName(edge).join(degree.withColumnRenamed("u", "node"), "node"))
    sizes = member.groupBy("root").agg(F.sum("w").alias("n"), F.max("k").alias("most")).filter(F.col("n") >= min_cluster_size)
    numbered = global_rank(sizes.withColumn("_s", -F.col("n")), ["_s"], ["root"], "topic_id").select("root", "most", (F.col("topic_id") - 1).cast("int").alias("topic_id"))
    named = member.join(numbered, "root").select(F.col("node").alias("_u"), "topic_id", (F.col("k") / F.col("most")).alias("probability"))
    copied = points.filter("w > 1").select(F.col("x").alias("_x"), F.col("u").alias("_first"))
    known = rows.withColumn("_u", F.col("_n")) if copied.isEmpty() else rows.join(copied, "_x", "left").withColumn("_u", F.coalesce("_first", "_n"))
    return known.join(named, "_u", "left").select("_row.*", F.coalesce("topic_id", F.lit(NOISE)).alias("topic_id"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


def _sample(rows: DataFrame, seed: int) -> np.ndarray:
    """The vectors ``_x`` of at most ``REACH_SAMPLE`` rows, by a hash."""
    return np.array([r["_x"] for r in rows.orderBy(F.xxhash64(F.lit(seed), F.col("_x").cast("array<double>")), "_n").limit(REACH_SAMPLE).select("_x").collect()], float)


def _fit_reach(rows: DataFrame, sample: np.ndarray, min_samples: int) -> float:
    """The distance within which ``REACH_SHARE`` of the sampled points have ``min_samples`` points, measured against all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(sample)

    def nearest(batches):
        best = None
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                d = np.sqrt(squared(shared.value, matrix(batch.slice(k, 2048).column("_x"))))
                best = d if best is None else np.hstack([best, d])
                best = np.partition(best, min(min_samples, best.shape[1]) - 1, axis=1)[:, :min_samples]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best), dtype=np.int32), best.shape[1])), pa.array(best.ravel())], ["i", "d"])

    each = rows.select("_x").mapInArrow(nearest, "i int, d double")
    kth = each.groupBy("i").agg(F.get(F.slice(F.array_sort(F.collect_list("d")), min_samples, 1), F.lit(0)).alias("d")).filter("d is not null")
    return float(kth.agg(F.percentile("d", REACH_SHARE)).first()[0] or 0.0)


def merge_topics(assignments: DataFrame, term_scores: DataFrame, nr_topics: int, topic: str = "topic_id", word: str = "word") -> DataFrame:
    """``topic, merged``: the smallest topic joins the one of the most similar words, until ``nr_topics`` are left; noise stays.

    Similarity is the cosine of the topics' c-TF-IDF vectors.  The driver holds
    a number for each pair of topics, not of documents.
    """
    known = term_scores.filter(F.col(topic) != NOISE).select(topic, word, "score")
    both = known.alias("a").join(known.alias("b"), F.col(f"a.{word}") == F.col(f"b.{word}")).groupBy(F.col(f"a.{topic}").alias("a"), F.col(f"b.{topic}").alias("b")).agg(F.sum(F.col("a.score") * F.col("b.score")).alias("s"))
    dots = {(r["a"], r["b"]): r["s"] for r in both.collect()}
    sizes = {r[topic]: r["n"] for r in topic_sizes(assignments.filter(F.col(topic) != NOISE), topic).collect()}
    groups = {t: [t] for t in sizes}
    while len(groups) > max(1, nr_topics):
        small = min(groups, key=lambda t: (sizes[t], t))
        cosine_to = lambda t: dots.get((small, t), 0.0) / max(1e-300, (dots.get((small, small), 0.0) * dots.get((t, t), 0.0)) ** 0.5)  # noqa: B023, E731
        into = max((t for t in groups if t != small), key=lambda t: (cosine_to(t), -t))
        for t in list(groups):
            for x, y in ((into, t), (t, into)):
                if t != small:
                    dots[x, y] = dots.get((x, y), 0.0) + dots.get((small, t), 0.0)
        dots[into, into] = dots.get((into, into), 0.0) + dots.get((small, small), 0.0)
        groups[into] += groups.pop(small)
        sizes[into] += sizes.pop(small)
    rows = [(t, into) for into, members in groups.items() for t in members]
    return assignments.sparkSession.createDataFrame(rows, f"{topic} int, merged int")


def word_vectors(docs: DataFrame, words: DataFrame, *, tokens: str = "tokens", vector: str = "embedding", word: str = "word") -> DataFrame:
    """``word, vector``: the mean vector of the documents that hold a word or pair of words."""
    wanted = words.select(word).distinct()
    grams = T.let(F.col(tokens), lambda t: F.array_distinct(F.concat(t, ngrams(t, 2))))
    hits = docs.filter(F.col(vector).isNotNull()).select(F.explode(grams).alias(word), F.col(vector).alias("_x")).join(wanted, word)
    return centroid_vectors(hits, word, "_x")


def vis_points(embeddings: DataFrame, vector: str, topic: str = "topic_id", probability: str = "probability") -> DataFrame:
    """``x, y, topic, probability``: two principal components for a plot."""
    flat = reduce_dimensions(embeddings, vector, 2)
    return flat.select(F.get("reduced", F.lit(0)).alias("x"), F.get("reduced", F.lit(1)).alias("y"), F.col(topic).alias("topic"), F.col(probability).cast("double").alias("probability"))


def topic_members(assignments: DataFrame, chosen: DataFrame, member: bool = True, topic: str = "topic_id") -> DataFrame:
    """The rows whose topic is (or isn't) among the few chosen ones; a null topic is in none."""
    ids = F.broadcast(chosen.select(F.col(topic).alias("_chosen")).distinct())
    return assignments.join(ids, F.col(topic) == F.col("_chosen"), "left_semi" if member else "left_anti")


def metrics_row(assignments: DataFrame, keywords: DataFrame, coherence: DataFrame, **settings) -> DataFrame:
    """One row of settings, coherence, diversity and size metrics for the metrics log."""
    fixed = [F.date_format(F.current_date(), "yyyy-MM-dd").alias("date"), *[F.lit(v).alias(k) for k, v in settings.items()]]
    c = coherence.agg(F.coalesce(F.avg("c_v"), F.lit(-1.0)).alias("c_v"))
    return topic_metrics(assignments).join(F.broadcast(topic_diversity(keywords))).join(F.broadcast(c)).select(*fixed, "c_v", "diversity", "n_topics", "noise_ratio", "size_ratio", "size_std")
