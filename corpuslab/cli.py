"""Stages on the command line: ``python -m corpuslab.cli STAGE --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from corpuslab import providers, schemas
from corpuslab.config import PIPELINE
from corpuslab.functions import text as T
from corpuslab.operators import extract, infill, masking, pairs, quality, splits, topics
from corpuslab.session import checkpoint, get_session
from corpuslab.sources import io


def _extract(spark, a):
    files = io.read_files(spark, a.base_dir, strict=not a.skip_errors)
    stories = extract.extract_stories(files)
    io.write_json(stories, f"{a.output_dir}/stories")
    rows = extract.validate_paragraphs(extract.chunk_paragraphs(stories, max_tokens=a.max_tokens))
    order = ["publication_year", "publication_month", "path", "block_index", "paragraph_index"]
    rows = splits.global_rank(rows, order[:2], order[2:], "paragraph_id")
    io.write_parquet(rows, f"{a.output_dir}/paragraphs")
    io.write_splits(splits.time_split(rows, order=order[2:]), f"{a.output_dir}/splits")


def _topics(spark, a):
    """Each stage reads what the ones before it left, and stages before it whose results are there aren't done again."""
    rows = spark.read.parquet(a.paragraphs).withColumn("tokens", T.clean_tokens(F.col("paragraph_text"), PIPELINE, lemmatize=T.plural_lemma)).filter(F.size("tokens") >= 10)
    at = lambda name: f"{a.output_dir}/{name}"
    if a.stage in ("embed", "full") or not io.stored(spark, at("embeddings")):
        io.write_parquet(providers.hashing_embedder(rows).select("paragraph_id", "tokens", "embedding"), at("embeddings"))
    if a.stage == "embed":
        return
    embedded = spark.read.parquet(at("embeddings"))
    if a.stage in ("cluster", "full") or not io.stored(spark, at("assignments")):
        reduction = topics.fit_reduction(embedded, "embedding", a.components)
        io.write_model(reduction, at("reduction_model"))
        small = topics.reduce_dimensions(embedded, "embedding", a.components, reduction)
        if a.clusterer == "density":
            found = topics.density_clusters(small, "reduced", min_cluster_size=a.min_cluster_size, min_samples=a.min_samples, seed=a.seed)
        else:
            model = topics.fit_clusters(small, "reduced", clusterer=a.clusterer, k=a.k_topics, seed=a.seed)
            io.write_model(model, at("topic_model"))
            found = topics.apply_clusters(model, small, "reduced")
        if a.nr_topics:
            found = checkpoint(found)
            terms = topics.class_tf_idf(found.select("topic_id", F.explode("tokens").alias("word")))
            merged = topics.merge_topics(found, terms, a.nr_topics)
            found = found.join(F.broadcast(merged), "topic_id", "left").withColumn("topic_id", F.coalesce("merged", "topic_id")).drop("merged")
        io.write_parquet(found.select("paragraph_id", "topic_id", "probability", "reduced"), at("assignments"))
    if a.stage == "cluster":
        return
    given = spark.read.parquet(at("assignments")).join(embedded, "paragraph_id")
    if a.stage in ("analyze", "full") or not io.stored(spark, at("keywords")):
        stop = T.stopwords(io.read_stopwords(spark, a.stopwords) if a.stopwords else ())
        words = topics.top_keywords(topics.class_tf_idf(given.select("topic_id", F.explode(topics.without_stopwords(F.col("tokens"), stop)).alias("word"))), 2 * a.top_words)
        # of twice as many candidates, those nearest to their topic's vector
        words = topics.rerank_keywords(words, topics.word_vectors(given, words), topics.centroid_vectors(given, "topic_id", "embedding"), a.top_words)
        io.write_parquet(words, at("keywords"))
        words = spark.read.parquet(at("keywords"))
        io.write_keywords(words, at("topic_keywords"))
        io.write_keywords(words, at("topic_keywords_detailed"), given)
        settings = {"clusterer": a.clusterer, "k_topics": a.k_topics or -1, "components": a.components, "min_cluster_size": a.min_cluster_size, "min_samples": a.min_samples}
        io.append_metrics(topics.metrics_row(given, words, topics.c_v_coherence(given, words), **settings), at("metrics"))
        latest = topics.metrics_row(given, words, topics.c_v_coherence(given, words)).first().asDict()
        io.write_text(spark, quality.model_card(settings, latest, given.count()), at("model_card"))
        sizes = topics.topic_size_stats(topics.topic_sizes(given)).first().asDict()
        io.write_text(spark, quality.statistics_text({"documents": given.count(), **latest, **sizes}), at("topic_statistics"))
    if a.stage in ("visualize", "full"):
        points = topics.vis_points(given, "embedding")
        io.write_csv(points.select(*[f.split()[0] for f in schemas.VIS_POINTS.split(", ")]), at("points_2d"))
        io.write_csv(topics.centroids(points), at("topic_centres"))
        top = topics.first_topics(topics.topic_sizes(given.filter("topic_id <> -1")))
        io.write_csv(topics.topic_members(given, top).select("paragraph_id", "topic_id", "probability"), at("top_topic_members"))


def _keywords(spark, a):
    """The stored keywords, if their first topic has enough of them; else words by c-TF-IDF anew."""
    stored = spark.read.parquet(f"{a.model_dir}/keywords")
    if topics.cache_is_usable(stored, least=a.least_keywords):
        return stored
    given = spark.read.parquet(f"{a.model_dir}/assignments").join(spark.read.parquet(f"{a.model_dir}/embeddings").select("paragraph_id", "tokens"), "paragraph_id")
    return topics.top_keywords(topics.class_tf_idf(given.select("topic_id", F.explode("tokens").alias("word"))), 50)


def _mask(spark, a):
    rows = spark.read.parquet(a.paragraphs).join(spark.read.parquet(f"{a.model_dir}/assignments").select("paragraph_id", "topic_id"), "paragraph_id")
    found = masking.collect_spans(masking.match_phrases(rows, _keywords(spark, a)))
    spans = found.withColumn("spans", masking.choose_spans(F.col("spans")))
    variants = masking.mask_variants(rows.join(spans.drop("topic_id"), "paragraph_id", "left"), variants=a.variants, seed=a.seed)
    io.write_json(variants, f"{a.output_dir}/masked_paragraphs")
    io.write_csv(variants, f"{a.output_dir}/masked_paragraphs_csv", compression="gzip")
    io.write_json(masking.masking_report(variants), f"{a.output_dir}/masking_report")


def _pairs(spark, a):
    variants = spark.read.json(a.masked)
    vocabulary = io.read_topic_keywords(spark, a.topic_keywords) if a.topic_keywords else None
    out = pairs.sentence_pairs(variants, vocabulary, order=["paragraph_id", "variant_no"], min_tokens=a.min_tokens, mask_min=a.mask_min, mask_max=a.mask_max, has_verb=providers.verb_test() if a.verbs else None)
    io.write_json(out, f"{a.output_dir}/masked_pairs")
    io.write_json(pairs.pair_stats(spark.read.schema(schemas.MASKED_PAIRS).json(f"{a.output_dir}/masked_pairs")), f"{a.output_dir}/pairs_stats")


def _infill(spark, a):
    rows = io.read_jsonl(spark, a.pairs, schemas.MASKED_PAIRS)
    text = rows.select(F.col("original").alias("sentence")).distinct()
    out = infill.fill_masks(rows, infill.bigram_model(text), infill.unigram_model(text), strategy=a.sampling_strategy, seed=a.seed, top_k=a.top_k, top_p=a.top_p, temperature=a.temperature)
    a_, b_ = F.col("original"), F.col("infilled")
    out = out.withColumn("sim_score", infill.text_cosine(a_, b_)).withColumn("hybrid_score", infill.hybrid_score(F.col("sim_score"), infill.token_jaccard(a_, b_), infill.length_ratio(a_, b_)))
    io.write_json(out, f"{a.output_dir}/infilled_pairs")


def _filter(spark, a):
    rows = io.read_jsonl(spark, a.input, schemas.INFILLED_PAIRS)
    kept = quality.filter_pairs(rows, tiebreak=["original"], th_lp=a.th_lp, th_hyb=a.th_hyb, min_len=a.min_len, max_len=a.max_len)
    io.write_json(kept, a.output)


def _annotate(spark, a):
    rows = io.read_annotation_csv(spark, a.input).withColumn("id", T.content_id(F.col("original_text"), F.col("modified_text")))
    io.write_csv(quality.annotation_set(quality.filter_annotations(rows), a.samples, seed=a.seed), f"{a.output_dir}/annotations")
    io.write_text(spark, quality.ANNOTATION_GUIDE, f"{a.output_dir}/guide")


def _finish(spark, a):
    out = quality.restructure(io.read_csv(spark, a.input))
    io.write_csv(out, f"{a.output_dir}/final_pairs_all")
    io.write_csv(quality.valid_scores(out), f"{a.output_dir}/final_pairs_valid")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpuslab")
    sub = top.add_subparsers(dest="command", required=True)

    def stage(name, run, *options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flag, kind, default in options:
            if kind is bool:
                p.add_argument(flag, action=argparse.BooleanOptionalAction, default=default)
            else:
                p.add_argument(flag, type=kind, default=default, required=default is ...)

    out, seed = ("--output_dir", str, ...), ("--seed", int, 42)
    stage("extract", _extract, ("--base_dir", str, ...), out, ("--skip_errors", bool, False), ("--max_tokens", int, 400))
    stage("topics", _topics, ("--paragraphs", str, ...), out, seed, ("--clusterer", str, "density"), ("--k_topics", int, None), ("--components", int, 10), ("--top_words", int, 50), ("--nr_topics", int, None), ("--min_cluster_size", int, 50), ("--min_samples", int, 10), ("--stopwords", str, None), ("--stage", str, "full"))
    stage("mask", _mask, ("--paragraphs", str, ...), ("--model_dir", str, ...), out, seed, ("--variants", int, 6), ("--least_keywords", int, 30))
    stage("pairs", _pairs, ("--masked", str, ...), out, ("--topic_keywords", str, None), ("--min_tokens", int, 4), ("--mask_min", float, 0.05), ("--mask_max", float, 0.40), ("--verbs", bool, True))
    stage("infill", _infill, ("--pairs", str, ...), out, seed, ("--sampling_strategy", str, "greedy"), ("--top_k", int, 10), ("--top_p", float, 0.9), ("--temperature", float, 1.0))
    stage("filter", _filter, ("--input", str, ...), ("--output", str, ...), ("--th_lp", float, -3.0), ("--th_hyb", float, 0.3), ("--min_len", int, 4), ("--max_len", int, 180))
    stage("finish", _finish, ("--input", str, ...), out)
    stage("annotate", _annotate, ("--input", str, ...), out, ("--samples", int, 250), seed)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(get_session(), args)


if __name__ == "__main__":
    main()
