import pytest
from pyspark.sql import functions as F

from corpuslab import providers
from corpuslab.functions import text as T
from corpuslab.operators import extract, infill, masking, pairs, probing, quality, splits, topics

SPANS = "array<struct<start:int,end:int,text:string>>"


def test_stories(spark):
    html = '<div type="story" n="1"><head>h</head><title> T </title><author> A </author><author>B</author>Body <b>x</b> <div>in</div>cut</div><div class="x" type="story"><title>no</title></div><div type="story"><title></title>no title</div>'
    rows = extract.extract_stories(spark.createDataFrame([(1, html)], "k int, text string")).collect()
    assert [(r.title, r.authors, r.full_text) for r in rows] == [("T", ["A", "B"], "<title> T </title><author> A </author><author>B</author>Body <b>x</b> <div>in")]


def test_file_entries(spark):
    names = ["/d/amazing_stories-1.2(1926.5).html", "/d/Amazing_stories-1.2(1926.5).html", "/d/amazing_stories-1.1(1926.4).txt", "/d/other"]
    out = extract.sorted_entries(spark.createDataFrame([(n,) for n in names], "path string")).collect()
    assert [(r.volume, r.issue, r.year, r.month) for r in out] == [(1, 1, 1926, 4), (1, 2, 1926, 5)]


def test_paragraphs(spark):
    rows = extract.segment_paragraphs(spark.createDataFrame([("s", "a\n \n\n b \n\nc\nd")], "story_id string, full_text string")).orderBy("paragraph_index").collect()
    assert [(r.paragraph_index, r.paragraph_text) for r in rows] == [(1, "a"), (2, "b"), (3, "c\nd")]


@pytest.mark.parametrize("counts, wanted", [([3, 4, 9, 1], [[3, 4], [9], [1]]), ([9, 9], [[9], [9]]), ([1, 1, 1], [[1, 1, 1]])])
def test_chunks(spark, counts, wanted):
    text = " ".join(" ".join(["w"] * (n - 1)) + (" w." if n > 1 else "w.") for n in counts)
    count = lambda s: F.size(T.whitespace_tokens(s))
    rows = extract.chunk_paragraphs(spark.createDataFrame([(text,), (None,)], "full_text string"), max_tokens=7, count=count).orderBy("paragraph_index").collect()
    assert [[len(s.split()) for s in r.paragraph_text.replace(". ", ".|").split("|")] for r in rows] == wanted


def test_content_dedup(spark):
    df = spark.createDataFrame([(1, 2, "x"), (2, 1, "x"), (3, 1, "y")], "id int, year int, text string")
    assert sorted(r.id for r in extract.dedup_by_content(df, "text", ["year", "id"]).collect()) == [2, 3]


def test_time_split(spark):
    df = spark.range(20).select(F.col("id"), (F.lit(1926) + F.col("id") % 3).alias("publication_year"), F.lit(1).alias("publication_month"))
    out = splits.time_split(df, order=["id"]).collect()
    assert {k: sum(r.split == k for r in out) for k in ("train", "dev", "test")} == {"train": 13, "dev": 3, "test": 4}
    assert max(r.publication_year for r in out if r.split == "train") <= min(r.publication_year for r in out if r.split == "test")


def test_global_rank_with_nulls(spark):
    df = spark.createDataFrame([(None, 1), (2, 1), (2, 0), (None, 0)], "y int, i int")
    assert [(r.y, r.i) for r in splits.global_rank(df, ["y"], ["i"]).orderBy("rank").collect()] == [(None, 0), (None, 1), (2, 0), (2, 1)]


def test_stratified(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("score"))
    out = splits.stratified_sample(df, 7).groupBy("score").count().orderBy("score").collect()
    assert [(r.score, r["count"]) for r in out] == [(1.0, 2), (2.0, 2), (3.0, 1), (4.0, 1), (5.0, 1)]
    few = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 2.5), (5, None)], "id int, score double")
    assert splits.stratified_sample(few, 10).count() == 3
    assert splits.stratified_sample(few.filter("id > 3"), 10).count() == 0


def test_cap(spark):
    df = spark.range(50).withColumn("g", F.col("id") % 2)
    assert [r["count"] for r in splits.cap_per_group(df, "g", 10, "id").groupBy("g").count().collect()] == [10, 10]


def choose(spark, given, compat):
    df = spark.createDataFrame([([(a, b, "") for a, b in given],)], f"s {SPANS}")
    return [(x.start, x.end) for x in df.select(masking.choose_spans(F.col("s"), compat).alias("s")).first().s]


def test_spans(spark):
    nested = [(4, 14), (4, 9), (10, 14)]
    assert choose(spark, nested, False) == [(4, 14)]
    assert sorted(choose(spark, nested, True)) == sorted(nested)
    for compat in (False, True):
        assert choose(spark, [(4, 14), (10, 21)], compat) == [(10, 21)]


def test_phrases(spark):
    docs = spark.createDataFrame([(1, 0, "Space ship, space ship!"), (2, 1, "space ship")], "paragraph_id int, topic_id int, paragraph_text string")
    kw = spark.createDataFrame([(0, "space ship"), (0, "ship"), (2, "space")], "topic_id int, word string")
    rows = masking.match_phrases(docs, kw).collect()
    assert sorted((r.paragraph_id, r.start, r.end, r.text) for r in rows) == [(1, 0, 10, "Space ship"), (1, 6, 10, "ship"), (1, 12, 22, "space ship"), (1, 18, 22, "ship")]


def test_variants(spark):
    docs = spark.createDataFrame([(1, "a bb ccc dd", [(2, 4, "bb"), (5, 8, "ccc")]), (2, "none", None)], f"paragraph_id int, paragraph_text string, spans {SPANS}")
    out = masking.mask_variants(docs)
    rows = out.collect()
    assert sum(r.paragraph_id == 1 for r in rows) == 6 and [r.masked_text for r in rows if r.paragraph_id == 2] == ["none"]
    for r in rows:
        text = r.masked_text
        assert text.count("<mask>") <= len(r.masked_tokens) <= 2
    assert sorted(map(str, rows)) == sorted(map(str, masking.mask_variants(docs).collect()))


def test_pairs(spark):
    rows = [
        (1, 1, 5, "The ship was gone. CHAPTER 12. It is well now, they say.", "The <mask> was gone. CHAPTER <mask>. It is well now, they say."),
        (1, 2, 5, "The ship was gone.", "The <mask> was gone."),
        (1, 3, 6, "No mask was here today.", "No mask was here today."),
        (2, 1, 7, "Many words but one of them <mask>.", "Many words but one of <mask> them."),
    ]
    df = spark.createDataFrame(rows, "paragraph_id int, variant_no int, topic_id int, paragraph_text string, masked_text string")
    vocabulary = spark.createDataFrame([(7, "absent")], "topic_id int, word string")
    out = pairs.sentence_pairs(df, vocabulary, order=["paragraph_id", "variant_no"], has_verb=providers.verb_test()).collect()
    assert [(r.original, r.masked, r.mask_ratio, r.length) for r in out] == [("The ship was gone.", "The <mask> was gone.", 0.25, 5)]
    stats = pairs.pair_stats(pairs.sentence_pairs(df, vocabulary, order=["paragraph_id", "variant_no"])).first()
    assert (stats.total_pairs, stats.avg_len, stats.avg_mask_ratio) == (1, 5.0, 0.2)


PAIRS = "pair_id string, infilled string, infill_score double, hybrid_score double, length int"


def test_filter_pairs(spark):
    nan = float("nan")
    rows = [("a", "ok", -1.0, 0.5, 10), ("a", "ok", -1.0, 0.9, 10), ("b", "a <mask>", -1.0, 0.9, 10), ("c", "ok", None, 0.9, 10), ("d", "ok", -1.0, nan, 10), ("e", "ok", -1.0, 0.9, 3), ("f", None, -1.0, 0.9, 10)]
    df = spark.createDataFrame(rows, PAIRS)
    assert [(r.pair_id, r.hybrid_score) for r in quality.filter_pairs(df).collect()] == [("a", 0.9)]
    assert sorted(r.pair_id for r in quality.filter_pairs(df, th_lp=-10.0).collect()) == ["a", "c"]
    a = quality.attrition(df).first()
    assert (a.original, a.after_no_mask, a.after_length_ok, a.after_dedup) == (7, 5, 2, 1)


def test_histograms(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (0.0,), (1.0,), (0.3,), (None,)], "hybrid_score double")
    assert {r.bucket: r.n for r in quality.hybrid_histogram(df).collect()} == {"low": 1, "mid": 2, "high": 1}
    scores = spark.createDataFrame([(4.0,), (5.0,), (None,)], "score double")
    assert [r.n for r in quality.score_histogram(scores).orderBy("lo").collect()] == [0, 0, 0, 0, 1]
    assert [r.n for r in quality.score_histogram(scores, compat=False).orderBy("lo").collect()] == [0, 0, 0, 0, 2]


def test_annotations(spark):
    rows = [(1, "long original text", "a fine change", 3.0), (2, "Chapter one of it", "a fine change", 3.0), (3, "long original text", "Answer: yes it is", 3.0), (4, None, "a fine change", 3.0), (5, "long original text", "singleword", 2.0)]
    df = spark.createDataFrame(rows, "id int, original_text string, modified_text string, score double")
    assert [r.id for r in quality.filter_annotations(df).collect()] == [1]
    out = quality.annotation_set(df, 10).collect()
    assert sorted(r.sample_id for r in out) == [1, 2, 3, 4, 5] and {r.expert_score for r in out} == {""}


def test_restructure(spark):
    df = spark.createDataFrame([("a", None, 2.0)], "original_text string, infilled_text string, score double")
    assert tuple(quality.restructure(df).first()) == ("a", None, "a [SEP] nan", 2.0)


def test_topics(spark):
    rows = [(0, "star"), (0, "star"), (0, "sea"), (1, "sea"), (1, "sea"), (-1, "x")]
    kw = topics.top_keywords(topics.class_tf_idf(spark.createDataFrame(rows, "topic_id int, word string")), 1).orderBy("topic_id").collect()
    assert [(r.topic_id, r.word) for r in kw] == [(0, "star"), (1, "sea")]
    m = topics.topic_metrics(spark.createDataFrame([(0,), (0,), (1,), (-1,)], "topic_id int")).first()
    assert (m.n_topics, m.noise_ratio, m.size_ratio) == (2, 0.25, 2.0)
    e = topics.topic_metrics(spark.createDataFrame([], "topic_id int")).first()
    assert (e.n_topics, e.noise_ratio, e.size_ratio) == (0, 0.0, 0.0)
    with pytest.raises(ValueError):
        topics.cluster(spark.createDataFrame([([1.0],)], "v array<double>"), "v", clusterer="x")


def test_argmax(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.2],), (None,)], "p array<double>")
    assert [tuple(r) for r in df.select(topics.argmax_topic(F.col("p")), topics.document_probability(F.col("p"))).collect()] == [(1, 0.7), (-1, 1.0)]


def test_infill(spark):
    text = spark.createDataFrame([("the red ship",), ("the red sea",), ("the old ship",)], "sentence string")
    rows = spark.createDataFrame([("p", "the <mask> ship"), ("q", "no masks"), ("r", "<mask> <mask>")], "pair_id string, masked string")
    out = {r.pair_id: r for r in infill.fill_masks(rows, infill.bigram_model(text), infill.unigram_model(text)).collect()}
    assert out["p"].infilled == "the red ship" and out["p"].infill_score == pytest.approx(-0.405465)
    assert out["q"].infill_score is None and out["r"].infilled == "the the"
    with pytest.raises(ValueError):
        infill.choose(F.lit(None), "beam")


@pytest.mark.parametrize("options, wanted", [({"top_k": 2}, [0.625, 0.375]), ({"top_p": 0.5}, [1.0]), ({"top_p": 0.51}, [0.625, 0.375]), ({"temperature": 0.5}, [25 / 38, 9 / 38, 4 / 38])])
def test_restrict(spark, options, wanted):
    df = spark.createDataFrame([([(0.5, "a"), (0.3, "b"), (0.2, "c")],)], "c array<struct<p:double,token:string>>")
    assert [x.p for x in df.select(infill.restrict(F.col("c"), **options).alias("c")).first().c] == pytest.approx(wanted)


def test_pick(spark):
    df = spark.createDataFrame([([(0.5, "a"), (0.3, "b"), (0.2, "c")], u) for u in (0.0, 0.49, 0.5, 0.79, 0.8, 0.999)], "c array<struct<p:double,token:string>>, u double")
    assert [r[0] for r in df.select(infill.pick(F.col("c"), F.col("u"))["token"]).collect()] == list("aabbcc")


def test_probing(spark):
    rows = spark.createDataFrame([(i, f"a{i} b c and d e f") for i in range(40)], "sentence_id long, sentence string")
    shifted = probing.bigram_shift(rows).collect()
    assert {r.label for r in shifted} == {"I", "O"}
    for r in shifted:
        assert sorted(r.item.split()) == sorted(f"a{r.sentence_id} b c and d e f".split()) and (r.label == "O") == (r.item == f"a{r.sentence_id} b c and d e f")
    assert {r.item for r in probing.coordinate_inversion(rows).collect() if r.label == "I" and r.sentence_id == 0} <= {"d e f and a0 b c"}
    assert probing.balanced(probing.clause_depth(rows), 10).count() == 10
