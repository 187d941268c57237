import json

from pyspark.sql import functions as F

from corpuslab import cli
from corpuslab.operators import quality
from corpuslab.sources import io
from corpuslab.streaming import pairs as stream_pairs


def test_files(spark, tmp_path):
    (tmp_path / "amazing_stories-1.2(1926.5).html").write_bytes(b"same")
    (tmp_path / "amazing_stories-1.1(1926.4).html").write_bytes(b"same")
    (tmp_path / "amazing_stories-1.3(1926.6).html").write_bytes(b"\xff\xfe")
    (tmp_path / "other.html").write_bytes(b"x")
    rows = io.read_files(spark, str(tmp_path), strict=False).collect()
    assert [(r.publication_month, r.text) for r in rows] == [(4, "same")]
    try:
        io.read_files(spark, str(tmp_path)).collect()
        raise AssertionError("strict reading must fail")
    except Exception as e:
        assert "not UTF-8" in str(e)


def test_annotation_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('sent1,sent2,pair,score\n"a, ""b""","c\nd",e, 3 \n')
    rows = io.read_annotation_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r.score for r in rows] == [None, 3.0] and rows[1].original_text == 'a, "b"' and rows[1].modified_text == "c\nd"


def test_keywords_and_stopwords(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"0": ["Star", "star", "Sea"], "1": ["x"]}))
    rows = sorted(map(tuple, io.read_topic_keywords(spark, str(tmp_path / "k.json")).collect()))
    assert rows == [(0, 1, "star"), (0, 2, "sea"), (1, 1, "x")]
    (tmp_path / "s.txt").write_text("One\n\n two \none\n")
    assert io.read_stopwords(spark, str(tmp_path / "s.txt")) == ["one", "two"]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "k int, l array<string>")
    io.write_csv(df, str(tmp_path / "c"), compression="gzip")
    assert io.read_csv(spark, str(tmp_path / "c"), "k int, l string").first().l == '["a","b"]'
    io.write_json(df, str(tmp_path / "j"))
    assert io.read_jsonl(spark, str(tmp_path / "j"), "k int, l array<string>").collect() == df.collect()
    for _ in range(2):
        io.append_metrics(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_stream(spark, tmp_path):
    schema = "ts timestamp, pair_id string, infilled string, infill_score double, hybrid_score double, length int"
    rows = [("2024-01-01 00:00:00", "a", "ok", -1.0, 0.9, 10), ("2024-01-01 00:00:01", "a", "ok", -1.0, 0.8, 10), ("2024-01-01 00:00:02", "b", "<mask>", -1.0, 0.9, 10)]
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).write.json(str(tmp_path / "in"))
    stream = stream_pairs.filter_stream(stream_pairs.read_stream(spark, str(tmp_path / "in"), schema), "ts")
    q = stream.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.pair_id for r in spark.table("kept").collect()] == ["a"]


def test_stages(spark, tmp_path):
    """The command line from files to annotation sets."""
    body = "The silver ship was near the green moon. " * 6 + "A small crew saw the ship and the moon. They were glad and the captain said so. " * 4
    for m in range(1, 5):
        (tmp_path / f"amazing_stories-1.{m}(1926.{m}).html").write_text("".join(f'<div type="story"><title>T{m}{k}</title><author>A</author>{body} Number {m}{k} was told.</div>' for k in range(3)))
    out = str(tmp_path / "out")
    run = lambda *a: cli.main([str(x) for x in a])
    run("extract", "--base_dir", tmp_path, "--output_dir", out, "--max_tokens", 60)
    paragraphs = spark.read.parquet(f"{out}/paragraphs")
    n = paragraphs.count()
    assert n > 12 and paragraphs.select("paragraph_id").distinct().count() == n
    assert spark.read.json(f"{out}/splits").count() == n
    run("topics", "--paragraphs", f"{out}/paragraphs", "--output_dir", out, "--k_topics", 2, "--components", 3, "--clusterer", "kmeans")
    assert spark.read.parquet(f"{out}/metrics").first().n_topics == 2
    run("mask", "--paragraphs", f"{out}/paragraphs", "--model_dir", out, "--output_dir", out)
    run("pairs", "--masked", f"{out}/masked_paragraphs", "--output_dir", out, "--verbs")
    assert spark.read.json(f"{out}/pairs_stats").first().total_pairs > 0
    run("infill", "--pairs", f"{out}/masked_pairs", "--output_dir", out, "--sampling_strategy", "top_k")
    run("filter", "--input", f"{out}/infilled_pairs", "--output", f"{out}/clean", "--th_lp", -20)
    clean = spark.read.json(f"{out}/clean")
    assert clean.count() > 0 and clean.filter(F.contains("infilled", F.lit("<mask>"))).isEmpty()
    final = quality.restructure(clean.select(F.col("original").alias("sent1"), F.col("infilled").alias("sent2"), F.lit("3").alias("score")))
    final.select("sent1", "sent2", "pair", "score").write.csv(f"{out}/headerless", escape='"')
    run("annotate", "--input", f"{out}/headerless", "--output_dir", out, "--samples", 3)
    assert io.read_csv(spark, f"{out}/annotations").count() == 3
