"""The corpus pipeline against plain versions of its stages."""

import os
from collections import Counter

import corpus_pipeline
from corpuslab.llm import common, mixing, queries, sharding
from pyspark.sql import functions as F
from tests.llm.test_text_matching import components


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, at = {r.doc_id: r for r in docs.collect()}, docs
    ids = set(rows)
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, sf_dir).cache()
        assert at.columns == docs.columns
        kept = {r.doc_id for r in at.collect()}
        assert kept <= ids and all(rows[r.doc_id] == r for r in at.collect())
        if name == "toxicity":
            assert ids - kept == {r.doc_id for r in queries.op2_toxicity(spark, sf_dir).filter("predicted = 1").collect()}
        if name == "near_duplicates":
            assert kept == {d for d, _, c in components([(i, rows[i].text) for i in ids], corpus_pipeline.NEAR_PERCENT) if d == c}
        if name == "decontamination":
            assert (ids - kept) == ids & {r.doc_id for r in queries.op7_decontamination(spark, sf_dir).collect()}
        ids = kept
    mixed = corpus_pipeline.mixing_stage(spark, at, sf_dir)
    taken = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(taken.values()) <= 2
    words, goal = Counter(), {}
    for r in mixing.mix_sources(at).collect():
        goal[r.source] = r.target
        assert taken[r.doc_id] == r.copies or not r.size
        words[r.source] += taken[r.doc_id] * r.size
    assert all(abs(words[s] - goal[s]) <= 0.02 * goal[s] for s in goal)
    placed = corpus_pipeline.sharding_stage(spark, mixed, sf_dir)
    assert Counter(r.doc_id for r in placed.collect()) == taken
    one = {r.doc_id: r.shard for r in placed.collect()}
    assert one == {r.doc_id: r.s for r in at.select("doc_id", sharding.rendezvous(F.col("doc_id"), [1.0] * 24).alias("s")).collect() if r.doc_id in one}


def test_run_leaves_nothing_behind(spark, sf_dir):
    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0
    new = set(os.listdir(folder)) - before
    assert len(new) == 1 and new.pop().startswith("sharding-") and common.shared_folder(spark).removeprefix("file:") == folder


def test_stages_of_awkward_tables(spark, sf_dir):
    """Null, repeated and empty values, a very long text, names that the operators use themselves, and no rows at all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = [(None, None, None, None, None), (None, "a null id", "en", None, 3), (900_005, "", "en", "src1", 0), (900_005, "", "en", "src1", 0), (900_005, "another text of this id", None, "src1", 1), (900_006, "word " * 300_000, "en", "src2", 1)]
    names = ["_gone", "_id", "_key", "row", "node", "text2", "_bucket", "_best", "_h", "_part", "score", "_maybe"]
    df = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({n: F.lit(n) for n in names})
    for table in (df, df.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            at = common.stored(stage(spark, at, sf_dir), name)[0]
            assert set(table.columns) <= set(at.columns) if name == "sharding" else at.columns == table.columns
            if table is df and name in ("toxicity", "decontamination"):
                assert at.filter("doc_id is null").count() == 2 and at.filter("doc_id = 900005").count() == 3 and at.filter("doc_id = 900006").count() == 1
        assert (at.count() > 0) == (table is df)
