"""Page text, toxicity and quality."""

import html as htmllib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import quality_gam, queries, toxicity
from corpuslab.llm.htmlblocks import extract_main_text, main_text

LONG = "This sentence of the article is long enough to let the text surge above the threshold of the blocks."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain", "plain"),
        ("<article><h1>T</h1><p>a\n  b&nbsp;&amp; c<br>d<p>e</article>", "T\n\na b & c d\n\ne"),
        ("<html><head><title>x</title></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><header>H</header><article><p>One</p><script>var t='</p>';</script><style>p{}</style><!-- no --><p>Two</p></article><footer>F</footer>", "One\n\nTwo"),
        ("<body><div class='has-sidebar'><article><p>One</p><div class='ad-box'>Buy <div>now</div> all</div><section id='comments'><p>nice</p></section><p>Two</p></article></div><aside>x</aside>", "One\n\nTwo"),
        ("<div class='content with sidebar'><main><p>Kept</p></main><p>not</p></div>", "Kept"),
        ("<div class='sidebar'><main><p>Kept</p></main></div>", "Kept"),
        ("<article><p>a</p><form><p>mail?</p><input></form><div role=navigation>n</div><div style='display:none'>h</div><p hidden>x<p>b</article>", "a\n\nb"),
        ("<article><p>cut <b>off", "cut off"),
        ("<article><p>1 < 2 and a<b>c</b></p></article>", "1 < 2 and ac"),
        ("<article><p title=\"a>b\">q</p><textarea><p>no</textarea></article>", "q"),
        (f"<body><div>Menu</div><div><a href=x>{LONG}</a></div><p>{LONG}</p><p>Short.</p><p>{LONG}</p><div class=footer>Imprint</div></body>", f"{LONG}\n\nShort.\n\n{LONG}"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_unmarked_menu_is_dropped_by_the_blocks():
    menu = "".join(f"<li><a href=/{i}>Entry number {i} of the menu</a></li>" for i in range(30))
    assert main_text(f"<body><ul>{menu}</ul><div></div><p>{LONG}</p><p>End.</p></body>") == f"{LONG}\n\nEnd."


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>é</p></article>", 0), (2, None, None, 0), (None, "v", "", 0), (1, "u", "<article><p>é</p></article>", 0)]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, [(1, "u", "é", 1), (2, None, "", 0), (None, "v", "", 0), (1, "u", "é", 1)]))
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_page():
    words = "word " * 400_000
    assert main_text(f"<article><p>{words}</p></article>") == words.strip()
    assert len(main_text("<article>" + "<p>x &lt; y</p>" * 50_000)) == 50_000 * 7 - 2


def test_pages_table(spark, sf_dir):
    """The pages' articles by a plain reading of their known, flat markup."""
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op1_main_text(spark, sf_dir).collect():
        page = pages[r.page_id]
        body = page[page.index("<article>") + 9 :].split("</article>")[0]
        blocks = [" ".join(htmllib.unescape(re.sub(r"<br>", " ", re.sub(r"<(?!br)[^>]*(?:>|$)", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def labelled(spark, n=400):
    """Documents of which the toxic ones have one bad sentence."""
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(words, 8)) + "." for _ in range(rng.integers(1, 12))]
        bad = i % 4 == 0
        if bad:
            sentences[rng.integers(len(sentences))] += " grumbo" + ("lak", "ter", "")[i % 3] + " here."
        rows.append((i, " ".join(sentences)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_finds_sentences(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.train(docs, labels)
    out = toxicity.score_toxicity(docs, model).collect()
    assert all(r.predicted == truth[r.doc_id] for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        assert bool(r.offending) == bool(truth[r.doc_id])
        assert all("grumbo" in text[r.doc_id][s.start : s.end] for s in r.offending)
    new = spark.createDataFrame([(1, None), (2, ""), (None, "grumbozzz x."), (3, "waa wab. " * 2000), (3, "waa wab. " * 2000)], "doc_id long, text string").withColumn("score", F.lit(1))
    got = sorted((str(r.doc_id), r.predicted, r.held_out) for r in toxicity.score_toxicity(new, model).collect())
    assert [g[1] for g in got] == [0, 0, 0, 0, 1]


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels, _ = labelled(spark)
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, wrong)
    assert (a.weights, a.bias) == (b.weights, b.bias)


def test_toxicity_without_labels(spark):
    docs, labels, _ = labelled(spark, 8)
    model = toxicity.train(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, model).filter("score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_noisy_or_is_the_product():
    model = toxicity.ToxicityModel({"bad": 3.0, "^badl": 1.0}, -2.0)
    p = lambda z: 1 / (1 + np.exp(-z))
    score, where = model.score("Bad one. fine\nbadly bad!")
    assert score == pytest.approx(1 - (1 - p(1)) * (1 - p(2)))
    assert [(x["start"], x["end"]) for x in where] == [(0, 8), (14, 24)]


def test_quality_model_is_additive():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (x[:, 0] + 2 * (x[:, 1] > 0) * (x[:, 2] > 0) + rng.normal(size=4000) * 0.2 > 1).astype(int)
    model = quality_gam.fit(x[:3000], y[:3000], n_pairs=2)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    assert (1, 2) in model.pairs
    b = model.bins(x[:1])[0]
    by_hand = model.base + sum(t[k] for t, k in zip(model.tables, b)) + sum(t[b[i], b[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
    assert model.logits(x[:1])[0] == pytest.approx(by_hand)


def test_quality_rows(spark):
    good = "A plain sentence follows here, and another one. It goes on as prose does.\n"
    bad = "BUY!! NOW!! CHEAP!! "
    rows = [(i, (bad if i % 3 == 0 else good) * (1 + i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    model = quality_gam.train(docs, labels)
    out = quality_gam.score_quality(docs, model).collect()
    assert all(r.predicted == int(r.doc_id % 3 != 0) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    edge = spark.createDataFrame([(1, None), (None, ""), (2, " \n"), (3, "x" * 300_000)], "doc_id long, text string")
    assert quality_gam.score_quality(edge, model).filter("score between 0 and 1").count() == 4
    assert quality_gam.score_quality(edge.limit(0), model).count() == 0


@pytest.mark.parametrize("name, label, least", [("op2_toxicity", "toxic", 0.9), ("op6_quality", "quality", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    out = queries.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select((F.col("predicted") == F.col(label)).cast("int").alias("ok"))
    assert out.agg(F.avg("ok")).first()[0] >= least
