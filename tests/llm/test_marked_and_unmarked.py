"""Surge and dive points locate the text of marked and unmarked pages alike."""

import re

import pytest
from pyspark.sql import functions as F

from corpuslab.llm.htmlblocks import extract_main_text, main_text

LONG = "This sentence of the article is long enough to let the text surge above the threshold of the blocks."


def test_pages_without_article_give_the_same_text():
    duckdb = pytest.importorskip("duckdb")
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    assert len(pages) == 250
    for (page,) in pages:
        assert main_text(re.sub(r"<(/?)article\b", r"<\1div", page)) == main_text(page) != ""


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h2>Teaser</h2></article><article><h1>T</h1><p>a</p><p>{LONG}</p></article><article><p>More</p></article>", ["T", "a", LONG]),
        ("<article><p>One</p></article><article><p>Two</p></article>", ["One", "Two"]),
        (f"<div><p>{LONG}</p></div><main><p>Short</p></main>", ["Short"]),
        ("<article><p><a href=x>All of it is a link</a></p></article>", ["All of it is a link"]),
        (f"<main><section><h1>T</h1></section><section><p>{LONG}</p></section></main>", ["T", LONG]),
        (f"<div><nav>menu</nav><h1>Title</h1><p>By.</p><h2>Sub</h2><h3>x</h3><h4>y</h4><p>{LONG}</p><h2>End</h2></div>", ["Title", "By.", "Sub", "x", "y", LONG, "End"]),
        (f"<div><span>Far away</span></div><div><aside>ad</aside><h1>T</h1><p>{LONG}</p></div><footer>f</footer><div>Other</div>", ["T", LONG]),
    ],
)
def test_regions(page, text):
    assert main_text(f"<html><body>{page}</body></html>") == "\n\n".join(text)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>")], "page_id long, url string, html string").withColumns({n: F.lit(n) for n in ("text", "n_chars", "marked", "row")})
    assert [tuple(r) for r in extract_main_text(df).collect()] == [(1, "u", LONG, len(LONG))]
