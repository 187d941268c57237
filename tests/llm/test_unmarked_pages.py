"""Paragraphs of the main region of pages that mark no article."""

import pytest

from corpuslab.llm.htmlblocks import main_text

LONG = "This sentence of the article is long enough to let the text surge above the threshold of the blocks."
MENU = "<div><ul>" + "".join(f"<li><a href=/{i}>Menu entry {i}</a></li>" for i in range(12)) + "</ul></div><div></div>"


@pytest.mark.parametrize(
    "body, text",
    [
        (f"<p>Short lead.</p><p>{LONG}</p><p>{LONG}</p>", ["Short lead.", LONG, LONG]),
        (f"<p>{LONG}</p><div class='ad'>Buy</div><p>Short one.</p><aside>x</aside><p>{LONG}</p>", [LONG, "Short one.", LONG]),
        (f"<p>{LONG}</p><p>{LONG}</p><form>f</form><p>The closing words.</p>", [LONG, LONG, "The closing words."]),
        (f"<div>{LONG}</div><aside>x</aside><div>Short one.</div><aside>x</aside><div>{LONG}</div>", [LONG, "Short one.", LONG]),
        (f"<p>{LONG}</p><p><a href=/x>All of this paragraph is a link.</a></p><p>{LONG}</p>", [LONG, "All of this paragraph is a link.", LONG]),
    ],
)
def test_paragraphs(body, text):
    assert main_text(f"<html><body>{MENU}<div>{body}</div><div><p>Other box</p></div></body></html>").split("\n\n")[: len(text)] == text
    assert "Menu entry" not in main_text(f"<html><body>{MENU}<div>{body}</div></body></html>")
