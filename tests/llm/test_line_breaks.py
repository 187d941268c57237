"""Entities over line breaks are found as in a search of the whole text."""

import random

import pytest

from corpuslab.llm import surrogates as S


def whole(text):
    return [e for m in S._KINDS.finditer(text) for e in S._entities(m)]


@pytest.mark.parametrize("text, kinds", [("we met Mary\nSmith there", ["given", "family"]), ("so Dr.\nJones came", ["family"]), ("Dr.\nMary\nJones", ["given", "family"]), ("the password:\n abc123x is", ["secret"]), ("password\n\n=\n\n\nabc123x", ["secret"])])
def test_broken(text, kinds):
    long = f"first line\n\n{text}\nlast line\nand more"
    assert [e.kind for e in S.detect(long)] == kinds and S.detect(long) == whole(long)
    new, _ = S.replace(long, b"k", {})
    assert not any(w in new for w in ("Mary", "Smith", "Jones", "abc123x"))


def test_same_as_whole():
    rng = random.Random(5)
    words = ["Mary", "Smith", "Dr.", "Jones", "password", "token:", "api_key", ":", "=", "abc123x", "'s3cret99'", "risk", "ann@b.org", "+49 30 1234567", "10.1.2.3", "123-45-6789", "the", "Hill", ""]
    for _ in range(4000):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\n", "\n\n", "\r\n", ""]) for _ in range(rng.randrange(1, 25)))
        assert S.detect(text) == whole(text), text
