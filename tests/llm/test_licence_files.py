"""Whole licence texts as people wrap, number and abridge them, and what lies beneath them."""

import math
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import licences, queries
from corpuslab.llm.licence_texts import WHOLE_TEXTS

MODEL = licences.LicenceModel({})


def written(name, width=78, start="Copyright (c) 2021 Some Body and others\n\n", mark=""):
    body = "\n\n".join(textwrap.fill(p, width) for p in WHOLE_TEXTS[name][1:])
    return "\n".join(mark + line for line in (WHOLE_TEXTS[name][0] + "\n\n" + start + body).split("\n"))


@pytest.mark.parametrize("name", sorted(WHOLE_TEXTS))
@pytest.mark.parametrize("width, mark", [(78, ""), (40, ""), (100_000, ""), (60, " * "), (60, "# ")])
def test_written_files(name, width, mark):
    score, licence, whole = MODEL.scan(written(name, width, mark=mark))
    assert (licence, whole) == (name, True) and score >= 0.6


@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"])
def test_abridged(name):
    """Without its title, and with the first half of the disclaimer only."""
    parts = WHOLE_TEXTS[name][1:]
    text = "\n\n".join(textwrap.fill(p, 70) for p in [*parts[:-1], parts[-1][: len(parts[-1]) // 2]])
    assert MODEL.scan(text)[1:] == (name, True)


def test_a_header_in_a_long_text_is_no_file():
    prose = "\n\n".join(" ".join(f"p{i}w{j}" for j in range(50)) for i in range(120))
    for name in WHOLE_TEXTS:
        assert MODEL.scan(prose + "\n\n" + written(name, 78) + "\n\n" + prose)[1:] == (name, False)


def test_ceiling_is_never_passed():
    """The bound that spares a comparison of whole texts."""
    pieces = [p for texts in WHOLE_TEXTS.values() for p in texts]
    for i in range(len(pieces)):
        for more in ("", " x y z", " ".join(f"w{j}" for j in range(40)), pieces[(i * 7) % len(pieces)]):
            text = f"{pieces[i]} {more}"
            best = max(MODEL._best(text, ("whole",))[0], MODEL._best(text, ("unit", "shared"))[0])
            assert best <= MODEL.ceiling(licences._WORD.findall(text.lower())) + 1e-9


def slow_cosine(a, b, idf):
    def vector(t):
        return {x: (1 + math.log(c)) * idf.get(x, MODEL.other) for x, c in Counter(licences.terms(t)).items()}

    u, v = vector(a), vector(b)
    norm = math.sqrt(sum(x * x for x in u.values())) * math.sqrt(sum(x * x for x in v.values()))
    return sum(w * v.get(t, 0) for t, w in u.items()) / norm if norm else 0.0


def test_scan_by_brute_force():
    """All units against all templates, without any pruning."""
    texts = [written("MIT", 50), "prose\n" + licences.TEMPLATES["ISC"][1] + "\nmore prose of another kind", "All rights reserved, or not.", "license version of the", "Released\nunder the MIT License. Then prose."]
    texts += [" ".join(p.split()[: n]) for p in WHOLE_TEXTS["MIT"] for n in (3, 8, 15, 30)]
    named = [(n, t) for n, kind, t in licences.templates() if kind != "whole"]
    for text in texts:
        found = [max(slow_cosine(u, t, {}) for _, t in named) for p in licences._PARAGRAPH.split(text) for parts in licences.units(p) for u in parts]
        assert (MODEL.scan(text)[1] is not None) == (max(found) >= 0.6 - 1e-12 or max(slow_cosine(text, " ".join(x), {}) for x in WHOLE_TEXTS.values()) >= licences.WHOLE)


def test_inheritance_by_brute_force(spark):
    """The nearest licence file upwards, walked directory by directory."""
    rows, mit, bsd = [], written("MIT"), written("BSD-3-Clause")
    for i, d in enumerate(["", "/a", "/a/b", "/a/b/c", "/d", "/d/e", "/f/g/h"]):
        rows.append((10 * i, "only prose", f"{d}/x.txt"))
        rows.append((10 * i + 1, None, f"{d}/y/z.txt"))
    rows += [(200, mit, "/a/LICENSE"), (201, bsd, "/a/b/COPYING.txt"), (202, "This project is licensed under the terms of the MIT license.\n" + "and prose goes on at length " * 30, "/d/licence-code.md"), (203, "prose " * 50 + "\n\nReleased under the ISC License.", "/f/readme.txt")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    files = {"/a": ("MIT", "/a/LICENSE"), "/a/b": ("BSD-3-Clause", "/a/b/COPYING.txt"), "/d": ("MIT", "/d/licence-code.md")}
    for r in licences.scan_licences(df, F.col("path")).collect():
        if r.origin != "own":
            folder, found = r.path.rpartition("/")[0], None
            while found is None and folder:
                found, folder = files.get(folder), folder.rpartition("/")[0]
            assert (r.licence, r.licence_path) == (found or (None, None)) and r.origin == ("inherited" if found else "none")
        else:
            assert r.doc_id >= 200


def test_query_paths_keep_their_depth(spark, tmp_path):
    docs = spark.createDataFrame([(1, written("MIT"), None, "en"), (2, "prose", None, "en"), (3, "prose", "s", None), (None, "prose", "s", "en")], "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.path, r.licence, r.origin) for r in queries.op10_licences(spark, str(tmp_path)).collect()}
    assert out == {1: ("/-/en/1", "MIT", "own"), 2: ("/-/en/2", "MIT", "inherited"), 3: ("/s/-/3", None, "none"), None: (None, None, "none")}
