"""Licence texts as they stand in files: with titles and copyright lines, wrapped at any width."""

import textwrap

import pytest

from labelsense.llm import licenses


def matches(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.license_id for r in licenses.license_matches(docs, **more).filter("scope = 'text'").collect()}
    return [found.get(i) for i in range(len(texts))]


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(part.split()), width) for part in text.split("\n\n"))


@pytest.mark.parametrize("name", ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC"])
def test_any_width_and_title(spark, name):
    text = licenses.TEXTS[name]
    texts = [wrapped(text, width) for width in range(60, 100, 2)]
    head = "Copyright (c) 2019, Acme Inc. and others\nAll rights reserved."
    texts += [f"{title}\n\n{head}\n\n{wrapped(text, 78)}" for title in licenses.TITLES[name]]
    texts += [f"Copyright 2020 Acme. {' '.join(text.split())}", f"(c) Acme\n{text}", f"Copyright <year> <holder>\n{text}"]
    assert matches(spark, texts) == [name] * len(texts)


def test_what_is_no_statement_stays(spark):
    clause = "copyright notice and this permission notice appear in all copies"
    assert licenses.normal_text(f"above\n{clause}").endswith(clause)
    assert licenses.normal_text("Copyright 1999 A\nall rights reserved\nword") == "word"
    less = licenses.TEXTS["ISC"].replace("copyright notice and", "notice and")
    assert matches(spark, [less, licenses.TEXTS["MIT"] + " And more.", "MIT"]) == [None] * 3


def test_further_texts(spark):
    own = "You may do what you like with this, but tell us.\nThe copyright\nowner is not to blame."
    other = "You may do what you like with this, but tell us. The copyright holder is not to blame."
    assert matches(spark, [own, other], more={"OWN": own}) == ["OWN", "OWN"] and matches(spark, [own]) == [None]


def test_a_notice_that_repeats_matches_each_time(spark):
    docs = spark.createDataFrame([(1, "Licensed under the MIT License\nx\nLicensed under the MIT License")] * 2, "doc_id long, text string")
    rows = licenses.license_matches(docs).collect()
    assert sorted((r.scope, r.line_no) for r in rows) == [("line", 1)] * 2 + [("line", 3)] * 2
