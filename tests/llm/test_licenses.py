"""The licence scan against regular expressions, and on odd rows."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelflow.llm import licenses
from labelflow.llm.licenses import PHRASES, TEMPLATES, Automaton

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base_places(text):
    own = words(text)
    return sorted(
        (i, label) for phrase, label in PHRASES.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()
    )


def as_pattern(markup):
    """The markup as a regular expression over words, each followed by a space."""
    out = []
    for token in re.findall(r"\[\[|\]\]|<<[^>]+>>|[^\s\[\]<>]+", markup):
        region = re.fullmatch(r"<<\w+:(\d+)\.\.(\d+)(:digits)?>>", token)
        if token == "[[":
            out.append("(?:")
        elif token == "]]":
            out.append(")?")
        elif region:
            out.append(("(?:[0-9]+ )" if region[3] else "(?:[^ ]+ )") + f"{{{region[1]},{region[2]}}}")
        else:
            out.append(re.escape(token) + " ")
    return re.compile("".join(out))


def accepted(markup, own):
    """Starts at which some end is accepted, with the longest one, by trying all of them."""
    pattern, found = as_pattern(markup), {}
    for i in range(len(own)):
        for j in range(len(own), i, -1):
            if pattern.fullmatch("".join(w + " " for w in own[i:j])):
                found[i] = j
                break
    return found


def leftmost(found):
    out, free = [], 0
    for i in sorted(found):
        if i >= free:
            out.append((i, found[i]))
            free = found[i]
    return out


MARKUPS = ["a b [[c]] d", "a [[b [[c]] ]] <<x:0..3>> d", "[[a]] b <<n:1..2:digits>> [[c]]", "a <<x:2..4>> b", "c c"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d", "7", "12", "e"]), max_size=14))
def test_automaton_equals_patterns(own):
    auto = Automaton([(m, m, False) for m in MARKUPS])
    for piece in (1, 5, 1000):
        n, found = auto.scan(" ".join(own).encode(), piece)
        assert n == len(own)
        for m in MARKUPS:
            assert [(f.start, f.stop) for f in found if f.label == m] == leftmost(accepted(m, own))


@pytest.mark.parametrize("markup", ["[[a]]", "<<x:0..2>> a", "a [[b", "a ]]", "a << b", "<<x:3..1>> a"])
def test_broken_markup(markup):
    with pytest.raises(ValueError):
        Automaton([("x", markup, False)])


def filled(markup, optional):
    """A text of the template: with or without its optional regions, replaceable ones filled."""
    text = re.sub(r"<<\w+:(\d+)\.\.(\d+)(:digits)?>>", lambda m: " ".join(["7" if m[3] else "Ünder"] * int(m[2])), markup)
    while "[[" in text:
        text = re.sub(r"\[\[([^\[\]]*)\]\]", lambda m: m[1] if optional else " ", text)
    return text


TEXTS = [
    None, "", " ", "...", "MIT License", "mit license", "the MIT-License, the mit license; MIT\nLicense", "mitlicense mit licenses",
    "CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.", "gnu general public licence", "gnu gnu general public license",
    "GNU Lesser General Public License, version 2.1 or any later version", "mit Kicense", "İ cc by é", "apache license version 3",
    "x " * 70_000 + "apache license" + " y" * 70_000, "word" * 50_000, "cc by " * 30_000, "permission " * 20_000,
]


@pytest.mark.parametrize("piece", [licenses.PIECE, 64])
def test_scan(spark, piece):
    texts = TEXTS + [filled(m, o) for _, m in TEMPLATES for o in (False, True)] + ["mit license"] * 3
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)] + [(None, "mit license", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("labels", F.lit(1)).withColumn("score", F.lit("?")).withColumn("spans", F.lit(0))
    got = licenses.scan(docs, piece=piece).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "mit license"
        places = base_places(text)
        assert r["n_words"] == len(words(text)) and r["n_base"] == len(places)
        assert r["first_word"] == (places[0][0] if places else None) and r["last_word"] == (places[-1][0] if places else None)
        base = sorted({label for _, label in places})
        assert r["base_labels"] == ",".join(base)
        own = r["labels"].split(",") if r["labels"] else []
        assert own == sorted(set(own)) and set(base) <= set(own)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(own)
        assert {s["label"] for s in r["spans"]} == set(own)
        at = (r["doc_id"] or 0) - len(TEXTS)
        if r["doc_id"] is not None and 0 <= at < 2 * len(TEMPLATES):
            label = TEMPLATES[at // 2][0]
            assert any(s["label"] == label and (s["start"], s["stop"]) == (0, len(words(text))) for s in r["spans"])


def test_labels_of_notices(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(TEXTS)], DOCS)
    labels = {TEXTS[r["doc_id"]]: r["labels"] for r in licenses.scan(docs).collect()}
    assert labels["CC BY-NC 4.0."] == "cc-by,cc-by-nc-4.0"
    assert labels["Licensed under the Apache License, Version 2.0."] == "apache,apache-2.0"
    assert labels["This work is licensed under the GNU General Public License, version 3."] == "gpl,gpl-3.0"
    assert labels["GNU Lesser General Public License, version 2.1 or any later version"] == "lgpl-2.1"
    assert labels["apache license version 3"] == "apache" and labels["gnu general public licence"] == ""
    # one mandatory word changed: the template no longer accepts
    mit = filled(TEMPLATES[0][1], True)
    changed = mit.replace("hereby granted", "hereby denied")
    both = licenses.scan(spark.createDataFrame([(1, mit, "", "", 0), (2, changed, "", "", 0)], DOCS)).orderBy("doc_id").collect()
    assert [r["labels"] for r in both] == ["mit", ""]


def test_scan_of_an_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
