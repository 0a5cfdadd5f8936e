"""The filter audit against a plain count, and on odd rows."""

from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.llm import interactions

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{i}" for i in range(120))


def failures(rows):
    """Mask per row, from the definition."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
        smaller = any(
            (t or "") == text and i is not None and doc_id is not None and i < doc_id for i, t, *_ in rows
        )
        rules = [
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            any(c in "#$%&*|" for c in text),
            smaller,
        ]
        out.append(sum(1 << i for i, r in enumerate(rules) if r))
    return out


def plain(rows, labels):
    marks = {}
    for doc_id, quality, toxic in labels:
        good, bad = marks.get(doc_id, (False, False))
        marks[doc_id] = (good or quality == 1, bad or toxic == 1)
    masks = failures(rows)
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(m, *marks.get(r[0], (False, False))) for m, r in zip(masks, rows) if (r[2] or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [d for d in left if d[0] & bit]
                left = [d for d in left if not d[0] & bit]
                fails = sum(1 for d in own if d[0] & bit)
                total[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), fails - len(gone), sum(1 for d in own if d[0] == bit),
                    sum(1 for d in gone if d[1]), sum(1 for d in gone if d[2]),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

ROWS = [
    (5, LONG, "en", "a", 1), (3, LONG, "de", "a", 1), (9, LONG, "en", "a", 1), (9, LONG, "en", "a", 1), (3, LONG, "de", "a", 1),
    (None, LONG, "en", None, None), (None, LONG, "en", None, None), (1, None, None, None, None), (2, "", "", "b", 0),
    (4, "SHOUTING text #1", "en", "b", 0), (6, "a a a\ta\na", "fr", None, 0), (7, "word " * 60_000, "fr", "x", 0),
    (8, "é è " * 130, "fr", "x", 0), (10, "AB" + " " * 18, "en", "x", 0), (11, LONG + " $", "en", "x", 0), (12, LONG + " $", None, "x", 0),
]
MARKS = [(3, 1, 0), (3, 0, 1), (5, 1, None), (9, None, 1), (None, 1, 1), (12, 1, 1), (4, 0, 1), (99, 1, 1)]


@pytest.mark.parametrize("parts", [1, 5])
def test_audit_equals_plain_count(spark, parts):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(parts)
    # clashing names: the operator's own columns also exist in the input
    docs = docs.withColumn("part", F.lit("?")).withColumn("digest", F.lit(1)).withColumn("failures", F.lit(7))
    labels = spark.createDataFrame(MARKS, LABELS).withColumn("text", F.lit("x")).withColumn("lang", F.lit("x"))
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in interactions.audit(docs, labels).collect()}
    want = plain(ROWS, MARKS)
    assert set(got) == set(want)
    assert [k for k in want if got[k] != want[k]] == []
    assert len(got) == 600 * 4


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert interactions.audit(docs, labels).count() == 0
    some = interactions.audit(spark.createDataFrame(ROWS[:1], DOCS), labels).collect()
    assert len(some) == 600 and all(r["kept"] == 1 and r["removed"] == 0 and r["good_lost"] == 0 for r in some)


@pytest.mark.parametrize("seed", range(4))
def test_planes_are_positional_popcounts(seed):
    rng = np.random.default_rng(seed)
    planes, want = interactions.Planes(), np.zeros(32, dtype=object)
    for _ in range(rng.integers(1, 30)):
        n = int(rng.integers(0, 900))
        words = rng.integers(0, 1 << 32, size=n, dtype=np.uint32)
        times = rng.choice([1, 2, 3, 1000, 123_456], size=n)
        planes.add(words, times)
        for s in range(32):
            want[s] += int((((words >> np.uint32(s)) & 1).astype(np.int64) * times).sum())
    got = [sum(((w >> s) & 1) << j for j, w in enumerate(planes.words())) for s in range(32)]
    assert got == list(want)


def test_survival_words():
    for failed, word in enumerate(interactions.survival_words(np.arange(32))):
        assert [(int(word) >> s) & 1 for s in range(32)] == [int(s & failed == 0) for s in range(32)]
