import pytest
from pyspark.sql import functions as F

from labelflow import Frames
from labelflow.operators import frames as fr
from labelflow.operators.dedup import drop_duplicates_first
from labelflow.functions import text as T
from labelflow.plans.preprocess import BuildConfig, build_dataset, default_steps

S = "sentence_id string, text string, split string"
SL = "sentence_id string, text string, sentiment string, split string"
A = "sentence_id string, aspect_category string, sentiment string"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_label_map(frame):
    a = frame(A, ("1", "anecdotes/miscellaneous", "positive"), ("1", "food", "conflict"), ("2", "food", None))
    out = fr.label_rows(a)
    assert set(rows(out, "aspect_category", "sentiment")) == {("general", "positive"), ("food", None)}


def test_label_map_without_renames(frame):
    a = frame(A, ("1", "ambience", "positive"))
    assert rows(fr.label_rows(a, {}), "aspect_category") == [("ambience",)]


@pytest.mark.parametrize(
    "labels, want",
    [
        (["positive", "negative"], "negative"),
        (["positive"], "positive"),
        (["negative", "negative"], "negative"),
        (["neutral", "neutral"], "neutral"),
        (["positive", "neutral"], "positive"),
        ([None, "neutral"], "neutral"),
        ([None], "neutral"),
        (["odd"], "odd"),
        ([], "neutral"),
    ],
)
def test_sentence_sentiment(frame, labels, want):
    s = frame(S, ("1", "t", "train"))
    a = frame(A, *[("1", "food", x) for x in labels], (None, "food", "negative"), ("9", "food", "negative"))
    assert rows(fr.attach_sentiment(s, a), "sentence_id", "sentiment") == [("1", want)]


def test_sentiment_overwrites_and_rejects_strategy(frame):
    s = frame(SL, ("1", "t", "positive", "train"))
    a = frame(A, ("1", "food", "negative"))
    assert rows(fr.attach_sentiment(s, a), "sentiment") == [("negative",)]
    with pytest.raises(ValueError, match="Unsupported strategy"):
        fr.attach_sentiment(s, a, "majority")
    with pytest.raises(ValueError, match="Unsupported strategy"):
        fr.derive_sentiment("majority")


def test_clean_text(frame):
    s = frame(S, ("1", "", "train"), ("2", "  \t ", "train"), ("3", "  THE Food   was great  \n", "train"), ("4", None, "train"))
    assert rows(fr.clean_rows(s), "sentence_id", "text") == [("3", "the food was great")]
    assert rows(fr.clean_rows(s, lowercase=False), "text") == [("THE Food was great",)]
    kept = dict(rows(fr.clean_rows(s, strip_whitespace=False), "sentence_id", "text"))
    assert kept == {"2": "  \t ", "3": "  the food   was great  \n"}


def test_clean_matches_python(frame):
    texts = ["a b", "x  y", "\x1cz\x1f\x85w ", "Ｗide　space", "ĐỒ ĂN", "﻿bom", "a​b"]
    s = frame(S, *[(str(i), t, "train") for i, t in enumerate(texts)])
    got = dict(rows(fr.clean_rows(s), "sentence_id", "text"))
    assert got == {str(i): " ".join(t.lower().split()) for i, t in enumerate(texts)}


def test_length_filter(frame):
    s = frame(S, ("1", "abc", "x"), ("2", "ab", "x"), ("3", "abcd", "x"), ("4", None, "x"), ("5", "😊😊😊", "x"))
    assert rows(fr.filter_length(s, 3, 3), "sentence_id") == [("1",), ("5",)]


def test_dedup_keeps_first(frame):
    s = frame(S, ("1", "same text", "train"), ("2", "same text", "test"), ("3", None, "x"), ("4", None, "y"))
    out = drop_duplicates_first(s, ["text"])
    assert out.columns == s.columns
    assert rows(out, "sentence_id", "split") == [("1", "train"), ("3", "x")]


def test_dedup_hot_text(spark):
    """A third of the rows share one text; the result does not depend on partitioning."""
    df = spark.range(3000).select(
        F.col("id").alias("row_order"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("text"),
    )
    want = rows(drop_duplicates_first(df.coalesce(1), ["text"]), "row_order")
    assert rows(drop_duplicates_first(df.repartition(7), ["text"]), "row_order") == want
    assert len(want) == 501 and want[0] == (0,)


def test_normalised_dedup(frame):
    s = frame("text string", ("Great food!",), (" great  food! ",), ("dịch vụ tốt",), (None,), ("NaN",))
    out = drop_duplicates_first(s, {"text": T.text_key(F.col("text"))})
    assert rows(out, "row_order", "text") == [(0, "Great food!"), (2, "dịch vụ tốt"), (3, None)]


def test_cascade_matches_missing_ids(frame):
    s = frame(S, ("1", "x", "train"), (None, "y", "train"))
    a = frame(A, ("1", "food", "p"), ("2", "food", "p"), (None, "food", "p"))
    assert rows(fr.cascade(s, a), "row_order") == [(0,), (2,)]
    assert rows(fr.cascade(s.filter("sentence_id = '1'"), a), "row_order") == [(0,)]


def test_run_steps_dedup_cascades(frame):
    s = frame(S, ("1", "same", "train"), ("2", "same", "train"))
    a = frame(A, ("1", "food", "positive"), ("2", "service", "negative"))
    out = fr.run_steps(Frames(s, a), [fr.remove_duplicates()], strict=True).frames
    assert rows(out.aspects, "sentence_id") == [("1",)]


def test_run_steps_cascades_before_a_step_that_reads_aspects(frame):
    s = frame(S, ("1", "ab", "train"), ("2", "abcdef", "train"))
    a = frame(A, ("1", "food", "positive"), ("2", "service", "negative"))
    seen = {}

    def spy(f):
        seen["ids"] = rows(f.aspects, "sentence_id")
        return f

    fr.run_steps(Frames(s, a), [fr.limit_length(3, 10), fr.Step("spy", spy)])
    assert seen["ids"] == [("2",)]


def test_run_steps_counts(frame):
    s = frame(S, ("1", "same", "train"), ("2", "same", "train"), ("3", " ", "train"))
    a = frame(A, ("1", "food", "positive"))
    result = fr.run_steps(Frames(s, a), [fr.clean_text(), fr.remove_duplicates()], count_rows=True)
    result.frames.sentences.collect()
    assert {k: o.get["sentences"] for k, o in result.counts.items()} == {"clean_text": 2, "remove_duplicates": 1}


def test_run_steps_checks(frame):
    s = frame(S, ("1", "x", "train"))
    a = frame(A, ("1", "food", "positive"))
    with pytest.raises(fr.SchemaError, match="input"):
        fr.run_steps(Frames(s.drop("sentence_id"), a), [])
    drop = fr.Step("drop", lambda f: Frames(f.sentences, f.aspects.drop("sentence_id")))
    with pytest.raises(fr.SchemaError, match="after drop"):
        fr.run_steps(Frames(s, a), [drop])
    lose = fr.Step("lose", lambda f: Frames(f.sentences.drop("text"), f.aspects), ("text",))
    with pytest.raises(fr.SchemaError, match=r"required sentence columns: \['text'\]"):
        fr.run_steps(Frames(s, a), [lose])
    with pytest.raises(fr.SchemaError, match="no sentences"):
        fr.run_steps(Frames(s, a), [fr.limit_length(5, 9)], strict=True)


def test_check_schema(frame):
    s, a = frame(S, ("1", "x", "train")), frame(A, ("1", "food", "p"))
    fr.check_schema(Frames(s, a))
    with pytest.raises(fr.SchemaError, match=r"\['split', 'text'\]"):
        fr.check_schema(Frames(s.drop("text", "split"), a))
    with pytest.raises(fr.SchemaError, match="empty"):
        fr.check_schema(Frames(s, a.limit(0)))


def raw_frames(frame, n=60):
    marks = ["positive", "negative", "neutral"]
    s = frame(S, *[(str(i), f"  Review  NUMBER {i % 50} ", "test" if i % 5 == 0 else "train") for i in range(n)])
    a = frame(A, *[(str(i), "ambience", marks[i % 3]) for i in range(n)], ("0", "food", "conflict"))
    return Frames(s, a)


def test_build_equals_steps(frame):
    raw = raw_frames(frame)
    one = build_dataset(raw)
    two = fr.run_steps(raw, default_steps()).frames
    cols = ("sentence_id", "text", "sentiment", "split")
    assert rows(one.sentences, *cols) == rows(two.sentences, *cols)
    assert rows(one.aspects, *A.replace(" string", "").split(", ")) == rows(two.aspects, *A.replace(" string", "").split(", "))
    assert one.sentences.count() == 50
    assert one.sentences.filter("split = 'val'").count() == 4
    orphans = one.aspects.join(one.sentences, "sentence_id", "left_anti")
    assert orphans.count() == 0


def test_build_does_not_depend_on_partitioning(frame):
    raw = raw_frames(frame)
    again = Frames(raw.sentences.repartition(5), raw.aspects.repartition(3))
    cols = ("sentence_id", "split")
    assert rows(build_dataset(raw, stage=False).sentences, *cols) == rows(build_dataset(again).sentences, *cols)


def test_build_without_dedup(frame):
    raw = raw_frames(frame)
    out = build_dataset(raw, BuildConfig(remove_duplicates=False, validation_ratio=0.25))
    assert out.sentences.count() == 60
    assert out.sentences.filter("split = 'val'").count() == 12
