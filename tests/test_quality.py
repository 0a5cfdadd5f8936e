import json

import pytest
from pyspark.sql import functions as F

from labelflow import Frames
from labelflow.operators import quality as q
from labelflow.sources import sinks as sk

SL = "sentence_id string, text string, sentiment string, split string"
A = "sentence_id string, aspect_category string, sentiment string"


def sentences(n, sentiment="positive", split="train", text="some text", start=0):
    return [(str(i + start), text, sentiment, split) for i in range(n)]


def aspects(n, category="food", sentiment="positive"):
    return [(str(i), category, sentiment) for i in range(n)]


def report(frame, s, a, **limits):
    result = q.quality_report(Frames(frame(SL, *s), frame(A, *a)), q.QualityLimits(**limits))
    found = {(r["severity"], r["rule"], r["scope"]): r["detail"] for r in result.findings.collect()}
    return result, found, result.report.first()


def test_happy_path(frame):
    _, found, row = report(frame, sentences(200), aspects(200))
    assert row["checks_passed"] and row["errors"] == []
    assert row["total_samples"] == 200
    assert row["splits"]["train"].asDict(True) == {
        "samples": 200, "null_ratio": 0.0, "label_distribution": {"positive": 200},
    }
    assert row["aspect_distribution"] == {"food": 200}
    assert row["text_length_stats"].asDict() == {"mean": 9.0, "min": 9, "max": 9, "median": 9.0, "p95": 9.0}
    assert found[("warning", "missing_sentiment", "split train")]
    json.loads(sk.report_json(q.quality_report(Frames(frame(SL, *sentences(2)), frame(A, *aspects(2)))).report).first()[0])


def test_missing_columns(frame):
    s, a = frame(SL, *sentences(3)), frame(A, *aspects(3))
    result = q.quality_report(Frames(s.drop("text"), a.drop("sentiment")))
    assert {(r["scope"], r["detail"]) for r in result.findings.collect()} == {("sentences", "text"), ("aspects", "sentiment")}
    assert result.report.first()["checks_passed"] is False
    with pytest.raises(ValueError, match="missing_columns"):
        q.require_passed(result)


def test_null_ratio(frame):
    rows = sentences(99) + [("99", None, "positive", "train")]
    _, found, row = report(frame, rows, aspects(100), max_null_ratio=0.005)
    assert found[("error", "null_ratio", "split train")] == "0.010000"
    _, found, row = report(frame, rows, aspects(100), max_null_ratio=0.01)
    assert row["checks_passed"]  # the limit itself is allowed


def test_bad_labels(frame):
    rows = sentences(100) + [("100", "x", "bad_label", "train"), ("101", "x", None, "train")]
    marks = aspects(98) + [("98", "not_a_real_aspect_label", "positive"), ("99", "food", "weird")]
    _, found, _ = report(frame, rows, marks, max_null_ratio=0.5)
    assert found[("error", "invalid_sentence_sentiment", "sentences")] == "bad_label"
    assert found[("error", "invalid_aspect_category", "aspects")] == "not_a_real_aspect_label"
    assert found[("error", "invalid_aspect_sentiment", "aspects")] == "weird"


def test_examples_in_first_seen_order(frame):
    rows = [(str(i), "t", f"z{(7 * i) % 20:02d}", "train") for i in range(20)]
    out = q.invalid_labels(q.sentence_profile(frame(SL, *rows)), "sentiment", ("positive",)).first()
    assert out["invalid"] == 20
    assert out["examples"] == [f"z{(7 * i) % 20:02d}" for i in range(10)]


def test_too_few_rows(frame):
    _, found, _ = report(frame, sentences(80), aspects(80))
    assert found[("error", "min_samples", "dataset")] == "80"
    rows = sentences(40) + sentences(120, split="test", start=40)
    _, found, _ = report(frame, rows, aspects(80))
    assert found[("error", "min_samples", "split train")] == "40"
    assert ("error", "min_samples", "dataset") not in found


def test_missing_split_and_null_sentiment(frame):
    rows = sentences(60) + sentences(40, split=None, start=60)
    _, found, row = report(frame, rows, aspects(100), min_samples=10)
    assert row["splits"]["<missing_split>"]["samples"] == 40
    assert row["splits"]["<missing_split>"]["null_ratio"] == 0.0
    _, found, row = report(frame, sentences(120, sentiment=None), aspects(120))
    assert found[("error", "invalid_sentence_sentiment", "sentences")] == "<null_or_na>"
    assert row["splits"]["train"]["label_distribution"] == {"<null_or_na>": 120}


def test_empty_aspects(frame, spark):
    s = frame(SL, *sentences(120))
    result = q.quality_report(Frames(s, frame(A, *aspects(1)).limit(0)))
    found = {(r["severity"], r["rule"]) for r in result.findings.collect()}
    assert ("error", "no_aspects") in found
    assert not any(rule.endswith("_aspect") for _, rule in found)


def test_orphans(frame):
    marks = aspects(150) + [("missing", "food", "positive"), (None, "food", "positive")]
    _, found, row = report(frame, sentences(150), marks)
    assert found[("error", "orphan_aspects", "aspects")] == "2:missing,nan"
    assert not row["checks_passed"]


def test_underrepresented(frame):
    rows = sentences(300) + sentences(14, "negative", start=300) + sentences(17, "neutral", start=400)
    _, found, row = report(frame, rows, aspects(20))
    assert found[("warning", "underrepresented_sentiment", "split train")] == "negative 14/331"
    assert row["checks_passed"]


def test_published_report(frame):
    """Only one warning: no text about the location."""
    rows, n = [], 0
    for split, counts in {
        "test": (501, 184, 114), "train": (1528, 669, 531), "val": (170, 75, 59),
    }.items():
        for label, k in zip(("positive", "negative", "neutral"), counts):
            rows += sentences(k, label, split, start=n)
            n += k
    marks = []
    for category, k in {"food": 1565, "general": 1313, "service": 728, "ambiance": 489, "price": 384}.items():
        marks += [(str(i % n), category, "positive") for i in range(k)]
    _, found, row = report(frame, rows, marks)
    assert row["total_samples"] == 3831 and row["checks_passed"]
    assert found == {("warning", "missing_aspect", "dataset"): "location 0/4479"}
    assert row["splits"]["val"]["label_distribution"] == {"positive": 170, "negative": 75, "neutral": 59}


def test_length_stats_of_empty_table(frame):
    empty = q.sentence_profile(frame(SL, *sentences(1)).limit(0))
    assert q.text_length_stats(empty).first().asDict() == {"mean": 0.0, "min": 0, "max": 0, "median": 0.0, "p95": 0.0}


def test_report_lists_every_label(frame):
    """No label is folded away, however many there are."""
    rows = [(str(i), "x", f"label {i}", "train") for i in range(1500)]
    result, _, row = report(frame, rows, aspects(10) + aspects(1, "zzz"), min_samples=1, max_null_ratio=1.0)
    assert row["splits"]["train"]["label_distribution"] == {f"label {i}": 1 for i in range(1500)}
    assert row["aspect_distribution"] == {"food": 10, "zzz": 1}
    assert result.labels.where("split = 'train'").count() == 1500
    bad = q.invalid_label_counts(result.profiles[0], "sentiment", ("label 0",))
    assert bad.count() == 1499 and bad.where("n <> 1").isEmpty()


def test_missing_columns_report_has_every_part(frame):
    s, a = frame(SL, *sentences(3)), frame(A, *aspects(3))
    broken = q.quality_report(Frames(s.drop("split"), a)).report
    whole = q.quality_report(Frames(s, a)).report
    assert [(f.name, f.dataType.simpleString()) for f in broken.schema] == [(f.name, f.dataType.simpleString()) for f in whole.schema]
    row = broken.first()
    assert (row["total_samples"], row["splits"], row["aspect_distribution"], row["checks_passed"]) == (3, {}, {}, False)


def test_retention(frame):
    before = frame(SL, *sentences(100))
    assert q.retention_check(before, 85, 80).first().asDict() == {
        "raw_rows": 100, "kept_rows": 85, "loss": pytest.approx(0.15), "enough_rows": True, "loss_ok": True,
    }
    assert not q.retention_check(before, 79, 80).first()["loss_ok"]


def test_quality_metrics_log(frame, spark, tmp_path):
    result = q.quality_report(Frames(frame(SL, *sentences(120)), frame(A, *aspects(120))))
    rows = sk.metric_log_rows(sk.quality_metrics(result.splits, True), "data_preprocessing", "r1")
    tags = {"task": "t", "git_sha": "s", "device": "cpu", "environment": "local", "dataset_version": "v1", "seed": 42, "user": "u"}
    path = str(tmp_path / "log")
    given = sk.run_log_rows(spark, "data_preprocessing", "r1", params={"validation_ratio": 0.1}, tags=tags)
    sk.append_run_log(rows.unionByName(given), path)
    log = {(r["kind"], r["key"]): r["value_num"] if r["kind"] == "metric" else r["value_str"] for r in sk.read_run_log(spark, path).collect()}
    assert log[("metric", "train_samples")] == 120.0 and log[("metric", "passed_quality_checks")] == 1.0
    assert log[("param", "validation_ratio")] == "0.1" and log[("tag", "seed")] == "42"
    with pytest.raises(ValueError, match="missing run tags"):
        sk.run_log_rows(spark, "e", "r", tags={"task": "t"})


def test_run_log_repeats_replace(spark, tmp_path):
    path = str(tmp_path / "log")

    def put(run, experiment="e", **metrics):
        sk.append_run_log(sk.run_log_rows(spark, experiment, run, metrics=metrics), path)

    def seen():
        return sorted((r["experiment"] or "", r["run_id"] or "", r["key"], r["value_num"]) for r in sk.read_run_log(spark, path).collect())

    put("1", a=1.0, b=2.0)
    put("2", a=5.0)
    put("1", "other", a=7.0)
    put(None, "", a=9.0)
    put("1", a=3.0)  # b is gone with the first attempt
    want = [("e", "1", "a", 3.0), ("e", "2", "a", 5.0), ("other", "1", "a", 7.0)]
    assert [r for r in seen() if r[0] in ("e", "other")] == want and len(seen()) == 4
    put(None, "", a=8.0)
    assert [r[3] for r in seen() if r[1] == ""] == [8.0]
    # rows whose job died before the commit record stay invisible
    lost = sk.run_log_rows(spark, "e", "2", metrics={"a": 99.0}).withColumn("attempt", F.lit("0" * 32))
    lost.write.mode("append").partitionBy("experiment", "attempt").parquet(f"{path}/rows")
    assert [r for r in seen() if r[0] == "e"] == want[:2]
    # several runs in one call, then one of them again; no rows are no run
    both = sk.run_log_rows(spark, "e", "3", metrics={"x": 1.0}).unionByName(sk.run_log_rows(spark, "e", "4", metrics={"x": 2.0}))
    sk.append_run_log(both, path)
    put("3", x=4.0)
    put("5")
    assert [(r[1], r[3]) for r in seen() if r[0] == "e" and r[1] > "2"] == [("3", 4.0), ("4", 2.0)]
