import math

import pytest
from pyspark.sql import functions as F

from labelflow.operators import balance as b
from labelflow.operators import metrics as m

LABELS = ("positive", "negative", "neutral")
TASK = ("negative", "neutral", "positive")
P = "id string, y_true string, y_pred string, lang string, confidence double"


def from_matrix(matrix, labels, lang="en"):
    return [
        (f"{lang}{i}{j}{k}", t, p, lang, 0.5)
        for i, t in enumerate(labels)
        for j, p in enumerate(labels)
        for k in range(matrix[i][j])
    ]


def test_published_baseline(frame):
    matrix = [[440, 16, 45], [10, 141, 33], [29, 16, 69]]
    df = frame(P, *from_matrix(matrix, LABELS))
    row = m.evaluate(df, LABELS).first()
    assert row["n_samples"] == 799
    assert row["accuracy"] == pytest.approx(0.8135168961201502)
    assert row["f1_macro"] == pytest.approx(0.7388702607479773)
    assert row["precision_macro"] == pytest.approx(0.7343323442063419)
    assert row["recall_macro"] == pytest.approx(0.7499370062316252)
    assert row["mean_confidence"] == pytest.approx(0.5)
    assert row["f1_per_class"] == pytest.approx([0.8979591836734694, 0.7899159663865546, 0.5287356321839081])
    assert row["matrix"] == matrix
    empty = m.evaluate(df.limit(0), LABELS).first()
    assert (empty["n_samples"], empty["accuracy"], empty["mean_confidence"]) == (0, 0.0, None)
    report = {r["row"]: r for r in m.classification_report(m.confusion_counts(df), LABELS).collect()}
    assert round(report["weighted avg"]["precision"], 2) == 0.83
    assert report["accuracy"]["f1"] == pytest.approx(0.8135168961201502)
    assert report["neutral"]["support"] == 114


def test_published_fairness(frame):
    en = [[7, 1, 0], [3, 5, 0], [0, 1, 6]]
    vi = [[32, 0, 2], [0, 1, 2], [4, 1, 35]]
    df = frame(P, *from_matrix(en, TASK, "en"), *from_matrix(vi, TASK, "vi"))
    row = m.fairness_payload(df, "lang", TASK).first()
    assert row["overall_f1"] == pytest.approx(0.7925559947299078)
    assert row["per_slice_f1"] == pytest.approx({"en": 0.7891737891737892, "vi": 0.7334538878842677})
    assert row["gap"] == pytest.approx(0.055719901289521534)
    assert row["sample_counts"] == {"en": 23, "vi": 77}
    assert row["slice_confusion_matrices"] == {"en": en, "vi": vi}
    assert row["confusion_matrix"] == [[x + y for x, y in zip(r, s)] for r, s in zip(en, vi)]


def test_active_labels_and_gap(frame):
    t = ["negative", "positive", "neutral", "positive"]
    p = ["negative", "negative", "neutral", "positive"]
    df = frame(P, *[(str(i), a, c, "en" if i < 2 else "vi", 0.5) for i, (a, c) in enumerate(zip(t, p))])
    row = m.fairness_payload(df, "lang", TASK).first()
    assert row["per_slice_f1"] == pytest.approx({"en": 1 / 3, "vi": 1.0})
    assert row["gap"] == pytest.approx(2 / 3)
    assert row["sample_counts"] == {"en": 2, "vi": 2}
    assert len(row["slice_confusion_matrices"]["en"]) == 3


def test_perfect_slices(frame):
    df = frame(P, *[(str(i), x, x, lang, 1.0) for i, (x, lang) in enumerate([("positive", "en"), ("negative", "en"), ("neutral", "vi"), ("positive", "vi")])])
    assert m.fairness_payload(df, "lang", TASK).first()["per_slice_f1"] == {"en": 1.0, "vi": 1.0}


def test_labels_outside_the_list(frame):
    """They leave the matrix but still cost precision and recall; the accuracy row turns into micro avg."""
    df = frame(P, ("1", "odd", "positive", "en", 0.5), ("2", "positive", "odd", "en", 0.5), ("3", "positive", "positive", "en", 0.5))
    counts = m.confusion_counts(df)
    score = {r["label"]: r for r in m.label_scores(counts, LABELS).collect()}
    assert score["positive"]["precision"] == 0.5 and score["positive"]["recall"] == 0.5
    assert score["negative"]["f1"] == 0.0 and score["negative"]["support"] == 0
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in m.confusion_matrix(counts, LABELS).collect()}
    assert len(cells) == 9 and sum(cells.values()) == cells[("positive", "positive")] == 1
    rows = {r["row"] for r in m.classification_report(counts, LABELS).collect()}
    assert "micro avg" in rows and "accuracy" not in rows


def test_weighted_log_loss(frame, spark):
    df = frame("label int, probs array<double>", (0, [0.7, 0.2, 0.1]), (1, [0.3, 0.6, 0.1]), (2, [0.5, 0.25, 0.25]))
    weights = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.5)], "label_id int, weight double")
    want = (1 * -math.log(0.7) + 2 * -math.log(0.6) + 0.5 * -math.log(0.25)) / 3.5
    assert m.weighted_log_loss(df, "label", "probs", weights).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("flips, gate", [(0, "accept"), (8, "accept"), (11, "refine"), (16, "stop")])
def test_kappa_gate(frame, flips, gate):
    rows = []
    for i in range(40):
        a = "x" if i % 2 else "y"
        rows += [(str(i), "a", a), (str(i), "b", ("y" if a == "x" else "x") if i < flips else a)]
    rows.append(("alone", "a", "x"))
    out = m.cohen_kappa(frame("id string, labeler_id string, label string", *rows), "a", "b").first()
    agree = 1 - flips / 40
    assert out["n_items"] == 40 and out["observed"] == pytest.approx(agree)
    expected = out["expected"]
    assert out["kappa"] == pytest.approx((agree - expected) / (1 - expected))
    assert out["gate"] == gate


def test_gates_and_comparison(spark):
    metrics = spark.createDataFrame([("en", "f1", 0.8), ("vi", "f1", 0.4)], "scope string, metric string, value double")
    gates = spark.createDataFrame([("en", "f1", 0.8), ("vi", "f1", 0.45), ("fr", "f1", 0.1)], "scope string, metric string, minimum double")
    assert {r["scope"]: r["passed"] for r in m.metric_gates(metrics, gates).collect()} == {"en": True, "vi": False, "fr": False}
    base = spark.createDataFrame([("s", "f1", 0.5), ("s", "n", 10.0)], "task string, metric string, value double")
    new = spark.createDataFrame([("s", "f1", 0.75), ("t", "f1", 0.5)], "task string, metric string, value double")
    got = {(r["task"], r["metric"]): r["delta"] for r in m.compare_runs(base, new).collect()}
    assert got == {("s", "f1"): 0.25, ("s", "n"): None, ("t", "f1"): None}


def test_published_balance(frame):
    rows = [(x, "train") for x, k in {"negative": 5325, "neutral": 458, "positive": 5643}.items() for _ in range(k)]
    df = frame("label string, split string", *rows)
    row = b.balance_report(df, "label").filter("split = 'all'").first()
    assert (row["total"], row["imbalance_ratio"], row["majority_class_pct"]) == (11426, 12.321, 49.39)
    assert row["status"] == "severely imbalanced"
    report = b.majority_baseline(b.split_label_counts(df, "label"), ["negative", "neutral", "positive"])
    got = {r["row"]: r for r in report.filter("split = 'train'").collect()}
    assert got["positive"]["recall"] == 1.0 and got["negative"]["f1"] == 0.0
    assert got["accuracy"]["precision"] == pytest.approx(5643 / 11426)


def test_published_aspect_balance(frame):
    rows = [(x, "train") for x, k in {"positive": 2179, "negative": 839, "neutral": 500, "conflict": 195}.items() for _ in range(k)]
    df = frame("label string, split string", *rows)
    row = b.balance_report(df, "label").filter("split = 'train'").first()
    assert (row["imbalance_ratio"], row["majority_class_pct"]) == (11.1744, 58.69)
    report = b.majority_baseline(b.split_label_counts(df, "label"), sorted({r[0] for r in rows}))
    got = {r["row"]: r for r in report.filter("split = 'train'").collect()}
    assert got["macro avg"]["f1"] == pytest.approx(0.18491174473863865)
    assert got["weighted avg"]["f1"] == pytest.approx(0.43406699896091766)


def test_bands(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (2.99,), (3.0,), (10.0,), (float("inf"),)], "ir double")
    got = [r[0].split()[0] for r in df.select(b.band(F.col("ir"))).collect()]
    assert got == ["balanced", "mildly", "mildly", "moderately", "severely", "severely"]


@pytest.mark.parametrize(
    "labels, n, want",
    [
        ([0, 0, 0, 1, 1, 1], 2, [1.0, 1.0]),
        ([0, 0, 0, 0, 1, 1], 2, [0.75, 1.5]),
        ([0, 0, 1], 3, [0.75, 1.5, 1.0]),
        ([1, 1, 1], 2, [1.0, 1.0]),
        ([], 3, [1.0, 1.0, 1.0]),
    ],
)
def test_class_weights(frame, labels, n, want):
    df = frame("label int", *[(x,) for x in labels]) if labels else frame("label int", (0,)).limit(0)
    out = b.class_weights(df, "label", n).orderBy("label_id")
    assert [r["weight"] for r in out.collect()] == pytest.approx(want)
    assert dict(out.dtypes)["weight"] == "float"


def test_attach_weights(frame):
    df = frame("label int", (0,), (0,), (0,), (0,), (1,), (1,))
    out = b.attach_weights(df, "label", b.class_weights(df, "label", 2))
    assert sum(r["weight"] for r in out.collect()) == pytest.approx(6.0)


def test_advice(frame):
    df = frame("label string", *[("a",)] * 8, *[("b",)] * 2, (None,))
    got = {r["label"]: r for r in b.imbalance_advice(df, "label").collect()}
    assert got["a"]["ratio"] == 4.0 and got["a"]["impact"] == "reduce" and got["b"]["impact"] == "strong"
    even = b.imbalance_advice(frame("label string", ("a",), ("b",)), "label").collect()
    assert all(not r["alert"] and r["weight"] is None for r in even)
