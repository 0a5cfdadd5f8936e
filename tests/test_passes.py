"""Passes with model selection, next to a plain loop over the same shards."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelflow.catalog import QUERIES
from labelflow.functions import vocab
from labelflow.operators.balance import attach_weights, class_weights
from labelflow.operators.scoring import linear_logits
from labelflow.plans import passes as ps
from labelflow.plans import training as tr

CLASSES = vocab.MODEL_SENTIMENTS
TASK = tr.get_task("sentiment")
SCHEMA = "id string, text string, label int, weight double"


def labelled(n=240, seed=7):
    """Labels follow one word of the text; the rest is noise."""
    draw = np.random.default_rng(seed)
    words = ("awful", "plain", "lovely")
    rows = []
    for i in range(n):
        label = int(draw.choice(3, p=[0.2, 0.6, 0.2]))
        noise = " ".join(f"w{draw.integers(30)}" for _ in range(6))
        rows.append((f"r{i}", f"{noise} {words[label]}", label, 1.0 + label))
    return rows


def plain_pass(rows, total, model, rate):
    """One pass by plain loops: rows is a list of (shard, label, weight, places) in order."""
    features, after = model.shape[0] - 1, model.copy()
    for shard in sorted({r[0] for r in rows}):
        w, sums, mine, mass = model.copy(), np.zeros_like(model), [r for r in rows if r[0] == shard], 0.0
        for low in range(0, len(mine), ps.BLOCK):
            block = mine[low : low + ps.BLOCK]
            whole = sum(r[2] for r in block)
            grad = np.zeros_like(w)
            for _, label, weight, places in block:
                value = 1 / np.sqrt(max(len(places), 1))
                logits = w[features] + sum((w[a] * value for a in places), np.zeros(w.shape[1]))
                p = np.exp(logits - logits.max())
                gap = (p / p.sum() - np.eye(w.shape[1])[label]) * weight / whole
                grad[features] += gap
                for a in places:
                    grad[a] += gap * value
            sums += grad**2
            w -= rate * grad / np.sqrt(sums + 1e-8)
            mass += whole
        after += (w - model) * mass / total
    return after


@pytest.mark.parametrize("shards", [1, 5])
def test_passes_equal_a_plain_loop(spark, shards):
    df = spark.createDataFrame(labelled(), SCHEMA).repartition(3)
    dealt, total = ps.deal_train_rows(df, 256, shards)
    rows = [(r["shard"], r["label"], r["weight"], r["at"]) for r in dealt.orderBy("shard", "key", "id").collect()]
    assert total == pytest.approx(sum(r[3] for r in labelled()))
    model = want = np.zeros((257, 3))
    for at in (1, 2):
        model = ps.one_pass(dealt, total, model, 0.5 / at)
        want = plain_pass(rows, total, want, 0.5 / at)
        assert np.allclose(model, want, atol=1e-9)


def test_best_pass_beats_the_majority_class(spark):
    rows = labelled(400)
    train, held = spark.createDataFrame(rows[:300], SCHEMA), spark.createDataFrame(rows[300:], SCHEMA)
    got = ps.select_model(train, held, TASK, features=1 << 10, passes=5, patience=2, shards=3)
    shares = [sum(r[2] == c for r in rows[300:]) for c in range(3)]
    majority = 2 * max(shares) / (100 + max(shares)) / 3
    best = max(h["f1_macro"] for h in got.history)
    assert best > 0.95 > majority and got.history[got.best_pass - 1]["f1_macro"] == best
    scores = got.scores(spark).orderBy("pass").collect()
    assert [r["pass"] for r in scores if r["best"]] == [got.best_pass] and all(r["rows"] == 100 for r in scores)
    out = got.predict(held).select("label", "y_pred", F.size("probs").alias("n")).collect()
    assert all(r["n"] == 3 for r in out) and np.mean([CLASSES[r["label"]] == r["y_pred"] for r in out]) > 0.95


def test_copies_count_as_weight(spark):
    rows = [(*r[:3], 1.0) for r in labelled(60)]
    copied = spark.createDataFrame(rows + rows[:1] * 500, SCHEMA)
    weighed = spark.createDataFrame([(*rows[0][:3], 501.0), *rows[1:]], SCHEMA)
    a, b = (ps.deal_train_rows(df, 64, 2) for df in (copied, weighed))
    assert a[0].count() == 60 and a[1] == b[1] == 560.0
    zero = np.zeros((65, 3))
    assert np.allclose(ps.one_pass(*a, zero, 0.5), ps.one_pass(*b, zero, 0.5))


def test_early_stop_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    odd = spark.createDataFrame([("a", None, 0, 1.0), ("b", "", 1, 1.0), (None, "x " * 20000, 2, 1.0)], SCHEMA)
    got = ps.select_model(empty, odd, TASK, features=16, passes=6, patience=2)
    assert len(got.history) == 3 and got.best_pass == 1 and not got.model.any()
    got = ps.select_model(odd, empty, TASK, features=16, passes=2)
    assert got.best_pass == 1 and got.history[0]["rows"] == 0 and got.history[0]["f1_macro"] is None
    assert np.isfinite(got.model).all()
    for wrong in ({"by": "recall"}, {"passes": 0}):
        with pytest.raises(ValueError):
            ps.select_model(odd, odd, TASK, **wrong)


def test_fit_selected_keeps_validation_apart(frame):
    words = {"negative": "bad awful", "neutral": "meh plain", "positive": "good fine"}
    rows = [(f"r{i}", f"{words[list(words)[i % 3]]} number {i}", list(words)[i % 3], "en") for i in range(90)]
    got = ps.fit_selected(frame("id string, text string, label string, lang string", *rows), "sentiment", features=1 << 10, passes=4)
    assert got.test.count() == 9 and got.validation.count() == 9
    assert not got.test.select("id").intersect(got.validation.select("id")).count()
    assert got.history[got.best_pass - 1]["f1_macro"] > 0.9


def test_registered_passes_beat_the_majority(spark):
    rows = QUERIES["pass_scores_m4"](spark, "/root/testdata/sf0.001").collect()
    kept = [r for r in rows if r["best"]]
    assert len(kept) == 1 and kept[0]["f1_macro"] == max(r["f1_macro"] for r in rows) and kept[0]["beats_majority"]


def test_fit_rows_are_dealt_evenly(spark):
    """However the rows came in, a fit's tasks hold about the asked number of characters each."""
    rows = spark.range(64).select(F.repeat(F.lit("word "), 20).alias("text"), F.lit(0).alias("label")).coalesce(1)
    sizes = [r["n"] for r in tr.deal_by_size(rows, chars=800).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 64 and max(sizes) <= 16


def test_class_weights_do_not_shuffle_the_rows(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 2).cast("int").alias("label"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        out = attach_weights(rows, "label", class_weights(rows, "label", 3))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r["label"], r["weight"]) for r in out.collect()} == {(0, 1.0), (1, 1.0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_hashed_once_not_per_token(spark):
    texts = spark.createDataFrame([("1", "good food good"), ("2", None)], "sentence_id string, text string")
    weights = spark.createDataFrame([("good", 1.0, 0.0, 0.0)], "token string, " + ", ".join(f"{c} double" for c in CLASSES))
    out = linear_logits(texts, weights, CLASSES, (0.0, 0.5, 0.0))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("xxhash64(text") > plan.index("Generate posexplode")
    assert {r["sentence_id"]: r["logits"] for r in out.collect()} == {"1": [2.0, 0.5, 0.0], "2": [0.0, 0.5, 0.0]}
