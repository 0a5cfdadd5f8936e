"""Classification metrics, planned as one chain: scan, grouped count, one wide row per slice, arithmetic.

``confusion_counts`` is a plain grouped count (map-side combined, skew-safe). ``score_rows`` folds its few
rows into one row per slice with an array entry per label. Every metric is then row arithmetic on that row,
so the predictions are read once however many metrics are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "all"


def ratio(num: Column, den: Column) -> Column:
    """num/den, 0 when the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / F.nullif(den, F.lit(0)))


def confusion_counts(
    df: DataFrame, by: Sequence[str] = (), truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """(by..., y_true, y_pred, n)."""
    return df.groupBy(*by, F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def sliced_counts(df: DataFrame, slice_col: str) -> DataFrame:
    """Counts per slice plus the slice ``all``, in one pass."""
    counts = confusion_counts(df, [slice_col]).withColumnRenamed(slice_col, "slice")
    both = F.explode(F.array(F.col("slice").cast("string"), F.lit(ALL)))
    return (
        counts.select(both.alias("slice"), "y_true", "y_pred", "n")
        .groupBy("slice", "y_true", "y_pred")
        .agg(F.sum("n").alias("n"))
    )


def score_rows(
    counts: DataFrame, labels: Sequence[str], by: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """One row per slice: n_samples, hits, covered, and per label tp, predicted, support, matrix.

    ``labels`` is a closed, small set. ``matrix`` keeps only pairs inside it; rows whose other side lies
    outside still count in ``predicted`` and ``support``. ``covered``: no label outside the set occurs.
    """
    t, p, n = F.col("y_true"), F.col("y_pred"), F.col("n")

    def total(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, n)), F.lit(0)).cast("long")

    inside = F.coalesce(t.isin(*labels) & p.isin(*labels), F.lit(False))
    return counts.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_samples"),
        total(t == p).alias("hits"),
        F.coalesce(F.min(inside), F.lit(True)).alias("covered"),
        F.array(*[total((t == x) & (p == x)) for x in labels]).alias("tp"),
        F.array(*[total(p == x) for x in labels]).alias("predicted"),
        F.array(*[total(t == x) for x in labels]).alias("support"),
        F.array(*[F.array(*[total((t == x) & (p == y)) for y in labels]) for x in labels]).alias(
            "matrix"
        ),
        *extra,
    )


def _per_label(of) -> Column:
    """Array with ``of(tp, predicted, support)`` for each label of a score row."""
    return F.transform(
        F.arrays_zip("tp", "predicted", "support"), lambda r: of(r["tp"], r["predicted"], r["support"])
    )


def _precision() -> Column:
    return _per_label(lambda tp, predicted, support: ratio(tp, predicted))


def _recall() -> Column:
    return _per_label(lambda tp, predicted, support: ratio(tp, support))


def _f1() -> Column:
    return _per_label(lambda tp, predicted, support: ratio(2 * tp, predicted + support))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _mean(values: Column) -> Column:
    return ratio(_sum(values), F.size(values))


def _active_f1() -> Column:
    """Mean F1 of the labels seen on either side."""
    seen = F.filter(
        F.arrays_zip("tp", "predicted", "support"), lambda r: (r["predicted"] + r["support"]) > 0
    )
    return _mean(F.transform(seen, lambda r: ratio(2 * r["tp"], r["predicted"] + r["support"])))


def confusion_matrix(
    counts: DataFrame, labels: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Long matrix (by..., true_pos, y_true, pred_pos, y_pred, n), zero cells included.

    Pairs with a label outside ``labels`` are dropped.
    """
    cells = [
        F.struct(
            F.lit(i).alias("true_pos"),
            F.lit(t).alias("y_true"),
            F.lit(j).alias("pred_pos"),
            F.lit(p).alias("y_pred"),
            F.get(F.get("matrix", F.lit(i)), F.lit(j)).alias("n"),
        )
        for i, t in enumerate(labels)
        for j, p in enumerate(labels)
    ]
    return score_rows(counts, labels, by).select(*by, F.inline(F.array(*cells)))


def label_scores(
    counts: DataFrame, labels: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., label, tp, predicted, support, precision, recall, f1) for every label, absent ones as 0."""
    return _label_rows(score_rows(counts, labels, by), labels, by)


def _label_rows(rows: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    zipped = F.arrays_zip(
        F.array(*[F.lit(x) for x in labels]).alias("label"),
        F.col("tp"),
        F.col("predicted"),
        F.col("support"),
        _precision().alias("precision"),
        _recall().alias("recall"),
        _f1().alias("f1"),
    )
    return rows.select(*by, F.inline(zipped))


def macro_scores(
    counts: DataFrame, labels: Sequence[str], by: Sequence[str] = (), active_only: bool = False
) -> DataFrame:
    """Unweighted means over ``labels``; ``active_only`` averages labels seen on either side only."""
    scores = label_scores(counts, labels, by)
    if active_only:
        scores = scores.filter((F.col("predicted") > 0) | (F.col("support") > 0))
    return scores.groupBy(*by).agg(
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def classification_report(
    counts: DataFrame, labels: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., row, precision, recall, f1, support): labels, then accuracy, macro avg, weighted avg.

    The row ``accuracy`` becomes ``micro avg`` when some label in the data is not listed.
    """
    rows = score_rows(counts, labels, by).select(
        "*", _precision().alias("precision"), _recall().alias("recall"), _f1().alias("f1")
    )
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)
    rows = rows.withColumns({"all_tp": whole("tp"), "all_p": whole("predicted"), "all_s": whole("support")})
    scores = ("precision", "recall", "f1")

    def line(name: Column, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(
            name.alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"), support.alias("support")
        )

    at = lambda c, i: F.get(c, F.lit(i))
    lines = [
        line(F.lit(x), *[at(c, i) for c in scores], at("support", i)) for i, x in enumerate(labels)
    ]
    tp, predicted, support = F.col("all_tp"), F.col("all_p"), F.col("all_s")
    lines.append(
        line(
            F.when(F.col("covered"), "accuracy").otherwise("micro avg"),
            ratio(tp, predicted),
            ratio(tp, support),
            ratio(2 * tp, predicted + support),
            support,
        )
    )
    lines.append(line(F.lit("macro avg"), *[_mean(F.col(c)) for c in scores], support))
    weighted = [
        ratio(_sum(F.zip_with(c, "support", lambda v, s: v * s)), support) for c in scores
    ]
    lines.append(line(F.lit("weighted avg"), *weighted, support))
    return rows.select(*by, F.inline(F.array(*lines)))


def slice_f1(counts: DataFrame, labels: Sequence[str], slice_col: str = "slice") -> DataFrame:
    """Macro F1 per slice over the labels active in that slice."""
    return score_rows(counts, labels, [slice_col]).select(slice_col, _active_f1().alias("f1_macro"))


def slice_gap(per_slice: DataFrame, value: str = "f1_macro") -> DataFrame:
    return per_slice.agg(F.coalesce(F.max(value) - F.min(value), F.lit(0.0)).alias("gap"))


def sliced_metrics(df: DataFrame, slice_col: str, labels: Sequence[str]) -> DataFrame:
    """One row per slice and one for ``all``: samples, accuracy, macro F1, matrix.

    Slices average over their active labels, ``all`` over every label.
    """
    rows = score_rows(sliced_counts(df, slice_col), labels, ["slice"])
    return rows.select(
        "slice",
        "n_samples",
        ratio(F.col("hits"), F.col("n_samples")).alias("accuracy"),
        F.when(F.col("slice") == ALL, _mean(_f1())).otherwise(_active_f1()).alias("f1"),
        "matrix",
    )


def fairness_payload(df: DataFrame, slice_col: str, labels: Sequence[str]) -> DataFrame:
    """One row: overall F1, F1 per slice, gap, sample counts and matrices."""
    rows = sliced_metrics(df, slice_col, labels)
    is_all = F.col("slice") == ALL

    def per_slice(value: str) -> Column:
        pairs = F.collect_list(F.when(~is_all, F.struct("slice", value)))
        return F.map_from_entries(F.sort_array(pairs))

    lowest, highest = (f(F.when(~is_all, F.col("f1"))) for f in (F.min, F.max))
    return rows.agg(
        F.max(F.when(is_all, F.col("f1"))).alias("overall_f1"),
        per_slice("f1").alias("per_slice_f1"),
        F.coalesce(highest - lowest, F.lit(0.0)).alias("gap"),
        per_slice("n_samples").alias("sample_counts"),
        F.max(F.when(is_all, F.col("matrix"))).alias("confusion_matrix"),
        per_slice("matrix").alias("slice_confusion_matrices"),
    )


def evaluate(
    df: DataFrame, labels: Sequence[str], confidence: str | None = "confidence"
) -> DataFrame:
    """One row: n_samples, accuracy, macro precision, recall and F1, F1 per label, mean confidence, matrix."""
    conf = F.lit(None).cast("double") if confidence is None else F.col(confidence)
    counts = df.groupBy("y_true", "y_pred").agg(
        F.count(F.lit(1)).alias("n"), F.sum(conf).alias("conf")
    )
    rows = score_rows(counts, labels, extra=[F.sum("conf").alias("conf")])
    return rows.select(
        "n_samples",
        ratio(F.col("hits"), F.col("n_samples")).alias("accuracy"),
        (F.col("conf") / F.nullif(F.col("n_samples"), F.lit(0))).alias("mean_confidence"),
        _mean(_precision()).alias("precision_macro"),
        _mean(_recall()).alias("recall_macro"),
        _mean(_f1()).alias("f1_macro"),
        _f1().alias("f1_per_class"),
        "matrix",
    )


def majority_f1(df: DataFrame, label_col: str, labels: int) -> DataFrame:
    """One row: macro F1 over ``labels`` classes of always naming the largest class; null without rows."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    share = F.max("n") / F.sum("n")
    return counts.agg((2 * share / (1 + share) / labels).alias("majority_f1"))


def weighted_log_loss(
    df: DataFrame, label_col: str, probs_col: str, weights: DataFrame
) -> DataFrame:
    """Weighted cross-entropy: sum of w * -ln p[label], divided by the sum of w.

    ``label_col`` is a class id; ``weights`` holds (label_id, weight), one row per class. A label without a weight
    or beyond the probabilities is an error.
    """
    joined = df.join(weights, F.col(label_col) == F.col("label_id"), "left")
    label = F.coalesce(F.col(label_col).cast("string"), F.lit("null"))
    bad = F.raise_error(F.concat(F.lit("log loss: no weight or no probability for label "), label)).cast("double")
    w = F.coalesce(F.col("weight").cast("double"), bad)
    p = F.coalesce(F.get(F.col(probs_col), F.col(label_col)).cast("double"), bad)
    return joined.agg((F.sum(w * -F.ln(p)) / F.sum(w)).alias("log_loss"))


def cohen_kappa(
    sheet: DataFrame, rater_a: str, rater_b: str, id_col: str = "id"
) -> DataFrame:
    """Agreement of two raters on the items both labelled, with the accept/refine/stop gate.

    One grouped pass per item brings both labels together; no self-join.
    """
    pick = lambda who: F.max(F.when(F.col("labeler_id") == who, F.col("label")))
    pairs = (
        sheet.filter(F.col("labeler_id").isin(rater_a, rater_b))
        .groupBy(id_col)
        .agg(pick(rater_a).alias("y_true"), pick(rater_b).alias("y_pred"))
        .filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    )
    zero, n = F.lit(0).cast("long"), F.col("n")
    same = F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(zero)

    def side(label: str, a: Column, b: Column, hit: Column) -> Column:
        return F.struct(F.col(label).alias("label"), a.alias("a"), b.alias("b"), hit.alias("hit"))

    sides = confusion_counts(pairs).select(
        F.inline(F.array(side("y_true", n, zero, same), side("y_pred", zero, n, zero)))
    )
    per_label = sides.groupBy("label").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("hit").alias("hit")
    )
    n = F.sum("a")
    totals = per_label.agg(
        F.coalesce(n, F.lit(0)).alias("n_items"),
        (F.sum("hit") / n).alias("observed"),
        (F.sum(F.col("a").cast("double") * F.col("b")) / (n.cast("double") * n)).alias("expected"),
    )
    kappa = (F.col("observed") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0))
    return totals.withColumn("kappa", kappa).withColumn(
        "gate",
        F.when(F.col("kappa") >= 0.5, "accept")
        .when(F.col("kappa") >= 0.4, "refine")
        .when(F.col("kappa").isNotNull(), "stop"),
    )


def metric_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Compare (scope, metric, value) with (scope, metric, minimum); a missing metric fails."""
    return gates.join(metrics, ["scope", "metric"], "left").select(
        "scope",
        "metric",
        "value",
        "minimum",
        F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False)).alias("passed"),
    )


def compare_runs(base: DataFrame, new: DataFrame, keys: Sequence[str] = ("task", "metric")) -> DataFrame:
    """Full outer pairing of two metric tables with the change in value."""
    b = base.select(*keys, F.col("value").alias("base_value"))
    n = new.select(*keys, F.col("value").alias("new_value"))
    return b.join(n, list(keys), "full").withColumn(
        "delta", F.col("new_value") - F.col("base_value")
    )


def unpivot_metrics(df: DataFrame, scope_cols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric row(s) to (scope..., metric, value)."""
    return df.select(
        *scope_cols,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                    for m in metrics
                ]
            )
        ),
    )
