"""Class balance: counts, shares, imbalance ratio, weights, advice. All from one grouped count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions import vocab
from labelflow.operators.metrics import ALL, classification_report
from labelflow.session import materialize


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, n, pct); a missing label counts as ``<null_or_na>``."""
    label = F.coalesce(F.col(col).cast("string"), F.lit(vocab.NULL_LABEL))
    counts = df.groupBy(*by, label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # The window runs over the few count rows, not over the data.
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return counts.withColumn("pct", F.col("n") / total * 100.0)


def split_label_counts(df: DataFrame, label_col: str, split_col: str = "split") -> DataFrame:
    """(split, label, n) for each split and for ``all``; missing labels are left out."""
    return (
        df.filter(F.col(label_col).isNotNull())
        .groupingSets(
            [[F.col(split_col), F.col(label_col)], [F.col(label_col)]], split_col, label_col
        )
        .agg(F.count(F.lit(1)).alias("n"), F.grouping(split_col).alias("__total"))
        .select(
            F.when(F.col("__total") == 1, ALL).otherwise(F.col(split_col)).alias("split"),
            F.col(label_col).cast("string").alias("label"),
            "n",
        )
    )


def band(ir: Column) -> Column:
    return (
        F.when(ir < 1.5, "balanced")
        .when(ir < 3.0, "mildly imbalanced")
        .when(ir < 10.0, "moderately imbalanced")
        .otherwise("severely imbalanced")
    )


def balance_summary(counts: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Total, imbalance ratio (infinite when a class is empty), majority share and band per group."""
    lo, hi, total = F.min("n"), F.max("n"), F.sum("n")
    out = counts.groupBy(*by).agg(
        total.alias("total"),
        F.count(F.lit(1)).alias("classes"),
        F.when(lo == 0, F.lit(float("inf")))
        .otherwise(hi.cast("double") / F.nullif(lo, F.lit(0)))
        .alias("ir"),
        F.when(total == 0, F.lit(0.0))
        .otherwise(hi / F.nullif(total, F.lit(0)) * 100.0)
        .alias("majority"),
    )
    return out.select(
        *by,
        "total",
        "classes",
        F.bround("ir", 4).alias("imbalance_ratio"),
        F.bround("majority", 2).alias("majority_class_pct"),
        band(F.col("ir")).alias("status"),
    )


def balance_report(df: DataFrame, label_col: str, split_col: str = "split") -> DataFrame:
    return balance_summary(split_label_counts(df, label_col, split_col))


def majority_baseline(
    counts: DataFrame, labels: Sequence[str], by: Sequence[str] = ("split",)
) -> DataFrame:
    """Classification report of always predicting the largest class (ties: smaller label)."""
    largest = Window.partitionBy(*by).orderBy(F.desc("n"), "label")
    pairs = counts.select(
        *by,
        F.col("label").alias("y_true"),
        F.first("label").over(largest).alias("y_pred"),
        "n",
    )
    return classification_report(pairs, labels, by)


def class_weights(df: DataFrame, label_col: str, num_labels: int) -> DataFrame:
    """(label_id, weight FLOAT) for ids 0..num_labels-1: N / (present classes * n), absent classes 1.

    With fewer than two classes present all weights are 1.
    """
    counts = (
        df.filter(F.col(label_col).isNotNull())
        .groupBy(F.col(label_col).cast("int").alias("label_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ids = df.sparkSession.range(num_labels).select(
        F.col("id").cast("int").alias("label_id"), F.lit(0).cast("long").alias("n")
    )
    # Zero rows for every id take the place of an outer join; then windows over num_labels rows.
    every = counts.unionByName(ids).groupBy("label_id").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(whole)
    present = F.sum((F.col("n") > 0).cast("long")).over(whole)
    weight = F.when((F.col("n") == 0) | (present < 2), F.lit(1.0)).otherwise(
        total.cast("double") / F.nullif(present * F.col("n"), F.lit(0))
    )
    return every.select("label_id", weight.cast("float").alias("weight"))


def attach_weights(df: DataFrame, label_col: str, weights: DataFrame) -> DataFrame:
    """Add ``weight``; ``weights`` has one row per class id (see :func:`class_weights`).

    The weights are written and read back, so their size is known and the rows are not shuffled by class.
    """
    w = materialize(weights.withColumnRenamed("label_id", "__id"), "class-weights")
    return df.join(w, F.col(label_col) == F.col("__id"), "left").drop("__id")


def imbalance_advice(
    df: DataFrame, label_col: str, by: Sequence[str] = (), threshold: float = 3.0
) -> DataFrame:
    """Per class: count, share, group ratio, alert, and - only under an alert - weight and its effect."""
    counts = df.filter(F.col(label_col).isNotNull()).groupBy(
        *by, F.col(label_col).cast("string").alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    total, classes = F.sum("n").over(group), F.count(F.lit(1)).over(group)
    shares = counts.select(
        *by,
        "label",
        "n",
        (F.col("n") / total * 100.0).alias("pct"),
        (F.max("n").over(group) / F.min("n").over(group)).alias("ratio"),
        (total / (classes * F.col("n"))).alias("w"),
    )
    alert = F.col("ratio") > threshold
    return shares.select(
        *by,
        "label",
        "n",
        "pct",
        "ratio",
        alert.alias("alert"),
        F.when(alert, F.col("w")).alias("weight"),
        F.when(
            alert,
            F.when(F.col("w") >= 2.0, "strong").when(F.col("w") > 1.0, "mild").otherwise("reduce"),
        ).alias("impact"),
    )
