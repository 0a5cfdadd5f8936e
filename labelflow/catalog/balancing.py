"""Class balance reports, weights, advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.catalog.registry import query
from labelflow.catalog.views import Tables, r6, sql
from labelflow.functions import vocab
from labelflow.functions.labels import encode_expr
from labelflow.operators import balance as b

COUNTS = """
    SELECT coalesce(lang, 'all') AS split, y_true AS label, count(*) AS n
    FROM predictions GROUP BY GROUPING SETS ((lang, y_true), (y_true))"""


def counts(t: Tables):
    return b.split_label_counts(t.predictions, "y_true", "lang").withColumnRenamed("lang", "split")


@query("label_counts_a14", sql(COUNTS, "predictions"))
def label_counts(t: Tables):
    return counts(t)


@query(
    "balance_report_a11_a12_a14",
    sql(
        """SELECT split, total, classes, round_even(ir, 4) AS imbalance_ratio,
                  round_even(majority, 2) AS majority_class_pct,
                  CASE WHEN ir < 1.5 THEN 'balanced' WHEN ir < 3 THEN 'mildly imbalanced'
                       WHEN ir < 10 THEN 'moderately imbalanced' ELSE 'severely imbalanced' END AS status
           FROM (SELECT split, sum(n)::BIGINT AS total, count(*) AS classes,
                        max(n)::DOUBLE / min(n) AS ir, max(n)::DOUBLE / sum(n) * 100 AS majority
                 FROM counts GROUP BY 1)""",
        "predictions",
        extra={"counts": COUNTS},
    ),
)
def balance_report(t: Tables):
    return b.balance_report(t.predictions, "y_true", "lang")


def sql_report(counts_cte: str, labels, by: str) -> str:
    """Classification report rows per group from a counts table (by, y_true, y_pred, n)."""
    names = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    listed = ", ".join(f"'{x}'" for x in labels)
    return f"""
        WITH g AS (SELECT DISTINCT {by} FROM {counts_cte}),
        sc AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
                      CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
                      CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1
               FROM (SELECT g.{by}, l.label,
                      coalesce(sum(n) FILTER (y_true = l.label AND y_pred = l.label), 0)::DOUBLE AS tp,
                      coalesce(sum(n) FILTER (y_pred = l.label), 0)::DOUBLE AS predicted,
                      coalesce(sum(n) FILTER (y_true = l.label), 0)::DOUBLE AS support
                     FROM g, (SELECT unnest({names}) AS label) l
                     JOIN {counts_cte} c ON c.{by} = g.{by} GROUP BY 1, 2)),
        mi AS (SELECT {by}, bool_and(y_true IN ({listed}) AND y_pred IN ({listed})) AS covered,
                      coalesce(sum(n) FILTER (y_true = y_pred AND y_true IN ({listed})), 0)::DOUBLE AS tp,
                      coalesce(sum(n) FILTER (y_pred IN ({listed})), 0)::DOUBLE AS predicted,
                      coalesce(sum(n) FILTER (y_true IN ({listed})), 0)::DOUBLE AS support
               FROM {counts_cte} GROUP BY 1),
        rows AS (
            SELECT {by}, label AS row, precision, recall, f1, support FROM sc
            UNION ALL SELECT {by}, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM sc GROUP BY 1
            UNION ALL SELECT {by}, 'weighted avg', sum(precision * support) / sum(support),
                sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM sc GROUP BY 1
            UNION ALL SELECT {by}, CASE WHEN covered THEN 'accuracy' ELSE 'micro avg' END, tp / predicted,
                tp / support, 2 * tp / (predicted + support), support FROM mi)
        SELECT {by}, row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
               support::BIGINT AS support FROM rows"""


def rounded_report(df, by):
    return df.select(
        by, "row", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@query(
    "majority_baseline_a13",
    sql(
        "SELECT * FROM report",
        "predictions",
        extra={
            "counts": COUNTS,
            "pairs": """SELECT split, label AS y_true, n,
                first(label) OVER (PARTITION BY split ORDER BY n DESC, label) AS y_pred FROM counts""",
            "report": sql_report("pairs", sorted(vocab.SENTIMENTS), "split"),
        },
    ),
)
def majority_baseline(t: Tables):
    out = b.majority_baseline(counts(t), sorted(vocab.SENTIMENTS))
    return rounded_report(out, "split")


CLASS_IDS = """
    SELECT id, CASE y_true WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS label FROM predictions"""
WEIGHTS = f"""
    SELECT i AS label_id, (CASE WHEN c IS NULL THEN 1.0 ELSE n::DOUBLE / (present * c) END)::FLOAT AS weight
    FROM (SELECT unnest(range(4))::INTEGER AS i)
    LEFT JOIN (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n, count(*) OVER () AS present
               FROM ({CLASS_IDS}) GROUP BY 1) ON i = label"""


def class_ids(t: Tables):
    return t.predictions.select(
        "id", encode_expr(F.col("y_true"), vocab.MODEL_SENTIMENTS).cast("int").alias("label")
    )


@query(
    "class_weights_a10",
    sql("SELECT label_id, round(weight::DOUBLE, 5) AS weight FROM w", "predictions", extra={"w": WEIGHTS}),
)
def class_weights(t: Tables):
    """Four ids, so one class is absent and gets weight 1."""
    out = b.class_weights(class_ids(t), "label", 4)
    return out.select("label_id", F.round(F.col("weight").cast("double"), 5).alias("weight"))


@query(
    "attach_weights_j9",
    sql(
        f"""SELECT id, label, round(weight::DOUBLE, 5) AS weight FROM ({CLASS_IDS}) c
            JOIN w ON c.label = w.label_id""",
        "predictions",
        extra={"w": WEIGHTS},
    ),
)
def attach_weights(t: Tables):
    rows = class_ids(t)
    out = b.attach_weights(rows, "label", b.class_weights(rows, "label", 4))
    return out.select("id", "label", F.round(F.col("weight").cast("double"), 5).alias("weight"))


@query(
    "imbalance_advice_a15",
    sql(
        """SELECT lang, label, n, round(pct, 6) AS pct, round(ratio, 6) AS ratio, ratio > 3 AS alert,
                  CASE WHEN ratio > 3 THEN round(w, 6) END AS weight,
                  CASE WHEN ratio > 3 THEN CASE WHEN w >= 2 THEN 'strong' WHEN w > 1 THEN 'mild'
                       ELSE 'reduce' END END AS impact
           FROM (SELECT lang, label, n, n * 100.0::DOUBLE / sum(n) OVER g AS pct,
                        max(n) OVER g / min(n) OVER g AS ratio, sum(n) OVER g / (count(*) OVER g * n) AS w
                 FROM (SELECT lang, y_true AS label, count(*)::DOUBLE AS n FROM predictions GROUP BY 1, 2)
                 WINDOW g AS (PARTITION BY lang))""",
        "predictions",
    ).replace("label, n, round(pct", "label, n::BIGINT AS n, round(pct"),
)
def imbalance_advice(t: Tables):
    out = b.imbalance_advice(t.predictions, "y_true", ["lang"])
    return out.select(
        "lang",
        "label",
        "n",
        r6(F.col("pct")).alias("pct"),
        r6(F.col("ratio")).alias("ratio"),
        "alert",
        r6(F.col("weight")).alias("weight"),
        "impact",
    )
