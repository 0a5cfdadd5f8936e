"""Classification metrics: overall, per label, by slice, agreement, gates, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.catalog.balancing import CLASS_IDS, WEIGHTS, class_ids, rounded_report, sql_report
from labelflow.catalog.expressions import SQL_PROBS, logits
from labelflow.catalog.registry import query
from labelflow.catalog.views import Tables, r6, sql
from labelflow.functions import probs as P
from labelflow.functions import vocab
from labelflow.operators import balance as b
from labelflow.operators import metrics as m

LABELS = vocab.SENTIMENTS
NAMES = "['positive', 'negative', 'neutral']"
ONE_SLICE = "SELECT 'all' AS slice, y_true, y_pred, count(*) AS n FROM predictions GROUP BY 2, 3"
SLICES = """
    SELECT coalesce({col}, 'all') AS slice, y_true, y_pred, count(*) AS n FROM predictions
    GROUP BY GROUPING SETS (({col}, y_true, y_pred), (y_true, y_pred))"""
BY_LANG = SLICES.format(col="lang")
BY_SOURCE = SLICES.format(col="source")


def sql_scores(counts: str, active: bool = False) -> str:
    """Per (slice, label) scores over the three labels, zeros for absent ones."""
    keep = "WHERE predicted + support > 0" if active else ""
    return f"""
        SELECT slice, label, tp, predicted, support,
               CASE WHEN predicted = 0 THEN 0 ELSE tp::DOUBLE / predicted END AS precision,
               CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall,
               CASE WHEN predicted + support = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (predicted + support) END AS f1
        FROM (SELECT slice, l.label,
                     coalesce(sum(n) FILTER (y_true = label AND y_pred = label), 0)::BIGINT AS tp,
                     coalesce(sum(n) FILTER (y_pred = label), 0)::BIGINT AS predicted,
                     coalesce(sum(n) FILTER (y_true = label), 0)::BIGINT AS support
              FROM {counts}, (SELECT unnest({NAMES}) AS label) l GROUP BY 1, 2) {keep}"""


@query(
    "confusion_matrix_a19",
    sql(
        f"""SELECT t.label AS y_true, p.label AS y_pred,
                   (SELECT count(*) FROM predictions x WHERE x.y_true = t.label AND x.y_pred = p.label) AS n
            FROM (SELECT unnest({NAMES}) AS label) t, (SELECT unnest({NAMES}) AS label) p""",
        "predictions",
    ),
)
def confusion_matrix(t: Tables):
    return m.confusion_matrix(m.confusion_counts(t.predictions), LABELS).select("y_true", "y_pred", "n")


@query(
    "label_scores_a18_a20",
    sql(
        """SELECT label, tp, predicted, support, round(precision, 6) AS precision, round(recall, 6) AS recall,
                  round(f1, 6) AS f1 FROM sc""",
        "predictions",
        extra={"c": ONE_SLICE, "sc": sql_scores("c")},
    ),
)
def label_scores(t: Tables):
    out = m.label_scores(m.confusion_counts(t.predictions), LABELS)
    return out.select(
        "label", "tp", "predicted", "support", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")]
    )


@query(
    "evaluate_a20_a21",
    sql(
        """SELECT (SELECT count(*) FROM predictions) AS n_samples,
                  (SELECT round(avg((y_true = y_pred)::INT), 6) FROM predictions) AS accuracy,
                  (SELECT round(avg(confidence), 6) FROM predictions) AS mean_confidence,
                  round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
                  round(avg(f1), 6) AS f1_macro FROM sc""",
        "predictions",
        extra={"c": ONE_SLICE, "sc": sql_scores("c")},
    ),
)
def evaluate(t: Tables):
    scalars = m.evaluate(t.predictions, LABELS)
    floats = ("accuracy", "mean_confidence", "precision_macro", "recall_macro", "f1_macro")
    return scalars.select("n_samples", *[r6(F.col(c)).alias(c) for c in floats])


@query(
    "classification_report_a18",
    sql("SELECT * FROM report", "predictions", extra={"c": BY_LANG, "report": sql_report("c", LABELS, "slice")}),
)
def classification_report(t: Tables):
    out = m.classification_report(m.sliced_counts(t.predictions, "lang"), LABELS, ["slice"])
    return rounded_report(out, "slice")


@query(
    "classification_report_uncovered_a18",
    sql(
        "SELECT * FROM report",
        "predictions",
        extra={"c": BY_LANG, "report": sql_report("c", ("positive", "neutral"), "slice")},
    ),
)
def classification_report_uncovered(t: Tables):
    """Only two of the three labels listed: the accuracy row becomes a micro average."""
    counts = m.sliced_counts(t.predictions, "lang")
    return rounded_report(m.classification_report(counts, ("positive", "neutral"), ["slice"]), "slice")


def _sliced(col_counts: str) -> dict[str, str]:
    return {"c": col_counts, "sc": sql_scores("c"), "act": sql_scores("c", True)}


FAIRNESS = """
    SELECT a.slice, a.n_samples, round(a.accuracy, 6) AS accuracy,
           round(CASE WHEN a.slice = 'all' THEN f.f1 ELSE g.f1 END, 6) AS f1
    FROM (SELECT slice, sum(n)::BIGINT AS n_samples,
                 coalesce(sum(n) FILTER (y_true = y_pred), 0)::DOUBLE / sum(n) AS accuracy FROM c GROUP BY 1) a
    JOIN (SELECT slice, avg(f1) AS f1 FROM sc GROUP BY 1) f ON a.slice = f.slice
    JOIN (SELECT slice, avg(f1) AS f1 FROM act GROUP BY 1) g ON a.slice = g.slice"""


@query("language_metrics_a22_a23", sql(FAIRNESS, "predictions", extra=_sliced(BY_LANG)))
def language_metrics(t: Tables):
    out = m.sliced_metrics(t.predictions, "lang", LABELS)
    return out.select("slice", "n_samples", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("f1")).alias("f1"))


@query("source_metrics_a37", sql(FAIRNESS, "predictions", extra=_sliced(BY_SOURCE)))
def source_metrics(t: Tables):
    out = m.sliced_metrics(t.predictions, "source", LABELS)
    return out.select("slice", "n_samples", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("f1")).alias("f1"))


@query(
    "language_matrices_a24",
    sql(
        f"""SELECT s.slice, t.label AS y_true, p.label AS y_pred,
                   coalesce((SELECT sum(n) FROM c WHERE c.slice = s.slice AND c.y_true = t.label
                             AND c.y_pred = p.label), 0)::BIGINT AS n
            FROM (SELECT DISTINCT slice FROM c) s, (SELECT unnest({NAMES}) AS label) t,
                 (SELECT unnest({NAMES}) AS label) p""",
        "predictions",
        extra={"c": BY_LANG},
    ),
)
def language_matrices(t: Tables):
    out = m.confusion_matrix(m.sliced_counts(t.predictions, "lang"), LABELS, ["slice"])
    return out.select("slice", "y_true", "y_pred", "n")


@query(
    "fairness_payload_a25_a23",
    sql(
        f"""SELECT s.slice, t.label AS y_true, p.label AS y_pred, s.samples,
                   coalesce((SELECT sum(n) FROM c WHERE c.slice = s.slice AND c.y_true = t.label
                             AND c.y_pred = p.label), 0)::BIGINT AS n,
                   round(CASE WHEN s.slice = 'all' THEN (SELECT avg(f1) FROM sc WHERE sc.slice = 'all')
                              ELSE (SELECT avg(f1) FROM act WHERE act.slice = s.slice) END, 6) AS f1,
                   (SELECT round(max(f) - min(f), 6)
                    FROM (SELECT avg(f1) AS f FROM act WHERE slice <> 'all' GROUP BY slice)) AS gap
            FROM (SELECT slice, CASE WHEN slice <> 'all' THEN sum(n)::BIGINT END AS samples FROM c GROUP BY 1) s,
                 (SELECT unnest({NAMES}) AS label) t, (SELECT unnest({NAMES}) AS label) p""",
        "predictions",
        extra=_sliced(BY_LANG),
    ),
)
def fairness_payload(t: Tables):
    """Every cell of the payload, one row per cell of its matrices."""
    out = m.fairness_payload(t.predictions, "lang", LABELS)

    def part(name, f1, samples, matrix):
        return F.struct(
            name.alias("slice"), f1.alias("f1"), samples.cast("long").alias("samples"), matrix.alias("matrix")
        )

    whole = part(F.lit("all"), F.col("overall_f1"), F.lit(None), F.col("confusion_matrix"))
    maps = ("per_slice_f1", "sample_counts", "slice_confusion_matrices")
    each = F.transform(F.map_keys("per_slice_f1"), lambda k: part(k, *[F.element_at(c, k) for c in maps]))
    rows = out.select("gap", F.explode(F.concat(F.array(whole), each)).alias("s")).select("gap", "s.*")
    lines = rows.select("gap", "slice", "f1", "samples", F.posexplode("matrix").alias("i", "line"))
    cells = lines.select("gap", "slice", "f1", "samples", "i", F.posexplode("line").alias("j", "n"))
    names = F.array(*[F.lit(x) for x in LABELS])
    return cells.select(
        "slice", F.get(names, F.col("i")).alias("y_true"), F.get(names, F.col("j")).alias("y_pred"), "samples", "n",
        r6(F.col("f1")).alias("f1"), r6(F.col("gap")).alias("gap"),
    )


@query(
    "negative_recall_a31",
    sql(
        "SELECT round(recall, 6) AS recall, recall >= 0.9 AS on_target FROM sc WHERE label = 'negative'",
        "predictions",
        extra={"c": ONE_SLICE, "sc": sql_scores("c")},
    ),
)
def negative_recall(t: Tables):
    scores = m.label_scores(m.confusion_counts(t.predictions), LABELS).filter("label = 'negative'")
    return scores.select(r6(F.col("recall")).alias("recall"), (F.col("recall") >= 0.9).alias("on_target"))


@query(
    "weighted_log_loss_a26",
    sql(
        f"""SELECT round(sum(weight * -ln(p[label + 1])) / sum(weight), 6) AS log_loss
            FROM ({CLASS_IDS}) c JOIN (SELECT label_id, weight::DOUBLE AS weight FROM w) w ON c.label = w.label_id
            JOIN probs ON probs.sentence_id = c.id""",
        "predictions",
        "sentences",
        extra={"w": WEIGHTS, "probs": SQL_PROBS},
    ),
)
def weighted_log_loss(t: Tables):
    rows = class_ids(t)
    probs = t.sentences.select(F.col("sentence_id").alias("id"), "sentence_id").select(
        "id", P.softmax(logits()).alias("p")
    )
    weights = b.class_weights(rows, "label", 4).select("label_id", F.col("weight").cast("double").alias("weight"))
    out = m.weighted_log_loss(rows.join(probs, "id"), "label", "p", weights)
    return out.select(r6(F.col("log_loss")).alias("log_loss"))


@query(
    "cohen_kappa_a27",
    sql(
        """SELECT n AS n_items, round(po, 6) AS observed, round(pe, 6) AS expected,
                  round((po - pe) / (1 - pe), 6) AS kappa,
                  CASE WHEN (po - pe) / (1 - pe) >= 0.5 THEN 'accept' WHEN (po - pe) / (1 - pe) >= 0.4
                       THEN 'refine' ELSE 'stop' END AS gate
           FROM (SELECT count(*) AS n, avg((a = b)::INT) AS po,
                        (SELECT sum(x.c * y.c)::DOUBLE FROM (SELECT a, count(*) AS c FROM pairs GROUP BY 1) x
                         JOIN (SELECT b, count(*) AS c FROM pairs GROUP BY 1) y ON x.a = y.b)
                        / (count(*)::DOUBLE * count(*)) AS pe FROM pairs)""",
        "annotations",
        extra={
            "pairs": """SELECT x.id, x.label AS a, y.label AS b FROM annotations x JOIN annotations y
                USING (id) WHERE x.labeler_id = 'ann_a' AND y.labeler_id = 'ann_b'"""
        },
    ),
)
def cohen_kappa(t: Tables):
    out = m.cohen_kappa(t.annotations, "ann_a", "ann_b")
    return out.select("n_items", *[r6(F.col(c)).alias(c) for c in ("observed", "expected", "kappa")], "gate")


GATES = [("all", "f1_macro", 0.5), ("en", "f1_macro", 0.55), ("fr", "f1_macro", 0.3), ("vi", "f1_macro", 0.45)]


@query(
    "metric_gates_a29",
    sql(
        """SELECT g.scope, g.metric, round(f.value, 6) AS value, g.minimum,
                  coalesce(f.value >= g.minimum, false) AS passed
           FROM (VALUES """
        + ", ".join(f"('{s}', '{k}', {v}::DOUBLE)" for s, k, v in GATES)
        + """) g(scope, metric, minimum)
           LEFT JOIN (SELECT slice AS scope, avg(f1) AS value FROM act GROUP BY 1) f ON g.scope = f.scope""",
        "predictions",
        extra=_sliced(BY_LANG),
    ),
)
def metric_gates(t: Tables):
    counts = m.sliced_counts(t.predictions, "lang")
    wide = m.macro_scores(counts, LABELS, ["slice"], active_only=True).withColumnRenamed("slice", "scope")
    metrics = m.unpivot_metrics(wide, ["scope"], ["f1_macro"])
    gates = t.spark.createDataFrame(GATES, "scope string, metric string, minimum double")
    return m.metric_gates(metrics, gates).withColumn("value", r6(F.col("value")))


@query(
    "compare_runs_a36",
    sql(
        """SELECT coalesce(b.slice, n.slice) AS task, 'f1_macro' AS metric, round(b.f, 6) AS base_value,
                  round(n.f, 6) AS new_value, round(n.f - b.f, 6) AS delta
           FROM (SELECT slice, avg(f1) AS f FROM sb GROUP BY 1) b
           FULL JOIN (SELECT slice, avg(f1) AS f FROM sc GROUP BY 1) n ON b.slice = n.slice""",
        "predictions",
        extra={
            "c": BY_LANG,
            "sc": sql_scores("c"),
            "cb": """SELECT lang AS slice, y_true, 'positive' AS y_pred, count(*) AS n FROM predictions GROUP BY 1, 2""",
            "sb": sql_scores("cb"),
        },
    ),
)
def compare_runs(t: Tables):
    """Always-positive baseline against the predictions, per language (the base run has no ``all``)."""
    base = m.confusion_counts(t.predictions.withColumn("y_pred", F.lit("positive")), ["lang"])
    new = m.sliced_counts(t.predictions, "lang")
    wide = lambda c, k: m.unpivot_metrics(
        m.macro_scores(c, LABELS, [k]).withColumnRenamed(k, "task"), ["task"], ["f1_macro"]
    )
    out = m.compare_runs(wide(base, "lang"), wide(new, "slice"))
    return out.select("task", "metric", *[r6(F.col(c)).alias(c) for c in ("base_value", "new_value", "delta")])
