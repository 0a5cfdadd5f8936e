"""Fit and evaluate: dedup, split, oversample, class weights, a weighted linear classifier, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.functions import labels as L
from labelflow.functions import probs as P
from labelflow.functions import text as T
from labelflow.functions import vocab
from labelflow.operators import metrics as m
from labelflow.operators import sampling as sp
from labelflow.operators import scoring as sc
from labelflow.operators.balance import attach_weights, class_weights
from labelflow.operators.dedup import drop_duplicates_first
from labelflow.session import materialize
from labelflow.sources.readers import select_split


TASK_CHARS = 1 << 26


@dataclass(frozen=True)
class TaskConfig:
    name: str
    label_names: tuple[str, ...]
    model_labels: int = 3
    seed: int = 42
    use_class_weights: bool = True
    oversample_minority: bool = False
    oversample_target_ratio: float = 0.15
    stratified: bool = False


# The two supported tasks. The irony task trains with three outputs, two are used.
TASKS = {
    "sarcasm": TaskConfig("sarcasm", vocab.IRONY),
    "sentiment": TaskConfig("sentiment", vocab.MODEL_SENTIMENTS, oversample_minority=True, stratified=True),
}


def get_task(name: str) -> TaskConfig:
    if name not in TASKS:
        raise ValueError(f"no task is called {name!r}; known: {sorted(TASKS)}")
    return TASKS[name]


def prepare_rows(
    df: DataFrame,
    task: TaskConfig,
    id_col: str = "id",
    order_col: str = "row_order",
    smoke: bool = False,
    balance: bool = True,
    smoke_rows: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with integer labels: first rows only for a smoke run, dedup, 90/10, oversample.

    ``df``: id, text, label (a name of the task or its index), lang, row_order.
    """
    rows = df.withColumn("label", L.resolve(F.col("label"), task.label_names))
    rows = L.encode(rows, "label", task.label_names)
    if smoke:
        rows = rows.orderBy(order_col).limit(smoke_rows)
    rows = drop_duplicates_first(rows, {"text": T.text_key(F.col("text"))}, order_col)
    strata = None
    if task.stratified and not smoke:
        rows = rows.withColumn("stratum", L.stratum_key(F.col("lang"), F.col("label")))
        strata = "stratum"
    rows = materialize(rows, "training-rows")  # read by the split's passes and by both halves
    halves = sp.train_test_split(rows, strata, id_col, 0.1, task.seed)
    train, test = (halves.filter(F.col("split") == s) for s in ("train", "test"))
    if balance and task.oversample_minority and not smoke:
        train = sp.oversample(train, "label", id_col, task.oversample_target_ratio, task.seed)
    return train, test


@dataclass
class Fitted:
    model: PipelineModel
    task: TaskConfig
    weights: DataFrame | None
    test: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``probs`` (one per label name), ``y_pred`` and ``confidence``."""
        n = len(self.task.label_names)
        out = self.model.transform(df).withColumn(
            "probs", F.slice(vector_to_array("probability"), 1, n)
        )
        return out.withColumn("y_pred", P.argmax_label(F.col("probs"), self.task.label_names)).withColumn(
            "confidence", P.confidence(F.col("probs"))
        )


def fit_classifier(
    df: DataFrame,
    task_name: str,
    id_col: str = "id",
    smoke: bool = False,
    balance: bool = True,
    features: int = 1 << 16,
    max_iter: int = 20,
) -> Fitted:
    """Hashed bag of words and multinomial logistic regression, trained by Spark on all executors."""
    task = get_task(task_name)
    train, test = prepare_rows(df, task, id_col, smoke=smoke, balance=balance)
    weights, weight_col = None, {}
    if balance and task.use_class_weights:
        weights = class_weights(train, "label", task.model_labels)
        train = attach_weights(train, "label", weights).withColumn(
            "weight", F.col("weight").cast("double")
        )
        weight_col = {"weightCol": "weight"}
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=T.WHITESPACE, toLowercase=True),
        HashingTF(inputCol="words", outputCol="features", numFeatures=features),
        LogisticRegression(
            labelCol="label", family="multinomial", maxIter=1 if smoke else max_iter, **weight_col
        ),
    ]
    return Fitted(Pipeline(stages=stages).fit(deal_by_size(train)), task, weights, test)


def deal_by_size(train: DataFrame, chars: int = TASK_CHARS) -> DataFrame:
    """The rows' text, label and weight, dealt evenly to tasks of about ``chars`` characters.

    A fit reads its rows once per iteration, in the tasks they came in; those of a join or of a few shuffle partitions would
    grow with the table.
    """
    columns = [c for c in ("text", "label", "weight") if c in train.columns]
    rows = materialize(train.select(*columns), "fit-rows")
    size, n = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count(F.lit(1))).first()
    least = min(n, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(1, least, -(-size // chars)))


def evaluate_split(
    df: DataFrame,
    scorer: sc.ScorerFactory,
    task_name: str = "sentiment",
    id_col: str = "id",
    max_samples: int | None = None,
    batch_size: int = 32,
) -> DataFrame:
    """Score the test rows and pair them with the truth by id: (id, y_true, y_pred, lang, confidence).

    Feed the result to the metrics module. For the irony task the flag of the first two classes decides.
    """
    task = get_task(task_name)
    rows = select_split(df, "test")
    if max_samples is not None:
        rows = sp.sample_rows(rows, max_samples, id_col, task.seed)
    lang = F.col("lang") if "lang" in rows.columns else F.lit(None).cast("string")
    truth = rows.select(
        F.col(id_col).cast("string").alias(id_col),
        L.resolve(F.col("label"), task.label_names).alias("y_true"),
        T.language_or_default(lang).alias("lang"),
    )
    scored = sc.score(rows, scorer, "text", id_col, batch_size, skip_sarcasm=True)
    if task_name == "sarcasm":
        hit = P.sarcasm_flag(F.col("probs"))
        pred = F.when(hit, task.label_names[1]).otherwise(task.label_names[0])
    else:
        pred = F.col("sentiment")
    pred = scored.select(id_col, pred.alias("y_pred"), "confidence")
    return sc.assert_paired(truth, pred, id_col)


def report(pairs: DataFrame, task_name: str = "sentiment") -> DataFrame:
    return m.fairness_payload(pairs, "lang", get_task(task_name).label_names)
