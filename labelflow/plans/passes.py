"""Model selection: warm-started passes over the train rows, each scored on validation rows, the best kept.

A pass is iterative parameter mixing. The train rows lie in shards; every shard starts from the model of the pass
before, walks once over its rows in blocks (softmax regression on hashed words, AdaGrad steps), and its change enters
the next model by its share of the weight. A task streams its rows and holds one model, ``features`` times the number
of labels; the driver holds two (the current and the best), whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.functions import probs as P
from labelflow.functions import text as T
from labelflow.operators import metrics as m
from labelflow.operators import sampling as sp
from labelflow.operators.balance import attach_weights, class_weights
from labelflow.plans.training import TaskConfig, get_task, prepare_rows
from labelflow.session import materialize

BLOCK = 64
ROWS_PER_SHARD = 20_000
MOST_SHARDS = 4096  # shards grow beyond this; no row is left out
SCORES = "pass int, rows bigint, log_loss double, accuracy double, f1_macro double, best boolean"


def word_features(text: Column, features: int) -> Column:
    """Places of the lower-cased words in a hashed vector, repeats included; empty for empty or missing texts."""
    words = T.tokens(F.lower(F.coalesce(text, F.lit(""))))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def deal_train_rows(train: DataFrame, features: int, shards: int | None, id_col: str = "id") -> tuple[DataFrame, float]:
    """(stored rows, total weight): one row per distinct train row, copies as weight, laid out by shard.

    ``train``: id, text, label (its index) and optionally weight. A row that was copied a million times is one row.
    """
    weight = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
    rows = train.select(F.col(id_col).cast("string").alias("id"), F.col("label").cast("int").alias("label"),
                        word_features(F.col("text"), features).alias("at"), weight.alias("weight"))
    rows = materialize(rows.groupBy("id", "label", "at").agg(F.sum("weight").alias("weight")), "train-features")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    count = shards or max(1, min(MOST_SHARDS, n // ROWS_PER_SHARD))
    key = F.xxhash64("id", "label", "at")
    dealt = rows.select(F.pmod(key, F.lit(count)).cast("int").alias("shard"), key.alias("key"), "id", "label", "at", "weight")
    dealt = dealt.repartition(count, "shard").sortWithinPartitions("shard", "key", "id", "label", "at")
    return materialize(dealt, "train-shards"), total


def _walk(model, features: int, classes: int, rate: float):
    """Arrow batches of a task's shards to (shard, key, weight, at, change): what each shard would change."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        start = model.value
        here, number = np.zeros(features, bool), np.zeros(features, "int64")

        def finish(state):
            w, seen, shard, key, mass = state["w"], np.flatnonzero(state["seen"]), state["shard"], state["key"], state["mass"]
            for low in range(0, len(seen), 8192):
                part = seen[low : low + 8192]
                n = len(part)
                change = (w[part] - start[part]) * mass
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, "int32")), pa.array(np.full(n, key, "int64")), pa.array(part.astype("int32")),
                     pa.ListArray.from_arrays(np.arange(0, n * classes + 1, classes, dtype="int32"), change.ravel())],
                    ["shard", "key", "at", "change"])

        def step(state):
            labels, weights, places = state["rows"]
            if not labels:
                return
            w, sums, seen = state["w"], state["sums"], state["seen"]
            sizes = np.array([len(p) for p in places])
            at = np.concatenate(places).astype("int64") if sizes.sum() else np.zeros(0, "int64")
            row = np.repeat(np.arange(len(labels)), sizes)
            value = 1.0 / np.sqrt(np.maximum(sizes, 1))[row]
            # every sum starts with the row's intercept and goes on in the order of its words
            rows = np.arange(len(labels) + len(row))
            rows[len(labels):] = row
            logits = np.stack([np.bincount(rows, np.concatenate([np.full(len(labels), w[features, c]), w[at, c] * value]))
                               for c in range(classes)], axis=1)
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(labels)), labels] -= 1.0
            p *= np.array(weights)[:, None]
            state["mass"] += float(sum(weights))
            p /= sum(weights)
            here[at] = True
            places_used = np.flatnonzero(here)
            here[places_used] = False
            number[places_used] = np.arange(len(places_used))
            group = number[at]
            grad = np.stack([np.bincount(group, p[row, c] * value, len(places_used) + 1) for c in range(classes)], axis=1)
            grad[-1] = p.sum(axis=0)  # the intercept
            used = np.append(places_used, features)
            sums[used] += grad**2
            w[used] -= rate * grad / np.sqrt(sums[used] + 1e-8)
            seen[used] = True
            state["rows"] = ([], [], [])

        state = None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("shard", "key", "label", "weight")]
            at = batch.column(batch.schema.get_field_index("at"))
            for i, (shard, key, label, weight) in enumerate(zip(*[c.to_numpy(zero_copy_only=False) for c in columns])):
                if state is None or state["shard"] != shard:
                    if state is not None:
                        step(state)
                        yield from finish(state)
                    state = {"shard": shard, "key": key, "w": start.copy(), "sums": np.zeros_like(start),
                             "seen": np.zeros(features + 1, bool), "rows": ([], [], []), "mass": 0.0}
                if weight <= 0:
                    continue
                for into, x in zip(state["rows"], (int(label), float(weight), at[i].values.to_numpy(zero_copy_only=False))):
                    into.append(x)
                if len(state["rows"][0]) == BLOCK:
                    step(state)
        if state is not None:
            step(state)
            yield from finish(state)

    return run


def one_pass(dealt: DataFrame, total: float, model: np.ndarray, rate: float) -> np.ndarray:
    """The model after one pass over ``dealt``, starting from ``model``; without rows the same model.

    The changes of a place are added in the order of the shards, so the sum does not depend on their arrival.
    """
    features, classes = model.shape[0] - 1, model.shape[1]
    sent = dealt.sparkSession.sparkContext.broadcast(model)
    changes = dealt.mapInArrow(_walk(sent, features, classes, rate), "shard int, key long, at int, change array<double>")
    zero = F.array(*[F.lit(0.0)] * classes)
    listed = F.array_sort(F.collect_list(F.struct("shard", "key", "change")))
    summed = changes.groupBy("at").agg(
        F.aggregate(listed, zero, lambda t, x: F.zip_with(t, x["change"], lambda a, b: a + b)).alias("change"))
    after = model.copy()
    for row in summed.toLocalIterator():  # at most features + 1 rows
        after[row["at"]] += np.array(row["change"]) / total
    sent.destroy()
    return after


def with_probs(df: DataFrame, model: np.ndarray, name: str = "probs") -> DataFrame:
    """Adds the class probabilities of the rows' ``text`` under ``model``."""
    features = model.shape[0] - 1
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def probabilities(at):
        import numpy as np
        import pandas as pd

        w, out = sent.value, []
        for places in at:
            logits = w[features] + w[np.asarray(places, dtype="int64")].sum(axis=0) / np.sqrt(max(len(places), 1))
            p = np.exp(logits - logits.max())
            out.append(p / p.sum())
        return pd.Series(out, dtype=object)

    return df.withColumn(name, probabilities(word_features(F.col("text"), features)))


def validation_scores(rows: DataFrame, model: np.ndarray, labels: tuple[str, ...]) -> dict:
    """(rows, log_loss, accuracy, f1_macro) of a model on rows with text and label index; the means are null without rows."""
    names = F.array(*[F.lit(x) for x in labels])
    scored = with_probs(rows.select("text", "label"), model)
    pairs = scored.select(
        F.get(names, F.col("label")).alias("y_true"), P.argmax_label(F.slice("probs", 1, len(labels)), labels).alias("y_pred"),
        (-F.log(F.greatest(F.get("probs", F.col("label")), F.lit(1e-15)))).alias("loss"))
    counts = pairs.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"), F.sum("loss").alias("loss"))
    counts = materialize(counts, "pass-scores")
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    n, loss, right = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("loss"), hit).first()
    f1 = m.macro_scores(counts.drop("loss"), labels).first()["f1_macro"] if n else None
    return {"rows": n, "log_loss": loss / n if n else None, "accuracy": right / n if n else None, "f1_macro": f1}


@dataclass
class Selected:
    model: np.ndarray
    task: TaskConfig
    history: list[dict] = field(default_factory=list)
    best_pass: int = 0
    validation: DataFrame | None = None
    test: DataFrame | None = None

    def scores(self, spark) -> DataFrame:
        """One row per pass: its validation scores, and whether its model was kept."""
        rows = [(h["pass"], h["rows"], h["log_loss"], h["accuracy"], h["f1_macro"], h["pass"] == self.best_pass) for h in self.history]
        return spark.createDataFrame(rows, SCORES)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``probs`` (one per label name), ``y_pred`` and ``confidence`` of the kept model."""
        names = self.task.label_names
        out = with_probs(df, self.model).withColumn("probs", F.slice("probs", 1, len(names)))
        return out.withColumn("y_pred", P.argmax_label(F.col("probs"), names)).withColumn("confidence", P.confidence(F.col("probs")))


def _better(new: dict, old: dict | None, by: str) -> bool:
    if old is None:
        return True
    if new[by] is None or old[by] is None:
        return False
    return new[by] < old[by] if by == "log_loss" else new[by] > old[by]


def select_model(
    train: DataFrame,
    validation: DataFrame,
    task: TaskConfig,
    id_col: str = "id",
    by: str = "f1_macro",
    passes: int = 8,
    patience: int = 2,
    features: int = 1 << 16,
    rate: float = 0.5,
    shards: int | None = None,
) -> Selected:
    """The best of up to ``passes`` models by ``by`` (f1_macro, accuracy or log_loss) on the validation rows.

    Both tables: id, text, label (its index), train optionally weight. Ends after ``patience`` passes without a better
    score; of equal scores the earlier pass stays. Without train rows the model stays at zero; without validation rows
    the first pass is kept.
    """
    if by not in ("f1_macro", "accuracy", "log_loss"):
        raise ValueError(f"models are selected by f1_macro, accuracy or log_loss, not {by!r}")
    if passes < 1 or patience < 1:
        raise ValueError("passes and patience must be 1 or more")
    dealt, total = deal_train_rows(train, features, shards, id_col)
    validation = materialize(validation.select(F.col(id_col).alias("id"), "text", F.col("label").cast("int").alias("label")), "validation")
    model = np.zeros((features + 1, max(task.model_labels, len(task.label_names))))
    out, best, worse = Selected(model, task, validation=validation), None, 0
    for at in range(1, passes + 1):
        if total > 0:
            model = one_pass(dealt, total, model, rate / math.sqrt(at))
        found = {"pass": at, **validation_scores(validation, model, task.label_names)}
        out.history.append(found)
        if _better(found, best, by):
            best, worse, out.model, out.best_pass = found, 0, model, at
        else:
            worse += 1
            if worse == patience:
                break
    return out


def fit_selected(df: DataFrame, task: TaskConfig | str, id_col: str = "id", validation_ratio: float = 0.1, **options) -> Selected:
    """Dedup, test split, validation split, oversampling and class weights of the task, then ``select_model``.

    ``df`` as for ``prepare_rows``. Copies are made after the validation rows are set aside, so none stands on both sides.
    """
    task = get_task(task) if isinstance(task, str) else task
    rest, test = prepare_rows(df, task, id_col, balance=False)
    halves = materialize(sp.train_test_split(rest.drop("split"), None, id_col, validation_ratio, task.seed + 1), "validation-split")
    train, validation = (halves.filter(F.col("split") == s) for s in ("train", "test"))
    if task.oversample_minority:
        train = sp.oversample(train, "label", id_col, task.oversample_target_ratio, task.seed)
    if task.use_class_weights:
        train = attach_weights(train, "label", class_weights(train, "label", task.model_labels))
    out = select_model(train, validation, task, id_col, **options)
    out.test = test
    return out
