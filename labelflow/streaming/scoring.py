"""Streaming clean, dedup, language detection and scoring of texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.functions import probs as P
from labelflow.functions import text as T
from labelflow.operators.frames import clean_rows


def inline_logits(
    text: Column, weights: Mapping[str, Sequence[float]], intercept: Sequence[float]
) -> Column:
    """Linear logits from a small literal lexicon, computed inside the row (no state, no shuffle)."""
    words = F.filter(F.split(F.lower(text), T.WHITESPACE, -1), lambda t: t.isin(*weights))

    def one(known: Column, i: int, bias: float) -> Column:
        values = {token: float(w[i]) for token, w in weights.items()}
        return F.aggregate(known, F.lit(float(bias)), lambda acc, t: acc + T.map_lookup(t, values))

    return T.bind(words, lambda known: F.array(*[one(known, i, b) for i, b in enumerate(intercept)]))


def score_stream(
    texts: DataFrame,
    weights: Mapping[str, Sequence[float]],
    classes: Sequence[str],
    intercept: Sequence[float],
    ts: str = "ts",
    delay: str = "10 minutes",
    id_col: str = "sentence_id",
    salts: int | None = None,
) -> DataFrame:
    """(id, ts, lang, lang_confidence, sentiment, confidence) of the first copy of each text.

    Copies are found on the normalised text within the watermark; state holds one key per recent text. A
    stream's dedup has no map-side combine, so it runs twice: per (text, salt of the id), which spreads a
    very frequent text over ``salts`` tasks (by default the session's shuffle partitions), and then per text on
    the few rows that are left.
    """
    if salts is None:
        salts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = (
        texts.withWatermark(ts, delay)
        .withColumn("__key", F.md5(T.text_key(F.col("text"))))
        .withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
        .dropDuplicatesWithinWatermark(["__key", "__salt"])
        .dropDuplicatesWithinWatermark(["__key"])
    )
    scored = clean_rows(keyed).withColumn("probs", P.softmax(inline_logits(F.col("text"), weights, intercept)))
    return scored.withColumn("d", T.detect_language(F.col("text"))).select(
        id_col,
        ts,
        F.col("d.lang").alias("lang"),
        F.col("d.confidence").alias("lang_confidence"),
        P.argmax_label(F.col("probs"), classes).alias("sentiment"),
        P.confidence(F.col("probs")).alias("confidence"),
    )
