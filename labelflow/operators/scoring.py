"""Batch scoring: pluggable Python scorers and a native linear scorer, aspects, batch summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.functions import probs as P
from labelflow.functions import text as T
from labelflow.functions import vocab
from labelflow.operators.aspects import ASPECT_LIST
from labelflow.session import materialize

# Builds a scorer once per task; the scorer maps a list of texts to rows of probabilities. A factory from a
# module needs that module on the workers; a nested function is shipped by value.
ScorerFactory = Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]
# Builds two functions: texts to rows of one score per candidate aspect, and (text, aspect) pairs to rows of one
# score per sentiment.
AspectScorerFactory = Callable[[], tuple[Callable, Callable]]


def score(
    df: DataFrame,
    scorer: ScorerFactory,
    text_col: str = "text",
    id_col: str = "sentence_id",
    batch_size: int = 32,
    sarcasm_scorer: ScorerFactory | None = None,
    skip_sarcasm: bool = False,
    label_names: Sequence[str] = vocab.MODEL_SENTIMENTS,
    aspect_scorer: AspectScorerFactory | None = None,
    skip_aspects: bool = False,
    lang_col: str | None = None,
    candidates: Sequence[str] = vocab.ASPECTS,
    threshold: float = vocab.ASPECT_THRESHOLD,
) -> DataFrame:
    """(id, probs, sentiment, confidence, aspects, sarcasm_flag) per row.

    Rows stay in their partitions: no shuffle, and the id travels with the text, so input and output
    cannot drift apart. Arrow batches are re-cut to ``batch_size`` texts per scorer call. Aspects are rated for
    sentiment only where they score above ``threshold``; a text the aspect scorer fails on has none. With
    ``lang_col``, a row in an unsupported language fails the job (a missing language is the default one).
    """
    if batch_size <= 0:
        raise ValueError(f"a batch needs at least one row, not {batch_size}")
    with_sarcasm = sarcasm_scorer is not None and not skip_sarcasm
    with_aspects = aspect_scorer is not None and not skip_aspects
    n_candidates = len(candidates)

    def detected(texts, detect, rate):
        """Per text the (candidate, score, sentiment scores) of its detected aspects."""
        found = []
        for text, scores in zip(texts, detect(texts), strict=True):
            if len(scores) != n_candidates:
                raise ValueError("aspect scorer returned a different number of scores")
            found += [(text, i, float(x)) for i, x in enumerate(scores) if x > threshold]
        pairs = [(text, candidates[i]) for text, i, _ in found]
        cut = [pairs[i : i + batch_size] for i in range(0, len(pairs), batch_size)]
        rates = [[float(x) for x in row] for chunk in cut for row in rate(chunk)]
        by_text: dict[str, list] = {}
        for (text, i, x), rated in zip(found, rates, strict=True):
            by_text.setdefault(text, []).append({"i": i, "score": x, "rates": rated})
        return [by_text.get(text, []) for text in texts]

    def aspects_of(texts, detect, rate):
        """As ``detected`` for texts that differ; if a batch fails, text by text."""
        try:
            return detected(texts, detect, rate)
        except Exception:  # noqa: BLE001 - a text the scorer cannot read has no aspects
            if len(texts) == 1:
                return [[]]
            return [found for text in texts for found in aspects_of([text], detect, rate)]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        main = scorer()
        irony = sarcasm_scorer() if with_sarcasm else None
        about = aspect_scorer() if with_aspects else None
        for batch in batches:
            texts = batch["text"].tolist()
            chunks = [texts[i : i + batch_size] for i in range(0, len(texts), batch_size)]

            def call(fn):
                return [[float(x) for x in row] for chunk in chunks for row in fn(chunk)]

            out = pd.DataFrame({"id": batch["id"], "probs": call(main)})
            if len(out["probs"]) != len(texts):
                raise ValueError("scorer returned a different number of rows")
            out["irony"] = call(irony) if irony else None
            out["aspects"] = None
            if about:
                known: dict[str, list] = {}
                for chunk in chunks:
                    distinct = [t for t in dict.fromkeys(chunk) if t not in known]
                    known.update(zip(distinct, aspects_of(distinct, *about) if distinct else []))
                out["aspects"] = [known[t] for t in texts]
            yield out

    text = F.coalesce(text_col, F.lit(""))
    if lang_col is not None:
        lang = T.language_or_default(F.col(lang_col))
        refusal = F.raise_error(F.concat(F.lit("no scorer for language "), lang)).cast("string")
        text = F.when(T.is_supported_language(lang), text).otherwise(refusal)
    source = df.select(F.col(id_col).cast("string").alias("id"), text.alias("text"))
    scored = source.mapInPandas(
        run,
        "id string, probs array<double>, irony array<double>, "
        "aspects array<struct<i:int,score:double,rates:array<double>>>",
    )
    names = F.array(*[F.lit(c) for c in candidates])
    sentiments = F.array(*[F.lit(x) for x in vocab.SENTIMENTS])
    ordered = F.array_sort(F.transform("aspects", lambda r: F.struct(
        (-r["score"]).alias("o"), F.get(names, r["i"]).alias("aspect"), r["rates"].alias("rates"))))
    aspects = F.transform(ordered, lambda r: F.struct(
        r["aspect"].alias("aspect"),
        F.get(sentiments, F.array_position(r["rates"], F.array_max(r["rates"])).cast("int") - 1).alias("sentiment"),
        F.bround(F.array_max(r["rates"]), 4).alias("confidence")))
    flag = P.sarcasm_flag(F.col("irony")) if with_sarcasm else F.lit(False)
    return scored.select(
        F.col("id").alias(id_col),
        "probs",
        P.argmax_label(F.col("probs"), label_names).alias("sentiment"),
        P.confidence(F.col("probs")).alias("confidence"),
        F.coalesce(aspects, F.array().cast(ASPECT_LIST)).alias("aspects"),
        F.coalesce(flag, F.lit(False)).alias("sarcasm_flag"),
    )


def linear_logits(
    df: DataFrame,
    weights: DataFrame,
    classes: Sequence[str],
    intercept: Sequence[float],
    text_col: str = "text",
    id_col: str = "sentence_id",
) -> DataFrame:
    """(id, logits): per class the intercept plus the weights of the text's tokens.

    ``weights`` is (token, one double column per class). Tokens of one text sit in one task, so the grouped
    sum collapses to one narrow row per text before the shuffle. The lexicon is joined by its size: a small one
    is sent to all tasks, a large one is shuffled by token, where adaptive execution splits frequent tokens.
    """
    # Empty tokens are kept: they match nothing, and a text without tokens still gets its row.
    words = F.split(F.lower(F.coalesce(text_col, F.lit(""))), T.WHITESPACE, -1)
    # Rows of one id are told apart by their text; equal rows are summed together and dealt out again.
    row = [id_col, "__text"]
    # hashed before it is cut: beside the tokens it would be hashed for each of them
    texts = df.select(F.col(id_col), F.xxhash64(text_col).alias("__text"), words.alias("__words"))
    tokens = texts.select(id_col, "__text", F.posexplode("__words").alias("__pos", "token"))
    lexicon = materialize(weights.select("token", *classes), "lexicon")  # read back, its size is known
    sums = tokens.join(lexicon, "token", "left").groupBy(*row).agg(
        *[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in classes],
        F.count_if(F.col("__pos") == 0).alias("__rows"),
    )
    logits = F.array(*[F.col(c) / F.col("__rows") + F.lit(float(b)) for c, b in zip(classes, intercept)])
    return sums.select(id_col, logits.alias("logits"), F.explode(F.sequence(F.lit(1).cast("long"), "__rows")).alias("__n")).drop("__n")


def from_logits(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Add probs, sentiment and confidence to a frame with ``logits``."""
    out = scored.withColumn("probs", P.softmax(F.col("logits")))
    return out.withColumn("sentiment", P.argmax_label(F.col("probs"), classes)).withColumn(
        "confidence", P.confidence(F.col("probs"))
    )


def clean_upload(text: Column, null_as_text: bool = True) -> tuple[Column, Column]:
    """(stripped text, error): only blank fields fail; a missing one is the text ``nan`` by default."""
    stripped = F.regexp_replace(
        F.coalesce(text, F.lit("nan" if null_as_text else "")),
        r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$",
        "",
    )
    return stripped, F.when(stripped == "", F.lit(vocab.EMPTY_ROW_ERROR))


def batch_results(
    uploads: DataFrame, scores: DataFrame, row_col: str = "row", null_as_text: bool = True
) -> DataFrame:
    """(row, text, sentiment, confidence, aspects, error): blank rows become neutral error rows.

    ``scores`` holds (row, sentiment, confidence) and maybe aspects for the other rows; a missing score is an
    error.
    """
    text, error = clean_upload(F.col("text"), null_as_text)
    cleaned = uploads.select(F.col(row_col).alias("row"), text.alias("text"), error.alias("error"))
    listed = "aspects" in scores.columns
    nothing = F.array().cast(ASPECT_LIST)
    scored = scores.select(F.col(row_col).alias("row"), "sentiment", "confidence", *(["aspects"] if listed else []))
    aspects = F.when(~F.col("error").isNotNull(), F.col("aspects")) if listed else nothing
    failed = F.col("error").isNotNull()
    return cleaned.join(scored, "row", "left").select(
        "row",
        "text",
        F.when(failed, "neutral").otherwise(F.col("sentiment")).alias("sentiment"),
        F.when(failed, F.lit(0.0)).otherwise(F.bround("confidence", 4)).alias("confidence"),
        F.coalesce(aspects, nothing).alias("aspects"),
        F.when(~failed & F.col("sentiment").isNull(), F.lit("Not scored"))
        .otherwise(F.col("error"))
        .alias("error"),
    )


def batch_totals(results: DataFrame) -> DataFrame:
    failed = F.count(F.when(F.col("error").isNotNull(), 1))
    return results.agg(
        F.count(F.lit(1)).alias("total_items"),
        (F.count(F.lit(1)) - failed).alias("processed_items"),
        failed.alias("failed_items"),
    )


def sentiment_summary(
    results: DataFrame, labels: Sequence[str] = ("positive", "neutral", "negative")
) -> DataFrame:
    """(pos, label, n, pct) in display order; shares are over all rows, error rows count as they are."""
    counts = results.agg(
        F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"),
        *[F.count(F.when(F.col("sentiment") == x, 1)).alias(x) for x in labels],
    )
    return counts.select(
        F.posexplode(
            F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("n")) for x in labels])
        ).alias("pos", "r"),
        "total",
    ).select("pos", "r.label", "r.n", (F.col("r.n") / F.col("total") * 100.0).alias("pct"))


def run_summary(timings: DataFrame, seconds: str, samples: int) -> DataFrame:
    """One row: runs, mean seconds, samples per second."""
    return timings.agg(
        F.count(seconds).alias("runs"),
        F.avg(seconds).alias("mean_s"),
        (F.lit(float(samples)) / F.nullif(F.avg(seconds), F.lit(0.0))).alias("samples_per_s"),
    )


def assert_paired(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """1:1 pairing by id; fails in the job when a row lacks a partner or an id occurs twice on a side.

    Rows per id are counted over the partitioning and order that the join needs anyway.
    """
    same = Window.partitionBy(id_col)
    l = left.withColumn("__l", F.count(F.lit(1)).over(same))
    r = right.withColumn("__r", F.count(F.lit(1)).over(same))
    paired = l.join(r, id_col, "full")
    id_type = left.schema[id_col].dataType
    fail = lambda text: F.raise_error(F.lit(text)).cast(id_type)
    checked = (
        F.when(F.col("__l").isNull() | F.col("__r").isNull(), fail("prediction and truth rows do not match"))
        .when((F.col("__l") > 1) | (F.col("__r") > 1), fail("prediction or truth rows share an id"))
        .otherwise(F.col(id_col))
    )
    return paired.withColumn(id_col, checked).drop("__l", "__r")
