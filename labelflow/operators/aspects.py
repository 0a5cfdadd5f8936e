"""Aspect extraction, keyword tagging, expectation checks, coverage."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.functions import text as T
from labelflow.functions import vocab


ASPECT_LIST = "array<struct<aspect:string,sentiment:string,confidence:double>>"


def rated_aspects(
    scores: Column,
    rate: Callable[[Column], Column],
    candidates: Sequence[str] = vocab.ASPECTS,
    threshold: float = vocab.ASPECT_THRESHOLD,
    order: Sequence[str] = vocab.SENTIMENTS,
) -> Column:
    """Aspects of a text as (aspect, sentiment, confidence), by score descending, then by name.

    ``scores`` is an array of one score per candidate; ``rate(aspect)`` gives an array of one score per
    sentiment of ``order`` and is evaluated for detected aspects only. Everything happens in the row, without
    a shuffle. Missing scores detect nothing; the earlier sentiment wins ties.
    """
    names, sentiments = F.array(*[F.lit(c) for c in candidates]), F.array(*[F.lit(x) for x in order])
    scored = F.transform(scores, lambda s, i: F.struct((-s).alias("o"), F.get(names, i).alias("aspect")))
    found = F.array_sort(F.filter(scored, lambda r: -r["o"] > threshold))

    def rated(r: Column) -> Column:
        def best(values: Column) -> Column:
            top = F.array_max(values)
            return F.struct(
                r["aspect"].alias("aspect"),
                F.get(sentiments, F.array_position(values, top).cast("int") - 1).alias("sentiment"),
                F.bround(top, 4).alias("confidence"),
            )

        return T.bind(rate(r["aspect"]), best)

    return F.coalesce(F.transform(found, rated), F.array().cast(ASPECT_LIST))


def expand_candidates(
    df: DataFrame, candidates: Sequence[str] = vocab.ASPECTS, out: str = "aspect"
) -> DataFrame:
    """One row per text and candidate label: a generator over a literal list, not a join."""
    return df.select("*", F.explode(F.array(*[F.lit(c) for c in candidates])).alias(out))


def detected_aspects(scores: DataFrame, threshold: float = vocab.ASPECT_THRESHOLD) -> DataFrame:
    """Aspect scores strictly above the threshold."""
    return scores.filter(F.col("score") > threshold)


def best_sentiment(
    sentiment_scores: DataFrame, keys: Sequence[str], order: Sequence[str] = vocab.SENTIMENTS
) -> DataFrame:
    """(keys..., sentiment, confidence): largest score, earlier label on ties."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("sentiment"))
    best = F.max(F.struct("score", (-rank).alias("r"), "sentiment"))
    return (
        sentiment_scores.groupBy(*keys)
        .agg(best.alias("b"))
        .select(*keys, F.col("b.sentiment"), F.bround("b.score", 4).alias("confidence"))
    )


def extract_aspects(
    texts: DataFrame,
    aspect_scores: DataFrame,
    sentiment_scores: DataFrame,
    id_col: str = "sentence_id",
    threshold: float = vocab.ASPECT_THRESHOLD,
) -> DataFrame:
    """(id, aspects): detected aspects with their sentiment, by aspect score descending.

    For scores that come as tables; :func:`rated_aspects` does the same for scores within the row. Texts without detected aspects, or whose scores are missing, get an empty list.
    """
    found = detected_aspects(aspect_scores, threshold)
    rated = best_sentiment(sentiment_scores, [id_col, "aspect"])
    items = found.join(rated, [id_col, "aspect"]).select(
        id_col, (-F.col("score")).alias("o"), "aspect", "sentiment", "confidence"
    )
    lists = items.groupBy(id_col).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("o", "aspect", "sentiment", "confidence"))),
            lambda r: F.struct(
                r["aspect"].alias("aspect"),
                r["sentiment"].alias("sentiment"),
                r["confidence"].alias("confidence"),
            ),
        ).alias("aspects")
    )
    nothing = F.array().cast(ASPECT_LIST)
    return texts.select(id_col).join(lists, id_col, "left").withColumn(
        "aspects", F.coalesce("aspects", nothing)
    )


def keyword_aspects(
    df: DataFrame,
    keywords: Mapping[str, Sequence[str]],
    text_col: str = "text",
    id_col: str = "sentence_id",
) -> DataFrame:
    """(id, aspects): sorted distinct aspects whose keywords occur as tokens.

    ``keywords`` is a small literal dictionary, so each text is matched in place: no explode, no shuffle.
    """
    words = T.tokens(F.lower(F.regexp_replace(text_col, r"[^\p{L}\p{N}\s]+", " ")))
    tagged = F.array_compact(
        F.array(
            *[
                F.when(
                    F.arrays_overlap(F.col("__words"), F.array(*[F.lit(w) for w in keywords[a]])), F.lit(a)
                )
                for a in sorted(keywords)
            ]
        )
    )
    return df.select(F.col(id_col), words.alias("__words")).select(id_col, tagged.alias("aspects"))


def aspect_coverage(df: DataFrame, aspects_col: str = "aspects", target: float = 0.8) -> DataFrame:
    """One row: texts, share with at least one aspect, and whether it exceeds the target."""
    share = F.avg((F.size(aspects_col) > 0).cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("n_texts"),
        share.alias("coverage"),
        F.coalesce(share > target, F.lit(False)).alias("on_target"),
    )


def aspect_sentiments(results: DataFrame, aspects_col: str = "aspects") -> DataFrame:
    """(aspect, sentiment, n) over batch results."""
    return (
        results.select(F.inline(aspects_col))
        .groupBy("aspect", "sentiment")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def check_expectations(expected: DataFrame, predicted: DataFrame, id_col: str = "id") -> DataFrame:
    """Pass or fail per scenario with the reasons.

    ``expected``: (id, aspect, allowed ARRAY<STRING>); an aspect ``a/b`` passes if either does, an absent one
    fails. ``predicted``: (id, aspect, sentiment).
    """
    wanted = expected.select(
        id_col, "aspect", "allowed", F.explode(F.split(F.lower("aspect"), "/")).alias("part")
    )
    found = predicted.select(
        F.col(id_col), F.lower("aspect").alias("part"), F.lower("sentiment").alias("sentiment")
    )
    matched = wanted.join(found, [id_col, "part"], "left")
    one = matched.groupBy(id_col, "aspect").agg(
        F.max(F.coalesce(F.array_contains("allowed", F.col("sentiment")), F.lit(False))).alias("ok"),
        F.sort_array(F.collect_set("sentiment")).alias("got"),
    )
    reason = F.concat(
        F.col("aspect"),
        F.lit(": "),
        F.when(F.size("got") == 0, "not found").otherwise(F.concat(F.lit("got "), F.array_join("got", ","))),
    )
    return one.groupBy(id_col).agg(
        F.min("ok").alias("passed"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("ok"), reason))), " | ").alias("reasons"),
    )
