"""The sentence/aspect pair and the steps that transform it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from labelflow.functions import text as T
from labelflow.functions import vocab
from labelflow.operators.dedup import drop_duplicates_first
from labelflow.operators.sampling import stratified_split
from labelflow.session import materialize

RAW_SENTENCES = ("sentence_id", "text", "split")
RAW_ASPECTS = ("sentence_id", "aspect_category", "sentiment")


class SchemaError(ValueError):
    """A frame lacks columns or rows it must have."""


@dataclass(frozen=True)
class Frames:
    sentences: DataFrame
    aspects: DataFrame


@dataclass(frozen=True)
class Step:
    """A transform over both frames and the columns that must still be there afterwards.

    ``reads_aspects`` and ``only_removes`` (its sentences are a subset of those it got) tell the runner when
    it may put off the cascade; the defaults are the safe ones.
    """

    name: str
    apply: Callable[[Frames], Frames]
    sentence_columns: tuple[str, ...] = ()
    aspect_columns: tuple[str, ...] = ()
    reads_aspects: bool = True
    only_removes: bool = False


@dataclass
class RunResult:
    frames: Frames
    counts: dict[str, Observation] = field(default_factory=dict)


def check_schema(frames: Frames) -> Frames:
    """Raw columns present (all missing ones listed, sorted) and both frames non-empty."""
    for what, df, needed in (
        ("sentences", frames.sentences, RAW_SENTENCES),
        ("aspects", frames.aspects, RAW_ASPECTS),
    ):
        missing = sorted(set(needed) - set(df.columns))
        if missing:
            raise SchemaError(f"{what} frame lacks columns: {missing}")
    if frames.sentences.isEmpty() or frames.aspects.isEmpty():
        raise SchemaError("sentence and aspect frames must not be empty")
    return frames


def label_rows(
    aspects: DataFrame,
    categories: Mapping[str, str] = vocab.ASPECT_RENAMES,
    drop: str = "conflict",
) -> DataFrame:
    """Drop one label (missing labels stay) and rename categories."""
    kept = aspects.filter(~F.col("sentiment").eqNullSafe(drop))
    if not categories:
        return kept
    category = F.col("aspect_category")
    return kept.withColumn(
        "aspect_category", F.coalesce(T.lookup(category, categories), category)
    )


def sentence_sentiment(aspects: DataFrame) -> DataFrame:
    """(sentence_id, derived): the one label, else negative if present, else positive."""
    return (
        aspects.filter(F.col("sentence_id").isNotNull() & F.col("sentiment").isNotNull())
        .groupBy("sentence_id")
        .agg(
            F.min("sentiment").alias("lo"),
            F.max("sentiment").alias("hi"),
            F.max(F.col("sentiment") == "negative").alias("negative"),
        )
        .select(
            "sentence_id",
            F.when(F.col("lo") == F.col("hi"), F.col("lo"))
            .when(F.col("negative"), "negative")
            .otherwise("positive")
            .alias("derived"),
        )
    )


def attach_sentiment(
    sentences: DataFrame, aspects: DataFrame, strategy: str = "negative_priority"
) -> DataFrame:
    if strategy != "negative_priority":
        raise ValueError(f"Unsupported strategy: {strategy}; supported: ['negative_priority']")
    out = sentences.join(sentence_sentiment(aspects), "sentence_id", "left")
    return out.withColumn("sentiment", F.coalesce("derived", F.lit("neutral"))).drop("derived")


def clean_rows(
    sentences: DataFrame, lowercase: bool = True, strip_whitespace: bool = True
) -> DataFrame:
    """Cleaned texts, empty ones dropped.

    A generator over a one-element list both computes and drops: a filter on the cleaned column would be
    pushed below the projection with the regex copied into every condition and run several times per row.
    """
    cleaned = F.array(T.clean(F.col("text"), lowercase, strip_whitespace))
    kept = F.explode(F.filter(cleaned, lambda t: F.length(t) > 0)).alias("text")
    return sentences.select(*[kept if c == "text" else c for c in sentences.columns])


def filter_length(
    sentences: DataFrame, lo: int = vocab.MIN_TEXT, hi: int = vocab.MAX_TEXT
) -> DataFrame:
    return sentences.filter(T.within_length(F.col("text"), lo, hi))


def cascade(sentences: DataFrame, aspects: DataFrame) -> DataFrame:
    """Aspects whose sentence survives; a missing id matches a missing id."""
    ids = sentences.select(F.col("sentence_id").alias("__kept"))
    return aspects.join(ids, F.col("sentence_id").eqNullSafe(F.col("__kept")), "left_semi")


def map_labels(categories: Mapping[str, str] = vocab.ASPECT_RENAMES, drop: str = "conflict") -> Step:
    return Step(
        "map_labels",
        lambda f: Frames(f.sentences, label_rows(f.aspects, categories, drop)),
        aspect_columns=("aspect_category", "sentiment"),
        only_removes=True,
    )


def derive_sentiment(strategy: str = "negative_priority") -> Step:
    if strategy != "negative_priority":
        raise ValueError(f"Unsupported strategy: {strategy}; supported: ['negative_priority']")
    return Step(
        "derive_sentiment",
        lambda f: Frames(attach_sentiment(f.sentences, f.aspects, strategy), f.aspects),
        sentence_columns=("sentence_id", "sentiment"),
        only_removes=True,
    )


def clean_text(lowercase: bool = True, strip_whitespace: bool = True) -> Step:
    return Step(
        "clean_text",
        lambda f: Frames(clean_rows(f.sentences, lowercase, strip_whitespace), f.aspects),
        sentence_columns=("text",),
        reads_aspects=False,
        only_removes=True,
    )


def remove_duplicates(order_col: str = "row_order") -> Step:
    return Step(
        "remove_duplicates",
        lambda f: Frames(drop_duplicates_first(f.sentences, ["text"], order_col), f.aspects),
        sentence_columns=("sentence_id", "text"),
        reads_aspects=False,
        only_removes=True,
    )


def limit_length(lo: int = vocab.MIN_TEXT, hi: int = vocab.MAX_TEXT) -> Step:
    return Step(
        "limit_length",
        lambda f: Frames(filter_length(f.sentences, lo, hi), f.aspects),
        sentence_columns=("text",),
        reads_aspects=False,
        only_removes=True,
    )


def split_validation(ratio: float = 0.1, seed: int = 42, stage: bool = True) -> Step:
    """``stage`` writes the sentences once, because the split reads them several times."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must satisfy 0 < ratio < 1")

    def apply(f: Frames) -> Frames:
        rows = materialize(f.sentences, "before-split") if stage else f.sentences
        return Frames(stratified_split(rows, "sentiment", ratio, seed, "sentence_id"), f.aspects)

    return Step(
        "split_validation",
        apply,
        sentence_columns=("split", "sentiment"),
        reads_aspects=False,
        only_removes=True,
    )


def _require_ids(frames: Frames, after: str) -> None:
    for what, df in (("sentences", frames.sentences), ("aspects", frames.aspects)):
        if "sentence_id" not in df.columns:
            raise SchemaError(f"cannot cascade after {after}: {what} frame lacks 'sentence_id'")


def _check_step(step: Step, frames: Frames, strict: bool) -> None:
    for what, df, needed in (
        ("sentence", frames.sentences, step.sentence_columns),
        ("aspect", frames.aspects, step.aspect_columns),
    ):
        missing = sorted(set(needed) - set(df.columns))
        if missing:
            raise SchemaError(f"{step.name} dropped required {what} columns: {missing}")
    if strict and frames.sentences.isEmpty():
        raise SchemaError(f"{step.name} produced no sentences")


def run_steps(
    frames: Frames, steps: Sequence[Step], strict: bool = False, count_rows: bool = False
) -> RunResult:
    """Apply steps in order; aspects of removed sentences are gone before any step can see them.

    Successive cascades over shrinking sentences equal the last one, so the cascade runs only before a step
    that reads aspects or may add sentences, and at the end. Column checks cost nothing (they read the
    plan). ``strict`` also runs an emptiness job per step. ``count_rows`` attaches observations, filled when
    the result is next computed, instead of counting.
    """
    _require_ids(frames, "input")
    result, pending = RunResult(frames), False
    for position, step in enumerate(steps):
        now = result.frames
        if pending and (step.reads_aspects or not step.only_removes):
            now = Frames(now.sentences, cascade(now.sentences, now.aspects))
        out = step.apply(now)
        _require_ids(out, step.name)
        if count_rows:
            watch = Observation(f"{position}_{step.name}")
            out = Frames(
                out.sentences.observe(watch, F.count(F.lit(1)).alias("sentences")), out.aspects
            )
            result.counts[step.name] = watch
        result.frames, pending = out, True
        _check_step(step, out, strict)
    last = result.frames
    if pending:
        result.frames = Frames(last.sentences, cascade(last.sentences, last.aspects))
    return result
