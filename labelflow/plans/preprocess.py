"""The dataset build: label map, sentiment, clean, dedup, length filter, validation split, cascade."""

from __future__ import annotations

from dataclasses import dataclass, field

from labelflow.functions import vocab
from labelflow.operators import frames as fr
from labelflow.operators.dedup import drop_duplicates_first
from labelflow.operators.frames import Frames, Step
from labelflow.operators.sampling import stratified_split
from labelflow.session import materialize


@dataclass(frozen=True)
class BuildConfig:
    validation_ratio: float = 0.1
    seed: int = 42
    lowercase: bool = True
    strip_whitespace: bool = True
    remove_duplicates: bool = True
    min_length: int = vocab.MIN_TEXT
    max_length: int = vocab.MAX_TEXT
    strategy: str = "negative_priority"
    categories: dict = field(default_factory=lambda: dict(vocab.ASPECT_RENAMES))


def default_steps(cfg: BuildConfig = BuildConfig(), order_col: str = "row_order") -> list[Step]:
    """The same build as separate steps, for :func:`labelflow.operators.frames.run_steps`."""
    steps = [
        fr.map_labels(cfg.categories),
        fr.derive_sentiment(cfg.strategy),
        fr.clean_text(cfg.lowercase, cfg.strip_whitespace),
    ]
    if cfg.remove_duplicates:
        steps.append(fr.remove_duplicates(order_col))
    steps.append(fr.limit_length(cfg.min_length, cfg.max_length))
    steps.append(fr.split_validation(cfg.validation_ratio, cfg.seed))
    return steps


def build_dataset(
    raw: Frames,
    cfg: BuildConfig = BuildConfig(),
    order_col: str = "row_order",
    stage: bool = True,
) -> Frames:
    """Same result as running :func:`default_steps`, planned for large tables.

    * Length is filtered before dedup: copies share their length, so the two commute and dropped rows are
      never shuffled.
    * Sentiment is attached after dedup, to survivors only; nothing before it reads the sentiment.
    * No step removes sentences between the label map and the sentiment, so one final cascade is enough.
    * ``stage`` writes the survivors once; the split's counting passes then read two narrow columns
      of that table instead of repeating the dedup shuffle.
    """
    aspects = fr.label_rows(raw.aspects, cfg.categories)
    sentences = fr.clean_rows(raw.sentences, cfg.lowercase, cfg.strip_whitespace)
    sentences = fr.filter_length(sentences, cfg.min_length, cfg.max_length)
    if cfg.remove_duplicates:
        sentences = drop_duplicates_first(sentences, ["text"], order_col)
    sentences = fr.attach_sentiment(sentences, aspects, cfg.strategy)
    if stage:
        sentences = materialize(sentences, "survivors")
    sentences = stratified_split(sentences, "sentiment", cfg.validation_ratio, cfg.seed, "sentence_id")
    return Frames(sentences, fr.cascade(sentences, aspects))
