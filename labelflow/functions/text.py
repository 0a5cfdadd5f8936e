"""Text expressions: cleaning, keys, language and script detection. All are plain Columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelflow.functions import vocab

# Java's \s is ASCII only; (?U) adds Unicode white space, and the separators 1C-1F complete the set.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def collapse(text: Column) -> Column:
    """Every white-space run to one space, ends stripped."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def clean(text: Column, lowercase: bool = True, strip_whitespace: bool = True) -> Column:
    out = F.coalesce(text, F.lit(""))
    if lowercase:
        out = F.lower(out)
    return collapse(out) if strip_whitespace else out


def text_key(text: Column) -> Column:
    """Dedup key. A missing text keys as the word ``nan``, so missing texts are copies of each other."""
    return collapse(F.lower(F.coalesce(text, F.lit("nan"))))


def tokens(text: Column) -> Column:
    """White-space tokens; an empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITESPACE, -1), lambda t: t != "")


def within_length(text: Column, lo: int = vocab.MIN_TEXT, hi: int = vocab.MAX_TEXT) -> Column:
    return F.length(text).between(lo, hi)


def _char_class(letters: str) -> str:
    """Regex class of the letters in both cases, neighbours merged to ranges (much cheaper than (?iu))."""
    points = sorted({ord(c) for c in letters + letters.upper()})
    out, start = "", points[0]
    for here, after in zip(points, [*points[1:], None]):
        if after != here + 1:
            out += f"\\x{{{start:X}}}-\\x{{{here:X}}}"
            start = after
    return f"[{out}]"


VIETNAMESE = _char_class(vocab.VIETNAMESE_LETTERS)


def has_tokens(text: Column, n: int) -> Column:
    """Whether the text has at least ``n`` white-space tokens. Anchored, so it reads only their characters."""
    gap, word = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"
    more = f"(?:{word}++{gap}++){{{n - 1}}}"
    return F.coalesce(text, F.lit("")).rlike(rf"(?U)\A{gap}*+{more}{word}")


def detect_language(
    text: Column, default: str = vocab.DEFAULT_LANGUAGE, min_tokens: int = vocab.MIN_TOKENS
) -> Column:
    """struct(lang, confidence): too short, any Vietnamese letter, or English."""

    def result(lang: str, confidence: float) -> Column:
        return F.struct(F.lit(lang).alias("lang"), F.lit(confidence).alias("confidence"))

    marked = text.rlike(VIETNAMESE)
    return F.when(~has_tokens(text, max(min_tokens, 1)), result(default, 0.0)).when(
        marked, result("vi", 0.99)
    ).otherwise(result("en", 0.75))


def resolve_language(requested: Column, text: Column) -> Column:
    """A non-empty requested language wins with confidence 1.0."""
    given = F.struct(requested.alias("lang"), F.lit(1.0).alias("confidence"))
    return F.when(F.coalesce(requested, F.lit("")) != "", given).otherwise(detect_language(text))


def language_or_default(lang: Column, default: str = vocab.DEFAULT_LANGUAGE) -> Column:
    return F.coalesce(lang, F.lit(default))


def language_label(lang: Column) -> Column:
    """Low-cardinality label for metrics."""
    return F.when(lang.isin(*vocab.SUPPORTED_LANGUAGES), lang).otherwise("other")


def is_supported_language(lang: Column) -> Column:
    return F.coalesce(lang.isin(*vocab.SUPPORTED_LANGUAGES), F.lit(False))


def _outside(ranges) -> str:
    """Runs of characters outside the ranges: removing runs is cheaper than removing single letters."""
    return "[^" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges) + "]+"


def dominant_script(text: Column) -> Column:
    """Script with most code points, earlier script on ties, null when no script occurs.

    One pass drops everything below U+0600; the other scripts are then counted in what is left, usually
    nothing.
    """
    body = F.coalesce(text, F.lit(""))
    high = F.regexp_replace(body, r"[\x{0}-\x{5FF}]+", "")

    def pick(rest: Column) -> Column:
        scored = [
            F.struct(
                F.length(
                    F.regexp_replace(body if name == "latin" else rest, _outside(ranges), "")
                ).alias("n"),
                F.lit(-rank).alias("rank"),
                F.lit(name).alias("script"),
            )
            for rank, (name, ranges) in enumerate(vocab.SCRIPT_RANGES.items())
        ]
        nothing = F.struct(
            F.lit(0).alias("n"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("script")
        )
        return F.array_max(F.array(*scored, nothing))["script"]

    return bind(high, pick)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def script_locale(script: Column) -> Column:
    return lookup(script, vocab.SCRIPT_LOCALES)


def lookup(key: Column, mapping: Mapping) -> Column:
    """Value of ``key`` in a small literal mapping, null when absent."""
    out = None
    for name, value in mapping.items():
        out = (F.when if out is None else out.when)(key == F.lit(name), F.lit(value))
    return F.lit(None).cast("string") if out is None else out


def map_lookup(key: Column, mapping: Mapping[str, object]) -> Column:
    """Like :func:`lookup` for use inside lambdas: the key expression is evaluated once per call."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


# Our own starter dictionaries for the social-text cleaner; pass others as arguments.
SLANG = {"u": "you", "gr8": "great", "pls": "please", "thx": "thanks", "ko": "không", "dc": "được"}
EMOJI = {"😊": "smile", "😞": "sad", "😡": "angry", "👍": "good", "👎": "bad", "❤": "love"}
OTHER_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"


def clean_social(
    text: Column,
    urls: bool = True,
    mentions: bool = True,
    repeats: bool = True,
    hashtags: bool = True,
    slang: Mapping[str, str] | None = None,
    emoji: Mapping[str, str] | None = None,
    drop_other_emoji: bool = True,
) -> Column:
    """Review and social-media cleaner; every rule can be switched off.

    URLs and @mentions go, emoji and slang words are replaced from small dictionaries, runs of three or
    more equal characters become two, and a ``#TagName2024`` token becomes its words.
    """
    out = F.coalesce(text, F.lit(""))
    if urls:
        out = F.regexp_replace(out, r"(?i)(https?://|www\.)[^\s]+", " ")
    if mentions:
        out = F.regexp_replace(out, r"@[A-Za-z0-9_]+", " ")
    for sign, word in (EMOJI if emoji is None else emoji).items():
        out = F.replace(out, F.lit(sign), F.lit(f" {word} "))
    if drop_other_emoji:
        out = F.regexp_replace(out, OTHER_EMOJI, " ")
    out = collapse(out)
    if repeats:
        out = F.regexp_replace(out, r"(?s)(.)\1{2,}", "$1$1")
    words = SLANG if slang is None else slang

    def token(t: Column) -> Column:
        word = F.coalesce(map_lookup(F.lower(t), words), t) if words else t
        return F.when(t.startswith("#"), _tag_words(t)).otherwise(word) if hashtags else word

    if hashtags or words:
        out = collapse(F.array_join(F.transform(F.split(out, " ", -1), token), " "))
    return out


def _tag_words(tag: Column) -> Column:
    """Words of a hash tag, split at lower-to-upper, letter-to-digit and digit-to-letter borders and ``_``."""
    out = F.regexp_replace(tag, "[#_]", " ")
    out = F.regexp_replace(out, "([a-z])([A-Z0-9])", "$1 $2")
    return F.regexp_replace(out, "([0-9])([A-Za-z])", "$1 $2")
