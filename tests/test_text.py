import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from labelflow.functions import contracts as C
from labelflow.functions import labels as L
from labelflow.functions import probs as P
from labelflow.functions import text as T
from labelflow.functions import vocab


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def many(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_language(spark):
    texts = [
        "ok", "Dịch vụ này rất tuyệt vời và đáng tiền", "The food was great", "", None, "  two words ",
        "a b c", "ĐỒ ĂN NGON", "c'est très bon", "\t\n", "x" * 5000, "one\x1ctwo\u00a0three",
    ]
    got = [(r["lang"], r["confidence"]) for r in many(spark, T.detect_language, texts)]
    marks = re.compile(f"[{vocab.VIETNAMESE_LETTERS}]", re.IGNORECASE)

    def want(t):
        t = (t or "").strip()
        if len(t.split()) < 3:
            return ("en", 0.0)
        return ("vi", 0.99) if marks.search(t) else ("en", 0.75)

    assert got == [want(t) for t in texts]


def test_letter_class_covers_exactly_both_cases():
    marks = re.compile(f"[{vocab.VIETNAMESE_LETTERS}]", re.IGNORECASE)
    ours = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", T.VIETNAMESE))
    for cp in range(0x20, 0x3000):
        assert bool(marks.match(chr(cp))) == bool(ours.match(chr(cp))), hex(cp)


def test_language_resolve(spark):
    df = spark.createDataFrame([("vi", "plain text here"), ("", "plain text here"), (None, "ok")], "l string, t string")
    got = [tuple(r[0]) for r in df.select(T.resolve_language(F.col("l"), F.col("t"))).collect()]
    assert got == [("vi", 1.0), ("en", 0.75), ("en", 0.0)]


def test_small_language_rules(spark):
    assert many(spark, T.language_label, ["en", "vi", "fr", None]) == ["en", "vi", "other", "other"]
    assert many(spark, T.is_supported_language, ["en", "fr", None]) == [True, False, False]
    assert many(spark, T.language_or_default, ["vi", None]) == ["vi", "en"]


def script(text):
    best, top = None, 0
    for name, ranges in vocab.SCRIPT_RANGES.items():
        n = sum(any(lo <= ord(c) <= hi for lo, hi in ranges) for c in text or "")
        if n > top:
            best, top = name, n
    return best


def test_dominant_script(spark):
    texts = ["hello", "한국어 text!", "中文 ab", "ab 中文", "ひらがな漢字", "ﻻ", "مرحبا x", "नमस्ते", "123 !?", "", None, "[]_^`\\", "Привет", "é한", "😀漢"]
    assert many(spark, T.dominant_script, texts) == [script(t) for t in texts]
    assert many(spark, T.script_locale, ["ko", "latin", None]) == ["ko-KR", "", None]


def test_tokens_and_key(spark):
    texts = ["  Great   FOOD!  ", "", " ", None, "a\x1cb c", "x"]
    assert many(spark, T.tokens, texts) == [(t or "").split() for t in texts]
    assert many(spark, T.text_key, texts[:4]) == ["great food!", "", "", "nan"]


def test_social(spark):
    rows = {
        "see https://x.y/z?q=1 and www.Q.com now": "see and now",
        "hi @user_1!": "hi !",
        "soooo goood!!!!": "soo good!!",
        "#BestFood2024x yes": "Best Food 2024 x yes",
        "#two_parts": "two parts",
        "gr8 U know": "great you know",
        "👍☀️": "good",
        "": "",
    }
    assert many(spark, T.clean_social, list(rows)) == list(rows.values())
    off = lambda c: T.clean_social(c, False, False, False, False, {}, {}, False)
    assert one(spark, off, "soooo  #A @b www.c.d 👍") == "soooo #A @b www.c.d 👍"


def test_decode(spark):
    assert many(spark, lambda c: L.decode(c, vocab.EN_CODES), [0, 2, 9, None], "int") == ["positive", "negative", None, None]
    assert many(spark, lambda c: L.decode(c, vocab.VI_CODES, "unknown"), [0, 2, 9], "int") == ["negative", "positive", "unknown"]
    assert many(spark, lambda c: L.decode(c, vocab.VI_CODES, "raise"), [2, 1, 0], "int") == ["positive", "neutral", "negative"]
    with pytest.raises(Exception, match="unknown label code: 7"):
        many(spark, lambda c: L.decode(c, vocab.VI_CODES, "raise"), [7], "int")


def test_resolve_and_stratum(spark):
    assert many(spark, lambda c: L.resolve(c, vocab.IRONY), ["0", "1", "irony"]) == ["non_irony", "irony", "irony"]
    df = spark.createDataFrame([("en", "positive"), ("vi", None)], "a string, b string")
    assert [r[0] for r in df.select(L.stratum_key(F.col("a"), F.col("b"))).collect()] == ["en__positive", "vi__nan"]


def test_probabilities(spark):
    logits = [1.0, 3.0, 3.0]
    p = one(spark, P.softmax, logits, "array<double>")
    total = sum(math.exp(x) for x in logits)
    assert p == pytest.approx([math.exp(x) / total for x in logits])
    assert one(spark, P.argmax_index, logits, "array<double>") == 1
    assert one(spark, lambda c: P.argmax_label(c, vocab.MODEL_SENTIMENTS), logits, "array<double>") == "neutral"
    assert one(spark, P.confidence, [0.12345, 0.1], "array<double>") == 0.1234  # half to even
    flags = many(spark, P.sarcasm_flag, [[0.3, 0.2, 0.5], [0.2, 0.3, 0.5], [0.4, 0.4, 0.2]], "array<double>")
    assert flags == [False, True, False]
    assert one(spark, P.softmax, [1000.0, 0.0], "array<double>") == pytest.approx([1.0, 0.0])


def test_json_safe(spark):
    values = [1.5, float("nan"), float("inf"), float("-inf"), None]
    assert many(spark, P.json_safe, values, "double") == [1.5, None, None, None, None]


def test_contracts(spark):
    assert many(spark, C.request_violations, ["ok", "", "x" * 2000, "x" * 2001, None]) == [
        [], ["text_too_short"], [], ["text_too_long"], ["text_too_short", "text_too_long"],
    ]
    df = spark.createDataFrame([("positive", 1.0), ("POSITIVE", 1.01), (None, float("nan"))], "s string, c double")
    got = [r[0] for r in df.select(C.prediction_violations(F.col("s"), F.col("c"))).collect()]
    assert got == [[], ["bad_sentiment", "bad_confidence"], ["bad_sentiment", "bad_confidence"]]
    valid, rejected = C.split_valid(df, C.prediction_violations(F.col("s"), F.col("c")))
    assert valid.count() == 1 and rejected.count() == 2 and valid.columns == ["s", "c"]
    two = spark.createDataFrame([(["a"], [1.0]), (["a"], [1.0, 2.0])], "t array<string>, v array<double>")
    assert [r[0] for r in two.select(C.attribution_violations(F.col("t"), F.col("v"))).collect()] == [[], ["length_mismatch"]]
    assert many(spark, C.language_violations, ["en", "fr"]) == [[], ["unsupported_language"]]


def test_decomposed_letters_do_not_count(spark):
    text = unicodedata.normalize("NFD", "rất tuyệt vời")
    assert one(spark, T.detect_language, text)["lang"] == "en"
