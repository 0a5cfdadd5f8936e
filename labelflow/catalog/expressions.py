"""Column expressions: decode/encode, language, script, contracts, probabilities, upload cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.catalog.registry import query
from labelflow.catalog.scans import EN
from labelflow.catalog.views import Tables, WS, r6, sql, sql_collapse, sql_hash_int
from labelflow.functions import contracts as C
from labelflow.functions import labels as L
from labelflow.functions import probs as P
from labelflow.functions import text as T
from labelflow.functions import vocab
from labelflow.functions.hashing import hash_int, hash_key
from labelflow.operators.scoring import clean_upload


@query(
    "label_decode_p4",
    sql(
        f"""SELECT sentence_id, {EN} AS known, coalesce({EN}, 'unknown') AS filled FROM coded_en""",
        "coded_en",
    ),
)
def label_decode(t: Tables):
    code = F.col("label")
    return t.coded_en.select(
        "sentence_id",
        L.decode(code, vocab.EN_CODES).alias("known"),
        L.decode(code, vocab.EN_CODES, "unknown").alias("filled"),
    )


@query(
    "label_encode_p5",
    sql(
        """SELECT id, CASE y_true WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END::INTEGER AS y_true
           FROM predictions""",
        "predictions",
    ),
)
def label_encode(t: Tables):
    rows = t.predictions.select("id", "y_true")
    return L.encode(rows, "y_true", vocab.MODEL_SENTIMENTS)


@query(
    "true_label_p6",
    sql(
        """SELECT row_order, CASE row_order % 4 WHEN 0 THEN 'non_irony' WHEN 1 THEN 'irony'
                  WHEN 2 THEN 'non_irony' ELSE 'irony' END AS label FROM sentences""",
        "sentences",
    ),
)
def true_label(t: Tables):
    d = F.col("row_order")
    value = F.when(d % 4 == 2, "non_irony").when(d % 4 == 3, "irony").otherwise((d % 4).cast("string"))
    return t.sentences.select("row_order", L.resolve(value, vocab.IRONY).alias("label"))


@query(
    "language_default_p8",
    sql(
        """SELECT sentence_id, coalesce(CASE WHEN row_order % 3 <> 0 THEN lang END, 'en') AS lang
           FROM sentences""",
        "sentences",
    ),
)
def language_default(t: Tables):
    lang = F.when(F.col("row_order") % 3 != 0, F.col("lang"))
    return t.sentences.select("sentence_id", T.language_or_default(lang).alias("lang"))


BODY = sql_collapse("coalesce(text, '')")
SHORT = f"{BODY} = '' OR len(string_split({BODY}, ' ')) < 3"
MARKED = f"regexp_matches({BODY}, '(?i)[{vocab.VIETNAMESE_LETTERS}]')"


@query(
    "language_detect_p9",
    sql(
        f"""SELECT row_order, CASE WHEN {SHORT} THEN 'en' WHEN {MARKED} THEN 'vi' ELSE 'en' END AS lang,
                   CASE WHEN {SHORT} THEN 0.0 WHEN {MARKED} THEN 0.99 ELSE 0.75 END::DOUBLE AS confidence
            FROM dirty_sentences""",
        "dirty_sentences",
    ),
)
def language_detect(t: Tables):
    found = T.detect_language(F.col("text"))
    return t.dirty.sentences.select("row_order", found.alias("d")).select("row_order", "d.lang", "d.confidence")


@query(
    "language_resolve_p10",
    sql(
        f"""SELECT sentence_id,
               CASE WHEN given <> '' THEN given WHEN {SHORT} THEN 'en' WHEN {MARKED} THEN 'vi'
                    ELSE 'en' END AS lang,
               CASE WHEN given <> '' THEN 1.0 WHEN {SHORT} THEN 0.0 WHEN {MARKED} THEN 0.99
                    ELSE 0.75 END::DOUBLE AS confidence
            FROM (SELECT *, CASE row_order % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lang END AS given
                  FROM sentences)""",
        "sentences",
    ),
)
def language_resolve(t: Tables):
    d = F.col("row_order")
    given = F.when(d % 3 == 1, "").when(d % 3 == 2, F.col("lang"))
    found = T.resolve_language(given, F.col("text"))
    return t.sentences.select("sentence_id", found.alias("d")).select("sentence_id", "d.lang", "d.confidence")


@query(
    "supported_language_p11",
    sql("SELECT sentence_id, lang, lang IN ('en', 'vi') AS supported FROM sentences", "sentences"),
)
def supported_language(t: Tables):
    return t.sentences.select(
        "sentence_id", "lang", T.is_supported_language(F.col("lang")).alias("supported")
    )


@query(
    "language_label_p12",
    sql(
        """SELECT CASE WHEN lang IN ('en', 'vi') THEN lang ELSE 'other' END AS label, count(*) AS n
           FROM sentences GROUP BY 1""",
        "sentences",
    ),
)
def language_label(t: Tables):
    return t.sentences.groupBy(T.language_label(F.col("lang")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "request_contract_p13",
    sql(
        """SELECT row_order,
               concat_ws(',', CASE WHEN coalesce(length(text) < 1, true) THEN 'text_too_short' END,
                              CASE WHEN coalesce(length(text) > 2000, true) THEN 'text_too_long' END)
               AS violations FROM dirty_sentences""",
        "dirty_sentences",
    ),
)
def request_contract(t: Tables):
    codes = C.request_violations(F.col("text"))
    return t.dirty.sentences.select("row_order", F.array_join(codes, ",").alias("violations"))


@query(
    "prediction_contract_p13",
    sql(
        """SELECT id, concat_ws(',',
               CASE WHEN lower(left(id, 1)) = '1' THEN 'bad_sentiment' END,
               CASE WHEN confidence * 1.1::DOUBLE > 1 THEN 'bad_confidence' END) AS violations
           FROM predictions
           WHERE lower(left(id, 1)) = '1' OR confidence * 1.1::DOUBLE > 1""",
        "predictions",
    ),
)
def prediction_contract(t: Tables):
    """Only the rejected rows."""
    rows = t.predictions.select(
        "id",
        F.when(F.col("id").startswith("1"), F.upper("y_pred")).otherwise(F.col("y_pred")).alias("y_pred"),
        (F.col("confidence") * F.lit(1.1)).alias("confidence"),
    )
    _, rejected = C.split_valid(rows, C.prediction_violations(F.col("y_pred"), F.col("confidence")))
    return rejected.select("id", F.array_join("violations", ",").alias("violations"))


@query(
    "attribution_contract_p13",
    sql(
        f"""SELECT sentence_id, CASE WHEN len(tokens) <> greatest(len(tokens) - (row_order % 2), 0)
                   THEN 'length_mismatch' ELSE '' END AS violations
            FROM (SELECT sentence_id, row_order,
                         list_filter(string_split({BODY}, ' '), lambda x: x <> '') AS tokens
                  FROM sentences)""",
        "sentences",
    ),
)
def attribution_contract(t: Tables):
    tokens = T.tokens(F.col("text"))
    rows = t.sentences.select("sentence_id", "row_order", tokens.alias("tokens"))
    kept = F.greatest(F.size("tokens") - (F.col("row_order") % 2), F.lit(0)).cast("int")
    values = F.slice(F.transform("tokens", lambda w: F.length(w).cast("double")), F.lit(1), kept)
    codes = C.attribution_violations(F.col("tokens"), F.col("values"))
    return rows.withColumn("values", values).select(
        "sentence_id", F.array_join(codes, ",").alias("violations")
    )


@query(
    "stratum_key_p15",
    sql(
        """SELECT coalesce(split, 'nan') || '__' || coalesce(sentiment, 'nan') AS stratum, count(*) AS n
           FROM dirty_sentences GROUP BY 1""",
        "dirty_sentences",
    ),
)
def stratum_key(t: Tables):
    key = L.stratum_key(F.col("split"), F.col("sentiment"))
    return t.dirty.sentences.groupBy(key.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "json_safe_p18",
    sql(
        """SELECT row_order, CASE WHEN row_order % 5 < 3 THEN NULL ELSE n_chars / 7.0::DOUBLE END AS value
           FROM sentences""",
        "sentences",
    ),
)
def json_safe(t: Tables):
    d = F.col("row_order")
    value = (
        F.when(d % 5 == 0, float("nan"))
        .when(d % 5 == 1, float("inf"))
        .when(d % 5 == 2, float("-inf"))
        .otherwise(F.col("n_chars") / F.lit(7.0))
    )
    return t.sentences.select("row_order", P.json_safe(value).alias("value"))


def logits():
    """Three stand-in logits per sentence, multiples of 1/16 so that ties occur and sums are exact."""
    part = lambda i: (hash_int(hash_key(i, F.col("sentence_id"))) % 64) / 16.0
    return F.array(part(0), part(1), part(2))


SQL_LOGITS = "[" + ", ".join(f"({sql_hash_int(repr(str(i)), 'sentence_id')} % 64) / 16.0::DOUBLE" for i in range(3)) + "]"
SQL_PROBS = f"""
    SELECT sentence_id, list_transform(l, lambda x: exp(x - list_max(l))
               / list_sum(list_transform(l, lambda y: exp(y - list_max(l))))) AS p, l
    FROM (SELECT sentence_id, {SQL_LOGITS} AS l FROM sentences)"""


@query(
    "softmax_argmax_p19",
    sql(
        """SELECT sentence_id, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2,
                  ['negative', 'neutral', 'positive'][list_position(l, list_max(l))] AS sentiment,
                  round_even(list_max(p), 4) AS confidence FROM probs""",
        "sentences",
        extra={"probs": SQL_PROBS},
    ),
)
def softmax_argmax(t: Tables):
    rows = t.sentences.select("sentence_id", P.softmax(logits()).alias("p"))
    p = F.col("p")
    return rows.select(
        "sentence_id",
        *[r6(F.get(p, F.lit(i))).alias(f"p{i}") for i in range(3)],
        P.argmax_label(p, vocab.MODEL_SENTIMENTS).alias("sentiment"),
        P.confidence(p).alias("confidence"),
    )


@query(
    "sarcasm_flag_p20",
    sql(
        "SELECT sentence_id, l[2] > l[1] AS sarcasm_flag FROM probs", "sentences", extra={"probs": SQL_PROBS}
    ),
)
def sarcasm_flag(t: Tables):
    rows = t.sentences.select("sentence_id", P.softmax(logits()).alias("p"))
    return rows.select("sentence_id", P.sarcasm_flag(F.col("p")).alias("sarcasm_flag"))


SQL_UPLOAD = f"""
    SELECT row_order, regexp_replace(coalesce(CASE row_order % 11 WHEN 0 THEN NULL WHEN 1 THEN '  ' || chr(10)
               ELSE text END, 'nan'), '^{WS}|{WS}$', '', 'g') AS text FROM sentences"""


def upload_text():
    d = F.col("row_order")
    return F.when(d % 11 == 1, "  \n").when(d % 11 != 0, F.col("text"))


@query(
    "upload_clean_p21",
    sql(
        """SELECT row_order, md5(text) AS text_md5,
                  CASE WHEN text = '' THEN 'Empty text — skipped' END AS error FROM upload""",
        "sentences",
        extra={"upload": SQL_UPLOAD},
    ),
)
def upload_clean(t: Tables):
    text, error = clean_upload(upload_text())
    rows = t.sentences.select("row_order", text.alias("text"), error.alias("error"))
    return rows.select("row_order", F.md5("text").alias("text_md5"), "error")


def _range_class(ranges) -> str:
    return "[" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges) + "]"


SQL_COUNTS = ", ".join(
    f"length(x) - length(regexp_replace(x, '{_range_class(r)}', '', 'g')) AS {name}"
    for name, r in vocab.SCRIPT_RANGES.items()
)
SQL_TOP = "greatest(" + ", ".join(vocab.SCRIPT_RANGES) + ")"
SQL_SCRIPT = (
    "CASE "
    + f"WHEN {SQL_TOP} = 0 THEN NULL "
    + " ".join(f"WHEN {s} = {SQL_TOP} THEN '{s}'" for s in vocab.SCRIPT_RANGES)
    + " END"
)
# Letters of other scripts mixed into the text so that every range is exercised.
SCRIPT_MIX = {1: "한국어 문장", 2: "中文句子", 3: "ひらがな", 4: "جملة", 5: "वाक्य"}


@query(
    "dominant_script_p22",
    sql(
        f"""SELECT row_order, script, CASE script WHEN 'ko' THEN 'ko-KR' WHEN 'zh' THEN 'zh-CN'
                WHEN 'ja' THEN 'ja-JP' WHEN 'ar' THEN 'ar-SA' WHEN 'hi' THEN 'hi-IN'
                WHEN 'latin' THEN '' END AS locale
            FROM (SELECT row_order, {SQL_SCRIPT} AS script FROM (SELECT row_order, {SQL_COUNTS} FROM (
                  SELECT row_order, CASE row_order % 9 {" ".join(f"WHEN {k} THEN repeat('{v}', 1 + (row_order % 5)::INTEGER * 300) || text" for k, v in SCRIPT_MIX.items())}
                         WHEN 6 THEN '123 !' WHEN 7 THEN '' ELSE text END AS x FROM sentences)))""",
        "sentences",
    ),
)
def dominant_script(t: Tables):
    d = F.col("row_order")
    times = (F.lit(1) + (d % 5) * 300).cast("int")
    mixed = F.when(d % 9 == 6, "123 !").when(d % 9 == 7, "")
    for k, v in SCRIPT_MIX.items():
        mixed = mixed.when(d % 9 == k, F.concat(F.repeat(F.lit(v), times), "text"))
    rows = t.sentences.select("row_order", mixed.otherwise(F.col("text")).alias("x"))
    script = T.dominant_script(F.col("x"))
    return rows.select("row_order", script.alias("script")).withColumn(
        "locale", T.script_locale(F.col("script"))
    )


def _sql_social() -> str:
    out = "x"
    out = rf"regexp_replace({out}, '(?i)(https?://|www\.)[^\s]+', ' ', 'g')"
    out = f"regexp_replace({out}, '@[A-Za-z0-9_]+', ' ', 'g')"
    for sign, word in T.EMOJI.items():
        out = f"replace({out}, '{sign}', ' {word} ')"
    out = rf"regexp_replace({out}, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{FE0F}}]', ' ', 'g')"
    out = sql_collapse(out)
    chars = f"string_split({out}, '')"
    runs = (
        f"(SELECT array_to_string(list_filter(c, lambda ch, i: NOT (i > 2 AND ch = c[i-1] AND ch = c[i-2])), '')"
        f" FROM (SELECT {chars} AS c))"
    )
    tag = "regexp_replace(regexp_replace(regexp_replace(w, '[#_]', ' ', 'g'), '([a-z])([A-Z0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
    slang = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.SLANG.items())
    words = (
        f"array_to_string(list_transform(string_split({runs}, ' '), lambda w: CASE WHEN w LIKE '#%' THEN {tag}"
        f" ELSE (CASE lower(w) {slang} ELSE w END) END), ' ')"
    )
    return sql_collapse(words)


SOCIAL_PREFIX = " Gr8 u #BestFood2024x @someone_1 https://a.b/c?d=1 soooo 😊😊 ☀ #a_b www.x.y THX "


@query(
    "social_clean_p23",
    sql(
        f"""SELECT row_order, md5({_sql_social()}) AS text_md5
            FROM (SELECT row_order, CASE WHEN row_order % 3 = 0 THEN '{SOCIAL_PREFIX}' ELSE '' END || text AS x
                  FROM sentences)""",
        "sentences",
    ),
)
def social_clean(t: Tables):
    prefix = F.when(F.col("row_order") % 3 == 0, SOCIAL_PREFIX).otherwise("")
    rows = t.sentences.select("row_order", F.concat(prefix, "text").alias("x"))
    return rows.select("row_order", F.md5(T.clean_social(F.col("x"))).alias("text_md5"))
