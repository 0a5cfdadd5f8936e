"""Scoring, aspects, attribution, batch results."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from labelflow.catalog.expressions import BODY, SQL_UPLOAD, upload_text
from labelflow.catalog.registry import query
from labelflow.catalog.sampling_draws import TRAINING_HALVES
from labelflow.catalog.views import OPINION_WORDS, Tables, WS, r6, sentiment_rates, sql, sql_clean, sql_hash
from labelflow.functions import vocab
from labelflow.functions.text import detect_language, language_label, tokens
from labelflow.operators import aspects as a
from labelflow.operators import attribution as at
from labelflow.operators import metrics as m
from labelflow.operators import scoring as s
from labelflow.plans import passes as ps
from labelflow.plans import training as tr
from labelflow.session import materialize
from labelflow.sources import sinks as sk

CLASSES = vocab.MODEL_SENTIMENTS
INTERCEPT = (0.125, 0.25, 0.0)
# A small demonstration lexicon: frequent tokens of the test texts plus a few opinion words. Weights are
# multiples of 1/8, so sums are exact in any order.
TOKENS = (
    "the of de and to in la der is that en for it on was die with que le be as und des by "
    "good great bad terrible love hate"
).split()
LEXICON = {
    w: tuple(((i * 7 + c * 3) % 11 - 5) / 8.0 for c in range(3)) for i, w in enumerate(TOKENS)
}


def lexicon(t: Tables):
    rows = [(w, *v) for w, v in LEXICON.items()]
    return t.spark.createDataFrame(rows, "token string, " + ", ".join(f"{c} double" for c in CLASSES))


SQL_LEXICON = "SELECT * FROM (VALUES " + ", ".join(
    f"('{w}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE)" for w, v in LEXICON.items()
) + ") x(token, negative, neutral, positive)"


def sql_scored(source: str, ident: str = "sentence_id") -> dict[str, str]:
    """CTEs ``lex``, ``toks`` (id, pos, token) and ``scored`` (id, l, p) for a source with ``text``."""
    return {
        "lex": SQL_LEXICON,
        "words": f"""SELECT {ident} AS id, list_filter(string_split({sql_clean()}, ' '), lambda x: x <> '') AS w
            FROM {source}""",
        "toks": """SELECT id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM words""",
        "logits": f"""
            SELECT w.id, [{INTERCEPT[0]}::DOUBLE + coalesce(n, 0), {INTERCEPT[1]}::DOUBLE + coalesce(u, 0),
                          {INTERCEPT[2]}::DOUBLE + coalesce(p, 0)] AS l
            FROM words w LEFT JOIN (SELECT id, sum(negative) AS n, sum(neutral) AS u, sum(positive) AS p
                                    FROM toks JOIN lex USING (token) GROUP BY 1) x ON w.id = x.id""",
        "scored": """
            SELECT id, l, p, ['negative', 'neutral', 'positive'][list_position(l, list_max(l))] AS sentiment,
                   round_even(list_max(p), 4) AS confidence
            FROM (SELECT id, l, list_transform(l, lambda x: exp(x - list_max(l))
                  / list_sum(list_transform(l, lambda y: exp(y - list_max(l))))) AS p FROM logits)""",
    }


def native(t: Tables, rows, id_col="sentence_id"):
    return s.from_logits(s.linear_logits(rows, lexicon(t), CLASSES, INTERCEPT, "text", id_col), CLASSES)


def make_python_scorer():
    """The same linear scorer as plain Python, standing in for a model.

    Nested functions are shipped to the workers by value, so the package need not be installed there.
    """
    lexicon_, intercept = dict(LEXICON), list(INTERCEPT)

    def factory():
        import math

        def run(texts: list[str]) -> list[list[float]]:
            out = []
            for text in texts:
                logits = list(intercept)
                for word in text.lower().split():
                    for c, w in enumerate(lexicon_.get(word, ())):
                        logits[c] += w
                top = max(logits)
                exps = [math.exp(x - top) for x in logits]
                total = sum(exps)
                out.append([e / total for e in exps])
            return out

        return run

    return factory


SCORES = """SELECT id AS sentence_id, sentiment, confidence, round(p[1], 6) AS p0, round(p[3], 6) AS p2
    FROM scored"""


def score_columns(df):
    p = F.col("probs")
    return df.select(
        "sentence_id",
        "sentiment",
        "confidence",
        r6(F.get(p, F.lit(0))).alias("p0"),
        r6(F.get(p, F.lit(2))).alias("p2"),
    )


@query("linear_scorer_m2", sql(SCORES, "sentences", extra=sql_scored("sentences")))
def linear_scorer(t: Tables):
    return score_columns(native(t, t.sentences))


@query("batch_scorer_m1", sql(SCORES, "sentences", extra=sql_scored("sentences")))
def batch_scorer(t: Tables):
    """The Python scorer in 32-text calls over all rows."""
    return score_columns(s.score(t.sentences, make_python_scorer(), batch_size=32))


DETECTED = "SELECT sentence_id, aspect, score FROM aspect_scores WHERE score > 0.45"
BEST = """
    SELECT sentence_id, aspect, sentiment, round_even(score, 4) AS confidence FROM sentiment_scores
    QUALIFY row_number() OVER (PARTITION BY sentence_id, aspect ORDER BY score DESC,
        list_position(['positive', 'negative', 'neutral'], sentiment)) = 1"""


ASPECT_LISTS = """
    SELECT s.sentence_id, coalesce(string_agg(aspect || ':' || sentiment, ';' ORDER BY d.score DESC, aspect), '')
           AS aspects, count(d.aspect) AS n
    FROM sentences s LEFT JOIN (SELECT * FROM detected JOIN best USING (sentence_id, aspect)) d
         ON s.sentence_id = d.sentence_id GROUP BY 1"""


def make_aspect_scorer():
    """The aspect scores of the catalog's native form as plain Python, standing in for a model."""
    lists = {aspect: [v.split() for v in words] for aspect, words in OPINION_WORDS.items()}

    def factory():
        def counts(text: str, aspect: str) -> list[int]:
            words = text.lower().split()
            return [sum(w in of for w in words) for of in lists[aspect]]

        def detect(texts: list[str]) -> list[list[float]]:
            out = []
            for text in texts:
                n = len(text.split())
                hits = [16 * sum(counts(text, aspect)) for aspect in lists]
                out.append([h / (h + n + 1) for h in hits])
            return out

        def rate(pairs: list[tuple[str, str]]) -> list[list[float]]:
            found = [counts(text, aspect) for text, aspect in pairs]
            return [[(x + 1) / (sum(row) + 3) for x in row] for row in found]

        return detect, rate

    return factory


@query(
    "batch_aspects_m1_m3_p11",
    sql(
        """SELECT c.id AS sentence_id, c.sentiment, c.confidence, l.aspects, l.n
           FROM scored c JOIN lists l ON l.sentence_id = c.id""",
        "sentences",
        "aspect_scores",
        "sentiment_scores",
        extra={**sql_scored("sentences"), "detected": DETECTED, "best": BEST, "lists": ASPECT_LISTS},
    ),
)
def batch_aspects(t: Tables):
    """Batch scoring with the aspect branch, behind the language gate."""
    rows = t.sentences.withColumn("spoken", detect_language(F.col("text"))["lang"])
    out = s.score(rows, make_python_scorer(), batch_size=32, aspect_scorer=make_aspect_scorer(), lang_col="spoken")
    return out.select(
        "sentence_id", "sentiment", "confidence", _pairs().alias("aspects"), F.size("aspects").cast("long").alias("n")
    )


@query(
    "prediction_pairs_j4",
    sql(
        """SELECT p.id, y_true, sentiment, lang FROM predictions p JOIN scored s ON p.id = s.id""",
        "predictions",
        "sentences",
        extra=sql_scored("sentences"),
    ),
)
def prediction_pairs(t: Tables):
    truth = t.predictions.select("id", "y_true", "lang")
    texts = t.sentences.select(F.col("sentence_id").alias("id"), "text").join(truth.select("id"), "id", "left_semi")
    return s.assert_paired(truth, native(t, texts, "id").select("id", "sentiment"), "id")


SQL_EVAL = {
    **sql_scored("test_rows", "id"),
    "pairs": """SELECT r.id, r.y_true, s.sentiment AS y_pred, r.lang, s.confidence
        FROM test_rows r JOIN scored s ON r.id = s.id""",
}
TEST_ROWS = """SELECT p.id, p.y_true, p.lang, x.text FROM predictions p
    JOIN sentences x ON p.id = x.sentence_id WHERE x.split = 'test'"""


@query(
    "evaluate_split_m5",
    sql(
        """SELECT y_true, y_pred, lang, count(*) AS n, round(avg(confidence), 6) AS mean_confidence
           FROM pairs GROUP BY 1, 2, 3""",
        "predictions",
        "sentences",
        extra={"test_rows": TEST_ROWS, **SQL_EVAL},
    ),
)
def evaluate_split(t: Tables):
    text = t.sentences.select(F.col("sentence_id").alias("id"), "text", "split")
    rows = t.predictions.select("id", F.col("y_true").alias("label"), "lang").join(text, "id")
    pairs = tr.evaluate_split(rows, make_python_scorer())
    return pairs.groupBy("y_true", "y_pred", "lang").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("confidence")).alias("mean_confidence")
    )


@query(
    "evaluate_sample_m5_w6",
    sql(
        """SELECT y_true, y_pred, count(*) AS n FROM pairs GROUP BY 1, 2""",
        "predictions",
        "sentences",
        extra={
            "test_rows": TEST_ROWS + f" ORDER BY {sql_hash(chr(39) + '42' + chr(39), 'p.id')}, p.id LIMIT 50",
            **SQL_EVAL,
        },
    ),
)
def evaluate_sample(t: Tables):
    """The same evaluation on a capped random sample of the test rows."""
    text = t.sentences.select(F.col("sentence_id").alias("id"), "text", "split")
    rows = t.predictions.select("id", F.col("y_true").alias("label"), "lang").join(text, "id")
    return m.confusion_counts(tr.evaluate_split(rows, make_python_scorer(), max_samples=50))


@query(
    "fit_classifier_m4",
    sql(
        """SELECT label AS y_true, count(*) AS n, true AS scored
           FROM halves WHERE split = 'test' GROUP BY 1""",
        "predictions",
        extra=TRAINING_HALVES,
    ),
)
def fit_classifier(t: Tables):
    """Weighted classifier on the labelled texts: its held-out rows per class, and whether each got a known label."""
    text = t.sentences.select(F.col("sentence_id").alias("id"), "text", "row_order")
    lang = language_label(F.col("lang")).alias("lang")
    rows = t.predictions.select("id", F.col("y_true").alias("label"), lang).join(text, "id")
    fitted = tr.fit_classifier(rows, "sentiment")
    labels = fitted.task.label_names
    names = F.array(*[F.lit(x) for x in labels])
    out = fitted.predict(fitted.test).select(F.get(names, F.col("label")).alias("y_true"), "y_pred")
    known = F.coalesce(F.col("y_pred").isin(*labels), F.lit(False))
    return out.groupBy("y_true").agg(F.count(F.lit(1)).alias("n"), F.min(known).alias("scored"))


@query("pass_scores_m4", None)
def pass_scores(t: Tables):
    """Warm-started passes over texts whose label is the lexicon's sentiment: validation scores of every pass, the kept one
    marked, and the macro F1 of always naming the largest class. No SQL: ``tests/test_passes.py`` repeats the passes."""
    label = materialize(native(t, t.sentences).select("sentence_id", F.col("sentiment").alias("label")), "labels")
    rows = t.sentences.join(label, "sentence_id").select(F.col("sentence_id").alias("id"), "text", "label", "lang", "row_order")
    chosen = ps.fit_selected(rows, replace(tr.get_task("sentiment"), stratified=False))
    base = m.majority_f1(chosen.validation, "label", len(CLASSES))
    scores = chosen.scores(t.spark).withColumn("majority_f1", F.lit(base.first()["majority_f1"]))
    return scores.withColumn("beats_majority", F.col("f1_macro") > F.col("majority_f1"))


@query(
    "aspect_candidates_j5",
    sql(
        """SELECT sentence_id, aspect, round(d.score, 6) AS score, sentiment, confidence
           FROM detected d JOIN best USING (sentence_id, aspect)""",
        "aspect_scores",
        "sentiment_scores",
        extra={"detected": DETECTED, "best": BEST},
    ),
)
def aspect_candidates(t: Tables):
    """The same scores as tables; only detected aspects are rated."""
    names = F.array(*[F.lit(x) for x in vocab.ASPECTS])
    long = t.opinions.select("sentence_id", "words", F.posexplode("scores").alias("i", "score"))
    found = a.detected_aspects(long).withColumn("aspect", F.get(names, F.col("i")))
    rates = found.select(
        "sentence_id", "aspect", F.posexplode(sentiment_rates(F.col("words"), F.col("aspect"))).alias("k", "score")
    ).withColumn("sentiment", F.get(F.array(*[F.lit(x) for x in vocab.SENTIMENTS]), F.col("k")))
    best = a.best_sentiment(rates, ["sentence_id", "aspect"])
    scores = found.select("sentence_id", "aspect", r6(F.col("score")).alias("score"))
    return scores.join(best, ["sentence_id", "aspect"])


def extracted(t: Tables):
    words = F.col("words")
    listed = a.rated_aspects(F.col("scores"), lambda aspect: sentiment_rates(words, aspect))
    return t.opinions.select("sentence_id", F.explode(F.array(listed)).alias("aspects"))  # computed once


def _pairs(c="aspects", sep=";"):
    return F.array_join(F.transform(c, lambda x: F.concat(x["aspect"], F.lit(":"), x["sentiment"])), sep)


@query(
    "aspect_extraction_m3_t4",
    sql(
        "SELECT * FROM lists",
        "aspect_scores",
        "sentiment_scores",
        extra={"detected": DETECTED, "best": BEST, "lists": ASPECT_LISTS},
    ),
)
def aspect_extraction(t: Tables):
    return extracted(t).select(
        "sentence_id", _pairs().alias("aspects"), F.size("aspects").cast("long").alias("n")
    )


@query(
    "aspect_coverage_a30",
    sql(
        """SELECT count(*) AS n_texts, round(avg((n > 0)::INT), 6) AS coverage, avg((n > 0)::INT) > 0.8 AS on_target
           FROM lists""",
        "aspect_scores",
        "sentiment_scores",
        extra={"detected": DETECTED, "best": BEST, "lists": ASPECT_LISTS},
    ),
)
def aspect_coverage(t: Tables):
    return a.aspect_coverage(extracted(t)).withColumn("coverage", r6(F.col("coverage")))


@query(
    "aspect_distribution_a38",
    sql(
        "SELECT aspect, sentiment, count(*) AS n FROM detected JOIN best USING (sentence_id, aspect) GROUP BY 1, 2",
        "aspect_scores",
        "sentiment_scores",
        extra={"detected": DETECTED, "best": BEST},
    ),
)
def aspect_distribution(t: Tables):
    return a.aspect_sentiments(extracted(t))


# Keywords that occur in the test texts; a real job passes its own domain lists.
KEYWORDS = {
    "food": ("the", "la"),
    "service": ("with", "mit", "avec"),
    "price": ("worthless", "für"),
    "location": ("from", "dans", "auf"),
}


@query(
    "keyword_aspects_m10",
    sql(
        f"""SELECT sentence_id, array_to_string(list_filter([{", ".join(
            f"CASE WHEN list_has_any(w, {list(KEYWORDS[k])}) THEN '{k}' END" for k in sorted(KEYWORDS)
        )}], lambda x: x IS NOT NULL), ',') AS aspects
            FROM (SELECT sentence_id, string_split(trim(regexp_replace(regexp_replace(lower(text),
                  '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '{WS}', ' ', 'g')), ' ') AS w FROM sentences)""",
        "sentences",
    ),
)
def keyword_aspects(t: Tables):
    out = a.keyword_aspects(t.sentences, KEYWORDS)
    return out.select("sentence_id", F.array_join("aspects", ",").alias("aspects"))


# (aspect, allowed sentiments) expected of a text, by id modulo 3.
EXPECTED = {
    0: (("food", ("positive",)), ("service", ("negative", "neutral"))),
    1: (("ambiance/general", ("negative",)),),
    2: (("service/general", ("neutral", "positive")), ("price", ("positive", "neutral"))),
}


def _sql_expected() -> str:
    rows = ", ".join(f"({k}, '{x}', {list(ok)})" for k, v in EXPECTED.items() for x, ok in v)
    return f"""SELECT s.sentence_id AS id, e.aspect, e.allowed FROM sentences s
        JOIN (VALUES {rows}) e(k, aspect, allowed) ON s.row_order % 3 = e.k"""


@query(
    "aspect_expectations_j8",
    sql(
        """SELECT id, bool_and(ok) AS passed, coalesce(string_agg(reason, ' | ' ORDER BY reason), '') AS reasons
           FROM (SELECT id, ok, CASE WHEN NOT ok THEN aspect || ': ' ||
                        CASE WHEN len(got) = 0 THEN 'not found' ELSE 'got ' || array_to_string(got, ',') END END AS reason
                 FROM (SELECT x.id, x.aspect, coalesce(bool_or(list_contains(x.allowed, p.sentiment)), false) AS ok,
                              list_sort(coalesce(list(DISTINCT p.sentiment) FILTER (p.sentiment IS NOT NULL), [])) AS got
                       FROM (SELECT id, aspect, allowed, unnest(string_split(aspect, '/')) AS part FROM expected) x
                       LEFT JOIN (SELECT * FROM detected JOIN best USING (sentence_id, aspect)) p
                         ON p.sentence_id = x.id AND p.aspect = x.part GROUP BY 1, 2))
           GROUP BY 1""",
        "aspect_scores",
        "sentiment_scores",
        extra={"detected": DETECTED, "best": BEST, "expected": _sql_expected()},
    ),
)
def aspect_expectations(t: Tables):
    kind = "array<struct<aspect:string,allowed:array<string>>>"
    per = None
    for k, items in EXPECTED.items():
        value = F.array(
            *[F.struct(F.lit(x).alias("aspect"), F.array(*[F.lit(o) for o in ok]).alias("allowed")) for x, ok in items]
        ).cast(kind)
        per = (F.when if per is None else per.when)(F.col("row_order") % 3 == k, value)
    expected = t.sentences.select(F.col("sentence_id").alias("id"), F.inline(per))
    found = extracted(t).select(F.col("sentence_id").alias("id"), F.inline("aspects"))
    return a.check_expectations(expected, found.drop("confidence"))


ATTRIBUTED = """
    SELECT t.id, t.pos, t.token, s.sentiment,
           coalesce(CASE s.sentiment WHEN 'negative' THEN negative WHEN 'neutral' THEN neutral ELSE positive END, 0) AS value
    FROM toks t JOIN scored s ON t.id = s.id LEFT JOIN lex USING (token)"""


@query(
    "token_attribution_m6",
    sql(
        """SELECT id AS sentence_id, sentiment, count(*) AS n_tokens, sum(value) AS total,
                  sum(value * (pos % 97)) AS weighted FROM att GROUP BY 1, 2""",
        "sentences",
        extra={**sql_scored("sentences"), "att": ATTRIBUTED},
    ),
)
def token_attribution(t: Tables):
    """Per text: token count, sum of values and a position-weighted sum (all exact)."""
    out = at.attribute_linear(t.sentences, lexicon(t), CLASSES, INTERCEPT)
    return out.groupBy("sentence_id", "sentiment").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum("value").alias("total"),
        F.sum(F.col("value") * (F.col("pos") % 97)).alias("weighted"),
    )


def make_logit_scorer():
    """The logits of the linear scorer as plain Python, standing in for a model whose inside is not known.

    ``encode`` looks every word's weights up, ``of_encoded`` rates the looked-up words of several texts at once.
    """
    lexicon_, intercept = dict(LEXICON), list(INTERCEPT)

    def factory():
        import numpy as np

        none = [0.0] * len(intercept)

        def encode(words: list[str]):
            # a token may hold white space that only Python's split knows
            found = [[lexicon_[w] for w in word.lower().split() if w in lexicon_] for word in words]
            rows = [[sum(column) for column in zip(*x)] if x else none for x in found]
            return np.array(rows, dtype=float).reshape(-1, len(intercept))

        def of_encoded(codes: list):
            sizes = np.array([len(x) for x in codes])
            out = np.tile(np.array(intercept), (len(codes), 1))
            filled = np.flatnonzero(sizes)
            if len(filled):
                starts = np.cumsum(sizes) - sizes
                out[filled] += np.add.reduceat(np.concatenate(codes), starts[filled], axis=0)
            return out

        def run(texts: list[str]) -> list[list[float]]:
            return of_encoded([encode(text.split()) for text in texts]).tolist()

        run.encode, run.of_encoded = encode, of_encoded
        return run

    return factory


TURNS = "SELECT conv_id || '-' || turn AS turn_id, text FROM conversations"


@query(
    "tree_attribution_m6",
    sql(
        """SELECT id AS turn_id, sentiment, pos::INTEGER AS pos, length(token)::INTEGER AS n_chars, round(base, 6) AS base_value,
                  round(value, 6) AS value
           FROM (SELECT t.id, t.pos, t.token, s.sentiment,
                        CASE s.sentiment WHEN 'negative' THEN coalesce(x.negative, 0) WHEN 'neutral' THEN coalesce(x.neutral, 0)
                             ELSE coalesce(x.positive, 0) END AS value,
                        CASE s.sentiment """ + " ".join(f"WHEN '{c}' THEN {b}::DOUBLE" for c, b in zip(CLASSES, INTERCEPT)) + """ END AS base
                 FROM toks t JOIN scored s USING (id) LEFT JOIN lex x USING (token))""",
        extra={"turns": TURNS, **sql_scored("turns", "turn_id")},
    ),
)
def tree_attribution(t: Tables):
    """Every token of every chat turn: a scorer that happens to be linear must get its weights back."""
    turns = t.chat.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text")
    out = at.attribute_tree(turns, make_logit_scorer(), id_col="turn_id")
    return out.select(
        "turn_id", "sentiment", F.col("pos").cast("int").alias("pos"), F.length("token").alias("n_chars"),
        r6("base_value").alias("base_value"), r6(F.col("value") + 0.0).alias("value"),
    )


RANKED = f"""
    SELECT sentence_id, list_transform(w, lambda x, i: (i * 37 % 101 - 50) / 64.0::DOUBLE) AS v, w
    FROM (SELECT sentence_id, list_filter(string_split({BODY}, ' '), lambda x: x <> '') AS w FROM sentences)"""


@query(
    "attribution_ranking_w8",
    sql(
        """SELECT sentence_id, count(*) AS n_tokens, sum(rank * length(token))::BIGINT AS token_check,
                  sum(rank * value) AS value_check, round(sum(width), 4) AS width_sum
           FROM (SELECT sentence_id, token, value,
                        row_number() OVER (PARTITION BY sentence_id ORDER BY abs(value) DESC, pos) AS rank,
                        abs(value) / greatest(max(abs(value)) OVER (PARTITION BY sentence_id), 1e-9::DOUBLE) * 45 AS width
                 FROM (SELECT sentence_id, unnest(w) AS token, unnest(v) AS value,
                              generate_subscripts(w, 1) AS pos FROM items))
           GROUP BY 1""",
        "sentences",
        extra={"items": RANKED},
    ),
)
def attribution_ranking(t: Tables):
    """All tokens ranked; per text the ranking is summed up in order-sensitive checks."""
    rows = t.sentences.select("sentence_id", tokens(F.col("text")).alias("w"))
    values = F.transform("w", lambda x, i: ((i + 1) * 37 % 101 - 50) / F.lit(64.0))
    rows = rows.withColumn("v", values)
    ranked = rows.select("sentence_id", F.inline(at.ranked_tokens(F.col("w"), F.col("v"))))
    return ranked.groupBy("sentence_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(F.col("rank") * F.length("token")).cast("long").alias("token_check"),
        F.sum(F.col("rank") * F.col("value")).alias("value_check"),
        F.round(F.sum("width"), 4).alias("width_sum"),
    )


UPLOADS = {
    "uploads": SQL_UPLOAD,
    **sql_scored("uploads", "row_order"),
    "results": """SELECT row_order AS row, text,
            CASE WHEN text = '' THEN 'neutral' ELSE s.sentiment END AS sentiment,
            CASE WHEN text = '' THEN 0.0 ELSE s.confidence END::DOUBLE AS confidence,
            CASE WHEN text = '' THEN 'Empty text — skipped' END AS error
        FROM uploads u JOIN scored s ON u.row_order = s.id""",
}


def results(t: Tables):
    raw = t.sentences.select(F.col("row_order").alias("row"), upload_text().alias("text"))
    cleaned, error = s.clean_upload(F.col("text"))
    valid = raw.select("row", cleaned.alias("text"), error.alias("error")).filter("error IS NULL")
    return s.batch_results(raw, native(t, valid, "row"))


@query(
    "batch_results_p21_j4",
    sql("SELECT row, md5(text) AS text_md5, sentiment, confidence, error FROM results", "sentences", extra=UPLOADS),
)
def batch_results(t: Tables):
    return results(t).select("row", F.md5("text").alias("text_md5"), "sentiment", "confidence", "error")


@query(
    "batch_totals_a32",
    sql(
        """SELECT count(*) AS total_items, count(*) - count(error) AS processed_items, count(error) AS failed_items
           FROM results""",
        "sentences",
        extra=UPLOADS,
    ),
)
def batch_totals(t: Tables):
    return s.batch_totals(results(t))


@query(
    "sentiment_summary_a33",
    sql(
        """SELECT label, (SELECT count(*) FROM results WHERE sentiment = label) AS n,
                  round((SELECT count(*) FROM results WHERE sentiment = label) * 100.0::DOUBLE
                        / greatest((SELECT count(*) FROM results), 1), 6) AS pct
           FROM (SELECT unnest(['positive', 'neutral', 'negative']) AS label)""",
        "sentences",
        extra=UPLOADS,
    ),
)
def sentiment_summary(t: Tables):
    return s.sentiment_summary(results(t)).select("label", "n", r6(F.col("pct")).alias("pct"))


@query(
    "result_export_k4",
    sql(
        """SELECT row, md5('"' || replace(text, '"', '""') || '"') AS text_md5, sentiment,
                  printf('%.2f%%', confidence * 100) AS confidence, '""' AS aspects, coalesce(error, '') AS error
           FROM results""",
        "sentences",
        extra=UPLOADS,
    ),
)
def result_export(t: Tables):
    out = sk.export_results(results(t))
    return out.select("row", F.md5("text").alias("text_md5"), "sentiment", "confidence", "aspects", "error")


@query(
    "aspect_export_k4_k5",
    sql(
        """SELECT s.sentence_id, '"' || coalesce(string_agg(aspect || ':' || sentiment, '; ' ORDER BY d.score DESC, aspect), '')
                  || '"' AS aspects,
                  coalesce(string_agg(aspect || '|' || sentiment || '|' || printf('%.4f', confidence), ';'
                           ORDER BY d.score DESC, aspect), '') AS json_items
           FROM sentences s LEFT JOIN (SELECT * FROM detected JOIN best USING (sentence_id, aspect)) d
                ON s.sentence_id = d.sentence_id GROUP BY 1""",
        "aspect_scores",
        "sentiment_scores",
        extra={"detected": DETECTED, "best": BEST},
    ),
)
def aspect_export(t: Tables):
    """Both export forms of the aspect column."""
    rows = extracted(t).select(
        F.col("sentence_id").alias("row"),
        F.lit("").alias("text"),
        F.lit("neutral").alias("sentiment"),
        F.lit(0.5).alias("confidence"),
        "aspects",
        F.lit(None).cast("string").alias("error"),
    )
    shown = sk.export_results(rows).select(F.col("row").alias("sentence_id"), "aspects")
    items = F.from_json("aspects_json", a.ASPECT_LIST)
    texts = F.transform(items, lambda x: F.concat_ws(
        "|", x["aspect"], x["sentiment"], F.format_string("%.4f", x["confidence"])))
    json = sk.export_with_json(rows).select(F.col("row").alias("sentence_id"), F.array_join(texts, ";").alias("json_items"))
    return shown.join(json, "sentence_id")
