"""The driver tables seen through the library's schemas, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.functions.text import tokens
from labelflow.operators.frames import Frames
from labelflow.session import spread


def r6(c):
    return F.round(c, 6)


# Words of the test texts that a demonstration scorer takes for (aspect, sentiment) evidence.
OPINION_WORDS = {
    "food": ("the der good", "of bad", "and terrible"),
    "service": ("de love", "to hate", "la"),
    "ambiance": ("die great", "is", "that"),
    "price": ("en", "for worthless", "it"),
    "location": ("on", "was with", "le"),
    "general": ("be que", "as", "und des by"),
}


def _among(words, listed: str):
    return F.size(F.filter(words, lambda w: w.isin(listed.split())))


def _found(words, listed):
    return F.size(F.filter(words, lambda w: F.array_contains(listed, w)))


def aspect_scores(words, n):
    """Score per aspect: its words' density among all ``n`` words."""
    hits = F.array(*[_among(words, " ".join(lists)) * 16 for lists in OPINION_WORDS.values()])
    return F.transform(hits, lambda h: h / (h + n + 1))


def sentiment_rates(words, aspect):
    """Score per sentiment of vocab.SENTIMENTS for one aspect of a text."""
    lists = [F.array(*[F.array(*[F.lit(w) for w in v[k].split()]) for v in OPINION_WORDS.values()]) for k in range(3)]
    place = F.array_position(F.array(*[F.lit(x) for x in OPINION_WORDS]), aspect).cast("int") - 1
    counts = F.array(*[_found(words, F.get(of, place)) for of in lists])
    total = F.aggregate(counts, F.lit(3), lambda t, n: t + n)
    return F.transform(counts, lambda n: (n + 1) / total)


class Tables:
    """Lazily built views over one scale factor's folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @property
    def sentences(self) -> DataFrame:
        d = F.col("doc_id")
        return spread(self.table("documents")).select(
            d.cast("string").alias("sentence_id"),
            "text",
            F.when(d % 5 == 0, "test").otherwise("train").alias("split"),
            d.alias("row_order"),
            "lang",
            "source",
            "n_chars",
        )

    @property
    def aspects(self) -> DataFrame:
        d = F.col("doc_id")
        first = F.struct(
            (d * 2).alias("row_order"),
            F.when(d % 3 == 0, "food")
            .when(d % 3 == 1, "service")
            .otherwise("anecdotes/miscellaneous")
            .alias("aspect_category"),
            F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("sentiment"),
        )
        second = F.struct(
            (d * 2 + 1).alias("row_order"),
            F.lit("ambience").alias("aspect_category"),
            F.when(d % 17 == 0, "conflict")
            .when(F.col("toxic") == 1, "negative")
            .otherwise("neutral")
            .alias("sentiment"),
        )
        return self.table("labels").select(
            d.cast("string").alias("sentence_id"), F.inline(F.array(first, second))
        )

    @property
    def raw(self) -> Frames:
        return Frames(self.sentences, self.aspects)

    @property
    def dirty(self) -> Frames:
        """Processed-looking frames with missing values, wrong labels and orphans put in."""
        d = F.col("row_order")
        s = self.sentences.select(
            F.when(d % 89 != 0, F.col("sentence_id")).alias("sentence_id"),
            F.when(d % 97 != 0, F.col("text")).alias("text"),
            F.when(d % 41 == 0, None)
            .when(d % 53 == 0, F.concat(F.lit("bad_"), (d % 7).cast("string")))
            .when(d % 3 == 0, "negative")
            .otherwise("positive")
            .alias("sentiment"),
            F.when(d % 29 != 0, F.col("split")).alias("split"),
            "row_order",
        )
        a = self.aspects.select(
            F.when(d % 62 == 0, F.concat(F.lit("x"), F.col("sentence_id")))
            .when(d % 83 != 0, F.col("sentence_id"))
            .alias("sentence_id"),
            "aspect_category",
            "sentiment",
            "row_order",
        )
        return Frames(s, a)

    @property
    def predictions(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "n_chars", "lang", "source")
        truth = (
            F.when(F.col("quality") == 0, "negative")
            .when(F.col("toxic") == 1, "neutral")
            .otherwise("positive")
        )
        shifted = (
            F.when(F.col("y_true") == "positive", "negative")
            .when(F.col("y_true") == "negative", "neutral")
            .otherwise("positive")
        )
        return (
            self.table("labels")
            .join(docs, "doc_id")
            .withColumn("y_true", truth)
            .select(
                F.col("doc_id").cast("string").alias("id"),
                "y_true",
                F.when(F.col("n_chars") % 7 < 4, F.col("y_true")).otherwise(shifted).alias("y_pred"),
                (F.lit(0.5) + (F.col("n_chars") % 50) / F.lit(100.0)).alias("confidence"),
                "lang",
                "source",
            )
        )

    @property
    def requests(self) -> DataFrame:
        u, kind = F.col("user_id"), F.col("event_type")
        return self.table("events").select(
            "ts",
            F.lit("POST").alias("method"),
            F.when(u % 3 == 0, "/predict")
            .when(u % 3 == 1, "/explain")
            .otherwise("/batch_predict")
            .alias("endpoint"),
            F.when(kind == "error", 500).when(kind == "signup", 400).otherwise(200).alias("http_status"),
            (F.col("value") / 100.0).alias("latency_s"),
            F.when(u % 4 == 1, "vi").when(u % 4 == 2, "fr").otherwise("en").alias("lang"),
        )

    @property
    def chat(self) -> DataFrame:
        return self.table("conversations")

    @property
    def opinions(self) -> DataFrame:
        """(sentence_id, words, scores): the text's opinion words and a stand-in score per aspect."""
        listed = sorted({w for lists in OPINION_WORDS.values() for v in lists for w in v.split()})
        # one-element generators, so that words and scores are computed once
        rows = self.sentences.select("sentence_id", F.explode(F.array(tokens(F.lower("text")))).alias("all"))
        words = F.filter("all", lambda w: w.isin(listed))
        rows = rows.select("sentence_id", F.size("all").alias("n"), F.explode(F.array(words)).alias("words"))
        scores = aspect_scores(F.col("words"), F.col("n"))
        return rows.select("sentence_id", "words", F.explode(F.array(scores)).alias("scores"))

    @property
    def annotations(self) -> DataFrame:
        d, q = F.col("doc_id"), F.col("quality")
        return self.table("labels").select(
            d.cast("string").alias("id"),
            F.inline(
                F.array(
                    F.struct(F.lit("ann_a").alias("labeler_id"), q.cast("string").alias("label")),
                    F.struct(
                        F.lit("ann_b").alias("labeler_id"),
                        F.when(d % 7 == 0, 1 - q).otherwise(q).cast("string").alias("label"),
                    ),
                )
            ),
        )

    @property
    def coded_en(self) -> DataFrame:
        """English-coded rows: code 3 is unknown."""
        d = F.col("row_order")
        return self.sentences.filter("lang = 'en'").select(
            "sentence_id", "text", (d % 4).cast("int").alias("label"), "split"
        )

    @property
    def coded_vi(self) -> DataFrame:
        d = F.col("row_order")
        return self.sentences.filter("lang <> 'en'").select(
            "sentence_id",
            F.col("text").alias("sentence"),
            (d % 3).cast("int").alias("sentiment"),
            "split",
        )


# The same views in SQL. White space is spelled out because the engines' \s differ.
WS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def sql_collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}', ' ', 'g'))"


def sql_clean(expr: str = "text") -> str:
    return sql_collapse(f"lower(coalesce({expr}, ''))")


def sql_hash(*parts: str) -> str:
    return "md5(concat(" + ", '|', ".join(parts) + "))"


def sql_hash_int(*parts: str) -> str:
    return f"('0x' || substr({sql_hash(*parts)}, 1, 8))::BIGINT"


SQL_VIEWS = {
    "sentences": """
        SELECT CAST(doc_id AS VARCHAR) AS sentence_id, text,
               CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
               doc_id AS row_order, lang, source, n_chars
        FROM documents""",
    "aspects": """
        SELECT CAST(doc_id AS VARCHAR) AS sentence_id, doc_id * 2 AS row_order,
               CASE doc_id % 3 WHEN 0 THEN 'food' WHEN 1 THEN 'service'
                    ELSE 'anecdotes/miscellaneous' END AS aspect_category,
               CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS sentiment
        FROM labels
        UNION ALL
        SELECT CAST(doc_id AS VARCHAR), doc_id * 2 + 1, 'ambience',
               CASE WHEN doc_id % 17 = 0 THEN 'conflict' WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END
        FROM labels""",
    "dirty_sentences": """
        SELECT CASE WHEN row_order % 89 <> 0 THEN sentence_id END AS sentence_id,
               CASE WHEN row_order % 97 <> 0 THEN text END AS text,
               CASE WHEN row_order % 41 = 0 THEN NULL
                    WHEN row_order % 53 = 0 THEN 'bad_' || (row_order % 7)
                    WHEN row_order % 3 = 0 THEN 'negative' ELSE 'positive' END AS sentiment,
               CASE WHEN row_order % 29 <> 0 THEN split END AS split, row_order
        FROM sentences""",
    "dirty_aspects": """
        SELECT CASE WHEN row_order % 62 = 0 THEN 'x' || sentence_id
                    WHEN row_order % 83 <> 0 THEN sentence_id END AS sentence_id,
               aspect_category, sentiment, row_order
        FROM aspects""",
    "predictions": """
        SELECT id, y_true,
               CASE WHEN n_chars % 7 < 4 THEN y_true WHEN y_true = 'positive' THEN 'negative'
                    WHEN y_true = 'negative' THEN 'neutral' ELSE 'positive' END AS y_pred,
               0.5::DOUBLE + (n_chars % 50) / 100.0::DOUBLE AS confidence, lang, source
        FROM (SELECT CAST(l.doc_id AS VARCHAR) AS id, d.n_chars, d.lang, d.source,
                     CASE WHEN quality = 0 THEN 'negative' WHEN toxic = 1 THEN 'neutral'
                          ELSE 'positive' END AS y_true
              FROM labels l JOIN documents d USING (doc_id))""",
    "requests": """
        SELECT ts, 'POST' AS method,
               CASE user_id % 3 WHEN 0 THEN '/predict' WHEN 1 THEN '/explain'
                    ELSE '/batch_predict' END AS endpoint,
               CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 400 ELSE 200 END AS http_status,
               value / 100.0::DOUBLE AS latency_s,
               CASE user_id % 4 WHEN 1 THEN 'vi' WHEN 2 THEN 'fr' ELSE 'en' END AS lang
        FROM events""",
    "aspect_names": "SELECT unnest(['food','service','ambiance','price','location','general']) AS aspect",
    "sentiment_names": "SELECT unnest(['positive','negative','neutral']) AS sentiment",
    "opinion_words": "SELECT * FROM (VALUES " + ", ".join(
        f"('{w}', '{aspect}', '{sentiment}')"
        for aspect, lists in OPINION_WORDS.items()
        for sentiment, words in zip(("positive", "negative", "neutral"), lists)
        for w in words.split()
    ) + ") x(token, aspect, sentiment)",
    "opinion_counts": f"""
        SELECT s.sentence_id, s.n_words, a.aspect, x.sentiment, count(h.token) AS n
        FROM (SELECT sentence_id, list_filter(string_split({sql_clean()}, ' '), lambda x: x <> '') AS w, len(w) AS n_words
              FROM sentences) s
        CROSS JOIN aspect_names a CROSS JOIN sentiment_names x
        LEFT JOIN (SELECT t.sentence_id, o.* FROM (
                SELECT sentence_id, unnest(list_filter(string_split({sql_clean()}, ' '), lambda x: x <> '')) AS token
                FROM sentences) t JOIN opinion_words o USING (token)) h
            ON h.sentence_id = s.sentence_id AND h.aspect = a.aspect AND h.sentiment = x.sentiment
        GROUP BY 1, 2, 3, 4""",
    "aspect_scores": """
        SELECT sentence_id, aspect, sum(n) * 16 / (sum(n) * 16 + any_value(n_words) + 1)::DOUBLE AS score
        FROM opinion_counts GROUP BY 1, 2""",
    "sentiment_scores": """
        SELECT sentence_id, aspect, sentiment,
               (n + 1) / (sum(n) OVER (PARTITION BY sentence_id, aspect) + 3)::DOUBLE AS score
        FROM opinion_counts""",
    "annotations": """
        SELECT CAST(doc_id AS VARCHAR) AS id, 'ann_a' AS labeler_id, CAST(quality AS VARCHAR) AS label
        FROM labels
        UNION ALL
        SELECT CAST(doc_id AS VARCHAR), 'ann_b',
               CAST(CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS VARCHAR)
        FROM labels""",
    "coded_en": """
        SELECT sentence_id, text, CAST(row_order % 4 AS INTEGER) AS label, split
        FROM sentences WHERE lang = 'en'""",
    "coded_vi": """
        SELECT sentence_id, text AS sentence, CAST(row_order % 3 AS INTEGER) AS sentiment, split
        FROM sentences WHERE lang <> 'en'""",
    # The dataset build, step by step.
    "mapped_aspects": """
        SELECT sentence_id, row_order, sentiment,
               CASE aspect_category WHEN 'anecdotes/miscellaneous' THEN 'general'
                    WHEN 'ambience' THEN 'ambiance' ELSE aspect_category END AS aspect_category
        FROM aspects WHERE sentiment IS DISTINCT FROM 'conflict'""",
    "derived": """
        SELECT sentence_id,
               CASE WHEN count(DISTINCT sentiment) = 1 THEN min(sentiment)
                    WHEN bool_or(sentiment = 'negative') THEN 'negative' ELSE 'positive' END AS sentiment
        FROM mapped_aspects WHERE sentiment IS NOT NULL GROUP BY 1""",
    "cleaned": f"""
        SELECT * FROM (SELECT sentence_id, {sql_clean()} AS text, split, row_order, lang, source
                       FROM sentences) WHERE length(text) > 0""",
    "firsts": """
        SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_order) = 1""",
    "survivors": """
        SELECT f.*, coalesce(d.sentiment, 'neutral') AS sentiment
        FROM firsts f LEFT JOIN derived d USING (sentence_id) WHERE length(f.text) BETWEEN 3 AND 2000""",
}

NEEDS = {
    "dirty_sentences": ("sentences",),
    "dirty_aspects": ("aspects",),
    "opinion_counts": ("sentences", "aspect_names", "sentiment_names", "opinion_words"),
    "aspect_scores": ("opinion_counts",),
    "sentiment_scores": ("opinion_counts",),
    "coded_en": ("sentences",),
    "coded_vi": ("sentences",),
    "mapped_aspects": ("aspects",),
    "derived": ("mapped_aspects",),
    "cleaned": ("sentences",),
    "firsts": ("cleaned",),
    "survivors": ("firsts", "derived"),
    "built": ("survivors",),
    "built_aspects": ("built", "mapped_aspects"),
}


def sql_split(source: str, stratum: str, ratio: float, id_col: str, to: str, among: str, seed: int = 42) -> str:
    """All rows of ``source`` with the ``split`` a stratified split gives them."""
    return f"""
        SELECT s.* REPLACE (CASE WHEN {among} AND r.held THEN '{to}' ELSE s.split END AS split)
        FROM {source} s LEFT JOIN (
            SELECT x.{id_col} AS held_id, row_number() OVER (
                       PARTITION BY x.stratum ORDER BY {sql_hash(f"'{seed}'", 'x.' + id_col)}, x.{id_col}
                   ) <= q.c - q.kept AS held
            FROM (SELECT {id_col}, {stratum} AS stratum FROM {source} WHERE {among}) x
            JOIN (
                SELECT stratum, c, fl + CASE WHEN row_number() OVER (ORDER BY share - fl DESC, stratum)
                           <= keep - sum(fl) OVER () THEN 1 ELSE 0 END AS kept
                FROM (SELECT *, floor(share) AS fl FROM (
                    SELECT stratum, c, keep, c::DOUBLE / n * keep AS share
                    FROM (SELECT stratum, c, n, n - ceil({ratio}::DOUBLE * n) AS keep
                          FROM (SELECT stratum, count(*) AS c, sum(count(*)) OVER () AS n
                                FROM (SELECT {stratum} AS stratum FROM {source} WHERE {among})
                                GROUP BY 1))))
            ) q ON x.stratum IS NOT DISTINCT FROM q.stratum
        ) r ON s.{id_col} = r.held_id"""


SQL_VIEWS["built"] = sql_split("survivors", "sentiment", 0.1, "sentence_id", "val", "split = 'train'")
SQL_VIEWS["built_aspects"] = """
    SELECT * FROM mapped_aspects WHERE sentence_id IN (SELECT sentence_id FROM built)"""


def sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named views (and what they need) as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for v in views:
        add(v)
    parts = [f"{v} AS ({SQL_VIEWS[v]})" for v in ordered]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
