"""Token attribution: exact weights of linear scorers; for any other scorer Owen values of a coalition tree over
token spans (Shapley values that respect the spans), or leave-one-out."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.functions import text as T
from labelflow.functions import vocab
from labelflow.operators.scoring import ScorerFactory, from_logits
from labelflow.session import materialize


def attribute_linear(
    df: DataFrame,
    weights: DataFrame,
    classes: Sequence[str],
    intercept: Sequence[float],
    text_col: str = "text",
    id_col: str = "sentence_id",
) -> DataFrame:
    """(id, sentiment, base_value, pos, token, value): each token's weight for the predicted class.

    Rows have a key of their own, so missing and repeated ids stay apart. Per row only the tokens of the lexicon are
    gathered, to rate it; the tokens are then cut out of the rated rows once more, so they are not shuffled but where
    the lexicon is too large to be sent to them. Texts without tokens have no rows.
    """
    keyed = df.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col), F.lower(text_col).alias("__text"))
    keyed = materialize(keyed, "keyed")  # written, so that a task that runs again finds the same keys
    lexicon = materialize(weights.select("token", *classes), "lexicon")  # read back, its size is known
    words = keyed.select("__row", F.posexplode(T.tokens(F.col("__text"))).alias("pos", "token"))
    weight = [F.coalesce(c, F.lit(0.0)).alias(c) for c in classes]
    hits = words.join(lexicon, "token").select("__row", F.struct("pos", *weight).alias("hit"))
    sums = [_total(c, b) for c, b in zip(classes, intercept)]
    rated = hits.groupBy("__row").agg(F.array_sort(F.collect_list("hit")).alias("hits")).select("__row", F.array(*sums).alias("logits"))
    empty = F.array(*[F.lit(float(b)) for b in intercept])
    rows = keyed.join(materialize(rated, "rated"), "__row", "left").withColumn("logits", F.coalesce("logits", empty))
    rows = from_logits(rows, classes).select(id_col, "sentiment", F.posexplode(T.tokens(F.col("__text"))).alias("pos", "token"))
    return rows.join(lexicon, "token", "left").select(
        id_col,
        "sentiment",
        _by_class(classes, [F.lit(float(b)) for b in intercept]).alias("base_value"),
        "pos",
        "token",
        _by_class(classes, weight).alias("value"),
    )


def _total(name: str, start: float) -> Column:
    return F.aggregate("hits", F.lit(float(start)), lambda total, hit: total + hit[name])


def _by_class(classes: Sequence[str], values: Sequence[Column]) -> Column:
    out = None
    for c, v in zip(classes, values):
        out = (F.when if out is None else out.when)(F.col("sentiment") == c, v)
    return out


def attribute_leave_one_out(
    df: DataFrame,
    scorer: ScorerFactory,
    text_col: str = "text",
    id_col: str = "sentence_id",
    batch_size: int = 32,
    classes: Sequence[str] = vocab.MODEL_SENTIMENTS,
) -> DataFrame:
    """(id, tokens, values, base_value): drop in the predicted class's probability without each token.

    ``base_value`` is the score of the empty text. Variants are generated and scored in batches inside the
    task, one text at a time, so memory stays at one batch.
    """
    if batch_size <= 0:
        raise ValueError(f"a batch needs at least one row, not {batch_size}")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = scorer()
        empty = list(fn([""])[0])
        for batch in batches:
            rows = []
            for ident, words in zip(batch["id"], batch["tokens"]):
                words = list(words)
                full = list(fn([" ".join(words)])[0])
                best = max(range(len(full)), key=lambda i: (full[i], -i))
                values: list[float] = []
                for start in range(0, len(words), batch_size):
                    stop = min(start + batch_size, len(words))
                    variants = [" ".join(words[:i] + words[i + 1 :]) for i in range(start, stop)]
                    values.extend(float(full[best] - p[best]) for p in fn(variants))
                rows.append((ident, words, values, float(empty[best]), classes[best]))
            yield pd.DataFrame(rows, columns=["id", "tokens", "values", "base_value", "sentiment"])

    source = df.select(
        F.col(id_col).cast("string").alias("id"), T.tokens(F.col(text_col)).alias("tokens")
    )
    schema = "id string, tokens array<string>, values array<double>, base_value double, sentiment string"
    return source.mapInPandas(run, schema).withColumnRenamed("id", id_col)


# Words a row of scoring work may put through the scorer; a long text becomes many such rows.
WORK = 1 << 23
# Outside contexts of a span that are always rated; up to 16 tokens this means all of them.
CONTEXTS = 8
# Tasks beyond this number get longer instead.
MOST_TASKS = 20_000
# Rows of work that make a task.
TASK_ROWS = 4
# Scored variants a task keeps for the spans below, in words.
KEPT_WORDS = 1 << 21
# Token values a task gathers before it sends them on.
KEPT_SUMS = 1 << 16


def split_of(n: int, at: int) -> tuple[int, int, list[tuple[int, int]]]:
    """The span (low, high) of the tree over n tokens that is cut at ``at``, and the siblings on the way down to it.

    A span is cut in its middle, so each of the places 1 .. n-1 cuts exactly one span.
    """
    low, high, siblings = 0, n, []
    while (middle := (low + high) // 2) != at:
        if at < middle:
            siblings.append((middle, high))
            high = middle
        else:
            siblings.append((low, middle))
            low = middle
    return low, high, siblings


def places(low: int, high: int) -> int:
    """The places of a span as bits."""
    return (1 << high) - (1 << low)


@lru_cache(maxsize=4096)
def outside_contexts(n: int, depth: int, limit: int, seed: int = 42) -> Sequence[int]:
    """Which siblings are present, as bits from the top: all combinations, or ``limit`` drawn ones with their opposites.

    Draws belong to the text's length and are cut to the depth, so the contexts of a span go on from those of the
    span above, and half of its variants have been scored there.
    """
    if 1 << depth <= limit:
        return range(1 << depth)
    draw, full = random.Random(f"{seed}|{n}"), (1 << depth) - 1
    half = [draw.getrandbits(64) & full for _ in range(limit // 2)]
    return (*half, *[full ^ c for c in half])


def attribute_tree(
    df: DataFrame,
    scorer: ScorerFactory,
    text_col: str = "text",
    id_col: str = "sentence_id",
    batch_size: int = 32,
    classes: Sequence[str] = vocab.MODEL_SENTIMENTS,
    contexts: int = CONTEXTS,
    work: int = WORK,
) -> DataFrame:
    """(id, sentiment, base_value, pos, token, value): Owen values of the tokens for the predicted class.

    Spans are halved down to single tokens. The halves of a span share what it adds to the score: each gets the
    mean of what it adds with and without the other half, in contexts where every span beside the way down from
    the whole text is either there or not. With up to ``contexts`` such contexts all are rated and the values are
    the exact Owen values; a deeper span gets max(contexts, log2 n) drawn ones, so a text of n tokens costs
    O(n log n) scorer calls. What drawn contexts leave between a span's share and that of its halves is dealt out
    over its tokens, so the values always sum to the score of the text minus that of the empty text
    (``base_value``). A linear scorer gets its weights back exactly.

    Variants are pieces of the text between spaces. A scorer may have two functions of its own: ``encode``, a list of words
    to an array with one entry per word, and ``of_encoded``, which rates a list of such arrays as the scorer rates the
    texts of their words. Then each text is encoded once, and not cut into words again for every variant.

    The spans of a text are dealt out as rows of about ``work`` words of scoring, so a long text is rated by many
    tasks in one pass; what they find meets in one sum per token. Texts without tokens have no rows; missing and
    repeated ids stay apart.
    """
    if batch_size <= 0 or contexts < 2 or contexts % 2:
        raise ValueError(f"a batch needs a row and contexts come in pairs, not {batch_size} and {contexts}")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = scorer()
        encode = getattr(fn, "encode", None)

        def rated(texts: list, best: int | None = None) -> list:
            rate = fn.of_encoded if encode else fn
            rows = [row for i in range(0, len(texts), batch_size) for row in rate(texts[i : i + batch_size])]
            if len(rows) != len(texts):
                raise ValueError("scorer returned a different number of rows")
            return rows if best is None else [float(row[best]) for row in rows]

        def shares(words: list[str], first: int, stop: int) -> tuple[int, np.ndarray, int, float]:
            n, whole = len(words), " ".join(words)
            starts = [0, *accumulate(len(w) + 1 for w in words)]

            codes = encode(words) if encode else None

            def variant(spans: list[tuple[int, int]]):
                if encode:
                    return np.concatenate([codes[a:b] for a, b in spans]) if spans else codes[:0]
                return " ".join([whole[starts[a] : starts[b] - 1] for a, b in spans])

            empty, full = rated([variant([]), variant([(0, n)])])
            best = max(range(len(full)), key=lambda i: (full[i], -i))
            limit = max(contexts, (n - 1).bit_length() // 2 * 2)
            known, held = {}, 0
            out = [(0, 1, float(full[best]) - float(empty[best]))] if n == 1 else []
            for at in range(first, stop):
                low, high, beside = split_of(n, at)
                siblings = sorted((a, b, 1 << i, places(a, b)) for i, (a, b) in enumerate(beside))
                parts = [(0, []), *[(places(a, b), [(a, b)]) for a, b in ((low, at), (at, high), (low, high))]]
                if held > KEPT_WORDS:
                    known, held = {}, 0
                order, fresh = [], {}  # a variant goes by the places of its tokens, as bits
                for context in outside_contexts(n, len(beside), limit):
                    there = [x for x in siblings if context & x[2]]
                    around = sum([x[3] for x in there])
                    for bits, part in parts:
                        bits |= around
                        order.append(bits)
                        if bits not in known and bits not in fresh:
                            fresh[bits] = sorted([x[:2] for x in there] + part)
                known.update(zip(fresh, rated([variant(spans) for spans in fresh.values()], best)))
                held += len(fresh) * n
                found = [known[bits] for bits in order]
                times = len(found) // 4
                without, a, b, both = (sum(found[k::4]) / times for k in range(4))
                share_a, share_b = (a - without + both - b) / 2, (b - without + both - a) / 2
                # a span below the whole text has had its share of the span above dealt out already
                given = 0.0 if high - low == n else (both - without) / (high - low)
                out += [(low, at, share_a / (at - low) - given), (at, high, share_b / (high - at) - given)]
            # neighbouring places cut spans inside one span, so their sums cover no more than that
            start, end = min(low for low, _, _ in out), max(high for _, high, _ in out)
            sums = np.zeros(end - start)
            for low, high, add in out:
                sums[low - start : high - start] += add
            return start, sums, best, float(empty[best])

        columns = ["key", "whole", "low", "sums", "sentiment", "base_value"]
        for batch in batches:
            rows, held = [], 0
            for key, words, first, stop in zip(batch["key"], batch["words"], batch["first"], batch["stop"]):
                low, sums, best, base = shares(list(words), int(first), int(stop))
                rows.append((key, first == 1 and stop >= len(words), low, sums, classes[best], base))
                held += len(sums)
                if held > KEPT_SUMS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    keyed = df.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col), T.tokens(F.col(text_col)).alias("__words"))
    keyed = materialize(keyed.where(F.size("__words") > 0), "keyed")  # written, so a task that runs again finds the same keys
    n = F.size("__words").cast("long")
    rated_contexts = F.greatest(F.lit(contexts), F.ceil(F.log2(n.cast("double"))))
    per_row = F.greatest(F.lit(1), F.floor(F.lit(work) / (2 * rated_contexts * n))).cast("long")
    firsts = F.sequence(F.lit(1).cast("long"), F.greatest(n - 1, F.lit(1)), per_row)
    pieces = keyed.select(F.col("__row").alias("key"), F.col("__words").alias("words"), n.alias("n"),
                          per_row.alias("size"), F.explode(firsts).alias("first"))
    pieces = pieces.select("key", "words", "first", F.least(F.col("first") + F.col("size"), "n").alias("stop"))
    # tasks are cut by work, which is far more than the size of the rows says
    per_text = F.ceil((n - 1) / per_row)
    total, rows = keyed.agg(F.sum(2.0 * rated_contexts * n * n), F.sum(F.greatest(per_text, F.lit(1)))).first()
    few = min((total or 0) // (work / 4), df.sparkSession.sparkContext.defaultParallelism)
    tasks = max(1, int(min(max((total or 0) // (work * TASK_ROWS), few), rows or 0, MOST_TASKS)))
    found = pieces.repartition(tasks, "key", "first").mapInPandas(
        run, "key long, whole boolean, low int, sums array<double>, sentiment string, base_value double"
    )
    found = materialize(found, "shares")
    # a text of one piece has its values already; the others' meet in one sum per token
    one = keyed.where(per_text <= 1).join(found.where("whole"), F.col("__row") == F.col("key"))
    one = one.select(id_col, "sentiment", "base_value", F.posexplode(F.arrays_zip("__words", "sums")).alias("pos", "at"))
    one = one.select(id_col, "sentiment", "base_value", "pos", F.col("at.__words").alias("token"), F.col("at.sums").alias("value"))
    tokens = found.where("NOT whole").select("key", "sentiment", "base_value", "low", F.posexplode("sums").alias("at", "add"))
    values = tokens.groupBy("key", (F.col("low") + F.col("at")).alias("pos")).agg(
        F.sum("add").alias("value"), F.first("sentiment").alias("sentiment"), F.first("base_value").alias("base_value")
    )
    words = keyed.where(per_text > 1).select(F.col("__row").alias("key"), id_col, F.posexplode("__words").alias("pos", "token"))
    met = words.join(values, ["key", "pos"]).select(id_col, "sentiment", "base_value", "pos", "token", "value")
    return one.unionByName(met)


def ranked_tokens(tokens: Column, values: Column, scale: float = 45.0) -> Column:
    """Array of struct(rank, token, value, width): by |value| descending, input order on ties.

    Works inside the row, so a long text needs no shuffle. Width is |value| / max(|value|, 1e-9) * scale;
    after sorting the maximum is the first entry, so no pass per token is needed.
    """
    items = F.transform(
        F.arrays_zip(tokens.alias("token"), values.alias("value")),
        lambda r, i: F.struct(
            (-F.abs(r["value"])).alias("o"), i.alias("pos"), r["token"].alias("token"), r["value"].alias("value")
        ),
    )

    def finish(ordered: Column) -> Column:
        def item(r: Column, i: Column) -> Column:
            top = F.greatest(-F.get(ordered, F.lit(0))["o"], F.lit(1e-9))
            return F.struct(
                (i + 1).alias("rank"),
                r["token"].alias("token"),
                r["value"].alias("value"),
                (-r["o"] / top * scale).alias("width"),
            )

        return F.transform(ordered, item)

    return T.bind(F.array_sort(items), finish)
