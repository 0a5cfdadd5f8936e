"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text is lower-cased and cut into words of letters and digits. At every anchor (a very common word), and at the
beginning, the next ``chain`` words that are no anchors, found within ``reach`` words, form a signature,
hashed to 64 bits. Where no anchor with a complete chain stands among the last ``reach`` words, every word, anchor or
not, gives a signature of itself and the words after it, ``chain`` in all: tables, lists and other languages enter
whole. A text without any complete chain has only these signatures; a text without words has signatures of its runs
of ``chain`` signs, white space aside. The fingerprint is the set of signatures; its
digest is what is shown. Two sets are compared by Jaccard similarity, which the ratio of their sizes bounds: pairs
whose sizes lie apart are never intersected.

``near_pairs`` partitions the sets by size into bands one threshold wide, so that only equal and neighbouring
bands can hold similar sets, and joins on the rarest signatures that any similar set must share.

Null texts count as empty; an empty or blank text has no signatures, is like another empty one (1) and unlike others (0).
``with_edits`` walks the ids downwards; a missing id counts as -2**62. Rows of one id take the same next text, the
largest one where the next id is repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.llm.graph import components
from labelflow.session import materialize

# Common words of the languages of the corpus.
ANCHORS = (
    "the of and to a in is it that for was on are with as be this by from or "
    "der die das und den des dem von mit für auf ist im zu ein eine nicht als "
    "le la les et du un une est que qui dans pour sur pas au ce "
    "el los las y que en del se por con no una su para es al lo"
).split()
CHAIN = 3
REACH = 12
THRESHOLD = 0.8
FAR_BELOW = -(1 << 62)
RANGE = 7
STEPS = (8, 20, 32, 44, 56)


def _barrier(rows: DataFrame, name: str, value) -> DataFrame:
    """Adds a column that is computed once, however often later expressions use it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def signatures(rows: DataFrame, text: str, name: str, chain: int = CHAIN, reach: int = REACH) -> DataFrame:
    """Adds column ``name``: the sorted set of signatures of a text column."""
    anchors = list(dict.fromkeys(ANCHORS))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    rows = _barrier(rows, "_w", words)

    def content(start):
        return F.slice(F.filter(F.slice("_w", start, F.lit(reach)), lambda w: ~w.isin(anchors)), 1, chain)

    places = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: F.get("_w", i - 1).isin(anchors))
    spots = F.transform(places, lambda i: F.struct(i.alias("at"), F.get("_w", i - 1).alias("anchor"), content(i + 1).alias("words")))
    rows = _barrier(rows, "_s", F.filter(spots, lambda s: F.size(s["words"]) == chain))
    hashed = F.transform("_s", lambda s: F.xxhash64(s["anchor"], F.array_join(s["words"], " ")))
    first = F.when(F.size(content(F.lit(1))) > 0, F.array_join(content(F.lit(1)), " ")).otherwise(F.array_join("_w", " "))
    none = F.array().cast("array<bigint>")
    opening = F.when(F.size("_s") > 0, F.array(F.xxhash64(F.lit("^"), first))).otherwise(none)

    # stretches of words that no complete chain reaches
    n, at = F.size("_w"), F.transform("_s", lambda s: s["at"])
    gaps = F.zip_with(
        F.concat(F.array(F.lit(-reach)), at), F.concat(at, F.array(n + 1)),
        lambda a, b: F.struct((a + reach + 1).alias("lo"), (b - 1).alias("hi")),
    )
    gaps = F.filter(gaps, lambda g: g["lo"] <= g["hi"])
    last = lambda g: F.least(g["hi"], F.greatest(g["lo"], n - chain + 1))
    runs = F.transform(gaps, lambda g: F.transform(
        F.sequence(g["lo"], last(g)), lambda i: F.xxhash64(F.lit(""), F.array_join(F.slice("_w", i, chain), " "))))
    # a text of signs only has signatures of its runs of code points, ``chain`` at a time
    def of_signs(signs):
        starts = F.sequence(F.lit(1), F.greatest(F.size(signs) - chain + 1, F.lit(1)))
        runs = F.transform(starts, lambda i: F.xxhash64(F.lit("="), F.array_join(F.slice(signs, i, chain), "")))
        return F.when(F.size(signs) == 0, none).otherwise(F.array_sort(F.array_distinct(runs)))

    bare = F.get(F.transform(F.array(F.regexp_extract_all(F.col(text), F.lit(r"\S"), 0)), of_signs), F.lit(0))
    found = F.when(F.size("_w") == 0, bare).otherwise(
        F.array_sort(F.array_distinct(F.concat(opening, hashed, F.flatten(runs))))
    )
    return _barrier(rows, name, found).drop("_w", "_s")


def digest(sigs: str):
    return F.md5(F.array_join(F.transform(sigs, lambda s: s.cast("string")), ","))


def likeness(a: str, b: str, least: float = 0.0):
    """Jaccard similarity, 0 where the sizes alone keep it below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, 1.0).when((small == 0) | (small < F.lit(least) * large), 0.0)
        .otherwise(shared / (F.size(a) + F.size(b) - shared))
    )


def next_below(ids: DataFrame) -> DataFrame:
    """(id, next_id): the largest smaller id; after the smallest the largest. ids: (id), non-null, repeats allowed.

    Windows run within ranges of ids, then over the ranges in wider ranges and so on, so that no task holds
    more than 4096 rows, whatever the spacing of the ids.
    """
    level = ids.groupBy("id").agg(F.first("id").alias("hi")).withColumnRenamed("id", "lo")
    level = materialize(level, "ids")
    pairs = []
    for step in STEPS:
        group = F.shiftright("lo", step)
        before = F.lag("hi").over(Window.partitionBy(group).orderBy("lo"))
        pairs.append(level.select(F.col("lo").alias("id"), before.alias("next_id")).where("next_id is not null"))
        level = materialize(level.groupBy(group).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi"), "ids")
    # at most 2**8 rows are left
    before = F.lag("hi").over(Window.orderBy("lo"))
    pairs.append(level.select(F.col("lo").alias("id"), before.alias("next_id")).where("next_id is not null"))
    pairs.append(level.agg(F.min("lo").alias("id"), F.max("hi").alias("next_id")).where("id is not null"))
    found = pairs[0]
    for more in pairs[1:]:
        found = found.union(more)
    return found


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    A row finds its next text in a window over its range of 2**RANGE ids, which is the one shuffle that
    carries texts. Only the smallest id of a range needs the last text of another range; those are joined.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FAR_BELOW))
    rows = docs.select("doc_id", key.alias("key"), F.coalesce("text", F.lit("")).alias("body"))
    rows = rows.withColumn("part", F.shiftright("key", RANGE))

    pairs = next_below(docs.select(key.alias("id")))
    crossing = (F.shiftright("id", RANGE) != F.shiftright("next_id", RANGE)) | (F.col("next_id") >= F.col("id"))
    asks = pairs.where(crossing).select(F.shiftright("id", RANGE).alias("part"), F.col("next_id").alias("key"))
    tops = rows.groupBy("part").agg(F.max(F.struct("key", "body")).alias("top")).select("top.key", F.col("top.body").alias("edge"))
    edges = asks.join(tops, "key").select("part", "edge")

    lower = Window.partitionBy("part").orderBy("key").rangeBetween(Window.unboundedPreceding, -1)
    below = F.max(F.struct("key", "body")).over(lower)
    both = rows.withColumn("below", below).join(edges, "part", "left")
    both = both.select("doc_id", "body", F.coalesce("below.body", "edge").alias("next"))
    n = F.length("body")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("body", n - half), F.left("next", half))
    both = both.select("doc_id", "body", "next", edited.alias("edited"))
    for text in ("body", "next", "edited"):
        both = signatures(both, text, f"{text}_sigs")
    return both.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digest("body_sigs").alias("fingerprint"), digest("edited_sigs").alias("edited_fingerprint"),
        likeness("body_sigs", "edited_sigs").alias("near_edited"), likeness("body_sigs", "next_sigs").alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, cluster_id): class of equal fingerprints and cluster of similar classes of every row.

    Both ids are the smallest doc_id in them. Two classes are linked if their similarity is at least
    ``threshold``: then both hold one of the rarest ``size - ceil(threshold * size) + 1`` signatures of the other.
    """
    rows = signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")), "body", "sigs").drop("body")
    rows = materialize(rows.withColumn("print", digest("sigs")), "prints")
    classes = materialize(
        rows.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")), "classes"
    )
    flat = classes.where("class_id is not null").select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    seen = materialize(flat.groupBy("sig").agg(F.count("*").alias("uses")), "uses")
    ranked = F.row_number().over(Window.partitionBy("class_id").orderBy("uses", "sig"))
    rare = flat.join(seen, "sig").withColumn("place", ranked).where(
        F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1
    )
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int")
    rare = materialize(rare.select("sig", "class_id", "n", band.alias("band")), "rare")
    a = rare.select("sig", F.col("class_id").alias("a"), F.col("n").alias("na"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    b = rare.select("sig", F.col("class_id").alias("b"), F.col("n").alias("nb"), "band")
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") >= F.lit(threshold) * F.col("nb")) & (F.col("a") != F.col("b"))
    pairs = materialize(a.join(b, ["sig", "band"]).where(fits).select("a", "b").distinct(), "pairs")
    sets = classes.select("class_id", "sigs")
    checked = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("sigs").alias("sa")), "a").join(
        sets.select(F.col("class_id").alias("b"), F.col("sigs").alias("sb")), "b"
    )
    links = checked.where(likeness("sa", "sb", threshold) >= threshold).select("a", "b")
    roots = components(links).select(F.col("node").alias("class_id"), F.col("root").alias("cluster_id"))
    placed = classes.select("print", "class_id").join(roots, "class_id", "left")
    placed = materialize(placed.select("print", "class_id", F.coalesce("cluster_id", "class_id").alias("cluster_id")), "placed")
    return rows.join(placed, "print").select("doc_id", "class_id", "cluster_id")
