"""Deterministic draws: quotas per stratum, stratified splits, capped samples, oversampling.

Row order is the md5 key of (seed, id), then the id, then a hash of the row's content, so repeated and missing
ids are drawn exactly; rows equal in all columns are told apart by a number. A quota never needs a per-stratum sort of the table:

1. count rows per (stratum, first ``digits`` hex digits of the key) - a small table after map-side combine,
   written once; stratum sizes come from it too;
2. find, per stratum, the one key range that holds the quota's last row, and rank only that range
   (1/4096 of the stratum at three digits);
3. mark rows by comparing their key with that last row, from a table of one row per stratum. It is joined by
   its size, which for class-like strata means a broadcast: no shuffle of the wide table.

Sizes, quotas and last rows stay tables, so there may be any number of strata.

So a stratum with a third of all rows costs no more than its share of a scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from labelflow.functions.hashing import hash_int, hash_key
from labelflow.session import materialize

DIGITS = 3
DRAWS = 4096


def key_ranges(keyed: DataFrame, digits: int) -> DataFrame:
    """(s, p, n): rows per stratum and key prefix, written once; sizes and edges are read from it."""
    prefix = F.substring("k", 1, digits).alias("p")
    return materialize(keyed.groupBy("s", prefix).agg(F.count(F.lit(1)).alias("n")), "key-ranges")


def _last_rows(keyed: DataFrame, ranges: DataFrame, wanted: DataFrame, digits: int) -> DataFrame:
    """(s, cut) of strata with a quota above 0: where the quota's last row stands, how many rows equal to it
    are taken, and how many there are. Every hex key sorts before "g", so that cut takes a whole stratum."""
    sized = ranges.groupBy("s").agg(F.sum("n").alias("size"))
    asked = sized.join(wanted.select(F.col("s").alias("ws"), "quota"), F.col("s").eqNullSafe(F.col("ws")))
    asked = asked.where("quota > 0").select(F.col("s").alias("ws"), "quota", "size")
    whole = asked.where("quota >= size").select(
        F.col("ws").alias("s"),
        F.struct(F.lit("g").alias("k"), F.lit("").alias("id"), F.lit(0).cast("long").alias("t"),
                 F.lit(1).cast("long").alias("take"), F.lit(1).cast("long").alias("n")).alias("cut"),
    )
    reached = F.col("upto") >= F.col("rest")
    started = F.col("upto") - F.col("n") < F.col("rest")
    edges = (
        ranges.join(asked.where("quota < size"), F.col("s").eqNullSafe(F.col("ws")))
        .withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("p")))
        .withColumnRenamed("quota", "rest")
        .where(reached & started)
        .select(F.col("s").alias("es"), F.col("p").alias("ep"), (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))
    )
    in_range = F.col("s").eqNullSafe(F.col("es")) & (F.substring("k", 1, digits) == F.col("ep"))
    alike = keyed.join(edges, in_range).groupBy("s", "k", "id", "t", "rest").agg(F.count(F.lit(1)).alias("n"))
    last = (
        alike.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("k", "id", "t")))
        .where(reached & started)
        .select("s", F.struct("k", "id", "t", (F.col("rest") - F.col("upto") + F.col("n")).alias("take"), "n").alias("cut"))
    )
    return whole.unionByName(last)


def content_hash(df: DataFrame) -> Column:
    """64 bits of a row's values that also tell which of them are missing."""
    return F.xxhash64(*df.columns, *[F.col(f"`{c}`").isNull() for c in df.columns])


def row_key(df: DataFrame, id_col: str, seed: int) -> Column:
    """md5 of seed and id; rows without an id are keyed by their content, so they do not share one key."""
    nameless = hash_key(seed, "no id", content_hash(df))
    return F.when(F.col(id_col).isNull(), nameless).otherwise(hash_key(seed, F.col(id_col)))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``rank`` 1..n in the given total order: a range-partitioned sort, then one offset per partition."""
    placed = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    upto = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))  # one row per partition
    offsets = sizes.select("__part", (upto - F.col("__n") - F.col("__first") + 1).alias("__shift"))
    rows = placed.join(offsets, part == F.col("__part"))
    return rows.withColumn("rank", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def mark_quota(
    df: DataFrame,
    stratum: Column,
    quotas: Mapping[str | None, int] | Callable[[DataFrame], DataFrame],
    id_col: str,
    seed: int,
    out: str = "taken",
    among: Column | None = None,
    digits: int = DIGITS,
) -> DataFrame:
    """Add boolean ``out``: true for exactly ``quota`` rows of each stratum (all, if it has fewer).

    ``quotas`` makes (s, quota) from (s, n), the strata and their sizes, or maps strata to numbers; there may
    be any number of strata.
    ``among`` restricts which rows compete. ``digits`` sets the number of key ranges, 16 to its power: one
    more divides what is ranked per stratum by 16.
    """
    among = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    key, ident = row_key(df, id_col, seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    content = content_hash(df)
    name = stratum.cast("string")
    keyed = df.filter(among).select(name.alias("s"), key.alias("k"), ident.alias("id"), content.alias("t"))
    ranges = key_ranges(keyed, digits)
    if isinstance(quotas, Mapping):
        wanted = df.sparkSession.createDataFrame(list(quotas.items()), "s string, quota long")
    else:
        wanted = quotas(ranges.groupBy("s").agg(F.sum("n").alias("n")))
    cuts = _last_rows(keyed, ranges, wanted, digits).withColumnsRenamed({"s": "__s", "cut": "__cut"})
    cuts = materialize(cuts, "cuts")  # one row per stratum; read back, its size decides how it is joined
    at, cut = F.struct(key.alias("k"), ident.alias("id"), content.alias("t")), F.col("__cut")
    edge = F.struct(cut["k"].alias("k"), cut["id"].alias("id"), cut["t"].alias("t"))
    placed = (
        df.withColumn("__stratum", name).withColumn("__at", at).withColumn("__among", among)
        .join(cuts, F.col("__stratum").eqNullSafe(F.col("__s")), "left")
        .withColumn("__hit", F.col("__among") & F.coalesce(F.col("__at") <= edge, F.lit(False)))
        .withColumn("__tie", F.col("__hit") & F.coalesce((F.col("__at") == edge) & (cut["take"] < cut["n"]), F.lit(False)))
    )
    columns = [*df.columns]
    if cuts.where(cut["take"] < cut["n"]).isEmpty():
        return placed.select(*columns, F.col("__hit").alias(out))
    # only some of a set of rows with one content hash are taken, in the order of their content
    marked = placed.filter(~F.col("__tie")).select(*columns, F.col("__hit").alias(out))
    whole = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    place = F.row_number().over(Window.partitionBy("__stratum").orderBy(whole))
    ties = placed.filter("__tie").withColumn("__place", place)
    return marked.unionByName(ties.select(*columns, (F.col("__place") <= cut["take"]).alias(out)))


def take_quota(df: DataFrame, stratum: Column, quotas, id_col: str, seed: int = 42) -> DataFrame:
    """Only the rows :func:`mark_quota` marks."""
    marked = mark_quota(df, stratum, quotas, id_col, seed, out="__taken")
    return marked.filter("__taken").drop("__taken")


def fixed_quota(n: int | Column) -> Callable[[DataFrame], DataFrame]:
    """The same quota for every stratum."""
    return lambda counts: counts.select("s", F.lit(n).cast("long").alias("quota"))


def validation_counts(counts: Mapping[str | None, int], ratio: float) -> dict[str | None, int]:
    """:func:`held_counts` of a plain mapping."""
    n = sum(counts.values())
    keep = n - math.ceil(ratio * n)
    shares = {c: k / n * keep for c, k in counts.items()}
    kept = {c: math.floor(v) for c, v in shares.items()}
    by_remainder = sorted(shares, key=lambda c: (kept[c] - shares[c], c is None, str(c)))
    for c in by_remainder[: keep - sum(kept.values())]:
        kept[c] += 1
    return {c: k - kept[c] for c, k in counts.items()}


def held_counts(counts: DataFrame, ratio: float) -> DataFrame:
    """(s, quota) from (s, n): ceil(ratio * n) rows in all, the kept rows shared by largest remainder.

    Equal remainders go to the smaller label first. Only strata are ranked, never rows, and by a distributed
    sort, so there may be any number of them.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    keep = total - math.ceil(ratio * total)
    share = F.col("n") / F.lit(total) * F.lit(keep)
    shared = counts.withColumn("share", share).withColumn("kept", F.floor("share"))
    spare = keep - (shared.agg(F.sum("kept")).first()[0] or 0)
    placed = ranked(shared, (F.col("share") - F.col("kept")).desc(), F.col("s").asc_nulls_last())
    extra = (F.col("rank") <= F.lit(spare)).cast("long")
    return placed.select("s", (F.col("n") - F.col("kept") - extra).alias("quota"))


def check_split(row: Row, ratio: float) -> None:
    """Whether classes (n rows in ``classes`` classes, the smallest of ``least``) can be split at all."""
    held = math.ceil(ratio * row["n"])
    if row["least"] < 2:
        raise ValueError("cannot stratify: every class needs at least 2 rows")
    if held < row["classes"]:
        raise ValueError(f"cannot stratify: {held} held-out rows for {row['classes']} classes")
    if row["n"] - held < row["classes"]:
        raise ValueError(f"cannot stratify: {row['n'] - held} remaining rows for {row['classes']} classes")


def stratified_split(
    df: DataFrame,
    strata: str | None,
    ratio: float,
    seed: int = 42,
    id_col: str = "sentence_id",
    from_value: str = "train",
    to_value: str = "val",
    split_col: str = "split",
) -> DataFrame:
    """Move ceil(ratio * n) of the ``from_value`` rows to ``to_value``, proportionally per class.

    Other rows, also those without a split, stay as they are; fewer than two rows to split: unchanged.
    """
    if not 0 < ratio < 1:
        raise ValueError("ratio must satisfy 0 < ratio < 1")
    among = F.col(split_col).eqNullSafe(from_value)
    stratum = F.lit("all") if strata is None else F.col(strata)

    def quotas(counts: DataFrame) -> DataFrame:
        row = counts.agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.count(F.lit(1)).alias("classes")).first()
        if (row["n"] or 0) < 2:
            return fixed_quota(0)(counts)
        if strata is not None:
            check_split(row, ratio)
        return held_counts(counts, ratio)

    marked = mark_quota(df, stratum, quotas, id_col, seed, "__held", among)
    moved = F.when(F.col("__held"), F.lit(to_value)).otherwise(F.col(split_col))
    return marked.withColumn(split_col, moved).drop("__held")


def train_test_split(
    df: DataFrame, strata: str | None, id_col: str, ratio: float = 0.1, seed: int = 42
) -> DataFrame:
    """All rows to train or test; one stratum when ``strata`` is None."""
    return stratified_split(
        df.withColumn("split", F.lit("train")), strata, ratio, seed, id_col, to_value="test"
    )


def sample_per_group(
    df: DataFrame, group: str, cap: int = 200, id_col: str = "sentence_id", seed: int = 42
) -> DataFrame:
    """At most ``cap`` rows of each group; rows without a group are dropped."""
    present = df.filter(F.col(group).isNotNull())
    return take_quota(present, F.col(group), fixed_quota(cap), id_col, seed)


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """``n`` rows of the table, all of them if it has fewer."""
    return take_quota(df, F.lit("all"), fixed_quota(n), id_col, seed)


def mix_tasks(
    main: DataFrame, other: DataFrame, id_col: str, ratio: int = 3, seed: int = 42
) -> DataFrame:
    """All of ``other`` and at most ``ratio`` times as many rows of ``main``."""
    quota = ratio * other.count()
    return take_quota(main, F.lit("all"), fixed_quota(quota), id_col, seed).unionByName(other)


def first_rows(df: DataFrame, n: int, order_col: str = "row_order") -> DataFrame:
    """First ``n`` rows with a 1-based ``row`` number; only those rows reach the numbering window."""
    top = df.orderBy(order_col).limit(n)
    return top.withColumn("row", F.row_number().over(Window.orderBy(order_col)))


def class_rank(df: DataFrame, stratum: str, id_col: str, seed: int, digits: int = DIGITS) -> DataFrame:
    """Add ``rank`` 1..n of each row inside its stratum, in key order.

    Ranking runs per (stratum, key range), and range totals give the offsets, so a large stratum is
    spread over 16 ** ``digits`` small windows. Rows of one id are ordered by their content, so ranks do not
    depend on partitioning; rows without an id are spread like others.
    """
    keyed = df.withColumns({"__k": row_key(df, id_col, seed), "__t": content_hash(df)}).withColumn(
        "__p", F.substring("__k", 1, digits)
    )
    sizes = keyed.groupBy(stratum, "__p").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(stratum).orderBy("__p")
    offsets = sizes.select(
        F.col(stratum).alias("__os"),
        F.col("__p").alias("__op"),
        (F.sum("__n").over(upto) - F.col("__n")).alias("__before"),
    )
    local = Window.partitionBy(stratum, "__p").orderBy("__k", F.col(id_col).cast("string"), "__t")
    return (
        keyed.withColumn("__local", F.row_number().over(local))
        .join(
            offsets,
            F.col(stratum).eqNullSafe(F.col("__os")) & (F.col("__p") == F.col("__op")),
        )
        .withColumn("rank", (F.col("__before") + F.col("__local")).cast("long"))
        .drop("__k", "__t", "__p", "__n", "__os", "__op", "__before", "__local")
    )


def extra_rows(counts: DataFrame, target: float) -> DataFrame:
    """(s, n, extra): new rows of each class below the target share of all rows, also the unlabelled ones."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = F.col("n") / F.lit(float(max(total, 1)))
    extra = ((F.lit(target * total) - F.col("n")) / F.lit(1.0 - target)).cast("long")
    return counts.where(F.col("s").isNotNull() & (share < target)).select("s", "n", extra.alias("extra")).where("extra > 0")


def oversample(
    df: DataFrame,
    label_col: str = "label",
    id_col: str = "sentence_id",
    target_ratio: float = 0.15,
    seed: int = 42,
    shuffle: bool = False,
) -> DataFrame:
    """Draw rows of small classes again, with replacement, until each has the target share.

    Draw k of class c takes the row whose rank is hash(seed, c, k) mod n_c + 1. Draws are made in blocks
    that are spread before they unfold, so neither a huge number of draws nor a one-row class lands in one
    task (the join's draw side is the big one and may be split).
    """
    if label_col not in df.columns:
        return df
    labelled = df.filter(F.col(label_col).isNotNull())
    name = F.col(label_col).cast("string")
    counts = materialize(df.groupBy(name.alias("s")).agg(F.count(F.lit(1)).alias("n")), "classes")
    if counts.where("s is not null").count() < 2:
        return df
    new = materialize(extra_rows(counts, target_ratio), "extra")
    if new.isEmpty():
        return labelled
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("extra") - 1) / DRAWS)))
    blocks = new.select("s", "n", "extra", block.alias("block")).repartition("s", "block")
    first, last = F.col("block") * DRAWS + 1, F.least((F.col("block") + 1) * DRAWS, F.col("extra"))
    draws = blocks.select(
        F.col("s").alias("__class"), F.explode(F.sequence(first, last)).alias("__draw"), F.col("n").alias("__size")
    )
    draws = draws.withColumn(
        "__rank",
        F.pmod(hash_int(hash_key(seed, F.col("__class"), F.col("__draw"))), F.col("__size")) + 1,
    )
    drawn = new.select(F.col("s").alias("__label"))
    small = class_rank(labelled.withColumn("__label", name).join(drawn, "__label", "left_semi"), "__label", id_col, seed)
    copies = draws.join(
        small, (F.col("__class") == F.col("__label")) & (F.col("__rank") == F.col("rank"))
    ).select(*df.columns, F.col("__draw").alias("draw"))
    out = labelled.withColumn("draw", F.lit(0).cast("long")).unionByName(copies)
    if shuffle:
        out = out.orderBy(hash_key(seed, F.col(id_col), F.col("draw")))
    return out.drop("draw")
