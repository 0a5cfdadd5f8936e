"""Mixing sources to target weights by weighted fair queueing.

Targets: sources in code point order, null last, weigh 5, 2, 1, 5, ...; they share ``share`` times all words
by weight, none above ``repeat`` times its own words, the excess shared again by weight until none is above.

Queue: each source's documents are shuffled by md5 of their id and may be taken ``repeat`` times, pass after
pass. A copy's virtual finish time is the words of its source up to and including it, divided by the source's
target. All copies stand in one order of finish time; the mix takes them from the front while their words
fit into the sum of the targets.

Neither step sorts a source or the whole table in one task. Words within a source are summed per three hex
digits of the key (4096 ranges of each source) and then within a range. The end of the mix is found by
narrowing the range of finish times in which the sum of words reaches the budget, 4096 ranges at a time,
until it holds (almost always) one copy.

Null texts have size 0. Documents of size 0 are never short of words: they take 0. Rows of one doc_id share
its key and stand next to each other. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.llm.rows import row_identity
from labelflow.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
SEED = "mix"
RANGES = 4096
PASSES = 4


def word_count(text: str):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, repeat=REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, size) rows; one row per source.

    The weights cycle over the sources' order, so that order is a window over the sources table. The filling
    asks for two sums over the sources a round, at most one round per source and in practice two or three.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(w) for w in weights])
    table = materialize(
        totals.withColumn("weight", F.get(cycle, (place - 1) % len(weights))), "sources"
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = share * total, 0.0, -1
    while True:
        above = F.col("source_size") * repeat < F.lit(level) * F.col("weight")
        row = table.agg(
            F.sum(F.when(above, F.col("source_size") * repeat).otherwise(0)),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))),
            F.sum(F.when(above, 1).otherwise(0)),
        ).first()
        if not row[1] or row[2] == capped:
            break
        capped, level = row[2], (budget - row[0]) / row[1]
    full = F.col("source_size") * repeat
    target = F.least(full.cast("double"), F.lit(float(level)) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def _range_of(finish, lo: float, hi: float):
    return F.least(F.floor((finish - F.lit(lo)) / F.lit(hi - lo) * RANGES), F.lit(RANGES - 1))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, repeat=REPEAT, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, and ``keep``) for every row of docs."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialize(
        docs.select("doc_id", "source", word_count("text").alias("size"), key.alias("key"), *keep), "sizes"
    )
    targets = source_targets(rows, weights, share, repeat)

    cell = F.substring("key", 1, 3)
    cells = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    cells = cells.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    cells = materialize(cells.select("source", "cell", "before", "source_size", "target"), "cells")

    a, c = rows.withColumn("cell", cell).alias("a"), cells.alias("c")
    same = F.col("a.source").eqNullSafe(F.col("c.source")) & (F.col("a.cell") == F.col("c.cell"))
    placed = a.join(c, same).select("a.*", "c.before", "c.source_size", "c.target")
    inside = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size", *keep).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    served = F.col("before") + F.sum("size").over(inside)
    placed = placed.withColumn("served", served).withColumn(
        "finish",
        F.transform(
            F.sequence(F.lit(0), F.lit(repeat - 1)),
            lambda k: F.try_divide(F.col("served") + k * F.col("source_size"), F.col("target")),
        ),
    )
    placed = materialize(placed.drop("served", "before", "cell"), "placed")

    copies = F.when(F.col("size") == 0, 0).otherwise(_copies_taken(placed, share))
    return placed.withColumn("copies", copies.cast("int")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        *keep,
    )


def draw(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs as often as the mix takes them, with the columns of docs."""
    own = row_identity(docs).alias("row_hash")
    taken = mix(docs.select("doc_id", "source", "text", own), keep=("row_hash",), **options)
    times = taken.groupBy("row_hash").agg(F.sum("copies").alias("times"), F.count("*").alias("n"))
    times = materialize(times.where("times > 0"), "times")
    found = docs.select(F.struct(*docs.columns).alias("row"), own).join(times.hint("merge"), "row_hash")
    rows = found.where("n = 1").unionByName(found.where("n > 1").dropDuplicates(["row_hash"]))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def _copies_taken(placed: DataFrame, share: float):
    """Column: how many of a row's copies lie before the place where the words reach the budget."""
    queue = placed.where("size > 0").select("source", "key", "doc_id", "size", F.posexplode("finish").alias("copy", "at"))
    row = placed.agg(F.sum("size"), F.max(F.element_at("finish", -1))).first()
    if not row[0]:
        return F.lit(0)
    room, lo, hi = share * row[0], 0.0, row[1] * 1.0000001
    steps: list[tuple[float, float, int]] = []
    for _ in range(PASSES):
        within = [_range_of(F.col("at"), *s[:2]) == s[2] for s in steps]
        part = reduce(lambda df, cond: df.where(cond), within, queue)
        sums = part.groupBy(_range_of(F.col("at"), lo, hi).alias("r")).agg(F.sum("size").alias("words"))
        fits = 0
        counts = sorted(sums.collect())  # at most RANGES rows
        for r, words in counts:
            if words > room:
                break
            room -= words
            fits += 1
        if fits == len(counts):
            cut = RANGES
            steps.append((lo, hi, cut))
            break
        cut = counts[fits][0]
        steps.append((lo, hi, cut))
        lo, hi = lo + (hi - lo) * cut / RANGES, lo + (hi - lo) * (cut + 1) / RANGES
        if not hi > lo:
            break

    # what is left in the last range, in order
    order = [F.col("at"), F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("copy")]
    within = [_range_of(F.col("at"), *s[:2]) == s[2] for s in steps]
    last = reduce(lambda df, cond: df.where(cond), within, queue)
    total = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    beyond = last.withColumn("total", total).where(F.col("total") > room).orderBy(*order).limit(1).collect()

    def place(at, copy):
        return F.struct(at.alias("at"), F.col("source").isNull().alias("none"), F.col("source").cast("string").alias("s"),
                        F.col("key").alias("k"), F.col("doc_id").alias("d"), copy.cast("int").alias("c"))

    def taken(at, copy):
        if beyond:
            b = beyond[0]
            edge = F.struct(F.lit(b["at"]).alias("at"), F.lit(b["source"] is None).alias("none"),
                            F.lit(b["source"]).cast("string").alias("s"), F.lit(b["key"]).alias("k"),
                            F.lit(b["doc_id"]).cast(dict(placed.dtypes)["doc_id"]).alias("d"),
                            F.lit(b["copy"]).cast("int").alias("c"))
            at_end = place(at, copy) < edge
        else:
            at_end = F.lit(True)
        for low, high, cut in reversed(steps):
            r = _range_of(at, low, high)
            at_end = F.when(r < cut, True).when(r > cut, False).otherwise(at_end)
        return at_end.cast("int")

    marks = F.transform("finish", lambda at, copy: F.when(at.isNull(), 0).otherwise(taken(at, copy)))
    return F.aggregate(marks, F.lit(0), lambda total, x: total + x)
