"""How five filters interact: survival words and carry-save positional popcounts.

Each filter is one letter of ``ABCDE`` (bit 0 to 4). A document that fails the filters in the mask f becomes a
32-bit word whose bit S is set if it survives the subset S of filters, that is if S and f share no bit. The
survivors of all 32 subsets are then the positional popcounts of the words. Tasks count them with carry-save
adders: a full adder turns three words into a sum word and a carry word, so plane j holds bit j of 32 counters
at once and no counter is ever unpacked in a task. Planes of all tasks are added up per part and label.

A text that occurs many times is one row per task before the shuffle, then one word with its number of copies;
the bits of that number say which planes the word enters. No join goes by text, so a hot text is no hot key.

Defined cases: a null text counts as empty (fails A, passes B, C and D); a null language is the part ``''``.
Rows without doc_id have no labels, never fail E and make no other row fail it. Repeated rows count each; rows
that share the smallest doc_id of a text all pass E. Labels of one doc_id are joined by "any". Very long texts
are read whole. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Classes of labels counted beside all documents.
KINDS = ("all", "good", "toxic")
# Counters a task holds before it passes them on, so that its memory does not grow with the number of parts.
OPEN_PARTS = 4096
BUFFER = 4096


def text_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))

    def mask(w: Column) -> Column:
        rules = [
            F.size(w) < 100,
            F.size(F.array_distinct(w)) * 100 < F.size(w) * 80,
            capitals * 100 > F.length(text) * 10,
            text.rlike(r"[#$%&*|]"),
        ]
        return sum((F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules)), F.lit(0))

    # a one-element array binds the words, so that they are cut once
    return F.get(F.transform(F.array(words), mask), F.lit(0)).cast("int")


def survival_words(failures: np.ndarray) -> np.ndarray:
    """One 32-bit word per mask of failed filters: bit S is set if none of S is failed."""
    subsets = np.arange(SUBSETS, dtype=np.uint32)
    alive = (subsets[None, :] & np.asarray(failures, dtype=np.uint32)[:, None]) == 0
    return (alive.astype(np.uint32) << subsets).sum(axis=1, dtype=np.uint32)


class Planes:
    """32 counters held as bit planes: bit S of plane j is bit j of counter S."""

    def __init__(self):
        self.pending: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, words: np.ndarray, times: np.ndarray) -> None:
        """Adds each word as often as ``times`` says: it enters the planes of the bits of that number."""
        for j in range(int(times.max(initial=0)).bit_length()):
            chosen = words[(times >> j) & 1 == 1]
            if len(chosen):
                self._put(j, chosen)
        self.waiting += len(words)
        if self.waiting > BUFFER:
            self.settle()

    def _put(self, plane: int, words: np.ndarray) -> None:
        while len(self.pending) <= plane:
            self.pending.append([])
        self.pending[plane].append(words)

    def settle(self) -> None:
        """Carry-save additions until every plane holds at most one word."""
        plane = 0
        while plane < len(self.pending):
            words = np.concatenate(self.pending[plane] or [np.zeros(0, np.uint32)])
            while len(words) > 1:
                third = -(-len(words) // 3)
                a, b, c = (np.pad(words[i::3], (0, third - len(words[i::3]))) for i in range(3))
                words, carry = a ^ b ^ c, (a & b) | (a & c) | (b & c)
                carry = carry[carry != 0]
                if len(carry):
                    self._put(plane + 1, carry)
            self.pending[plane] = [words]
            plane += 1
        self.waiting = 0

    def words(self) -> list[int]:
        self.settle()
        return [int(p[0][0]) if len(p[0]) else 0 for p in self.pending]


def _popcounts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Planes per part and kind of label from rows (part, good, toxic, failures, times)."""
    table = survival_words(np.arange(SUBSETS))
    held: dict[tuple[str, str], Planes] = {}

    def passed_on() -> pd.DataFrame:
        rows = [(p, k, j, w) for (p, k), planes in held.items() for j, w in enumerate(planes.words())]
        held.clear()
        return pd.DataFrame(rows, columns=["part", "kind", "plane", "word"]).astype({"plane": "int32", "word": "int64"})

    for frame in frames:
        for part, rows in frame.groupby("part", sort=False):
            words, times = table[rows["failures"].to_numpy()], rows["times"].to_numpy()
            for kind in KINDS:
                chosen = np.ones(len(rows), dtype=bool) if kind == "all" else rows[kind].to_numpy(dtype=bool)
                held.setdefault((part, kind), Planes()).add(words[chosen], times[chosen])
        if len(held) > OPEN_PARTS:
            yield passed_on()
    yield passed_on()


def counted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, failures, times): documents by what they fail, copies of a text as numbers of rows."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"),
        text_failures(text).alias("failures"),
    )
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    group = ["digest", "part", "good", "toxic", "failures"]
    known = narrow.where(F.col("id").isNotNull()).join(marks, "id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}
    )
    # rows of one id are counted where the join has put them; then copies meet as few rows per task
    of_id = known.groupBy("id", *group).agg(F.count(F.lit(1)).alias("n"))
    copies = of_id.groupBy(*group).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    everywhere = Window.partitionBy("digest")  # few rows: parts times kinds of labels
    placed = copies.withColumn("smallest", F.min("first.id").over(everywhere)).withColumn(
        "originals", F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(F.lit(0))
    )
    nameless = narrow.where(F.col("id").isNull()).groupBy("part", "failures").agg(F.count(F.lit(1)).alias("times"))
    fails_e = F.lit(1 << FILTERS.index("E"))
    sides = F.array(
        F.struct(F.col("failures").alias("failures"), F.col("originals").alias("times")),
        F.struct((F.col("failures") + fails_e).alias("failures"), (F.col("n") - F.col("originals")).alias("times")),
    )
    split = placed.select("part", "good", "toxic", F.inline(sides)).where("times > 0")
    off = F.lit(False)
    return split.unionByName(nameless.withColumns({"good": off, "toxic": off})).select(
        "part", "good", "toxic", F.col("failures").cast("int").alias("failures"), F.col("times").cast("long").alias("times")
    )


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, all, good, toxic): per part three arrays with the survivors of each of the 32 subsets."""
    schema = "part string, kind string, plane int, word long"
    planes = counted_texts(docs, labels).mapInPandas(_popcounts, schema)
    place = [f"sum(shiftleft(shiftright(word, {s}) & 1L, plane)) FILTER (WHERE kind = '%s')" for s in range(SUBSETS)]
    counts = [F.array(*[F.coalesce(F.expr(p % kind), F.lit(0)) for p in place]).alias(kind) for kind in KINDS]
    return planes.groupBy("part").agg(*counts)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step; see the column list of ``select`` below.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fails the filter, gone before), ``unique_fails``
    (fails this filter only), ``good_lost``, ``toxic_lost``, and ``shapley``, the filter's removals summed over all orders.
    """
    full = SUBSETS - 1

    def at(name: str, subset: Column) -> Column:
        return F.get(name, subset.cast("int"))

    # removals of filter i summed over the orders: |S|! (4 - |S|)! orders put exactly S before it
    weights = [24, 6, 4, 6, 24]
    shares = []
    for i in range(len(FILTERS)):
        without = [s for s in range(SUBSETS) if not s >> i & 1]
        shares.append(sum(
            (F.get("all", F.lit(s)) - F.get("all", F.lit(s | 1 << i))) * weights[s.bit_count()] for s in without
        ))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = F.sequence(F.lit(1), F.lit(len(FILTERS)))
    counted = survivors(docs, labels).withColumn("shares", F.array(*shares))

    def step_of(step: Column) -> Column:
        done = F.substring("filter_order", F.lit(1), step)
        masks = [F.when(F.instr(done, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(FILTERS)]
        index = F.instr(F.lit(FILTERS), F.substring("filter_order", step, F.lit(1))) - 1
        return F.struct(step.alias("step"), index.alias("index"), sum(masks, F.lit(0)).alias("after"))

    # generated columns are computed once, while projected ones would be copied into each use
    rows = counted.withColumn("filter_order", F.explode(orders))
    rows = rows.select("*", F.inline(F.transform(steps, step_of)))
    rows = rows.withColumn("own", F.expr("shiftleft(1, index)")).withColumn("before", F.col("after") - F.col("own"))
    removed = at("all", F.col("before")) - at("all", F.col("after"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("all", F.col("after")).alias("kept"),
        removed.alias("removed"),
        (at("all", F.lit(0)) - at("all", F.col("own")) - removed).alias("redundant"),
        (at("all", full - F.col("own")) - at("all", F.lit(full))).alias("unique_fails"),
        (at("good", F.col("before")) - at("good", F.col("after"))).alias("good_lost"),
        (at("toxic", F.col("before")) - at("toxic", F.col("after"))).alias("toxic_lost"),
        F.get("shares", F.col("index")).alias("shapley"),
    )
