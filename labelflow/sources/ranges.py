"""Scans of one large file by many tasks, for records that may hold their own separator.

The text source cuts a file into byte ranges and hands out the pieces between separators, each piece to one task.
Whether a piece ends a record depends on all that stands before it in the file: a line break inside quotes does
not end a CSV record, a closing tag inside a comment does not end an XML row. A small automaton says so. Its start
state in a range is found without reading the file in order: every task works out which state each possible start
state leads to (a map of a few entries per range), and the maps are composed over the ranges of a file. Knowing its
start state, a task cuts its range into records; the parts of a record that crosses a range border are put
together afterwards.

The composed states go to the tasks: a few bytes per range that does not start in state 0, which is less than what
Spark itself keeps per range to plan the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# state after a piece, given the state before it; 0 means that a record ends where the piece ends
Advance = Callable[[str, int], int]

QUOTED_REST = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def csv_advance(line: str, inside: int) -> int:
    """1 if the line ends inside a quoted field. Quotes are doubled inside quotes; elsewhere they only open a field."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            closing = QUOTED_REST.match(line, at)
            if not closing:
                return 1
            at, inside = closing.end(), 0
        elif line.startswith('"', at):
            at, inside = at + 1, 1
            continue
        at = line.find(",", at) + 1
        if not at:
            return 0


XML_OPENERS = {1: "<!--", 2: "<![CDATA["}
XML_CLOSERS = {1: "-->", 2: "]]>"}


def xml_advance(piece: str, state: int) -> int:
    """1 inside a comment, 2 inside a CDATA section, at the end of the piece."""
    at = 0
    while True:
        if state:
            at = piece.find(XML_CLOSERS[state], at)
            if at < 0:
                return state
            at, state = at + 3, 0
        found = [(p, s) for s, opener in XML_OPENERS.items() if (p := piece.find(opener, at)) >= 0]
        if not found:
            return 0
        at, state = min(found)
        at += len(XML_OPENERS[state])


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """((file, block), pieces) in scan order; a range that spans batches comes in several parts."""
    for batch in batches:
        keys = zip(batch.column("file").to_pylist(), batch.column("block").to_pylist())
        values = batch.column("value").to_pylist()
        for key, part in groupby(zip(keys, values), key=lambda kv: kv[0]):
            yield key, [value for _, value in part]


def _start_states(pieces: DataFrame, advance: Advance, states: int) -> dict[tuple[str, int], tuple[int, int]]:
    """(state, pieces) of every range that does not start in state 0, and (0, pieces) of the others."""
    schema = "file string, block long, n long, ends array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, current, n, ends = [], None, 0, []
        for key, values in _by_range(batches):
            if key != current:
                if current:
                    rows.append((*current, n, ends))
                current, n, ends = key, 0, list(range(states))
            n += len(values)
            for value in values:
                ends = [advance(value, s) for s in ends]
        if current:
            rows.append((*current, n, ends))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "n", "ends"])

    found, state, file = {}, 0, None
    # one small row per range, as many as the scan itself has in its plan
    for r in pieces.mapInArrow(run, schema).orderBy("file", "block").toLocalIterator():
        state = state if r["file"] == file else 0
        file = r["file"]
        found[file, r["block"]] = (state, r["n"])
        state = r["ends"][state]
    return found


def read_records(spark: SparkSession, path: str, separator: str, advance: Advance, states: int) -> DataFrame:
    """(file, block, seq, text): the records of all files below ``path``, read by as many tasks as ranges.

    (file, block, seq) is the order of the records. Records without any text are left out. ``text`` lacks the
    separator that ends the record. Runs one job that reads the files for the states, then scans when asked.
    """
    pieces = _pieces(spark, path, separator)
    known = spark.sparkContext.broadcast(_start_states(pieces, advance, states))
    schema = "file string, block long, seq long, kind int, text string"
    whole, opening, middle, closing = range(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seq, state, held, begun, seen, expected = None, 0, 0, [], True, 0, 0
        rows: list[tuple] = []

        def finish() -> None:
            if current and seen != expected:
                raise RuntimeError(f"the ranges of {current[0]} changed between passes; set spark.sql.files.minPartitionNum")
            if held:
                rows.append((*current, seq, opening if begun else middle, separator.join(held)))

        for key, values in _by_range(batches):
            if key != current:
                finish()
                current, seq, held, seen = key, 0, [], 0
                state, expected = known.value.get(key, (0, -1))
                begun = state == 0
            seen += len(values)
            for value in values:
                state = advance(value, state)
                held.append(value)
                if state == 0:
                    text = separator.join(held)
                    if not begun or text.strip("\r"):
                        rows.append((*current, seq, whole if begun else closing, text))
                        seq += 1
                    held, begun = [], True
            if len(rows) >= 1024:
                yield _batch(rows)
                rows = []
        finish()
        yield _batch(rows)

    found = pieces.mapInArrow(run, schema)
    complete = found.where(F.col("kind") == whole).select("file", "block", "seq", "text")
    if all(state == 0 for state, _ in known.value.values()):
        return complete.unionByName(_last_open(found, opening))
    # parts of records that cross borders: at most two per range
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == opening)
    begins = F.when(F.col("kind") == opening, F.struct("block", "seq"))
    parts = found.where(F.col("kind") != whole).withColumn("first", F.last(begins, ignorenulls=True).over(order))
    joined = parts.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("parts"))
    crossing = joined.select(
        "file", "first.block", "first.seq", F.array_join(F.transform("parts", lambda p: p["text"]), separator).alias("text")
    )
    return complete.unionByName(crossing)


def _last_open(found: DataFrame, opening: int) -> DataFrame:
    """Records that are still open where their file ends."""
    return found.where(F.col("kind") == opening).select("file", "block", "seq", "text")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "seq", "kind", "text"]
    )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files with doubled quotes, headers left out; lines end with LF or CR LF."""
    rows = read_records(spark, path, "\n", csv_advance, 2)
    body = ~((F.col("block") == 0) & (F.col("seq") == 0))
    return rows.where(body).withColumn("text", F.regexp_replace("text", r"\r$", ""))


def xml_rows(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """(file, block, seq, pos, text): every ``row_tag`` element that is not commented out; elements do not nest."""
    closing = f"</{row_tag}>"
    pieces = read_records(spark, path, closing, xml_advance, 3)
    # a piece holds empty elements, then perhaps the start of the one that its separator closes
    bare = F.regexp_replace("text", r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->", "$1")
    opener = rf"<{row_tag}(?:\s(?:[^<>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*)?"
    elements = F.regexp_extract_all(bare, F.lit(rf"(?s){opener}/>|{opener}>.*"), 0)
    rows = pieces.select("file", "block", "seq", F.posexplode(elements).alias("pos", "text"))
    whole = F.when(F.col("text").endswith("/>") & ~F.col("text").rlike(rf"(?s)^{opener}>"), F.col("text"))
    return rows.withColumn("text", F.coalesce(whole, F.concat("text", F.lit(closing))))


def range_order(*extra: Column | str, rank: int = 0) -> Column:
    """Order column of scanned records: (input rank, file, block, seq, ..)."""
    return F.struct(F.lit(rank).alias("rank"), "file", "block", "seq", *extra)
