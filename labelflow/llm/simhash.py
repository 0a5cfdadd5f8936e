"""SimHash near-duplicates: pigeonhole blocks join close fingerprints, Hamming distance verifies them.

A fingerprint of 64 bits is cut into five blocks. Two fingerprints that differ in at most three bits agree
in at least two whole blocks, so each distinct fingerprint goes to one bucket per pair of blocks and every
close pair meets in some bucket. Copies of a text share a fingerprint and enter as one row.

A bucket is searched as a graph: from a fingerprint to all unvisited ones within the distance, and on from
those. It yields a spanning forest, at most one edge per fingerprint, which has the same components as all
close pairs. A bucket of more than ``bucket_rows`` fingerprints is cut into chunks by a hash, and each pair
of its chunks is searched on its own, so memory is bounded and no link is lost.

:func:`keep_first` also links texts whose word-shingle sets are similar: 64-bit fingerprints of such texts may be too
far apart for blocks, so :mod:`labelflow.llm.setblocks` cuts the sets themselves into pigeonhole blocks.

Null texts count as empty. Texts without words have fingerprint zero and link like any other. Rows without a
doc_id take part and get the smallest id of their component, null if it has none. Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.graph import components
from labelflow.llm.rows import row_identity
from labelflow.llm.setblocks import SIMILARITY, similar_links
from labelflow.session import materialize

SHINGLE = 3
DISTANCE = 3
BLOCKS = (0, 13, 26, 39, 52, 64)
SHARED = len(BLOCKS) - 1 - DISTANCE
BUCKET_ROWS = 8192
SLICE = 1 << 16

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the XXH64 values (seed 42) of the text's word shingles."""
    from xxhash import xxh64_digest

    words = (text or "").encode().translate(LOWER).split()  # bytes.split() parts at 09-0D and 20
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[:-1]).tolist()]
    ends = (ends - 1).tolist()
    n = max(1, len(words) - size + 1)
    set_bits = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        last = ends[lo + size - 1 : hi + size - 1] if len(words) >= size else ends[-1:]
        digests = b"".join([xxh64_digest(whole[s:e], 42) for s, e in zip(starts[lo:hi], last)])
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8)).reshape(-1, 64)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The columns of rows without ``text``, and ``fp``: the 64 bits as a signed long."""
    others = [c for c in rows.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(t.as_py(), size) for t in batch.column("text")], dtype=np.uint64)
            columns = {c: batch.column(c) for c in others}
            yield pa.RecordBatch.from_pydict(columns | {"fp": pa.array(found.view(np.int64), pa.int64())})

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in others) + ", fp long"
    return rows.mapInArrow(work, schema)


def _keys(fp: str):
    """One key per pair of blocks: its number and the bits of both."""
    keys = []
    for number, pair in enumerate(combinations(range(len(BLOCKS) - 1), SHARED)):
        mask = sum(((1 << (BLOCKS[i + 1] - BLOCKS[i])) - 1) << BLOCKS[i] for i in pair)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(number), F.col(fp).bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest, as index pairs, of the graph of fingerprints within the distance."""
    edges: list[tuple[int, int]] = []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            here = todo.pop()
            close = np.bitwise_count(fps[rest] ^ fps[here]) <= distance
            if close.any():
                found = rest[close].tolist()
                rest = rest[~close]
                edges += [(here, x) for x in found]
                todo += found
    return edges


def _search(distance: int):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; the last bucket of a batch may go on in the next."""
        left = None
        for frame in frames:
            key, fp = frame["bucket"].to_numpy(), frame["fp"].to_numpy()
            if left is not None:
                key, fp = np.concatenate([left[0], key]), np.concatenate([left[1], fp])
            if not len(key):
                continue
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            tail = int(cuts[-1]) if len(cuts) else 0
            left = key[tail:], fp[tail:]
            yield _edges(fp, [0, *cuts.tolist()], distance)
        if left is not None:
            yield _edges(left[1], [0, len(left[1])], distance)

    return work


def _edges(fp: np.ndarray, bounds: list[int], distance: int) -> pd.DataFrame:
    """Edges within each stretch between neighbouring bounds."""
    bits = fp.view(np.uint64)
    a, b = [], []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo > 1:
            for x, y in forest(bits[lo:hi], distance):
                a.append(fp[lo + x])
                b.append(fp[lo + y])
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def close_links(distinct: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect what pairs within the distance connect."""
    rows = materialize(distinct.select("fp", F.explode(_keys("fp")).alias("bucket")), "buckets")
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    large = materialize(large.select("bucket", F.ceil(F.col("n") / bucket_rows).cast("int").alias("chunks")), "large")
    if not large.isEmpty():
        marked = rows.join(large, "bucket", "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
        other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(None).cast("int")))
                          .otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
        spread = marked.select("fp", "bucket", mine.alias("mine"), other.alias("other"))
        rows = spread.select(
            "fp",
            F.when(F.col("other").isNull(), F.col("bucket"))
            .otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
            .alias("bucket"),
        )
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "fp").mapInPandas(_search(distance), "a long, b long")


def _groups(found: DataFrame, distance: int, bucket_rows: int, links: DataFrame | None = None) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of (doc_id, fp) rows; ``links`` are further edges (a, b)."""
    copies = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "copies")
    edges = close_links(copies, distance, bucket_rows)
    roots = components(edges if links is None else edges.unionByName(links)).withColumnRenamed("node", "fp")
    member = materialize(copies.join(roots, "fp").select("fp", "root", "least"), "member")
    smallest = materialize(member.groupBy("root").agg(F.min("least").alias("first")), "smallest")
    linked = materialize(member.join(smallest, "root").select("fp", "root", "first"), "linked")
    return materialize(
        copies.join(linked, "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("first", "least").alias("component_id")
        ),
        "groups",
    )


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    found = materialize(fingerprints(docs.select("doc_id", "text"), size), "fingerprints")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(_groups(found, distance, bucket_rows), "fp").select(
        "doc_id", digits.alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE,
               bucket_rows: int = BUCKET_ROWS, similarity: float | None = SIMILARITY) -> DataFrame:
    """One row of each component, with the columns of docs: the one of the smallest doc_id (none counts as
    largest), among those of one doc_id the one of the smallest hash of all its columns.

    Texts whose 5-word shingle sets have a Jaccard similarity of ``similarity`` or more are linked too (None: only
    close fingerprints are).
    """
    own = row_identity(docs)
    found = fingerprints(docs.select("doc_id", "text", own.alias("row_hash")), size)
    found = materialize(found, "fingerprints")
    links = None if similarity is None else similar_links(docs, lambda text: fingerprint_of(text, size), similarity)
    placed = found.join(_groups(found, distance, bucket_rows, links), "fp")
    counted = placed.groupBy("root", "doc_id", "row_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "n")
    first = counted.groupBy("root").agg(F.min(order).alias("w"))
    first = materialize(first.select(F.col("w.row_hash").alias("row_hash"), F.col("w.n").alias("n")), "first")
    row = F.struct(*docs.columns)
    kept = docs.select(row.alias("row"), own.alias("row_hash")).join(first.hint("merge"), "row_hash")
    once = kept.where("n = 1").select("row.*")
    return once.unionByName(kept.where("n > 1").dropDuplicates(["row_hash"]).select("row.*"))
