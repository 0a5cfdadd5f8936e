"""Pigeonhole blocks over word-shingle sets: every pair of texts with a Jaccard similarity of 0.8 or more.

The set of a text's 5-word shingles (A-Z lower-cased, words between spaces and tabs) is a sparse fingerprint: one
bit per possible shingle. Two sets of at most ``u`` shingles with a similarity of ``s`` differ in at most
``K = 2u(1-s)/(1+s)`` bits. A hash deals the bits to ``K + 1 + e`` blocks, so at least ``1 + e`` blocks are equal, and
texts that share the key of a block are compared exactly. Sizes fall into classes of ratio ``1/s``; a text takes part in
its own class and the next, so similar texts always meet in one of them.

Empty blocks have no key. If two similar sets share no filled block, both have more than ``e`` empty ones; a set with
that many also gives the shingles of its prefix (the smallest ``n - ceil(s n) + 1`` by hash) as keys, and similar sets
share one of those. So no pair is lost.

Pairs are ruled out by their sizes and by parity sketches (the sketches of two sets differ in no more bits than the
sets): a short one inside the buckets, then one of a bit or two per shingle, so that few dissimilar pairs are left. Only
the texts of those are sent as sets of 64-bit hashes and compared exactly.

Keys are matched in four passes. First each text is compared with one of the texts that are the smallest of its
buckets; what is similar is one group from then on, however many near copies it holds. In a few rounds each text of a
bucket that still holds several groups is compared with the next ``REACH`` ones of other groups, in an order of the bucket's
and the round's own, so the pairs grow with the rows and large groups of near copies meet. Then, in the buckets that are
left, one pair of every two groups is compared, and at last all pairs of groups that are still apart.

Null and empty texts have an empty set and link to nothing here. Texts of one to four words are one shingle. Repeated
rows and copies enter as one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.graph import components
from labelflow.session import materialize

WORDS = 5
SIMILARITY = 0.8
CHUNK = 4096
ROWS = 256
ROUNDS = 3
REACH = 2
SKETCH = tuple(f"k{i}" for i in range(16))

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = x + np.uint64(salt * int(ODD) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()  # bytes.split() parts at 09-0D and 20


def text_id(words: list[bytes]) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b" ".join(words), 7)


def shingle_set(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``size`` are one shingle."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    known: dict[bytes, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxh64_intdigest(w, 42)
    each = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    n = max(1, len(each) - size + 1)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(min(size, len(each))):
        total = _mix(total + each[i : i + n], i + 1)
    return np.unique(total)


def size_class(n: int, s: float) -> int:
    """Largest c with s**-c <= n: sizes whose ratio is at least s are in one class or in neighbouring ones."""
    c = floor(log(n) / -log(s))
    while s ** -(c + 1) <= n:
        c += 1
    while s**-c > n:
        c -= 1
    return c


def block_keys(shingles: np.ndarray, s: float = SIMILARITY) -> np.ndarray:
    """Distinct keys of the filled blocks in both classes, and of the prefix where too many blocks are empty."""
    n = len(shingles)
    if not n:
        return shingles
    own, parts, sparse = size_class(n, s), [], False
    for c in (own, own + 1):
        largest = floor(s ** -(c + 1) + 1e-9)
        most = floor(2 * largest * (1 - s) / (1 + s) + 1e-9)
        spare = 2 + most // 8
        blocks = most + 1 + spare
        block = _mix(shingles, 2 * c + 1) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        block = block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        sums = np.add.reduceat(_mix(shingles, 3)[order], starts)
        parts.append(_mix(sums + block[starts] * ODD, 2 * c + 2))
        sparse |= blocks - len(starts) > spare
    if sparse:
        parts.append(_mix(shingles[: n - ceil(s * n - 1e-9) + 1], 1 << 40))
    return np.unique(np.concatenate(parts))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """``SKETCH`` 64-bit words; bit i is the parity of the number of shingles that fall on i."""
    slots = (_mix(shingles, 5) % np.uint64(64 * len(SKETCH))).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=64 * len(SKETCH)).astype(np.uint8) & 1).view(np.int64)


def wide_sketch(shingles: np.ndarray) -> np.ndarray:
    """As :func:`sketch`, of one to two bits per shingle (256 at least); a power of two, so halves fold onto each other."""
    bits = max(256, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 256
    slots = (_mix(shingles, 7) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=bits).astype(np.uint8) & 1).view(np.int64)


def _keyed(s: float, size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                words = words_of(text.as_py())
                keys = block_keys(shingle_set(words, size), s)
                if len(keys):
                    tid = np.full(len(keys), text_id(words), dtype=np.uint64)
                    yield pa.RecordBatch.from_pydict(
                        {"bucket": pa.array(keys.view(np.int64)), "tid": pa.array(tid.view(np.int64))}
                    )

    return work


def _merged(work, rows: int = 1 << 16):
    """The same record batches, small ones joined."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in work(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return merged


def _sets(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(words_of(t.as_py()), size) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({
                "tid": batch.column("tid"),
                "fp": batch.column("fp"),
                "shingles": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
            })

    return work


def _shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (bucket, tid), sorted: those of buckets with two texts or more, each once, with the bucket's smallest."""
    last: tuple | None = None  # bucket, smallest tid, last tid, whether its first row is out
    for frame in frames:
        key, tid = frame["bucket"].to_numpy(), frame["tid"].to_numpy()
        if not len(key):
            continue
        carried = last is not None
        if carried:
            key, tid = np.r_[last[0], key], np.r_[last[2], tid]
        new = np.r_[True, (key[1:] != key[:-1]) | (tid[1:] != tid[:-1])]
        key, tid = key[new], tid[new]
        first = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(first)
        lead = tid[starts][np.cumsum(first) - 1]
        out = np.ones(len(key), dtype=bool)
        sizes = np.diff(np.r_[starts, len(key)])
        out[starts[sizes == 1]] = False
        sent = False
        if carried:
            lead[: sizes[0]] = last[1]
            sent = last[3]
            if sent:
                out[0] = False
        more = pd.DataFrame({"bucket": key[out], "tid": tid[out], "lead": lead[out]})
        only = len(starts) == 1
        last = key[-1], lead[-1], tid[-1], bool(sizes[-1] > 1 or (only and sent))
        yield more


def _bits_apart(x: str, y: str):
    """Number of bits in which two wide sketches differ; the longer one is folded to the length of the shorter."""

    def folded(long: str, short: str):
        k = F.size(short)
        halves = F.zip_with(F.slice(long, F.lit(1), k), F.slice(long, k + 1, k), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(long) > k, halves).otherwise(F.col(long))

    apart = F.zip_with(folded(x, y), folded(y, x), lambda p, q: p.bitwiseXOR(q))
    return F.aggregate(apart, F.lit(0), lambda n, z: n + F.bit_count(z))


def possible(pairs: DataFrame, texts: DataFrame, s: float) -> DataFrame:
    """The distinct pairs (a, b) that the sizes and sketches of the texts allow."""
    ratio = (1 - s) / (1 + s)

    def side(name: str, *columns: str) -> DataFrame:
        return texts.select(F.col("tid").alias(name), *[F.col(k).alias(f"{k}_{name}") for k in columns])

    differ = sum(F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in SKETCH)
    most = (F.col("n_a") + F.col("n_b")) * ratio + 1e-9
    near = (F.least("n_a", "n_b") >= F.lit(s) * F.greatest("n_a", "n_b") - 1e-9) & (differ <= most)
    left = pairs.select("a", "b").distinct().join(side("a", "n", *SKETCH), "a").join(side("b", "n", *SKETCH), "b")
    left = left.where(near).select("a", "b", most.alias("most"))
    left = left.join(side("a", "wide"), "a").join(side("b", "wide"), "b")
    return left.where(_bits_apart("wide_a", "wide_b") <= F.col("most")).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, s: float, size: int = WORDS) -> DataFrame:
    """The pairs (a, b) of texts whose shingle sets have a similarity of s or more, with their fingerprints.

    Sets are made for the texts of the pairs only and travel to them in chunks of ``CHUNK`` partners, so a text with
    very many of them is not one task.
    """
    needed = materialize(pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).distinct(), "needed")
    texts = texts.select("tid", "fp", "text").join(needed, "tid", "left_semi")
    sets = materialize(texts.mapInArrow(_sets(size), "tid long, fp long, shingles array<long>"), "sets")
    degree = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    chunks = degree.select("a", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "a", "left").select(
        "a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("chunks")), F.lit(0)).cast("int").alias("chunk"))
    left = sets.select(F.col("tid").alias("a"), F.col("fp").alias("fp_a"), F.col("shingles").alias("x"))
    left = left.join(chunks, "a", "left").select(
        "a", "fp_a", "x", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
    right = sets.select(F.col("tid").alias("b"), F.col("fp").alias("fp_b"), F.col("shingles").alias("y"))
    both = dealt.join(left, ["a", "chunk"]).join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    enough = shared >= F.lit(s) * (F.size("x") + F.size("y") - shared) - 1e-9
    return both.where(enough).select("a", "b", "fp_a", "fp_b")


def _across(s: float, reach: int | None = None):
    """Pairs of different groups in each bucket; rows come sorted by bucket (and chunk of it).

    Rows at distance 1, 2, 3 ... are compared for all buckets of a batch at once; with ``reach`` each row is compared only
    with the first rows of the next ``reach`` stretches of other groups.
    """
    ratio = (1 - s) / (1 + s)

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        key, tid, root = (part[c].to_numpy() for c in ("bucket", "tid", "root"))
        n, side = part["n"].to_numpy(), part["side"].to_numpy()
        bits = part[list(SKETCH)].to_numpy().view(np.uint64)
        ends = np.r_[np.flatnonzero((key[1:] != key[:-1]) | (root[1:] != root[:-1])) + 1, len(part)]
        following = np.repeat(ends, np.diff(np.r_[0, ends]))
        at, step, a, b = np.arange(len(part)), 0, [], []
        to = at
        while reach is None or step < reach:
            step += 1
            to = to + 1 if reach is None else following[to]
            at, to = at[to < len(part)], to[to < len(part)]
            same = key[at] == key[to]
            at, to = at[same], to[same]
            if not len(at):
                break
            i, k = at, to
            ok = (root[i] != root[k]) & (np.minimum(n[i], n[k]) >= s * np.maximum(n[i], n[k]) - 1e-9)
            ok &= (side[i] != side[k]) | (side[i] < 0)
            i, k = i[ok], k[ok]
            differ = np.bitwise_count(bits[i] ^ bits[k]).sum(axis=1)
            ok = differ <= (n[i] + n[k]) * ratio + 1e-9
            a.append(np.minimum(tid[i], tid[k])[ok])
            b.append(np.maximum(tid[i], tid[k])[ok])
        empty = [np.zeros(0, dtype=np.int64)]
        return pd.DataFrame({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty)}).drop_duplicates()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for frame in frames:
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            if not len(frame):
                continue
            key = frame["bucket"].to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            tail = int(cuts[-1]) if len(cuts) else 0
            if tail:
                yield pairs(frame.iloc[:tail])
            left = frame.iloc[tail:]
        if left is not None and len(left) > 1:
            yield pairs(left)

    return work


def _open_pairs(rows: DataFrame, short: DataFrame, s: float, turn: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) of different groups in one bucket that sizes and sketches allow.

    ``rows``: (bucket, tid, root); ``short``: (tid, n and the sketch). A bucket of more than ``CHUNK`` texts is cut into
    chunks, and every chunk and pair of chunks is searched on its own. With ``turn``, the number of a round, a text meets
    the next ones of its chunk only.
    """
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("q"), F.count("*").alias("size"))
    mixed = mixed.where("r <> q").select("bucket", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    found = rows.join(mixed, "bucket").withColumn("mine", F.pmod(F.xxhash64("tid"), F.col("chunks")))
    found = found.join(short, "tid")
    if turn is None:
        spread = found.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        order = F.col("tid")
    else:
        spread = found.withColumn("other", F.col("mine"))
        order = F.xxhash64("tid", "bucket", F.lit(turn))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), -1).otherwise(F.when(F.col("mine") < F.col("other"), 0).otherwise(1))
    # A chunk enters its pair with another one as a side of its own; pairs inside a chunk come from (mine, mine).
    dealt = spread.select(F.xxhash64("bucket", low, high).alias("bucket"), "tid", "root", "n", *SKETCH,
                          side.cast("int").alias("side"), order.alias("place"))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "place").drop("place")
    pairs = dealt.mapInPandas(_across(s, None if turn is None else REACH), "a long, b long")
    return materialize(pairs.distinct(), "candidates")


def _moved(table: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """table with ``column`` replaced by its root, where it has one."""
    to = roots.select(F.col("node").alias(column), F.col("root").alias("moved"))
    return table.join(to, column, "left").withColumn(column, F.coalesce("moved", column)).drop("moved")


def similar_links(docs: DataFrame, fingerprint, s: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """Edges (a, b) between fingerprints that connect what texts with a similarity of ``s`` or more connect.

    ``fingerprint`` gives the node of a text, the same for texts of equal words.
    """

    def about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(lo, ROWS) for batch in batches for lo in range(0, batch.num_rows, ROWS)):
            columns: dict[str, list] = {k: [] for k in ("tid", "fp", "n", *SKETCH, "wide")}
            for text in part.column("text"):
                words = words_of(text.as_py())
                shingles = shingle_set(words, size)
                columns["tid"].append(text_id(words))
                columns["fp"].append(fingerprint(text.as_py()))
                columns["n"].append(len(shingles))
                for k, word in zip(SKETCH, sketch(shingles).tolist()):
                    columns[k].append(word)
                columns["wide"].append(wide_sketch(shingles))
            ids = {k: pa.array(np.array(columns.pop(k), dtype=np.uint64).view(np.int64)) for k in ("tid", "fp")}
            kinds = {"n": pa.int32(), "wide": pa.list_(pa.int64())}
            others = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()}
            yield pa.RecordBatch.from_pydict(ids | {"text": part.column("text")} | others)

    texts = docs.select("text").where("text is not null").mapInArrow(
        about, "tid long, fp long, text string, n int, " + ", ".join(f"{k} long" for k in SKETCH) + ", wide array<long>")
    texts = materialize(texts.dropDuplicates(["tid", "fp"]), "texts")
    keyed = texts.select("text").mapInArrow(_merged(_keyed(s, size)), "bucket long, tid long")
    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket")
    shared = materialize(dealt.mapInPandas(_shared, "bucket long, tid long, lead long"), "shared")

    stars = shared.where("lead <> tid").select(F.col("lead").alias("a"), F.col("tid").alias("b"))
    stars = materialize(possible(stars, texts, s).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "stars")
    links = materialize(verified(stars, texts, s, size), "links")
    roots = components(links)

    short, tried = texts.select("tid", "n", *SKETCH), stars

    def open_pairs(turn: int | None) -> DataFrame:
        rows = _moved(shared.select("bucket", "tid", F.col("tid").alias("root")), roots, "root")
        rest = _open_pairs(materialize(rows, "rows"), short, s, turn).join(tried, ["a", "b"], "left_anti")
        return materialize(possible(rest, texts, s), "possible")

    for turn in range(ROUNDS):
        few = open_pairs(turn)
        more = materialize(verified(few, texts, s, size), "links")
        if more.isEmpty():
            break
        links, tried = links.union(more), tried.union(few)
        roots = components(links)
    rest = open_pairs(None)
    ends = rest.select("a", "b", F.col("a").alias("p"), F.col("b").alias("q"))
    ends = materialize(_moved(_moved(ends, roots, "p"), roots, "q"), "ends")
    pair = F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")
    picked = ends.groupBy(*pair).agg(F.min(F.struct("a", "b")).alias("w"))
    picked = materialize(picked.select("w.*", "low", "high"), "picked")
    more = materialize(verified(picked.select("a", "b"), texts, s, size), "links")
    roots = components(picked.join(more, ["a", "b"]).select(F.col("low").alias("a"), F.col("high").alias("b")))
    ends = _moved(_moved(ends.join(picked, ["a", "b"], "left_anti"), roots, "p"), roots, "q")
    last = materialize(ends.where("p <> q").select("a", "b"), "open")
    links = links.union(more).union(materialize(verified(last, texts, s, size), "links"))
    return links.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).where("a <> b").distinct()
