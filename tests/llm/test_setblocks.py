"""Similar texts by pigeonhole blocks of shingle sets, against all pairs."""

from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
import pytest

from labelflow import session
from labelflow.llm import setblocks, simhash
from labelflow.llm.setblocks import block_keys, shingle_set, words_of


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return bool(x) and bool(y) and len(x & y) >= 0.8 * len(x | y) - 1e-12


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(999)}"
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"more{rng.randrange(999)}")
    return words


def texts(seed, groups=25):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 5, 6, 9, 14, 30, 60, 120, 300]))]
        if g % 3 == 0:
            base = base + passage
        out.append(base)
        for _ in range(rng.randrange(6)):
            out.append(edited(rng, rng.choice([base, out[-1]]), rng.randrange(1, 2 + len(base) // 30)))
    return [" ".join(x) for x in out]


def roots_of(values, linked):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 33, 60, 100, 250, 900, 3000]:
        for _ in range(60):
            whole = rng.integers(0, 2**63, size=n, dtype=np.uint64)
            # the least similar pair allowed: both sides lose shingles of the union, 20 per cent in all
            drop = int(n * 0.2 + 1e-9)
            mine = int(rng.integers(0, drop + 1))
            a, b = np.unique(whole[mine:]), np.unique(np.r_[whole[:mine], whole[drop:]])
            if not len(a) or not len(b):
                continue
            both = len(np.intersect1d(a, b))
            if both >= 0.8 * (len(a) + len(b) - both):
                assert len(np.intersect1d(block_keys(a), block_keys(b))), (n, mine)


def test_sets_are_word_shingles():
    for text in ["", "One", "a b c d", "a b c d e", "A b\tc d e f a b c d e", "ö x   y z w v"]:
        # only A-Z are folded and only spaces, tabs and line ends part words
        words = words_of(text)
        plain = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(shingle_set(words)) == len(plain)
    assert list(shingle_set(words_of("A B c"))) == list(shingle_set(words_of("a  b C")))


@pytest.mark.parametrize("seed,chunk", [(1, 4096), (2, 4096), (3, 3)])
def test_kept_rows_equal_all_pairs(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(setblocks, "CHUNK", chunk)
    values = texts(seed) + ["", "Same words here", "same WORDS here"]
    rows = [(i, t, i % 3) for i, t in enumerate(values)] + [(len(values), None, None), (3, values[3], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tid int").repartition(4)
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}

    def linked(a, b):
        bits = simhash.fingerprint_of(a) ^ simhash.fingerprint_of(b)
        return bits.bit_count() <= 3 or similar(a, b)

    # the null text is linked like the empty one
    assert kept == set(roots_of([*values, None], linked))


def test_large_group_of_near_copies_and_a_shared_passage(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    passage = [f"p{i}" for i in range(60)]
    near = [" ".join(edited(rng, base, 2)) for _ in range(120)]
    sharing = [" ".join([f"x{rng.randrange(10**6)}" for _ in range(70)] + passage) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(near + sharing)), "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert kept == set(roots_of(near + sharing, similar))
    assert set(range(120, 240)) <= kept


def test_wide_sketches_differ_in_no_more_bits_than_the_sets(spark):
    rng = np.random.default_rng(3)
    rows, apart = [], {}
    for k, (n, lost, more) in enumerate([(1, 0, 0), (40, 4, 3), (500, 20, 30), (520, 30, 10), (900, 0, 300), (3000, 200, 200)]):
        a = rng.integers(0, 2**63, size=n, dtype=np.uint64)
        b = np.r_[a[lost:], rng.integers(0, 2**63, size=more, dtype=np.uint64)]
        apart[k] = lost + more
        rows.append((k, setblocks.wide_sketch(a).tolist(), setblocks.wide_sketch(b).tolist()))
    found = spark.createDataFrame(rows, "k int, x array<long>, y array<long>")
    for r in found.select("k", setblocks._bits_apart("x", "y").alias("n"), setblocks._bits_apart("y", "x").alias("m")).collect():
        assert r.n == r.m and 0.5 * apart[r.k] <= r.n <= apart[r.k]


def test_sets_are_sent_for_few_pairs_that_are_not_similar(spark, monkeypatch):
    """Long texts that share 200 words of 450: too many bits for a short sketch, ruled out before sets are sent."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(200)]
    values = [" ".join([f"x{rng.randrange(10**6)}" for _ in range(250)] + passage) for _ in range(30)]
    near = [" ".join(edited(rng, [f"w{i}" for i in range(300)], 3)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(values + near)), "doc_id long, text string").repartition(3)
    sent, plain = [], setblocks.verified
    monkeypatch.setattr(setblocks, "verified", lambda pairs, *rest: sent.append(pairs.count()) or plain(pairs, *rest))
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert kept == set(roots_of(values + near, similar)) and sum(sent) < 60


def test_few_pairs_of_long_texts_that_share_a_passage_leave_the_buckets(spark, monkeypatch):
    """60 texts of 700 words share 400: every pair meets in buckets, and 256 bits of 700 shingles rule none out."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(400)]
    values = [" ".join([f"x{rng.randrange(10**6)}" for _ in range(300)] + passage) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(3)
    left, plain = [], setblocks.possible
    monkeypatch.setattr(setblocks, "possible", lambda pairs, *rest: left.append(pairs.distinct().count()) or plain(pairs, *rest))
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert kept == set(range(60)) and sum(left[1:]) < 200


def test_rounds_compare_a_text_with_the_next_of_other_groups():
    part = pd.DataFrame({"bucket": [1] * 6 + [2] * 2, "tid": range(8), "root": [0, 0, 2, 0, 0, 5, 6, 7], "n": 1, "side": -1}
                        | {k: 0 for k in setblocks.SKETCH})
    pairs = lambda reach: {(r.a, r.b) for f in setblocks._across(0.8, reach)(iter([part])) for r in f.itertuples()}
    every = {(0, 2), (1, 2), (2, 3), (2, 4), (0, 5), (1, 5), (2, 5), (3, 5), (4, 5), (6, 7)}
    assert pairs(None) == every
    assert pairs(1) == {(0, 2), (1, 2), (2, 3), (3, 5), (4, 5), (6, 7)}
    assert pairs(3) == every - {(2, 4)}  # 4 is not the first of its stretch


def test_shuffle_files_go_with_the_write(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in found.split("\n") if "/shuffle_" in x}

    key, before = session.SHUFFLE_CLEANUP, files()
    setting = spark.conf.get(key, None)
    table = session.materialize(spark.range(1000).repartition(3, "id").groupBy("id").count(), "table")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and table.count() == 1000 and spark.conf.get(key, None) == setting


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert simhash.keep_first(docs).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_first(blank).collect()] == [1]
