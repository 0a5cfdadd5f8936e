import hashlib
import math

import pytest
from pyspark.sql import functions as F

from labelflow.functions import labels as L
from labelflow.operators import sampling as sp

T = "sentence_id string, sentiment string, split string"


def split_counts(df, *cols):
    return {tuple(r[:-1]): r["count"] for r in df.groupBy(*cols).count().collect()}


def labelled(frame, spec, split="train"):
    rows, n = [], 0
    for label, k in spec.items():
        for _ in range(k):
            rows.append((str(n), label, split))
            n += 1
    return rows


def test_published_allotment():
    counts = {"positive": 1698, "negative": 744, "neutral": 590}
    assert sp.validation_counts(counts, 0.1) == {"positive": 170, "negative": 75, "neutral": 59}


def test_published_allotment_on_rows(frame):
    df = frame(T, *labelled(frame, {"positive": 1698, "negative": 744, "neutral": 590}))
    got = split_counts(sp.stratified_split(df, "sentiment", 0.1), "split", "sentiment")
    assert got == {
        ("train", "positive"): 1528, ("train", "negative"): 669, ("train", "neutral"): 531,
        ("val", "positive"): 170, ("val", "negative"): 75, ("val", "neutral"): 59,
    }


def test_split_takes_lowest_keys(frame):
    df = frame(T, *labelled(frame, {"a": 40, "b": 10}))
    out = sp.stratified_split(df, "sentiment", 0.2, seed=7)
    got = {r["sentence_id"] for r in out.filter("split = 'val'").collect()}
    want = set()
    for label, n in (("a", 8), ("b", 2)):
        ids = [r["sentence_id"] for r in df.filter(F.col("sentiment") == label).collect()]
        ids.sort(key=lambda i: (hashlib.md5(f"7|{i}".encode()).hexdigest(), i))
        want |= set(ids[:n])
    assert got == want


def test_split_other_rows_unchanged(frame):
    rows = labelled(frame, {"positive": 10}) + [(f"t{i}", "negative", "test") for i in range(5)] + [("n", "negative", None)]
    out = sp.stratified_split(frame(T, *rows), "sentiment", 0.2)
    assert split_counts(out, "split") == {("train",): 8, ("val",): 2, ("test",): 5, (None,): 1}


def test_split_small_inputs(frame):
    one = frame(T, ("1", "positive", "train"), ("2", "positive", "test"))
    assert split_counts(sp.stratified_split(one, "sentiment", 0.5), "split") == {("train",): 1, ("test",): 1}
    with pytest.raises(ValueError, match="cannot stratify"):
        sp.stratified_split(frame(T, *labelled(frame, {"p": 4, "n": 1})), "sentiment", 0.5)
    with pytest.raises(ValueError, match="cannot stratify"):
        sp.stratified_split(frame(T, *labelled(frame, {"p": 4, "n": 4, "u": 4})), "sentiment", 0.1)
    with pytest.raises(ValueError, match="cannot stratify"):
        sp.stratified_split(frame(T, *labelled(frame, {"p": 4, "n": 4, "u": 4})), "sentiment", 0.95)
    with pytest.raises(ValueError, match="ratio"):
        sp.stratified_split(one, "sentiment", 1.0)


def test_split_every_class_present(frame):
    df = frame(T, *labelled(frame, {"pos": 5, "neg": 3, "neu": 2}))
    got = split_counts(sp.stratified_split(df, "sentiment", 0.25).filter("split = 'val'"), "sentiment")
    assert set(got) == {("pos",), ("neg",), ("neu",)} and sum(got.values()) == 3


def test_split_missing_class_is_a_class(frame):
    df = frame(T, *labelled(frame, {"a": 10, None: 10}))
    got = split_counts(sp.stratified_split(df, "sentiment", 0.2), "split", "sentiment")
    assert got == {("train", "a"): 8, ("val", "a"): 2, ("train", None): 8, ("val", None): 2}


def test_train_test_by_language_and_label(frame):
    rows = [(f"{a}{b}{i}", f"{a}__{b}", "x") for a in ("en", "vi") for b in ("p", "n", "u") for i in range(10)]
    out = sp.train_test_split(frame(T, *rows), "sentiment", "sentence_id")
    assert split_counts(out, "split") == {("train",): 54, ("test",): 6}
    assert set(split_counts(out.filter("split = 'test'"), "sentiment").values()) == {1}


def test_capped_sample(frame):
    rows = [(str(i), ["en", "vi", None][i % 3] if i > 4 else "fr", "x") for i in range(65)]
    out = sp.sample_per_group(frame(T, *rows), "sentiment", 15)
    assert split_counts(out, "sentiment") == {("en",): 15, ("vi",): 15, ("fr",): 5}
    assert sp.sample_rows(frame(T, *rows), 7, "sentence_id").count() == 7
    assert sp.sample_rows(frame(T, *rows), 700, "sentence_id").count() == 65


def test_boundary_range_is_exact(spark):
    """Every quota from nothing to everything gives exactly that many rows, also inside one key range."""
    df = spark.range(40).select(F.col("id").cast("string").alias("sentence_id"))
    for quota in (0, 1, 2, 20, 39, 40, 41):
        got = sp.take_quota(df, F.lit("all"), {"all": quota}, "sentence_id")
        assert got.count() == min(quota, 40)


def test_many_strata_use_a_table(spark):
    df = spark.range(400).select(
        F.col("id").cast("string").alias("sentence_id"), (F.col("id") % 40).cast("string").alias("s")
    )
    got = split_counts(sp.sample_per_group(df, "s", 3), "s")
    assert got == {(str(i),): 3 for i in range(40)}


def test_any_number_of_strata(spark):
    """One stratum per row or per three rows, more than a driver-made list would be sensible for."""
    df = spark.range(36_000).select(F.col("id").cast("string").alias("sentence_id"), (F.col("id") % 12_000).alias("s"))
    got = sp.sample_per_group(df, "s", 2).groupBy("s").count()
    assert got.count() == 12_000 and got.where("count <> 2").isEmpty()


def test_allotment_as_a_table(spark):
    counts = {"a": 33, "b": 33, "c": 33, None: 17, "d": 2}
    table = spark.createDataFrame(list(counts.items()), "s string, n long")
    for ratio in (0.1, 0.25, 0.5, 0.9):
        got = {r["s"]: r["quota"] for r in sp.held_counts(table, ratio).collect()}
        assert got == sp.validation_counts(counts, ratio)


def test_width_of_ranges_makes_no_difference(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("sentence_id"))
    runs = [
        {r[0] for r in sp.mark_quota(df, F.lit("all"), {"all": 77}, "sentence_id", 1, digits=d).where("taken").collect()}
        for d in (1, 3, 5)
    ]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 77


def test_first_rows(frame):
    df = frame("v string", *[(str(i),) for i in range(20)])
    got = [(r["row"], r["v"]) for r in sp.first_rows(df, 3).orderBy("row").collect()]
    assert got == [(1, "0"), (2, "1"), (3, "2")]


def test_mix_tasks(frame):
    a = frame("id string", *[(f"a{i}",) for i in range(50)])
    b = frame("id string", *[(f"b{i}",) for i in range(10)])
    assert sp.mix_tasks(a, b, "id").count() == 40
    assert sp.mix_tasks(b, a, "id").count() == 60


O = "id string, label int"


def test_oversample_published_counts(frame):
    labels = [2] * 500 + [0] * 460 + [1] * 40
    df = frame(O, *[(str(i), x) for i, x in enumerate(labels)])
    out = sp.oversample(df, "label", "id", 0.15)
    assert out.columns == df.columns
    assert split_counts(out, "label") == {(2,): 500, (0,): 460, (1,): 40 + int(110 / 0.85)}
    assert split_counts(out.filter("label <> 1").distinct(), "label") == {(2,): 500, (0,): 460}
    again = sp.oversample(df.repartition(5), "label", "id", 0.15)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(out) == key(again)


def test_oversample_one_row_class(frame):
    df = frame(O, *[(str(i), 0) for i in range(99)], ("x", 1))
    out = sp.oversample(df, "label", "id", 0.3, shuffle=True)
    assert split_counts(out, "label") == {(0,): 99, (1,): 1 + int((0.3 * 100 - 1) / 0.7)}


def test_oversample_unchanged(frame):
    even = frame(O, *[(str(i), i % 2) for i in range(10)])
    assert sp.oversample(even, "label", "id").count() == 10
    assert sp.oversample(even.limit(0), "label", "id").count() == 0
    assert sp.oversample(even, "other", "id") is even
    single = frame(O, ("a", 1), ("b", 1))
    assert sp.oversample(single, "label", "id").count() == 2


def test_oversample_drops_unlabelled_but_counts_them(frame):
    df = frame(O, *[(str(i), 0) for i in range(80)], *[(f"m{i}", 1) for i in range(10)], *[(f"n{i}", None) for i in range(10)])
    out = sp.oversample(df, "label", "id", 0.2)
    assert split_counts(out, "label") == {(0,): 80, (1,): 10 + int((0.2 * 100 - 10) / 0.8)}


def test_class_rank(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("i"), (F.col("id") % 2).cast("string").alias("c"))
    got = [(r["c"], r["rank"], r["i"]) for r in sp.class_rank(df, "c", "i", 3).collect()]
    for c in "01":
        ids = [str(i) for i in range(300) if str(i % 2) == c]
        ids.sort(key=lambda i: (hashlib.md5(f"3|{i}".encode()).hexdigest(), i))
        assert sorted((r, i) for k, r, i in got if k == c) == list(enumerate(ids, 1))


def test_encode_lists_bad_labels(frame):
    df = frame("label string", ("positive",), ("mixed",), ("bad",), ("mixed",))
    with pytest.raises(ValueError, match="labels outside the task: bad, mixed"):
        L.encode(df, "label", ("negative", "neutral", "positive"))
    ok = L.encode(df.limit(1), "label", ("negative", "neutral", "positive"))
    assert [r["label"] for r in ok.collect()] == [2]


def test_ceil_uses_double_arithmetic():
    assert sum(sp.validation_counts({"a": 30, "b": 70}, 0.07).values()) == math.ceil(0.07 * 100)


@pytest.mark.parametrize("ids", [[None] * 100, ["None"] * 100, ["a"] * 60 + [None] * 40])
def test_quotas_are_exact_for_repeated_and_missing_ids(spark, ids):
    rows = [(i, f"text {n // 2}", "train") for n, i in enumerate(ids)]  # pairs of rows are equal in all columns
    df = spark.createDataFrame(rows, "sentence_id string, text string, split string")
    split = sp.stratified_split(df, None, 0.1)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 90, "val": 10}
    for n in (0, 1, 7, 99, 100, 200):
        assert sp.sample_rows(df, n, "sentence_id").count() == min(n, 100)
    assert sp.sample_per_group(df, "split", 20).count() == 20
    assert sp.mix_tasks(df, df.limit(3), "sentence_id").count() == 12


@pytest.mark.parametrize("id_of", [lambda i: "same", lambda i: None, lambda i: str(i % 3)])
def test_draws_do_not_depend_on_partitioning(spark, id_of):
    """Repeated and missing ids: rows are told apart by content, missing values included."""
    rows = [(id_of(i), f"t{i}" if i % 4 else None, None if i % 4 else f"t{i}", "a" if i % 7 else "b") for i in range(70)]
    df = spark.createDataFrame(rows, "sentence_id string, text string, other string, label string")
    seen = []
    for parts in (1, 3, 7):
        dealt = df.repartition(parts, "text")
        copies = sp.oversample(dealt, "label", "sentence_id", 0.4)
        held = sp.mark_quota(dealt, F.lit("all"), {"all": 13}, "sentence_id", 1).where("taken")
        ranks = sp.class_rank(dealt, "label", "sentence_id", 5).where("label = 'b'")
        seen.append([sorted(map(str, x.collect())) for x in (copies, held, ranks)])
        assert len(seen[-1][1]) == 13 and len(set(seen[-1][1])) == 13
    assert seen[0] == seen[1] == seen[2]


def test_rows_that_differ_in_missing_values_only(spark):
    rows = [("1", "x", None)] * 2 + [("1", None, "x")] * 2
    df = spark.createDataFrame(rows, "sentence_id string, a string, b string")
    assert df.select(sp.content_hash(df)).distinct().count() == 2


def test_held_counts_of_many_strata(spark):
    sizes = {f"s{i:03}": 2 + i * i % 11 for i in range(150)} | {None: 5}
    counts = spark.createDataFrame(list(sizes.items()), "s string, n long").repartition(5)
    got = {r["s"]: r["quota"] for r in sp.held_counts(counts, 0.3).collect()}
    assert got == sp.validation_counts(sizes, 0.3)
    assert sp.held_counts(counts.where("n < 0"), 0.3).count() == 0
