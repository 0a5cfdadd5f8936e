import itertools
import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from labelflow.operators import aspects as a
from labelflow.operators import attribution as at
from labelflow.operators import scoring as s
from labelflow.plans import training as tr
from labelflow.plans.eval_set import build_eval_set, irony_probes
from labelflow.sources import sinks as sk

# Workers cannot import a test module, so its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLASSES = ("negative", "neutral", "positive")
LEX = {"good": (-1.0, 0.0, 2.0), "bad": (2.0, 0.0, -1.0), "meh": (0.0, 0.5, 0.0)}
BIAS = (0.0, 0.25, 0.0)


def lexicon(spark):
    return spark.createDataFrame([(k, *v) for k, v in LEX.items()], "token string, negative double, neutral double, positive double")


def scorer():
    calls = []

    def run(texts):
        calls.append(len(texts))
        assert len(texts) <= 16
        out = []
        for t in texts:
            z = list(BIAS)
            for w in t.lower().split():
                z = [x + y for x, y in zip(z, LEX.get(w, (0, 0, 0)))]
            e = [math.exp(x) for x in z]
            out.append([x / sum(e) for x in e])
        return out

    return run


T = "sentence_id string, text string"


@pytest.mark.parametrize("batch", [1, 5, 16])
def test_batch_scoring(frame, batch):
    df = frame(T, *[(str(i), ["good", "bad bad", "", None][i % 4]) for i in range(100)])
    out = {r["sentence_id"]: r for r in s.score(df, scorer, batch_size=batch).collect()}
    assert len(out) == 100
    assert [out[str(i)]["sentiment"] for i in range(4)] == ["positive", "negative", "neutral", "neutral"]
    assert all(r["sarcasm_flag"] is False for r in out.values())


def test_scoring_edges(frame):
    df = frame(T, ("1", "good"))
    for bad in (0, -1):
        with pytest.raises(ValueError, match="a batch needs at least one row"):
            s.score(df, scorer, batch_size=bad)
    assert s.score(df.limit(0), scorer).count() == 0


def test_sarcasm_branch(frame):
    def irony():
        return lambda texts: [[0.2, 0.3, 0.5] if "wow" in t else [0.5, 0.2, 0.3] for t in texts]

    df = frame(T, ("1", "wow good"), ("2", "good"))
    got = {r["sentence_id"]: r["sarcasm_flag"] for r in s.score(df, scorer, sarcasm_scorer=irony, batch_size=16).collect()}
    assert got == {"1": True, "2": False}
    off = s.score(df, scorer, sarcasm_scorer=irony, skip_sarcasm=True, batch_size=16)
    assert off.filter("sarcasm_flag").count() == 0


@pytest.mark.parametrize("threshold", ["10MB", "-1"])  # -1: the lexicon is joined by a shuffle
def test_linear_equals_python(frame, spark, threshold):
    df = frame(T, ("1", "Good good bad"), ("2", ""), ("3", None), ("4", "nothing known"), ("5", " meh\tMEH "))
    py = {r["sentence_id"]: r for r in s.score(df, scorer, batch_size=16).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        native = s.from_logits(s.linear_logits(df, lexicon(spark), CLASSES, BIAS), CLASSES)
        rows = {r["sentence_id"]: r for r in native.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(rows) == set(py)
    for k, r in rows.items():
        assert r["probs"] == pytest.approx(py[k]["probs"])
        assert (r["sentiment"], r["confidence"]) == (py[k]["sentiment"], py[k]["confidence"])


def test_upload_rows(frame, spark):
    up = frame("text string", ("good",), ("  \n",), (None,), ('a "q" bad',)).withColumnRenamed("row_order", "row")
    text, error = s.clean_upload(F.col("text"))
    valid = up.select("row", text.alias("text"), error.alias("error")).filter("error IS NULL")
    scores = s.from_logits(s.linear_logits(valid, lexicon(spark), CLASSES, BIAS, "text", "row"), CLASSES)
    out = s.batch_results(up, scores)
    got = {r["row"]: r for r in out.collect()}
    assert (got[1]["sentiment"], got[1]["confidence"], got[1]["error"]) == ("neutral", 0.0, "Empty text — skipped")
    assert got[2]["text"] == "nan" and got[2]["error"] is None
    assert s.batch_totals(out).first().asDict() == {"total_items": 4, "processed_items": 3, "failed_items": 1}
    summary = [(r["label"], r["n"], r["pct"]) for r in s.sentiment_summary(out).orderBy("pos").collect()]
    assert summary == [("positive", 1, 25.0), ("neutral", 2, 50.0), ("negative", 1, 25.0)]
    lines = {r[0].split(",")[0]: r[0] for r in sk.export_lines(out).collect()}
    assert lines["3"].startswith('3,"a ""q"" bad",negative,') and lines["3"].endswith('%,"",')
    assert lines["1"] == '1,"",neutral,0.00%,"",Empty text — skipped'
    strict, failed = s.clean_upload(F.lit(None).cast("string"), null_as_text=False)
    assert spark.range(1).select(strict, failed).first()[1] == "Empty text — skipped"
    none = s.sentiment_summary(out.limit(0)).collect()
    assert [r["pct"] for r in none] == [0.0, 0.0, 0.0]


def test_missing_scores_are_errors(frame, spark):
    up = frame("text string", ("good",)).withColumnRenamed("row_order", "row")
    none = spark.createDataFrame([], "row long, sentiment string, confidence double")
    assert s.batch_results(up, none).first()["error"] == "Not scored"


def test_pairing(frame):
    l, r = frame("id string, y_true string", ("1", "a"), ("2", "b")).drop("row_order"), frame("id string, y_pred string", ("2", "x"), ("1", "y")).drop("row_order")
    assert sorted(tuple(x) for x in s.assert_paired(l, r, "id").collect()) == [("1", "a", "y"), ("2", "b", "x")]
    with pytest.raises(Exception, match="do not match"):
        s.assert_paired(l, r.limit(1), "id").collect()


def test_aspects(frame, spark):
    texts = frame(T, ("1", "x"), ("2", "y"), ("3", "z"))
    scores = spark.createDataFrame([("1", "food", 0.46), ("1", "price", 0.9), ("1", "service", 0.45), ("2", "food", 0.1)], "sentence_id string, aspect string, score double")
    sents = spark.createDataFrame(
        [("1", "food", "negative", 0.4), ("1", "food", "positive", 0.4), ("1", "food", "neutral", 0.2), ("1", "price", "negative", 0.77777)],
        "sentence_id string, aspect string, sentiment string, score double",
    )
    out = {r["sentence_id"]: [tuple(x) for x in r["aspects"]] for r in a.extract_aspects(texts, scores, sents).collect()}
    assert out == {"1": [("price", "negative", 0.7778), ("food", "positive", 0.4)], "2": [], "3": []}
    cover = a.aspect_coverage(a.extract_aspects(texts, scores, sents)).first()
    assert cover["coverage"] == pytest.approx(1 / 3) and not cover["on_target"]


def test_keyword_aspects(frame):
    df = frame(T, ("1", "Pizza, great staff!"), ("2", "nothing"), ("3", "the PIZZA"))
    got = {r["sentence_id"]: r["aspects"] for r in a.keyword_aspects(df, {"service": ["staff", "waiter"], "food": ["pizza"]}).collect()}
    assert got == {"1": ["food", "service"], "2": [], "3": ["food"]}


def test_expectations(spark):
    expected = spark.createDataFrame(
        [
            ("1", "food", ["positive"]), ("1", "service", ["negative"]),
            ("2", "ambiance/general", ["negative"]),
            ("3", "price", ["negative", "neutral"]), ("3", "food", ["positive"]),
            ("4", "service/general", ["negative"]),
        ],
        "id string, aspect string, allowed array<string>",
    )
    predicted = spark.createDataFrame(
        [("1", "Food", "positive"), ("1", "service", "Negative"), ("2", "general", "negative"), ("2", "ambiance", "positive"), ("3", "price", "positive"), ("4", "service", "positive")],
        "id string, aspect string, sentiment string",
    )
    got = {r["id"]: (r["passed"], r["reasons"]) for r in a.check_expectations(expected, predicted).collect()}
    assert got["1"] == (True, "") and got["2"][0] is True
    assert got["3"] == (False, "food: not found | price: got positive")
    assert got["4"] == (False, "service/general: got positive")


@pytest.mark.parametrize("left,right", [(["1", "1"], ["1", "1"]), (["1", "1", "2"], ["1", "2"]), (["1", "2"], ["1", "2", "2"]), ([None], [None])])
def test_pairing_refuses_repeated_ids(frame, left, right):
    l = frame("id string, a string", *[(i, "x") for i in left]).drop("row_order")
    r = frame("id string, b string", *[(i, "y") for i in right]).drop("row_order")
    with pytest.raises(Exception, match="share an id|do not match"):
        s.assert_paired(l, r, "id").collect()


def test_linear_attribution(frame, spark):
    df = frame(T, ("1", "good food bad good"), ("2", "bad"))
    rows = at.attribute_linear(df, lexicon(spark), CLASSES, BIAS).orderBy("sentence_id", "pos").collect()
    assert [(r["token"], r["value"]) for r in rows if r["sentence_id"] == "1"] == [("good", 2.0), ("food", 0.0), ("bad", -1.0), ("good", 2.0)]
    assert {r["sentiment"] for r in rows if r["sentence_id"] == "2"} == {"negative"}


def test_linear_attribution_of_missing_and_repeated_ids(frame, spark):
    df = frame(T, (None, "good"), (None, "bad bad"), ("1", "good"), ("1", "good"), ("2", None), ("3", ""))
    rows = at.attribute_linear(df, lexicon(spark), CLASSES, BIAS).collect()
    got = sorted((str(r["sentence_id"]), r["pos"], r["token"], r["sentiment"], r["value"]) for r in rows)
    assert got == [
        ("1", 0, "good", "positive", 2.0), ("1", 0, "good", "positive", 2.0), ("None", 0, "bad", "negative", 2.0),
        ("None", 0, "good", "positive", 2.0), ("None", 1, "bad", "negative", 2.0),
    ]


def test_linear_attribution_shuffles_no_tokens(frame, spark):
    """Tokens outside the lexicon keep their places, and what is grouped or sorted by row holds no tokens."""
    df = frame(T, ("1", "the good and the bad good"), ("2", "the end"))
    out = at.attribute_linear(df, lexicon(spark), CLASSES, BIAS)
    rows = sorted((r["sentence_id"], r["pos"], r["token"], r["value"]) for r in out.collect())
    assert rows[:6] == [("1", 0, "the", 0.0), ("1", 1, "good", 2.0), ("1", 2, "and", 0.0), ("1", 3, "the", 0.0), ("1", 4, "bad", -1.0), ("1", 5, "good", 2.0)]
    assert [r[1:] for r in rows[6:]] == [(0, "the", 0.0), (1, "end", 0.0)]
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()


def test_leave_one_out_brute_force(frame):
    texts = {"1": "good bad food", "2": "", "3": " ".join(["meh", "x"] * 12)}
    df = frame(T, *texts.items())
    fn = scorer()
    for r in at.attribute_leave_one_out(df, scorer, batch_size=5).collect():
        words = texts[r["sentence_id"]].split()
        full = fn([" ".join(words)])[0]
        best = full.index(max(full))
        want = [full[best] - fn([" ".join(words[:i] + words[i + 1 :])])[0][best] for i in range(len(words))]
        assert r["tokens"] == words and r["values"] == pytest.approx(want)
        assert r["base_value"] == pytest.approx(fn([""])[0][best]) and r["sentiment"] == CLASSES[best]


def game_scorer():
    """One class rated by a set function of the words: pairs and triples of words act together."""

    def rate(words):
        v = sum({"good": 2.0, "bad": -1.5}.get(w, 0.25) for w in words)
        v += 3.0 * ("not" in words and "good" in words) - 2.0 * ({"a", "bad", "c"} <= set(words))
        return v + 0.1 * len(words) ** 2

    def run(texts):
        assert len(texts) <= 7
        return [[rate(t.split()), -1e9] for t in texts]

    run.rate = rate
    return run


def tree_orders(low, high):
    """Orders of tokens in which every span of the tree stays together, all equally likely."""
    if high - low == 1:
        return [[low]]
    middle = (low + high) // 2
    a, b = tree_orders(low, middle), tree_orders(middle, high)
    return [x + y for x in a for y in b] + [y + x for x in a for y in b]


def mean_marginals(words, orders, rate):
    out = [0.0] * len(words)
    for order in orders:
        for k, i in enumerate(order):
            before = sorted(order[:k])
            out[i] += rate([words[j] for j in sorted([*before, i])]) - rate([words[j] for j in before])
    return [v / len(orders) for v in out]


def tree_values(df, **options):
    got = {}
    for r in at.attribute_tree(df, game_scorer, batch_size=7, classes=("yes", "no"), **options).collect():
        assert r["sentiment"] == "yes" and r["base_value"] == 0
        got.setdefault(r["sentence_id"], []).append((r["pos"], r["token"], r["value"]))
    return {k: sorted(v) for k, v in got.items()}


def test_tree_attribution_enumerated(frame):
    texts = ["good", "not good", "a bad c", "not good a bad", "x not y good bad", "a not bad good c x", "good not c a bad good z"]
    got = tree_values(frame(T, *[(str(i), t) for i, t in enumerate(texts)]))
    rate = game_scorer().rate
    for i, text in enumerate(texts):
        words = text.split()
        assert [t for _, t, _ in got[str(i)]] == words
        assert [v for *_, v in got[str(i)]] == pytest.approx(mean_marginals(words, tree_orders(0, len(words)), rate))
        if len(words) <= 2:  # one pair: the Owen values are the Shapley values
            assert [v for *_, v in got[str(i)]] == pytest.approx(mean_marginals(words, list(itertools.permutations(range(len(words)))), rate))


def test_tree_attribution_equals_shapley_of_sibling_pairs(frame):
    """Words that act together only inside a span leave nothing for the tree to change."""
    text = "not good x y not good z z"
    rows = at.attribute_tree(frame(T, ("1", text)), sibling_scorer, batch_size=7, classes=("yes", "no")).orderBy("pos").collect()
    words = text.split()
    halves = [mean_marginals(w, list(itertools.permutations(range(4))), sibling_scorer().rate) for w in (words[:4], words[4:])]
    assert [r["value"] for r in rows] == pytest.approx(halves[0] + halves[1])


def sibling_scorer():
    def rate(words):
        together = sum(a == "not" and b == "good" for a, b in zip(words, words[1:]))
        return 5.0 * together + sum({"good": 1.0, "x": 2.0, "y": -2.0, "z": -1.0}.get(w, 0.0) for w in words)

    def run(texts):
        return [[rate(t.split()), -1e9] for t in texts]

    run.rate = rate
    return run


@pytest.mark.parametrize("work", [40_000, 1 << 25])
def test_tree_attribution_of_long_texts(frame, work):
    """Drawn contexts: shares still add up, tasks do not change them, additive words get their weight."""
    text = " ".join(["not", "x", "good", "bad"] * 25)
    df = frame(T, ("long", text), ("none", ""), ("null", None), (None, "bad"), (None, "good"), ("twice", "bad a"), ("twice", "bad a"))
    got = tree_values(df, work=work)
    rate = game_scorer().rate
    assert sum(v for *_, v in got["long"]) == pytest.approx(rate(text.split()))
    assert len(got["long"]) == 100 and set(got) == {"long", None, "twice"}
    assert [t for _, t, _ in got[None]] == ["bad", "good"] and len(got["twice"]) == 4
    whole = tree_values(df)
    assert [v for *_, v in got["long"]] == pytest.approx([v for *_, v in whole["long"]])


def encoding_scorer():
    """The game over codes of words; whole texts are refused."""
    import numpy as np

    names, game = {}, game_scorer()

    def encode(words):
        return np.array([names.setdefault(w, len(names)) for w in words], dtype=int)

    def of_encoded(codes):
        known = list(names)
        return game([" ".join(known[i] for i in code) for code in codes])

    def run(texts):
        raise AssertionError("cut into words again")

    run.encode, run.of_encoded = encode, of_encoded
    return run


def test_tree_attribution_encodes_a_text_once(frame):
    texts = ["good", "not good a bad", "not x good bad " * 25]
    df = frame(T, *[(str(i), t) for i, t in enumerate(texts)], ("none", " "))
    rows = at.attribute_tree(df, encoding_scorer, batch_size=7, classes=("yes", "no"), work=40_000).collect()
    got = {k: sorted((r["pos"], r["token"], r["value"]) for r in rows if r["sentence_id"] == k) for k in "012"}
    plain = tree_values(df)
    assert set(plain) == set(got)
    for k in got:
        assert [x[:2] for x in got[k]] == [x[:2] for x in plain[k]]
        assert [x[2] for x in got[k]] == pytest.approx([x[2] for x in plain[k]])


def test_tree_splits_cover_all_places():
    for n in (2, 3, 7, 64, 100):
        spans = [at.split_of(n, i) for i in range(1, n)]
        assert len({(a, b) for a, b, _ in spans}) == n - 1
        for low, high, beside in spans:
            assert sorted([(low, high), *beside])[0][0] == 0 and sum(b - a for a, b in [(low, high), *beside]) == n
    drawn = at.outside_contexts(1000, 9, 20)
    assert len(drawn) == 20 and all(sum(c >> i & 1 for c in drawn) == 10 for i in range(9))


def test_ranked_tokens(frame):
    df = frame("w array<string>, v array<double>", (["a", "b", "c"], [0.5, -1.0, 0.5]), ([], []), (["z"], [0.0]))
    got = [[tuple(x) for x in r[0]] for r in df.orderBy("row_order").select(at.ranked_tokens(F.col("w"), F.col("v"))).collect()]
    assert got[0] == [(1, "b", -1.0, 45.0), (2, "a", 0.5, 22.5), (3, "c", 0.5, 22.5)]
    assert got[1] == [] and got[2] == [(1, "z", 0.0, 0.0)]


def task_rows(frame, n=60):
    words = {"negative": "bad awful", "neutral": "meh plain", "positive": "good fine"}
    labels = list(words)
    rows = [(f"r{i}", f"{words[labels[i % 3]]} number {i}", labels[i % 3], "en" if i % 2 else "vi") for i in range(n)]
    return frame("id string, text string, label string, lang string", *rows)


def test_fit_and_evaluate(frame):
    fitted = tr.fit_classifier(task_rows(frame), "sentiment", features=1 << 10, max_iter=10)
    assert fitted.test.count() == 6
    out = fitted.predict(fitted.test).select("label", "y_pred", F.size("probs").alias("n")).collect()
    assert all(r["n"] == 3 and CLASSES[r["label"]] == r["y_pred"] for r in out)
    assert fitted.weights.count() == 3


def test_smoke_fit_uses_first_rows(frame):
    train, test = tr.prepare_rows(task_rows(frame), tr.get_task("sentiment"), smoke=True)
    assert train.count() + test.count() == 32 and test.count() == 4
    with pytest.raises(ValueError, match="no task is called"):
        tr.get_task("topic")


def test_evaluate_split(frame):
    df = task_rows(frame).withColumn("split", F.when(F.col("row_order") < 30, "test").otherwise("train"))
    df = df.withColumn("lang", F.when(F.col("lang") == "vi", "vi"))
    pairs = tr.evaluate_split(df, scorer, batch_size=16)
    assert pairs.count() == 30
    row = tr.report(pairs).first()
    assert row["overall_f1"] == pytest.approx(1.0) and row["sample_counts"] == {"en": 15, "vi": 15}
    assert tr.evaluate_split(df, scorer, max_samples=7, batch_size=16).count() == 7


def test_evaluate_irony(frame):
    def irony():
        return lambda texts: [[0.1, 0.2, 0.7] if "wow" in t else [0.5, 0.4, 0.1] for t in texts]

    df = frame("id string, text string, label string", ("1", "wow", "1"), ("2", "plain", "0"), ("3", "wow", "non_irony"))
    got = {r["id"]: (r["y_true"], r["y_pred"], r["lang"]) for r in tr.evaluate_split(df, irony, "sarcasm").collect()}
    assert got == {"1": ("irony", "irony", "en"), "2": ("non_irony", "non_irony", "en"), "3": ("non_irony", "irony", "en")}


def test_eval_set(frame, spark):
    rows = [(f"{x}{i}", f"t{i}", "positive", "src", "test" if i < 6 else "train") for x in ("e", "v") for i in range(15)]
    df = frame("id string, text string, label string, source string, split string", *rows)
    parts = {"en": df.filter("id LIKE 'e%'"), "vi": df.filter("id LIKE 'v%'")}
    out = build_eval_set(parts, "id")
    assert out.columns == ["id", "text", "label", "lang", "source"]
    assert {r["lang"]: r["count"] for r in out.groupBy("lang").count().collect()} == {"en": 6, "vi": 6}
    assert build_eval_set({"en": parts["en"].drop("split")}, "id", cap=10).count() == 10
    with pytest.raises(ValueError):
        build_eval_set({}, "id")
    assert irony_probes(spark).groupBy("label").count().count() == 2


def aspect_scorer():
    def detect(texts):
        if any("broken" in t for t in texts):
            raise RuntimeError("cannot read this")
        return [[0.9 if "food" in t else 0.0, 0.95 if "staff" in t else 0.45, 0.0, 0.0, 0.0, 0.0] for t in texts]

    def rate(pairs):
        assert all(aspect in ("food", "service") for _, aspect in pairs)
        return [[0.2, 0.55555, 0.1] if aspect == "service" else [0.4, 0.4, 0.2] for _, aspect in pairs]

    return detect, rate


def test_aspect_branch(frame):
    df = frame(T, ("1", "good food and staff"), ("2", "nothing"), ("3", None), ("4", "broken food"), ("5", "food"), ("5", "food"))
    got = sorted((r["sentence_id"], [tuple(x) for x in r["aspects"]]) for r in s.score(df, scorer, aspect_scorer=aspect_scorer, batch_size=16).collect())
    food, service = ("food", "positive", 0.4), ("service", "negative", 0.5556)
    # one text the scorer fails on loses its own aspects only
    assert got == [("1", [service, food]), ("2", []), ("3", []), ("4", []), ("5", [food]), ("5", [food])]
    off = s.score(df, scorer, aspect_scorer=aspect_scorer, skip_aspects=True, batch_size=16)
    assert off.filter("size(aspects) > 0").count() == 0


def test_language_gate(frame):
    df = frame("sentence_id string, text string, lang string", ("1", "good", "en"), ("2", "tốt", "vi"), ("3", "x", None))
    assert s.score(df, scorer, lang_col="lang", batch_size=16).count() == 3
    with pytest.raises(Exception, match="no scorer for language de"):
        s.score(df.withColumn("lang", F.lit("de")), scorer, lang_col="lang", batch_size=16).collect()


def test_rated_aspects_in_the_row(spark):
    df = spark.createDataFrame([("a", [0.9, 0.45, 0.46, 0.9, None, 0.1]), ("b", [0.0] * 6), ("c", None)], "id string, x array<double>")
    rate = lambda aspect: F.when(aspect == "food", F.array(F.lit(0.3), F.lit(0.3), F.lit(0.4))).otherwise(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)))
    got = {r["id"]: [tuple(x) for x in r["aspects"]] for r in df.select("id", a.rated_aspects(F.col("x"), rate).alias("aspects")).collect()}
    assert got == {"a": [("food", "neutral", 0.4), ("price", "positive", 0.5), ("ambiance", "positive", 0.5)], "b": [], "c": []}
