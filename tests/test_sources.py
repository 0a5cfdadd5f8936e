import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.functions import vocab
from labelflow.operators.dedup import drop_duplicates_first
from labelflow.operators.frames import SchemaError
from labelflow.session import shared_dir
from labelflow.sources import readers as rd
from labelflow.sources import sinks as sk

XML = """<?xml version="1.0" encoding="UTF-8"?>
<sentences>
  <sentence id="1">
    <text>The food was great but the service was slow.</text>
    <aspectCategories>
      <aspectCategory category="food" polarity="positive"/>
      <aspectCategory category="service" polarity="negative"/>
      <aspectCategory category="price" polarity=" NULL "/>
      <aspectCategory category="price" polarity=""/>
      <aspectCategory category="price"/>
    </aspectCategories>
  </sentence>
  <sentence id="2"><aspectCategories><aspectCategory category="food" polarity="conflict"/></aspectCategories></sentence>
  <sentence id="3"><text>Fish &amp; chips</text></sentence>
</sentences>
"""


def test_review_xml(spark, tmp_path, capsys):
    path = tmp_path / "train.xml"
    path.write_text(XML)
    out = rd.read_review_xml(spark, {"train": str(path), "test": str(tmp_path / "none.xml")})
    assert "no file for split 'test'" in capsys.readouterr().out
    assert [tuple(r) for r in out.sentences.select("sentence_id", "text", "split").orderBy("sentence_id").collect()] == [
        ("1", "The food was great but the service was slow.", "train"),
        ("2", "", "train"),
        ("3", "Fish & chips", "train"),
    ]
    assert [tuple(r) for r in out.aspects.orderBy("row_order").select("sentence_id", "aspect_category", "sentiment").collect()] == [
        ("1", "food", "positive"), ("1", "service", "negative"), ("2", "food", "conflict"),
    ]
    with pytest.raises(SchemaError):
        rd.read_review_xml(spark, {"test": str(tmp_path / "none.xml")})
    with pytest.raises(ValueError):
        rd.read_review_xml(spark, {})
    path.write_text("<sentences><sentence id='1'><text>x</text></sentence></sentences>")
    with pytest.raises(SchemaError):
        rd.read_review_xml(spark, {"train": str(path)})


def test_scan_order_keeps_first_copy(spark, tmp_path):
    for split, words in {"train": "abc", "test": "cde"}.items():
        body = "".join(f"<sentence id='{split}{w}'><text>{w}</text></sentence>" for w in words)
        (tmp_path / f"{split}.xml").write_text(f"<sentences>{body}</sentences>")
    paths = {s: str(tmp_path / f"{s}.xml") for s in ("train", "test")}
    rows = rd.read_review_xml(spark, paths, check_rows=False).sentences
    kept = drop_duplicates_first(rows, ["text"])
    assert {r["sentence_id"] for r in kept.collect()} == {"traina", "trainb", "trainc", "testd", "teste"}


def test_csv_roundtrip(spark, tmp_path):
    texts = ['say "hi", ok', "two\nlines", "cr\r\nlf", " padded ", "back\\slash", "tab\t", "", None, "NA", "null"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    path = str(tmp_path / "csv")
    sk.write_csv(df, path, ["i", "text"])
    got = {int(r["i"]): r["text"] for r in rd.read_csv(spark, path, ["i", "text"]).collect()}
    assert got == {i: (None if t in vocab.CSV_NULLS else t) for i, t in enumerate(texts) for t in [t or ""]}
    assert rd.csv_header(spark, path) == ["i", "text"]
    typed = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("text", T.StringType())])
    assert rd.read_csv(spark, path, typed).agg(F.sum("i")).first()[0] == 45
    with pytest.raises(SchemaError):
        rd.read_upload(spark, path, ["i"])


def test_splits(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), F.when(F.col("id") < 4, "test").otherwise("train").alias("split"))
    path = str(tmp_path / "t")
    sk.write_table(df, path)
    rows = rd.read_splits(spark, {s: f"{path}/split={s}/*.parquet" for s in ("train", "test")})
    assert rd.select_split(rows).count() == 4 and rd.select_split(rows.drop("split")).count() == 10
    plan = spark.read.parquet(path).filter("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_union_splits(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "text string, label int")
    out = rd.union_splits(spark, {"train": df, "test": df.limit(1)}, "en", "tweet_eval_irony")
    assert out.count() == 3 and {(r["lang"], r["source"]) for r in out.collect()} == {("en", "tweet_eval_irony")}
    empty = rd.union_splits(spark, {}, "en", "x")
    assert empty.count() == 0 and empty.columns == ["text", "label", "lang", "split", "source"]


def test_sentiment_union(spark):
    en = spark.createDataFrame([("a", 0, "train"), ("b", 9, "train")], "text string, label int, split string")
    vi = spark.createDataFrame([("c", 0, "test")], "sentence string, sentiment int, split string")
    got = {r["text"]: (r["label"], r["lang"], r["split"]) for r in rd.sentiment_union(en, vi).collect()}
    assert got == {"a": ("positive", "en", "train"), "b": (None, "en", "train"), "c": ("negative", "vi", "test")}
    with pytest.raises(Exception, match="unknown label code"):
        rd.sentiment_union(en, vi.withColumn("sentiment", F.lit(5))).collect()


def test_optional(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "en"))
    readers = {x: (str(tmp_path / x), spark.read.parquet) for x in ("en", "vi")}
    assert len(rd.read_optional(spark, readers)) == 1
    with pytest.raises(FileNotFoundError):
        rd.read_optional(spark, {"vi": readers["vi"]})


def test_report_and_exports(spark, tmp_path):
    path = str(tmp_path / "report")
    sk.write_report(spark.createDataFrame([(1, None)], "a int, b string"), path)
    assert [r[0] for r in spark.read.text(path).collect()] == ['{"a":1,"b":null}']
    rows = spark.sql(
        """SELECT 1L AS row, 'x' AS text, 'neutral' AS sentiment, 0.98765D AS confidence,
           array(named_struct('aspect', 'food', 'sentiment', 'positive', 'confidence', 0.5D),
                 named_struct('aspect', 'price', 'sentiment', 'negative', 'confidence', 0.25D)) AS aspects,
           CAST(NULL AS STRING) AS error"""
    )
    assert sk.export_lines(rows).first()[0] == '1,"x",neutral,98.77%,"food:positive; price:negative",'
    json = sk.export_with_json(rows).first()["aspects_json"]
    assert json == '[{"aspect":"food","sentiment":"positive","confidence":0.5},{"aspect":"price","sentiment":"negative","confidence":0.25}]'


def test_shared_dir(spark):
    assert shared_dir(spark) == shared_dir(spark)
