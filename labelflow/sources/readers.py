"""Scans: review XML, CSV, parquet by split, request logs, and the label-normalising unions."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.functions import vocab
from labelflow.functions.labels import decode
from labelflow.operators.frames import Frames, SchemaError
from labelflow.sources import ranges

TASK_COLUMNS = ("text", "label", "lang", "source", "split")

XML_SENTENCE = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField(
            "aspectCategories",
            T.StructType(
                [
                    T.StructField(
                        "aspectCategory",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("_category", T.StringType()),
                                    T.StructField("_polarity", T.StringType()),
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), frames)


def scan_order(rank: int = 0) -> Column:
    """Position of a row in its scan: (input rank, file, block start, row in block).

    Two rows of one block are always read by the same task in file order, so comparisons do not depend
    on how blocks are packed into tasks. Use as ``order_col`` right after the scan.
    """
    return F.struct(
        F.lit(rank).alias("rank"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_review_xml(
    spark: SparkSession, paths: Mapping[str, str], check_rows: bool = True
) -> Frames:
    """Sentences and aspects from ``<sentence>`` rows, one path (or glob) per split.

    A split without files is skipped. Aspects whose polarity is empty or says "none" are dropped. A file is read
    by as many tasks as it has byte ranges; ``row_order`` goes by input, file, range and row.
    """
    if not paths:
        raise ValueError("at least one split is needed")
    scans = []
    for rank, (split, path) in enumerate(paths.items()):
        if not path_exists(spark, path):
            print(f"Warning: no file for split '{split}': {path}")
            continue
        rows = ranges.xml_rows(spark, path, "sentence")
        order = ranges.range_order("pos", rank=rank).alias("row_order")
        # a generator, so that a row is parsed once
        parsed = F.explode(F.array(F.from_xml("text", XML_SENTENCE))).alias("row")
        scans.append(rows.select(parsed, order).select("row.*", "row_order", F.lit(split).alias("split")))
    if not scans:
        raise SchemaError("no review files found")
    rows = union(scans)
    ident = F.coalesce(F.col("_id"), F.lit("None")).alias("sentence_id")
    sentences = rows.select(ident, F.coalesce("text", F.lit("")).alias("text"), "split", "row_order")
    item = rows.select(
        ident, "row_order", F.posexplode("aspectCategories.aspectCategory").alias("pos", "a")
    )
    polarity = F.col("a._polarity")
    labelled = (polarity != "") & ~F.lower(F.trim(polarity)).isin(*vocab.EMPTY_POLARITY)
    aspects = item.filter(labelled).select(
        "sentence_id",
        F.col("a._category").alias("aspect_category"),
        polarity.alias("sentiment"),
        F.struct("row_order", "pos").alias("row_order"),
    )
    if check_rows and (sentences.isEmpty() or aspects.isEmpty()):
        raise SchemaError("no sentences or aspects in the review files")
    return Frames(sentences, aspects)


def nulls_from_tokens(df: DataFrame) -> DataFrame:
    """String columns: the usual missing-value spellings become null."""
    missing = lambda c: F.when(~F.col(c).isin(*vocab.CSV_NULLS), F.col(c)).alias(c)
    return df.select(*[missing(f.name) if f.dataType == T.StringType() else f.name for f in df.schema])


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | Sequence[str],
    null_tokens: bool = True,
    multi_line: bool = True,
    order_col: str | None = None,
) -> DataFrame:
    """CSV with a header and doubled quotes. A list of names means all strings.

    Fields may hold line breaks: the file is still read by as many tasks as it has byte ranges (see ``ranges``),
    after a pass that finds where records begin. ``multi_line=False`` saves that pass when no field holds a line
    break. ``order_col`` adds the position of a row in its scan. Lines end with LF or CR LF.
    """
    if not isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in schema])
    options = {
        "escape": '"',
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "maxCharsPerColumn": "-1",
    }
    if multi_line:
        records = ranges.csv_records(spark, path)
        parsed = F.explode(F.array(F.from_csv("text", _ddl(schema), options | {"multiLine": "true"}))).alias("row")
        rows = records.select(parsed, ranges.range_order().alias("__order")).select("row.*", "__order")
    else:
        rows = spark.read.schema(schema).options(header=True, **options).csv(path)
        rows = rows.select("*", scan_order().alias("__order"))
    rows = rows.select(*[F.col(f"`{f.name}`") for f in schema], *([F.col("__order").alias(order_col)] if order_col else []))
    return nulls_from_tokens(rows) if null_tokens else rows


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def read_upload(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Uploaded CSV; must have a ``text`` column."""
    if "text" not in columns:
        raise SchemaError("an upload needs a column named text")
    return read_csv(spark, path, columns)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV: reads the header line only."""
    return spark.read.option("header", True).option("escape", '"').csv(path).columns


def read_splits(
    spark: SparkSession, globs: Mapping[str, str], schema: T.StructType | None = None
) -> DataFrame:
    """Parquet files per split, with the split's name as a column."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return union([reader.parquet(g).withColumn("split", F.lit(s)) for s, g in globs.items()])


def read_optional(spark: SparkSession, readers: Mapping[str, tuple[str, object]]) -> list[DataFrame]:
    """[reader(path)] for the paths that exist; fails when none does. ``readers``: name -> (path, fn)."""
    found = []
    for name, (path, reader) in readers.items():
        if path_exists(spark, path):
            found.append(reader(path))
        else:
            print(f"Warning: {name} input not found, skipping: {path}")
    if not found:
        raise FileNotFoundError("no input found: " + ", ".join(p for p, _ in readers.values()))
    return found


def union_splits(
    spark: SparkSession, splits: Mapping[str, DataFrame], lang: str, source: str, label_type: str = "int"
) -> DataFrame:
    """Text and label of each split with its lineage; an empty typed frame for no splits."""
    if not splits:
        return spark.createDataFrame(
            [], f"text string, label {label_type}, lang string, split string, source string"
        )
    return union(
        [
            df.select(
                "text",
                "label",
                F.lit(lang).alias("lang"),
                F.lit(split).alias("split"),
                F.lit(source).alias("source"),
            )
            for split, df in splits.items()
        ]
    )


def decode_labels(
    df: DataFrame, col: str, mapping: Mapping[int, str], on_unknown: str = "null"
) -> DataFrame:
    return df.withColumn(col, decode(F.col(col), mapping, on_unknown))


def task_frame(
    df: DataFrame,
    text: Column,
    label: Column,
    lang: Column,
    source: Column,
    split: Column,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """The shared task schema text, label, lang, source, split."""
    return df.select(
        text.alias("text"),
        label.alias("label"),
        lang.alias("lang"),
        source.alias("source"),
        split.alias("split"),
        *extra,
    )


def sentiment_union(english: DataFrame, vietnamese: DataFrame) -> DataFrame:
    """Both sentiment sources with their own label coding resolved.

    ``english`` (text, label code, split) maps unknown codes to null; ``vietnamese`` (sentence,
    sentiment code, split) fails on them.
    """
    en = task_frame(
        english,
        F.col("text"),
        decode(F.col("label"), vocab.EN_CODES, "null"),
        F.lit("en"),
        F.lit("multilingual_sentiments"),
        F.col("split"),
    )
    vi = task_frame(
        vietnamese,
        F.col("sentence"),
        decode(F.col("sentiment"), vocab.VI_CODES, "raise"),
        F.lit("vi"),
        F.lit("uit_vsfc"),
        F.col("split"),
    )
    return en.unionByName(vi)


def select_split(df: DataFrame, split: str = "test") -> DataFrame:
    """Rows of one split; all rows when there is no split column."""
    return df.filter(F.col("split") == split) if "split" in df.columns else df


REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("method", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("latency_s", T.DoubleType()),
        T.StructField("lang", T.StringType()),
    ]
)
