"""Dedup of a stream against everything it has ever delivered, not only against what the watermark remembers.

Keys that were delivered lie in a table, dealt to buckets by their hash. Beside it every bucket has a Bloom filter.
A micro-batch first asks the filters, which are small and read whole; only the keys they cannot rule out are
looked up in the table, and only in their buckets, so new texts, the usual case, never touch the history. False
hits of a filter cost a lookup, never a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelflow.functions import text as T
from labelflow.operators.dedup import drop_duplicates_first
from labelflow.sources.readers import path_exists

BUCKETS = 256
# Ten bits a key keep a filter of four hashes below 2 % false hits: 100,000 keys a bucket, 25 million in all. More
# keys only mean more lookups; for larger histories raise the buckets.
BITS = 1 << 20
HASHES = 4

FILTERS = "bucket int, bits binary"
KEYS = "key string, bucket int"


def _filter_places(keys: pd.Series, bits: int) -> np.ndarray:
    """Places of md5 hex keys in a filter: four stretches of the digest."""
    return np.array([[int(k[i * 8 : i * 8 + 8], 16) % bits for i in range(HASHES)] for k in keys], dtype=np.int64).reshape(-1, HASHES)


def _bits_of(rows: pd.DataFrame, bits: int) -> np.ndarray:
    stored = np.zeros(bits // 8, dtype=np.uint8)
    for data in rows["bits"]:
        stored |= np.frombuffer(data, dtype=np.uint8)
    return stored


def unseen_keys(keys: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """Distinct (key, bucket) with ``maybe``: whether the bucket's filter holds all places of the key."""

    def ask(rows: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        held = _bits_of(stored, bits)
        places = _filter_places(rows["key"], bits)
        maybe = ((held[places >> 3] >> (places & 7)) & 1).all(axis=1) if len(rows) else np.zeros(0, bool)
        return rows.assign(maybe=maybe)

    asked = keys.groupBy("bucket").cogroup(filters.groupBy("bucket"))
    return asked.applyInPandas(lambda rows, stored: ask(rows, stored), KEYS + ", maybe boolean")


def updated_filters(keys: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """Filters with the given keys added."""

    def add(rows: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        held = _bits_of(stored, bits)
        places = _filter_places(rows["key"], bits).ravel()
        np.bitwise_or.at(held, places >> 3, (1 << (places & 7)).astype(np.uint8))
        bucket = int((rows if len(rows) else stored)["bucket"].iloc[0])
        return pd.DataFrame({"bucket": [bucket], "bits": [held.tobytes()]})

    both = keys.groupBy("bucket").cogroup(filters.groupBy("bucket"))
    return both.applyInPandas(lambda rows, stored: add(rows, stored), FILTERS)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def first_copies(
    texts: DataFrame,
    folder: str,
    order_col: str,
    text_col: str = "text",
    then: Callable[[DataFrame], DataFrame] | None = None,
    buckets: int = BUCKETS,
    bits: int = BITS,
    available_now: bool = True,
) -> StreamingQuery:
    """Writes the first copy of every normalised text of the whole stream to ``folder/rows/batch=N``.

    Of the copies in one micro-batch the first by ``order_col`` counts. ``then`` maps the rows that are kept, for
    example to scores, before they are written. A batch reads the keys of earlier batches and writes its own
    folders, so a batch that runs again after a failure overwrites what it left and decides the same. Of the
    filters, only those of the last two batches are kept; ``bits`` must stay the same for a folder.
    """
    spark = texts.sparkSession
    if bits % 8:
        raise ValueError(f"filters come in whole bytes, not {bits} bits")

    def stored(name: str, schema: str, batch: int) -> DataFrame:
        path = f"{folder}/{name}/batch={batch}"
        return spark.read.schema(schema).parquet(path) if batch >= 0 and path_exists(spark, path) else spark.createDataFrame([], schema)

    def run(rows: DataFrame, batch: int) -> None:
        key = F.md5(T.text_key(F.col(text_col)))
        keyed = rows.withColumn("key", key)
        fresh = drop_duplicates_first(keyed, ["key"], order_col)
        fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).persist()
        filters = stored("filters", FILTERS, batch - 1)
        asked = unseen_keys(fresh.select("key", "bucket"), filters, bits).persist()
        kept = fresh
        if batch > 0 and not asked.where("maybe").isEmpty():
            known = spark.read.schema("key string, batch int, bucket int").parquet(f"{folder}/keys").where(F.col("batch") < batch)
            # the buckets that are asked for are known before the scan, which leaves out all others
            seen = known.join(asked.where("maybe").select("bucket", "key"), ["bucket", "key"], "left_semi")
            kept = fresh.join(seen.select("key").distinct(), "key", "left_anti").persist()
        out = kept.drop("key", "bucket")
        (then(out) if then else out).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        new = kept.select("key", "bucket")
        updated_filters(new, filters, bits).write.mode("overwrite").parquet(f"{folder}/filters/batch={batch}")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/keys/batch={batch}")
        for used in (kept, asked, fresh):
            used.unpersist()
        _remove(spark, f"{folder}/filters/batch={batch - 2}")

    writer = texts.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
