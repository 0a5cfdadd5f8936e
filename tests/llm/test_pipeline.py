"""The pipeline's stages, each on its own input, and the registered queries next to their SQL."""

import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from labelflow.llm import bpe, mixing, pii, simhash, toxicity
from labelflow.llm.queries import ORACLES, QUERIES
from labelflow.llm.setblocks import words_of
from labelflow.session import ARROW_BYTES, small_batches
from oracle import compare, connect
from test_setblocks import roots_of

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    names, rows = [n for n, _ in corpus_pipeline.STAGES], docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, FOLDER).cache()
        seen[name] = rows, out
        assert name == names[-1] or out.columns == docs.columns
        rows = out
    before, after = seen["toxicity"]
    clean = {r["doc_id"] for r in toxicity.judge(before, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in after.collect()} == clean
    before, after = seen["simhash_near_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    values = []
    for _, text in rows:
        words = words_of(text)
        values.append((simhash.fingerprint_of(text), {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}))
    roots = roots_of(values, lambda a, b: (a[0] ^ b[0]).bit_count() <= 3
                     or len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({rows[i][0] for i in roots})
    before, after = seen["pii"]
    assert after.count() == before.count()
    found = {r["doc_id"]: r["spans"] for r in pii.find(before).collect()}
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert (r["text"] == old[r["doc_id"]]) == (found[r["doc_id"]] == "") and r["n_chars"] == len(r["text"])
    before, after = seen["source_mix"]
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(before).where("copies > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == want
    before, after = seen["bpe"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    encoder = bpe.Codec().base
    for r in after.collect():
        ids = encoder.encode_ordinary(texts[r["doc_id"]])
        assert r["tokens"] == ids and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_stages_keep_all_columns(spark):
    """Nulls, empty texts and further columns, some named like the stages' own, pass through; an empty table too."""
    rows = [(1, "one two three four five", "en", "a", 23), (2, None, None, None, None), (None, "", "en", "b", 0),
            (3, "mail me at x.y@example.org please", "en", "b", 30), (3, "mail me at x.y@example.org please", "en", "b", 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "7 AS row", "'h' AS row_hash", "1.5 AS score", "array(1) AS spans", "'t' AS times", "'r' AS root")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        kept = out.collect()
        assert kept and all(r["row"] == 7 and r["row_hash"] == "h" and r["root"] == "r" for r in kept), name


def test_stages_bound_arrow_batches_by_bytes(spark):
    """Stages that hand texts to Python leave batches of about 4 MB, however long the texts; a caller's own bound stays."""
    docs = spark.createDataFrame([(1, "one two three", "en", "a", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    long = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 10000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    before = spark.conf.get(ARROW_BYTES, None)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name in ("toxicity", "simhash_near_dedup", "bpe"):
                spark.conf.unset(ARROW_BYTES)
                stage(spark, docs, FOLDER)
                found = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
                assert sum(found) > 20_000_000 and max(found) < 5_000_000, name
        spark.conf.set(ARROW_BYTES, "1m")
        assert small_batches(spark).conf.get(ARROW_BYTES) == "1m"
    finally:
        spark.conf.unset(ARROW_BYTES) if before is None else spark.conf.set(ARROW_BYTES, before)
