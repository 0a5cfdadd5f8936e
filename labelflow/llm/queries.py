"""Registered queries of the operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.llm import bpe, html, interactions, licenses, mixing, pii, simhash, spotsigs, topk, toxicity, urls, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register ``fn(table, ..)``, which gets the named tables of a folder."""

    def register(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(*[spark.read.parquet(f"{folder.rstrip('/')}/{t}.parquet") for t in tables])
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_toxicity", "documents", "labels")
def _toxicity(docs, labels):
    return toxicity.judge(docs, labels)


@query("op2_html_extraction", "pages")
def _html(pages):
    return html.extract(pages)


@query("op3_spotsigs", "documents")
def _spotsigs(docs):
    return spotsigs.with_edits(docs)


@query("op4_simhash", "documents")
def _simhash(docs):
    return simhash.near_duplicates(docs)


@query("op5_bpe", "documents")
def _bpe(docs):
    return bpe.encode_documents(docs, tokens=False)


MIX_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT 0 AS round, CAST(0 AS DOUBLE) AS level
  UNION ALL
  SELECT round + 1, (
    SELECT (1.5 * sum(source_size) - sum(CASE WHEN source_size * 2 < f.level * weight THEN source_size * 2 ELSE 0 END))
           / sum(CASE WHEN source_size * 2 < f.level * weight THEN 0 ELSE weight END)
    FROM sources)
  FROM filled f WHERE round < 25),
targets AS (
  SELECT source, source_size,
         least(CAST(source_size * 2 AS DOUBLE), (SELECT level FROM filled WHERE round = 25) * weight) AS target
  FROM sources),
served AS (
  SELECT s.doc_id, s.source, s.size, s.key, t.source_size, t.target,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
queue AS (
  SELECT doc_id, source, size, key, copy, (done + copy * source_size) / target AS finish
  FROM served, (VALUES (0), (1)) c(copy) WHERE size > 0),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, copy ROWS UNBOUNDED PRECEDING) AS total FROM queue),
counted AS (
  SELECT doc_id, source, size, count(*) AS copies FROM ordered
  WHERE total <= 1.5 * (SELECT sum(size) FROM sized) GROUP BY doc_id, source, size)
SELECT s.doc_id, s.size, s.source_size, s.target, CAST(s.size * coalesce(c.copies, 0) AS BIGINT) AS taken
FROM served s LEFT JOIN counted c ON s.doc_id = c.doc_id AND s.source IS NOT DISTINCT FROM c.source AND s.size = c.size
"""


@query("op6_mix_sources", "documents", sql=MIX_SQL)
def _mix(docs):
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


TOP_SQL = """
WITH used AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, d.v)]) AS BIGINT) AS score
  FROM used q JOIN used d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op7_top_k", "embeddings", sql=TOP_SQL)
def _top_k(vectors):
    used = topk.usable(vectors, "vec_id", "embedding")
    return topk.top_k(used, used.where("id % 50 = 0"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages with altered, lost and doubled records."""
    altered = F.when(F.col("page_id") % 97 == 5, F.concat("html", F.lit("?"))).otherwise(F.col("html"))
    kept = pages.where(~F.coalesce(F.col("page_id") % 211 == 7, F.lit(False)))
    rows = kept.select("page_id", "url", altered.alias("html"))
    return rows.union(rows.where("page_id % 389 = 11"))


def _side(name: str, source: str) -> str:
    digits = ", ".join(
        f"CAST(sum(CAST('0x' || substr(digest, {1 + 15 * i}, {15 if i < 4 else 4}) AS HUGEINT)) AS VARCHAR)" for i in range(5)
    )
    crlf = "chr(13) || chr(10)"
    levels = [f"""{name}0 AS (
  SELECT file, slot AS node, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {digits})) AS hash,
         CAST(min(stop - length) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop
  FROM {name}p GROUP BY file, slot)"""]
    for i in range(3):
        levels.append(f"""{name}{i + 1} AS (
  SELECT file, node // 8 AS node, sha256(string_agg(CAST(node AS VARCHAR) || ':' || hash, '|' ORDER BY node)) AS hash,
         min(start) AS start, max(stop) AS stop
  FROM {name}{i} GROUP BY file, node // 8)""")
    return f"""{name}w AS (
  SELECT page_id // 512 AS file, page_id % 512 AS slot,
         'WARC/1.0' || {crlf} || 'WARC-Type: response' || {crlf} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {crlf}
         || 'WARC-Target-URI: ' || coalesce(url, '') || {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) || {crlf}
         || {crlf} || coalesce(html, '') || {crlf} || {crlf} AS whole
  FROM {source}),
{name}d AS (SELECT file, slot, sha256(whole) AS digest, CAST(strlen(whole) AS BIGINT) AS length FROM {name}w),
{name}p AS (
  SELECT *, sum(length) OVER (PARTITION BY file ORDER BY slot, digest ROWS UNBOUNDED PRECEDING) AS stop FROM {name}d),
{", ".join(levels)}"""


def _pairs(level: int, depth: int, where: str) -> str:
    page = "CAST(NULL AS BIGINT)" if depth == 0 else "file * 512 + node"
    return f"""SELECT file, {page} AS page_id, {depth} AS level,
  CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'extra' WHEN a.hash = b.hash THEN 'same' ELSE 'altered' END AS status,
  a.hash AS hash_a, b.hash AS hash_b, a.start AS begin_a, a.stop AS end_a, b.start AS begin_b, b.stop AS end_b
FROM a{level} a FULL JOIN b{level} b USING (file, node) {where}"""


WARC_SQL = f"""
WITH kept AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 5 THEN html || '?' ELSE html END AS html FROM pages
  WHERE NOT coalesce(page_id % 211 = 7, false)),
other AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE page_id % 389 = 11),
{_side("a", "pages")},
{_side("b", "other")}
{_pairs(3, 0, "")}
UNION ALL
{_pairs(0, 3, "WHERE a.hash IS DISTINCT FROM b.hash")}
"""


@query("op8_warc_fixity", "pages", sql=WARC_SQL)
def _warc(pages):
    return warc.audit(warc.records(pages), warc.records(damaged(pages)))


@query("op9_url_filter", "pages")
def _urls(pages):
    return urls.judge(pages)


@query("op10_pii", "documents")
def _pii(docs):
    return pii.find(docs)


@query("op11_licenses", "documents")
def _licenses(docs):
    return licenses.scan(docs)


@query("op12_whitening", "embeddings")
def _whitening(vectors):
    return whitening.whiten(vectors)


AUDIT_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM words GROUP BY text),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT w.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
         CAST(len(w.w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w.w)) < 80 * len(w.w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text) AS INT)
         + 8 * CAST(regexp_matches(w.text, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(w.doc_id > f.first_id, false) AS INT) AS mask
  FROM words w JOIN firsts f ON w.text = f.text LEFT JOIN marks m ON w.doc_id = m.doc_id),
masks AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM failed GROUP BY part, mask),
letters AS (SELECT substr('ABCDE', i + 1, 1) AS letter, 1 << i AS own FROM (SELECT unnest(range(5)) AS i)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
         [a.own, b.own, c.own, d.own, e.own] AS masks
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.own | b.own | c.own | d.own | e.own = 31),
steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, masks[step] AS own,
         CAST(coalesce(list_sum(masks[1:step - 1]), 0) AS INT) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
rows AS (
  SELECT m.part, s.filter_order, s.step, s.own,
         CAST(sum(CASE WHEN m.mask & (s.before | s.own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN m.mask & s.before = 0 AND m.mask & s.own <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN m.mask & s.before <> 0 AND m.mask & s.own <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN m.mask = s.own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN m.mask & s.before = 0 AND m.mask & s.own <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN m.mask & s.before = 0 AND m.mask & s.own <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM masks m, steps s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM rows
"""


@query("op13_filter_audit", "documents", "labels", sql=AUDIT_SQL)
def _filter_audit(docs, labels):
    return interactions.audit(docs, labels)
