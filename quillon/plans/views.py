"""The collection the queries work on, derived from the driver tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import tokens, tokens_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """path, page_id, title, description, status, type, language, cluster, concept, updated, stale_after, verified_by, body."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    updated = F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int"))
    checked = F.when(F.col("quality") == 1, F.concat(F.lit("human:r"), i % 7)).when(F.col("quality") == 0, "process:q")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("wiki/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), i.alias("page_id"), lines[0].alias("title"),
        F.substring(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), 1, 140).alias("description"),
        F.when(i % 10 == 0, "superseded").when(i % 10 == 1, "draft").otherwise("active").alias("status"),
        F.element_at(F.array(*map(F.lit, ("topic", "process", "decision", "reference"))), (i % 4 + 1).cast("int")).alias("type"),
        F.col("lang").alias("language"), F.col("source").alias("cluster"), F.concat(F.lit("c"), i % 25).alias("concept"), updated.alias("updated"),
        F.when(i % 3 == 0, F.date_add(updated, (i % 400).cast("int"))).alias("stale_after"), checked.alias("verified_by"), F.coalesce("text", F.lit("")).alias("body"))


PAGES = """
pages AS (SELECT 'wiki/' || source || '/' || doc_id || '.md' AS path, doc_id AS page_id, string_split(coalesce(text, ''), chr(10))[1] AS title,
  substr(coalesce(string_split(coalesce(text, ''), chr(10))[2], ''), 1, 140) AS description,
  CASE WHEN doc_id % 10 = 0 THEN 'superseded' WHEN doc_id % 10 = 1 THEN 'draft' ELSE 'active' END AS status,
  ['topic', 'process', 'decision', 'reference'][(doc_id % 4 + 1)::INT] AS type, lang AS language, source AS cluster, 'c' || (doc_id % 25) AS concept,
  DATE '2024-01-01' + (doc_id % 365)::INT AS updated, CASE WHEN doc_id % 3 = 0 THEN DATE '2024-01-01' + (doc_id % 365)::INT + (doc_id % 400)::INT END AS stale_after,
  CASE WHEN quality = 1 THEN 'human:r' || (doc_id % 7) WHEN quality = 0 THEN 'process:q' END AS verified_by, coalesce(text, '') AS body
  FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id))"""


def claims(spark: SparkSession, d: str) -> DataFrame:
    """path, page_id, line_no, claim_id, kind, status, replaces, text: a claim for each line with text."""
    rows = table(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text")).where("text <> ''")
    i, n = F.col("doc_id"), F.col("line_no")
    name = lambda no: F.concat(F.lit("clm-"), F.substring(F.sha2(F.concat(i, F.lit(":"), no), 256), 1, 16))
    turn = (i + n) % 8
    status = F.when(turn == 0, "disputed").when(turn == 1, "superseded").when(turn == 2, "unsupported").otherwise("active")
    return rows.select(
        F.concat(F.lit("wiki/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), i.alias("page_id"), n.cast("long").alias("line_no"), name(n).alias("claim_id"),
        F.element_at(F.array(*map(F.lit, ("fact", "decision", "estimate", "rule", "opinion"))), (n % 5 + 1).cast("int")).alias("kind"), status.alias("status"),
        F.when((turn == 1) & (n > 0), name(n - 1)).alias("replaces"), "text")


CLAIMS = """
claim_lines AS (SELECT source, doc_id, (i - 1) AS n, text FROM (SELECT source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE text <> ''),
claims AS (SELECT 'wiki/' || source || '/' || doc_id || '.md' AS path, doc_id AS page_id, n::BIGINT AS line_no, 'clm-' || substr(sha256(doc_id || ':' || n), 1, 16) AS claim_id,
  ['fact', 'decision', 'estimate', 'rule', 'opinion'][(n % 5 + 1)::INT] AS kind,
  CASE (doc_id + n) % 8 WHEN 0 THEN 'disputed' WHEN 1 THEN 'superseded' WHEN 2 THEN 'unsupported' ELSE 'active' END AS status,
  CASE WHEN (doc_id + n) % 8 = 1 AND n > 0 THEN 'clm-' || substr(sha256(doc_id || ':' || (n - 1)), 1, 16) END AS replaces, text FROM claim_lines)"""

def sources(spark: SparkSession, d: str) -> DataFrame:
    """source_no, source_id, unit_kind, text: benchmark passages and documents."""
    bench = table(spark, d, "benchmark").select((F.col("item_id") * 2).alias("source_no"), "text")
    docs = table(spark, d, "documents").select((F.col("doc_id") * 2 + 1).alias("source_no"), F.coalesce("text", F.lit("")).alias("text"))
    rows = bench.unionByName(docs)
    return rows.select("source_no", F.concat(F.lit("src-"), F.substring(F.sha2("text", 256), 1, 16)).alias("source_id"), F.when(F.col("source_no") % 4 < 2, "page").otherwise("section").alias("unit_kind"), "text")


SOURCES = """
sources AS (SELECT source_no, 'src-' || substr(sha256(text), 1, 16) AS source_id, CASE WHEN source_no % 4 < 2 THEN 'page' ELSE 'section' END AS unit_kind, text
  FROM (SELECT item_id * 2 AS source_no, text FROM benchmark UNION ALL SELECT doc_id * 2 + 1, coalesce(text, '') FROM documents))"""


def citations(spark: SparkSession, d: str) -> DataFrame:
    """claim_id, claim_status, source_no, locator: each claim but an opinion cites one source; some cite one that is not there."""
    n_bench, n_docs = table(spark, d, "benchmark").count(), table(spark, d, "documents").count()
    n, k = F.col("page_id") * 31 + F.col("line_no"), F.col("line_no") % 7
    of = F.when(n % 50 == 0, F.lit(-1)).when(n % 2 == 0, n % n_bench * 2).otherwise(n % n_docs * 2 + 1)
    a = (n % 3 + 1).cast("string")
    locator = F.when(k == 0, F.concat(F.lit("page="), a)).when(k == 1, F.concat(F.lit("page=2-"), a)).when(k == 2, "document").when(k == 3, "see above")
    locator = locator.when(k == 4, F.concat(F.lit("Section = "), a)).when(k == 5, F.concat(F.lit("slide="), a)).otherwise(F.concat(F.lit("page=1-"), a))
    return claims(spark, d).where("kind <> 'opinion'").select("claim_id", F.col("status").alias("claim_status"), of.cast("long").alias("source_no"), locator.alias("locator"))


CITATIONS = CLAIMS + """,
citations AS (SELECT claim_id, status AS claim_status, (CASE WHEN n % 50 = 0 THEN -1 WHEN n % 2 = 0 THEN n % (SELECT count(*) FROM benchmark) * 2 ELSE n % (SELECT count(*) FROM documents) * 2 + 1 END)::BIGINT AS source_no,
  CASE line_no % 7 WHEN 0 THEN 'page=' || a WHEN 1 THEN 'page=2-' || a WHEN 2 THEN 'document' WHEN 3 THEN 'see above' WHEN 4 THEN 'Section = ' || a WHEN 5 THEN 'slide=' || a ELSE 'page=1-' || a END AS locator
  FROM (SELECT *, page_id * 31 + line_no AS n, (page_id * 31 + line_no) % 3 + 1 AS a FROM claims WHERE kind <> 'opinion'))"""


def links(spark: SparkSession, d: str) -> DataFrame:
    """path, page_id, target_id: three links a page; some lead nowhere."""
    docs = table(spark, d, "documents")
    n = docs.count()
    rows = docs.select(F.concat(F.lit("wiki/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.col("doc_id").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return rows.select("path", "page_id", F.when((F.col("page_id") % 97 == 0) & (F.col("k") == 0), F.col("page_id") + 10**9).otherwise((F.col("page_id") * 7 + F.col("k")) % n).alias("target_id"))


LINKS = """
links AS (SELECT 'wiki/' || source || '/' || doc_id || '.md' AS path, doc_id AS page_id,
  CASE WHEN doc_id % 97 = 0 AND k = 0 THEN doc_id + 1000000000 ELSE (doc_id * 7 + k) % (SELECT count(*) FROM documents) END AS target_id
  FROM documents, (SELECT unnest([0, 1, 2]) AS k) ks)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    """fid, text: the first six tokens of each benchmark passage."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("fid"), F.array_join(F.slice(tokens(F.col("text")), 1, 6), " ").alias("text"))


QUESTIONS = f"""
questions AS (SELECT item_id AS fid, array_to_string(({tokens_sql("text")})[1:6], ' ') AS text FROM benchmark)"""


def formulations(spark: SparkSession, d: str) -> DataFrame:
    """qid, no, text: the question (0), tokens 4-9 and 7-12, a repeat of the question and an empty one."""
    t = tokens(F.col("text"))
    part = lambda a: F.array_join(F.slice(t, a, 6), " ")
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("no"), x.alias("text")) for i, x in enumerate((part(1), part(4), part(7), F.upper(part(1)), F.lit("")))))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.inline(rows))


FORMULATIONS = f"""
formulations AS (SELECT item_id AS qid, u.no::BIGINT AS no, u.text AS text FROM (SELECT item_id, unnest([{{'no': 0, 'text': array_to_string(t[1:6], ' ')}}, {{'no': 1, 'text': array_to_string(t[4:9], ' ')}}, {{'no': 2, 'text': array_to_string(t[7:12], ' ')}}, {{'no': 3, 'text': upper(array_to_string(t[1:6], ' '))}}, {{'no': 4, 'text': ''}}]) AS u
  FROM (SELECT item_id, {tokens_sql("text")} AS t FROM benchmark)))"""


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """collection, kind, reviewed_at, review_id, outcome."""
    e = table(spark, d, "events").where("event_type IN ('signup', 'purchase')")
    return e.select(F.col("user_id").alias("collection"), F.when(F.col("event_type") == "signup", "quality").otherwise("cleaning").alias("kind"), F.col("ts").alias("reviewed_at"), F.col("event_id").alias("review_id"),
                    F.element_at(F.array(*map(F.lit, ("passed", "findings", "failed"))), (F.col("event_id") % 3 + 1).cast("int")).alias("outcome"))


REVIEWS = """
reviews AS (SELECT user_id AS collection, CASE WHEN event_type = 'signup' THEN 'quality' ELSE 'cleaning' END AS kind, ts AS reviewed_at, event_id AS review_id,
  ['passed', 'findings', 'failed'][(event_id % 3 + 1)::INT] AS outcome FROM events WHERE event_type IN ('signup', 'purchase'))"""


def release(spark: SparkSession, d: str, version: int) -> DataFrame:
    """path, content of a release; version 2 drops, alters and adds pages."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    at = lambda i: F.concat(F.lit("wiki/"), i, F.lit(".md"))
    i = F.col("doc_id")
    if version == 1:
        return docs.select(at(i).alias("path"), "content")
    kept = docs.where(i % 50 != 0).select(at(i).alias("path"), F.when(i % 31 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return kept.unionByName(docs.where(i % 40 == 0).select(at(i + 10**9).alias("path"), "content"))


RELEASES = """
v1 AS (SELECT 'wiki/' || doc_id || '.md' AS path, coalesce(text, '') AS content FROM documents),
v2 AS (SELECT 'wiki/' || doc_id || '.md' AS path, CASE WHEN doc_id % 31 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END AS content FROM documents WHERE doc_id % 50 <> 0
  UNION ALL SELECT 'wiki/' || (doc_id + 1000000000) || '.md', coalesce(text, '') FROM documents WHERE doc_id % 40 = 0)"""
