"""Queries of quantities and concepts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import fold_sql, normalize_sql, stem_sql, tokens, tokens_sql
from quillon.operators import quantities as Q
from quillon.operators import search as S
from quillon.plans import views as V
from quillon.plans.search_queries import SIGNALS, STATUS, TERMS, query

def cased(column: str, given: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in given.items()) + " END"


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def amount_pages(pages: DataFrame) -> DataFrame:
    """Pages with a line of amounts in several notations, and of numbers that are none, behind the text."""
    n = F.col("page_id") % 50
    return pages.withColumn("body", F.concat("body", F.lit("\n"), n, F.lit(" MWh, § 3 Monate, "), n, F.lit(" Monate, zwischen 10 € und "), n, F.lit(" €, zwei bis "), n, F.lit(" Prozent, EUR 2.500,"), n, F.lit(", minus "), n, F.lit(" %, drei Wochen")))


AMOUNT_PAGES = "amount_pages AS (SELECT path, body || chr(10) || n || ' MWh, § 3 Monate, ' || n || ' Monate, zwischen 10 € und ' || n || ' €, zwei bis ' || n || ' Prozent, EUR 2.500,' || n || ', minus ' || n || ' %, drei Wochen' AS body FROM (SELECT *, page_id % 50 AS n FROM pages))"


@query(f"""WITH {V.PAGES}, {AMOUNT_PAGES}, spans AS (SELECT path, unnest(regexp_extract_all({normalize_sql("body")}, '{quoted(Q.SPAN)}')) AS q FROM amount_pages),
forms AS (SELECT path, regexp_extract(q, '{quoted(Q.MONEY)}', 1) AS money, regexp_extract(q, '{quoted(Q.ACCEPTED)}', 1) AS number, regexp_extract(q, '{quoted(Q.ACCEPTED)}', 2) AS u FROM spans),
told AS (SELECT path, CASE WHEN money <> '' THEN money ELSE number END AS n, CASE WHEN money <> '' THEN 'eur' ELSE u END AS u FROM forms WHERE money <> '' OR number <> ''),
amounts AS (SELECT path, u, coalesce({cased("n", Q.NUMBER_WORDS)}::DECIMAL(21,6), try_cast(replace(CASE WHEN regexp_full_match(n, '{quoted(Q.GROUPED)}') THEN regexp_replace(n, '[. ''’]', '', 'g') ELSE n END, ',', '.') AS DECIMAL(21,6)))
  * coalesce({cased("u", {k: f"{10.0**p:.3f}" for k, (_, p) in Q.UNITS.items()})}, 1.000)::DECIMAL(13,3) AS value FROM told),
named AS (SELECT path, value::DECIMAL(38,9) AS value, {cased("u", {k: f"'{u}'" for k, u in Q.CANONICAL.items()})} AS unit FROM amounts
  WHERE value IS NOT NULL AND (u NOT IN ({", ".join(f"'{x}'" for x in Q.COUNT_UNITS)}) OR value IN ({", ".join(map(str, Q.NUMBER_WORDS.values()))})))
SELECT path, value::DOUBLE AS value, unit, '=' || regexp_replace(value::VARCHAR, '\\.?0+$', '') || unit AS token FROM named""")
def extract_quantities(spark: SparkSession, d: str) -> DataFrame:
    return Q.extract_quantities(amount_pages(V.pages(spark, d)))


CONCEPTS = f"""
named AS (SELECT 'c' || item_id AS concept_id, 0::BIGINT AS no, ({tokens_sql("text")})[2:3] AS w FROM benchmark UNION ALL SELECT 'c' || item_id, 1, ({tokens_sql("text")})[5:5] FROM benchmark),
concepts AS (SELECT concept_id, no, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS ord FROM named)"""


TRIGGERED = f"""
met AS (SELECT DISTINCT fid, concept_id, no, c.ord, t.ord - c.ord AS start FROM terms t, concepts c WHERE list_has_any([term, {fold_sql("term")}, {stem_sql("term")}], [word, {fold_sql("word")}, {stem_sql("word")}])),
runs AS (SELECT fid, concept_id, no, start FROM met m JOIN (SELECT concept_id, no, count(*) AS width FROM concepts GROUP BY ALL) USING (concept_id, no) GROUP BY fid, concept_id, no, start, width HAVING count(*) = width)"""


@query(f"WITH {TERMS}, {CONCEPTS}, {TRIGGERED} SELECT fid, concept_id, arg_min(start, struct_pack(no := no, start := start)) AS start FROM runs GROUP BY ALL")
def concept_trigger(spark: SparkSession, d: str) -> DataFrame:
    bench = V.table(spark, d, "benchmark").select(F.concat(F.lit("c"), "item_id").alias("concept_id"), tokens(F.col("text")).alias("t"))
    parts = [bench.select("concept_id", F.lit(no).cast("long").alias("no"), F.posexplode(F.slice("t", a, n)).alias("ord", "word")) for no, (a, n) in enumerate(((2, 2), (5, 1)))]
    concepts = parts[0].unionByName(parts[1]).withColumn("ord", F.col("ord").cast("long"))
    return Q.concept_trigger(S.query_term_plan(V.questions(spark, d)).select("fid", "ord", "term"), concepts)


@query(f"""WITH {SIGNALS}, {CONCEPTS}, {TRIGGERED} SELECT s.fid, s.path, round(score * CASE WHEN phrase THEN 1.5 ELSE 1.0 END * CASE WHEN (s.fid, concept) IN (SELECT (fid, concept_id) FROM runs) THEN 1.5 ELSE 1.0 END * {STATUS}, 4) AS score
FROM scores s JOIN pages USING (path) JOIN phrases p ON p.fid = s.fid AND p.path = s.path""")
def score_signals(spark: SparkSession, d: str) -> DataFrame:
    pages, questions = V.pages(spark, d), V.questions(spark, d)
    fields, terms = S.split_fields(pages), S.query_term_plan(questions).where("dropped IS NULL")
    wanted = terms.select("fid", "term", F.col("term").alias("token"), F.lit(1.0).alias("weight"))
    found = S.postings(fields).join(wanted.select("token").distinct(), "token", "left_semi")
    scores = S.bm25f_score(found, S.term_groups(wanted, found), S.corpus_stats(pages, fields))
    told = S.score_signals(scores, pages, S.phrase_match(questions, pages, scores), concept_trigger(spark, d))
    return told.withColumn("score", F.round("score", 4))
