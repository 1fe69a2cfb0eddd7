"""Queries of the gate over search quality, and their SQL.

A page is required if it holds tokens 7 to 14 of a passage in a row, whose first six tokens are the question; the recorded
ranking is the one without phrases and status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.settled import settled
from quillon.functions.text import tokens, tokens_sql
from quillon.operators import gate as G
from quillon.operators import search as S
from quillon.plans import views as V
from quillon.plans.search_queries import SIGNALS, query

FLOORS, CAPS = {"required_first_result": 5, "all_must_find_within_12": 5}, {"negative_results_within_12": 1000, "navigation_in_top_3": 2}


def truth(spark: SparkSession, d: str) -> DataFrame:
    """fid, path: pages by runs of eight tokens, met by an equality join on one of them."""
    asked = V.table(spark, d, "benchmark").select(F.col("item_id").alias("fid"), tokens(F.col("text")).alias("t")).where(F.size("t") >= 14).select("fid", F.slice("t", 7, 8).alias("run"))
    return G.holders_of_runs(V.pages(spark, d).select("path", tokens(F.col("body")).alias("t")), asked)


def accepted(required: DataFrame) -> DataFrame:
    return required.where("fid % 4 < 2").select("fid", "path", F.when(F.col("fid") % 4 == 1, 12).alias("accepted_rank"))


TRUTH = SIGNALS + f""",
runs AS (SELECT item_id AS fid, ' ' || array_to_string(t[7:14], ' ') || ' ' AS run FROM (SELECT item_id, {tokens_sql("text")} AS t FROM benchmark) WHERE len(t) >= 14),
truth AS (SELECT fid, path FROM runs, (SELECT path, ' ' || array_to_string({tokens_sql("body")}, ' ') || ' ' AS body FROM pages) WHERE contains(body, run)),
recorded AS (SELECT fid, path, row_number() OVER (PARTITION BY fid ORDER BY round(score, 2) DESC, path) AS rank FROM scores),
need AS (SELECT t.fid, t.path, CASE WHEN c.rank <= 100 THEN c.rank END AS was, CASE WHEN r.rank <= 100 THEN r.rank END AS now FROM truth t LEFT JOIN recorded c USING (fid, path) LEFT JOIN ranked r ON r.fid = t.fid AND r.path = t.path),
per AS (SELECT fid, min(now) AS first, max(coalesce(now, 101)) AS last FROM need GROUP BY fid),
shown AS (SELECT fid, count(*) FILTER (rank <= 12) AS results, count(*) FILTER (rank <= 3 AND regexp_matches(path, '1[.]md$')) AS nav FROM ranked GROUP BY fid),
total AS (SELECT count(last) AS a, count(*) - count(last) AS n, count(*) FILTER (first = 1) AS f, count(*) FILTER (last <= 3) AS w3, count(*) FILTER (last <= 12) AS w12, count(*) FILTER (last <= 100) AS w100,
  coalesce(sum(results) FILTER (last IS NULL), 0)::BIGINT AS neg, coalesce(sum(nav), 0)::BIGINT AS nav FROM questions LEFT JOIN per USING (fid) LEFT JOIN shown USING (fid)),
metrics AS (SELECT unnest(['answerable_queries', 'negative_queries', 'required_first_result', 'all_must_find_within_3', 'all_must_find_within_12', 'all_must_find_within_100', 'negative_results_within_12', 'navigation_in_top_3']) AS metric,
  unnest([a, n, f, w3, w12, w100, neg, nav]) AS value FROM total)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    pages, questions = V.pages(spark, d), V.questions(spark, d)
    return G.quality_metrics(S.ranking(pages, questions, limit=G.RANK_LIMIT), questions, truth(spark, d), F.col("path").rlike("1[.]md$"))


@query(f"WITH {TRUTH} SELECT metric, value FROM metrics")
def search_quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d)


BOUNDS = ", ".join(f"('{k}', {FLOORS.get(k, 'NULL')}, {CAPS.get(k, 'NULL')})" for k in (*FLOORS, *CAPS))


@query(f"""WITH {TRUTH} SELECT metric, value, floor::BIGINT AS floor, cap::BIGINT AS cap, value >= coalesce(floor, value) AND value <= coalesce(cap, value) AS held FROM metrics JOIN (VALUES {BOUNDS}) b(metric, floor, cap) USING (metric)""")
def search_quality_bounds(spark: SparkSession, d: str) -> DataFrame:
    return G.held_bounds(_metrics(spark, d), FLOORS, CAPS)


@query(f"""WITH {TRUTH}, told AS (SELECT *, fid % 4 = 0 AS exempt, CASE WHEN fid % 4 = 0 THEN NULL WHEN fid % 4 = 1 AND was < 12 THEN 12 ELSE was END AS held FROM need)
SELECT fid, path, 1 AS bound, was AS held, now FROM told t WHERE was = 1 AND fid % 4 >= 2 AND NOT EXISTS (SELECT 1 FROM need n WHERE n.fid = t.fid AND n.now = 1)
UNION ALL SELECT fid, path, CASE WHEN held <= 3 AND coalesce(now, 101) > 3 THEN 3 ELSE 12 END, held, now FROM told WHERE (held <= 3 AND coalesce(now, 101) > 3) OR (held <= 12 AND coalesce(now, 101) > 12)""")
def rank_regressions(spark: SparkSession, d: str) -> DataFrame:
    pages, questions = V.pages(spark, d), V.questions(spark, d)
    required = settled(truth(spark, d))
    # both rankings read the same scores
    terms = S.query_term_plan(questions).where("dropped IS NULL").select("fid", "term")
    fields, wanted = S.split_fields(pages), S.wanted_members(S.split_fields(pages), terms)
    scores = S.page_scores(pages, terms, wanted, settled(S.asked_postings(fields, wanted)), levels=False)
    found = G.rank_regressions(S.signalled(scores, pages, questions, G.RANK_LIMIT), S.plain_ranks(scores, G.RANK_LIMIT), required, accepted(required))
    return found.withColumns({x: F.col(x).cast("long") for x in ("held", "now")})
