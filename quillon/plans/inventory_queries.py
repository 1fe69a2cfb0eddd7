"""The inventory of typed properties and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import inventory as I
from quillon.operators import markup as M
from quillon.plans.passage_queries import PROPERTIES, md_pages
from quillon.plans.search_queries import query

TYPED = PROPERTIES + """,
typed AS (SELECT key AS property, CASE kind WHEN 'list' THEN 'list<string>' WHEN 'bool' THEN 'boolean' ELSE kind END AS type,
  CASE WHEN kind = 'list' THEN '[' || array_to_string(items, ', ') || ']' ELSE scalar END AS sample FROM properties),
types AS (SELECT property, sum(n)::BIGINT AS n, string_agg(type || ' ' || n, ', ' ORDER BY type) AS types FROM (SELECT property, type, count(*) AS n FROM typed GROUP BY ALL) GROUP BY property),
samples AS (SELECT property, list(sample ORDER BY sha256(sample)) AS samples FROM (SELECT DISTINCT property, sample FROM typed QUALIFY dense_rank() OVER (PARTITION BY property ORDER BY sha256(sample)) <= 5) GROUP BY property)"""


@query(f"WITH {TYPED} SELECT property, n, types, 'wiki-page ' || n AS classes, array_to_string(samples, ' / ') AS samples FROM types JOIN samples USING (property)")
def typed_inventory(spark: SparkSession, d: str) -> DataFrame:
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["name"], x["n"])), ", ")
    found = I.typed_inventory(M.load_frontmatter(md_pages(spark, d))[0])
    return found.select("property", "n", told("types").alias("types"), told("classes").alias("classes"), F.array_join("samples", " / ").alias("samples"))
