"""Queries of filters, changes and releases, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import change as C
from quillon.plans import views as V
from quillon.plans.search_queries import query


@query(f"WITH {V.PAGES} SELECT path, (coalesce(lower(language) = 'de', false) OR coalesce(contains(lower(title), 'the'), false) OR NOT coalesce(verified_by IS NOT NULL, false)) AS selected FROM pages")
def filter_pages(spark: SparkSession, d: str) -> DataFrame:
    return C.filter_pages(V.pages(spark, d), [("language", "equals", "DE"), ("title", "contains", "THE"), ("verified_by", "not_exists")], "or").select("path", "selected")


@query(f"WITH {V.PAGES} SELECT path, regexp_extract(path, '^(.*)/', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS filename, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\\.([^.]*)$', 1) AS extension FROM pages")
def virtual_properties(spark: SparkSession, d: str) -> DataFrame:
    return C.virtual_properties(V.pages(spark, d))


PLAN = "plan AS (SELECT path, coalesce(status, '') AS before, CASE WHEN stale_after < DATE '2024-12-31' THEN 'superseded' ELSE coalesce(status, '') END AS after FROM pages WHERE language = 'en')"


def _plan(pages: DataFrame) -> DataFrame:
    return C.plan_property(pages, F.col("language") == "en", "status", F.when(F.col("stale_after") < "2024-12-31", "superseded").otherwise(F.col("status")))


@query(f"WITH {V.PAGES}, {PLAN} SELECT path, before, after, before <> after AS changed, sha256(before) AS before_hash FROM plan")
def property_actions(spark: SparkSession, d: str) -> DataFrame:
    return _plan(V.pages(spark, d))


@query(f"WITH {V.PAGES}, {PLAN} SELECT path, coalesce(after, status) AS status FROM pages LEFT JOIN plan USING (path)")
def apply_plan(spark: SparkSession, d: str) -> DataFrame:
    pages = V.pages(spark, d)
    return C.apply_plan(pages, _plan(pages), "status")[0].select("path", "status")


@query(f"WITH {V.RELEASES} SELECT path, sha256(content) AS sha256, strlen(content)::BIGINT AS bytes FROM v1")
def build_manifest(spark: SparkSession, d: str) -> DataFrame:
    return C.build_manifest(V.release(spark, d, 1))


DIFF = V.RELEASES + """,
diff AS (SELECT coalesce(v1.path, v2.path) AS path, CASE WHEN v1.path IS NULL THEN 'added' WHEN v2.path IS NULL THEN 'removed' WHEN sha256(v1.content) <> sha256(v2.content) THEN 'changed' ELSE 'same' END AS change FROM v1 FULL JOIN v2 ON v1.path = v2.path)"""


@query(f"WITH {DIFF} SELECT * FROM diff")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return C.snapshot_diff(*(C.build_manifest(V.release(spark, d, v)) for v in (1, 2)))


@query(f"""WITH {DIFF} SELECT CASE WHEN count(*) FILTER (change <> 'same') = 0 THEN 'ready' ELSE 'snapshot_changed' END AS state, count(*) FILTER (change = 'removed') AS missing, count(*) FILTER (change = 'changed') AS changed,
count(*) FILTER (change = 'added') AS unexpected FROM diff""")
def verify_manifest(spark: SparkSession, d: str) -> DataFrame:
    return C.verify_manifest(C.build_manifest(V.release(spark, d, 1)), V.release(spark, d, 2))


@query(f"WITH {V.RELEASES} SELECT path, CASE WHEN v2.content IS NULL THEN NULL ELSE sha256(v2.content) END AS before, sha256(v1.content) AS after FROM v1 LEFT JOIN v2 USING (path) WHERE v2.content IS NULL OR sha256(v1.content) <> sha256(v2.content)")
def restore_plan(spark: SparkSession, d: str) -> DataFrame:
    return C.restore_plan(C.build_manifest(V.release(spark, d, 1)), V.release(spark, d, 2), with_missing=True)


@query(f"WITH {V.RELEASES} SELECT 's1' AS snapshot_id, path, sha256(content) AS sha256, strlen(content)::BIGINT AS bytes FROM v1 WHERE path IN (SELECT path FROM chosen)".replace("v2 AS", "chosen AS (SELECT 'wiki/' || doc_id || '.md' AS path FROM documents WHERE lang = 'en'), v2 AS"))
def snapshot_table(spark: SparkSession, d: str) -> DataFrame:
    chosen = V.table(spark, d, "documents").where("lang = 'en'").select(F.concat(F.lit("wiki/"), "doc_id", F.lit(".md")).alias("path"))
    return C.snapshot_table(V.release(spark, d, 1), "s1", chosen).drop("content")


@query(f"WITH {V.RELEASES} SELECT coalesce(v1.path, v2.path) AS path, sha256(coalesce(v1.content, v2.content)) AS sha256 FROM v1 FULL JOIN v2 ON v1.path = v2.path")
def restore(spark: SparkSession, d: str) -> DataFrame:
    old, new = C.snapshot_table(V.release(spark, d, 1), "s1"), V.release(spark, d, 2)
    return C.build_manifest(C.restore(new, old, C.restore_plan(old, new, with_missing=True), "s2")[0]).drop("bytes")


@query(f"""WITH {V.SOURCES}, numbered AS (SELECT source_no, source_id, text, row_number() OVER (PARTITION BY source_id ORDER BY source_no) AS n FROM sources),
known AS (SELECT DISTINCT source_id FROM sources WHERE source_no % 7 = 0)
SELECT source_no, source_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN n > 1 OR source_id IN (SELECT source_id FROM known) THEN 'duplicate' ELSE 'registered' END AS outcome FROM numbered""")
def register_sources(spark: SparkSession, d: str) -> DataFrame:
    sources = V.sources(spark, d)
    return C.register_sources(sources, sources.where("source_no % 7 = 0"))


@query(f"WITH {V.PAGES} SELECT path, verified_by AS before, 'human:editor' AS after FROM pages WHERE status = 'draft' AND NOT ends_with(path, 'index.md')")
def mark_verified(spark: SparkSession, d: str) -> DataFrame:
    return C.mark_verified(V.pages(spark, d), F.col("status") == "draft", "human:editor")


@query(f"WITH {V.PAGES}, {V.LINKS} SELECT l.path, target_id, target_id + 5000000 AS new_target_id FROM links l JOIN pages p ON p.page_id = l.target_id WHERE p.status = 'superseded'")
def move_page(spark: SparkSession, d: str) -> DataFrame:
    moves = V.pages(spark, d).where("status = 'superseded'").select("page_id", (F.col("page_id") + 5_000_000).alias("new_id"))
    return C.move_page(V.links(spark, d), moves)


@query(f"""WITH {V.CLAIMS}, fresh AS (SELECT path, line_no, text, 'clm-' || substr(sha256(concat_ws(':', path, line_no, text)), 1, 16) AS new FROM claims WHERE kind = 'opinion') SELECT path, line_no, new AS claim_id FROM fresh""")
def assign_claim_ids(spark: SparkSession, d: str) -> DataFrame:
    claims = V.claims(spark, d)
    return C.assign_claim_ids(claims.withColumn("claim_id", F.when(F.col("kind") != "opinion", F.col("claim_id"))))
