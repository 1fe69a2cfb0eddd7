"""Queries of links in texts, actions on properties and streamed logs, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.settled import shared_folder
from quillon.operators import links as K
from quillon.operators import properties as A
from quillon.plans import views as V
from quillon.plans.governance_queries import LATEST
from quillon.plans.search_queries import query
from quillon.streaming import logs


def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    """path, body: texts with a link by path, one with ending, anchor and label, one by ./ and for some one that leads nowhere."""
    docs = V.table(spark, d, "documents")
    n, i = docs.count(), F.col("doc_id")
    tail = F.concat(F.lit("\nSee [[wiki/"), (i * 7) % n, F.lit("]], [[wiki/"), (i * 3 + 1) % n, F.lit(".md#part|the other]]\nand [[./wiki/"), (i * 5) % n, F.lit("|x]]"), F.when(i % 97 == 0, " or [[gone/page#a]]").otherwise(""), F.lit("."))
    return docs.select(F.concat(F.when(i % 13 == 0, "sources/").otherwise("wiki/"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.coalesce("text", F.lit("")), tail).alias("body"))


LINKED_PAGES = """
n AS (SELECT count(*) AS n FROM documents),
links AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'sources/' ELSE 'wiki/' END || doc_id || '.md' AS path, doc_id, unnest([
    {'ord': 0, 'target': 'wiki/' || (doc_id * 7 % n), 'anchor': '', 'label': NULL::VARCHAR}, {'ord': 1, 'target': 'wiki/' || ((doc_id * 3 + 1) % n), 'anchor': '#part', 'label': 'the other'}, {'ord': 2, 'target': 'wiki/' || (doc_id * 5 % n), 'anchor': '', 'label': 'x'},
    CASE WHEN doc_id % 97 = 0 THEN {'ord': 3, 'target': 'gone/page', 'anchor': '#a', 'label': NULL} END], recursive := true) FROM documents, n),
names AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'sources/' ELSE 'wiki/' END || doc_id AS target FROM documents)"""


@query(f"WITH {LINKED_PAGES} SELECT path, ord, target, anchor, label, target IN (SELECT target FROM names) AS resolved, target NOT IN (SELECT target FROM names) AND NOT starts_with(path, 'sources/') AS broken FROM links WHERE ord IS NOT NULL")
def text_links(spark: SparkSession, d: str) -> DataFrame:
    return K.resolved_links(linked_pages(spark, d))


@query("""WITH n AS (SELECT count(*) AS n FROM documents), ids AS (SELECT doc_id, coalesce(text, '') AS text, doc_id * 7 % n AS a, (doc_id * 3 + 1) % n AS b, doc_id * 5 % n AS c FROM documents, n),
moved AS (SELECT doc_id AS m FROM documents WHERE doc_id % 50 = 1 AND doc_id % 13 <> 0),
hit AS (SELECT *, a IN (SELECT m FROM moved) AS ma, b IN (SELECT m FROM moved) AS mb, c IN (SELECT m FROM moved) AS mc FROM ids)
SELECT CASE WHEN doc_id IN (SELECT m FROM moved) THEN 'wiki/moved/' WHEN doc_id % 13 = 0 THEN 'sources/' ELSE 'wiki/' END || doc_id || '.md' AS path, CASE WHEN doc_id % 13 = 0 THEN 'sources/' ELSE 'wiki/' END || doc_id || '.md' AS old_path, ma::INT + mb::INT + mc::INT AS n_links,
  sha256(text || chr(10) || 'See [[wiki/' || CASE WHEN ma THEN 'moved/' ELSE '' END || a || ']], [[wiki/' || CASE WHEN mb THEN 'moved/' || b ELSE b || '.md' END || '#part|the other]]' || chr(10) || 'and [[' || CASE WHEN mc THEN 'wiki/moved/' ELSE './wiki/' END || c || '|x]]' || CASE WHEN doc_id % 97 = 0 THEN ' or [[gone/page#a]]' ELSE '' END || '.') AS body_sha256 FROM hit""")
def move_page_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = linked_pages(spark, d)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    moves = pages.where(F.col("path").startswith("wiki/") & (number % 50 == 1)).select(F.col("path").alias("from_path"), F.regexp_replace("path", "^wiki/", "wiki/moved/").alias("to_path"))
    return K.moved_pages(pages, moves).select("path", "old_path", "n_links", F.sha2("body", 256).alias("body_sha256"))


def property_pages(spark: SparkSession, d: str) -> DataFrame:
    """path, props: pages with tags, a topic, an old topic and links, of several kinds."""
    i = F.col("doc_id")
    text, none = (lambda x: A.value("string", x)), F.lit(None).cast(A.VALUE)
    link = lambda k, tail: F.concat(F.lit("[["), F.concat(F.lit("wiki/"), k), F.lit(tail), F.lit("]]"))
    entries = F.array(
        F.struct(F.lit("tags").alias("k"), F.when(i % 4 == 0, none).when(i % 4 == 1, text(F.col("source"))).otherwise(A.value("list", items=F.array("lang", F.concat(F.lit(" "), F.upper("source")), "lang"))).alias("v")),
        F.struct(F.lit("topic").alias("k"), F.when(i % 3 == 0, none).when(i % 3 == 1, text(F.lit(""))).otherwise(text(F.col("lang"))).alias("v")),
        F.struct(F.lit("related").alias("k"), A.value("list", items=F.array(link(i, ""), link(i, ".md"), link(i + 1, "|next"), F.concat(F.lit("[["), i, F.lit("]]")))).alias("v")),
    )
    filled = F.filter(entries, lambda e: e["v"].isNotNull())
    return V.table(spark, d, "documents").select(F.concat(F.lit("wiki/"), "doc_id", F.lit(".md")).alias("path"), F.map_from_entries(filled).alias("props"))


def shown(plan: DataFrame, name: str) -> DataFrame:
    """A plan with one property of its pages as text: kind and items."""
    v = A.of(F.col("after"), name)
    told = F.concat_ws(":", v["kind"], F.coalesce(F.array_join(v["items"], ","), v["scalar"]))
    return plan.select("path", "changed", "skipped_reason", F.when(v.isNotNull(), told).otherwise("-").alias("value"), F.size("after").cast("long").alias("n_properties"))


ONE_PAGE = """
p AS (SELECT 'wiki/' || doc_id || '.md' AS path, doc_id, source, lang, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN [source] ELSE [lang, ' ' || upper(source)] END AS tags, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lang END AS topic FROM documents)"""


@query(f"""WITH {ONE_PAGE} SELECT path, topic IS NOT NULL AS changed, CASE WHEN topic IS NULL THEN 'no source property present' ELSE '' END AS skipped_reason, (1 + (tags IS NOT NULL)::INT + (topic IS NOT NULL AND tags IS NULL)::INT)::BIGINT AS n_properties,
CASE WHEN tags IS NULL THEN coalesce('string:' || topic, '-') WHEN topic IS NULL THEN CASE WHEN doc_id % 4 = 1 THEN 'string:' || source ELSE 'list:' || array_to_string([lang, ' ' || upper(source), lang], ',') END
  ELSE 'list:' || array_to_string(CASE WHEN list_contains(tags, topic) THEN tags ELSE list_append(tags, topic) END, ',') END AS value FROM p""")
def property_merge(spark: SparkSession, d: str) -> DataFrame:
    return shown(A.plan_action(property_pages(spark, d), F.lit(True), {"type": "merge", "from_properties": ["topic"], "to_property": "tags"}), "tags")


@query(f"""WITH {ONE_PAGE} SELECT path, tags IS NOT NULL AND doc_id % 4 <> 1 AS changed, CASE WHEN tags IS NULL THEN 'property not present' WHEN doc_id % 4 = 1 THEN 'no value change' ELSE '' END AS skipped_reason, (1 + (tags IS NOT NULL)::INT + (topic IS NOT NULL)::INT)::BIGINT AS n_properties,
CASE WHEN tags IS NULL THEN '-' WHEN doc_id % 4 = 1 THEN 'string:' || source ELSE 'list:' || lang || ',' || lower(source) END AS value
FROM (SELECT * REPLACE (CASE lang WHEN 'en' THEN 'english' ELSE lang END AS lang) FROM p)""")
def property_normalize(spark: SparkSession, d: str) -> DataFrame:
    action = {"type": "normalize_values", "property": "tags", "transforms": ["trim", "lowercase"], "mappings": [("en", "english")]}
    return shown(A.plan_action(property_pages(spark, d), F.lit(True), action), "tags")


@query(f"""WITH {ONE_PAGE} SELECT path, true AS changed, '' AS skipped_reason, (1 + (tags IS NOT NULL)::INT + (topic IS NOT NULL)::INT)::BIGINT AS n_properties, 'list:[[wiki/' || doc_id || ']],[[wiki/' || (doc_id + 1) || '|next]]' AS value FROM p""")
def property_dedupe_links(spark: SparkSession, d: str) -> DataFrame:
    return shown(A.plan_action(property_pages(spark, d), F.lit(True), {"type": "dedupe_wikilinks", "properties": ["related"]}), "related")


@query(f"WITH {LATEST} SELECT collection, kind, epoch_us(reviewed_at) AS reviewed_us, review_id, outcome FROM latest")
def stream_latest_review(spark: SparkSession, d: str) -> DataFrame:
    """The latest reviews, from the events read as a stream of files."""
    events = V.table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d).where("event_type IN ('signup', 'purchase')")
    reviews = stream.select(F.col("user_id").alias("collection"), F.when(F.col("event_type") == "signup", "quality").otherwise("cleaning").alias("kind"), F.col("ts").alias("reviewed_at"), F.col("event_id").alias("review_id"),
                            F.element_at(F.array(*map(F.lit, ("passed", "findings", "failed"))), (F.col("event_id") % 3 + 1).cast("int")).alias("outcome"))
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    logs.latest_stream(reviews, f"{folder}/latest", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/latest/version=0").withColumn("reviewed_us", F.unix_micros(F.col("reviewed_at").cast("timestamp"))).drop("reviewed_at")
