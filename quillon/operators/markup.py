"""Markdown pages as tables: front matter, claims, layers, conflict copies, schema drift, index listing, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import fold_key, tokens

REQUIRED = ("title", "status", "tags", "sources")
LISTS = ("tags", "sources")


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """path, content, bytes of all Markdown files under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("bytes"))


def classify_layer(pages: DataFrame) -> DataFrame:
    """path, scope, is_navigation: the layer by prefix; the root page, indexes and the questions page only navigate."""
    p = F.col("path")
    scope = F.when(p.startswith("sources/"), "sources").when(p.startswith("meta/history/"), "history").otherwise("wiki")
    return pages.select("path", scope.alias("scope"), (~p.contains("/") | p.endswith("/index.md") | p.endswith("open-questions.md")).alias("is_navigation"))


def load_frontmatter(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(properties, errors) of ``raw`` (path, content).

    properties: path, key, kind (null, bool, integer, number, string, list), scalar, items. errors: path, line_no,
    reason; a page with an error has no properties, and no other page suffers. A page without a block has neither.
    """
    lines = raw.where(F.col("content").startswith("---\n")).select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    end = F.min(F.when((F.col("line_no") > 0) & (F.col("line") == "---"), F.col("line_no"))).over(Window.partitionBy("path"))
    block = lines.withColumn("end", end).where("line_no > 0 AND (end IS NULL OR line_no < end)").where("trim(line) <> '' AND NOT line LIKE '#%'")
    item = F.regexp_extract("line", r"^  - (.*)$", 1)
    is_item, key = F.col("line").rlike(r"^  - "), F.regexp_extract("line", r"^([A-Za-z_][\w-]*):", 1)
    reason = F.when(F.col("end").isNull(), "unclosed block").when(F.col("line").contains("\t"), "tab").when(~is_item & F.col("line").startswith(" "), "nesting").when(~is_item & (key == ""), "missing colon")
    reason = reason.when((key != "") & (F.count("*").over(Window.partitionBy("path", key, is_item)) > 1), "duplicate key")
    rows = block.withColumns({"reason": reason, "own": F.when(~is_item, key), "item": F.when(is_item, item), "rest": F.when(~is_item, F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)))})
    errors = rows.where("reason IS NOT NULL").select("path", F.col("line_no").cast("long").alias("line_no"), "reason")
    rows = rows.withColumn("key", F.last("own", ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no")))
    found = rows.groupBy("path", "key").agg(F.max("rest").alias("rest"), F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("line_no", "item")))).alias("below"))
    plain = lambda x: F.regexp_replace(F.trim(x), r"^[\"'](.*)[\"']$", "$1")
    inline = F.col("rest").rlike(r"^\[.*\]$")
    inside = F.filter(F.transform(F.split(F.regexp_extract("rest", r"^\[(.*)\]$", 1), ","), lambda x: plain(x)), lambda x: x != "")
    items = F.when(F.size("below") > 0, F.transform("below", lambda x: plain(x["item"]))).when(inline, inside)
    kind = F.when(items.isNotNull(), "list").when(F.col("rest").isin("", "null", "~"), "null").when(F.col("rest").isin("true", "false"), "bool").when(F.col("rest").rlike(r"^-?[0-9]+$"), "integer").when(F.col("rest").rlike(r"^-?[0-9]+\.[0-9]+$"), "number").otherwise("string")
    good = found.join(errors.select("path").distinct(), "path", "left_anti")
    return good.select("path", "key", kind.alias("kind"), F.when(kind != "list", plain(F.col("rest"))).alias("scalar"), items.alias("items")), errors


#: Fixed format: a claim is a comment with its metadata, the text and a closing comment.
CLAIM = r"(?is)<!-- *claim *\n(.*?)-->(.*?)<!-- */claim *-->"


def extract_claims(raw: DataFrame) -> DataFrame:
    """path, ord, claim_id, kind, status, sources, text: a row for each claim comment block."""
    blocks = raw.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(CLAIM), F.lit(0))).alias("ord", "block"))
    meta = F.regexp_extract("block", CLAIM, 1)
    field = lambda k: F.trim(F.regexp_extract(meta, rf"(?im)^{k}:(.*)$", 1))
    sources = F.filter(F.transform(F.split(field("sources"), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return blocks.select("path", F.col("ord").cast("long").alias("ord"), field("id").alias("claim_id"), field("kind").alias("kind"), field("status").alias("status"), F.array_join(sources, " ").alias("sources"), F.trim(F.regexp_replace(F.regexp_extract("block", CLAIM, 2), r"\s+", " ")).alias("text"))


def schema_drift(properties: DataFrame, pages: DataFrame) -> DataFrame:
    """path, kind, property: required properties that are missing, lists that are none, unknown properties, bad names."""
    need = pages.select("path", F.explode(F.array(*map(F.lit, REQUIRED))).alias("property"))
    have = properties.select("path", F.col("key").alias("property"), F.col("kind").alias("type"))
    missing = need.join(have, ["path", "property"], "left_anti").select("path", F.lit("missing-required").alias("kind"), "property")
    wrong = F.when(F.col("property").isin(*LISTS) & (F.col("type") != "list"), "type-mismatch").when(~F.col("property").rlike("^[a-z][a-z0-9_]*$"), "property-name").when(~F.col("property").isin(*REQUIRED), "extension")
    return missing.unionByName(have.withColumn("kind", wrong).where("kind IS NOT NULL").select("path", "kind", "property"))


def conflict_pairs(files: DataFrame) -> DataFrame:
    """copy, original, identical: copies a sync service left, with the file they are of. ``files``: path, content."""
    original = F.regexp_replace("path", r"(?: \(conflicted copy[^)]*\)|\.sync-conflict-[0-9-]+|\([0-9]+\))(\.[a-z]+)$", "$1")
    copies = files.select(F.col("path").alias("copy"), F.sha2("content", 256).alias("h"), original.alias("original")).where("copy <> original")
    return copies.join(files.select(F.col("path").alias("original"), F.sha2("content", 256).alias("o")), "original").select("copy", "original", (F.col("h") == F.col("o")).alias("identical"))


def ambiguous_terms(concepts: DataFrame) -> DataFrame:
    """key, n: terms that more than one concept claims. ``concepts``: concept_id, term."""
    key = fold_key(F.array_join(tokens(F.col("term")), " "))
    return concepts.groupBy(key.alias("key")).agg(F.countDistinct("concept_id").alias("n")).where("n > 1 AND key <> ''")


def index_listing(pages: DataFrame, links: DataFrame, root: str = "wiki") -> DataFrame:
    """path, index: pages that neither the index of their own directory nor the root index links, with the index that should.

    ``links``: path (of the linking page), target_path. Pages right under ``root`` belong to its index; index pages are not listed.
    """
    own = pages.where(~F.col("path").rlike("(^|/)index[.]md$")).select("path", F.concat(F.regexp_extract("path", "^(.*/)[^/]*$", 1), F.lit("index.md")).alias("index"))
    links = links.select(F.col("path").alias("index"), F.col("target_path").alias("path")).distinct()
    listed = own.join(links, ["index", "path"], "left_semi").select("path").unionByName(links.where(F.col("index") == f"{root}/index.md").select("path"))
    return own.join(listed, "path", "left_anti").select("path", "index")


def okf_report(properties: DataFrame, pages: DataFrame) -> DataFrame:
    """path, conforms, missing, unknown: which documents keep the open format, and what is missing or unknown."""
    drift = schema_drift(properties, pages).groupBy("path").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "missing-required", F.col("property")))).alias("m"), F.sort_array(F.collect_list(F.when(F.col("kind") == "extension", F.col("property")))).alias("u"),
        F.count_if(F.col("kind").isin("missing-required", "type-mismatch")).alias("bad"))
    return pages.select("path").join(drift, "path", "left").select("path", (F.coalesce("bad", F.lit(0)) == 0).alias("conforms"), F.coalesce(F.array_join("m", " "), F.lit("")).alias("missing"), F.coalesce(F.array_join("u", " "), F.lit("")).alias("unknown"))
