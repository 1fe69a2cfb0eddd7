"""Files of definitions (concepts, clusters): their entries, the terms of active concepts, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a concept and of a cluster, those that must be there, states, and the colours of clusters.
SHAPE = {"concept": ("preferred", "status", "definition", "aliases", "broader", "related"), "cluster": ("label", "color", "status", "purpose", "directory", "includes", "excludes")}
REQUIRED = {"concept": ("preferred", "status", "definition"), "cluster": ("label", "color", "status", "purpose")}
STATES = ("active", "draft", "superseded")
PALETTE = ("#000099", "#FE8F11", "#1195EB", "#5BE3D6", "#84C041", "#FFC83A", "#E2C39A", "#FC6538")

ENTRY, HEADING, FIELD = r"^##\s+([a-z0-9]+(?:-[a-z0-9]+)*)\s*$", r"^ {0,3}#{1,6}(?:\s|$)", r"^-\s+([A-Za-z]+):\s*(.*)$"
#: A fenced block up to a run of its own marks, or a comment over several lines, in lines that begin with their number.
HIDDEN = r"(?ms)^\d+\t[ \t]*(?:(`{3,}|~{3,}).*?(?:\n\d+\t[ \t]*\1[^\n]*|\z)|<!--(?![^\n]*-->).*?(?:-->[^\n]*|\z))"


def visible_lines(files: DataFrame) -> DataFrame:
    """path, line, text: the lines of each file outside fenced blocks and comments over several lines, numbered from 1.

    Lines are numbered before blocks are cut out of the text by one expression, so all happens inside the file's row.
    """
    raw = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), r"\r\n?", "\n"), "\n")
    numbered = F.array_join(F.transform(raw, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\t"), x)), "\n")
    rows = files.select("path", F.explode(F.split(F.regexp_replace(numbered, HIDDEN, ""), "\n")).alias("x")).where("x <> ''")
    return rows.select("path", F.substring_index("x", "\t", 1).cast("long").alias("line"), F.expr("substring(x, instr(x, '\t') + 1)").alias("text"))


def load_definitions(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions, orphans) of ``files`` (path, content).

    definitions: path, id, line, fields (map), current: a level-two heading that is an id, and the field lines up to the
    next heading. Of a repeated field the last value counts; current is the last definition of an id. orphans: path,
    line, field, heading, closed: field lines below another heading, with the definition before it. Lines that belong
    to no definition and follow none are neither. Null content is an empty file; an empty value of a field is "".
    """
    lines = visible_lines(files).withColumns({"id": F.nullif(F.regexp_extract(F.trim("text"), ENTRY, 1), F.lit("")), "field": F.lower(F.nullif(F.regexp_extract(F.trim("text"), FIELD, 1), F.lit("")))})
    lines = lines.withColumn("head", F.when(F.col("id").isNotNull() | F.col("text").rlike(HEADING), F.trim("text"))).where("head IS NOT NULL OR field IS NOT NULL")
    so_far = Window.partitionBy("path").orderBy("line")
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    rows = lines.withColumns({"closed": last("id"), "at": last(F.when(F.col("id").isNotNull(), F.col("line"))), "heading": last("head"), "head_at": last(F.when(F.col("head").isNotNull(), F.col("line")))})
    inside = F.col("at") == F.col("head_at")
    entry = F.struct("line", "field", F.trim(F.regexp_extract(F.trim("text"), FIELD, 2)).alias("value"))
    listed = rows.where(inside).groupBy("path", F.col("closed").alias("id"), F.col("at").alias("line")).agg(F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), entry))).alias("f"))
    later = lambda x: F.exists("f", lambda y: (y["field"] == x["field"]) & (y["line"] > x["line"]))
    fields = F.map_from_entries(F.transform(F.filter("f", lambda x: ~later(x)), lambda x: F.struct(x["field"], x["value"])))
    current = F.max("line").over(Window.partitionBy("path", "id")) == F.col("line")
    orphans = rows.where(~inside & F.col("field").isNotNull())
    return listed.select("path", "id", "line", fields.alias("fields"), current.alias("current")), orphans.select("path", "line", "field", "heading", "closed")


def piped(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def concept_terms(definitions: DataFrame) -> DataFrame:
    """path, concept_id, ord, term: the preferred name (0) and the aliases of each active concept."""
    terms = F.concat(F.array(F.coalesce(F.col("fields")["preferred"], F.lit(""))), piped(F.col("fields")["aliases"]))
    return definitions.where(F.col("current") & (F.col("fields")["status"] == "active")).select("path", F.col("id").alias("concept_id"), F.posexplode(terms).alias("ord", "term"))


def definition_rules(definitions: DataFrame, orphans: DataFrame, noun: str = "concept", palette: tuple[str, ...] = PALETTE) -> DataFrame:
    """path, line, id, code, detail of what is wrong with the definitions of a file of concepts, or of clusters.

    Fields are judged on the current definition of an id; each earlier one is told as repeated on the later line. An
    orphaned field is told only if concepts (clusters) have such a field; its detail says what may be meant: to rename
    the heading where the field that names a definition stands below it, else to move the field.
    """
    value = lambda k: F.coalesce(F.col("fields")[k], F.lit(""))
    told = lambda when, code, detail: F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))
    found = [told(value(k) == "", "missing-field", F.lit(k)) for k in REQUIRED[noun]]
    found.append(told(~value("status").isin(*STATES), "bad-status", value("status")))
    if noun == "cluster":
        found.append(told((value("color") != "") & ~F.upper(value("color")).isin(*palette), "bad-color", value("color")))
        sound = value("directory").rlike(r"^wiki/[^\\:*?\"<>|]*$") & ~value("directory").rlike(r"(?:^|/)\.\.?(?:/|$)|//")
        found.append(told((value("directory") != "") & ~sound, "bad-directory", value("directory")))
    else:
        found.append(told(F.size(piped(F.col("fields")["broader"])) > 1, "several-broader", value("broader")))
    current = definitions.where("current")
    own = current.select("path", "line", "id", F.inline(F.array_compact(F.array(*found))))
    first = F.min("line").over(Window.partitionBy("path", "id"))
    again = definitions.withColumn("first", first).where("line > first").select("path", "line", "id", F.lit("duplicate-id").alias("code"), F.col("first").cast("string").alias("detail"))
    naming = REQUIRED[noun][0]
    misnamed = F.max(F.when((F.col("field") == naming) & F.col("heading").startswith("## "), 1)).over(Window.partitionBy("path", "heading", "closed"))
    stray = orphans.withColumn("hint", F.when(misnamed == 1, "rename the heading").otherwise("move the field")).where(F.col("field").isin(*SHAPE[noun]))
    found_all = own.unionByName(again).unionByName(stray.select("path", "line", F.col("closed").alias("id"), F.lit("orphaned-field").alias("code"), F.concat_ws(": ", "field", "hint").alias("detail")))
    if noun == "cluster":
        return found_all
    relations = current.select("path", "line", "id", F.explode(F.concat(piped(F.col("fields")["broader"]), piped(F.col("fields")["related"]))).alias("other"))
    selfish = relations.where("other = id").select("path", "line", "id", F.lit("relation-to-itself").alias("code"), F.col("other").alias("detail"))
    unknown = relations.where("other <> id").join(current.select("path", F.col("id").alias("other")), ["path", "other"], "left_anti").select("path", "line", "id", F.lit("unknown-concept").alias("code"), F.col("other").alias("detail"))
    return found_all.unionByName(selfish).unionByName(unknown)
