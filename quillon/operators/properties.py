"""Actions on typed properties of pages, as plans that say what would change and why something is skipped.

A page has a map of properties: name -> struct(kind, scalar, items); kind is string, bool, integer, number, null or list.
Every action is one expression over that map but the dedupe of links, which asks for the pages by equality joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import MARKED, PLAIN

VALUE = "struct<kind:string,scalar:string,items:array<string>>"
PROPS = f"map<string,{VALUE}>"
#: What may stand where the target property is there, and changes of a string.
CONFLICTS, TRANSFORMS = ("skip", "overwrite", "merge_list"), ("trim", "lowercase", "titlecase", "strip_diacritics")
LINK = r"^\[\[([^\]|#]+)(#[^\]|]*)?(?:\|([^\]]*))?\]\]$"


def value(kind: str, scalar: Column | None = None, items: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), (scalar if scalar is not None else null).cast("string").alias("scalar"), (items if items is not None else null).cast("array<string>").alias("items")).cast(VALUE)


def constant(x: object) -> Column:
    """A value of Python as a property value."""
    if isinstance(x, (list, tuple)):
        return value("list", items=F.array(*(F.lit(None if y is None else str(y).lower() if isinstance(y, bool) else str(y)) for y in x)))
    kind = "null" if x is None else "bool" if isinstance(x, bool) else "integer" if isinstance(x, int) else "number" if isinstance(x, float) else "string"
    return value(kind, F.lit(None if x is None else str(x).lower() if kind == "bool" else str(x)))


def of(props: Column, name: str) -> Column:
    return F.try_element_at(props, F.lit(name))


def is_set(v: Column) -> Column:
    """There, and neither null nor an empty text or list."""
    return v.isNotNull() & (v["kind"] != "null") & F.when(v["kind"] == "list", F.size(v["items"]) > 0).otherwise(F.coalesce(v["scalar"], F.lit("")) != "")


def merged(a: Column, b: Column) -> Column:
    items = lambda v: F.when(v["kind"] == "list", v["items"]).otherwise(F.array(v["scalar"]))
    return value("list", items=F.array_distinct(F.concat(items(a), items(b))))


def put(props: Column, name: str, v: Column) -> Column:
    return F.map_concat(F.map_filter(props, lambda k, _: k != name), F.create_map(F.lit(name), v))


def without(props: Column, names: Sequence[str]) -> Column:
    return F.map_filter(props, lambda k, _: ~k.isin(*names)) if names else props


def set_value(props: Column, name: str, new: object, mode: str = "skip") -> tuple[Column, Column]:
    old, fresh = of(props, name), constant(new)
    after = F.when(is_set(old), {"skip": props, "overwrite": put(props, name, fresh), "merge_list": put(props, name, merged(old, fresh))}[mode]).otherwise(put(props, name, fresh))
    return after, F.when(is_set(old) & F.lit(mode == "skip"), "property already set")


def delete(props: Column, names: Sequence[str]) -> tuple[Column, Column]:
    there = reduce(lambda a, b: a | b, (of(props, x).isNotNull() for x in names))
    return without(props, names), F.when(~there, "no matching property")


def gather(props: Column, kind: str, sources: Sequence[str], target: str, on_conflict: str | None = None) -> tuple[Column, Column]:
    """rename, copy or merge: values of several properties go to one; rename and merge take the sources away."""
    on_conflict = on_conflict or ("merge_list" if kind == "merge" else "skip")
    collected = reduce(lambda acc, v: F.when(acc.isNull(), v).when(v.isNull(), acc).otherwise(merged(acc, v)), (of(props, x) for x in sources))
    old = of(props, target)
    held = is_set(old)
    new = F.when(held & F.lit(on_conflict == "merge_list"), merged(old, collected)).otherwise(collected)
    after = put(props, target, new)
    if kind != "copy":
        after = without(after, [x for x in sources if x != target])
    reason = F.when(collected.isNull(), "no source property present").when(held & F.lit(on_conflict == "skip"), "target property exists")
    return F.when(reason.isNull(), after).otherwise(props), reason


def changed_text(x: Column, transforms: Sequence[str]) -> Column:
    marks, plain = MARKED + MARKED.upper(), PLAIN + PLAIN.upper()
    for t in transforms:
        x = {"trim": F.trim(x), "lowercase": F.lower(x), "titlecase": F.initcap(x), "strip_diacritics": F.translate(x, marks, plain)}[t]
    return x


def normalize_values(props: Column, name: str, transforms: Sequence[str] = (), mappings: Sequence[tuple[str, str]] = (), preserve_wikilinks: bool = True) -> tuple[Column, Column]:
    table = F.create_map(*(F.lit(x) for kv in mappings for x in kv)) if mappings else None

    def one(x: Column) -> Column:
        new = changed_text(x, transforms)
        new = F.coalesce(F.try_element_at(table, new), new) if table is not None else new
        return F.when(x.rlike(LINK), x).otherwise(new) if preserve_wikilinks else new

    old = of(props, name)
    listed = value("list", items=F.array_distinct(F.filter(F.transform(old["items"], one), lambda x: x.isNull() | (x != ""))))
    new = F.when(old["kind"] == "list", listed).when(old["kind"] == "string", value("string", one(old["scalar"]))).otherwise(old)
    return F.when(old.isNotNull(), put(props, name, new)).otherwise(props), F.when(old.isNull(), "property not present")


ACTIONS = {
    "set": lambda p, a: set_value(p, a["property"], a["value"], a.get("mode", "skip")), "delete": lambda p, a: delete(p, a["properties"]),
    "normalize_values": lambda p, a: normalize_values(p, a["property"], a.get("transforms", ()), a.get("mappings", ()), a.get("preserve_wikilinks", True)),
} | {kind: (lambda p, a, kind=kind: gather(p, kind, a["from_properties"], a["to_property"], a.get("on_conflict"))) for kind in ("rename", "copy", "merge")}


def link_names(pages: DataFrame) -> DataFrame:
    """name, canonical: what a link may call a page: its path without ending, or its last part where only one page has it (else null)."""
    paths = pages.select(F.regexp_replace("path", r"[.]md$", "").alias("canonical")).distinct()
    last = paths.groupBy(F.regexp_extract("canonical", "([^/]*)$", 1).alias("name")).agg(F.when(F.count("*") == 1, F.min("canonical")).alias("canonical"))
    whole = paths.select(F.col("canonical").alias("name"), "canonical").join(last.select("name"), "name", "left_anti")
    return last.unionByName(whole)


def dedupe_links(docs: DataFrame, pages: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """path, before, after, skipped_reason: links in properties by the canonical path of their page; of two links to one page, anchor and label, the first stays. ``names``: the properties, all if empty."""
    entries = docs.select("path", F.explode(F.map_entries("props")).alias("e")).select("path", F.col("e.key").alias("key"), F.col("e.value").alias("v"))
    if names:
        entries = entries.where(F.col("key").isin(*names))
    items = F.when(F.col("v.kind") == "list", F.col("v.items")).when(F.col("v.kind") == "string", F.array("v.scalar"))
    rows = entries.select("path", "key", F.col("v.kind").alias("kind"), F.posexplode(items).alias("pos", "item"))
    part = lambda i: F.regexp_extract("item", LINK, i)
    target = F.trim(part(1))
    portable = ~target.rlike(r"^/|\\|(^|/)\.\.(/|$)")
    rows = rows.withColumns({"is_link": F.coalesce(F.col("item").rlike(LINK), F.lit(False)), "name": F.when(portable, F.regexp_replace(F.regexp_replace(target, r"[.]md$", ""), r"^[.]/", "")), "anchor": part(2), "label": part(3), "has_label": F.col("item").contains("|")})
    rows = rows.join(link_names(pages), "name", "left")
    emitted = F.when(F.col("canonical").isNotNull(), F.concat(F.lit("[["), "canonical", "anchor", F.when(F.col("has_label"), F.concat(F.lit("|"), "label")).otherwise(""), F.lit("]]"))).otherwise(F.col("item"))
    rows = rows.withColumn("new", F.when(F.col("is_link"), emitted).otherwise(F.col("item")))
    key = F.when(F.col("is_link"), F.struct(F.coalesce("canonical", F.concat(F.lit("broken:"), "item")).alias("a"), F.col("anchor").alias("b"), F.col("label").alias("c")))
    again = F.row_number().over(Window.partitionBy("path", "key", key).orderBy("pos")) > 1
    kept = rows.withColumn("gone", F.col("is_link") & again).groupBy("path", "key", "kind").agg(
        F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("pos", "new")))).alias("items"), F.bool_or(F.col("gone") | (F.col("new") != F.col("item"))).alias("touched"))
    kept = kept.where("touched").withColumn("items", F.transform("items", lambda x: x["new"]))
    new = F.when(F.col("kind") == "list", value("list", items=F.col("items"))).otherwise(value("string", F.get("items", F.lit(0))))
    fresh = kept.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", new.alias("value")))).alias("fresh"))
    both = docs.select("path", F.col("props").alias("before")).join(fresh, "path", "left")
    after = F.when(F.col("fresh").isNull(), F.col("before")).otherwise(F.transform_values("before", lambda k, v: F.coalesce(F.try_element_at("fresh", k), v)))
    return both.select("path", "before", after.alias("after"), F.when(F.col("fresh").isNull(), "no duplicate or non-canonical wikilink").alias("skipped_reason"))


def listed(props: Column) -> Column:
    """A map as an array in the order of its names, which can be compared."""
    return F.array_sort(F.map_entries(props))


def plan_action(docs: DataFrame, chosen: Column, action: dict, pages: DataFrame | None = None) -> DataFrame:
    """path, before, after, before_sha256, changed, skipped_reason of each chosen page ('' : it changes).

    ``docs``: path, props. ``action``: type and what that type asks for: set (property, value, mode), delete (properties),
    rename, copy, merge (from_properties, to_property, on_conflict), normalize_values (property, transforms, mappings,
    preserve_wikilinks), dedupe_wikilinks (properties; ``pages`` are those that links may name, ``docs`` if not given).
    """
    kind = action.get("type")
    if kind not in (*ACTIONS, "dedupe_wikilinks"):
        raise ValueError("action type must be set, delete, rename, copy, merge, normalize_values or dedupe_wikilinks")
    if action.get("on_conflict", "skip") not in CONFLICTS or action.get("mode", "skip") not in CONFLICTS or set(action.get("transforms", ())) - set(TRANSFORMS):
        raise ValueError("unknown mode, conflict rule or transform")
    rows = docs.where(chosen).select("path", F.col("props").cast(PROPS).alias("props"))
    if kind == "dedupe_wikilinks":
        told = dedupe_links(rows, pages if pages is not None else docs, action.get("properties", ()))
    else:
        after, reason = ACTIONS[kind](F.col("props"), action)
        told = rows.select("path", F.col("props").alias("before"), after.alias("after"), reason.alias("skipped_reason"))
    same = listed(F.col("before")) == listed(F.col("after"))
    reason = F.coalesce("skipped_reason", F.when(same, F.lit("no value change")), F.lit(""))
    return told.select("path", "before", "after", F.sha2(F.to_json(listed(F.col("before"))), 256).alias("before_sha256"), (~same).alias("changed"), reason.alias("skipped_reason"))
