"""Links in the text of pages: found with anchor and label, resolved, and rewritten where a page moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a link in double brackets.
LINK = r"\[\[([^\[\]\n]+)\]\]"


def link_target(raw: Column) -> Column:
    """The page that the inside of a link names: without label, anchor, ending and leading ./"""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(raw, r"^([^|#]*)", 1)), r"[.]md$", ""), r"^[./]+", "")


def text_links(pages: DataFrame) -> DataFrame:
    """path, ord, target, anchor (with its sign), label (null: none) of each link in a body, in order."""
    rows = pages.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(LINK), F.lit(1))).alias("ord", "raw"))
    label = F.when(F.col("raw").contains("|"), F.regexp_extract("raw", r"^[^|]*\|(.*)$", 1))
    return rows.select("path", "ord", link_target(F.col("raw")).alias("target"), F.regexp_extract("raw", r"^[^|#]*(#[^|]*)", 1).alias("anchor"), label.alias("label"))


def resolved_links(pages: DataFrame) -> DataFrame:
    """path, ord, target, anchor, label, resolved, broken: links that name no page are broken, but from sources."""
    names = pages.select(F.regexp_replace("path", r"[.]md$", "").alias("target")).distinct().withColumn("resolved", F.lit(True))
    rows = text_links(pages).join(names, "target", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    return rows.select("path", "ord", "target", "anchor", "label", "resolved", (~F.col("resolved") & ~F.col("path").startswith("sources/")).alias("broken"))


def moved_pages(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """path, body, old_path, n_links: all pages, at their new path, with links to moved pages rewritten; anchor and label stay.

    ``moves``: from_path, to_path. Links meet the moves by equality; a body is put together again from its pieces in one
    pass, and only if it holds such a link. A move onto a page that is there and does not move itself is refused.
    """
    clash = moves.join(pages.select(F.col("path").alias("to_path")), "to_path", "left_semi").join(moves.select(F.col("from_path").alias("to_path")), "to_path", "left_anti")
    twice = moves.groupBy("to_path").count().where("count > 1")
    if not clash.isEmpty() or not twice.isEmpty():
        raise ValueError("a page is moved to a path that is taken")
    bare = lambda c: F.regexp_replace(c, r"[.]md$", "")
    to = moves.select(bare(F.col("from_path")).alias("target"), bare(F.col("to_path")).alias("new"))
    held = text_links(pages).join(to, "target").groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("target", "new"))).alias("to"), F.count("*").alias("n_links"))
    rows = pages.select("path", "body").join(held, "path", "left").join(moves.withColumnRenamed("from_path", "path"), "path", "left")
    between, inside = F.split("body", LINK), F.regexp_extract_all("body", F.lit(LINK), F.lit(1))

    def again(raw: Column) -> Column:
        new = F.try_element_at("to", link_target(raw))
        return F.concat(F.lit("[["), F.when(new.isNull(), raw).otherwise(F.concat(new, F.regexp_extract(raw, r"^[^|#]*(.*)$", 1))), F.lit("]]"))

    body = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(again(F.get(inside, i)), F.lit("")))), "")
    return rows.select(F.coalesce("to_path", "path").alias("path"), F.when(F.col("to").isNull(), F.col("body")).otherwise(body).alias("body"), F.col("path").alias("old_path"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
