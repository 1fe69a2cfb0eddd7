"""Which properties a collection uses: counts, value types, classes of documents and a few sample values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a property, items of a list and characters of a value that a sample shows.
SAMPLES, ITEMS, LONGEST = 5, 5, 160


def document_class(path: Column) -> Column:
    """wiki-page, source or schema, by the folder."""
    return F.when(path.startswith("sources/"), "source").when(path.startswith("wiki/"), "wiki-page").otherwise("schema")


def item_kind(x: Column) -> Column:
    kinds = (("null", "^(?:|null|~)$"), ("boolean", "^(?:true|false)$"), ("integer", "^-?[0-9]+$"), ("number", r"^-?[0-9]+\.[0-9]+$"))
    return F.coalesce(*(F.when(F.coalesce(x, F.lit("")).rlike(p), F.lit(k)) for k, p in kinds), F.lit("string"))


def value_type(kind: Column, items: Column) -> Column:
    """The type as it is told: that of a list names the types of its items, an empty one is a plain list."""
    inside = F.array_join(F.array_sort(F.array_distinct(F.transform(items, item_kind))), "|")
    of_list = F.when(F.size(items) > 0, F.concat(F.lit("list<"), inside, F.lit(">"))).otherwise("list")
    return F.when(kind == "list", of_list).when(kind == "bool", "boolean").otherwise(kind)


def sample_value(kind: Column, scalar: Column, items: Column) -> Column:
    short = lambda x: F.when(F.length(x) > LONGEST, F.concat(F.left(x, F.lit(LONGEST)), F.lit("…"))).otherwise(x)
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.slice(items, 1, ITEMS), lambda x: F.coalesce(short(x), F.lit("null"))), ", "), F.lit("]"))
    return F.when(kind == "list", listed).when(kind == "null", "null").otherwise(short(scalar))


def typed_inventory(properties: DataFrame) -> DataFrame:
    """property, n, types, classes (both arrays of name and n, by name), samples.

    ``properties``: path, key, kind, scalar, items. Samples are the ``SAMPLES`` distinct values with the smallest digests,
    so any number of values of one property is never gathered: every task hands on its own few.
    """
    value, name = sample_value(F.col("kind"), F.col("scalar"), F.col("items")), value_type(F.col("kind"), F.col("items"))
    rows = properties.select(F.col("key").alias("property"), name.alias("type"), document_class(F.col("path")).alias("class"), value.alias("sample"))
    named = lambda c: F.array_sort(F.collect_list(F.struct(F.col(c).alias("name"), "n")))
    types = rows.groupBy("property", "type").agg(F.count("*").alias("n")).groupBy("property").agg(F.sum("n").alias("total"), named("type").alias("types"))
    classes = rows.groupBy("property", "class").agg(F.count("*").alias("n")).groupBy("property").agg(named("class").alias("classes"))
    # row_number under a bound is cut in every task before the shuffle
    order = Window.partitionBy("property").orderBy("digest", "sample")
    picked = rows.select("property", "sample").distinct().withColumn("digest", F.sha2("sample", 256)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLES)
    samples = picked.groupBy("property").agg(F.array_sort(F.collect_list(F.struct("k", "sample"))).alias("s")).select("property", F.col("s.sample").alias("samples"))
    return types.join(classes, "property").join(samples, "property").select("property", F.col("total").alias("n"), "types", "classes", "samples")
