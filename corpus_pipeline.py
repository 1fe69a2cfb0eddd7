"""A corpus through five stages: quality rules, line dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import cut
from quillon.llm.lines import without_repeats
from quillon.llm.minhash import near_duplicates
from quillon.llm.mixing import mix_sources
from quillon.llm.packing import pack_documents
from quillon.llm.quality import keep_good

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep all quality rules. Null, empty and wordless texts have no words and go; repeated rows are judged alike; an empty table stays empty."""
    return keep_good(docs.select(DOCUMENTS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, or nearly repeat, an earlier one are cut; documents without a word left go.

    The first line of a class, by doc_id and place, stays. Null and empty texts have no lines and stay as they are; a
    repeated row is the same place and keeps the same lines; an empty table stays empty.
    """
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(DOCUMENTS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates.

    Null, empty and wordless texts are linked with nothing and stay; rows that repeat the kept doc_id stay with it; an
    empty table stays empty.
    """
    gone = near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(DOCUMENTS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights flattened until one would be used 1.25 times; a row for each use of a document.

    A null source is a source of its own; texts without words go along without tokens; repeated rows share a place in
    the permutation and are used together; an empty table stays empty.
    """
    return mix_sources(docs, max_repeats=1.25).select(DOCUMENTS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens. A null or empty text is its end mark; rows are packed as often as they occur; an empty table gives no piece."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("minhash near-dedup", near_dedup), ("source mixing", mixing), ("packing", packing)]

#: Edit distance joins, sketches and tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
