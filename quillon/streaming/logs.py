"""Logs of records as streams: appended once, whatever is replayed, with the latest record of each kind kept up to date.

A folder of JSON lines is read as a file stream. Each batch is judged by the same function that judges a whole log, ids that
the log already holds are problems, and what is sound is written to a folder of its own for the batch, which a
replay of the batch replaces. So a batch that ran half, or twice, leaves each record once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.settled import settled
from quillon.operators.records import load_review_log


def lines_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """file, line of every line of the files of ``folder``, as they come; blank lines are none."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where("trim(line) <> ''")


def held(spark: SparkSession, out: str, schema: str, before: int | None = None) -> DataFrame:
    """The records of a log, of batches before ``before`` if given."""
    try:
        rows = spark.read.schema(schema + ", batch long").parquet(out)
    except Exception as e:  # nothing was appended yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], schema + ", batch long")
    return rows if before is None else rows.where(F.col("batch") < before)


def append_log(stream: DataFrame, out: str, refused: str, checkpoint: str, key: str = "review_id", judge: Callable[[DataFrame], DataFrame] = load_review_log) -> StreamingQuery:
    """Append the sound records of ``stream`` (file, line) to the log at ``out``, others with their problems to ``refused``; all that is there is taken.

    ``judge``: lines (line_no, line) to records with ``key`` and problems. A record whose id an earlier batch holds is a
    duplicate-id; of several in one batch the first by file, then by spelling, counts.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        # a fixed order of lines, so that a replay judges them alike
        ordered = rows.orderBy("file", "line").select("line", F.monotonically_increasing_id().alias("line_no"))
        judged = judge(settled(ordered).select("line_no", "line"))
        schema = ", ".join(f"{c} {t}" for c, t in judged.drop("problems", "line_no").dtypes)
        known = held(spark, out, schema, before=number).select(key).distinct().withColumn("_known", F.lit(True))
        told = judged.join(known, key, "left").withColumn("problems", F.when(F.col("_known"), F.concat_ws(" ", F.nullif("problems", F.lit("")), F.lit("duplicate-id"))).otherwise(F.col("problems")))
        sound = F.col("problems") == ""
        told.where(sound).drop("problems", "line_no", "_known").write.mode("overwrite").parquet(f"{out}/batch={number}")
        told.where(~sound).drop("line_no", "_known").write.mode("overwrite").parquet(f"{refused}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(reviews: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The latest review of each collection and kind, kept in the state of the stream and written whole after each batch.

    ``reviews``: collection, kind, reviewed_at, review_id, outcome. The later time counts, then the larger id, as in
    :func:`quillon.operators.governance.latest_review`.
    """
    last = F.max_by(F.struct("reviewed_at", "review_id", "outcome"), F.struct("reviewed_at", "review_id")).alias("r")
    latest = reviews.groupBy("collection", "kind").agg(last).select("collection", "kind", "r.*")

    def batch(rows: DataFrame, number: int) -> None:
        # the last version stays readable while the next is written
        rows.write.mode("overwrite").parquet(f"{out}/version={number % 2}")

    return latest.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
