"""Records kept as JSON lines: sources, reviews and questions, with what is wrong with a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the records.
KINDS, OUTCOMES = ("quality", "cleaning"), ("passed", "findings", "failed")
SOURCE_STATUS = ("active", "superseded", "withdrawn")


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """line_no, the fields of the line and _broken: not an object of JSON. ``lines``: line_no, line."""
    got = F.from_json("line", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select("line_no", "line", got.alias("r"))
    return rows.select("line_no", "r.*", (F.col("r._corrupt").isNotNull() | F.col("r").isNull() | ~F.ltrim("line").startswith("{")).alias("_broken")).drop("_corrupt")


def with_problems(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with problems: what is wrong with each, in the order of the rules; a line that is no record has that problem alone.

    The first line of an id counts, and later ones repeat it. Ids are counted by an aggregation, so one that a third of
    the lines share is no window of one task.
    """
    first = rows.where(~F.col("_broken")).groupBy(key).agg(F.min("line_no").alias("_first"))
    told = rows.join(first, key, "left")
    again = F.coalesce(F.col("_first") < F.col("line_no"), F.lit(False))
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items()), F.when(again, F.lit("duplicate-id"))))
    return told.withColumn("problems", F.when(F.col("_broken"), "invalid-line").otherwise(F.array_join(found, " "))).drop("_first", "_broken")


def load_registry(lines: DataFrame) -> DataFrame:
    """line_no, source_id, path, language, status, problems of each line of the registry of sources."""
    rows = parsed(lines, "source_id string, path string, language string, status string")
    rules = {"bad-id": ~F.col("source_id").rlike("^src-[0-9a-f]{16}$"), "no-path": F.trim("path") == "", "bad-language": ~F.col("language").rlike("^[a-z]{2}$"), "bad-status": ~F.col("status").isin(*SOURCE_STATUS)}
    return with_problems(rows, "source_id", rules).select("line_no", "source_id", "path", "language", "status", "problems")


def load_review_log(lines: DataFrame) -> DataFrame:
    """line_no, review_id, kind, reviewed_at, outcome, summary, problems of each line of the log of reviews."""
    rows = parsed(lines, "review_id string, kind string, reviewed_at string, outcome string, summary string")
    time = F.try_to_timestamp("reviewed_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rules = {"bad-id": ~F.col("review_id").rlike("^rev-[0-9]+$"), "bad-kind": ~F.col("kind").isin(*KINDS), "bad-time": time.isNull(), "bad-outcome": ~F.col("outcome").isin(*OUTCOMES), "bad-summary": ~F.length("summary").between(1, 500)}
    return with_problems(rows, "review_id", rules).select("line_no", "review_id", "kind", "reviewed_at", "outcome", "summary", "problems")


def load_questions(lines: DataFrame, most: int = 500) -> DataFrame:
    """line_no, question_id, question, claim_id, author, problems of each line of the recorded questions."""
    rows = parsed(lines, "question_id string, question string, claim_id string, author string")
    rules = {"bad-id": ~F.col("question_id").rlike("^fq-[0-9]+$"), "bad-question": ~F.length(F.trim("question")).between(1, most), "bad-claim": ~F.col("claim_id").rlike("^clm-[0-9a-f]{16}$"), "bad-author": ~F.col("author").rlike("^[a-z]+:[a-z0-9][a-z0-9._-]*$")}
    return with_problems(rows, "question_id", rules).select("line_no", "question_id", "question", "claim_id", "author", "problems")
