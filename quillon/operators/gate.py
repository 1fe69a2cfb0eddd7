"""Search quality held against a table of truth and a recorded ranking: metrics, floors and caps, lost bands.

``ranked``, ``recorded``: fid, path, rank. ``truth``: fid, path, the pages that a question requires; a question without one is
negative, it should find little. ``questions``: fid. A page that is not in a ranking, or beyond ``RANK_LIMIT``, has no rank.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far ranks are told, results without a flag, and the bands a required page is held to.
RANK_LIMIT, DEFAULT_LIMIT, TOP = 100, 12, 3
BANDS = (TOP, DEFAULT_LIMIT)


def is_navigation(path: Column) -> Column:
    """The root page, every index.md and the page of questions."""
    return path.isin("WIKI.md", "meta/questions.md") | path.rlike("(?:^|/)index[.]md$")


def holders_of_runs(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """fid, path: pages that hold the tokens of a run in a row. ``pages``: path, t; ``runs``: fid, run (arrays of tokens).

    A page's tokens meet the longest token of each run, which are broadcast; only where that stands is the run compared.
    """
    longest = F.array_max(F.transform("run", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("token"))))
    keyed = runs.where(F.size("run") > 0).select("fid", "run", longest.alias("k")).select("fid", "run", (-F.col("k.at")).alias("at"), F.col("k.token").alias("token"))
    placed = pages.select("path", "t", F.posexplode_outer("t").alias("i", "token")).join(F.broadcast(keyed), "token")
    start = F.col("i") - F.col("at") + 1
    return placed.where((start > 0) & (F.slice("t", F.greatest(start, F.lit(1)), F.size("run")) == F.col("run"))).select("fid", "path").distinct()


def _within(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("rank") <= RANK_LIMIT).select("fid", "path", "rank")


def quality_metrics(ranked: DataFrame, questions: DataFrame, truth: DataFrame, navigation: Column | None = None) -> DataFrame:
    """metric, value: counts over all questions.

    required_first_result: questions with a required page first; all_must_find_within_k: those all of whose required pages
    stand within k. ``navigation``: which rows of ``ranked`` are navigation pages.
    """
    asked = questions.select("fid").distinct()
    need = truth.select("fid", "path").distinct().join(asked, "fid", "left_semi").join(_within(ranked), ["fid", "path"], "left")
    by_question = need.groupBy("fid").agg(F.min("rank").alias("first"), F.max(F.coalesce("rank", F.lit(RANK_LIMIT + 1))).alias("last"))
    shown = _within(ranked.withColumn("path", F.when(is_navigation(F.col("path")) if navigation is None else navigation, F.lit("navigation")).otherwise(F.lit("page"))))
    shown = shown.groupBy("fid").agg(F.count_if(F.col("rank") <= DEFAULT_LIMIT).alias("results"), F.count_if((F.col("rank") <= TOP) & (F.col("path") == "navigation")).alias("navigation"))
    rows = asked.join(by_question, "fid", "left").join(shown, "fid", "left")
    answerable = F.col("last").isNotNull()
    counts = {
        "answerable_queries": F.count_if(answerable), "negative_queries": F.count_if(~answerable), "required_first_result": F.count_if(F.col("first") == 1),
        **{f"all_must_find_within_{k}": F.count_if(F.col("last") <= k) for k in (TOP, DEFAULT_LIMIT, RANK_LIMIT)},
        "negative_results_within_12": F.coalesce(F.sum(F.when(~answerable, F.col("results"))), F.lit(0)), "navigation_in_top_3": F.coalesce(F.sum("navigation"), F.lit(0)),
    }
    row = rows.agg(*(c.alias(k) for k, c in counts.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in counts))))


def held_bounds(metrics: DataFrame, floors: Mapping[str, int], caps: Mapping[str, int]) -> DataFrame:
    """metric, value, floor, cap, held: each metric with a bound, and whether it keeps it; a metric that is missing does not."""
    bounds = [(k, floors.get(k), caps.get(k)) for k in dict.fromkeys([*floors, *caps])]
    table = metrics.sparkSession.createDataFrame(bounds, "metric string, floor long, cap long")
    value = F.col("value")
    kept = F.coalesce(value >= F.coalesce("floor", value), F.lit(False)) & F.coalesce(value <= F.coalesce("cap", value), F.lit(False))
    return F.broadcast(table).join(metrics, "metric", "left").select("metric", "value", "floor", "cap", kept.alias("held"))


def rank_regressions(ranked: DataFrame, recorded: DataFrame, truth: DataFrame, accepted: DataFrame) -> DataFrame:
    """fid, path, bound, held, now: required pages that left the first place (bound 1) or a band (3, 12) of the recorded ranking.

    First place is lost by a question: none of its required pages has it any more; told at the one that had it, unless its loss
    is accepted. ``accepted``: fid, path, accepted_rank; null: the page is exempt, else it is held to the bands of that rank
    where the recorded one is better. Only the widest band to the left of which a page fell is told.
    """
    need = truth.select("fid", "path").distinct()
    rows = need.join(_within(recorded).withColumnRenamed("rank", "was"), ["fid", "path"], "left").join(_within(ranked).withColumnRenamed("rank", "now"), ["fid", "path"], "left")
    told = accepted.groupBy("fid", "path").agg(F.max("accepted_rank").alias("accepted_rank"), F.lit(True).alias("accepted"))
    rows = rows.join(told, ["fid", "path"], "left")
    first = rows.join(rows.groupBy("fid").agg(F.coalesce(F.min("now") == 1, F.lit(False)).alias("still")), "fid")
    first = first.where("was = 1 AND accepted IS NULL AND NOT still").select("fid", "path", F.lit(1).alias("bound"), F.col("was").alias("held"), "now")
    held = F.when(F.col("accepted").isNull(), F.col("was")).when(F.col("accepted_rank").isNotNull(), F.greatest("was", "accepted_rank"))
    lost = F.coalesce(*(F.when((F.col("held") <= k) & (F.col("now").isNull() | (F.col("now") > k)), k) for k in BANDS))
    left = rows.withColumn("held", F.when(F.col("was").isNotNull(), held)).withColumn("bound", lost).where("bound IS NOT NULL")
    return first.unionByName(left.select("fid", "path", "bound", "held", "now"))


def rank_improvements(ranked: DataFrame, recorded: DataFrame, truth: DataFrame) -> DataFrame:
    """fid, path, was, now: required pages that stand higher than recorded."""
    now = truth.select("fid", "path").distinct().join(_within(ranked).withColumnRenamed("rank", "now"), ["fid", "path"])
    return now.join(_within(recorded).withColumnRenamed("rank", "was"), ["fid", "path"], "left").where("was IS NULL OR now < was").select("fid", "path", "was", "now")
