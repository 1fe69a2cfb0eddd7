"""Plan and apply changes, manifests and snapshots, as joins of tables guarded by hashes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = ("exists", "not_exists", "equals", "not_equals", "contains", "not_contains", "starts_with", "ends_with", "is_empty", "is_not_empty", "in_path")


def condition(prop: str, operator: str, value: str | None = None, case_sensitive: bool = False) -> Column:
    """One condition of a selector as a column. Of an absent property the positive operators are false, the not_ ones true."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator}")
    x, v = F.col(prop).cast("string"), F.lit(value)
    if not case_sensitive:
        x, v = F.lower(x), F.lower(v)
    positive = {
        "exists": x.isNotNull(), "equals": x == v, "contains": x.contains(v), "starts_with": x.startswith(v), "ends_with": x.endswith(v),
        "is_empty": x == "", "is_not_empty": x != "", "in_path": F.col("path").startswith(F.lit(value)) if value else F.lit(False),
    }
    if operator.startswith("not_"):
        return ~F.coalesce(positive[{"not_exists": "exists", "not_equals": "equals", "not_contains": "contains"}[operator]], F.lit(False))
    return F.coalesce(positive[operator], F.lit(False))


def selector(conditions: Sequence[tuple], mode: str = "and") -> Column:
    """1 to 100 conditions, joined by and, or or."""
    if not 1 <= len(conditions) <= 100:
        raise ValueError("a selector has 1 to 100 conditions")
    return reduce((lambda a, b: a & b) if mode == "and" else (lambda a, b: a | b), (condition(*c) for c in conditions))


def filter_pages(pages: DataFrame, conditions: Sequence[tuple], mode: str = "and") -> DataFrame:
    """All pages with a column selected: what a word matches is decided on all of them, so this is no early filter."""
    return pages.withColumn("selected", selector(conditions, mode))


def virtual_properties(pages: DataFrame) -> DataFrame:
    """path, folder, filename, extension."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return pages.select("path", F.regexp_extract("path", "^(.*)/", 1).alias("folder"), name.alias("filename"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("extension"))


def plan_property(pages: DataFrame, chosen: Column, prop: str, new: Column) -> DataFrame:
    """path, before, after, changed, before_hash: what setting ``prop`` would do to the chosen pages."""
    old = F.coalesce(F.col(prop).cast("string"), F.lit(""))
    rows = pages.where(chosen).select("path", old.alias("before"), F.coalesce(new.cast("string"), F.lit("")).alias("after"))
    return rows.select("path", "before", "after", (F.col("before") != F.col("after")).alias("changed"), F.sha2("before", 256).alias("before_hash"))


def apply_plan(pages: DataFrame, plan: DataFrame, prop: str) -> tuple[DataFrame, DataFrame]:
    """(new pages, conflicts). A conflict is a page whose value is no longer the planned one; with any conflict nothing changes."""
    now = pages.withColumn("_hash", F.sha2(F.coalesce(F.col(prop).cast("string"), F.lit("")), 256))
    steps = plan.where("changed").select("path", "after", "before_hash")
    conflicts = steps.join(now.select("path", "_hash"), "path", "left").where(~F.col("_hash").eqNullSafe(F.col("before_hash"))).select("path")
    free = F.broadcast(conflicts.agg((F.count("*") == 0).alias("_free")))
    both = pages.join(steps.select("path", "after"), "path", "left").crossJoin(free)
    return both.withColumn(prop, F.when(F.col("_free") & F.col("after").isNotNull(), F.col("after")).otherwise(F.col(prop).cast("string"))).drop("after", "_free"), conflicts


def build_manifest(files: DataFrame) -> DataFrame:
    """path, sha256, bytes."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: added, removed, changed or same, between two manifests."""
    a, b = (m.select("path", F.col("sha256").alias(f"sha_{k}")) for k, m in (("a", old), ("b", new)))
    change = F.when(F.col("sha_a").isNull(), "added").when(F.col("sha_b").isNull(), "removed").when(F.col("sha_a") != F.col("sha_b"), "changed").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """state, missing, changed, unexpected: one row on whether the files are those of the release."""
    diff = snapshot_diff(manifest, build_manifest(files))
    counts = [F.count_if(F.col("change") == x) for x in ("removed", "changed", "added")]
    row = diff.agg(*(c.alias(n) for c, n in zip(counts, ("missing", "changed", "unexpected"), strict=True)))
    return row.select(F.when(F.col("missing") + F.col("changed") + F.col("unexpected") == 0, "ready").otherwise("snapshot_changed").alias("state"), "missing", "changed", "unexpected")


def restore_plan(snapshot: DataFrame, files: DataFrame, with_missing: bool = False) -> DataFrame:
    """path, before, after: hashes now and after a restore; missing files only on request."""
    now = build_manifest(files).select("path", F.col("sha256").alias("before"))
    rows = snapshot.select("path", F.col("sha256").alias("after")).join(now, "path", "left").where(~F.col("before").eqNullSafe(F.col("after")))
    return (rows if with_missing else rows.where("before IS NOT NULL")).select("path", "before", "after")


def snapshot_table(files: DataFrame, snapshot_id: str, chosen: DataFrame | None = None) -> DataFrame:
    """snapshot_id, path, content, sha256, bytes: a copy of the chosen files (``chosen``: path; None: all), to be kept as a table."""
    rows = files if chosen is None else files.join(chosen.select("path").distinct(), "path", "left_semi")
    return rows.select(F.lit(snapshot_id).alias("snapshot_id"), "path", "content", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def write_snapshot(snapshot: DataFrame, out: str) -> None:
    """Add a snapshot to the table of snapshots, in a folder of its own; earlier ones stay."""
    snapshot.write.mode("append").partitionBy("snapshot_id").parquet(out)


def restore(files: DataFrame, snapshot: DataFrame, plan: DataFrame, recovery_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files after the restore, recovery snapshot, conflicts). ``plan``: path, before, after, as ``restore_plan`` gives it.

    recovery: what the restore replaces, to be written before it. A conflict is a planned path whose file is no longer
    the planned one, or whose copy is not; with any conflict the files stay as they are.
    """
    now = files.select("path", F.sha2("content", 256).alias("now"))
    copies = snapshot.select("path", F.col("content").alias("copy"), F.sha2("content", 256).alias("held"))
    checked = plan.join(now, "path", "left").join(copies.select("path", "held"), "path", "left")
    conflicts = checked.where(~F.col("now").eqNullSafe(F.col("before")) | ~F.col("held").eqNullSafe(F.col("after"))).select("path")
    free = F.broadcast(conflicts.agg((F.count("*") == 0).alias("_free")))
    wanted = plan.select("path").join(copies.select("path", "copy"), "path").crossJoin(free).where("_free").select("path", "copy", F.lit(True).alias("_hit"))
    after = files.select("path", "content").join(wanted, "path", "full_outer").select("path", F.when(F.col("_hit"), F.col("copy")).otherwise(F.col("content")).alias("content"))
    return after, snapshot_table(files, recovery_id, plan), conflicts


def register_sources(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """source_no, source_id, outcome: registered, duplicate (of the registry or an earlier candidate) or empty."""
    known = registry.select("source_id").distinct().withColumn("known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("source_id").orderBy("source_no"))
    rows = candidates.withColumn("n", first).join(known, "source_id", "left")
    outcome = F.when(F.trim("text") == "", "empty").when(F.col("known") | (F.col("n") > 1), "duplicate").otherwise("registered")
    return rows.select("source_no", "source_id", outcome.alias("outcome"))


def mark_verified(pages: DataFrame, chosen: Column, actor: str) -> DataFrame:
    """path, before, after: who verified the chosen pages; index pages are refused."""
    refused = F.col("path").endswith("index.md")
    return pages.where(chosen & ~refused).select("path", F.col("verified_by").alias("before"), F.lit(actor).alias("after"))


def move_page(links: DataFrame, moves: DataFrame) -> DataFrame:
    """path, target_id, new_target_id: links with moved targets, and those of moved pages, rewritten. ``moves``: page_id, new_id."""
    to = moves.select(F.col("page_id").alias("target_id"), F.col("new_id").alias("new_target_id"))
    return links.join(to, "target_id").select("path", "target_id", "new_target_id")


def assign_claim_ids(claims: DataFrame) -> DataFrame:
    """path, line_no, claim_id for claims without one: the start of a hash of place and text, salted where that is taken."""
    seed = F.concat_ws(":", "path", "line_no", "text")
    name = lambda salt: F.concat(F.lit("clm-"), F.substring(F.sha2(F.concat(seed, F.lit(salt)), 256), 1, 16))
    again = F.row_number().over(Window.partitionBy(name("")).orderBy("path", "line_no"))
    taken = claims.select(F.col("claim_id").alias("new")).where("new IS NOT NULL").distinct().withColumn("taken", F.lit(True))
    rows = claims.where("claim_id IS NULL").withColumns({"new": name(""), "again": again}).join(taken, "new", "left")
    return rows.select("path", "line_no", F.when((F.col("again") > 1) | F.col("taken"), name("#")).otherwise(F.col("new")).alias("claim_id"))
