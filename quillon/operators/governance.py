"""Rules, trust, freshness, links, evidence: findings about pages, claims and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Review intervals in days.
REVIEW_DAYS = {"quality": 30, "cleaning": 90}


def trust_audit(pages: DataFrame) -> DataFrame:
    """path, trust_tier, finding: the tier follows from who verified the page."""
    who = F.col("verified_by")
    actor = who.rlike("^[a-z]+:[a-z0-9][a-z0-9._-]*$")
    tier = F.when(who.isNull() | ~actor, "unverified").when(who.startswith("human:"), "human-reviewed").otherwise("machine-confirmed")
    return pages.select("path", tier.alias("trust_tier"), F.when(who.isNotNull() & ~actor, "malformed-actor").alias("finding"))


def trust_distribution(pages: DataFrame) -> DataFrame:
    """trust_tier, n, share (four digits)."""
    counts = trust_audit(pages).groupBy("trust_tier").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def expiry_audit(pages: DataFrame, today: str) -> DataFrame:
    """path, is_stale, days_past: a page without an end date never expires."""
    past = F.datediff(F.lit(today).cast("date"), "stale_after")
    return pages.select("path", F.coalesce(past > 0, F.lit(False)).alias("is_stale"), F.when(past > 0, past).cast("long").alias("days_past"))


def freshness_summary(pages: DataFrame, today: str) -> DataFrame:
    """pages, with_expiry, expired."""
    return pages.agg(F.count("*").alias("pages"), F.count("stale_after").alias("with_expiry"), F.count_if(F.col("stale_after") < F.lit(today).cast("date")).alias("expired"))


def latest_review(reviews: DataFrame) -> DataFrame:
    """collection, kind, reviewed_at, review_id, outcome: the last by time, then by id."""
    last = F.max_by(F.struct("reviewed_at", "review_id", "outcome"), F.struct("reviewed_at", "review_id")).alias("r")
    return reviews.groupBy("collection", "kind").agg(last).select("collection", "kind", "r.*")


def review_health(latest: DataFrame, now: str) -> DataFrame:
    """collection, state: the worst over its reviews of attention-needed (the outcome says so), overdue (as old as the interval), due-soon (the last fifth of it, 3 to 14 days), current."""
    days = F.coalesce(F.create_map(*(F.lit(x) for k, v in REVIEW_DAYS.items() for x in (k, v)))[F.col("kind")], F.lit(60))
    soon = F.least(F.greatest(F.round(days * 0.2), F.lit(3)), F.lit(14))
    age = F.greatest(F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("reviewed_at").cast("timestamp"))) / 86400), F.lit(0))
    rank = F.when(F.col("outcome") == "failed", 3).when(age >= days, 2).when(days - age <= soon, 1).otherwise(0)
    worst = latest.withColumn("rank", rank).groupBy("collection").agg(F.max("rank").alias("rank"))
    return worst.select("collection", F.element_at(F.array(*map(F.lit, ("current", "due-soon", "overdue", "attention-needed"))), F.col("rank") + 1).alias("state"))


def field_rules(pages: DataFrame) -> DataFrame:
    """path, code: one row for each rule a page breaks, from one projection."""
    rules = {
        "missing-title": F.trim("title") == "", "long-title": F.length("title") > 200, "missing-description": F.col("description") == "",
        "long-description": F.length("description") > 120, "bad-status": ~F.col("status").isin("active", "draft", "superseded", "withdrawn"),
        "bad-language": ~F.col("language").rlike("^[a-z]{2}$"), "todo-in-active": (F.col("status") == "active") & F.col("body").rlike(r"(?i)\btodo\b"),
        "expires-before-update": F.col("stale_after") < F.col("updated"),
    }
    codes = F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in rules.items())))
    return pages.select("path", F.explode(codes).alias("code"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """key, n of keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def wikilink_join(links: DataFrame, pages: DataFrame) -> DataFrame:
    """path, target_id, resolved, target_path."""
    known = pages.select(F.col("page_id").alias("target_id"), F.col("path").alias("target_path"))
    return links.join(known, "target_id", "left").select("path", "target_id", F.col("target_path").isNotNull().alias("resolved"), "target_path")


def inbound_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """path, inbound, orphan."""
    counts = links.groupBy(F.col("target_id").alias("page_id")).agg(F.count("*").alias("inbound"))
    return pages.select("path", "page_id").join(counts, "page_id", "left").select("path", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.col("inbound").isNull().alias("orphan"))


def graph_nodes(pages: DataFrame) -> DataFrame:
    """kind, id: pages, clusters and concepts."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in (("file", "path"), ("cluster", "cluster"), ("concept", "concept"))))
    return pages.select(F.inline(pairs)).where("id IS NOT NULL").distinct()


def graph_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """kind, source, target without repeats; links that lead nowhere have a null target."""
    own = F.array(*(F.struct(F.lit(k).alias("kind"), F.col("path").alias("source"), F.col(k).alias("target")) for k in ("cluster", "concept")))
    found = wikilink_join(links, pages).select(F.lit("wikilink").alias("kind"), F.col("path").alias("source"), F.col("target_path").alias("target"))
    return pages.select(F.inline(own)).unionByName(found).distinct()


def reference_integrity(claims: DataFrame, citations: DataFrame, sources: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """code, subject: what points to something that is not there."""
    known = claims.select(F.col("claim_id").alias("replaces")).distinct()
    replaced = claims.where("replaces IS NOT NULL").join(known, "replaces", "left_anti").select(F.lit("unknown-replaced-claim").alias("code"), F.col("claim_id").alias("subject"))
    cited = citations.join(sources.select("source_no").distinct(), "source_no", "left_anti").select(F.lit("unknown-source").alias("code"), F.col("claim_id").alias("subject"))
    broken = wikilink_join(links, pages).where(~F.col("resolved")).select(F.lit("broken-link").alias("code"), F.col("path").alias("subject"))
    return replaced.unionByName(cited).unionByName(broken)


def lint_report(findings: DataFrame, errors: tuple[str, ...]) -> DataFrame:
    """code, level, n of each finding."""
    level = F.when(F.col("code").isin(*errors), "error").otherwise("warning")
    return findings.groupBy("code").agg(F.count("*").alias("n")).select("code", level.alias("level"), "n")


def directory_index(pages: DataFrame) -> DataFrame:
    """directory, n, entries: one sorted listing per directory with titles and statuses that are not the default."""
    entry = F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(")"), F.when(F.col("status") != "active", F.concat(F.lit(" ("), "status", F.lit(")"))).otherwise(""))
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return pages.groupBy(directory.alias("directory")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("entries"))


def path_audit(files: DataFrame) -> DataFrame:
    """path, reason: names that another system may refuse or confuse."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    reasons = F.array_compact(F.array(
        F.when(F.length("path") > 260, "long-path"), F.when(name.rlike(r'[<>:"|?*\\]'), "invalid-character"), F.when(name.rlike(r"[. ]$"), "trailing-character"),
        F.when(F.lower(name).rlike(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"), "reserved-name"), F.when(name.rlike(r"(?i)conflict|\([0-9]+\)\.md$"), "conflict-copy"),
        F.when(name.isin(".DS_Store", "Thumbs.db", "desktop.ini"), "system-file")))
    clash = files.groupBy(F.lower("path").alias("low")).agg(F.count("*").alias("n")).where("n > 1")
    clashing = files.withColumn("low", F.lower("path")).join(clash, "low", "left_semi").select("path", F.lit("case-clash").alias("reason"))
    return files.select("path", F.explode(reasons).alias("reason")).unionByName(clashing)


#: Our own rules for credentials in text: published prefixes of tokens, and words that announce a secret.
SECRET_RULES = {
    "assigned-secret": r"(?i)(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|token|credential)s?[\"']?\s*[=:]\s*[^\s]{6,}", "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "cloud-key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "bearer": r"(?i)bearer [a-z0-9._-]{16,}", "code-host-token": r"\b(?:gh[pousr]_[0-9A-Za-z]{36}|github_pat_[0-9A-Za-z_]{22,}|glpat-[0-9A-Za-z_-]{20,})",
    "chat-token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}", "web-token": r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}", "maps-key": r"\bAIza[0-9A-Za-z_-]{35}", "payment-key": r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "model-key": r"\bsk-[0-9A-Za-z_-]{20,}", "package-token": r"\b(?:npm_[0-9A-Za-z]{36}|pypi-[0-9A-Za-z_-]{16,})", "login-in-address": r"\b[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]{3,}@", "encrypted-key": r"-----BEGIN PGP PRIVATE KEY BLOCK-----",
}


def secret_screen(pages: DataFrame) -> DataFrame:
    """path, line_no, rule for each line in which a rule finds a credential."""
    lines = pages.select("path", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(rx), F.lit(name)) for name, rx in SECRET_RULES.items())))
    return lines.select("path", F.col("line_no").cast("long").alias("line_no"), F.explode(hits).alias("rule"))


def extraction_quality(sources: DataFrame) -> DataFrame:
    """source_no, state, problems: texts that look badly extracted."""
    text = F.col("text")
    longest = F.array_max(F.transform(F.split(text, "\n"), lambda x: F.length(x)))
    n_fences = F.size(F.filter(F.split(text, "\n"), lambda x: x.startswith("```")))
    errors = [F.when(F.trim(text) == "", "empty"), F.when(text.contains("�"), "replacement-character"), F.when(longest > 20000, "flattened")]
    warnings = [F.when((longest > 2000) & (longest <= 20000), "long-line"), F.when(n_fences % 2 == 1, "odd-fences")]
    rows = sources.select("source_no", F.array_compact(F.array(*errors)).alias("e"), F.array_compact(F.array(*warnings)).alias("w"))
    return rows.select("source_no", F.when(F.size("e") > 0, "error").when(F.size("w") > 0, "warning").otherwise("ok").alias("state"), F.array_join(F.concat("e", "w"), " ").alias("problems"))


def property_inventory(pages: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """property, n, n_values: which properties occur, and how many values they have."""
    pairs = F.array(*(F.struct(F.lit(x).alias("property"), F.col(x).cast("string").alias("value")) for x in names))
    return pages.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("property").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def claim_rules(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """claim_id, code: bad ids, kinds and statuses, no text, no source, malformed locators."""
    rules = {
        "bad-id": ~F.col("claim_id").rlike("^clm-[0-9a-f]{16}$"), "bad-kind": ~F.col("kind").isin("fact", "decision", "estimate", "rule"),
        "bad-status": ~F.col("status").isin("active", "disputed", "superseded", "unsupported"), "no-text": F.trim("text") == "",
    }
    own = claims.select("claim_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("code"))
    none = claims.join(citations.select("claim_id"), "claim_id", "left_anti").select("claim_id", F.lit("no-source").alias("code"))
    odd = citations.where(~F.col("locator").rlike("^(?:document|(?:page|slide)=[0-9]+(?:-[0-9]+)?|(?:section|heading|sheet|timestamp)=.+)$")).select("claim_id", F.lit("malformed-locator").alias("code"))
    return own.unionByName(none).unionByName(odd)


def findability_check(questions: DataFrame, claims: DataFrame, ranked: DataFrame, limit: int = 12) -> DataFrame:
    """fid, status: whether the page of a question's target claim is found. ``questions``: fid, claim_id."""
    rows = questions.join(claims.select("claim_id", "path", "status"), "claim_id", "left").join(ranked.select("fid", "path", "rank"), ["fid", "path"], "left")
    told = F.when(F.col("path").isNull(), "target_missing").when(~F.col("status").isin("active", "disputed"), "target_inactive").when(F.col("rank") <= limit, "found").otherwise("not_found")
    return rows.select("fid", told.alias("status"))


def alias_review(words: DataFrame, files: DataFrame, n_pages: int) -> DataFrame:
    """term, n: alias words that stand on so many content pages that they do not tell pages apart. ``words``: term; ``files``: path, token."""
    held = files.join(F.broadcast(words.select(F.col("term").alias("token")).distinct()), "token")
    counts = held.groupBy(F.col("token").alias("term")).agg(F.countDistinct("path").alias("n"))
    return counts.where(F.col("n") >= max(3, -(-n_pages // 10)))


def page_preflight(pages: DataFrame) -> DataFrame:
    """path, code: staged pages that must not be written."""
    longest = F.array_max(F.transform(F.split("body", "\n"), lambda x: F.length(x)))
    rules = {"empty-body": F.trim("body") == "", "nul-character": F.col("body").contains("\0"), "replacement-character": F.col("body").contains("�"), "long-line": longest > 20_000}
    return pages.select("path", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("code"))


def write_tables(out: str, **tables: DataFrame) -> None:
    """Each table as Parquet in a folder of its own name, for reports and graphs."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")
