"""Queries of definitions, of the open format and of search reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.settled import settled
from quillon.functions.text import tokens, tokens_sql
from quillon.operators import bundle as B
from quillon.operators import definitions as D
from quillon.operators import passages as P
from quillon.operators import search as S
from quillon.plans import views as V
from quillon.plans.passage_queries import COUNTED, HITS, _kept, _members
from quillon.plans.search_queries import ORACLES, SIGNALS, TERMS, TOKENS, query


def definition_files(spark: SparkSession, d: str) -> DataFrame:
    """path, content: for each document a file of two concepts, a fenced block, a comment and, in every second, notes."""
    i, w = F.col("doc_id"), tokens(F.col("text"))
    word = lambda k: F.coalesce(F.get("w", F.lit(k)), F.lit("x"))
    own = F.concat(F.lit("c-"), i % 50)
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    broader = F.when(i % 5 == 0, own).when(i % 5 == 1, "c-901 | c-902").otherwise("")
    lines = [F.lit("# Concepts"), F.lit(""), line("## ", own), line("- Preferred: ", word(0)), line("- Status: ", F.when(i % 3 == 0, "active").when(i % 3 == 1, "draft").otherwise("odd")), line("- Aliases: ", word(1), " | ", word(2)),
             line("- Broader: ", broader), F.lit("~~~"), F.lit("## not-one"), F.lit("- Status: hidden"), F.lit("~~~~"), F.lit("<!-- a draft"), F.lit("- Status: hidden"), F.lit("-->"), F.when(i % 2 == 0, "## Notes").otherwise("text"),
             line("- Definition: ", word(3)), F.lit("- Note: other"), line("## ", F.when(i % 4 == 0, "c-").otherwise("d-"), i % 50), line("- Preferred: ", word(4)), F.when(i % 3 == 0, line("- preferred: ", word(5))).otherwise("- Status: active")]
    return V.table(spark, d, "documents").select("doc_id", w.alias("w")).select(F.concat(F.lit("schema/"), "doc_id", F.lit(".md")).alias("path"), F.concat_ws("\n", *lines).alias("content"))


WORD = "coalesce(w[{}], 'x')"
DEFINED = f"""
dw AS (SELECT doc_id AS i, 'schema/' || doc_id || '.md' AS path, 'c-' || (doc_id % 50) AS own, CASE WHEN doc_id % 4 = 0 THEN 'c-' ELSE 'd-' END || (doc_id % 50) AS other, {tokens_sql("text")} AS w FROM documents),
fields_of AS (SELECT i, path, own AS id, 3::BIGINT AS line, i % 4 <> 0 AS current, unnest([{{'f': 'preferred', 'v': {WORD.format(1)}}}, {{'f': 'status', 'v': ['active', 'draft', 'odd'][(i % 3 + 1)::INT]}}, {{'f': 'aliases', 'v': {WORD.format(2)} || ' | ' || {WORD.format(3)}}},
    {{'f': 'broader', 'v': CASE i % 5 WHEN 0 THEN own WHEN 1 THEN 'c-901 | c-902' ELSE '' END}}, CASE WHEN i % 2 = 1 THEN {{'f': 'definition', 'v': {WORD.format(4)}}} END, CASE WHEN i % 2 = 1 THEN {{'f': 'note', 'v': 'other'}} END], recursive := true) FROM dw
  UNION ALL SELECT i, path, other, 18, true, unnest([{{'f': 'preferred', 'v': CASE WHEN i % 3 = 0 THEN {WORD.format(6)} ELSE {WORD.format(5)} END}}, CASE WHEN i % 3 <> 0 THEN {{'f': 'status', 'v': 'active'}} END], recursive := true) FROM dw)"""


@query(f"WITH {DEFINED} SELECT path, id, line, current, f AS field, v AS value FROM fields_of WHERE f IS NOT NULL")
def load_definitions(spark: SparkSession, d: str) -> DataFrame:
    return D.load_definitions(definition_files(spark, d))[0].select("path", "id", "line", "current", F.explode("fields").alias("field", "value"))


@query(f"WITH {DEFINED} SELECT path, line, field, '## Notes' AS heading, own AS closed FROM dw, (VALUES (16::BIGINT, 'definition'), (17, 'note')) AS f(line, field) WHERE i % 2 = 0")
def definition_orphans(spark: SparkSession, d: str) -> DataFrame:
    return D.load_definitions(definition_files(spark, d))[1]


@query(f"""WITH {DEFINED} SELECT path, id AS concept_id, ord, term FROM (SELECT path, own AS id, unnest([{WORD.format(1)}, {WORD.format(2)}, {WORD.format(3)}]) AS term, unnest([0::BIGINT, 1, 2]) AS ord FROM dw WHERE i % 3 = 0 AND i % 4 <> 0
UNION ALL SELECT path, other, {WORD.format(5)}, 0 FROM dw WHERE i % 3 <> 0)""")
def concept_terms(spark: SparkSession, d: str) -> DataFrame:
    return D.concept_terms(D.load_definitions(definition_files(spark, d))[0]).withColumn("ord", F.col("ord").cast("long"))


@query(f"""WITH {DEFINED}, r AS (SELECT path, 3::BIGINT AS line, own AS id, unnest([CASE WHEN i % 2 = 0 THEN {{'code': 'missing-field', 'detail': 'definition'}} END, CASE WHEN i % 3 = 2 THEN {{'code': 'bad-status', 'detail': 'odd'}} END,
  CASE WHEN i % 5 = 1 THEN {{'code': 'several-broader', 'detail': 'c-901 | c-902'}} END, CASE WHEN i % 5 = 0 THEN {{'code': 'relation-to-itself', 'detail': own}} END, CASE WHEN i % 5 = 1 THEN {{'code': 'unknown-concept', 'detail': 'c-901'}} END, CASE WHEN i % 5 = 1 THEN {{'code': 'unknown-concept', 'detail': 'c-902'}} END], recursive := true) FROM dw WHERE i % 4 <> 0
UNION ALL SELECT path, 18, other, unnest([{{'code': 'missing-field', 'detail': 'definition'}}, CASE WHEN i % 3 = 0 THEN {{'code': 'missing-field', 'detail': 'status'}} END, CASE WHEN i % 3 = 0 THEN {{'code': 'bad-status', 'detail': ''}} END, CASE WHEN i % 4 = 0 THEN {{'code': 'duplicate-id', 'detail': '3'}} END], recursive := true) FROM dw
UNION ALL SELECT path, 16, own, 'orphaned-field', 'definition: move the field' FROM dw WHERE i % 2 = 0) SELECT * FROM r WHERE code IS NOT NULL""")
def definition_rules(spark: SparkSession, d: str) -> DataFrame:
    return D.definition_rules(*D.load_definitions(definition_files(spark, d)))


def exported_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(pages with all that the open format asks for, registry of their sources)."""
    i = F.col("page_id")
    source = F.concat(F.lit("[[src-"), F.substring(F.sha2("body", 256), 1, 16), F.lit("]]"))
    body = F.concat(F.lit("<!-- claim\nid: x\n-->\n"), "title", F.lit("\n<!-- /claim -->\nSee [[wiki/a b.md#part| "), "cluster", F.lit(" ]] and [[./notes/"), i, F.lit("]]."))
    pages = V.pages(spark, d).withColumns({
        "status": F.when(i % 10 == 2, "disputed").otherwise(F.col("status")), "tags": F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("cluster")), "stale_after": F.col("stale_after").cast("string"), "generated_by": F.when(i % 2 == 0, "agent:x").otherwise("Some One"),
        "generated_at": F.when(i % 5 == 0, "soon").otherwise("2024-01-02T10:00Z"), "verified_at": F.col("updated").cast("string"), "sources": F.array(source, F.lit("src-0000000000000000"), F.lit("none")), "body": body})
    text = F.coalesce("text", F.lit(""))
    registry = V.table(spark, d, "documents").select(F.col("doc_id").alias("line_no"), F.concat(F.lit("src-"), F.substring(F.sha2(text, 256), 1, 16)).alias("source_id"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("T"), "doc_id")).alias("title"),
                                                         F.concat("source", F.lit("/"), "doc_id").alias("original_ref"), F.when(F.col("doc_id") % 2 == 0, "2024-05-06").otherwise("May").alias("extracted_at"))
    return pages, registry


@query(f"""WITH {V.PAGES}, registry AS (SELECT sha256(coalesce(text, '')) AS h, arg_max(doc_id, doc_id) AS i, arg_max(source || '/' || doc_id, doc_id) AS ref FROM documents GROUP BY 1),
p AS (SELECT *, page_id AS n, CASE WHEN page_id % 10 = 2 THEN 'disputed' ELSE status END AS own FROM pages)
SELECT path, type, CASE WHEN trim(title) <> '' THEN title END AS title, CASE WHEN trim(description) <> '' THEN description END AS description, CASE WHEN n % 3 > 0 THEN cluster END AS tags, CASE own WHEN 'active' THEN 'stable' WHEN 'superseded' THEN 'deprecated' ELSE 'draft' END AS status,
  stale_after::VARCHAR AS stale_after, CASE WHEN n % 2 = 0 AND n % 5 <> 0 THEN 'agent:x' END AS generated_by, verified_by || ' ' || updated::VARCHAR AS verified, 'src-' || h[1:16] || ',' || concat_ws(',', CASE WHEN r.i % 3 > 0 THEN 'T' || r.i END, ref, CASE WHEN r.i % 2 = 0 THEN '2024-05-06' END) AS sources,
  regexp_replace(title, '^\\s+|\\s+$', '', 'g') || chr(10) || 'See [' || cluster || '](/wiki/a b.md) and [' || n || '](/notes/' || n || '.md).' AS body,
  concat_ws('; ', CASE WHEN own = 'disputed' THEN 'disputed is exported as draft' END, CASE WHEN trim(title) = '' THEN 'missing recommended field: title' END, CASE WHEN trim(description) = '' THEN 'missing recommended field: description' END, CASE WHEN n % 3 = 0 THEN 'missing recommended field: tags' END, 'missing recommended field: resource') AS notes
FROM p JOIN registry r ON r.h = sha256(body)""")
def okf_export(spark: SparkSession, d: str) -> DataFrame:
    rows = B.okf_export(*exported_pages(spark, d))
    sources = F.array_join(F.transform("sources", lambda x: F.concat_ws(",", x["id"], x["title"], x["resource"], x["last_modified"])), ";")
    flat = {"tags": F.array_join("tags", ","), "generated_by": F.col("generated.by"), "verified": F.concat("verified.by", F.lit(" "), "verified.at"), "sources": sources, "notes": F.array_join("notes", "; ")}
    return rows.withColumns(flat).drop("generated")


@query(f"""WITH RECURSIVE {SIGNALS}{HITS.removeprefix(TOKENS + ", " + TERMS)}, {COUNTED}, c AS (SELECT qid AS fid, count(*) AS n FROM counted WHERE counted GROUP BY qid),
needed AS (SELECT fid, count(*) AS n, sum(least(length(text), 400)) AS chars FROM hits JOIN (SELECT pid, text FROM passages) USING (pid) GROUP BY fid), r AS (SELECT fid, count(*) AS n, string_agg(path, ' ' ORDER BY rank) FILTER (rank <= 12) AS results FROM ranked GROUP BY fid),
placed_hits AS (SELECT fid, pid, row_number() OVER (PARTITION BY fid ORDER BY strength <> 'word_form', h.path, line_no, pid) AS place FROM hits h JOIN (SELECT pid, line_no FROM passages) USING (pid)),
printed AS (SELECT fid, count(*) AS n, string_agg(pid, ' ' ORDER BY place) AS hits FROM placed_hits GROUP BY fid),
values_of AS (SELECT fid, field, value, count(*) AS n FROM (SELECT fid, unnest(['type', 'status', 'language', 'cluster', 'concept']) AS field, unnest([type, status, language, cluster, concept]) AS value FROM ranked JOIN pages USING (path)) GROUP BY ALL),
f AS (SELECT fid, string_agg(field || '=' || value || ':' || n, ' ' ORDER BY field, value) AS facets FROM values_of GROUP BY fid),
files_of AS (SELECT fid, term, path, max(CASE WHEN m.token = m.term THEN 1 ELSE 0 END) AS literal FROM (SELECT DISTINCT path, token FROM postings) p JOIN members m ON m.token = p.token GROUP BY ALL),
counted_files AS (SELECT m.fid, m.term, count(h.path) AS files, count(h.path) FILTER (literal = 0) AS form_files FROM (SELECT DISTINCT fid, term FROM terms WHERE dropped IS NULL) m LEFT JOIN files_of h ON h.fid = m.fid AND h.term = m.term GROUP BY ALL),
v AS (SELECT fid, string_agg(term || ':' || files || ':' || form_files, ' ' ORDER BY term) AS coverage FROM counted_files GROUP BY fid),
fused AS ({ORACLES["fuse_formulations"]}), b AS (SELECT qid AS fid, string_agg(path || ':' || no || ':' || rank, ' ' ORDER BY place) AS reformulations FROM fused GROUP BY qid),
told AS (SELECT q.fid, q.text, coalesce(results, '') AS results, coalesce(reformulations, '') AS reformulations, coalesce(coverage, '') AS coverage, coalesce(facets, '') AS facets, coalesce(printed.hits, '') AS hits, coalesce(r.n, 0) AS n_matches, coalesce(needed.n, 0) AS n_hits, coalesce(printed.n, 0) AS n_printed,
  concat_ws(',', CASE WHEN coalesce(c.n, 0) < 2 THEN 'too_few_reformulations' END, CASE WHEN q.fid NOT IN (SELECT fid FROM terms WHERE dropped IS NULL) THEN 'no_content_words' END, CASE WHEN coalesce(chars, 0) > 2000 THEN 'budget_exhausted' END) AS reasons
  FROM questions q LEFT JOIN r USING (fid) LEFT JOIN needed USING (fid) LEFT JOIN c USING (fid) LEFT JOIN printed USING (fid) LEFT JOIN f USING (fid) LEFT JOIN v USING (fid) LEFT JOIN b USING (fid))
SELECT fid, text, results, reformulations, coverage, facets, hits, n_printed, n_matches, n_hits, reasons = '' AS complete, 'matches=' || n_matches || ' hits=' || n_hits || ' complete=' || (reasons = '') || CASE WHEN reasons <> '' THEN ' reasons=' || reasons ELSE '' END AS audit FROM told""")
def write_report(spark: SparkSession, d: str) -> DataFrame:
    """The rows that ``bundle.write_report`` writes, with their lists joined."""
    pages, terms, members, found = _members(spark, d)
    questions, kept = V.questions(spark, d), _kept(spark, d)
    forms = kept.select(F.struct("qid", "no").alias("fid"), "text")
    fields, terms = S.split_fields(pages), settled(terms.select("fid", "term"))
    asked, form_terms = S.wanted_members(fields, terms), settled(S.query_term_plan(forms).where("dropped IS NULL").select("fid", "term"))
    form_asked = S.wanted_members(fields, form_terms)
    # one reading of the texts for the ranking of questions, that of reformulations, and coverage
    held = settled(S.asked_postings(fields, members.select("token").unionByName(asked.select("token")).unionByName(form_asked.select("token"))))
    scores = S.page_scores(pages, terms, asked, held, levels=False)
    facets = settled(S.facets(scores.select("fid", "path"), pages))
    ranked = settled(S.signalled(scores, pages, questions, limit=12))
    by_form = S.signalled(S.page_scores(pages, form_terms, form_asked, held, levels=False), pages, forms, limit=12)
    fused = S.fuse_formulations(by_form.select("fid.qid", "fid.no", "path", "rank")).withColumnRenamed("qid", "fid")
    hits = settled(P.passage_hits(found, members, terms))
    # of the passages only those of pages with a hit are read again
    near = settled(P.passages(pages.join(hits.select("path").distinct(), "path", "left_semi")).join(hits.select("pid").distinct(), "pid", "left_semi").select("pid", "line_no", "text"))
    absence = P.absence_check(questions, hits, P.counted_reformulations(kept), terms.withColumn("dropped", F.lit(None).cast("string")), near, budget=2000)
    matches = facets.where("field = 'status'").groupBy("fid").agg(F.sum("n").alias("n_matches"))
    report = B.search_report(questions, ranked, P.coverage_account(members, held, terms), absence, P.hit_order(hits, near), facets, fused, matches=matches)
    joined = lambda name, *parts: F.array_join(F.transform(name, lambda x: F.concat(*(x[p] if p.isalpha() or "_" in p else F.lit(p) for p in parts))), " ").alias(name)
    lists = joined("results", "path"), joined("reformulations", "path", ":", "no", ":", "rank"), joined("coverage", "term", ":", "files", ":", "form_files"), joined("facets", "field", "=", "value", ":", "n"), joined("hits", "pid")
    return report.select("fid", "text", *lists, F.size("hits").cast("long").alias("n_printed"), "n_matches", "n_hits", "complete", "audit")
