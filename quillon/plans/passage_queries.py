"""Queries of the exhaustive scan and of Markdown pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.settled import settled
from quillon.functions.text import fold_sql, stem_sql, tokens, tokens_sql, verb_keys_sql
from quillon.operators import lexicon as L
from quillon.operators import markup as M
from quillon.operators import passages as P
from quillon.operators import search as S
from quillon.plans import views as V
from quillon.plans.governance_queries import FORMS, RESOLVED, VOCABULARY, WORD_PARTS
from quillon.plans.search_queries import SIGNALS, TERMS, TOKENS, WORDS, query

PASSAGES = """
every_line AS (SELECT path, status, title, rtrim(line) AS line, (i - 1)::BIGINT AS line_no, CASE WHEN starts_with(line, '<!-- page: ') AND ends_with(line, ' -->') THEN 'page=' || split_part(line, ' ', 3) END AS mark
  FROM (SELECT path, status, title, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM pages)),
located AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS loc FROM every_line),
raw_lines AS (SELECT * EXCLUDE (mark), CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6} +[^ ]') THEN 'heading' WHEN regexp_matches(line || ' ', '^\\s*(?:[-*+]|[0-9]{1,9}[.)])\\s') THEN 'item' WHEN starts_with(ltrim(line), '|') THEN 'table' ELSE 'paragraph' END AS kind FROM located WHERE mark IS NULL),
beside AS (SELECT *, coalesce(lag(kind) OVER w, 'blank') AS before, coalesce(lag(line) OVER w, '') AS above FROM raw_lines WINDOW w AS (PARTITION BY path ORDER BY line_no)),
islands AS (SELECT *, kind IN ('paragraph', 'item') AND before NOT IN ('paragraph', 'item') AS first, sum((kind IN ('paragraph', 'item') AND before NOT IN ('paragraph', 'item'))::INT) OVER (PARTITION BY path ORDER BY line_no) AS island,
  sum((kind = 'table' AND before <> 'table')::INT) OVER (PARTITION BY path ORDER BY line_no) AS table_no FROM beside),
modes AS (SELECT *, min(CASE WHEN kind = 'item' AND (first OR ends_with(above, ':')) THEN line_no END) OVER (PARTITION BY path, island) AS listed FROM islands WHERE kind <> 'blank'),
line_places AS (SELECT *, sum((kind IN ('heading', 'table') OR first OR (kind = 'item' AND coalesce(line_no >= listed, false)))::INT) OVER (PARTITION BY path ORDER BY line_no) AS block FROM modes),
plain_blocks AS (SELECT path, status, title, min(line_no) AS line_no, arg_min(kind, line_no) AS kind, arg_min(table_no, line_no) AS table_no, count(*) AS n_lines, arg_min(line, line_no) AS first_line, string_agg(trim(line), ' ' ORDER BY line_no) AS joined, arg_min(loc, line_no) AS a, arg_max(loc, line_no) AS z FROM line_places GROUP BY path, status, title, block),
blocks AS (SELECT path, status, title, line_no, kind, table_no, n_lines, CASE kind WHEN 'heading' THEN trim(ltrim(first_line, '#')) WHEN 'table' THEN first_line ELSE joined END AS text, CASE WHEN a = z OR z = '' THEN a WHEN a = '' THEN z ELSE a || '-' || split_part(z, '=', 2) END AS locator,
  CASE WHEN kind = 'heading' THEN length(first_line) - length(ltrim(first_line, '#')) WHEN kind = 'paragraph' AND n_lines = 1 AND length(joined) <= 100 AND ends_with(joined, ':') THEN 7 END AS level FROM plain_blocks),
page_heads AS (SELECT path, line_no, level, text, min(line_no) FILTER (level <= 1) OVER w AS n1, min(line_no) FILTER (level <= 2) OVER w AS n2, min(line_no) FILTER (level <= 3) OVER w AS n3, min(line_no) FILTER (level <= 7) OVER w AS n7 FROM blocks WHERE level IS NOT NULL
  WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
page_spans AS (SELECT path, line_no, text, level, CASE level WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE n7 END AS until FROM page_heads),
sections AS (SELECT b.path, b.line_no, list(s.text ORDER BY s.line_no) AS section FROM blocks b JOIN page_spans s ON s.path = b.path AND s.line_no < b.line_no AND (s.until IS NULL OR b.line_no < s.until OR (b.line_no = s.until AND b.level > s.level)) GROUP BY ALL),
headers AS (SELECT path, table_no, arg_min(text, line_no) AS header, min(line_no) AS top FROM blocks WHERE kind = 'table' GROUP BY ALL),
in_section AS (SELECT b.path, b.status, b.title, b.line_no, b.kind, b.locator, coalesce(s.section, []) AS section, CASE WHEN b.kind = 'table' AND b.line_no > h.top THEN h.header END AS header, b.text
  FROM blocks b LEFT JOIN sections s ON s.path = b.path AND s.line_no = b.line_no LEFT JOIN headers h ON h.path = b.path AND h.table_no = b.table_no AND b.kind = 'table'),
cut_texts AS (SELECT *, CASE WHEN length(text) < 1500 THEN [text] ELSE list_reduce(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: [x]),
  lambda acc, x: CASE WHEN length(acc[-1]) >= 1500 THEN list_concat(acc, x) ELSE list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) END) END AS cuts FROM in_section),
passages AS (SELECT path, path || '#' || line_no || '#' || (part - 1) AS pid, line_no, kind, status, title, locator, section, header, text FROM (SELECT path, line_no, kind, status, title, locator, section, header, unnest(cuts) AS text, generate_subscripts(cuts, 1) AS part FROM cut_texts))"""
PTOKENS = f"""
ptokens AS (SELECT pid, path, unnest(list_distinct({tokens_sql("text")})) AS token FROM passages)"""
MEMBERS = VOCABULARY + ", " + WORD_PARTS + ", " + RESOLVED.replace(WORD_PARTS + ",", "") + ", " + PASSAGES + ", " + PTOKENS + """,
members AS (SELECT t.fid, t.term, f.token, f.rule, f.weight FROM terms t JOIN resolved f USING (term) WHERE dropped IS NULL)"""


def _members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """pages, terms asked, members (fid, term, token, rule, weight), passages."""
    pages = V.pages(spark, d)
    terms = S.query_term_plan(V.questions(spark, d))
    asked = terms.where("dropped IS NULL")
    members = L.resolve_terms(asked, S.distinct_tokens(S.split_fields(pages)))
    return pages, asked, settled(asked.select("fid", "term").join(members, "term")), P.passages(pages)


def structured_pages(pages: DataFrame) -> DataFrame:
    """Pages whose lines stand under headings, labels and page marks, some of them as list items."""
    words = lambda x: F.array_join(F.slice(tokens(x), 1, 2), " ")

    def line(x, i):
        above = F.when(i % 7 == 0, F.concat(F.lit("\n## H "), words(x), F.lit("\n"))).when(i % 7 == 3, F.concat(F.lit("### K "), words(x), F.lit("\n"))).when(i % 7 == 5, F.concat(F.lit("\nOf "), words(x), F.lit(":\n\n")))
        above = above.when(i % 7 == 2, F.concat(F.lit("<!-- page: "), i + 1, F.lit(" -->\n"))).otherwise("")
        return F.concat(above, F.when(i % 5 == 4, "- ").otherwise(""), x)

    return pages.withColumn("body", F.concat(F.when(F.col("page_id") % 2 == 0, "# Top\n").otherwise(""), F.array_join(F.transform(F.split("body", "\n"), line), "\n")))


MARK_WORDS = f"array_to_string(({tokens_sql('x')})[1:2], ' ')"
STRUCTURED = V.PAGES.replace("pages AS (", "plain_pages AS (") + f""",
page_lines AS (SELECT path, unnest(string_split(body, chr(10))) AS x, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS i FROM plain_pages),
bodies AS (SELECT path, string_agg(CASE i % 7 WHEN 0 THEN chr(10) || '## H ' || {MARK_WORDS} || chr(10) WHEN 3 THEN '### K ' || {MARK_WORDS} || chr(10) WHEN 5 THEN chr(10) || 'Of ' || {MARK_WORDS} || ':' || chr(10) || chr(10) WHEN 2 THEN '<!-- page: ' || (i + 1) || ' -->' || chr(10) ELSE '' END
  || CASE WHEN i % 5 = 4 THEN '- ' ELSE '' END || x, chr(10) ORDER BY i) AS marked FROM page_lines GROUP BY path),
pages AS (SELECT p.* REPLACE (CASE WHEN page_id % 2 = 0 THEN '# Top' || chr(10) ELSE '' END || marked AS body) FROM plain_pages p JOIN bodies USING (path))"""


@query(f"WITH {STRUCTURED}, {PASSAGES} SELECT * FROM passages")
def passages(spark: SparkSession, d: str) -> DataFrame:
    return P.passages(structured_pages(V.pages(spark, d)))


@query(f"WITH {V.PAGES}, {PASSAGES}, {PTOKENS} SELECT * FROM ptokens")
def passage_tokens(spark: SparkSession, d: str) -> DataFrame:
    return P.passage_tokens(P.passages(V.pages(spark, d)))


HITS = MEMBERS + f""",
need AS (SELECT fid, count(DISTINCT term) AS need FROM terms WHERE dropped IS NULL GROUP BY fid),
around AS (SELECT pid, path, unnest(list_distinct({tokens_sql("concat_ws(' ', array_to_string(section, ' '), header, title)")})) AS token FROM passages),
ctokens AS (SELECT pid, path, token, bool_or(own) AS own FROM (SELECT pid, path, token, true AS own FROM ptokens UNION ALL SELECT pid, path, token, false FROM around) GROUP BY ALL),
in_context AS (SELECT fid, pid, path, term, bool_or(own) AS own, bool_or(weight >= 0.5) AS sure FROM ctokens JOIN members USING (token) GROUP BY fid, pid, path, term),
hits AS (SELECT fid, pid, path, CASE WHEN bool_and(sure) THEN 'word_form' ELSE 'heuristic' END AS strength FROM in_context JOIN need USING (fid) GROUP BY fid, pid, path, need HAVING count(*) = need AND bool_or(own))"""


@query(f"WITH RECURSIVE {HITS} SELECT fid, term, pid, path, own, sure FROM in_context")
def passage_context_join(spark: SparkSession, d: str) -> DataFrame:
    _, _, members, found = _members(spark, d)
    return P.passage_context_join(found, members)


@query(f"WITH RECURSIVE {HITS} SELECT * FROM hits")
def passage_hits(spark: SparkSession, d: str) -> DataFrame:
    _, terms, members, found = _members(spark, d)
    return P.passage_hits(found, members, terms)


@query(f"""WITH RECURSIVE {MEMBERS} SELECT term, coalesce(passages, 0) AS passages, coalesce(files, 0) AS files FROM asked LEFT JOIN
(SELECT term, count(DISTINCT pid) AS passages, count(DISTINCT path) AS files FROM (SELECT DISTINCT term, token FROM members) m JOIN ptokens USING (token) GROUP BY term) USING (term)""")
def token_census(spark: SparkSession, d: str) -> DataFrame:
    _, terms, members, found = _members(spark, d)
    return P.token_census(found, members, terms)


CELLS = "list_filter(list_transform(string_split({}, '|'), lambda c: trim(c)), lambda c: NOT regexp_matches(c, '^[:-]*$'))"


def table_pages(pages: DataFrame) -> DataFrame:
    """Pages whose body is a table: a row of the first words of each line."""
    cells = lambda x: F.concat(F.lit("| "), F.array_join(F.slice(tokens(x), 1, 4), " | "), F.lit(" |"))
    return pages.withColumn("body", F.concat(F.lit("# T\n| one | two |\n| :-- | --- |\n"), F.array_join(F.transform(F.split("body", "\n"), cells), "\n")))


TABLE_PAGES = V.PAGES.replace("pages AS (", "plain_pages AS (") + f""",
pages AS (SELECT * REPLACE ('# T' || chr(10) || '| one | two |' || chr(10) || '| :-- | --- |' || chr(10) || array_to_string(list_transform(string_split(body, chr(10)), lambda x: '| ' || array_to_string(({tokens_sql("x")})[1:4], ' | ') || ' |'), chr(10)) AS body) FROM plain_pages)"""


@query(f"""WITH {TABLE_PAGES}, {PASSAGES}, r AS (SELECT pid, path, {CELLS.format("text")} AS c, CASE WHEN header IS NOT NULL THEN {CELLS.format("header")} END AS h FROM passages WHERE kind = 'table')
SELECT pid, path, array_to_string(list_transform(c, lambda x, i: coalesce(h[i] || ': ', '') || x), ' | ') AS cells FROM r WHERE len(c) > 0""")
def table_passages(spark: SparkSession, d: str) -> DataFrame:
    return P.table_passages(P.passages(table_pages(V.pages(spark, d))))


ROOM = 396


@query(f"""WITH RECURSIVE {HITS}, w AS (SELECT fid, list(DISTINCT token) AS wanted FROM members GROUP BY fid),
x AS (SELECT fid, pid, text, string_split(text, ' ') AS words, wanted FROM hits JOIN w USING (fid) JOIN (SELECT pid, text FROM passages) USING (pid)),
f AS (SELECT *, coalesce(list_filter(range(1, len(words) + 1), lambda i: list_has_any({tokens_sql("words[i]")}, wanted))[1], 1) AS first FROM x),
b AS (SELECT *, first - list_max([0] || list_filter(range(1, least(first - 1, 100) + 1), lambda k: length(array_to_string(words[first - k:first - 1], ' ')) + 1 <= 100)) AS start FROM f),
n0 AS (SELECT *, list_max([0] || list_filter(range(1, 398), lambda k: start + k - 1 <= len(words) AND length(array_to_string(words[start:start + k - 1], ' ')) <= {ROOM})) AS n_first FROM b),
s1 AS (SELECT * REPLACE (CASE WHEN start + n_first <= first THEN first ELSE start END AS start) FROM n0),
n1 AS (SELECT *, list_max([0] || list_filter(range(1, 398), lambda k: start + k - 1 <= len(words) AND length(array_to_string(words[start:start + k - 1], ' ')) <= {ROOM})) AS n FROM s1)
SELECT fid, pid, CASE WHEN length(text) <= 400 THEN text ELSE CASE WHEN start > 1 THEN '… ' ELSE '' END || CASE WHEN n = 0 THEN substr(words[start], 1, {ROOM}) ELSE array_to_string(words[start:start + n - 1], ' ') END || CASE WHEN n = 0 OR start + n - 1 < len(words) THEN ' …' ELSE '' END END AS excerpt FROM n1""")
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    _, terms, members, found = _members(spark, d)
    return P.excerpt(P.passage_hits(found, members, terms), found, members)


ALTERNATIVES = HITS + """,
alternatives AS (SELECT DISTINCT a.fid, a.term, 'concept' AS alt, b.token, b.weight FROM terms a JOIN terms o ON o.fid = a.fid AND o.dropped IS NULL AND o.term <> a.term JOIN members b ON b.fid = o.fid AND b.term = o.term AND b.token = o.term
  WHERE a.dropped IS NULL AND a.ord = (SELECT min(ord) FROM terms m WHERE m.fid = a.fid AND m.dropped IS NULL)),
alt_size AS (SELECT fid, term, alt, count(DISTINCT token) AS size FROM alternatives GROUP BY ALL),
alt_met AS (SELECT fid, term, pid, path, bool_or(own) AS own, bool_and(weight >= 0.5) AS sure FROM ctokens JOIN alternatives USING (token) JOIN alt_size USING (fid, term, alt) GROUP BY fid, term, alt, size, pid, path HAVING count(DISTINCT token) = size),
either AS (SELECT fid, term, pid, path, bool_or(own) AS own, bool_or(sure) AS sure FROM (SELECT fid, term, pid, path, own, sure FROM in_context UNION ALL SELECT * FROM alt_met) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {ALTERNATIVES} SELECT fid, pid, path, CASE WHEN bool_and(sure) THEN 'word_form' ELSE 'heuristic' END AS strength FROM either JOIN need USING (fid) GROUP BY fid, pid, path, need HAVING count(*) = need AND bool_or(own)")
def passage_hits_by_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """The first word of each question is also said by all others of it together."""
    _, terms, members, found = _members(spark, d)
    first = terms.groupBy("fid").agg(F.min_by("term", "ord").alias("term"))
    others = terms.select("fid", F.col("term").alias("token")).join(members.where("token = term").select("fid", "token", "weight"), ["fid", "token"])
    alternatives = first.join(others, "fid").where("token <> term").select("fid", "term", F.lit("concept").alias("alt"), "token", "weight").distinct()
    return P.passage_hits(found, members, terms, alternatives)


COUNTED = V.FORMULATIONS + f""",
keyed AS (SELECT qid, no, text, array_to_string({tokens_sql("text")}, ' ') AS key FROM formulations),
kept AS (SELECT qid, no, text FROM (SELECT *, min(no) OVER (PARTITION BY qid, key) AS f FROM keyed) WHERE key <> '' AND f = no AND length(text) <= 200),
kw AS (SELECT qid, no, CASE WHEN len(c) > 0 THEN c ELSE w END AS w FROM (SELECT qid, no, list_distinct({tokens_sql("text")}) AS w, list_filter(list_distinct({tokens_sql("text")}), lambda x: x NOT IN ({WORDS}) AND length(x) > 1) AS c FROM kept)),
kwords AS (SELECT DISTINCT qid, no, unnest(w) AS word FROM kw),
kunits AS (SELECT DISTINCT qid, no, word, unnest(u) AS unit FROM (SELECT *, list_filter(regexp_split_to_array(word, '[-_]'), lambda x: length(x) > 1) AS u FROM kwords) WHERE len(u) > 1),
kpool AS (SELECT qid, no, word FROM kwords UNION SELECT qid, no, unit FROM kunits),
kstems AS (SELECT word, {stem_sql("word")} AS st, {stem_sql(fold_sql("word"))} AS fst FROM (SELECT DISTINCT word FROM kpool)),
kforms AS (SELECT * FROM (VALUES {FORMS}) AS f(form, key, noun)),
kkeys AS (SELECT word, 's:' || fst AS key FROM kstems UNION SELECT word, 'v:' || st FROM kstems WHERE regexp_matches(st, '^\\p{{L}}+$') UNION SELECT word, 'v:' || unnest({verb_keys_sql("st")}) FROM kstems WHERE regexp_matches(st, '^\\p{{L}}+$') UNION SELECT word, 'f:' || f.key FROM kstems JOIN kforms f ON f.form = word),
ksame AS (SELECT DISTINCT a.word AS x, b.word AS y FROM kkeys a JOIN kkeys b USING (key)),
kheld AS (SELECT DISTINCT w.qid, w.no, p.no AS by_no, w.word FROM kwords w JOIN ksame ON x = w.word JOIN kpool p ON p.qid = w.qid AND p.word = y AND p.no <> w.no),
kunit_held AS (SELECT DISTINCT u.qid, u.no, p.no AS by_no, u.word, u.unit FROM kunits u JOIN ksame ON x = u.unit JOIN kpool p ON p.qid = u.qid AND p.word = y AND p.no <> u.no),
kall AS (SELECT qid, no, by_no, word FROM kheld UNION SELECT qid, no, by_no, word FROM kunit_held JOIN (SELECT qid, no, word, count(*) AS n FROM kunits GROUP BY ALL) USING (qid, no, word) GROUP BY qid, no, by_no, word, n HAVING count(*) = n),
kholds AS (SELECT qid, no, by_no FROM kall JOIN (SELECT qid, no, count(*) AS n FROM kwords GROUP BY ALL) USING (qid, no) GROUP BY qid, no, by_no, n HAVING count(*) = n),
counted AS (SELECT a.qid, a.no, NOT EXISTS (SELECT 1 FROM kholds h WHERE h.qid = a.qid AND h.by_no = a.no AND (h.no = 0 OR h.no < a.no OR NOT EXISTS (SELECT 1 FROM kholds r WHERE r.qid = a.qid AND r.no = a.no AND r.by_no = h.no))) AND len(w) > 0 AS counted FROM kw a WHERE a.no > 0)"""


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return S.dedupe_formulations(V.formulations(spark, d)).where("reason IS NULL").select("qid", "no", "text")


@query(f"WITH {COUNTED} SELECT * FROM counted")
def counted_reformulations(spark: SparkSession, d: str) -> DataFrame:
    return P.counted_reformulations(_kept(spark, d))


@query(f"""WITH RECURSIVE {HITS}, {COUNTED}, c AS (SELECT qid AS fid, count(*) AS n FROM counted WHERE counted GROUP BY qid), w AS (SELECT fid, count(*) AS n FROM terms WHERE dropped IS NULL GROUP BY fid),
h AS (SELECT fid, count(*) AS n, sum(least(length(text), 400))::BIGINT AS needed FROM hits JOIN (SELECT pid, text FROM passages) USING (pid) GROUP BY fid),
r AS (SELECT q.fid, coalesce(h.n, 0) AS hits, coalesce(needed, 0) AS needed_chars, concat_ws(' ', CASE WHEN coalesce(c.n, 0) < 2 THEN 'too_few_reformulations' END, CASE WHEN coalesce(w.n, 0) = 0 THEN 'no_content_words' END, CASE WHEN coalesce(needed, 0) > 2000 THEN 'budget_exhausted' END) AS reasons
FROM questions q LEFT JOIN h USING (fid) LEFT JOIN c USING (fid) LEFT JOIN w USING (fid)) SELECT fid, hits, needed_chars, reasons = '' AS complete, reasons FROM r""")
def absence_check(spark: SparkSession, d: str) -> DataFrame:
    _, terms, members, found = _members(spark, d)
    return P.absence_check(V.questions(spark, d), P.passage_hits(found, members, terms), P.counted_reformulations(_kept(spark, d)), terms, found, budget=2000)


FILES = MEMBERS + ", held_files AS (SELECT fid, term, path, max(CASE WHEN m.token = m.term THEN 1 ELSE 0 END) AS literal FROM (SELECT DISTINCT path, token FROM postings) p JOIN members m ON m.token = p.token GROUP BY ALL)"


@query(f"WITH RECURSIVE {FILES} SELECT m.fid, m.term, count(h.path) AS files, count(h.path) FILTER (literal = 0) AS form_files FROM (SELECT DISTINCT fid, term FROM terms WHERE dropped IS NULL) m LEFT JOIN held_files h ON h.fid = m.fid AND h.term = m.term GROUP BY ALL")
def coverage_account(spark: SparkSession, d: str) -> DataFrame:
    pages, terms, members, _ = _members(spark, d)
    return P.coverage_account(members, S.postings(S.split_fields(pages)), terms)


@query(f"""WITH RECURSIVE {MEMBERS}, got AS (SELECT DISTINCT fid, path, term || ':' || m.token || ':' || rule AS r FROM (SELECT DISTINCT path, token FROM postings) p JOIN members m ON m.token = p.token)
SELECT fid, path, array_to_string(list_sort(list(r)), ' ') AS rules FROM got GROUP BY ALL""")
def match_rules(spark: SparkSession, d: str) -> DataFrame:
    pages, _, members, _ = _members(spark, d)
    found = S.postings(S.split_fields(pages)).join(members.select("token").distinct(), "token", "left_semi")
    matches = found.join(members, "token").select("fid", "path").distinct()
    return P.match_rules(matches, members, found)


@query(f"""WITH {SIGNALS}, {V.CLAIMS}, asked AS (SELECT fid, list(term) AS terms FROM terms WHERE dropped IS NULL GROUP BY fid),
h AS (SELECT fid, path, claim_id, len(list_intersect(list_distinct({tokens_sql("text")}), terms)) AS hits FROM (SELECT fid, path FROM ranked WHERE rank <= 12) JOIN asked USING (fid) JOIN claims USING (path))
SELECT * FROM (SELECT fid, path, claim_id, row_number() OVER (PARTITION BY fid, path ORDER BY hits DESC, claim_id) AS place FROM h WHERE hits > 0) WHERE place <= 8""")
def relevant_claims(spark: SparkSession, d: str) -> DataFrame:
    pages, questions = V.pages(spark, d), V.questions(spark, d)
    return P.relevant_claims(S.ranking(pages, questions, limit=12), V.claims(spark, d), S.query_term_plan(questions))


def md_pages(spark: SparkSession, d: str) -> DataFrame:
    """path, content: front matter, a heading, and the lines of a document as claims."""
    docs = V.table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("doc_id")
    tags = F.when(i % 5 == 0, F.lit("")).when(i % 5 == 1, F.lit("tags: single\n")).otherwise(F.concat(F.lit("tags: ["), "source", F.lit(", 't"), i % 9, F.lit("']\n")))
    extra = F.when(i % 7 == 0, "Extra-Note: 12\n").when(i % 7 == 1, "verified: true\n").otherwise("")
    broken = F.when(i % 11 == 0, "no colon here\n").otherwise("")
    head = F.concat(F.lit("---\ntitle: \"Page "), i, F.lit("\"\nstatus: active\n"), tags, F.lit("sources:\n  - src-"), i % 13, F.lit("\n  - src-"), i % 17, F.lit("\n"), extra, broken, F.lit("---\n# Page "), i, F.lit("\n"))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x, k: F.concat(F.lit("<!-- claim\nid: clm-"), i, F.lit("-"), k, F.lit("\nKind: fact\nstatus: active\nsources: src-"), i % 13, F.lit("@page=1 | src-"), i % 17, F.lit("@document\n-->\n"), x, F.lit("\n<!-- /claim -->"))), "\n")
    return docs.select(F.concat(F.lit("wiki/"), "doc_id", F.lit(".md")).alias("path"), F.concat(head, body).alias("content"))


PROPERTIES = """
ids AS (SELECT doc_id AS i, source, 'wiki/' || doc_id || '.md' AS path FROM documents),
properties AS (SELECT path, key, kind, scalar, items FROM ids, LATERAL (SELECT unnest([
  {'key': 'title', 'kind': 'string', 'scalar': 'Page ' || i, 'items': NULL::VARCHAR[]}, {'key': 'status', 'kind': 'string', 'scalar': 'active', 'items': NULL},
  CASE WHEN i % 5 = 0 THEN NULL WHEN i % 5 = 1 THEN {'key': 'tags', 'kind': 'string', 'scalar': 'single', 'items': NULL} ELSE {'key': 'tags', 'kind': 'list', 'scalar': NULL, 'items': [source, 't' || (i % 9)]} END,
  {'key': 'sources', 'kind': 'list', 'scalar': NULL, 'items': ['src-' || (i % 13), 'src-' || (i % 17)]},
  CASE WHEN i % 7 = 0 THEN {'key': 'Extra-Note', 'kind': 'integer', 'scalar': '12', 'items': NULL} WHEN i % 7 = 1 THEN {'key': 'verified', 'kind': 'bool', 'scalar': 'true', 'items': NULL} END], recursive := true)) u WHERE key IS NOT NULL AND i % 11 <> 0),
drift AS (SELECT path, 'missing-required' AS kind, r AS property FROM ids, (SELECT unnest(['title', 'status', 'tags', 'sources']) AS r) rs WHERE NOT EXISTS (SELECT 1 FROM properties p WHERE p.path = ids.path AND p.key = r)
  UNION ALL SELECT path, CASE WHEN key = 'tags' AND kind <> 'list' THEN 'type-mismatch' WHEN key = 'Extra-Note' THEN 'property-name' ELSE 'extension' END, key FROM properties WHERE key IN ('verified', 'Extra-Note') OR (key = 'tags' AND kind <> 'list'))"""


@query(f"WITH {PROPERTIES} SELECT path, key, kind, scalar, array_to_string(items, '|') AS items FROM properties")
def load_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    return M.load_frontmatter(md_pages(spark, d))[0].withColumn("items", F.array_join("items", "|"))


@query("SELECT 'wiki/' || doc_id || '.md' AS path, (6 + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END + CASE WHEN doc_id % 7 < 2 THEN 1 ELSE 0 END)::BIGINT AS line_no, 'missing colon' AS reason FROM documents WHERE doc_id % 11 = 0")
def frontmatter_errors(spark: SparkSession, d: str) -> DataFrame:
    return M.load_frontmatter(md_pages(spark, d))[1]


@query("""WITH ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS k FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM documents))
SELECT 'wiki/' || doc_id || '.md' AS path, k AS ord, 'clm-' || doc_id || '-' || k AS claim_id, 'fact' AS kind, 'active' AS status, 'src-' || (doc_id % 13) || '@page=1 src-' || (doc_id % 17) || '@document' AS sources, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text FROM ln""")
def extract_claims(spark: SparkSession, d: str) -> DataFrame:
    return M.extract_claims(md_pages(spark, d))


@query(f"WITH {PROPERTIES} SELECT * FROM drift")
def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    raw = md_pages(spark, d)
    return M.schema_drift(M.load_frontmatter(raw)[0], raw)


@query(f"""WITH {PROPERTIES}, g AS (SELECT path, list_sort(list(property) FILTER (kind = 'missing-required')) AS m, list_sort(list(property) FILTER (kind = 'extension')) AS u, count(*) FILTER (kind IN ('missing-required', 'type-mismatch')) AS bad FROM drift GROUP BY path)
SELECT path, coalesce(bad, 0) = 0 AS conforms, coalesce(array_to_string(m, ' '), '') AS missing, coalesce(array_to_string(u, ' '), '') AS unknown FROM ids LEFT JOIN g USING (path)""")
def okf_report(spark: SparkSession, d: str) -> DataFrame:
    raw = md_pages(spark, d)
    return M.okf_report(M.load_frontmatter(raw)[0], raw)


@query("""SELECT path, CASE WHEN starts_with(path, 'sources/') THEN 'sources' WHEN starts_with(path, 'meta/history/') THEN 'history' ELSE 'wiki' END AS scope, (NOT contains(path, '/') OR ends_with(path, '/index.md') OR ends_with(path, 'open-questions.md')) AS is_navigation
FROM (SELECT url_path AS path FROM (SELECT CASE page_id % 4 WHEN 0 THEN 'sources/' WHEN 1 THEN 'meta/history/' WHEN 2 THEN 'wiki/' ELSE '' END || CASE WHEN page_id % 10 = 0 THEN 'index.md' ELSE page_id || '.md' END AS url_path FROM pages))""")
def classify_layer(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    path = F.concat(F.when(i % 4 == 0, "sources/").when(i % 4 == 1, "meta/history/").when(i % 4 == 2, "wiki/").otherwise(""), F.when(i % 10 == 0, F.lit("index.md")).otherwise(F.concat(i, F.lit(".md"))))
    return M.classify_layer(V.table(spark, d, "pages").select(path.alias("path")))


@query("""WITH f AS (SELECT 'wiki/' || doc_id || '.md' AS path, coalesce(text, '') AS content FROM documents UNION ALL SELECT 'wiki/' || doc_id || ' (conflicted copy 1).md', coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '+' END FROM documents WHERE doc_id % 20 < 2)
SELECT c.path AS copy, o.path AS original, sha256(c.content) = sha256(o.content) AS identical FROM f c JOIN f o ON o.path = replace(c.path, ' (conflicted copy 1)', '') WHERE c.path LIKE '%conflicted%'""")
def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    copies = docs.where("doc_id % 20 < 2").select(F.concat(F.lit("wiki/"), "doc_id", F.lit(" (conflicted copy 1).md")).alias("path"), F.concat("content", F.when(F.col("doc_id") % 2 == 0, "").otherwise("+")).alias("content"))
    return M.conflict_pairs(docs.select(F.concat(F.lit("wiki/"), "doc_id", F.lit(".md")).alias("path"), "content").unionByName(copies))


CONCEPTS = f"concepts AS (SELECT 'c' || (doc_id % 25) AS concept_id, {tokens_sql('text')}[1] AS term FROM documents)"


@query(f"WITH {CONCEPTS} SELECT {fold_sql('term')} AS key, count(DISTINCT concept_id) AS n FROM concepts WHERE term IS NOT NULL GROUP BY 1 HAVING count(DISTINCT concept_id) > 1")
def ambiguous_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    return M.ambiguous_terms(docs.select(F.concat(F.lit("c"), F.col("doc_id") % 25).alias("concept_id"), F.get(tokens(F.col("text")), F.lit(0)).alias("term")))


@query(f"""WITH {V.PAGES}, l AS (SELECT CASE page_id % 6 WHEN 0 THEN 'wiki/' || cluster || '/index.md' WHEN 1 THEN 'wiki/index.md' ELSE 'wiki/other/index.md' END AS path, path AS target FROM pages WHERE page_id % 6 < 3)
SELECT path, 'wiki/' || cluster || '/index.md' AS index FROM pages p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.target = p.path AND l.path IN ('wiki/index.md', 'wiki/' || p.cluster || '/index.md'))""")
def index_listing(spark: SparkSession, d: str) -> DataFrame:
    pages, i = V.pages(spark, d), F.col("page_id") % 6
    by = F.when(i == 0, F.concat(F.lit("wiki/"), "cluster", F.lit("/index.md"))).when(i == 1, "wiki/index.md").otherwise("wiki/other/index.md")
    return M.index_listing(pages, pages.where(i < 3).select(by.alias("path"), F.col("path").alias("target_path")))


@query(f"""WITH RECURSIVE {HITS}, placed_tokens AS (SELECT DISTINCT pid, n, place, token FROM (SELECT pid, 0 AS n, 'text' AS place, unnest({tokens_sql("text")}) AS token FROM passages UNION ALL SELECT pid, 1, 'heading', unnest({tokens_sql("array_to_string(section, ' ')")}) FROM passages
  UNION ALL SELECT pid, 2, 'header', unnest({tokens_sql("header")}) FROM passages UNION ALL SELECT pid, 3, 'title', unnest({tokens_sql("title")}) FROM passages))
SELECT fid, pid, term, token, rule, place FROM placed_tokens JOIN members USING (token) JOIN (SELECT fid, pid FROM hits) h USING (fid, pid)
QUALIFY row_number() OVER (PARTITION BY fid, pid, term ORDER BY n, weight DESC, token) = 1""")
def hit_evidence(spark: SparkSession, d: str) -> DataFrame:
    _, terms, members, found = _members(spark, d)
    return P.hit_evidence(P.passage_hits(found, members, terms), found, members)


@query(f"WITH RECURSIVE {HITS} SELECT fid, pid, row_number() OVER (PARTITION BY fid ORDER BY strength <> 'word_form', h.path, line_no, pid) AS place FROM hits h JOIN (SELECT pid, line_no FROM passages) USING (pid)")
def hit_order(spark: SparkSession, d: str) -> DataFrame:
    _, terms, members, found = _members(spark, d)
    return P.hit_order(P.passage_hits(found, members, terms), found)


@query(f"""WITH RECURSIVE {SIGNALS}{HITS.removeprefix(TOKENS + ", " + TERMS)} SELECT h.fid, h.pid, r.rank AS shown_in FROM hits h LEFT JOIN (SELECT fid, path, rank FROM ranked WHERE rank <= 12) r ON r.fid = h.fid AND r.path = h.path""")
def already_printed(spark: SparkSession, d: str) -> DataFrame:
    pages, terms, members, found = _members(spark, d)
    return P.already_printed(P.passage_hits(found, members, terms), S.ranking(pages, V.questions(spark, d), limit=12))


@query(f"""WITH {V.CITATIONS}, r AS (SELECT claim_id, unnest([CASE WHEN NOT regexp_matches(claim_id, '^clm-[0-9a-f]{{16}}$') THEN 'bad-id' END, CASE WHEN kind NOT IN ('fact', 'decision', 'estimate', 'rule') THEN 'bad-kind' END,
CASE WHEN status NOT IN ('active', 'disputed', 'superseded', 'unsupported') THEN 'bad-status' END, CASE WHEN trim(text) = '' THEN 'no-text' END]) AS code FROM claims)
SELECT * FROM r WHERE code IS NOT NULL UNION ALL SELECT claim_id, 'no-source' FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM citations) UNION ALL SELECT claim_id, 'malformed-locator' FROM citations WHERE NOT regexp_matches(locator, '^(?:document|(?:page|slide)=[0-9]+(?:-[0-9]+)?|(?:section|heading|sheet|timestamp)=.+)$')""")
def claim_rules(spark: SparkSession, d: str) -> DataFrame:
    from quillon.operators import governance

    return governance.claim_rules(V.claims(spark, d), V.citations(spark, d))


@query(f"""WITH {SIGNALS}, {V.CLAIMS}, target AS (SELECT fid, 'clm-' || substr(sha256((fid * 3) || ':' || (fid % 4)), 1, 16) AS claim_id FROM questions)
SELECT t.fid, CASE WHEN c.path IS NULL THEN 'target_missing' WHEN c.status NOT IN ('active', 'disputed') THEN 'target_inactive' WHEN rank <= 12 THEN 'found' ELSE 'not_found' END AS status
FROM target t LEFT JOIN claims c USING (claim_id) LEFT JOIN ranked r ON r.fid = t.fid AND r.path = c.path""")
def findability_check(spark: SparkSession, d: str) -> DataFrame:
    from quillon.operators import governance

    questions = V.questions(spark, d)
    target = questions.select("fid", F.concat(F.lit("clm-"), F.substring(F.sha2(F.concat(F.col("fid") * 3, F.lit(":"), F.col("fid") % 4), 256), 1, 16)).alias("claim_id"))
    return governance.findability_check(target, V.claims(spark, d), S.ranking(V.pages(spark, d), questions))


@query(f"""WITH {VOCABULARY} SELECT term, count(DISTINCT path) AS n FROM asked JOIN tok ON token = term GROUP BY term HAVING count(DISTINCT path) >= greatest(3, (SELECT ceil(count(*) / 10) FROM pages))""")
def alias_review(spark: SparkSession, d: str) -> DataFrame:
    from quillon.operators import governance

    pages = V.pages(spark, d)
    return governance.alias_review(S.query_term_plan(V.questions(spark, d)).where("dropped IS NULL"), S.postings(S.split_fields(pages)), pages.count())


@query(f"""WITH {V.PAGES}, r AS (SELECT path, unnest([CASE WHEN trim(body) = '' THEN 'empty-body' END, CASE WHEN contains(body, chr(0)) THEN 'nul-character' END, CASE WHEN contains(body, '�') THEN 'replacement-character' END,
CASE WHEN list_max(list_transform(string_split(body, chr(10)), lambda x: length(x))) > 20000 THEN 'long-line' END]) AS code FROM pages) SELECT * FROM r WHERE code IS NOT NULL""")
def page_preflight(spark: SparkSession, d: str) -> DataFrame:
    from quillon.operators import governance

    return governance.page_preflight(V.pages(spark, d))
