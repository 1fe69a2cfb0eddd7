"""Search queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import stem_sql, tokens_sql
from quillon.operators import search as S
from quillon.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WORDS = ", ".join(f"'{x}'" for x in S.FUNCTION_WORDS)
WEIGHT = "CASE field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.FIELD_WEIGHTS.items()) + " END"
FIELDS = V.PAGES + """,
fields AS (SELECT path, unnest(['title', 'description', 'body']) AS field, unnest([title, description, body]) AS text FROM pages),
full_fields AS (SELECT * FROM fields WHERE text <> '')"""
TOKENS = FIELDS + f""",
listed AS (SELECT path, field, {tokens_sql("text")} AS t FROM full_fields),
tok AS (SELECT path, field, len(t) AS field_len, unnest(t) AS token FROM listed),
postings AS (SELECT path, field, field_len, token, count(*) AS tf FROM tok GROUP BY ALL),
stats AS (SELECT field, (SELECT count(*) FROM pages) AS n_docs, sum(len(t)) / (SELECT count(*) FROM pages) AS avg_len FROM listed GROUP BY field)"""
TERMS = V.QUESTIONS + f""",
words AS (SELECT fid, ord, term FROM (SELECT fid, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS ord FROM (SELECT fid, {tokens_sql("text")} AS w FROM questions)) QUALIFY row_number() OVER (PARTITION BY fid, term ORDER BY ord) = 1),
placed AS (SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY ord) - 1 AS ord, term, CASE WHEN term IN ({WORDS}) THEN 'stopword' WHEN length(term) = 1 THEN 'single-character' END AS reason FROM words),
terms AS (SELECT fid, ord, term, CASE WHEN sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY fid) > 0 THEN reason END AS dropped FROM placed)"""
SCORES = TOKENS + ", " + TERMS + f""",
wanted AS (SELECT fid, term, min(term) OVER (PARTITION BY fid, {stem_sql("term")}) AS label FROM terms WHERE dropped IS NULL),
held AS (SELECT DISTINCT fid, label, path FROM wanted JOIN postings ON token = term),
dfs AS (SELECT fid, label, count(*) AS df FROM held GROUP BY ALL),
tfs AS (SELECT fid, path, label, sum({WEIGHT} * tf / (1 - {S.B} + {S.B} * field_len / avg_len)) AS tf FROM wanted JOIN postings ON token = term JOIN stats USING (field) GROUP BY ALL),
scores AS (SELECT fid, path, sum(ln(1 + ((SELECT count(*) FROM pages) - df + 0.5) / (df + 0.5)) * tf / ({S.K1} + tf)) AS score FROM tfs JOIN dfs USING (fid, label) GROUP BY ALL)"""
PHRASES = """,
phrases AS (SELECT s.fid, s.path, (contains(' ' || array_to_string(b.t, ' ') || ' ', ' ' || array_to_string(q.t, ' ') || ' ') AND len(q.t) > 0) AS phrase FROM scores s
  JOIN (SELECT fid, {q} AS t FROM questions) q USING (fid) JOIN (SELECT path, {b} AS t FROM pages) b USING (path))""".format(q=tokens_sql("text"), b=tokens_sql("body"))
STATUS = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.STATUS_FACTOR.items()) + " ELSE 1.0 END"
SIGNALS = SCORES + PHRASES + f""",
signalled AS (SELECT fid, path, score * CASE WHEN phrase THEN 1.5 ELSE 1.0 END * {STATUS} AS score FROM scores JOIN pages USING (path) JOIN phrases USING (fid, path)),
ranked AS (SELECT fid, path, round(score, 2) AS score, row_number() OVER (PARTITION BY fid ORDER BY round(score, 2) DESC, path) AS rank FROM signalled)"""


@query(f"WITH {FIELDS} SELECT * FROM full_fields")
def split_fields(spark: SparkSession, d: str) -> DataFrame:
    return S.split_fields(V.pages(spark, d))


@query(f"WITH {TOKENS} SELECT path, field, i - 1 AS pos, token FROM (SELECT path, field, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM listed)")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return S.tokenize(S.split_fields(V.pages(spark, d))).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {TOKENS} SELECT path, field, token, tf, field_len FROM postings")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(S.split_fields(V.pages(spark, d))).select("path", "field", "token", "tf", "field_len")


@query(f"WITH {TOKENS} SELECT token, count(DISTINCT path) AS files FROM tok GROUP BY token")
def build_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return S.build_vocabulary(S.split_fields(V.pages(spark, d)))


@query(f"WITH {TOKENS} SELECT field, n_docs, avg_len FROM stats")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    pages = V.pages(spark, d)
    return S.corpus_stats(pages, S.split_fields(pages))


@query(f"WITH {TERMS} SELECT fid, ord, term, dropped FROM terms")
def query_term_plan(spark: SparkSession, d: str) -> DataFrame:
    return S.query_term_plan(V.questions(spark, d))


@query(f"WITH {TOKENS}, {TERMS} SELECT fid, term, path, field, tf, field_len FROM terms JOIN postings ON token = term WHERE dropped IS NULL")
def exact_postings_join(spark: SparkSession, d: str) -> DataFrame:
    found = S.exact_postings_join(S.query_term_plan(V.questions(spark, d)), S.postings(S.split_fields(V.pages(spark, d))))
    return found.select("fid", "term", "path", "field", "tf", "field_len")


@query(f"WITH {SCORES} SELECT DISTINCT fid, label, term AS token, 1.0::DOUBLE AS weight, df FROM wanted JOIN dfs USING (fid, label)")
def term_groups(spark: SparkSession, d: str) -> DataFrame:
    terms = S.query_term_plan(V.questions(spark, d)).where("dropped IS NULL")
    members = terms.select("fid", "term", F.col("term").alias("token"), F.lit(1.0).alias("weight"))
    return S.term_groups(members, S.postings(S.split_fields(V.pages(spark, d)))).select("fid", "label", "token", "weight", "df")


@query(f"WITH {SCORES} SELECT fid, path, round(score, 4) AS score FROM scores")
def bm25f_score(spark: SparkSession, d: str) -> DataFrame:
    pages = V.pages(spark, d)
    fields = S.split_fields(pages)
    terms = S.query_term_plan(V.questions(spark, d)).where("dropped IS NULL")
    members = terms.select("fid", "term", F.col("term").alias("token"), F.lit(1.0).alias("weight"))
    found = S.postings(fields).join(members.select("token").distinct(), "token", "left_semi")
    return S.bm25f_score(found, S.term_groups(members, found), S.corpus_stats(pages, fields)).select("fid", "path", F.round("score", 4).alias("score"))


@query(f"WITH {SIGNALS} SELECT fid, path, phrase FROM phrases")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    pages, questions = V.pages(spark, d), V.questions(spark, d)
    return S.phrase_match(questions, pages, S.ranking(pages, questions, with_signals=False))


@query(f"WITH {SIGNALS} SELECT fid, path, score, rank FROM ranked")
def rank_pages(spark: SparkSession, d: str) -> DataFrame:
    return S.ranking(V.pages(spark, d), V.questions(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {SIGNALS} SELECT fid, path, score, rank, rank > 12 AS omitted FROM ranked WHERE rank <= 32")
def search_top_k(spark: SparkSession, d: str) -> DataFrame:
    return S.top_k(S.ranking(V.pages(spark, d), V.questions(spark, d), limit=32)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {SIGNALS} SELECT fid, field, value, count(*) AS n FROM (SELECT fid, unnest(['type', 'status', 'language', 'cluster', 'concept']) AS field, unnest([type, status, language, cluster, concept]) AS value
FROM ranked JOIN pages USING (path)) GROUP BY ALL""")
def facets(spark: SparkSession, d: str) -> DataFrame:
    pages = V.pages(spark, d)
    return S.facets(S.ranking(pages, V.questions(spark, d), with_signals=False), pages)


@query(f"""WITH {V.FORMULATIONS}, keyed AS (SELECT qid, no, text, array_to_string({tokens_sql("text")}, ' ') AS key FROM formulations),
firsts AS (SELECT *, min(no) OVER (PARTITION BY qid, key) AS f FROM keyed),
placed AS (SELECT *, sum(CASE WHEN key <> '' AND f = no THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY no) AS place FROM firsts)
SELECT qid, no, text, CASE WHEN key = '' THEN 'empty' WHEN f <> no THEN 'duplicate' WHEN length(text) > 200 THEN 'too-long' WHEN place > 5 THEN 'too-many' END AS reason,
CASE WHEN key <> '' AND f <> no THEN f END AS duplicate_of FROM placed""")
def dedupe_formulations(spark: SparkSession, d: str) -> DataFrame:
    return S.dedupe_formulations(V.formulations(spark, d))


def _formulation_ranks(spark: SparkSession, d: str, with_signals: bool = True, limit: int | None = None) -> DataFrame:
    kept = S.dedupe_formulations(V.formulations(spark, d)).where("reason IS NULL")
    ranked = S.ranking(V.pages(spark, d), kept.select(F.struct("qid", "no").alias("fid"), "text"), with_signals, limit=limit)
    return ranked.select("fid.qid", "fid.no", "path", F.col("rank").cast("long").alias("rank"))


FORM_RANKS = SIGNALS.replace(V.QUESTIONS, V.FORMULATIONS + f""",
keyed AS (SELECT qid, no, text, array_to_string({tokens_sql("text")}, ' ') AS key FROM formulations),
questions AS (SELECT {{'qid': qid, 'no': no}} AS fid, text FROM (SELECT *, min(no) OVER (PARTITION BY qid, key) AS f FROM keyed) WHERE key <> '' AND f = no AND length(text) <= 200)""") + """,
by_form AS (SELECT fid.qid AS qid, fid.no AS no, path, rank FROM ranked)"""


@query(f"""WITH {FORM_RANKS}, best AS (SELECT qid, path, min(struct_pack(rank := rank, no := no)) AS b FROM by_form WHERE rank <= 12 AND no > 0 GROUP BY ALL),
fresh AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM by_form f WHERE f.qid = best.qid AND f.path = best.path AND f.no = 0 AND f.rank <= 12))
SELECT * FROM (SELECT qid, path, b.rank AS rank, b.no AS no, row_number() OVER (PARTITION BY qid ORDER BY b.rank, b.no, path) AS place FROM fresh) WHERE place <= 12""")
def fuse_formulations(spark: SparkSession, d: str) -> DataFrame:
    return S.fuse_formulations(_formulation_ranks(spark, d, limit=12)).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {FORM_RANKS} SELECT qid, path, string_agg(no || ':' || rank, ' ' ORDER BY no, rank) AS via FROM by_form WHERE rank <= 12 GROUP BY ALL")
def found_by(spark: SparkSession, d: str) -> DataFrame:
    return S.found_by(_formulation_ranks(spark, d, limit=12))


@query(f"WITH {FORM_RANKS} SELECT qid, no, count(*) AS matched, count(*) FILTER (rank <= 12) AS within_limit, count(*) FILTER (rank > 12) AS truncated FROM by_form GROUP BY ALL")
def formulation_coverage(spark: SparkSession, d: str) -> DataFrame:
    # how many pages match, and how many of them stand within a limit, is the same in every order
    return S.formulation_coverage(_formulation_ranks(spark, d, with_signals=False))


@query(f"""WITH {SIGNALS}, asked AS (SELECT fid, list(term) AS terms FROM terms WHERE dropped IS NULL GROUP BY fid),
ln AS (SELECT fid, path, terms, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM (SELECT fid, path FROM ranked WHERE rank <= 12) JOIN asked USING (fid) JOIN pages USING (path)),
hit AS (SELECT fid, path, line_no, line, len(list_intersect(list_distinct({tokens_sql("line")}), terms)) AS hits FROM ln WHERE NOT starts_with(line, '#'))
SELECT fid, path, line_no, hits, substr(line, 1, 320) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY fid, path ORDER BY hits DESC, length(line) DESC, line_no) AS n FROM hit) WHERE n = 1 AND hits > 0""")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    pages, questions = V.pages(spark, d), V.questions(spark, d)
    return S.snippet(S.ranking(pages, questions).where("rank <= 12"), pages, S.query_term_plan(questions))


@query(f"""WITH {SIGNALS}, cost AS (SELECT fid AS qid, rank AS ord, 40 + length(path) + length(title) AS cost FROM ranked JOIN pages USING (path)),
fits AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY ord ROWS UNBOUNDED PRECEDING) <= 4000 AS fits FROM cost)
SELECT qid, count(*) FILTER (fits) AS returned, count(*) FILTER (NOT fits) AS omitted, sum(cost)::BIGINT AS needed FROM fits GROUP BY qid""")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    pages = V.pages(spark, d)
    ranked = S.ranking(pages, V.questions(spark, d)).join(pages.select("path", "title"), "path")
    return S.budget_prefix(ranked.select(F.col("fid").alias("qid"), F.col("rank").alias("ord"), (40 + F.length("path") + F.length("title")).cast("long").alias("cost")), 4000)


@query(f"""WITH {SIGNALS}, need AS (SELECT q.fid, min(p.path) AS path FROM questions q JOIN ranked r ON r.fid = q.fid AND r.rank = 1 JOIN pages p ON p.path = r.path WHERE q.fid % 2 = 0 GROUP BY q.fid
UNION ALL SELECT fid, min(path) FROM ranked WHERE fid % 2 = 1 GROUP BY fid)
SELECT count(*) AS n_questions, count(*) FILTER (rank <= 1) AS first, count(*) FILTER (rank <= 3) AS within_3, count(*) FILTER (rank <= 12) AS within_12, count(*) FILTER (rank <= 100) AS within_100
FROM need LEFT JOIN ranked USING (fid, path)""")
def search_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    ranked = S.ranking(V.pages(spark, d), V.questions(spark, d))
    required = ranked.where("fid % 2 = 0 AND rank = 1").select("fid", "path")
    required = required.unionByName(ranked.where("fid % 2 = 1").groupBy("fid").agg(F.min("path").alias("path")))
    return S.search_quality_gate(ranked, required)
