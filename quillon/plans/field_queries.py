"""Queries over six fields and repaired tokens. Spark reads pages with artefacts in their words; the SQL reads the same pages without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import stem_sql, tokens_sql
from quillon.operators import fields as D
from quillon.operators import search as S
from quillon.plans import views as V
from quillon.plans.search_queries import STATUS, TERMS, WEIGHT, query

#: Digits become letters and the signs of markup blanks, so that the only artefacts are those put in below.
FROM, TO = "0123456789&<>*~^#-", "abcdefghij       _"
#: A second and a third word of a text.
SECOND, THIRD = r"^\s*\S+\s+(\S+)", r"^\s*\S+\s+\S+\s+(\S+)"
#: Artefacts within words: what is written, and how.
ARTEFACTS = (("ü", "&uuml;"), ("é", "&#233;"), ("è", "&#xE8;"), ("tion", "ti­on"), ("ment", "m~ent~"), ("ver", "v<sub>er</sub>"), ("ch", "c**h**"))


def plain(text: str | Column) -> Column:
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), FROM, TO)


def damaged(text: Column, lines: bool = True) -> Column:
    text = F.replace(text, F.lit("nd"), F.lit("n-\nd")) if lines else text
    for word, written in ARTEFACTS:
        text = F.replace(text, F.lit(word), F.lit(written))
    return text


def field_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages with aliases, a heading, an amount and artefacts in their words."""
    body, n = plain("body"), F.col("page_id") % 50
    aliases = F.when(F.col("page_id") % 3 == 0, F.array(damaged(F.regexp_extract(body, THIRD, 1)), plain("cluster")))
    line = F.concat(F.lit("\nAb 2."), n + 500, F.lit(" kWh je m^2^, "), n, F.lit("km."))
    text = F.concat(F.lit("## "), damaged(F.regexp_extract(body, SECOND, 1), lines=False), F.lit("\n\n"), damaged(body), line)
    return V.pages(spark, d).withColumns({"aliases": aliases, "title": damaged(plain("title")), "description": damaged(plain("description")), "body": text})


def field_questions(spark: SparkSession, d: str) -> DataFrame:
    """fid, text: six tokens of a passage and an amount in megawatt hours, which pages write in kilowatt hours."""
    text = F.array_join(F.slice(F.regexp_extract_all(F.lower(plain("text")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), 1, 6), " ")
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("fid"), F.concat(text, F.lit(" 2,5"), F.format_string("%02d", F.col("item_id") % 50), F.lit(" MWh")).alias("text"))


def plain_sql(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{FROM}', '{TO}')"


CLEAN = V.PAGES + f""",
clean AS (SELECT path, page_id, status, page_id % 50 AS n, {plain_sql("title")} AS title, {plain_sql("description")} AS description, {plain_sql("cluster")} AS cluster, {plain_sql("body")} AS body FROM pages),
texts AS (SELECT path, n, title, CASE WHEN page_id % 3 = 0 THEN regexp_extract(body, '{THIRD}', 1) || ' ' || cluster ELSE '' END AS aliases, regexp_extract(body, '{SECOND}', 1) AS headings, description, body FROM clean),
fields AS (SELECT path, unnest(['title', 'aliases', 'headings', 'description']) AS field, unnest([{", ".join(tokens_sql(x) for x in ("title", "aliases", "headings", "description"))}]) AS t FROM texts
  UNION ALL SELECT path, 'body', {tokens_sql("headings || chr(10) || body")} || ['ab', (2500 + n)::VARCHAR, 'kwh', 'je', 'm', '2', n::VARCHAR, 'km', 'm2'] FROM texts
  UNION ALL SELECT path, 'quantities', ['=' || (2500 + n) || 'kwh'] FROM texts),
tok AS (SELECT path, field, len(t) AS field_len, unnest(t) AS token FROM fields),
postings AS (SELECT path, field, field_len, token, count(*) AS tf FROM tok GROUP BY ALL),
stats AS (SELECT field, (SELECT count(*) FROM pages) AS n_docs, sum(len(t)) / (SELECT count(*) FROM pages) AS avg_len FROM fields WHERE len(t) > 0 GROUP BY field)"""


@query(f"WITH {CLEAN} SELECT path, field, i - 1 AS pos, token FROM (SELECT path, field, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM fields WHERE field <> 'quantities')")
def repaired_tokens(spark: SparkSession, d: str) -> DataFrame:
    return D.document_fields(field_pages(spark, d)).select("path", "field", F.posexplode_outer("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {CLEAN} SELECT path, field, token, tf, field_len FROM postings")
def field_postings(spark: SparkSession, d: str) -> DataFrame:
    return D.field_postings(field_pages(spark, d))


@query(f"WITH {CLEAN} SELECT field, n_docs, avg_len FROM stats")
def field_stats(spark: SparkSession, d: str) -> DataFrame:
    return D.field_stats(field_pages(spark, d))


def _counts(kind: str, *words: str) -> str:
    n = " + ".join(f"len(string_split(t, '{w}')) - 1" for w in words)
    return f"SELECT '{kind}' AS kind, {n} AS n FROM bodies"


@query(f"""WITH {CLEAN}, bodies AS (SELECT headings || chr(10) || body AS t, body FROM texts), found AS ({_counts("reference", "ü", "é", "è")} UNION ALL {_counts("hidden", "tion")} UNION ALL {_counts("subscript", "ment", "ver")}
UNION ALL {_counts("emphasis", "ch")} UNION ALL SELECT 'line-end', len(string_split(body, 'nd')) - 1 FROM bodies UNION ALL SELECT unnest(['superscript', 'digit-groups']), 1 FROM bodies)
SELECT kind, count(*) FILTER (n > 0) AS pages, sum(n)::BIGINT AS n FROM found GROUP BY kind""")
def repair_report(spark: SparkSession, d: str) -> DataFrame:
    return D.repair_report(field_pages(spark, d))


# the amount of a question stands for its two words: they lie in every second page, so the bridge counts where the number does not
FIELD_SCORES = CLEAN + ", " + TERMS.replace(V.QUESTIONS, rf"""
asked_text AS (SELECT item_id AS fid, array_to_string(regexp_extract_all(lower({plain_sql("text")}), '[\p{{L}}\p{{N}}_]+')[1:6], ' ') AS words, item_id % 50 AS n FROM benchmark),
questions AS (SELECT fid, words || ' 2 ' || printf('5%02d', n) || ' mwh' AS text, n FROM asked_text)""") + f""",
named AS (SELECT fid, term, term AS token, 1.0 AS weight FROM terms WHERE dropped IS NULL),
amounts AS (SELECT fid, term, '=' || (2500 + n) || 'kwh' AS token FROM named JOIN questions USING (fid) WHERE term IN (printf('5%02d', n), 'mwh')),
bridge AS (SELECT DISTINCT a.fid, a.term, a.token, 0.9 AS weight FROM amounts a JOIN postings p ON p.token = a.token WHERE NOT EXISTS (SELECT 1 FROM postings o WHERE o.path = p.path AND o.token = a.term)),
members AS (SELECT *, min(term) OVER (PARTITION BY fid, {stem_sql("term")}) AS label FROM (SELECT * FROM named UNION ALL SELECT * FROM bridge)),
grouped AS (SELECT fid, label, token, max(weight) AS weight FROM members GROUP BY ALL),
dfs AS (SELECT fid, label, count(DISTINCT path) AS df FROM grouped JOIN postings USING (token) GROUP BY ALL),
levels AS (SELECT fid, path, label, weight, sum({WEIGHT} * tf / (1 - {S.B} + {S.B} * field_len / avg_len)) AS tf FROM grouped JOIN postings USING (token) JOIN stats USING (field) GROUP BY ALL),
so_far AS (SELECT fid, path, label, weight - coalesce(lead(weight) OVER (PARTITION BY fid, path, label ORDER BY weight DESC), 0) AS step, sum(tf) OVER (PARTITION BY fid, path, label ORDER BY weight DESC ROWS UNBOUNDED PRECEDING) AS tf FROM levels),
scores AS (SELECT fid, path, sum(step * ln(1 + ((SELECT count(*) FROM pages) - df + 0.5) / (df + 0.5)) * tf / ({S.K1} + tf)) AS score FROM so_far JOIN dfs USING (fid, label) GROUP BY ALL),
signalled AS (SELECT fid, path, score * {STATUS} * CASE WHEN contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string({tokens_sql("text")}, ' ') || ' ') THEN 1.5 ELSE 1.0 END AS score
  FROM scores JOIN clean USING (path) JOIN (SELECT path, t FROM fields WHERE field = 'body') b USING (path) JOIN questions q USING (fid)),
ranked AS (SELECT fid, path, round(score, 2) AS score, row_number() OVER (PARTITION BY fid ORDER BY round(score, 2) DESC, path) AS rank FROM signalled)"""


@query(f"WITH {FIELD_SCORES} SELECT fid, path, score, rank, rank > 12 AS omitted FROM ranked WHERE rank <= 32")
def search_fields(spark: SparkSession, d: str) -> DataFrame:
    return S.top_k(D.field_ranking(field_pages(spark, d), field_questions(spark, d))).withColumn("rank", F.col("rank").cast("long"))
