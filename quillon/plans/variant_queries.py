"""Queries of the rules that only the scan knows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import fold_sql, stem_sql, tokens, tokens_sql
from quillon.operators import passages as P
from quillon.operators import search as S
from quillon.operators import variants as X
from quillon.plans import views as V
from quillon.plans.governance_queries import VOCABULARY
from quillon.plans.passage_queries import PASSAGES
from quillon.plans.search_queries import WORDS, query

LIST = {k: "[" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in {"infl": X.INFLECTION, "degree": X.DEGREE + X.FEMININE, "verb": X.VERB, "particles": X.PARTICLES}.items()}


def left_of(word: str, endings: str, least: int) -> str:
    return f"list_transform(list_filter({endings}, lambda e: ends_with({word}, e) AND length({word}) - length(e) >= {least}), lambda e: left({word}, length({word}) - length(e)))"


def scan_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary, and its words before a hyphenated part, with a footnote mark and as verb forms."""
    t = F.col("token")
    more = F.array(t, F.concat(t, F.lit("-e")), F.concat(F.lit("plan-"), t), F.concat(t, F.lit("2")), F.concat(t, F.lit("innen")), F.concat(F.lit("ab"), t, F.lit("t")), F.concat(F.lit("abge"), t, F.lit("t")))
    return vocabulary.select(F.explode(more).alias("token")).distinct()


VARIANTS = f"""
scanned AS (SELECT DISTINCT unnest([token, token || '-e', 'plan-' || token, token || '2', token || 'innen', 'ab' || token || 't', 'abge' || token || 't']) AS token FROM vocabulary),
named AS (SELECT term FROM asked_for WHERE term NOT IN ({WORDS})), folded AS (SELECT token, {fold_sql("token")} AS spelled FROM scanned WHERE token NOT IN ({WORDS})),
letters AS (SELECT term, {fold_sql("term")} AS word FROM named WHERE regexp_matches(term, '^\\p{{L}}+$')), keyed AS (SELECT term, {stem_sql(f"({fold_sql('term')})")} AS key FROM named),
ending_bases AS (SELECT DISTINCT term, word, unnest(list_concat([word], {left_of("word", LIST["infl"], 3)}, {left_of("word", LIST["degree"], 4)})) AS b FROM letters WHERE length(word) >= 3),
ending_forms AS (SELECT term, word, unnest(list_concat([b], list_transform({LIST["infl"]}, lambda e: b || e), CASE WHEN length(b) >= 4 THEN list_transform({LIST["degree"]}, lambda e: b || e) ELSE [] END)) AS spelled FROM ending_bases),
stems AS (SELECT term, word, unnest({left_of("word", LIST["verb"], 4)}) AS s FROM letters UNION SELECT term, word, s FROM (SELECT term, word, regexp_extract(word, CASE WHEN ends_with(word, 'et') THEN '^ge(.*)et$' ELSE '^ge(.*)t$' END, 1) AS s FROM letters WHERE regexp_matches(word, '^ge.*t$')) WHERE length(s) >= 4),
cut_words AS (SELECT term, word, p, substr(word, length(p) + 1) AS rest FROM letters, (SELECT unnest({LIST["particles"]}) AS p) ps WHERE starts_with(word, p)),
apart AS (SELECT term, word, p, unnest({left_of("rest", LIST["verb"], 3)}) AS s FROM cut_words UNION SELECT term, word, p, unnest({left_of("substr(rest, 3)", "['t', 'et', 'en']", 3)}) FROM cut_words WHERE starts_with(rest, 'ge') UNION SELECT term, word, p, unnest({left_of("substr(rest, 3)", "['n', 'en']", 3)}) FROM cut_words WHERE starts_with(rest, 'zu')),
english AS (SELECT term, word, b FROM (SELECT term, word, unnest([word, CASE WHEN regexp_matches(word, '(?:ied|ies)$') THEN left(word, length(word) - 3) || 'y' END, CASE WHEN ends_with(word, 'ed') THEN left(word, length(word) - 2) END, CASE WHEN ends_with(word, 'ed') THEN left(word, length(word) - 1) END,
  CASE WHEN ends_with(word, 'ing') THEN left(word, length(word) - 3) END, CASE WHEN ends_with(word, 'ing') THEN left(word, length(word) - 3) || 'e' END, CASE WHEN ends_with(word, 'ed') AND length(word) >= 4 AND word[-3] = word[-4] AND word[-3] NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(word, length(word) - 3) END,
  CASE WHEN ends_with(word, 'ing') AND length(word) >= 5 AND word[-4] = word[-5] AND word[-4] NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(word, length(word) - 4) END]) AS b FROM letters) WHERE length(b) >= 3),
verb_forms AS (SELECT term, word, unnest(list_concat(list_transform({LIST["verb"]}, lambda e: s || e), ['ge' || s || 't', 'ge' || s || 'et'])) AS spelled FROM stems
  UNION SELECT term, word, unnest(list_concat(list_transform({LIST["verb"]}, lambda e: p || s || e), list_transform(['t', 'et', 'en'], lambda e: p || 'ge' || s || e), [p || 'zu' || s || 'n', p || 'zu' || s || 'en'])) FROM apart
  UNION SELECT term, word, unnest([b, b || 'ed', b || 'ing', CASE WHEN ends_with(b, 'e') THEN b || 'd' END, CASE WHEN ends_with(b, 'e') THEN left(b, length(b) - 1) || 'ing' END, CASE WHEN regexp_matches(b, '[^aeiou]y$') THEN left(b, length(b) - 1) || 'ied' END, CASE WHEN regexp_matches(b, '[^aeiou]y$') THEN left(b, length(b) - 1) || 'ies' END,
    CASE WHEN regexp_matches(b, '(?:^|[^aeiou])[aeiou][^aeiouwxy]$') THEN b || right(b, 1) || 'ed' END, CASE WHEN regexp_matches(b, '(?:^|[^aeiou])[aeiou][^aeiouwxy]$') THEN b || right(b, 1) || 'ing' END]) FROM english),
hyphened AS (SELECT token, list_filter(string_split(replace(token, '_', '-'), '-'), lambda x: x <> '') AS u FROM scanned WHERE regexp_matches(token, '[-_]')),
piece AS (SELECT token, part FROM (SELECT token, unnest(u) AS part FROM hyphened) WHERE length(part) >= 2 AND part NOT IN ({WORDS})
  UNION SELECT token, unnest(regexp_extract_all(regexp_replace(regexp_replace('-' || array_to_string(u, '--') || '-', '-(\\w)--(\\w+)-', '-\\1~\\2-', 'g'), '-(\\w+)--(\\w)-$', '-\\1~\\2-'), '\\w+~\\w+')) FROM hyphened),
rules AS (SELECT term, token, 0 AS i FROM keyed JOIN (SELECT token, replace(part, '~', '-') AS part FROM piece) ON {stem_sql(f"({fold_sql('part')})")} = key
  UNION ALL SELECT term, token, 1 FROM ending_forms JOIN folded USING (spelled) WHERE spelled <> word UNION ALL SELECT term, token, 2 FROM verb_forms JOIN folded USING (spelled) WHERE spelled <> word
  UNION ALL SELECT term, token, 3 FROM keyed JOIN (SELECT token, regexp_replace(token, '[0-9]+$', '') AS bare FROM scanned WHERE regexp_matches(token, '^\\p{{L}}{{4,}}[0-9]{{1,2}}$')) ON {stem_sql(f"({fold_sql('bare')})")} = key)"""


@query(f"WITH {VOCABULARY}, asked_for AS (SELECT term FROM asked), {VARIANTS} SELECT term, token, ['hyphen_part', 'ending', 'verb_ending', 'footnote_mark'][min(i) + 1] AS rule, 0.35::DOUBLE AS weight FROM rules WHERE term <> token GROUP BY term, token")
def scan_variants(spark: SparkSession, d: str) -> DataFrame:
    terms, vocabulary = S.query_term_plan(V.questions(spark, d)).where("dropped IS NULL"), S.build_vocabulary(S.split_fields(V.pages(spark, d)))
    return X.scan_variants(terms, scan_vocabulary(vocabulary))


def split_pages(pages: DataFrame) -> DataFrame:
    """Pages of which each line is a sentence that ends in a particle."""
    word = lambda x, i: F.regexp_replace(F.coalesce(F.get(tokens(x), F.lit(i)), F.lit("x")), "[^a-z]", "")
    return pages.withColumn("body", F.array_join(F.transform(F.split("body", "\n"), lambda x: F.concat(F.lit("er "), word(x, 0), F.lit("t "), word(x, 1), F.lit("xx ab."))), "\n"))


SPLIT = f"""
split_words AS (SELECT pid, path, string_split(s, ' ')[:-2] AS w FROM (SELECT pid, path, unnest(string_split(rtrim(text, '.'), '. ')) AS s FROM passages)),
candidates AS (SELECT DISTINCT pid, path, unnest(w) AS v FROM split_words)"""
SPLIT_PAGES = f"""{V.PAGES.replace("pages AS (", "plain_pages AS (")},
pages AS (SELECT * REPLACE (array_to_string(list_transform(string_split(body, chr(10)), lambda x: 'er ' || regexp_replace(coalesce(({tokens_sql("x")})[1], 'x'), '[^a-z]', '', 'g') || 't ' || regexp_replace(coalesce(({tokens_sql("x")})[2], 'x'), '[^a-z]', '', 'g') || 'xx ab.'), chr(10)) AS body) FROM plain_pages)"""


@query(f"WITH {SPLIT_PAGES}, {PASSAGES}, {SPLIT} SELECT pid, path, '+' || v || '+ab' AS token FROM candidates WHERE regexp_matches(v, '^[a-z]{{2,}}[ent]$') AND v NOT IN ({WORDS})")
def split_verbs(spark: SparkSession, d: str) -> DataFrame:
    return X.split_verbs(P.passages(split_pages(V.pages(spark, d))))
