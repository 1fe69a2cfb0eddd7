"""Queries of word forms, governance and evidence, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.settled import settled
from quillon.functions.text import fold_sql, stem_sql, verb_keys_sql
from quillon.operators import governance as G
from quillon.operators import lexicon as L
from quillon.operators import search as S
from quillon.plans import views as V
from quillon.plans.search_queries import TERMS, TOKENS, WORDS, query

TODAY = "2024-12-31"
VOCABULARY = TOKENS + ", " + TERMS + """,
vocabulary AS (SELECT token, count(DISTINCT path) AS files FROM tok GROUP BY token), asked AS (SELECT DISTINCT term FROM terms WHERE dropped IS NULL)"""


def _terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return S.query_term_plan(V.questions(spark, d)).where("dropped IS NULL"), S.build_vocabulary(S.split_fields(V.pages(spark, d)))


LETTERS = "^\\p{L}+$"


def family_sql(name: str, asked: str) -> str:
    return f"""
{name}_asked AS (SELECT term, {stem_sql("term")} AS key FROM {asked} WHERE term NOT IN ({WORDS})),
{name}_words AS (SELECT token, {stem_sql("token")} AS key FROM vocabulary WHERE token NOT IN ({WORDS})),
{name}_left AS (SELECT term, key, true AS bare FROM {name}_asked WHERE regexp_matches(key, '{LETTERS}') AND (ends_with(term, 'n') OR term = key) UNION ALL SELECT term, unnest({verb_keys_sql("key")}), false FROM {name}_asked),
{name}_right AS (SELECT token, key, true AS base FROM {name}_words UNION ALL SELECT token, unnest({verb_keys_sql("key")}), false FROM {name}_words),
{name} AS (SELECT term, token, max(struct_pack(weight := w, rule := r)) AS b FROM (
  SELECT term, token, 1.0::DOUBLE AS w, 'exact' AS r FROM {asked} JOIN vocabulary ON term = token
  UNION ALL SELECT term, token, 0.9, 'fold' FROM {name}_asked a JOIN {name}_words v ON {fold_sql("term")} = {fold_sql("token")}
  UNION ALL SELECT term, token, 0.6, 'stem' FROM {name}_asked a JOIN {name}_words v ON a.key = v.key
  UNION ALL SELECT term, token, 0.5, 'verb' FROM {name}_left a JOIN {name}_right v ON a.key = v.key WHERE NOT (bare AND base)) GROUP BY ALL)"""


FAMILY = family_sql("family", "asked")


@query(f"WITH {VOCABULARY}, {FAMILY} SELECT term, token, b.rule AS rule, b.weight AS weight FROM family")
def family_join(spark: SparkSession, d: str) -> DataFrame:
    return L.family_join(*_terms(spark, d))


FORMS = ", ".join([f"('{x}', '{k}', false)" for k, v in L.IRREGULAR.items() for x in (k, *v.split())] + [f"('{x}', '{k}', true)" for k, v in L.NOUNS_OF.items() for x in v.split()])
IRREGULAR = f"""
forms AS (SELECT * FROM (VALUES {FORMS}) AS f(form, key, noun)),
every_word AS (SELECT DISTINCT term FROM terms),
by_form AS (SELECT DISTINCT w.term, v.token, a.noun <> b.noun AS crossing FROM every_word w JOIN forms a ON a.form = w.term JOIN forms b ON b.key = a.key JOIN vocabulary v ON v.token = b.form WHERE w.term <> v.token)"""


@query(f"WITH {VOCABULARY}, {IRREGULAR} SELECT term, token, 'irregular' AS rule, 0.45::DOUBLE AS weight FROM by_form WHERE NOT crossing")
def irregular_join(spark: SparkSession, d: str) -> DataFrame:
    _, vocabulary = _terms(spark, d)
    return L.irregular_join(S.query_term_plan(V.questions(spark, d)), vocabulary)


def corpus_terms(vocabulary: DataFrame) -> DataFrame:
    """Every word of the corpus, asked for: rules that few questions meet are run over all of them."""
    return vocabulary.select(F.col("token").alias("term"))


@query(f"WITH {VOCABULARY}, {IRREGULAR.replace('SELECT DISTINCT term FROM terms', 'SELECT token AS term FROM vocabulary')} SELECT term, token, 'derived' AS rule, 0.45::DOUBLE AS weight FROM by_form WHERE crossing")
def derived_join(spark: SparkSession, d: str) -> DataFrame:
    _, vocabulary = _terms(spark, d)
    return L.derived_join(corpus_terms(vocabulary), vocabulary)


WORD_PARTS = f"word_parts AS (SELECT DISTINCT part FROM (SELECT unnest([token, {stem_sql('token')}]) AS part FROM vocabulary WHERE regexp_matches(token, '{LETTERS}') AND token NOT IN ({WORDS})) WHERE length(part) >= 4)"
LINKED = f"""
{WORD_PARTS},
keyed_terms AS (SELECT term, {stem_sql("term")} AS key FROM (SELECT DISTINCT term FROM split_terms) WHERE regexp_matches(term, '^\\p{{L}}+$') AND term NOT IN ({WORDS})),
term_cuts AS (SELECT term, key, substr(term, length(key) + 1) AS ending, substr(key, 1, place) AS before, substr(key, place + 1) AS rest FROM (SELECT term, key, unnest(generate_series(4, length(key) - 4)) AS place FROM keyed_terms WHERE length(key) >= 8)),
split_words AS (SELECT term, ending, before, l AS link, substr(rest, length(l) + 1) AS after FROM term_cuts, (SELECT unnest(['', 's', 'es', 'n', 'en', 'e']) AS l) ls WHERE starts_with(rest, l) AND length(rest) - length(l) >= 4),
sound AS (SELECT * FROM split_words WHERE before IN (SELECT part FROM word_parts) AND after IN (SELECT part FROM word_parts)),
variants AS (SELECT term, unnest([before || l || after, before || l || after || ending]) AS token FROM sound, (SELECT unnest(['', 's', 'es', 'n', 'en', 'e']) AS l) ls WHERE l <> link),
link_variants AS (SELECT DISTINCT term, token FROM variants WHERE token IN (SELECT token FROM vocabulary) AND term <> token),
heads AS (SELECT term, arg_max(after, length(after)) AS head FROM sound GROUP BY term),
head_words AS (SELECT DISTINCT head AS term FROM heads), {family_sql("family_of_heads", "head_words")},
head_family AS (SELECT DISTINCT h.term, f.token FROM heads h JOIN family_of_heads f ON f.term = h.head WHERE h.term <> f.token)"""


@query(f"WITH {VOCABULARY}, split_terms AS (SELECT token AS term FROM vocabulary), {LINKED} SELECT term, token, 'compound_link' AS rule, 0.45::DOUBLE AS weight FROM link_variants")
def link_variant_join(spark: SparkSession, d: str) -> DataFrame:
    _, vocabulary = _terms(spark, d)
    return L.link_variant_join(corpus_terms(vocabulary), vocabulary)


@query(f"WITH {VOCABULARY}, split_terms AS (SELECT token AS term FROM vocabulary), {LINKED} SELECT term, token, 'query_part' AS rule, 0.35::DOUBLE AS weight FROM head_family")
def query_head_join(spark: SparkSession, d: str) -> DataFrame:
    _, vocabulary = _terms(spark, d)
    return L.query_head_join(corpus_terms(vocabulary), vocabulary)


@query(f"""WITH {VOCABULARY} SELECT term, token, 'typo' AS rule, 0.3::DOUBLE AS weight FROM asked JOIN vocabulary ON abs(length(term) - length(token)) <= 1 AND term <> token
WHERE length(term) >= 8 AND length(token) >= 7 AND damerau_levenshtein(term, token) <= 1""")
def typo_join(spark: SparkSession, d: str) -> DataFrame:
    return L.typo_join(*_terms(spark, d))


COMPOUND = f"""
named AS (SELECT DISTINCT term, {stem_sql("term")} AS part FROM asked WHERE regexp_matches(term, '{LETTERS}') AND term NOT IN ({WORDS})),
wholes AS (SELECT token, {stem_sql("token")} AS whole FROM vocabulary WHERE regexp_matches(token, '{LETTERS}') AND token NOT IN ({WORDS})),
pieces AS (SELECT whole, start, stop, substr(whole, start + 1, stop - start) AS part FROM (SELECT whole, start, unnest(generate_series(start + 4, length(whole))) AS stop
  FROM (SELECT whole, unnest(generate_series(0, length(whole) - 4)) AS start FROM (SELECT DISTINCT whole FROM wholes WHERE length(whole) >= 8)))),
in_compound AS (SELECT term, whole, start, stop FROM pieces JOIN named USING (part) WHERE stop - start < length(whole)),
edges AS (SELECT whole, start, stop FROM pieces WHERE whole IN (SELECT whole FROM in_compound) AND part IN (SELECT part FROM word_parts)),
link AS (SELECT unnest(['', 's', 'es', 'n', 'en', 'e']) AS l),
reached AS (SELECT whole, 0::BIGINT AS place FROM (SELECT DISTINCT whole FROM in_compound) UNION SELECT e.whole, e.stop + length(l) FROM reached r JOIN edges e ON e.whole = r.whole AND e.start = r.place JOIN link ON starts_with(substr(e.whole, e.stop + 1), l)),
reaching AS (SELECT whole, length(whole)::BIGINT AS place FROM (SELECT DISTINCT whole FROM in_compound) UNION SELECT e.whole, e.start - length(l) FROM reaching r JOIN edges e ON e.whole = r.whole AND e.stop = r.place JOIN link ON ends_with(substr(e.whole, 1, e.start), l)),
compound AS (SELECT term, token, min(CASE WHEN stop = length(whole) THEN 'compound_head' ELSE 'compound_modifier' END) AS rule FROM in_compound h JOIN wholes USING (whole)
  WHERE (whole, start) IN (SELECT (whole, place) FROM reached) AND (whole, stop) IN (SELECT (whole, place) FROM reaching) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {VOCABULARY}, {WORD_PARTS}, {COMPOUND} SELECT term, token, rule, CASE rule WHEN 'compound_head' THEN 0.45 ELSE 0.35 END::DOUBLE AS weight FROM compound")
def compound_join(spark: SparkSession, d: str) -> DataFrame:
    terms, vocabulary = _terms(spark, d)
    return L.compound_join(terms, settled(vocabulary))


RESOLVED = f"""{FAMILY}, {IRREGULAR}, split_terms AS (SELECT term FROM asked), {LINKED}, {COMPOUND},
sure AS (SELECT term, token, b.rule AS rule, b.weight AS weight, 0 AS stage FROM family
  UNION ALL SELECT term, token, CASE WHEN crossing THEN 'derived' ELSE 'irregular' END, 0.45::DOUBLE, CASE WHEN crossing THEN 2 ELSE 1 END FROM by_form WHERE term IN (SELECT term FROM asked)
  UNION ALL SELECT term, token, rule, CASE rule WHEN 'compound_head' THEN 0.45 ELSE 0.35 END::DOUBLE, 3 FROM compound),
staged AS (SELECT * FROM sure UNION ALL SELECT term, token, 'compound_link', 0.45::DOUBLE, 4 FROM link_variants WHERE term NOT IN (SELECT term FROM family)
  UNION ALL SELECT term, token, 'query_part', 0.35::DOUBLE, 5 FROM head_family WHERE term NOT IN (SELECT term FROM sure)),
every AS (SELECT * FROM staged UNION ALL SELECT term, token, 'typo', 0.3::DOUBLE, 6 FROM asked JOIN vocabulary ON abs(length(term) - length(token)) <= 1 AND term <> token
  WHERE term NOT IN (SELECT term FROM staged) AND length(term) >= 8 AND length(token) >= 7 AND damerau_levenshtein(term, token) <= 1),
resolved AS (SELECT term, token, rule, weight FROM every QUALIFY row_number() OVER (PARTITION BY term, token ORDER BY stage) = 1)"""


@query(f"WITH RECURSIVE {VOCABULARY}, {RESOLVED} SELECT term, token, rule, weight FROM resolved")
def resolve_terms(spark: SparkSession, d: str) -> DataFrame:
    return L.resolve_terms(*_terms(spark, d))


TRUST = """
trust AS (SELECT path, CASE WHEN verified_by IS NULL OR NOT regexp_matches(verified_by, '^[a-z]+:[a-z0-9][a-z0-9._-]*$') THEN 'unverified' WHEN starts_with(verified_by, 'human:') THEN 'human-reviewed' ELSE 'machine-confirmed' END AS trust_tier,
  CASE WHEN verified_by IS NOT NULL AND NOT regexp_matches(verified_by, '^[a-z]+:[a-z0-9][a-z0-9._-]*$') THEN 'malformed-actor' END AS finding FROM pages)"""


@query(f"WITH {V.PAGES}, {TRUST} SELECT * FROM trust")
def trust_audit(spark: SparkSession, d: str) -> DataFrame:
    return G.trust_audit(V.pages(spark, d))


@query(f"WITH {V.PAGES}, {TRUST} SELECT trust_tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM trust GROUP BY trust_tier")
def trust_distribution(spark: SparkSession, d: str) -> DataFrame:
    return G.trust_distribution(V.pages(spark, d))


@query(f"WITH {V.PAGES} SELECT path, coalesce(DATE '{TODAY}' > stale_after, false) AS is_stale, CASE WHEN DATE '{TODAY}' > stale_after THEN DATE '{TODAY}' - stale_after END AS days_past FROM pages")
def expiry_audit(spark: SparkSession, d: str) -> DataFrame:
    return G.expiry_audit(V.pages(spark, d), TODAY)


@query(f"WITH {V.PAGES} SELECT count(*) AS pages, count(stale_after) AS with_expiry, count(*) FILTER (stale_after < DATE '{TODAY}') AS expired FROM pages")
def freshness_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.freshness_summary(V.pages(spark, d), TODAY)


LATEST = V.REVIEWS + """,
latest AS (SELECT collection, kind, r.reviewed_at AS reviewed_at, r.review_id AS review_id, r.outcome AS outcome FROM (SELECT collection, kind, max(struct_pack(reviewed_at := reviewed_at, review_id := review_id, outcome := outcome)) AS r FROM reviews GROUP BY ALL))"""


@query(f"WITH {LATEST} SELECT collection, kind, epoch_us(reviewed_at) AS reviewed_us, review_id, outcome FROM latest")
def latest_review(spark: SparkSession, d: str) -> DataFrame:
    return G.latest_review(V.reviews(spark, d)).withColumn("reviewed_us", F.unix_micros(F.col("reviewed_at").cast("timestamp"))).drop("reviewed_at")


HEALTH_DAY = "2024-03-01"


@query(f"""WITH {LATEST}, aged AS (SELECT collection, outcome, greatest(floor((epoch(TIMESTAMP '{HEALTH_DAY}') - floor(epoch(reviewed_at))) / 86400), 0) AS age, CASE kind WHEN 'quality' THEN 30 ELSE 90 END AS days FROM latest),
ranked AS (SELECT collection, CASE WHEN outcome = 'failed' THEN 3 WHEN age >= days THEN 2 WHEN days - age <= least(greatest(round(days * 0.2), 3), 14) THEN 1 ELSE 0 END AS r FROM aged)
SELECT collection, ['current', 'due-soon', 'overdue', 'attention-needed'][max(r) + 1] AS state FROM ranked GROUP BY collection""")
def review_health(spark: SparkSession, d: str) -> DataFrame:
    return G.review_health(G.latest_review(V.reviews(spark, d)), HEALTH_DAY)


RULES = r"""
rules AS (SELECT path, unnest(list_filter([CASE WHEN trim(title) = '' THEN 'missing-title' END, CASE WHEN length(title) > 200 THEN 'long-title' END, CASE WHEN description = '' THEN 'missing-description' END,
  CASE WHEN length(description) > 120 THEN 'long-description' END, CASE WHEN status NOT IN ('active', 'draft', 'superseded', 'withdrawn') THEN 'bad-status' END, CASE WHEN NOT regexp_matches(language, '^[a-z]{2}$') THEN 'bad-language' END,
  CASE WHEN status = 'active' AND regexp_matches(body, '(?i)\btodo\b') THEN 'todo-in-active' END, CASE WHEN stale_after < updated THEN 'expires-before-update' END], lambda x: x IS NOT NULL)) AS code FROM pages)"""


@query(f"WITH {V.PAGES}, {RULES} SELECT path, code FROM rules")
def field_rules(spark: SparkSession, d: str) -> DataFrame:
    return G.field_rules(V.pages(spark, d))


@query(f"WITH {V.PAGES}, {RULES} SELECT code, CASE WHEN code IN ('missing-title', 'bad-status') THEN 'error' ELSE 'warning' END AS level, count(*) AS n FROM rules GROUP BY code")
def lint_report(spark: SparkSession, d: str) -> DataFrame:
    return G.lint_report(G.field_rules(V.pages(spark, d)), ("missing-title", "bad-status"))


@query(f"WITH {V.SOURCES} SELECT source_id, count(*) AS n FROM sources GROUP BY source_id HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return G.duplicate_keys(V.sources(spark, d), "source_id")


JOINED = V.PAGES + ", " + V.LINKS + ", joined AS (SELECT l.path, l.target_id, p.path IS NOT NULL AS resolved, p.path AS target_path FROM links l LEFT JOIN pages p ON p.page_id = l.target_id)"


@query(f"WITH {JOINED} SELECT path, target_id, resolved, target_path FROM joined")
def wikilink_join(spark: SparkSession, d: str) -> DataFrame:
    return G.wikilink_join(V.links(spark, d), V.pages(spark, d))


@query(f"WITH {JOINED} SELECT p.path, coalesce(n, 0) AS inbound, n IS NULL AS orphan FROM pages p LEFT JOIN (SELECT target_id, count(*) AS n FROM links GROUP BY target_id) t ON t.target_id = p.page_id")
def inbound_links(spark: SparkSession, d: str) -> DataFrame:
    return G.inbound_links(V.links(spark, d), V.pages(spark, d))


@query(f"WITH {V.PAGES} SELECT DISTINCT kind, id FROM (SELECT unnest(['file', 'cluster', 'concept']) AS kind, unnest([path, cluster, concept]) AS id FROM pages) WHERE id IS NOT NULL")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_nodes(V.pages(spark, d))


@query(f"WITH {JOINED} SELECT DISTINCT * FROM (SELECT unnest(['cluster', 'concept']) AS kind, path AS source, unnest([cluster, concept]) AS target FROM pages UNION ALL SELECT 'wikilink', path, target_path FROM joined)")
def graph_links(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_links(V.pages(spark, d), V.links(spark, d))


@query(f"""WITH {V.PAGES}, {V.LINKS}, {V.CITATIONS}, {V.SOURCES}
SELECT 'unknown-replaced-claim' AS code, claim_id AS subject FROM claims WHERE replaces IS NOT NULL AND replaces NOT IN (SELECT claim_id FROM claims)
UNION ALL SELECT 'unknown-source', claim_id FROM citations WHERE source_no NOT IN (SELECT source_no FROM sources)
UNION ALL SELECT 'broken-link', path FROM links WHERE target_id NOT IN (SELECT page_id FROM pages)""")
def reference_integrity(spark: SparkSession, d: str) -> DataFrame:
    return G.reference_integrity(V.claims(spark, d), V.citations(spark, d), V.sources(spark, d), V.links(spark, d), V.pages(spark, d))


@query(f"""WITH {V.PAGES} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, count(*) AS n,
array_to_string(list_sort(list('- [' || title || '](' || path || ')' || CASE WHEN status <> 'active' THEN ' (' || status || ')' ELSE '' END)), chr(10)) AS entries FROM pages GROUP BY 1""")
def directory_index(spark: SparkSession, d: str) -> DataFrame:
    return G.directory_index(V.pages(spark, d))


SECRETS = "[" + ", ".join(f"CASE WHEN regexp_matches(line, '{rx.replace(chr(39), chr(39) * 2)}') THEN '{k}' END" for k, rx in G.SECRET_RULES.items()) + "]"


@query(f"""WITH {V.PAGES}, ln AS (SELECT path, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM pages)
SELECT * FROM (SELECT path, line_no, unnest({SECRETS}) AS rule FROM ln) WHERE rule IS NOT NULL""")
def secret_screen(spark: SparkSession, d: str) -> DataFrame:
    return G.secret_screen(V.pages(spark, d))


@query(f"""WITH {V.SOURCES}, m AS (SELECT source_no, text, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '```'))) AS fences FROM sources),
f AS (SELECT source_no, list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN contains(text, '�') THEN 'replacement-character' END, CASE WHEN longest > 20000 THEN 'flattened' END], lambda x: x IS NOT NULL) AS e,
list_filter([CASE WHEN longest > 2000 AND longest <= 20000 THEN 'long-line' END, CASE WHEN fences % 2 = 1 THEN 'odd-fences' END], lambda x: x IS NOT NULL) AS w FROM m)
SELECT source_no, CASE WHEN len(e) > 0 THEN 'error' WHEN len(w) > 0 THEN 'warning' ELSE 'ok' END AS state, array_to_string(list_concat(e, w), ' ') AS problems FROM f""")
def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    return G.extraction_quality(V.sources(spark, d))


INVENTORY = ("status", "type", "language", "cluster", "concept", "updated", "stale_after", "verified_by")


@query(f"""WITH {V.PAGES} SELECT property, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT unnest([{", ".join(f"'{x}'" for x in INVENTORY)}]) AS property, unnest([{", ".join(f"{x}::VARCHAR" for x in INVENTORY)}]) AS value FROM pages)
WHERE value IS NOT NULL GROUP BY property""")
def property_inventory(spark: SparkSession, d: str) -> DataFrame:
    return G.property_inventory(V.pages(spark, d), INVENTORY)
