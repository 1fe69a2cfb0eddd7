"""Queries of sources and citations, and their SQL, which reads the marked texts by string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.settled import settled
from quillon.functions.text import tokens, tokens_sql
from quillon.operators import evidence as E
from quillon.plans import views as V
from quillon.plans.search_queries import query


def marked_sources(spark: SparkSession, d: str) -> DataFrame:
    """source_no, text: sources with page marks, headings, slides beside code fences, no marks, or headings with time stamps."""
    rows = V.sources(spark, d).select("source_no", F.split("text", "\n").alias("lines"), (F.col("source_no") % 5).alias("k"))
    words = lambda x: F.array_join(F.slice(tokens(x), 1, 3), " ")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")

    def before(x, i):
        mark = F.when((F.col("k") == 0) & (i % 3 == 0), F.concat(F.lit("<!-- page: "), (i / 3).cast("long") + 1, F.lit(" -->\n")))
        mark = mark.when((F.col("k") == 1) & (i % 2 == 0), F.concat(F.when(i % 4 == 0, "## ").otherwise("### "), words(x), F.lit("\n")))
        mark = mark.when((F.col("k") == 2) & (i % 2 == 0), F.concat(F.lit("<!-- slide: "), (i / 2).cast("long") + 1, F.lit(" -->\n"))).when((F.col("k") == 2) & (i % 4 == 1), F.lit("```\n<!-- slide: 99 -->\n```\n"))
        return mark.when((F.col("k") == 4) & (i % 2 == 0), F.concat(F.lit("## 00:"), two(i % 60), F.lit(":07 "), words(x), F.lit("\n"))).otherwise("")

    title = F.when((F.col("k") == 1) & (F.col("source_no") % 2 == 0), F.lit("# Source\n")).otherwise("")
    return rows.select("source_no", F.concat(title, F.array_join(F.transform("lines", lambda x, i: F.concat(before(x, i), x)), "\n")).alias("text"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    """claim_id, claim_status, source_no, locator: each claim but an opinion cites a passage, its own page's text or nothing that is there."""
    n_bench = V.table(spark, d, "benchmark").count()
    n, k, i = F.col("page_id") * 31 + F.col("line_no"), (F.col("page_id") + F.col("line_no")) % 8, F.col("line_no")
    of = F.when(n % 50 == 0, F.lit(-1)).when(n % 3 == 0, n % n_bench * 2).otherwise(F.col("page_id") * 2 + 1)
    a = ((n % 4) + 1).cast("string")
    words = tokens(F.col("text"))
    locator = F.when(k == 0, F.concat(F.lit("page="), a)).when(k == 1, F.concat(F.lit("page=1-"), a)).when(k == 2, "document").when(k == 3, "see above")
    locator = locator.when(k == 4, F.concat(F.lit("Section = "), F.array_join(F.slice(words, 1, 3), " "))).when(k == 5, F.concat(F.lit("heading="), F.coalesce(F.get(words, F.lit(0)), F.lit(""))))
    locator = locator.when(k == 6, F.concat(F.lit("slide="), a)).otherwise(F.concat(F.lit("timestamp=00:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(":07")))
    return V.claims(spark, d).where("kind <> 'opinion'").select("claim_id", F.col("status").alias("claim_status"), of.cast("long").alias("source_no"), locator.alias("locator"))


WORDS = f"array_to_string(({tokens_sql('x')})[1:3], ' ')"
PARTS = V.SOURCES + f""",
split_sources AS (SELECT source_no, source_no % 5 AS k, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM sources),
joined AS (SELECT source_no, CASE WHEN source_no % 5 = 1 AND source_no % 2 = 0 THEN '# Source' || chr(10) ELSE '' END || string_agg(CASE WHEN k = 0 AND i % 3 = 0 THEN '<!-- page: ' || (i // 3 + 1) || ' -->' || chr(10)
    WHEN k = 1 AND i % 2 = 0 THEN CASE WHEN i % 4 = 0 THEN '## ' ELSE '### ' END || {WORDS} || chr(10) WHEN k = 2 AND i % 2 = 0 THEN '<!-- slide: ' || (i // 2 + 1) || ' -->' || chr(10)
    WHEN k = 2 AND i % 4 = 1 THEN '```' || chr(10) || '<!-- slide: 99 -->' || chr(10) || '```' || chr(10) WHEN k = 4 AND i % 2 = 0 THEN '## 00:' || lpad((i % 60)::VARCHAR, 2, '0') || ':07 ' || {WORDS} || chr(10) ELSE '' END || x, chr(10) ORDER BY i) AS text
  FROM split_sources GROUP BY source_no),
ln AS (SELECT source_no, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM joined),
says AS (SELECT *, t = '```' AS fence, regexp_matches(t, '[\\p{{L}}\\p{{N}}_]') AS word FROM ln),
open_fence AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY source_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM says),
classed AS (SELECT *, CASE WHEN NOT inside AND ends_with(t, ' -->') AND starts_with(t, '<!-- page: ') THEN 'page' WHEN NOT inside AND ends_with(t, ' -->') AND starts_with(t, '<!-- slide: ') THEN 'slide' END AS mark,
  CASE WHEN NOT inside AND contains('|#|##|###|####|#####|######|', '|' || split_part(t, ' ', 1) || '|') AND regexp_matches(substr(t, instr(t, ' ') + 1), '[\\p{{L}}\\p{{N}}_]') AND instr(t, ' ') > 0 THEN instr(t, ' ') - 1 END AS level FROM open_fence),
numbered AS (SELECT *, sum((mark IS NOT NULL OR level IS NOT NULL)::INT) OVER w AS segment, sum((level IS NOT NULL)::INT) OVER w AS head, last_value(CASE WHEN mark IS NOT NULL THEN mark || '=' || split_part(t, ' ', 3) END IGNORE NULLS) OVER w AS page_unit
  FROM classed WINDOW w AS (PARTITION BY source_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
heads AS (SELECT source_no, head, level, i AS line, trim(substr(t, instr(t, ' ') + 1)) AS words FROM numbered WHERE level IS NOT NULL),
spans AS (SELECT h.source_no, h.head, coalesce(min(b.head), (SELECT max(head) + 1 FROM heads e WHERE e.source_no = h.source_no)) AS until FROM heads h LEFT JOIN heads b ON b.source_no = h.source_no AND b.head > h.head AND b.level <= h.level GROUP BY h.source_no, h.head),
kinds AS (SELECT source_no, CASE WHEN bool_or(mark = 'page') THEN 'page' WHEN bool_or(mark = 'slide') THEN 'slide' WHEN max(level) IS NOT NULL THEN 'section' WHEN bool_or(fence OR (word AND mark IS NULL AND level IS NULL)) THEN 'document' ELSE 'empty' END AS kind FROM numbered GROUP BY source_no),
segs AS (SELECT source_no, segment, max(head) AS head, max(page_unit) AS page_unit, bool_or(fence OR (word AND mark IS NULL AND level IS NULL)) AS has_text,
  list_distinct(flatten(list(CASE WHEN mark IS NULL THEN regexp_extract_all(t, '(?:^|[^0-9:])([0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}})(?:$|[^0-9:])', 1) ELSE [] END))) AS stamps FROM numbered GROUP BY source_no, segment),
names AS (SELECT h.source_no, h.head, 'section=' || words || CASE WHEN count(*) OVER (PARTITION BY h.source_no, words) > 1 THEN ' (line ' || line || ')' ELSE '' END AS label FROM heads h),
plain_units AS (SELECT s.source_no, kind, segment, s.head, until, stamps, CASE WHEN has_text THEN CASE WHEN kind IN ('page', 'slide') THEN page_unit WHEN kind = 'section' THEN label WHEN kind = 'document' THEN 'document' END END AS unit
  FROM segs s JOIN kinds USING (source_no) LEFT JOIN names n ON n.source_no = s.source_no AND n.head = s.head LEFT JOIN spans p ON p.source_no = s.source_no AND p.head = s.head),
ranked AS (SELECT *, until > max(head) OVER (PARTITION BY source_no) AND row_number() OVER (PARTITION BY source_no ORDER BY head) < count(*) OVER (PARTITION BY source_no) AS over_all FROM plain_units WHERE kind = 'section' AND unit IS NOT NULL),
titles AS (SELECT source_no, segment FROM ranked r WHERE over_all AND NOT EXISTS (SELECT 1 FROM ranked e WHERE e.source_no = r.source_no AND e.head < r.head AND NOT e.over_all)),
in_unit AS (SELECT p.source_no, kind, segment, head, stamps, CASE WHEN (source_no, segment) IN (SELECT (source_no, segment) FROM titles) THEN NULL ELSE unit END AS unit FROM plain_units p),
units AS (SELECT source_no, row_number() OVER (PARTITION BY source_no ORDER BY min(segment)) AS ord, unit, kind FROM in_unit WHERE unit IS NOT NULL GROUP BY source_no, unit, kind)"""
CITED = V.CLAIMS + ", " + PARTS + f""",
citations AS (SELECT claim_id, status AS claim_status, (CASE WHEN n % 50 = 0 THEN -1 WHEN n % 3 = 0 THEN n % (SELECT count(*) FROM benchmark) * 2 ELSE page_id * 2 + 1 END)::BIGINT AS source_no,
  CASE (page_id + line_no) % 8 WHEN 0 THEN 'page=' || a WHEN 1 THEN 'page=1-' || a WHEN 2 THEN 'document' WHEN 3 THEN 'see above' WHEN 4 THEN 'Section = ' || array_to_string(w[1:3], ' ') WHEN 5 THEN 'heading=' || coalesce(w[1], '') WHEN 6 THEN 'slide=' || a ELSE 'timestamp=00:' || lpad((line_no % 60)::VARCHAR, 2, '0') || ':07' END AS locator
  FROM (SELECT *, page_id * 31 + line_no AS n, (page_id * 31 + line_no) % 4 + 1 AS a, {tokens_sql('text')} AS w FROM claims WHERE kind <> 'opinion')),
asked AS (SELECT DISTINCT source_no, locator, lower(trim(split_part(locator, '=', 1))) AS key, trim(substr(locator, instr(locator, '=') + 1)) AS v FROM citations WHERE source_no IN (SELECT source_no FROM joined)),
marks AS (SELECT DISTINCT source_no, mark, split_part(t, ' ', 3)::BIGINT AS no FROM numbered WHERE mark IS NOT NULL),
ranges AS (SELECT source_no, locator, key, split_part(v, '-', 1)::BIGINT AS low, split_part(v, '-', -1)::BIGINT AS high FROM asked WHERE key IN ('page', 'slide')),
by_mark AS (SELECT r.source_no, locator, key || '=' || m.no AS unit FROM ranges r JOIN marks m ON m.source_no = r.source_no AND m.mark = r.key AND m.no BETWEEN low AND high
  WHERE EXISTS (SELECT 1 FROM marks e WHERE e.source_no = r.source_no AND e.mark = r.key AND e.no = low) AND EXISTS (SELECT 1 FROM marks e WHERE e.source_no = r.source_no AND e.mark = r.key AND e.no = high)),
bare_heads AS (SELECT source_no, head, lower(words) AS full_words, regexp_replace(lower(words), '^[0-9]+[a-z]? +', '') AS bare FROM heads),
tiers AS (SELECT a.source_no, a.locator, h.head, CASE WHEN full_words = v THEN 1 WHEN bare = v THEN 2 ELSE 3 END AS tier FROM asked a JOIN bare_heads h ON h.source_no = a.source_no
  WHERE key IN ('section', 'heading') AND v <> '' AND (full_words = v OR bare = v OR starts_with(full_words, v || ' ') OR starts_with(bare, v || ' '))),
chosen AS (SELECT * FROM tiers QUALIFY tier = min(tier) OVER (PARTITION BY source_no, locator) AND (tier = 1 OR count(*) OVER (PARTITION BY source_no, locator, tier) = 1)),
by_head AS (SELECT c.source_no, c.locator, u.unit FROM chosen c JOIN spans s ON s.source_no = c.source_no AND s.head = c.head LEFT JOIN in_unit u ON u.source_no = c.source_no AND u.head >= c.head AND u.head < s.until AND u.unit IS NOT NULL),
by_stamp AS (SELECT a.source_no, a.locator, u.unit FROM asked a JOIN in_unit u ON u.source_no = a.source_no AND list_contains(u.stamps, a.v) WHERE key = 'timestamp'),
whole AS (SELECT a.source_no, a.locator, u.unit FROM asked a LEFT JOIN units u ON u.source_no = a.source_no WHERE a.locator = 'document'),
met AS (SELECT * FROM by_mark UNION ALL SELECT * FROM by_head UNION ALL SELECT * FROM by_stamp UNION ALL SELECT * FROM whole),
named AS (SELECT DISTINCT source_no, locator, unit FROM met WHERE (source_no, unit) IN (SELECT (source_no, unit) FROM units)),
states AS (SELECT a.source_no, a.locator, CASE WHEN key NOT IN ('page', 'slide', 'section', 'heading', 'timestamp', 'document') THEN 'unchecked' WHEN (a.source_no, a.locator) IN (SELECT (source_no, locator) FROM met) THEN 'resolved' ELSE 'unresolved' END AS state FROM asked a),
told AS (SELECT s.source_no, s.locator, s.state, (SELECT count(*) FROM named n WHERE n.source_no = s.source_no AND n.locator = s.locator) AS n_units, (SELECT count(*) FROM units u WHERE u.source_no = s.source_no) AS total FROM states s),
live AS (SELECT c.*, coalesce(t.state, 'unknown-source') AS state, n_units, coalesce(t.state = 'resolved' AND total > 1 AND n_units = total, false) AS broad FROM citations c LEFT JOIN told t ON t.source_no = c.source_no AND t.locator = c.locator),
cited AS (SELECT DISTINCT n.source_no, n.unit FROM named n JOIN live l ON l.source_no = n.source_no AND l.locator = n.locator WHERE claim_status IN ('active', 'disputed') AND NOT broad)"""


def _evidence(spark: SparkSession, d: str) -> E.Evidence:
    return E.Evidence(citations(spark, d), settled(E.segments(marked_sources(spark, d))))


@query(f"WITH {PARTS} SELECT * FROM units")
def source_units(spark: SparkSession, d: str) -> DataFrame:
    return E.source_units(E.segments(marked_sources(spark, d)))


@query(f"WITH {CITED} SELECT claim_id, source_no, locator, state, coalesce(n_units, 0) AS n_units, broad FROM live")
def locator_resolve(spark: SparkSession, d: str) -> DataFrame:
    return E.locator_resolve(_evidence(spark, d)).drop("reason")


@query(f"""WITH {CITED} SELECT j.source_no, (SELECT count(*) FROM units u WHERE u.source_no = j.source_no) AS total, (SELECT count(*) FROM cited c WHERE c.source_no = j.source_no) AS cited,
count(l.claim_id) AS citations, count(*) FILTER (broad) AS broad, count(*) FILTER (state = 'unchecked') AS unchecked FROM joined j LEFT JOIN (SELECT * FROM live WHERE claim_status IN ('active', 'disputed')) l ON l.source_no = j.source_no GROUP BY j.source_no""")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    return E.source_coverage(_evidence(spark, d))


@query(f"""WITH {CITED}, open_units AS (SELECT source_no, ord, unit, kind, CASE WHEN kind IN ('page', 'slide') THEN split_part(unit, '=', 2)::BIGINT END AS no, row_number() OVER (PARTITION BY source_no ORDER BY ord) AS place FROM units u WHERE (source_no, unit) NOT IN (SELECT (source_no, unit) FROM cited)),
islands AS (SELECT *, coalesce(no - place, place + 1000000) AS island FROM open_units),
runs AS (SELECT source_no, min(place) AS first, CASE WHEN count(*) = 1 THEN arg_min(unit, place) ELSE arg_min(unit, place) || '-' || max(no) END AS label, count(*) AS size FROM islands GROUP BY source_no, island)
SELECT source_no, ord, label, size, ord <= 20 AS listed FROM (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY first) AS ord FROM runs)""")
def uncited_runs(spark: SparkSession, d: str) -> DataFrame:
    return E.uncited_runs(_evidence(spark, d))
