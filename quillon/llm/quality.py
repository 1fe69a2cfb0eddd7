"""Operator 4: quality rules as one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, WORD

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and a to in is for on that with as by it this be are was or an from at not have has "
    "le la les des du un une et est pour dans que qui sur pas par au aux en de il elle "
    "der die das und ist von zu den dem ein eine im auf mit nicht sich für als auch "
    "el los las y del por con para se no su al lo una"
).split()

#: rule -> (signal, lowest allowed, highest allowed); None: no bound. A document is kept if all hold.
RULES: dict[str, tuple[str, float | None, float | None]] = {
    "length": ("n_words", 50, None),
    "word_length": ("mean_word_chars", 2.0, 14.0),
    "symbols": ("symbol_ratio", None, 0.1),
    "shouting": ("exclamation_ratio", None, 0.4),
    "stop_words": ("stop_word_ratio", 0.02, None),
    "repeated_lines": ("dup_line_ratio", None, 0.5),
    "repeated_words": ("repeat_word_ratio", None, 0.5),
}


def signals(docs: DataFrame, text: str = "text", hash_bits: int = 64) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios the rules read.

    A null text has no words. Repeated words: 3-word windows are hashed (to ``hash_bits`` bits); where two hashes are
    equal, windows are sorted by hash and words, so equal windows, and no others, are equal neighbours, and words under
    starts with an equal neighbour are counted once. The hash only saves comparing words: a tie changes nothing.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("_words", F.array_remove(F.split(whole, f"{SPACE}+"), "")).withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("_lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("_hashes", F.expr(f"""
        CASE WHEN n_words > 3 THEN transform(arrays_zip(slice(_words, 1, n_words - 2), slice(_words, 2, n_words - 2), slice(_words, 3, n_words - 2)), x -> shiftright(xxhash64(x), {64 - hash_bits})) END"""))
    df = df.withColumn("_repeats", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    df = df.withColumn("_windows", F.expr("CASE WHEN _repeats THEN sort_array(transform(_hashes, (h, i) -> struct(struct(h, _words[i] AS a, _words[i + 1] AS b, _words[i + 2] AS c) AS w, i AS i))) END"))
    df = df.withColumn("_starts", F.expr("""
        CASE WHEN _repeats THEN sort_array(transform(filter(sequence(0, size(_windows) - 1), k -> _windows[k].w <=> get(_windows, k - 1).w OR _windows[k].w <=> get(_windows, k + 1).w), k -> cast(_windows[k].i AS long))) END"""))
    df = df.withColumns({
        "word_chars": (F.length(whole) - F.regexp_count(whole, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_exclamations": (F.length(whole) - F.length(F.replace(whole, F.lit("!"), F.lit("")))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)))).cast("long"),
        "n_repeat_words": F.expr("CASE WHEN _repeats THEN aggregate(_starts, named_struct('n', 0L, 'end', 0L), (acc, p) -> named_struct('n', acc.n + 3L - greatest(0L, acc.end - p), 'end', p + 3L)).n ELSE 0L END"),
    })
    words = F.greatest("n_words", F.lit(1))
    return df.withColumns({
        "mean_word_chars": F.col("word_chars") / words, "symbol_ratio": F.col("n_symbols") / words, "exclamation_ratio": F.col("n_exclamations") / words,
        "stop_word_ratio": F.col("n_stop_words") / words, "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeat_word_ratio": F.col("n_repeat_words") / words,
    }).drop("_words", "_lines", "_hashes", "_repeats", "_windows", "_starts")


def verdict(rules: dict[str, tuple[str, float | None, float | None]] = RULES) -> Column:
    """The rule table as one column: names of the rules a row breaks."""
    broken = []
    for name, (signal, low, high) in rules.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(signal) < low)
        if high is not None:
            bad = bad | (F.col(signal) > high)
        broken.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*broken)).cast("array<string>")


def quality_rules(docs: DataFrame, text: str = "text", rules: dict[str, tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """Operator 4: ``docs`` with signals, base_failed, broken_rules and kept.

    One projection over the scan, no shuffle. Null and empty texts have no words and fail
    the base rule. Repeated rows are judged alike; an empty table gives an empty table. A
    column of ``docs`` that has the name of a signal is replaced.
    """
    df = signals(docs, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("broken_rules", verdict(rules))
    # the row number (never negative) keeps a filter on kept above this projection: the optimiser would
    # else copy the signals, lambda in lambda, into the filter and count them anew for each word
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0) & (F.monotonically_increasing_id() >= 0))


def keep_good(docs: DataFrame, text: str = "text", rules: dict[str, tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with the columns they had."""
    return quality_rules(docs, text, rules).where("kept").select(docs.columns)


def rules_sql() -> str:
    """The query of operator 4 in DuckDB's SQL."""
    words = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
    stop = ", ".join(f"'{x}'" for w in STOP_WORDS for x in (w, w.capitalize()))
    broken = []
    for signal, low, high in RULES.values():
        broken += [f"coalesce({signal} < {low}, false)"] * (low is not None) + [f"coalesce({signal} > {high}, false)"] * (high is not None)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {words} AS words FROM d),
tok AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o) AS x, lead(word, 2) OVER o IS NOT NULL AS ok FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win WHERE ok) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations,
        coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN ln ON ln.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id),
r AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio, n_exclamations / greatest(n_words, 1) AS exclamation_ratio,
        n_stop_words / greatest(n_words, 1) AS stop_word_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_word_ratio,
        (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {" OR ".join(broken)}) AS kept FROM r"""
