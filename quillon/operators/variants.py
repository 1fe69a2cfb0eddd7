"""Rules of the scan alone: other endings and verb forms of a word, parts at hyphens, footnote marks, verbs split in a clause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import fold_key, normalize, stem
from quillon.operators.search import FUNCTION_WORDS

#: Weight of the rules, endings, and the letters that must be left.
WEIGHT = 0.35
INFLECTION = ("e", "en", "n", "er", "ern", "es", "em", "s", "se", "sen", "nen")
DEGREE = ("ere", "eren", "erer", "erem", "eres", "ste", "sten", "ster", "stem", "stes", "stens", "este", "esten", "ester", "estem", "estes", "estens", "est")
FEMININE = ("in", "innen")
VERB = ("e", "en", "n", "t", "et", "te", "ten", "ete", "eten", "st", "est")
MIN_BASE, MIN_DEGREE, MIN_VERB, MIN_ENGLISH, MIN_SEPARABLE = 3, 4, 4, 3, 3
LOOK_BACK = 500
#: Particles of separable verbs, without marks on letters.
PARTICLES = tuple("ab an auf aus bei dar durch ein empor entgegen fest fort frei her herab heran herauf heraus herbei herein herum herunter hervor hin hinab hinauf hinaus hinein hinzu hoch los mit nach nieder um vor voran voraus vorbei weg weiter wieder zu zurecht zuruck zusammen".split())
LETTERS = r"^\p{L}+$"


def without(word: Column, endings: tuple[str, ...], shortest: int) -> Column:
    """What is left of a word without each of the endings that it has, if at least ``shortest`` letters."""
    return F.array_compact(F.array(*(F.when(word.endswith(x) & (F.length(word) >= shortest + len(x)), F.left(word, F.length(word) - len(x))) for x in endings)))


def added(bases: Column, endings: tuple[str, ...]) -> Column:
    return F.flatten(F.transform(bases, lambda b: F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat(b, e))))


def ending_variants(words: DataFrame) -> DataFrame:
    """term, token: the spellings that share a base with a term, by inflection, degree and feminine endings. ``words``: term, word."""
    word = F.col("word")
    bases = F.array_distinct(F.concat(F.array(word), without(word, INFLECTION, MIN_BASE), without(word, DEGREE, MIN_DEGREE), without(word, FEMININE, MIN_DEGREE)))
    long = F.filter("bases", lambda b: F.length(b) >= MIN_DEGREE)
    rows = words.where(F.length("word") >= MIN_BASE).withColumn("bases", bases)
    return rows.select("term", "word", F.explode(F.concat("bases", added(F.col("bases"), INFLECTION), added(long, DEGREE + FEMININE))).alias("token")).where("token <> word").select("term", "token").distinct()


def verb_variants(words: DataFrame) -> DataFrame:
    """term, token: other forms of a regular verb, of a separable one, and of an English one. ``words``: term, word."""
    word = F.col("word")
    inner = F.expr("substring(word, 3, length(word) - CASE WHEN word LIKE '%et' THEN 4 ELSE 3 END)")
    participle = F.when(word.rlike(r"^ge.*t$") & (F.length(inner) >= MIN_VERB), inner)
    stems = words.withColumn("s", F.array_distinct(F.array_compact(F.array_append(without(word, VERB, MIN_VERB), participle))))
    joined = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    regular = stems.select("term", "word", F.explode(F.concat(added(F.col("s"), VERB), F.transform("s", lambda s: joined("ge", s, "t")), F.transform("s", lambda s: joined("ge", s, "et")))).alias("token"))

    cut = words.select("term", word.alias("whole"), F.explode(F.array(*map(F.lit, PARTICLES))).alias("p")).where("startswith(whole, p)").select("term", "whole", "p", F.expr("substring(whole, length(p) + 1)").alias("word"))
    bare = lambda infix: F.when(F.col("word").startswith(infix), F.expr("substring(word, 3)")).otherwise("")
    cut = cut.withColumns({"plain": without(word, VERB, MIN_SEPARABLE), "ge": bare("ge"), "zu": bare("zu")})
    ends = lambda c, endings: F.array_compact(F.array(*(F.when(F.col(c).endswith(x) & (F.length(c) >= MIN_SEPARABLE + len(x)), F.left(F.col(c), F.length(c) - len(x))) for x in endings)))
    cut = cut.select("term", "whole", "p", F.explode(F.array_distinct(F.concat("plain", ends("ge", ("t", "et", "en")), ends("zu", ("n", "en"))))).alias("s"))
    forms = [F.concat("p", "s", F.lit(x)) for x in VERB] + [F.concat("p", F.lit("ge"), "s", F.lit(x)) for x in ("t", "et", "en")] + [F.concat("p", F.lit("zu"), "s", F.lit(x)) for x in ("n", "en")]
    separable = cut.select("term", F.col("whole").alias("word"), F.explode(F.array(*forms)).alias("token"))

    less = lambda n: F.expr(f"left(word, length(word) - {n})")
    bases = [word, F.when(word.rlike("(?:ied|ies)$"), F.concat(less(3), F.lit("y")))]
    for x in ("ed", "ing"):
        bases += [F.when(word.endswith(x), b) for b in (less(len(x)), F.concat(less(len(x)), F.lit("e")))]
        bases.append(F.when(word.rlike(rf"([^aeiou])\1{x}$"), less(len(x) + 1)))
    based = words.select("term", "word", F.explode(F.array_distinct(F.array_compact(F.array(*bases)))).alias("b")).where(F.length("b") >= MIN_ENGLISH)
    b, short, mark = F.col("b"), F.expr("left(b, length(b) - 1)"), F.expr("right(b, 1)")
    one_vowel = b.rlike(r"(?:^|[^aeiou])[aeiou][^aeiouwxy]$")
    english = [b, joined(b, "ed"), joined(b, "ing"), F.when(b.endswith("e"), joined(b, "d")), F.when(b.endswith("e"), joined(short, "ing"))]
    english += [F.when(b.rlike("[^aeiou]y$"), joined(short, x)) for x in ("ied", "ies")] + [F.when(one_vowel, joined(b, mark, x)) for x in ("ed", "ing")]
    forms_of = based.select("term", "word", F.explode(F.array_compact(F.array(*english))).alias("token"))
    return regular.unionByName(separable).unionByName(forms_of).where("token <> word").select("term", "token").distinct()


def hyphen_groups(parts: Column) -> Column:
    """The parts of a hyphenated word; one letter stays with the part after it, the last with the one before."""
    kept = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")), lambda a, x: F.struct(
        F.when(F.length(F.concat(a["open"], x)) < 2, a["done"]).otherwise(F.array_append(a["done"], F.concat(a["open"], x))).alias("done"),
        F.when(F.length(F.concat(a["open"], x)) < 2, F.concat(x, F.lit("-"))).otherwise(F.lit("")).alias("open")))
    rows = lambda a: F.when(a["open"] == "", a["done"]).when(F.size(a["done"]) == 0, F.array(F.rtrim(a["open"], F.lit("-")))).otherwise(
        F.array_append(F.slice(a["done"], 1, F.size(a["done"]) - 1), F.concat(F.element_at(a["done"], -1), F.lit("-"), F.rtrim(a["open"], F.lit("-")))))
    return rows(kept)


def hyphen_keys(vocabulary: DataFrame) -> DataFrame:
    """token, key: the stems of the parts of hyphenated tokens; a part of one letter counts only with its neighbour."""
    parts = F.filter(F.split(F.replace("token", F.lit("_"), F.lit("-")), "-"), lambda x: x != "")
    rows = vocabulary.where(F.col("token").rlike("[-_]")).select("token", parts.alias("parts"))
    single = F.filter("parts", lambda x: (F.length(x) >= 2) & ~x.isin(FUNCTION_WORDS))
    grouped = F.filter(hyphen_groups(F.col("parts")), lambda x: x.contains("-"))
    keyed = rows.select("token", F.explode(F.concat(single, grouped)).alias("part"))
    return keyed.select("token", stem(fold_key(F.col("part"))).alias("key")).distinct()


def scan_variants(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token, rule, weight: tokens that only the scan takes for a word, by the first rule that finds them.

    hyphen_part: a part of a hyphenated token; ending: the word with another ending; verb_ending: another form of a
    verb; footnote_mark: the word with one or two digits glued to it. The variants of the words asked are listed and
    meet the vocabulary by equality, so no word meets the whole vocabulary. Function words, null and the word itself
    have no variants. ``terms``: term. ``vocabulary``: token.
    """
    named = terms.select("term").distinct().where(F.col("term").isNotNull() & ~F.col("term").isin(FUNCTION_WORDS))
    words = named.where(F.col("term").rlike(LETTERS)).withColumn("word", fold_key(F.col("term")))
    keyed = named.withColumn("key", stem(fold_key(F.col("term"))))
    folded = vocabulary.select("token", fold_key(F.col("token")).alias("spelled")).where(~F.col("token").isin(FUNCTION_WORDS))
    footnotes = vocabulary.where(F.col("token").rlike(r"^\p{L}{4,}[0-9]{1,2}$")).select("token", stem(fold_key(F.regexp_replace("token", "[0-9]+$", ""))).alias("key"))
    by_spelling = lambda variants: variants.withColumnRenamed("token", "spelled").join(folded, "spelled").select("term", "token")
    found = (("hyphen_part", keyed.join(hyphen_keys(vocabulary), "key").select("term", "token")), ("ending", by_spelling(ending_variants(words))), ("verb_ending", by_spelling(verb_variants(words))), ("footnote_mark", keyed.join(footnotes, "key").select("term", "token")))
    rows = None
    for i, (rule, df) in enumerate(found):
        part = df.select("term", "token", F.struct(F.lit(i).alias("i"), F.lit(rule).alias("rule")).alias("r"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.where("term <> token").groupBy("term", "token").agg(F.min("r").alias("r"))
    return best.select("term", "token", "r.rule", F.lit(WEIGHT).alias("weight"))


#: A particle that ends a clause: before a mark, a conjunction or the end, after closing quotes or brackets.
CLAUSE_END = r"(?<![\p{L}\p{N}_-])(?:" + "|".join(sorted(PARTICLES, key=lambda p: (-len(p), p))) + r")(?=[\"'»«)\]]*(?:\s*(?:[.,;:!?]|$)|\s+(?:und|oder|aber|sondern|denn|bzw|sowie)(?![\p{L}\p{N}_])))"
#: Ends of a sentence: a mark, or a full stop after a word of two letters that is no number.
SENTENCE_END = r"[!?;:]|(?<=[^\s.0-9][^\s.0-9])\.(?=\s|$)"


def split_verbs(found: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """pid, path, token: +verb+particle for each separable verb that a clause of a passage splits ("lehnt ... ab").

    The particle ends a clause; the verb is any word of the same sentence before it, at most ``look_back`` characters
    away, that may be finite (three letters or more, with e, n or t at the end) and is no function word. All happens
    inside the passage's row; repeats of a pair in a passage are one row.
    """
    text = normalize(F.col("text"))
    sentences = found.select("pid", "path", F.explode(F.split(F.regexp_replace(text, SENTENCE_END, "$0\n"), "\n")).alias("s"))
    ends = F.regexp_extract_all("s", F.lit(CLAUSE_END), F.lit(0))
    rows = sentences.where(F.col("s").rlike(CLAUSE_END)).select("pid", "path", ends.alias("ends"), F.split("s", CLAUSE_END).alias("between"))
    ahead = lambda i: F.concat(F.array_join(F.zip_with(F.slice("between", 1, i), F.slice("ends", 1, i), lambda a, b: F.concat(a, b)), ""), F.get("between", i))
    pairs = rows.select("pid", "path", F.inline(F.transform("ends", lambda p, i: F.struct(p.alias("particle"), F.right(ahead(i), F.lit(look_back)).alias("ahead")))))
    verbs = F.array_except(F.regexp_extract_all("ahead", F.lit(r"(?<!\p{L})\p{L}{2,}[ent](?!\p{L})"), F.lit(0)), F.array(*map(F.lit, FUNCTION_WORDS)))
    return pairs.select("pid", "path", F.explode(F.transform(verbs, lambda v: F.concat(F.lit("+"), v, F.lit("+"), "particle"))).alias("token")).distinct()


def split_forms(terms: DataFrame) -> DataFrame:
    """term, token: +verb+particle for the forms of a separable verb ("ablehnen": +lehnt+ab), to meet ``split_verbs`` by equality."""
    words = terms.select("term").distinct().where(F.col("term").rlike(LETTERS)).withColumn("word", fold_key(F.col("term")))
    forms = words.select("term", F.col("word").alias("token")).unionByName(verb_variants(words))
    cut = forms.select("term", "token", F.explode(F.array(*map(F.lit, PARTICLES))).alias("p")).where("startswith(token, p) AND length(token) >= length(p) + 3")
    return cut.select("term", F.concat(F.lit("+"), F.expr("substring(token, length(p) + 1)"), F.lit("+"), "p").alias("token")).distinct()
