"""Which corpus tokens a question word stands for: same word in another form, compounds, typing errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.settled import settled
from quillon.functions.text import fold_key, stem, verb_keys
from quillon.operators.search import FUNCTION_WORDS

#: Weights of the rules by which a token counts for a word.
RULE_WEIGHTS = {"exact": 1.0, "fold": 0.9, "stem": 0.6, "verb": 0.5, "irregular": 0.45, "derived": 0.45, "compound_link": 0.45, "compound_head": 0.45, "compound_modifier": 0.35, "query_part": 0.35, "short_part": 0.35, "typo": 0.3}
MIN_TYPO = 8
MIN_PART = 4

#: Forms of one verb or degree, without marks on letters; our own list, to be replaced by a table of the caller's.
IRREGULAR = {
    "be": "am is are was were been being", "begin": "began begun", "break": "broke broken", "bring": "brought", "build": "built", "buy": "bought", "catch": "caught", "choose": "chose chosen", "come": "came", "cost": "costing",
    "deal": "dealt", "do": "did done does", "draw": "drew drawn", "drive": "drove driven", "eat": "ate eaten", "fall": "fell fallen", "feel": "felt", "find": "found", "fly": "flew flown", "forget": "forgot forgotten",
    "freeze": "froze frozen", "get": "got gotten", "give": "gave given", "go": "goes went gone", "grow": "grew grown", "have": "has had having", "hear": "heard", "hold": "held", "keep": "kept", "know": "knew known",
    "lead": "led", "leave": "left", "lend": "lent", "lose": "lost", "make": "made", "mean": "meant", "meet": "met", "pay": "paid", "rise": "rose risen", "run": "ran", "say": "said", "see": "saw seen", "sell": "sold",
    "send": "sent", "show": "showed shown", "speak": "spoke spoken", "spend": "spent", "stand": "stood", "take": "took taken", "teach": "taught", "tell": "told", "think": "thought", "understand": "understood", "win": "won", "write": "wrote written",
    "good": "better best", "bad": "worse worst", "far": "further furthest farther farthest", "little": "less least", "man": "men", "woman": "women", "child": "children", "foot": "feet", "person": "people", "tooth": "teeth", "mouse": "mice",
    "sein": "bin bist ist sind war waren gewesen", "haben": "hat hatte hatten gehabt", "werden": "wird wurde wurden geworden", "gehen": "ging gingen gegangen", "geben": "gibt gab gaben gegeben", "nehmen": "nimmt nahm nahmen genommen",
    "bleiben": "blieb geblieben", "bringen": "brachte gebracht", "denken": "dachte gedacht", "finden": "fand fanden gefunden", "gelten": "gilt galt gegolten", "halten": "halt hielt gehalten", "kommen": "kam kamen gekommen", "lassen": "lasst liess gelassen",
    "laufen": "lauft lief gelaufen", "lesen": "liest las gelesen", "liegen": "lag lagen gelegen", "messen": "misst mass gemessen", "schliessen": "schloss geschlossen", "schreiben": "schrieb geschrieben", "sehen": "sieht sah sahen gesehen", "sprechen": "spricht sprach gesprochen",
    "stehen": "stand standen gestanden", "steigen": "stieg gestiegen", "tragen": "tragt trug getragen", "treffen": "trifft traf getroffen", "verlieren": "verlor verloren", "ziehen": "zog zogen gezogen", "gut": "besser beste", "hoch": "hoher hochste", "nah": "naher nachste", "viel": "mehr meiste",
}
#: Nouns made from a verb of that list.
NOUNS_OF = {
    "begin": "beginning", "build": "building", "buy": "buyer", "choose": "choice", "cost": "costs", "deal": "dealer", "drive": "driver", "fly": "flight", "give": "gift", "grow": "growth", "know": "knowledge", "lead": "leader", "lose": "loss",
    "mean": "meaning", "meet": "meeting", "pay": "payment", "sell": "sale seller", "speak": "speech speaker", "teach": "teacher", "think": "thought", "win": "winner", "write": "writing writer",
    "finden": "fund", "geben": "gabe", "gehen": "gang", "halten": "halt haltung", "laufen": "lauf", "liegen": "lage", "messen": "messung mass", "nehmen": "nahme", "schliessen": "schluss", "schreiben": "schrift schreiber", "sehen": "sicht", "sprechen": "sprache",
    "stehen": "stand", "steigen": "steigung anstieg", "tragen": "trager", "treffen": "treffer", "verlieren": "verlust", "ziehen": "zug",
}
#: Letters that may join the parts of a compound.
LINKS = ("", "s", "es", "n", "en", "e")


def weight_of(rule: str) -> Column:
    return F.lit(RULE_WEIGHTS[rule])


def family_join(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token, rule, weight: tokens with the term's spelling, folded spelling or stem, and forms of the same verb; the best rule of a token wins.

    Function words match only themselves. A form in -t counts for a term that may be a verb (in -n, or a bare stem).
    Keys are computed once per distinct token, and joined on equality.
    """
    keyed = lambda rule, kind, key: F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), key.alias("key"))
    each = lambda rule, kind, keys: F.coalesce(F.transform(keys, lambda k: keyed(rule, kind, k)), F.array().cast("array<struct<rule:string,kind:string,key:string>>"))
    term, token = F.col("term"), F.col("token")
    may_be_verb = stem(term).rlike(r"^\p{L}+$") & (term.endswith("n") | (term == stem(term)))
    verbs = F.concat(each("verb", "verb", F.when(may_be_verb, F.array(stem(term)))), each("verb", "stem", verb_keys(stem(term))), each("verb", "verb", verb_keys(stem(term))))
    asked = F.concat(F.array(keyed("exact", "word", term), keyed("fold", "fold", fold_key(term)), keyed("stem", "stem", stem(term))), verbs)
    given = F.concat(F.array(keyed("", "word", token), keyed("", "fold", fold_key(token)), keyed("", "stem", stem(token))), each("", "verb", verb_keys(stem(token))))
    open_only = lambda word, keys: F.when(word.isin(FUNCTION_WORDS), F.slice(keys, 1, 1)).otherwise(keys)
    left = terms.select("term").distinct().select("term", F.inline(open_only(term, asked)))
    right = vocabulary.select("token", F.inline(open_only(token, given))).drop("rule")
    weight = F.create_map(*(F.lit(x) for k, v in RULE_WEIGHTS.items() for x in (k, v)))[F.col("rule")]
    best = left.join(right, ["kind", "key"]).withColumn("weight", weight).groupBy("term", "token").agg(F.max(F.struct("weight", "rule")).alias("b"))
    return best.select("term", "token", "b.rule", "b.weight")


def by_form(terms: DataFrame, vocabulary: DataFrame, crossing: bool) -> DataFrame:
    """term, token of one key of the tables of forms, of which the one is a noun and the other not (``crossing``), or both alike."""
    listed = [(x, k, False) for k, v in IRREGULAR.items() for x in (k, *v.split())] + [(x, k, True) for k, v in NOUNS_OF.items() for x in v.split()]
    rows = F.array(*(F.struct(F.lit(x).alias("form"), F.lit(k).alias("key"), F.lit(n).alias("noun")) for x, k, n in listed))
    forms = terms.sparkSession.range(1).select(F.inline(rows))  # a few hundred rows, fixed
    keyed = terms.select("term").distinct().join(F.broadcast(forms.withColumnRenamed("form", "term")), "term")
    other = F.broadcast(forms.select(F.col("form").alias("token"), "key", F.col("noun").alias("noun_too")))
    met = keyed.join(other, "key").where(F.col("noun") != F.col("noun_too") if crossing else F.col("noun") == F.col("noun_too"))
    return met.join(vocabulary.select("token"), "token").where("term <> token").select("term", "token").distinct()


def irregular_keys() -> dict[str, list[str]]:
    """Form -> keys of the irregular words that it is a form or a noun of."""
    found: dict[str, set[str]] = {}
    for table, with_key in ((IRREGULAR, True), (NOUNS_OF, False)):
        for key, forms in table.items():
            for form in (*([key] if with_key else []), *forms.split()):
                found.setdefault(form, set()).add(key)
    return {form: sorted(keys) for form, keys in sorted(found.items())}


def irregular_join(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token, rule, weight: other forms of the same irregular word. The table of forms is fixed and small, so it is broadcast."""
    return by_form(terms, vocabulary, False).select("term", "token", F.lit("irregular").alias("rule"), weight_of("irregular").alias("weight"))


def derived_join(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token, rule, weight: the noun of a verb with forms of the verb, or the reverse, by the tables of forms."""
    return by_form(terms, vocabulary, True).select("term", "token", F.lit("derived").alias("rule"), weight_of("derived").alias("weight"))


def deletions(word: Column) -> Column:
    """The word and what is left of it without one letter."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.array_append(cut, word))


def typo_join(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token, rule, weight: tokens one edit or one swap of neighbours away from a word of at least MIN_TYPO letters.

    Both sides are joined on what is left after one deletion, then compared; no word meets the whole vocabulary.
    """
    left = terms.select("term").distinct().where(F.length("term") >= MIN_TYPO).select("term", F.explode(deletions(F.col("term"))).alias("key"))
    right = vocabulary.where(F.length("token") >= MIN_TYPO - 1).select("token", F.explode(deletions(F.col("token"))).alias("key"))
    met = left.join(right, "key").where("term <> token").select("term", "token").distinct()
    at = F.sequence(F.lit(1), F.length("term") - 1)
    swapped = F.exists(at, lambda i: F.concat(F.substring(F.col("term"), F.lit(1), i - 1), F.substring(F.col("term"), i + 1, F.lit(1)), F.substring(F.col("term"), i, F.lit(1)), F.substring(F.col("term"), i + 2, F.length("term"))) == F.col("token"))
    near = (F.levenshtein("term", "token") <= 1) | ((F.length("term") == F.length("token")) & swapped)
    return met.where(near).select("term", "token", F.lit("typo").alias("rule"), weight_of("typo").alias("weight"))


def part_lengths(words: DataFrame) -> DataFrame:
    """lengths: the distinct lengths of ``words`` (part), in one row; as many as lengths occur."""
    return F.broadcast(words.agg(F.array_sort(F.collect_set(F.length("part"))).alias("lengths")))


def pieces(wholes: DataFrame, words: DataFrame) -> DataFrame:
    """whole, start, stop, part: the runs of letters of each word whose length one of ``words`` has."""
    runs = wholes.crossJoin(part_lengths(words)).select("whole", F.explode("lengths").alias("n")).where("n <= length(whole)")
    runs = runs.withColumn("start", F.explode(F.expr("sequence(0, length(whole) - n)")))
    return runs.select("whole", "start", (F.col("start") + F.col("n")).alias("stop"), F.expr("substring(whole, start + 1, n)").alias("part"))


def holding(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """term, whole, start, stop: where a word holds a term's part, but for the whole of it.

    Words and parts meet on the part's first letters, so a word has a row for each of its letters and not for each of its runs.
    """
    seeds = parts.withColumn("seed", F.left("part", F.lit(MIN_PART)))
    grams = wholes.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("whole") - MIN_PART))).withColumn("seed", F.expr(f"substring(whole, start + 1, {MIN_PART})"))
    met = grams.join(seeds, "seed").where("substring(whole, start + 1, length(part)) = part AND length(part) < length(whole)")
    return met.select("term", "whole", "start", (F.col("start") + F.length("part")).alias("stop"))


def compound_join(terms: DataFrame, vocabulary: DataFrame, links: tuple[str, ...] = LINKS) -> DataFrame:
    """term, token, rule, weight: tokens that hold the term, without their endings, as last part (head) or as another part (modifier).

    All letters before and after the term must be words of the vocabulary, one or more, with or without linking elements.
    Letters of each distinct token meet the first letters of the terms by equality; only tokens that hold one are cut into
    runs of the lengths that words have, which meet the vocabulary by equality. What can be reached from either end is one fold over a word's parts.
    """
    letters = lambda c: F.col(c).rlike(r"^\p{L}+$") & ~F.col(c).isin(FUNCTION_WORDS)
    named = terms.where(letters("term")).select("term", stem(F.col("term")).alias("part")).distinct().where(F.length("part") >= MIN_PART)
    whole = vocabulary.where(letters("token")).select("token", stem(F.col("token")).alias("whole")).where(F.length("whole") >= 2 * MIN_PART)
    held = settled(holding(settled(named), whole.select("whole").distinct()))
    words = settled(words_of(vocabulary))
    parts = pieces(held.select("whole").distinct(), words).join(words, "part", "left_semi").groupBy("whole").agg(F.collect_list(F.struct("start", "stop")).alias("parts"))
    word = F.col("whole")
    after = lambda at: F.array_compact(F.array(*(F.when(F.substring(word, at + 1, F.lit(len(x))) == x, at + len(x)) for x in links)))
    before = lambda at: F.array_compact(F.array(*(F.when((at >= len(x)) & (F.substring(word, at - len(x) + 1, F.lit(len(x))) == x), at - len(x)) for x in links)))
    starts = F.aggregate(F.array_sort("parts"), F.array(F.lit(0)), lambda got, p: F.when(F.array_contains(got, p["start"]), F.array_union(got, after(p["stop"]))).otherwise(got))
    by_stop = F.reverse(F.array_sort(F.transform("parts", lambda p: F.struct(p["stop"].alias("stop"), p["start"].alias("start")))))
    stops = F.aggregate(by_stop, F.array(F.length(word)), lambda got, p: F.when(F.array_contains(got, p["stop"]), F.array_union(got, before(p["start"]))).otherwise(got))
    sound = held.join(parts.select("whole", starts.alias("starts"), stops.alias("stops")), "whole").where("array_contains(starts, start) AND array_contains(stops, stop)")
    place = F.when(F.col("stop") == F.length("whole"), "compound_head").otherwise("compound_modifier")
    found = sound.groupBy("term", "whole").agg(F.min(place).alias("rule")).join(whole, "whole").select("term", "token", "rule")
    return found.withColumn("weight", F.when(F.col("rule") == "compound_head", weight_of("compound_head")).otherwise(weight_of("compound_modifier")))


def words_of(vocabulary: DataFrame) -> DataFrame:
    """part: words that may be a part of a compound, as spelled and without their ending."""
    either = F.array_distinct(F.array("token", stem(F.col("token"))))
    words = vocabulary.where(F.col("token").rlike(r"^\p{L}+$") & ~F.col("token").isin(FUNCTION_WORDS)).select(F.explode(either).alias("part"))
    return words.where(F.length("part") >= MIN_PART).distinct()


def query_splits(terms: DataFrame, words: DataFrame) -> DataFrame:
    """term, key, ending, before, link, after: cuts of a term without its ending into two of ``words``, with every linking element that stands there."""
    named = terms.select("term").distinct().where(F.col("term").rlike(r"^\p{L}+$") & ~F.col("term").isin(FUNCTION_WORDS)).withColumn("key", stem(F.col("term")))
    named = named.where(F.length("key") >= 2 * MIN_PART).withColumn("ending", F.expr("substring(term, length(key) + 1)"))
    # only cuts behind as many letters as some word has
    cuts = named.crossJoin(part_lengths(words)).withColumn("at", F.explode("lengths")).where(F.col("at") <= F.length("key") - MIN_PART).drop("lengths").withColumn("link", F.explode(F.array(*map(F.lit, LINKS))))
    cuts = cuts.withColumns({"before": F.expr("substring(key, 1, at)"), "rest": F.expr("substring(key, at + 1)")}).where("startswith(rest, link)")
    cuts = cuts.withColumn("after", F.expr("substring(rest, length(link) + 1)")).where(F.length("after") >= MIN_PART).select("term", "key", "ending", "before", "link", "after")
    return cuts.join(words.withColumnRenamed("part", "before"), "before", "left_semi").join(words.withColumnRenamed("part", "after"), "after", "left_semi")


def link_variant_join(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token, rule, weight: tokens of the two parts of a term with another linking element, without ending or with the term's own.

    Both parts must be words of the vocabulary. Meant for terms that have no word form of their own.
    """
    split = query_splits(terms, settled(words_of(vocabulary)))
    other = split.withColumn("other", F.explode(F.array(*map(F.lit, LINKS)))).where("other <> link")
    variants = other.select("term", F.explode(F.array_distinct(F.array(F.concat("before", "other", "after"), F.concat("before", "other", "after", "ending")))).alias("token"))
    found = variants.join(vocabulary.select("token"), "token").where("term <> token").select("term", "token").distinct()
    return found.select("term", "token", F.lit("compound_link").alias("rule"), weight_of("compound_link").alias("weight"))


def query_head_join(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token, rule, weight: word forms of the longest head of a term whose head and rest are words of the vocabulary."""
    split = query_splits(terms, settled(words_of(vocabulary)))
    heads = settled(split.groupBy("term").agg(F.max_by("after", F.length("after")).alias("head")))
    found = heads.join(family_join(heads.select(F.col("head").alias("term")), vocabulary).withColumnRenamed("term", "head"), "head").where("term <> token")
    return found.select("term", "token", F.lit("query_part").alias("rule"), weight_of("query_part").alias("weight")).distinct()


def short_parts(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token, rule, weight: tokens with a term of two or three letters as first part, before a word, or as last part, after one of at least three letters.

    Prefixes and suffixes of the distinct tokens meet the terms, and what is left meets the vocabulary, by equality.
    """
    named = terms.select("term").distinct().where(F.col("term").rlike(r"^\p{L}{2,3}$") & ~F.col("term").isin(FUNCTION_WORDS))
    whole = vocabulary.where(F.col("token").rlike(r"^\p{L}{6,}$")).select("token", F.explode(F.array(F.lit(2), F.lit(3))).alias("n"))
    words = words_of(vocabulary)
    first = whole.select("token", F.expr("left(token, n)").alias("term"), F.expr("substring(token, n + 1)").alias("part")).join(named, "term").join(words, "part", "left_semi")
    before = vocabulary.where(F.col("token").rlike(r"^\p{L}{3,}$") & ~F.col("token").isin(FUNCTION_WORDS)).select(F.col("token").alias("part"))
    last = whole.select("token", F.expr("right(token, n)").alias("term"), F.expr("left(token, length(token) - n)").alias("part")).join(named, "term").join(before, "part", "left_semi")
    found = first.select("term", "token").unionByName(last.select("term", "token")).distinct()
    return found.select("term", "token", F.lit("short_part").alias("rule"), weight_of("short_part").alias("weight"))


def resolve_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, token, rule, weight by precedence: word forms; irregular and derived forms and compounds; linking elements
    for a word without word form; the head of a word with nothing else; a typing error for a word with nothing at all."""
    named, vocabulary = settled(terms.select("term").distinct()), settled(vocabulary.select("token"))
    terms = named
    stage = lambda df, i: df.select("term", "token", "rule", "weight", F.lit(i).alias("stage"))
    without = lambda df: named.join(df.select("term").distinct(), "term", "left_anti")
    family = settled(family_join(terms, vocabulary))
    sure = stage(family, 0)
    for i, found in enumerate((irregular_join(terms, vocabulary), derived_join(terms, vocabulary), compound_join(terms, vocabulary)), 1):
        sure = sure.unionByName(stage(found, i))
    sure = settled(sure)
    linked = stage(link_variant_join(without(family), vocabulary), 4)
    heads = stage(query_head_join(without(sure), vocabulary), 5)
    found = settled(sure.unionByName(linked).unionByName(heads))
    found = found.unionByName(stage(typo_join(without(found), vocabulary), 6))
    first = F.row_number().over(Window.partitionBy("term", "token").orderBy("stage"))
    return found.withColumn("n", first).where("n = 1").select("term", "token", "rule", "weight")
