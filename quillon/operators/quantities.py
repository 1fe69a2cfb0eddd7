"""Numbers with units, in one spelling, and the words of a question they may stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.repair import bound
from quillon.functions.text import fold_key, normalize, stem

#: Unit as written -> (canonical unit, power of ten to it).
UNITS = {
    "wh": ("kwh", -3), "kwh": ("kwh", 0), "mwh": ("kwh", 3), "gwh": ("kwh", 6), "twh": ("kwh", 9), "wattstunde": ("kwh", -3), "wattstunden": ("kwh", -3), "kilowattstunde": ("kwh", 0), "kilowattstunden": ("kwh", 0),
    "megawattstunde": ("kwh", 3), "megawattstunden": ("kwh", 3), "gigawattstunde": ("kwh", 6), "gigawattstunden": ("kwh", 6), "terawattstunde": ("kwh", 9), "terawattstunden": ("kwh", 9),
    "w": ("kw", -3), "watt": ("kw", -3), "kw": ("kw", 0), "kilowatt": ("kw", 0), "mw": ("kw", 3), "megawatt": ("kw", 3), "gw": ("kw", 6), "gigawatt": ("kw", 6),
    "ct": ("eur", -2), "cent": ("eur", -2), "eur": ("eur", 0), "euro": ("eur", 0), "€": ("eur", 0), "%": ("prozent", 0), "prozent": ("prozent", 0), "percent": ("prozent", 0),
}
#: Number words without marks on letters.
NUMBER_WORDS = {
    "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "funf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "elf": 11, "zwolf": 12, "dreizehn": 13, "vierzehn": 14, "funfzehn": 15, "sechzehn": 16,
    "siebzehn": 17, "achtzehn": 18, "neunzehn": 19, "zwanzig": 20, "dreissig": 30, "vierzig": 40, "funfzig": 50, "sechzig": 60, "siebzig": 70, "achtzig": 80, "neunzig": 90,
}
#: What a number may count, and its forms.
COUNTED = {
    "tag": "tag tage tagen tages", "werktag": "werktag werktage werktagen werktages", "kalendertag": "kalendertag kalendertage kalendertagen kalendertages", "woche": "woche wochen", "monat": "monat monate monaten monats",
    "quartal": "quartal quartale quartalen quartals", "jahr": "jahr jahre jahren jahres", "stunde": "stunde stunden", "minute": "minute minuten", "person": "person personen", "rate": "rate raten",
}
COUNT_UNITS = {form: unit for unit, forms in COUNTED.items() for form in forms.split()}
CANONICAL = {form: unit for form, (unit, _) in UNITS.items()} | COUNT_UNITS

_words = "|".join(NUMBER_WORDS)
_named = "|".join(x for x in CANONICAL if x.isalpha())
_glued = "|".join(x for x in UNITS if x.isalpha() and 2 <= len(x) <= 4)
_dash = "(?:,(?:--?|–))?"
#: Digits in groups of three, or digits with a decimal sign.
GROUPED = r"[0-9]{1,3}(?:[. '’][0-9]{3})+(?:,[0-9]{1,6})?"
DIGITS = rf"(?:{GROUPED}|[0-9]+(?:[.,][0-9]{{1,6}})?)"
NUMBER = rf"(?:{DIGITS}|(?:{_words})\b)"
_one = rf"(?:{DIGITS}{_dash}(?:[ \t]*(?:[%€]|(?:{_glued})\b-?)|[ \t]+(?:{_named})\b-?)|(?:{_words})[ \t]+(?:[%€]|(?:{_named})\b-?))"
_scale = "hundert|tausend|tsd|mio|mrd|million|millionen|milliarde|milliarden"
_money = rf"(?:€|eur)[ \t]*{DIGITS}{_dash}(?:[%€_\p{{L}}-]|[ \t]*(?:{_scale})\b)?"
_cited = r"abs\.|absatz|nr\.|nummer|art\.|artikel|ziff\.|ziffer|satz"
#: What stands before a number that is no quantity of its own: a citation, a sign, another number, the first one of a range.
_lead = rf"(?:(?:§|{_cited}|minus|plus|komma|[−+±-])[ \t]*|{NUMBER}(?:[ \t]*[–—][ \t]*|[ \t]+bis[ \t]+|[ \t]+)|zwischen[ \t]+{NUMBER}[ \t]+und[ \t]+)"
#: A number with its unit, with what stands before it and with the second number of its range.
SPAN = rf"(?:^|[^\p{{L}}\p{{N}}_])(?:zwischen[ \t]+{_one}[ \t]+und[ \t]+{_one}|{_money}|{_lead}??{_one}(?:[ \t]+bis[ \t]+{_one})?)"
_free = r"[^\p{L}\p{N}_.,'’/:⁄−+±=–—-]?"
#: A span that is a quantity: number and unit; or an amount of money behind its unit.
ACCEPTED = rf"^(?:\n?-[ \t]+|{_free})(?:zwischen[ \t]+)?({NUMBER}){_dash}[ \t]*([%€]|{_named})(?:[ \t]|$)"
MONEY = rf"^{_free}(?:€|eur)[ \t]*({DIGITS}){_dash}$"
#: What a line with a quantity holds, if it holds no digit, behind a line end.
_worded = rf"[^\p{{L}}\p{{N}}_](?i:{_words})"


def extract_quantities(pages: DataFrame) -> DataFrame:
    """path, value, unit, token: numbers with a known unit, as exact decimals of the canonical unit; the token is the same in every notation.

    Number words and digits that a number word names may count days, months and the like; money may stand behind its
    unit. Citations, signed numbers, scaled amounts and the second number of a range are no quantities.
    """
    spans = pages.select("path", F.explode_outer(bound(normalize(F.col("body")), spans_of)).alias("q")).select("path", quantity_of(F.col("q")).alias("f"))
    return spans.where("f IS NOT NULL").select("path", "f.value", "f.unit", "f.token")


def numbered_lines(text: Column) -> Column:
    """The lines of a text that hold a digit or a number word, each behind a line end."""
    worded = lambda x: F.concat(F.lit("\n"), x).rlike(_worded)
    told = lambda words: F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[0-9]") | (words & worded(x)))
    return bound(worded(text), lambda words: F.when(words | text.rlike("[0-9]"), F.concat(F.lit("\n"), F.array_join(told(words), "\n"))).otherwise(F.lit("")))


def spans_of(text: Column) -> Column:
    """The spans of a text that may be quantities. A span lies in one line, with the end of the one before, and holds a number."""
    return bound(numbered_lines(text), lambda x: F.regexp_extract_all(normalize(x), F.lit(SPAN), F.lit(0)))


def quantity_of(q: Column) -> Column:
    """{value, unit, token} of a span, or null."""
    named = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))

    def told(n: Column, u: Column) -> Column:
        plain = F.when(n.rlike(f"^{GROUPED}$"), F.regexp_replace(n, "[. '’]", "")).otherwise(n)
        number = F.coalesce(named(NUMBER_WORDS)[n].cast("decimal(21,6)"), F.replace(plain, F.lit(","), F.lit(".")).try_cast("decimal(21,6)"))
        power = F.coalesce(named({k: p for k, (_, p) in UNITS.items()})[u], F.lit(0))
        value = F.when(power < 0, number * F.pow(F.lit(10), power).cast("decimal(4,3)")).otherwise(number * F.pow(F.lit(10), power).cast("decimal(10,0)")).cast("decimal(38,9)")
        return bound(value, lambda v: F.when(v.isNotNull() & (~u.isin(list(COUNT_UNITS)) | v.isin(list(NUMBER_WORDS.values()))), shown(v, named(CANONICAL)[u])))

    shown = lambda v, unit: F.struct(v.cast("double").alias("value"), unit.alias("unit"), F.concat(F.lit("="), F.regexp_replace(v.cast("string"), r"\.?0+$", ""), unit).alias("token"))
    money = F.regexp_extract(q, MONEY, 1)
    read = F.struct(F.when(money != "", money).otherwise(F.regexp_extract(q, ACCEPTED, 1)).alias("n"), F.when(money != "", "eur").otherwise(F.regexp_extract(q, ACCEPTED, 2)).alias("u"))
    return bound(read, lambda x: F.when(x["n"] != "", told(x["n"], x["u"])))


def quantity_tokens(text: Column) -> Column:
    """The tokens of the quantities of a text that is spelled by ``number_spelling``, in order."""
    return F.transform(F.filter(F.transform(bound(text, spans_of), quantity_of), lambda f: f.isNotNull()), lambda f: f["token"])


def concept_trigger(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """fid, concept_id, start: concepts one of whose terms stands in a question as a run of neighbouring words.

    ``terms``: fid, ord, term; ``concepts``: concept_id, no (of the term), ord, word. Words agree by spelling, folded
    spelling or stem; a run is found by joining words and counting equal offsets. The first term that fires counts.
    """
    width = concepts.groupBy("concept_id", "no").agg(F.count("*").alias("width"))
    keys = lambda c: F.array_distinct(F.array(c, fold_key(c), stem(c)))
    asked = terms.select("fid", F.col("ord").alias("at"), F.explode(keys(F.col("term"))).alias("key"))
    named = concepts.select("concept_id", "no", "ord", F.explode(keys(F.col("word"))).alias("key"))
    met = asked.join(named, "key").select("fid", "concept_id", "no", "ord", (F.col("at") - F.col("ord")).alias("start")).distinct()
    runs = met.groupBy("fid", "concept_id", "no", "start").agg(F.count("*").alias("n")).join(F.broadcast(width), ["concept_id", "no"]).where("n = width")
    return runs.groupBy("fid", "concept_id").agg(F.min(F.struct("no", "start")).alias("b")).select("fid", "concept_id", F.col("b.start").alias("start"))


def quantity_bridge(asked: DataFrame, members: DataFrame, held: DataFrame, amounts: DataFrame) -> DataFrame:
    """fid, term, token, rule, weight: a quantity token counts for a word if some page holds it and none of the word's other members.

    ``asked``: fid, term, token (the quantity the word may stand for); ``members``: fid, term, token; ``held``: path, token of words; ``amounts``: path, token of quantities.
    """
    holders = asked.join(amounts.select("path", "token").distinct(), "token").select("fid", "term", "token", "path")
    known = members.join(held.select("path", "token").distinct(), "token").select("fid", "term", "path").distinct()
    found = holders.join(known, ["fid", "term", "path"], "left_anti").select("fid", "term", "token").distinct()
    return found.withColumns({"rule": F.lit("quantity"), "weight": F.lit(0.9)})
