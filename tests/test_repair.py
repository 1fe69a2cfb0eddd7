"""Token repair: each artefact by hand, and random texts against a version in Python."""

import html
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import repair as R
from quillon.operators import fields as D

CASES = [
    ("Ab 2.500 kWh", "ab 2500 kwh"), ("Ab 2 500 kWh", "ab 2500 kwh"), ("Ab 2 500 kWh", "ab 2500 kwh"), ("Ab 2 500 kWh", "ab 2500 kwh"), ("Ab 2 500 kWh", "ab 2500 kwh"), ("Ab 2'500 kWh", "ab 2500 kwh"),
    ("Ab 2500kWh", "ab 2500 kwh"), ("2.500,50 Euro", "2500 50 euro"), ("2,50 Euro", "2 50 euro"), ("31.12.2025", "31 12 2025"), ("1.234.567", "1234567"), ("§ 14a EnWG", "14a enwg"), ("§ 312g BGB", "312g bgb"),
    ("OBIS 1.8.1", "obis 1 8 1"), ("2 500 3 500", "2500 3500"), ("2 500 3000", "2500 3000"),
    ("CO~2~-Preis", "co2-preis"), ("CO<sub>2</sub>-Preis", "co2-preis"), ("CO₂-Preis", "co2-preis"), ("je m^2^ Fläche", "je m 2 flache m2"), ("je m<sup>2</sup>", "je m 2 m2"), ("~~weg~~", "weg"),
    ("Die **Kündigungs**frist", "die kundigungsfrist"), ("Vor**teil**", "vorteil"), ("**Hinweis** hier", "hinweis hier"), ("Kund*innen und Kolleg*innen", "kund innen und kolleg innen"),
    ("K&uuml;ndigungs&shy;frist &#252;ber Granit&nbsp;Nord &#xfc;", "kundigungsfrist uber granit nord u"), ("A&keinname;B", "a keinname b"), ("&#128; &#0;x", "x"),
    ("Kündigungs-\nfrist", "kundigungsfrist"), ("Netz-\n  Entgelt", "netz-entgelt"), ("Netz-\nund Messentgelt", "netz und messentgelt"), ("Netz-\nundine", "netzundine"), ("Seite 4-\n5", "seite 4 5"),
    ("Straße ﬁnden ½ Ⅳ", "strasse finden 1 2 iv"), ("été Ångström Žižek", "ete angstrom zizek"), ("Zähler​stand ab‑bau", "zahlerstand ab-bau"), (None, ""), ("", ""),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: " ".join(r.w) for r in rows.select("i", R.repaired_tokens(F.col("t")).alias("w")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(CASES)] == CASES


def test_scan_keeps_groups_apart(spark):
    row = spark.createDataFrame([("100 200 und 1.500",)], "t string").select(R.scan_tokens(F.col("t")).alias("w")).first()
    assert set(row.w) == {"100200", "100", "200", "und", "1500"}


def test_counts(spark):
    text = "K&uuml;n­di-\ngung H~2~O m<sup>2</sup> ab**c**d 2.500"
    got = spark.createDataFrame([(text,)], "t string").select(*(c.alias(k) for k, c in R.repair_counts(F.col("t")).items())).first().asDict()
    assert got == {"reference": 1, "hidden": 1, "subscript": 1, "superscript": 1, "emphasis": 1, "line-end": 1, "digit-groups": 1}


def by_hand(text: str) -> list[str]:
    """Character by character for numbers; references and folding by the standard library."""
    text = "".join(c for c in html.unescape(text) if c not in R.HIDDEN)
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    words, out, i = re.split("([0-9]+)", text), [], 0
    # words[odd] are runs of digits; a run of up to three digits takes on all full groups of three behind it
    while i < len(words):
        out.append(words[i])
        before = "".join(words[:i])[-1:]
        if i % 2 and len(words[i]) <= 3 and not (before.isalnum() or before in "_.,'’" and before):
            j, run = i, words[i]
            while j + 2 < len(words) and re.fullmatch("[. '’]", words[j + 1]) and len(words[j + 2]) == 3:
                j, run = j + 2, run + words[j + 2]
            out[-1], i = run, j
        i += 1
    return re.findall(r"[^\W_]+(?:[-_][^\W_]+)*", "".join(out))


@pytest.fixture(scope="module")
def told(spark):
    def ask(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r.w for r in rows.select("i", R.repaired_tokens(F.col("t")).alias("w")).orderBy("i").collect()]

    return ask


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["12", "3", "500", "1000", ".", " ", "'", ",", "x", "Ä", "&auml;", "&#228;", "­", "-", "_", "ß", "ﬁ", "é", "́", " und "]), max_size=14).map("".join), min_size=40, max_size=60))
def test_random_texts(told, texts):
    assert told(texts) == [by_hand(t) for t in texts]


def test_only_postings_of_asked_tokens_are_counted(spark):
    fields = spark.createDataFrame([("p", "body", ["a", "b", "a"]), ("q", "title", ["b"])], "path string, field string, tokens array<string>")
    amounts = spark.createDataFrame([("p", "=1kwh"), ("p", "=2kwh"), ("p", "=2kwh")], "path string, token string")
    asked = spark.createDataFrame([("a",), ("=2kwh",)], "token string")
    got = {tuple(r) for r in D.counted_fields(fields, amounts, asked).collect()}
    assert got == {("p", "body", "a", 2, 3), ("p", "quantities", "=2kwh", 2, 3)}
    assert D.counted_fields(fields, amounts).count() == 5


def test_plain_letters_of_references_are_found_first(spark):
    row = spark.range(1).select(R._reference(F.lit("&uuml;")).alias("u"), R._reference(F.lit("&hellip;")).alias("h"), R._reference(F.lit("&#150;")).alias("n"), R._reference(F.lit("&nothing;")).alias("x"), R._reference(F.lit("&NotEqualTilde;")).alias("two"))
    assert tuple(row.first()) == ("ü", "…", "–", "&nothing;", "≂̸")
    assert list(R.named_references()).index("&uuml;") < 200


def test_postings_of_a_page_are_counted_where_it_lies(spark):
    rows = [("a", "Ab 5", ["x"], None, "## Kopf\n5 kWh und 5 kWh je m^2^\nzwei\nzwei Monate"), ("b", "H<sub", None, "Netz-", "ende 2~,~ 3 kWh"), ("c", "CO<su~b~", ["&uuml;-"], None, "kw 1 000 kWh"), ("d", None, None, None, None)]
    pages = spark.createDataFrame(rows, "path string, title string, aliases array<string>, description string, body string")
    made = D.field_postings(pages)
    want = D.counted_fields(D.document_fields(pages), D.page_quantities(pages))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect())) and made.where("token = '=5kwh' AND tf = 2 AND field_len = 3").count() == 1
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
