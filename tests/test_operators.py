"""Rules of single operators on rows made by hand."""

import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from quillon.functions.text import stem, tokens
from quillon.operators import change, governance, lexicon, passages, quantities, search


def test_tokens_fold_marks_and_keep_hyphens(spark):
    row = spark.createDataFrame([("Größe der Wind-Kraft, été_2",)], ["t"]).select(tokens(F.col("t"))).first()[0]
    assert row == ["grosse", "der", "wind-kraft", "ete_2"]


def test_stem_takes_one_inflection_ending(spark):
    pairs = {"houses": "hous", "house": "hous", "gas": "gas", "zahlungen": "zahlung", "zahlung": "zahlung", "zahlern": "zahler", "zahler": "zahler", "batteries": "battery", "preise": "preis", "status": "status", "glass": "glass", "walking": "walking", "meters": "meter"}
    rows = spark.createDataFrame([(x,) for x in pairs], ["t"]).select("t", stem(F.col("t"))).collect()
    assert {r[0]: r[1] for r in rows} == pairs


def test_budget_is_a_prefix(spark):
    hits = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 5, 5, 1])], "qid long, ord long, cost long")
    assert tuple(search.budget_prefix(hits, 10).first()) == (1, 2, 2, 16)


def test_typo_takes_swaps_and_single_edits(spark):
    terms = spark.createDataFrame([("management",)], ["term"])
    vocabulary = spark.createDataFrame([("managemetn",), ("managment",), ("managements",), ("mangment",), ("management",)], ["token"])
    assert {r.token for r in lexicon.typo_join(terms, vocabulary).collect()} == {"managemetn", "managment", "managements"}


def test_compound_needs_both_parts(spark):
    terms = spark.createDataFrame([("preis",)], ["term"])
    vocabulary = spark.createDataFrame([("arbeit",), ("preis",), ("arbeitspreis",), ("unbekanntpreis",), ("preisarbeit",)], ["token"])
    assert {(r.token, r.rule) for r in lexicon.compound_join(terms, vocabulary).collect()} == {("arbeitspreis", "compound_head"), ("preisarbeit", "compound_modifier")}


def named(spark, column, *words):
    return spark.createDataFrame([(w,) for w in words], [column])


def test_linking_elements_and_heads(spark):
    vocabulary = named(spark, "token", "abschlag", "zahlung", "abschlagszahlung", "abschlagszahlungen", "kirchturm", "kirche", "turm", "tarif", "strom", "stromtarife")
    got = lambda f, *t: {(r.term, r.token) for r in f(named(spark, "term", *t), vocabulary).collect()}
    assert got(lexicon.link_variant_join, "abschlagzahlung", "abschlagzahlungen", "kirchenturm") == {("abschlagzahlung", "abschlagszahlung"), ("abschlagzahlungen", "abschlagszahlung"), ("abschlagzahlungen", "abschlagszahlungen"), ("kirchenturm", "kirchturm")}
    assert got(lexicon.query_head_join, "stromtarif", "unbekannttarif") == {("stromtarif", "tarif")}


def test_resolve_takes_the_first_rule_that_finds(spark):
    vocabulary = named(spark, "token", "payment", "paid", "pays", "preis", "arbeit", "arbeitspreis", "stromtarife", "tarif", "strom")
    got = {(r.term, r.token): r.rule for r in lexicon.resolve_terms(named(spark, "term", "pay", "paid", "preis", "stromtarifs", "paymemt"), vocabulary).collect()}
    assert got == {("pay", "payment"): "derived", ("pay", "paid"): "irregular", ("paid", "paid"): "exact", ("paid", "payment"): "derived", ("preis", "preis"): "exact", ("preis", "arbeitspreis"): "compound_head", ("stromtarifs", "stromtarife"): "stem"}


def test_stale_plan_changes_nothing(spark):
    pages = spark.createDataFrame([("a", "active"), ("b", "draft")], ["path", "status"])
    plan = change.plan_property(pages, F.lit(True), "status", F.lit("superseded"))
    done, conflicts = change.apply_plan(pages, plan, "status")
    assert {tuple(r) for r in done.collect()} == {("a", "superseded"), ("b", "superseded")} and conflicts.isEmpty()
    moved = spark.createDataFrame([("a", "active"), ("b", "active")], ["path", "status"])
    done, conflicts = change.apply_plan(moved, plan, "status")
    assert {tuple(r) for r in done.collect()} == {("a", "active"), ("b", "active")} and conflicts.count() == 1


def test_not_operators_hold_for_absent_properties(spark):
    pages = spark.createDataFrame([("a", None), ("b", "x")], "path string, tag string")
    chosen = change.filter_pages(pages, [("tag", "not_equals", "x")])
    assert {r.path: r.selected for r in chosen.collect()} == {"a": True, "b": False}


def test_review_health_bounds(spark):
    rows = [(1, "quality", "2024-01-31 00:00:00", "passed"), (2, "quality", "2024-02-01 00:00:00", "passed"), (3, "quality", "2024-01-01 00:00:00", "failed"), (4, "quality", "2024-02-07 00:00:00", "passed"), (5, "quality", "2024-02-06 00:00:00", "passed"), (6, "cleaning", "2023-12-17 00:00:00", "passed")]
    latest = spark.createDataFrame(rows, "collection long, kind string, reviewed_at string, outcome string")
    got = {r.collection: r.state for r in governance.review_health(latest, "2024-03-01").collect()}
    assert got == {1: "overdue", 2: "due-soon", 3: "attention-needed", 4: "current", 5: "due-soon", 6: "current"}


def page(spark, *bodies):
    return spark.createDataFrame([(f"p{i}", "active", "Title" if i else "Sun", b) for i, b in enumerate(bodies)], "path string, status string, title string, body string")


def test_passages_know_their_section_and_table(spark):
    body = "one line\nand more\n\n# Head\n- item\ntext\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    got = [(r.line_no, r.kind, r.section, r.header, r.text) for r in passages.passages(page(spark, body)).orderBy("line_no").collect()]
    assert got == [(0, "paragraph", [], None, "one line and more"), (3, "heading", [], None, "Head"), (4, "item", ["Head"], None, "- item text"),
                   (6, "table", ["Head"], None, "| a | b |"), (7, "table", ["Head"], "| a | b |", "|---|---|"), (8, "table", ["Head"], "| a | b |", "| 1 | 2 |")]
    cells = {r.cells for r in passages.table_passages(passages.passages(page(spark, body))).collect()}
    assert cells == {"a | b", "a: 1 | b: 2"}


def test_passages_are_cut_after_sentences(spark):
    body = " ".join(f"Sentence number {i} ends here." for i in range(200)) + " " + "endless " * 500
    got = [r.text for r in passages.passages(page(spark, body)).orderBy(F.length("pid"), "pid").collect()]
    assert len(got) > 3 and all(len(x) >= 1500 and x.endswith(".") for x in got[:-1]) and " ".join(got).split() == body.split()
    assert passages.passages(page(spark, "", "  \n ")).count() == 0


def test_a_word_that_stands_nowhere_allows_no_hit(spark):
    found = passages.passages(page(spark, "solar panel\n\nsolar roof", "wind mill\n\npanel"))
    terms = spark.createDataFrame([(1, "solar"), (1, "zzzabsent"), (2, "solar"), (2, "roof"), (3, "panel"), (3, "sun")], "fid long, term string").withColumn("dropped", F.lit(None).cast("string"))
    members = spark.createDataFrame([(1, "solar", "solar", 1.0), (2, "solar", "solar", 1.0), (2, "roof", "roof", 0.3), (3, "panel", "panel", 1.0), (3, "sun", "sun", 1.0)], "fid long, term string, token string, weight double")
    hits = passages.passage_hits(found, members, terms)
    assert {(r.fid, r.pid, r.strength) for r in hits.collect()} == {(2, "p0#2#0", "heuristic"), (3, "p0#0#0", "word_form")}
    assert {tuple(r) for r in passages.token_census(found, members, terms).collect()} == {("solar", 2, 1), ("zzzabsent", 0, 0), ("roof", 1, 1), ("panel", 2, 2), ("sun", 0, 0)}
    postings = passages.passage_tokens(found)
    assert {tuple(r) for r in passages.coverage_account(members, postings, terms).collect() if r.term in ("zzzabsent", "roof")} == {(1, "zzzabsent", 0, 0), (2, "roof", 1, 0)}
    questions = spark.createDataFrame([(1,), (2,), (3,), (4,)], "fid long")
    counted = spark.createDataFrame([(i, no, True) for i in (1, 2, 3) for no in (1, 2)], "qid long, no long, counted boolean")
    told = {r.fid: (r.hits, r.complete, r.reasons) for r in passages.absence_check(questions, hits, counted, terms, found, budget=10).collect()}
    assert told == {1: (0, True, ""), 2: (1, True, ""), 3: (1, False, "budget_exhausted"), 4: (0, False, "too_few_reformulations no_content_words")}
    assert {(r.hits, r.complete, r.reasons) for r in passages.absence_check(questions, None, counted, terms).collect()} == {(None, False, "not_exhaustive")}


def test_path_audit(spark):
    files = spark.createDataFrame([("a/CON.md",), ("a/x.md",), ("a/X.md",), ("b/y .md ",), ("b/n(1).md",)], ["path"])
    assert {tuple(r) for r in governance.path_audit(files).collect()} == {("a/CON.md", "reserved-name"), ("a/x.md", "case-clash"), ("a/X.md", "case-clash"), ("b/y .md ", "trailing-character"), ("b/n(1).md", "conflict-copy")}


def test_entry_imports_without_the_optional_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("quillon", "__spark_entry__.py"):
        copy = shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy
        copy(f"{root}/{name}", f"{tmp_path}/{name}", **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if copy is shutil.copytree else {}))
    assert not os.path.exists(f"{tmp_path}/quillon/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert e.__file__.startswith({0!r}); assert set(e.oracle_sql()) <= set(q) and len(q) > 80; assert not any(x.startswith('op1_') for x in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code.format(str(tmp_path))], cwd=tmp_path, env=env, check=True)


def test_entry_tells_of_a_broken_dependency(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(f"{root}/quillon/llm"):
        return
    (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError('no xxhash', name='xxhash')")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{root}"}, capture_output=True, text=True)
    assert done.returncode and "no xxhash" in done.stderr


def test_definitions_end_at_headings_and_skip_blocks(spark):
    from quillon.operators import definitions

    text = "## a-b\n- Preferred: One\n- preferred: Two\n### more\n- Status: late\n````\n## no\n```\n- Status: no\n`````\n<!-- one line -->\n<!-- two\n## no\n-->\n## Not An Id\n- Definition: lost\n## a-b\n- Status:\n- Related: a-b | zz"
    files = spark.createDataFrame([("s", text), ("e", ""), ("n", None), ("x", "- Status: first\n# T\n~~~\n## open"), ("t", "    # no heading\n## t\r\n- Label: L\r\n")], "path string, content string")
    found, orphans = definitions.load_definitions(files)
    assert {(r.path, r.id, r.line, tuple(sorted(r.fields.items())), r.current) for r in found.collect()} == {
        ("s", "a-b", 1, (("preferred", "Two"),), False), ("s", "a-b", 17, (("related", "a-b | zz"), ("status", "")), True), ("t", "t", 2, (("label", "L"),), True)}
    assert {tuple(r) for r in orphans.collect()} == {("s", 5, "status", "### more", "a-b"), ("s", 16, "definition", "## Not An Id", "a-b")}
    told = {(r.line, r.code, r.detail) for r in definitions.definition_rules(found, orphans).where("path = 's'").collect()}
    assert told == {(17, "missing-field", x) for x in ("preferred", "status", "definition")} | {(17, "bad-status", ""), (17, "duplicate-id", "1"), (17, "relation-to-itself", "a-b"), (17, "unknown-concept", "zz"), (5, "orphaned-field", "status: move the field"), (16, "orphaned-field", "definition: move the field")}
    clusters = spark.createDataFrame([("c", "k", 1, {"label": "L", "color": "#fe8f11", "status": "active", "purpose": "p", "directory": "wiki/../x"}, True), ("c", "m", 9, {"label": "L", "color": "red", "status": "active", "purpose": "p", "directory": "wiki/m"}, True)], found.schema)
    assert {(r.id, r.code) for r in definitions.definition_rules(clusters, orphans.limit(0), "cluster").collect()} == {("k", "bad-directory"), ("m", "bad-color")}


def test_scan_variants_by_rule(spark):
    from quillon.operators import variants

    vocabulary = named(spark, "token", "sms-warndienst", "e-mail-adresse", "krankenhauser", "tage", "kundinnen", "gunstigste", "senken", "abgeschaltet", "abzuschalten", "cancelled", "applied", "charging", "kundigungsfrist2", "vitamin-c", "polster", "the")
    got = {(r.term, r.token): r.rule for r in variants.scan_variants(named(spark, "term", "sms", "mail", "e-mail", "krankenhaus", "tag", "kunden", "gunstiger", "senkt", "abschalten", "cancel", "apply", "charge", "kundigungsfrist", "c", "pol", "the"), vocabulary).collect()}
    assert got == {
        ("sms", "sms-warndienst"): "hyphen_part", ("mail", "e-mail-adresse"): "hyphen_part", ("e-mail", "e-mail-adresse"): "hyphen_part", ("krankenhaus", "krankenhauser"): "ending", ("tag", "tage"): "ending", ("kunden", "kundinnen"): "ending", ("gunstiger", "gunstigste"): "ending",
        ("senkt", "senken"): "verb_ending", ("abschalten", "abgeschaltet"): "verb_ending", ("abschalten", "abzuschalten"): "verb_ending", ("cancel", "cancelled"): "verb_ending", ("apply", "applied"): "verb_ending", ("charge", "charging"): "verb_ending", ("kundigungsfrist", "kundigungsfrist2"): "footnote_mark"}


def test_split_verbs_stay_in_their_sentence(spark):
    from quillon.operators import variants

    rows = [("a", "Der Netzbetreiber lehnt sie ab. Dann kommt nichts."), ("b", "Er lehnt. Sie geht ab und bleibt"), ("c", "Ab Mai gilt es"), ("d", None), ("e", "Sie schaltet " + "x " * 300 + "ab."), ("f", "Er lehnt am 3. Mai den Antrag »ab«, und zieht ihn zurück!")]
    found = spark.createDataFrame([(k, k, t) for k, t in rows], "pid string, path string, text string")
    got = {(r.pid, r.token) for r in variants.split_verbs(found).collect()}
    assert ("a", "+lehnt+ab") in got and ("b", "+geht+ab") in got and ("b", "+lehnt+ab") not in got and ("f", "+lehnt+ab") in got and ("f", "+zieht+zuruck") in got
    assert {p for p, _ in got} == {"a", "b", "f"}
    assert {r.token for r in variants.split_forms(named(spark, "term", "ablehnen")).collect()} >= {"+lehnt+ab", "+lehnen+ab"}


def test_restore_keeps_what_it_replaces(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], ["path", "content"])
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], ["path", "content"])
    snapshot = change.snapshot_table(old, "s1")
    plan = change.restore_plan(snapshot, new, with_missing=True)
    after, recovery, conflicts = change.restore(new, snapshot, plan, "s2")
    assert {tuple(r) for r in after.collect()} == {("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")} and conflicts.isEmpty()
    assert {(r.snapshot_id, r.path, r.content) for r in recovery.collect()} == {("s2", "b", "x")}
    moved = new.withColumn("content", F.when(F.col("path") == "b", "y").otherwise(F.col("content")))
    after, _, conflicts = change.restore(moved, snapshot, plan, "s2")
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in moved.collect()} and [r.path for r in conflicts.collect()] == ["b"]


def test_export_writes_links_and_leaves_out_claims(spark, tmp_path):
    from quillon.operators import bundle

    body = "[[a/b.md#x|Label ]] [[./c d]] [[e|]]\n<!-- Claim\nid: 1\n-->\n kept \n<!-- /claim -->!"
    assert named(spark, "t", body).select(bundle.exported_body(F.col("t"))).first()[0] == "[Label](/a/b.md) [c d](/c d.md) [e](/e.md)\nkept!"
    nodes, links = spark.createDataFrame([("file", "p")], "kind string, id string"), spark.createDataFrame([("wikilink", "p", None), ("wikilink", "p", "q")], "kind string, source string, target string")
    bundle.write_graph(nodes, links, f"{tmp_path}/g")
    assert {r.part for r in spark.read.parquet(f"{tmp_path}/g").collect()} == {"node", "link", "unresolved"}
    change.write_snapshot(change.snapshot_table(spark.createDataFrame([("a", "1")], ["path", "content"]), "s1"), f"{tmp_path}/s")
    change.write_snapshot(change.snapshot_table(spark.createDataFrame([("a", "2")], ["path", "content"]), "s2"), f"{tmp_path}/s")
    assert {(r.snapshot_id, r.content) for r in spark.read.parquet(f"{tmp_path}/s").collect()} == {("s1", "1"), ("s2", "2")}


def test_shared_concepts_raise_a_score(spark):
    pages = spark.createDataFrame([("a", "active", "c1"), ("b", "draft", None), ("c", None, "c2")], "path string, status string, concept string")
    scores = spark.createDataFrame([(1, x, 2.0) for x in "abc"] + [(2, "a", 2.0)], "fid long, path string, score double")
    phrases = scores.select("fid", "path", F.lit(False).alias("phrase"))
    triggers = spark.createDataFrame([(1, "c1"), (1, "c1"), (1, "c3")], "fid long, concept_id string")
    got = {(r.fid, r.path): round(r.score, 6) for r in search.score_signals(scores, pages, phrases, triggers).collect()}
    assert got == {(1, "a"): 3.45, (1, "b"): 1.9, (1, "c"): 2.0, (2, "a"): 2.3}


def test_verb_forms_of_a_family(spark):
    vocabulary = named(spark, "token", "kundigt", "gekundigt", "andert", "rechnet", "gerechnet", "planet", "internet", "filmt")
    got = {(r.term, r.token): r.rule for r in lexicon.family_join(named(spark, "term", "kundigen", "andere", "rechnen", "kundigt", "plan", "filmen"), vocabulary).collect()}
    assert got == {("kundigen", "kundigt"): "verb", ("kundigen", "gekundigt"): "verb", ("kundigt", "kundigt"): "exact", ("kundigt", "gekundigt"): "verb", ("rechnen", "rechnet"): "verb", ("rechnen", "gerechnet"): "verb"}


def test_compounds_of_many_parts(spark):
    vocabulary = named(spark, "token", "strom", "netz", "entgelt", "vertrag", "stromnetzentgelt", "stromnetzentgelten", "netzentgeltvertrags", "stromxnetzentgelt", "vertragsstromnetz")
    got = {(r.term, r.token): r.rule for r in lexicon.compound_join(named(spark, "term", "netz", "entgelt", "strom"), vocabulary).collect()}
    head, other = "compound_head", "compound_modifier"
    assert got == {("netz", "stromnetzentgelt"): other, ("netz", "stromnetzentgelten"): other, ("netz", "netzentgeltvertrags"): other, ("netz", "vertragsstromnetz"): head, ("entgelt", "stromnetzentgelt"): head,
        ("entgelt", "stromnetzentgelten"): head, ("entgelt", "netzentgeltvertrags"): other, ("strom", "stromnetzentgelt"): other, ("strom", "stromnetzentgelten"): other, ("strom", "vertragsstromnetz"): other}


def test_quantities_in_every_notation(spark):
    texts = {"2,5 MWh und 2.500 kWh": ["=2500kwh", "=2500kwh"], "drei Monate": ["=3monat"], "3 Monaten": ["=3monat"], "37 Monate": [], "€ 75 und 75,- € und EUR 25,50": ["=75eur", "=75eur", "=25.5eur"], "§ 3 Monate": [], "Nr. 2 Tage": [],
        "minus 5 %": [], "−5 %": [], "2 bis 4 Wochen": [], "10 € bis 20 €": ["=10eur"], "zwischen 10 und 20 Prozent": [], "zwischen 10 € und 20 €": ["=10eur"], "10 € und 20 €": ["=10eur", "=20eur"], "€ 1,5 Mio.": [], "- 14 Tage": ["=14tag"],
        "Wert - 14 Tage": [], "Frist – drei Monate": ["=3monat"], "9,84 ct": ["=0.0984eur"], "3 Monats-Frist": [], "abc5 %": [], "1/5 %": [], "(5 %)": ["=5prozent"], "0 %": ["=0prozent"], "": []}
    pages = spark.createDataFrame([(t, t) for t in texts], "path string, body string")
    got = {t: [] for t in texts}
    for r in quantities.extract_quantities(pages).collect():
        got[r.path].append(r.token)
    assert got == texts
