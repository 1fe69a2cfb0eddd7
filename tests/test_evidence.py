"""Units, locators and coverage of sources, case by case."""

import pytest

from quillon.operators import evidence as E

PAGED = "Cover\n<!-- page: 1 -->\nA\n<!-- page: 2 -->\nB\n<!-- page: 3 -->\nC\n<!-- page: 4 -->\nD\n"
NOTE = "# Handbook\nPreface [00:00:05].\n## Chapter A\na\n### A.1 Details\nmore\n## Chapter B\nb\n"
NUMBERED = (
    "## § 3 Preise\nx\n## 4 Abrechnung\ny\n### 4.1 Berechnung des Abschlags\nz\n## 10 Schluss\nw\n## 1 Anspruch\na\n### 1.2 X\nb\n"
    "## **Zähler-Wechsel**:\nc\n## Teil 1\nt1\n## Teil 2\nt2\n## 5.1 Fristen\nf\n## 6.1 Fristen\ng\n"
)
SPANNING = "# Guide\n<!-- page: 1 -->\n## A\ntext\n<!-- page: 2 -->\nmore A\n## B\ntext b\n<!-- page: 3 -->\n## C\nc\n"
STAMPED = "## [00:00:05] Hello\nHi.\n## 00:12:30 Prices\nPrices.\n[00:20:00] B: Thanks.\n## 00:40:00 Break\n## 00:45:00 Questions\nAsk.\n"

UNITS = [
    (PAGED, "page", ["page=1", "page=2", "page=3", "page=4"]),
    ("# Title\n\n## Extracted content\n\n## Part\nText.\n", "section", ["section=Part"]),
    ("# Own title\n## Contents\nText.\n", "section", ["section=Contents"]),
    ("Cover\n<!-- page: 1 -->\nA\n<!-- page: 2 -->\n## Only a heading\n<!-- PAGE: 3 -->\nC\n<!--page:1-->\nMore of page 1\n", "page", ["page=1", "page=3"]),
    ("<!-- slide: 1 -->\nAgenda\n<!-- slide: 2 -->\nPrices\n", "slide", ["slide=1", "slide=2"]),
    ("Before\n# Part\n## A\ntext a\n### A1\ntext a1\n## B\ntext b\n## A\nonce more\n", "section", ["section=A (line 3)", "section=A1", "section=B", "section=A (line 9)"]),
    (NOTE, "section", ["section=Chapter A", "section=A.1 Details", "section=Chapter B"]),
    ("# Title\nPreface\n## Part\nIntro\n### One\na\n### Two\nb\n", "section", ["section=One", "section=Two"]),
    ("# Title\nPreface\n## A\na\n# Appendix\nx\n", "section", ["section=Title", "section=A", "section=Appendix"]),
    ("# Title\nOnly a preface\n", "section", ["section=Title"]),
    ("# Title\nPreface\n## Single\nText\n", "section", ["section=Single"]),
    ("# Title\n<!-- page: 1 -->\nA\n## B\n<!-- page: 2 -->\nC\n", "page", ["page=1", "page=2"]),
    ("One paragraph.\n\nAnd a second.\n", "document", ["document"]),
    ("\n\n", "empty", []), (None, "empty", []), ("", "empty", []), ("--- !!\n", "empty", []),
    ("```markdown\n<!-- page: 1 -->\n# Head\n```\n", "document", ["document"]),
    ("<!-- page: 1 -->\nText\n<!-- page: 2 -->\n```\n```\n", "page", ["page=1", "page=2"]),
    ("<!-- page: 1 -->\n\nFirst.\n\n~~~\n<!-- page: 2 -->\n# Comment in code\n~~~\n\nStill one.\n", "page", ["page=1"]),
    ("<!-- page: 1 -->\nA\n    ```\n<!-- page: 2 -->\nB\n", "page", ["page=1", "page=2"]),
    ("Text <!-- page: 1 --> more\nand <!-- slide: 2 -->\n", "document", ["document"]),
    ("## # \n#hash\n###### deep ##\nx\r\ny\n", "section", ["section=deep"]),
]


@pytest.fixture(scope="module")
def parts_of(spark):
    return lambda texts: E.segments(spark.createDataFrame(list(enumerate(texts)), "source_no long, text string")).cache()


def test_units(parts_of):
    parts = parts_of([t for t, *_ in UNITS])
    kinds = {r.source_no: r.unit_kind for r in E.unit_kinds(parts).collect()}
    units: dict = {}
    for r in E.source_units(parts).orderBy("source_no", "ord").collect():
        units.setdefault(r.source_no, []).append(r.unit)
    for i, (text, kind, want) in enumerate(UNITS):
        assert (kinds[i], units.get(i, [])) == (kind, want), text


ZEROS = "<!-- page: 01 -->\nA\n<!-- page: 02 -->\nB\n<!-- page: 03 -->\nC\n"
LETTERS = "<!-- page: iv -->\nPreface\n<!-- page: A-1 -->\nAppendix\n"
MANY = "".join(f"<!-- page: {n} -->\nPage {n}\n" for n in range(1, 40, 2))
ODD = "<!-- page: 1 -->\nA\n<!-- page: ² -->\nB\n<!-- page: 3 -->\nC\n<!-- page: ３ -->\nE\n"
NAMED = [
    (PAGED, "page=2", {"page=2"}), (PAGED, "Page = 03", {"page=3"}), (ZEROS, "page=3", {"page=03"}), (PAGED, "page=2–4", {"page=2", "page=3", "page=4"}), (LETTERS, "page=IV", {"page=iv"}), (LETTERS, "page=a-1", {"page=A-1"}),
    (PAGED, " Document ", {"page=1", "page=2", "page=3", "page=4"}), (ODD, "page=²", {"page=²"}), (ODD, "page=3", {"page=3", "page=３"}),
    (NUMBERED, "section=§3 Preise", {"section=§ 3 Preise"}), (NUMBERED, "section=§3", {"section=§ 3 Preise"}), (NUMBERED, "section=zahler-wechsel", {"section=**Zähler-Wechsel**:"}), (NUMBERED, "heading=ZÄHLER-WECHSEL.", {"section=**Zähler-Wechsel**:"}),
    (NUMBERED, "section=  4   Abrechnung", {"section=4 Abrechnung", "section=4.1 Berechnung des Abschlags"}), (NUMBERED, "section=4", {"section=4 Abrechnung", "section=4.1 Berechnung des Abschlags"}),
    (NUMBERED, "section=Berechnung des Abschlags", {"section=4.1 Berechnung des Abschlags"}), (NUMBERED, "sheet=Preise", {"section=§ 3 Preise"}), (NUMBERED, "section=1", {"section=1 Anspruch", "section=1.2 X"}), (NUMBERED, "section=`Teil 2`", {"section=Teil 2"}),
    ("## Teil\nx\n## Teil 1\ny\n## Teil 2\nz\n", "section=Teil", {"section=Teil"}), (SPANNING, "section=A", {"page=1", "page=2"}), (SPANNING, "section=B", {"page=2"}), (SPANNING, "section=Guide", {"page=1", "page=2", "page=3"}),
    (NOTE, "section=Handbook", {"section=Chapter A", "section=A.1 Details", "section=Chapter B"}), (NOTE, "timestamp=00:00:05", set()),
    (STAMPED, "timestamp=00:00:05", {"section=[00:00:05] Hello"}), (STAMPED, "timestamp=[00:20:00]", {"section=00:12:30 Prices"}), (STAMPED, "timestamp=00:40:00", set()), ("Cover 09:30\n<!-- page: 1 -->\nA\n<!-- page: 2 -->\nB 10:15\n", "timestamp=10:15", {"page=2"}),
    ("## Introduction\ntext\n", "section=Introduction", {"section=Introduction"}), ("", "document", set()),
]
REASONS = [
    (PAGED, "page=7", "the extraction marks pages 1-4"), (PAGED, "page=3-2", "the range 3-2 is reversed; write page=2-3"), (PAGED, "page=3-9", "the extraction marks pages 1-4"), (PAGED, "page=1,2", "write one entry per page, or a range such as page=3-5"),
    (PAGED, "page=3 (Table 2)", "'3 (Table 2)' is not a page marker value; write page=3 and keep further detail in the claim text"), (PAGED, "page=v", "the extraction marks pages 1-4"), (PAGED, "page=", "the locator names no page"),
    (LETTERS, "page=v", "the extraction marks pages iv, A-1"), (MANY, "page=2", "the extraction marks pages 1, 3, 5, 7, 9, 11, 13, 15, 17, 19 and 10 more"), ("## A\nText\n", "page=1", "the extraction has no page markers"), (PAGED, "slide=1", "the extraction has no slide markers"),
    (NUMBERED, "section=Fristen", "2 headings match 'Fristen'; cite the full heading with its number"), (NUMBERED, "section=Teil", "2 headings begin with 'Teil'; cite the full heading"), (NUMBERED, "section=Nichts", "no heading of the extraction matches 'Nichts'"),
    (NUMBERED, "section=**", "the locator names no section"), (NUMBERED, "heading=", "the locator names no heading"), (STAMPED, "timestamp=1:00", "the extraction does not contain the time stamp '1:00'"), (STAMPED, "timestamp=Minute 3", "'Minute 3' is not a time stamp such as 00:12:30 or 12:30"),
    (ODD, "page=9", "the extraction marks pages 1, ², 3, ３"),
]
UNCHECKED = ["S. 12", "p. 4", "paragraph=4", "", None]


def test_locators(spark, parts_of):
    texts = list(dict.fromkeys([t for t, *_ in NAMED + REASONS]))
    parts = parts_of(texts)
    asked = [(texts.index(t), x) for t, x, _ in NAMED + REASONS] + [(texts.index(PAGED), x) for x in UNCHECKED] + [(999, "page=1")]
    found = E.Evidence(spark.createDataFrame(asked, "source_no long, locator string"), parts)
    state = {(r.source_no, r.locator): (r.state, r.reason) for r in found.states.collect()}
    units: dict = {}
    for r in found.named.collect():
        units.setdefault((r.source_no, r.locator), set()).add(r.unit)
    for text, locator, want in NAMED:
        key = texts.index(text), locator
        assert (state[key], units.get(key, set())) == (("resolved", ""), want), locator
    for text, locator, reason in REASONS:
        key = texts.index(text), locator
        assert (state[key], units.get(key, set())) == (("unresolved", reason), set()), locator
    assert {state[texts.index(PAGED), x or ""] for x in UNCHECKED} == {("unchecked", "")}
    assert state[999, "page=1"][0] == "unknown-source" and len(state) == len(set((a, b or "") for a, b in asked))


def test_coverage(spark, parts_of):
    three = "# Guide\n<!-- page: 1 -->\nA\n<!-- page: 2 -->\nB\n<!-- page: 3 -->\nC\n"
    runs = "".join(f"<!-- page: {v} -->\nText\n" for v in ("1", "2", "3", "5", "iv", "7", "8"))
    parts = parts_of([three, "Only text.", NOTE, runs, PAGED, "\n"])
    rows = [("a1", "active", 0, "document"), ("a2", "disputed", 0, "section=Guide"), ("a3", "active", 0, "page=1-3"), ("b", "active", 1, "document")]
    rows += [(f"c{i}", "active", 2, x) for i, x in enumerate(("section=Handbook", "document", "section=Chapter A"))]
    rows += [("e1", "active", 4, "page=2"), ("e2", "superseded", 4, "page=3"), ("e3", "active", 4, "S. 4"), ("e4", "active", 4, "page=9"), ("x", "active", 99, "page=1")]
    cited = spark.createDataFrame(rows, "claim_id string, claim_status string, source_no long, locator string")
    found = E.Evidence(cited, parts)
    got = {r.source_no: tuple(r)[1:] for r in E.source_coverage(found).collect()}
    assert got == {0: (3, 0, 3, 3, 0), 1: (1, 1, 1, 0, 0), 2: (3, 2, 3, 2, 0), 3: (7, 0, 0, 0, 0), 4: (4, 1, 3, 0, 1), 5: (0, 0, 0, 0, 0)}
    left: dict = {}
    for r in E.uncited_runs(found).orderBy("source_no", "ord").collect():
        left.setdefault(r.source_no, []).append(r.label)
    assert left == {0: ["page=1-3"], 2: ["section=Chapter B"], 3: ["page=1-3", "page=5", "page=iv", "page=7-8"], 4: ["page=1", "page=3-4"]}
    told = {r.claim_id: r for r in E.locator_resolve(found).collect()}
    assert len(told) == len(rows) and told["a1"].broad and not told["b"].broad and told["x"].state == "unknown-source" and told["e1"].n_units == 1
