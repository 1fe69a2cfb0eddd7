"""Actions on properties, and links in texts, case by case."""

import pytest

from pyspark.sql import functions as F

from quillon.operators import links, properties

S = lambda x: ("string", x, None)
N = lambda: ("null", None, None)
L = lambda *x: ("list", None, list(x))


@pytest.fixture(scope="module")
def plan(spark):
    def run(props, action, pages=("p.md",)):
        docs = spark.createDataFrame([("p.md", props)], "path string, props " + properties.PROPS)
        known = spark.createDataFrame([(x,) for x in pages], "path string")
        r = properties.plan_action(docs, F.lit(True), action, known).first()
        return {k: tuple(v) for k, v in r.after.items()}, r.skipped_reason, r.changed

    return run


def test_set(plan):
    assert plan({}, {"type": "set", "property": "a", "value": 3}) == ({"a": ("integer", "3", None)}, "", True)
    assert plan({"a": S("x")}, {"type": "set", "property": "a", "value": "y"}) == ({"a": S("x")}, "property already set", False)
    assert plan({"a": S("")}, {"type": "set", "property": "a", "value": ["y"]}) == ({"a": L("y")}, "", True)
    assert plan({"a": N()}, {"type": "set", "property": "a", "value": True}) == ({"a": ("bool", "true", None)}, "", True)
    assert plan({"a": S("x")}, {"type": "set", "property": "a", "value": "x", "mode": "overwrite"}) == ({"a": S("x")}, "no value change", False)
    assert plan({"a": S("x")}, {"type": "set", "property": "a", "value": ["y", "x"], "mode": "merge_list"}) == ({"a": L("x", "y")}, "", True)


def test_delete_rename_copy_merge(plan):
    assert plan({"a": S("x"), "b": S("y")}, {"type": "delete", "properties": ["a", "z"]}) == ({"b": S("y")}, "", True)
    assert plan({"b": S("y")}, {"type": "delete", "properties": ["z"]})[1] == "no matching property"
    assert plan({"a": S("x"), "b": L("y", "x")}, {"type": "rename", "from_properties": ["z", "a", "b"], "to_property": "c"}) == ({"c": L("x", "y")}, "", True)
    assert plan({"a": S("x"), "c": S("v")}, {"type": "rename", "from_properties": ["a"], "to_property": "c"})[1] == "target property exists"
    assert plan({"a": S("x"), "c": S("v")}, {"type": "rename", "from_properties": ["a"], "to_property": "c", "on_conflict": "overwrite"})[0] == {"c": S("x")}
    assert plan({"a": S("x"), "c": L()}, {"type": "copy", "from_properties": ["a"], "to_property": "c"})[0] == {"a": S("x"), "c": S("x")}
    assert plan({"a": S("x"), "c": L("v")}, {"type": "merge", "from_properties": ["a", "c"], "to_property": "c"})[0] == {"c": L("v", "x")}
    assert plan({"c": L("v")}, {"type": "merge", "from_properties": ["a"], "to_property": "c"})[1] == "no source property present"


def test_normalize(plan):
    action = {"type": "normalize_values", "property": "t", "transforms": ["trim", "lowercase", "strip_diacritics"], "mappings": [("preise", "price")]}
    assert plan({"t": L(" Größe", "PREISE ", "", "price", "[[A/B]]")}, action) == ({"t": L("große", "price", "[[A/B]]")}, "", True)
    assert plan({"t": S(" Été ")}, action)[0] == {"t": S("ete")} and plan({"t": ("integer", "3", None)}, action)[1] == "no value change"
    assert plan({}, action)[1] == "property not present"
    with pytest.raises(ValueError):
        plan({}, {"type": "normalize_values", "property": "t", "transforms": ["reverse"]})


def test_dedupe_links(plan):
    pages = ("wiki/a/x.md", "wiki/b/x.md", "wiki/b/y.md")
    action = {"type": "dedupe_wikilinks", "properties": []}
    got = plan({"r": L("[[y]]", "[[wiki/b/y.md]]", "[[./wiki/b/y#s|L]]", "[[x]]", "[[x]]", "plain", "[[../y]]"), "s": S("[[y|Z]]"), "n": ("integer", "1", None)}, action, pages)
    assert got == ({"r": L("[[wiki/b/y]]", "[[wiki/b/y#s|L]]", "[[x]]", "plain", "[[../y]]"), "s": S("[[wiki/b/y|Z]]"), "n": ("integer", "1", None)}, "", True)
    assert plan({"r": L("[[wiki/b/y]]")}, action, pages)[1] == "no duplicate or non-canonical wikilink"


def test_links_keep_anchor_and_label(spark):
    bodies = [("wiki/a.md", "See [[wiki/b.md#Top|the B]], [[b]], [[./wiki/b]] and [[wiki/c|C]].\n[[wiki/b#x]]"), ("wiki/b.md", "to [[wiki/a]] $1 \\"), ("sources/s.md", "[[nowhere]] [[wiki/b]]"), ("wiki/n.md", None)]
    pages = spark.createDataFrame(bodies, "path string, body string")
    got = {(r.path, r.ord): (r.target, r.anchor, r.label, r.resolved, r.broken) for r in links.resolved_links(pages).collect()}
    assert got["wiki/a.md", 0] == ("wiki/b", "#Top", "the B", True, False) and got["wiki/a.md", 1] == ("b", "", None, False, True) and got["sources/s.md", 0] == ("nowhere", "", None, False, False)
    moves = spark.createDataFrame([("wiki/b.md", "wiki/new/b2.md")], "from_path string, to_path string")
    moved = {r.path: (r.body, r.n_links) for r in links.moved_pages(pages, moves).collect()}
    assert moved["wiki/a.md"] == ("See [[wiki/new/b2#Top|the B]], [[b]], [[wiki/new/b2]] and [[wiki/c|C]].\n[[wiki/new/b2#x]]", 3)
    assert moved["wiki/new/b2.md"] == (bodies[1][1], 0) and moved["sources/s.md"] == ("[[nowhere]] [[wiki/new/b2]]", 1) and moved["wiki/n.md"] == (None, 0)
    with pytest.raises(ValueError):
        links.moved_pages(pages, spark.createDataFrame([("wiki/b.md", "wiki/a.md")], "from_path string, to_path string"))
