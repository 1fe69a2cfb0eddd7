"""The inventory of typed properties, by hand."""

from quillon.operators import inventory as I

SCHEMA = "path string, key string, kind string, scalar string, items array<string>"


def test_inventory(spark):
    rows = [
        ("wiki/a.md", "tags", "list", None, ["x", "12", "true"]), ("wiki/b.md", "tags", "string", "x", None), ("sources/c.md", "tags", "list", None, []), ("CONCEPTS.md", "tags", "null", None, None),
        ("wiki/a.md", "size", "integer", "12", None), ("wiki/b.md", "size", "number", "1.5", None), ("wiki/b.md", "draft", "bool", "true", None), ("wiki/c.md", "long", "string", "y" * 200, None),
        ("wiki/d.md", "many", "list", None, [None, "2.5", "a", "b", "c", "d"]),
    ]
    got = {r["property"]: r for r in I.typed_inventory(spark.createDataFrame(rows, SCHEMA)).collect()}
    plain = lambda x: {y["name"]: y["n"] for y in x}
    assert plain(got["tags"].types) == {"list": 1, "list<boolean|integer|string>": 1, "null": 1, "string": 1} and got["tags"].n == 4
    assert plain(got["tags"].classes) == {"schema": 1, "source": 1, "wiki-page": 2}
    assert sorted(got["tags"].samples) == ["[]", "[x, 12, true]", "null", "x"]
    assert plain(got["size"].types) == {"integer": 1, "number": 1} and plain(got["draft"].types) == {"boolean": 1}
    assert got["long"].samples == ["y" * 160 + "…"]
    assert plain(got["many"].types) == {"list<null|number|string>": 1} and got["many"].samples == ["[null, 2.5, a, b, c]"]


def test_samples_are_bounded_and_do_not_depend_on_the_order(spark):
    rows = [(f"wiki/{i}.md", "k", "string", str(i % 700), None) for i in range(2000)]
    told = [I.typed_inventory(spark.createDataFrame(x, SCHEMA).repartition(7)).first() for x in (rows, rows[::-1])]
    assert told[0].samples == told[1].samples and len(set(told[0].samples)) == I.SAMPLES and told[0].n == 2000


def test_no_properties(spark):
    assert I.typed_inventory(spark.createDataFrame([], SCHEMA)).count() == 0
