"""The gate over search quality, case by case."""

import pytest

from quillon.operators import gate as G

RANKS = "fid int, path string, rank int"


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows, schema=RANKS: spark.createDataFrame(rows, schema)


def test_metrics(table):
    ranked = table([(1, "a.md", 1), (1, "wiki/index.md", 2), (1, "b.md", 4), (2, "c.md", 13), (2, "WIKI.md", 3), (3, "x.md", 1), (3, "y.md", 12), (3, "z.md", 13), (4, "d.md", 101)])
    truth = table([(1, "a.md"), (1, "b.md"), (2, "c.md"), (4, "d.md"), (9, "not-asked.md")], "fid int, path string")
    questions = table([(1,), (2,), (3,), (4,)], "fid int")
    got = {r.metric: r.value for r in G.quality_metrics(ranked, questions, truth).collect()}
    assert got == {"answerable_queries": 3, "negative_queries": 1, "required_first_result": 1, "all_must_find_within_3": 0, "all_must_find_within_12": 1, "all_must_find_within_100": 2, "negative_results_within_12": 2, "navigation_in_top_3": 2}
    bounds = G.held_bounds(table(list(got.items()), "metric string, value long"), {"required_first_result": 1, "all_must_find_within_12": 2, "missing": 0}, {"navigation_in_top_3": 2, "negative_results_within_12": 1})
    assert {r.metric: r.held for r in bounds.collect()} == {"required_first_result": True, "all_must_find_within_12": False, "missing": False, "navigation_in_top_3": True, "negative_results_within_12": False}


def test_metrics_of_nothing(table):
    got = G.quality_metrics(table([]), table([], "fid int"), table([], "fid int, path string")).collect()
    assert len(got) == 8 and all(r.value == 0 for r in got)


def test_regressions(table):
    recorded = table([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "d", 2), (3, "e", 3), (4, "f", 12), (5, "g", 2), (6, "h", 2), (7, "i", 2), (8, "j", 13), (9, "k", 1)])
    ranked = table([(1, "a", 2), (1, "b", 1), (2, "c", 2), (2, "d", 3), (3, "e", 4), (4, "f", 101), (5, "g", 40), (6, "h", 9), (7, "i", 13), (8, "j", 90)])
    truth = table([(i, p) for i, p in zip((1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9), "abcdefghijk", strict=True)], "fid int, path string")
    accepted = table([(5, "g", None), (6, "h", 10), (7, "i", 10), (9, "k", 12)], "fid int, path string, accepted_rank int")
    got = {(r.fid, r.path): (r.bound, r.held, r.now) for r in G.rank_regressions(ranked, recorded, truth, accepted).collect()}
    # 1: another required page took the place; 5: exempt; 6: within the accepted band; 8: was in no band; 9: first place accepted, not that it went
    assert got == {(2, "c"): (1, 1, 2), (3, "e"): (3, 3, 4), (4, "f"): (12, 12, None), (7, "i"): (12, 10, 13), (9, "k"): (12, 12, None)}
    better = {(r.fid, r.path): (r.was, r.now) for r in G.rank_improvements(ranked, recorded, truth).collect()}
    assert better == {(1, "b"): (2, 1)}


def test_runs_are_met_where_their_longest_token_stands(spark):
    pages = spark.createDataFrame([("a", "x y long z x y".split()), ("b", "long y x".split()), ("c", "y long z".split()), ("d", []), ("e", "long z y y long z".split())], "path string, t array<string>")
    runs = spark.createDataFrame([(1, ["y", "long", "z"]), (2, ["x", "y"]), (3, ["y", "y"]), (4, ["z", "long"])], "fid long, run array<string>")
    made = G.holders_of_runs(pages, runs)
    assert {tuple(r) for r in made.collect()} == {(1, "a"), (1, "c"), (1, "e"), (2, "a"), (3, "e")}
    # no page is written out as all its runs
    assert "array_join" not in made._jdf.queryExecution().optimizedPlan().toString()
