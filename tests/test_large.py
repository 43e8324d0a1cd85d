"""What keeps queries within their limits on large tables, with the results that they had."""

import random
from collections import deque

import pytest


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_module_members_make_no_edge_twice(spark):
    from weftline.operators.upkeep import module_members

    modules = [("m1", "a", "./x"), ("m1", "a", "../b/x"), ("m1", "a", "./x"), ("m2", "a", "../b/x"), ("m3", "a", "../../x"), ("m4", "a", "./z")]
    members = [("v1", "a/x"), ("v1", "b/x"), ("v1", "a/x"), ("v2", "b/x"), ("v3", "c")]
    found = module_members(spark.createDataFrame(modules, "id string, folder string, source string"), spark.createDataFrame(members, "id string, folder string"))
    assert sorted(map(tuple, found.collect())) == [("m1", "v1"), ("m1", "v2"), ("m2", "v1"), ("m2", "v2")]
    assert not plan(found).startswith("Aggregate")  # edges are not sorted out afterwards


@pytest.mark.parametrize("directed", [True, False])
def test_shortest_path_from_both_ends(spark, directed):
    from weftline.operators.graph import shortest_path

    r = random.Random(5)
    arcs = {(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(45)}
    df = spark.createDataFrame(sorted(arcs), "src string, dst string").cache()
    steps = {(a, b) for a, b in arcs if a != b} | ({(b, a) for a, b in arcs if a != b} if not directed else set())
    for end in ("n7", "n12", "n21", "n3"):
        dist, todo = {"n0": 0}, deque(["n0"])
        while todo:
            x = todo.popleft()
            for a, b in steps:
                if a == x and b not in dist:
                    dist[b] = dist[x] + 1
                    todo.append(b)
        want = [end] if end in dist else []
        while want and want[-1] != "n0":
            want.append(min(a for a, b in steps if b == want[-1] and dist.get(a) == dist[b] - 1))
        got = sorted(map(tuple, shortest_path(df, "n0", end, 30, directed).collect()))
        assert got == list(enumerate(reversed(want)))


def test_shortest_path_keeps_off_crowds(spark, monkeypatch):
    from weftline.operators import graph

    sizes = []
    level = graph._level
    monkeypatch.setattr(graph, "_level", lambda ids: sizes.append(level(ids)) or sizes[-1])
    arcs = [("s", "hub"), ("s", "t"), *[("hub", f"x{i}") for i in range(300)], ("hub", "m"), ("m", "e")]
    found = graph.shortest_path(spark.createDataFrame(arcs, "src string, dst string"), "s", "e", directed=False)
    assert [x["id"] for x in sorted(found.collect())] == ["s", "hub", "m", "e"]
    assert sum(n for _, n in sizes) < 20


def test_edge_betweenness_takes_trees_off(spark, monkeypatch):
    from weftline.operators import centrality

    searched = []
    levels = centrality._levels
    monkeypatch.setattr(centrality, "_levels", lambda around, start: searched.append(start.count()) or levels(around, start))
    ring = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")]
    tree = [("a", f"x{i}") for i in range(20)] + [("x1", "y"), ("p", "q"), ("q", "r")]
    pairs = spark.createDataFrame(ring + tree, "u string, v string")
    got = {(r["u"], r["v"]): r["score"] for r in centrality.edge_betweenness(pairs).collect()}
    assert searched == [4]
    assert got["a", "x1"] == 2 * 23 and got["a", "x2"] == 24 and got["x1", "y"] == 24 and got["p", "q"] == got["q", "r"] == 2
    assert got["a", "b"] == 22 + 0.5 * 22 + 0.5 and got["b", "c"] == 1 + 0.5 * 22 + 0.5


def test_calls_meet_their_chain_before_methods(spark):
    from weftline.operators.ancestry import bound_calls

    calls = spark.createDataFrame([("s1", "A", "f", None), ("s2", "A", "f", "A"), ("s3", "B", "g", None), ("s4", "A", "h", None)], "src string, type string, name string, after string")
    order = spark.createDataFrame([("A", "A", 1), ("A", "M", 2), ("B", "B", 1), ("B", "U", 2), ("B", "M", 3)], "type string, at string, pos int")
    types = spark.createDataFrame([("A",), ("B",), ("M",)], "type string")
    methods = spark.createDataFrame([("A", "f", "1"), ("M", "f", "2"), ("M", "g", "3"), ("M", "h", "4"), ("M", "h", "5")], "owner string, name string, id string")
    found = bound_calls(calls, order, types, methods)
    got = {r["src"]: (r["owner"], r["dst"], r["state"]) for r in found.collect()}
    assert got == {"s1": ("A", "1", "bound"), "s2": ("M", "2", "bound"), "s3": (None, None, "barrier"), "s4": (None, None, "ambiguous")}
    joins = [x.split("Inner, ")[1] for x in plan(found).splitlines() if "Join Inner" in x]
    assert not any(x.startswith("(name#") and "at#" not in x for x in joins)  # never by name alone


def test_stored_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    from weftline import session

    monkeypatch.setattr(session, "FEW", 5, raising=False)
    many, few = session.stored(spark.range(10)), session.stored(spark.range(4))
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in shown(many.join(many.withColumnRenamed("id", "k"), many["id"] == 2 * session.F.col("k")))
    assert "Broadcast" in shown(spark.range(10**9).join(few, "id"))
