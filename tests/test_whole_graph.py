"""Graph queries hold for the whole graph, not for a part of its edges."""

from collections import deque

import pytest

from weftline.operators import graph
from weftline.plans import registry
from weftline.plans.kgview import edges

registry.load()


def path_shares(around, source):
    """By node: the sum over targets of the share of shortest paths from source through it."""
    paths, hops, order, before = {source: 1}, {source: 0}, [], {}
    queue = deque([source])
    while queue:
        at = queue.popleft()
        order.append(at)
        for to in around[at]:
            if to not in hops:
                hops[to], paths[to] = hops[at] + 1, 0
                queue.append(to)
            if hops[to] == hops[at] + 1:
                paths[to] += paths[at]
                before.setdefault(to, []).append(at)
    carried = dict.fromkeys(order, 0.0)
    for node in reversed(order):
        for b in before.get(node, ()):
            carried[b] += paths[b] / paths[node] * (1 + carried[node])
    del carried[source]
    return carried


def test_betweenness_covers_all_edges(spark, sf_dir):
    from pyspark.sql import functions as F

    pairs = graph.simple(edges(spark, sf_dir))
    around = {}
    for u, v in pairs.where("u <> v").collect():
        around.setdefault(u, []).append(v)
        around.setdefault(v, []).append(u)
    start = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(100)
    want = {}
    for (s,) in start.collect():
        for node, value in path_shares(around, s).items():
            want[node] = want.get(node, 0.0) + value
    want = {k: v for k, v in want.items() if v}
    got = dict(registry.QUERIES["node_betweenness_sampled"](spark, sf_dir).collect())
    assert {k.split("_")[0] for k in got} >= {"order", "part", "customer", "supplier", "nation"}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-5) for k in want)


def test_betweenness_of_a_table_without_edges(spark):
    from weftline.operators.centrality import betweenness

    assert betweenness(spark.createDataFrame([], "u string, v string")).count() == 0
    assert betweenness(spark.createDataFrame([("a", "a")], "u string, v string")).count() == 0


@pytest.mark.parametrize("name", ["detected_communities", "louvain_communities"])
def test_communities_cover_every_node(name, spark, sf_dir):
    from weftline.plans.kgview import nodes

    found = registry.QUERIES[name](spark, sf_dir)
    assert sorted(r["id"] for r in found.select("id").collect()) == sorted(r["id"] for r in nodes(spark, sf_dir).select("id").collect())


def test_split_sees_all_relations(spark, sf_dir, monkeypatch):
    from weftline.operators import community

    given = []
    monkeypatch.setattr(community, "split_large", lambda members, pairs: given.append(pairs) or members)
    registry.QUERIES["split_oversized"](spark, sf_dir)
    assert given[0].count() == graph.simple(edges(spark, sf_dir)).count()


def test_nodes_without_edges_are_communities(spark):
    from weftline.operators import community

    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "u string, v string")
    ids = spark.createDataFrame([(k,) for k in "abcde"], "id string")
    for found in (community.propagate(pairs, ids=ids), community.louvain(pairs, ids=ids)):
        got = dict(found.collect())
        assert got["d"] == 1 and got["e"] == 2 and got.keys() == set("abcde")


def test_split_gives_lone_members_parts(spark):
    from weftline.operators import community

    members = spark.createDataFrame([(f"n{i:02}", 0) for i in range(12)] + [("x", 1)], "id string, community int")
    pairs = spark.createDataFrame([("n00", "n01"), ("n02", "x")], "u string, v string")
    got = {r["id"]: r["part"] for r in community.split_large(members, pairs).collect()}
    assert got.pop("x") is None and got["n00"] == got["n01"] is not None
    assert len(set(got.values())) == 11 and None not in got.values()


def test_remap_follows_long_chains(spark):
    """Each round can settle one pair only: new i overlaps old 50 - i, and old 51 - i a little more."""
    from weftline.operators import community

    rows = []
    for i in range(15):
        rows += [(f"{i}-{k}", i, 50 - i) for k in range(40 - 2 * i)]
        rows += [(f"{i}+{k}", i, 51 - i) for k in range(41 - 2 * i)] if i else []
    both = spark.createDataFrame(rows, "id string, new int, old int")
    got = community.remap(both.selectExpr("id", "new as community"), both.selectExpr("id", "old as community"))
    assert dict(got.collect()) == {i: 50 - i for i in range(15)}
