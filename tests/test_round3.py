"""What round 3's findings asked for."""

from __future__ import annotations

from weftline.operators import community


def test_communities_go_round_with_numbers(spark):
    pairs = spark.createDataFrame([("b", "a"), ("b", "c"), ("c", "c"), ("é", "a")], "u string, v string")
    known, around = community.by_number(pairs)
    assert {r["id"]: r["n"] for r in known.collect()} == {"a": 0, "b": 1, "c": 2, "é": 3}
    assert dict(around.dtypes) == {"a": "bigint", "b": "bigint"}
    assert sorted(map(tuple, around.collect())) == [(0, 1), (0, 3), (1, 0), (1, 2), (2, 1), (3, 0)]


def test_searches_count_degrees_once_and_take_edges_as_they_are(spark):
    from pyspark.sql import functions as F

    from weftline.operators import graph

    edges = [("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "d"), ("d", "e")]
    pairs = spark.createDataFrame(edges, "u string, v string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def told(d):
        seen.add(1)
        return d

    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    degreed = nodes.withColumn("degree", told(F.lit(2).cast("long") + F.length("id") * 0))
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r) for r in graph.khop(seeds, pairs, degreed, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert seen.value == 6
    assert {tuple(r) for r in graph.dfs(seeds, pairs, degreed, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert seen.value == 12


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_of_one_line_are_swept_once(spark):
    from weftline.operators import nesting

    scopes = spark.createDataFrame([("f", 1, 9, "a"), ("f", 3, 5, "b"), (None, 1, 2, "c")], "path string, start int, end int, id string")
    rows = [("f", 4, "x"), ("f", 4, "y"), ("f", 4, "y"), ("f", 8, "z"), ("f", 20, "o"), ("f", None, "n"), ("g", 4, "g"), (None, 1, "q")]
    found = nesting.innermost(scopes, spark.createDataFrame(rows, "path string, line int, member string"))
    assert sorted(((r["member"], r["scope"]) for r in found.collect()), key=str) == sorted([("x", "b"), ("y", "b"), ("y", "b"), ("z", "a"), ("o", None), ("n", None), ("g", None), ("q", "c")], key=str)
    assert "member" not in next(x for x in _plan(found).splitlines() if "FlatMapCoGroups" in x)


def test_votes_take_repeated_pairs_once(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("a", "c"), ("d", "a"), ("a", "a")], "u string, v string")
    members = spark.createDataFrame([("a", 9), ("b", 1), ("c", 2), ("d", 2)], "id string, community int")
    assert [tuple(r) for r in community.vote(spark.createDataFrame([("a",)], "id string"), members, pairs).collect()] == [("a", 2)]


def test_diagnoses_read_no_files_and_deal_no_values(spark, sf_dir):
    import __spark_entry__

    for name in ("diagnosis_report", "collapse_simple_graph", "duplicate_pair_examples"):
        plan = _plan(__spark_entry__.queries()[name](spark, sf_dir))
        assert "Inner, (l_" not in plan and "Expand" not in plan
    assert "Expand" not in _plan(__spark_entry__.queries()["diagnose_edges"](spark, sf_dir))
