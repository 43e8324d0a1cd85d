"""Each registered query against its SQL."""

import pytest
from compare import assert_same, duck

from weftline.plans import registry

registry.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(name, spark, sf_dir, con):
    assert_same(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE_SQL[name])


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_communities_cover_all_nodes_once(spark, sf_dir):
    from weftline.operators import community, graph

    found = registry.QUERIES["detected_communities"](spark, sf_dir)
    assert found.count() == found.select("id").distinct().count() > 0
    from weftline.plans.kgview import links, nodes

    assert found.count() == nodes(spark, sf_dir).count()
    assert -0.5 <= community.modularity(found, graph.simple(links(spark, sf_dir))).first()[0] <= 1


def test_louvain_finds_cliques(spark):
    from weftline.operators import community

    cliques = [(f"{c}{i}", f"{c}{j}") for c in "abcd" for i in range(6) for j in range(i)]
    bridges = [("a0", "b0"), ("b1", "c1"), ("c2", "d2"), ("d3", "a3")]
    pairs = spark.createDataFrame(cliques + bridges, "u string, v string")
    found = community.louvain(pairs)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["community"], set()).add(r["id"][0])
    assert sorted(len(g) for g in groups.values()) == [1, 1, 1, 1]
    assert community.modularity(found, pairs).first()[0] > 0.6


def test_remap_keeps_old_ids(spark, sf_dir):
    got = {r["community"]: r["stable"] for r in registry.QUERIES["remap_previous"](spark, sf_dir).collect()}
    assert got == {k: (k - 2) % 5 for k in range(5)}


def test_query_graph_keeps_its_budget(spark, sf_dir):
    rows = registry.QUERIES["query_graph"](spark, sf_dir).collect()
    assert rows and max(r["used"] for r in rows) <= 6000


def test_slices_cover_texts(spark):
    from weftline.sources.slices import ranges

    for text in ("", "abc", "# a\nb\n\nc\n# d" * 50, "x" * 999, "\n" * 300):
        for most in (1, 7, 100):
            got = ranges(text, most)
            assert "".join(text[a:b] for a, b in got) == text
            assert all(b - a <= most for a, b in got)


def test_fuzzy_merge_joins_typos_only(spark):
    from weftline.operators.dedup import fuzzy_components

    rows = [
        ("a", "asset contribution flow handler"), ("b", "asset contributon flow handler"), ("c", "asset consumption flow handler"),
        ("d", "adr 0011 storage layout decision"), ("e", "adr 0012 storage layout decision"), ("f", "Asset  Contribution Flow-Handler"),
    ]
    got = dict(fuzzy_components(spark.createDataFrame(rows, "id string, label string")).collect())
    assert got["b"] == got["f"] == got["a"] == "a" and got["c"] == "c" and got["d"] == "d" and got["e"] == "e"


def test_shortest_path_directed_and_missing(spark):
    from weftline.operators.graph import shortest_path

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("d", "d")], "src string, dst string")
    got = sorted(tuple(r) for r in shortest_path(e, "a", "d").collect())
    assert got == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert shortest_path(e, "d", "a").count() == 0
    assert shortest_path(e, "d", "a", directed=False).count() == 4
    assert shortest_path(e, "a", "a").count() == 1


def test_degrees_count_self_loops_twice(spark):
    from weftline.operators.graph import degrees, simple

    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a")], "src string, dst string")
    assert dict(degrees(n, simple(e)).select("id", "degree").collect()) == {"a": 3, "b": 1, "c": 0}


def test_graph_json_variants(spark, tmp_path):
    from weftline.sources.graph_json import read_graph

    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "name": "A"}, {"label": "no id"}], "edges": [{"from": "a", "to": "b", "type": "calls"}]}')
    nodes, edges = read_graph(spark, str(tmp_path / "g.json"))
    assert [(r["id"], r["label"]) for r in nodes.collect()] == [("a", "A")]
    assert [(r["src"], r["dst"], r["relation"]) for r in edges.collect()] == [("a", "b", "calls")]


def test_shrinking_state_is_refused(spark):
    from weftline.streaming.sessions import merge_state

    kind = "id string, source_file string, origin string"
    state = spark.createDataFrame([(f"n{i}", "a.py", "ast") for i in range(10)], kind)
    with pytest.raises(ValueError):
        merge_state(state, spark.createDataFrame([("n1", "a.py", "ast")], kind))
    assert merge_state(state, spark.createDataFrame([("x", "b.py", "ast")], kind)).count() == 11


def test_stream_sessions_match_the_batch(spark, sf_dir, tmp_path):
    from weftline.streaming import sessions as S

    stream = S.debounced(S.event_stream(spark, sf_dir), "30 minutes", key="user_id", late="10 minutes")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["user_id"], r["start"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["user_id"], r["start"]): r["n"] for r in registry.QUERIES["user_sessions"](spark, sf_dir).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert len(want) - len(got) <= 30  # the last ones stay open until the watermark passes


def test_extractors_and_sinks(spark, tmp_path):
    from weftline.sinks.formats import write_lines

    write_lines(spark.createDataFrame([("a",), ("b",)], "line string"), str(tmp_path / "lines"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a", "b"]


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10


def test_extractors():
    from weftline.sources import extract as X

    py = list(X.python_rows("import os\nfrom a.b import c\nclass K(Base):\n    def m(self):\n        f(1)\ndef f(x): pass\n", "src/x.py"))
    assert [r[2] for r in py if r[0] == "node"] == ["x.py", "K", ".m()", "f()"]
    assert {(r[1], r[4], r[5]) for r in py if r[0] != "node"} == {
        ("src_x", "os", "imports"), ("src_x", "a.b.c", "imports_from"), ("src_x", "src_x_K", "contains"), ("src_x_K", "Base", "inherits"),
        ("src_x_K", "src_x_K_m", "method"), ("src_x_K_m", "f", "calls"), ("src_x", "src_x_f", "contains"),
    }
    assert list(X.python_rows("def (", "x.py")) == []
    md = list(X.markdown_rows("# A\n## B\n[l](y.md)\n```\n# no\n```\n# C\n", "d.md"))
    assert [(r[1], r[4], r[5]) for r in md if r[0] == "edge"] == [("d", "d_1", "contains"), ("d_1", "d_2", "contains"), ("d_2", "y.md", "references"), ("d", "d_7", "contains")]
    sql = "CREATE TABLE a (id int, b_id int REFERENCES b(id)); create view v as with w as (select * from c) select * from w join a on 1=1;"
    assert {(r[1], r[4], r[5]) for r in X.sql_rows(sql, "s.sql") if r[0] == "edge"} == {("a", "b", "references"), ("v", "c", "reads_from"), ("v", "a", "reads_from")}


def test_extraction_of_files(spark):
    from weftline.sources.extract import extract

    f = spark.createDataFrame([("a.py", "def f(): pass"), ("b.md", "# T"), ("c.xyz", "?"), (None, "x"), ("d.py", None)], "path string, text string")
    assert {r["source_file"] for r in extract(f).collect()} == {"a.py", "b.md"}


def test_ignore_rules():
    from weftline.operators.paths import rule_regex

    import re

    hit = lambda rule, path: bool(re.match(rule_regex(rule)[0], path))
    assert hit("*.md", "a/b.md") and hit("build/", "x/build") and not hit("/build", "x/build") and hit("a/**/b", "a/x/y/b") and hit("a/**/b", "a/b")
    assert hit("a/**", "a/x/y") and not hit("a?c", "a/c") and rule_regex("!x")[1]


def test_betweenness_against_enumeration(spark):
    from weftline.operators.centrality import betweenness

    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "e"), ("e", "d")], "u string, v string")
    got = dict(betweenness(pairs, sources=10).collect())
    # pairs through b: a-c, a-d (all), a-e, c-e (half, the other half through d); through c and e: a-d and b-d by halves
    assert got == {"b": 7.0, "c": 2.0, "e": 2.0, "d": 1.0}


def test_split_large_keeps_all_members(spark, sf_dir):
    out = registry.QUERIES["split_oversized"](spark, sf_dir)
    assert out.count() == out.select("id").distinct().count()


def test_memory_note_round_trip(spark):
    from pyspark.sql import functions as F

    from weftline.sources.memory import parse_memory, write_memory

    df = spark.createDataFrame([('why "so"?', "because", "useful", ["n1", "n 2"])], "q string, a string, o string, n array<string>")
    text = df.select(write_memory(F.col("q"), F.col("a"), F.col("o"), F.col("n")).alias("text"))
    r = parse_memory(text, "text").first()
    assert (r["question"], r["outcome"], r["source_nodes"]) == ("why 'so'?", "useful", ["n1", "n 2"])


def test_library_runs_without_the_llm_package():
    """The rest imports and lists its queries when the optional folders are gone."""
    import os
    import shutil
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(os.path.join(root, "weftline"), os.path.join(d, "weftline"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(root, "__spark_entry__.py"), d)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'god_nodes' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
        subprocess.run([sys.executable, "-c", code], cwd=d, check=True, env=os.environ | {"PYTHONPATH": d})
