"""Reports and routine recovery by example."""

import datetime as dt

from weftline.operators import reports
from weftline.sources.extract import sql_masked, sql_routines
from weftline.sources.office import sidecars


def test_diagnosis_lines(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = [("a", "b", "calls", "L1"), ("a", "b", "uses", "L2"), ("b", "a", "calls", None), ("a", "x", "calls", None), (None, "a", "calls", None), ("b", "b", "calls", None)]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string, source_location string")
    lines = [r["line"] for r in reports.diagnosis(nodes, edges).orderBy("k").collect()]
    assert lines == ["n_edges: 6", "missing_end: 1", "dangling: 1", "self_loops: 1", "duplicates_directed: 1", "duplicates_undirected: 2", "relation_variants: 1", "location_variants: 1", "loses 3 of 6 edges", "a -> b x2 (calls, uses)"]
    both = [r["line"] for r in reports.diagnosis(nodes, edges, directed=False).orderBy("k").collect()]
    assert both[8:] == ["loses 4 of 6 edges", "a -- b x3 (calls, uses)"]
    assert [r["line"] for r in reports.diagnosis(nodes, edges.limit(0)).orderBy("k").collect()][8:] == ["loses nothing"]


def test_reflected_lessons(spark):
    at = lambda d: dt.datetime(2026, 5, d)
    docs = [(1, "n", "useful", at(1), "q1"), (2, "n", "useful", at(2), "q2"), (3, "n", "useful", at(2), "q3"), (4, "m", "dead_end", at(3), "q4"), (5, "gone", "useful", at(3), "q5"), (6, "k", "useful", at(1), "q6"), (7, "k", "corrected", at(4), "q7"), (8, "n", None, at(9), "q8")]
    got = reports.reflected(spark.createDataFrame(docs, "id int, node string, outcome string, date timestamp, question string"), spark.createDataFrame([("n", 1), ("m", 1), ("k", 2)], "id string, community int"), "2026-06-01", recent=2)
    assert {r["node"]: (r["community"], r["bucket"], r["verdict"], r["recent"]) for r in got.collect()} == {
        "n": (1, "preferred", None, ["q3", "q2"]), "m": (1, "dead_end", None, ["q4"]), "k": (2, "contested", "dead end", ["q7", "q6"]),
    }


def test_routines_after_broken_statements():
    text = """CREATE TABLE t (a INT
CREATE OR REPLACE FUNCTION a.b() AS $x$ 'it''s' CREATE FUNCTION no() $x$;
-- CREATE FUNCTION no()
/* /* */ CREATE FUNCTION no() */ CREATE PROC [my proc] AS
SELECT 'CREATE TRIGGER no', "CREATE TRIGGER no" FROM x;
CREATE TRIGGER IF NOT EXISTS "T 1" AFTER; RECREATE FUNCTION no(); CREATE
  AGGREGATE FUNCTION agg(x);
'open CREATE FUNCTION no()"""
    assert sql_routines(text) == [("function", "a.b", 2), ("procedure", "my proc", 4), ("trigger", "T 1", 6), ("function", "agg", 6)]
    assert len(sql_masked(text)) == len(text) and sql_masked(text).count("\n") == text.count("\n")
    assert sql_routines("") == [] and sql_routines("/* CREATE FUNCTION x()") == sql_routines("$$ CREATE FUNCTION x()") == []


def test_sidecars(spark):
    rows = [("a/x.docx", 5, "text"), ("b/x.docx", 5, "text"), ("c.docx", 5, " \n\t"), ("d.docx", 5, None), ("caf\u00e9.xlsx", 5, "t"), ("cafe\u0301.xlsx", 5, "t"), (None, 1, "t"), (".docx", 1, "t")]
    df = spark.createDataFrame(rows, "path string, time long, text string")
    none = spark.createDataFrame([], "name string, time long")
    got = {r["path"]: r for r in sidecars(df, none).collect()}
    assert got.keys() == {"a/x.docx", "b/x.docx", "caf\u00e9.xlsx", "cafe\u0301.xlsx", ".docx"}
    assert got["a/x.docx"]["name"] != got["b/x.docx"]["name"] and got["a/x.docx"]["content"] == "<!-- converted from x.docx -->\n\ntext"
    assert got["caf\u00e9.xlsx"]["name"].rpartition("_")[2] == got["cafe\u0301.xlsx"]["name"].rpartition("_")[2] and got[".docx"]["name"].startswith(".docx_")
    have = spark.createDataFrame([(got["a/x.docx"]["name"], 5), (got["b/x.docx"]["name"], 4)], "name string, time long")
    assert {r["path"] for r in sidecars(df, have).collect()} == got.keys() - {"a/x.docx"}
