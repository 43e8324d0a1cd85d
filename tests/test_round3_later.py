"""What the later findings of round 3 asked for."""

from __future__ import annotations

import random


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_betweenness_keeps_a_row_for_a_node_not_for_each_source(spark, monkeypatch):
    from weftline.operators import centrality

    r, rows = random.Random(3), []
    pairs = sorted({tuple(sorted((f"n{r.randrange(40)}", f"n{r.randrange(40)}"))) for _ in range(90)})
    kept = centrality.checkpointed
    monkeypatch.setattr(centrality, "checkpointed", lambda df: rows.append(kept(df)) or rows[-1])
    df = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "u string, v string")
    all_ = dict(centrality.betweenness(df, 40).collect())
    assert max(x.count() for x in rows if "v" in x.columns) <= 40
    monkeypatch.setattr(centrality, "WIDTH", 7)  # several runs of sources side by side
    again = dict(centrality.betweenness(df, 40).collect())
    assert all_.keys() == again.keys() and all(abs(all_[k] - again[k]) < 1e-5 for k in all_)


def test_url_models_count_every_url(spark, monkeypatch):
    from weftline.llm import queries, url_lm

    seen, plain = [], url_lm.gains
    monkeypatch.setattr(url_lm, "gains", lambda counted, order: seen.append(counted) or plain(counted, order))
    urls = [f"http://a{i}.org/x" for i in range(9000)] + ["http://b.com/de/y", "http://c.net/é😀"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_lm.filter_urls(df, queries.URL_RULES).collect()}
    assert len(got) == len(urls) and got[9001]["score"] is not None
    from zlib import crc32

    ends = seen[0].where("gram like '%org/x\0'").groupBy().sum("a").first()[0]
    assert ends == sum(crc32(u.encode()) % 5 != 0 for u in urls[:9000])


def test_orders_are_written_once_and_only_what_is_asked_for_is_kept(spark, monkeypatch):
    from weftline.operators import ancestry

    kept, sizes = ancestry.stored, []

    def counted(df):
        out = kept(df)
        if "pos" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(ancestry, "stored", counted)
    chain = [(f"t{i}", "inherit", 1, f"t{i - 1}") for i in range(1, 9)]
    alone = [(f"a{i}",) for i in range(300)]
    types = spark.createDataFrame([(f"t{i}",) for i in range(9)] + alone, "type string")
    found = ancestry.linearised(types, spark.createDataFrame(chain, "type string, kind string, ord int, of string"))
    assert found.count() == 300 + 45 and found.where("type = 't8' and at = 't0'").first()["pos"] == 9
    assert sum(sizes) < 500  # 300 types that nobody asks for are not written again each round


def test_ends_that_are_ids_do_not_meet_in_one_task(spark):
    from pyspark.sql import functions as F

    from weftline.operators.resolve import resolve_ends

    ids = spark.createDataFrame([(f"n{i}",) for i in range(400)] + [("x_1",), ("N5",)], "id string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(399)] + [("X 1", "n0"), ("gone", "N 5")], "src string, dst string")
    for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.set(k, "false" if "adaptive" in k else "-1")
    try:
        found = resolve_ends(edges, ids, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9_]+", "_"))
        got = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
    assert {(r["src"], r["dst"]) for r in got} == {(f"n{i}", f"n{i + 1}") for i in range(399)} | {("x_1", "n0"), (None, None)}
    sizes = [r["task"] for r in got]
    assert max(sizes.count(t) for t in set(sizes)) < 200


def test_differences_read_the_edges_once(spark, sf_dir):
    import __spark_entry__

    plan = _plan(__spark_entry__.queries()["graph_diff_edges"](spark, sf_dir))
    assert sum("l_orderkey" in x and "Relation" in x for x in plan.splitlines()) == 1 and "p_brand" not in plan


def test_notes_deal_neighbours_out_once(spark):
    from weftline.sinks import pages

    nodes = spark.createDataFrame([(x, x.upper(), "code", 1) for x in "abc"], "id string, label string, file_type string, community int")
    links = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "c"), ("a", "b"), ("b", "b")], "src string, dst string")
    found = pages.vault_notes(nodes, links, 1)
    assert {r["id"]: r["note"].split("\n")[-1] for r in found.collect()} == {"a": "- [[B]]", "b": "- [[A]]", "c": "- [[A]]"}
    lines = _plan(found).splitlines()
    at = next(i for i, x in enumerate(lines) if "dense_rank" in x)
    assert not any("Aggregate" in x for x in lines[at + 1 : at + 5])


def test_call_tables_find_what_is_shown_once(spark, sf_dir):
    import __spark_entry__

    plan = _plan(__spark_entry__.queries()["call_tables"](spark, sf_dir))
    assert "row_number() windowspecdefinition(section" not in plan and "n_nationkey" in plan  # links are read, ranks of nodes are not found again
