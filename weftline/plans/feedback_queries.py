"""Queries on feedback (events as answers) and change requests (orders)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback as B
from .kgview import table
from .registry import query

NOW = "2024-06-01 00:00:00"
DOC_SQL = """d AS (SELECT 'n' || (user_id % 23) AS node, CASE event_type WHEN 'purchase' THEN 'useful' WHEN 'click' THEN 'useful' WHEN 'error' THEN 'dead_end' WHEN 'signup' THEN 'corrected' END AS outcome,
 ts AS date, 'c' || (user_id % 4) AS community, event_id AS id, 'q' || (event_id % 37) AS question FROM events),
 w AS (SELECT *, CASE WHEN outcome = 'useful' THEN 1 ELSE -1 END AS s, (CASE WHEN outcome = 'useful' THEN 1 ELSE -1 END) * pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(date)) / 86400e6) / 30.0) AS w FROM d WHERE outcome IS NOT NULL)"""
AGG = "round(sum(w), 6) AS score, count(*) FILTER (s > 0) AS pos, count(*) FILTER (s < 0) AS neg, max(date) AS last"


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    outcome = F.when(t.isin("purchase", "click"), "useful").when(t == "error", "dead_end").when(t == "signup", "corrected")
    k = lambda c, n, p: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    return table(spark, sf_dir, "events").select(
        k("user_id", 23, "n").alias("node"), outcome.alias("outcome"), F.col("ts").alias("date"), k("user_id", 4, "c").alias("community"),
        F.col("event_id").alias("id"), k("event_id", 37, "q").alias("question"),
    )


def _round(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("lessons_scores", f"WITH {DOC_SQL} SELECT node, {AGG} FROM w GROUP BY node")
def lessons_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(B.scores(memory(spark, sf_dir), NOW))


@query("lessons_by_community", f"WITH {DOC_SQL} SELECT node, community, {AGG} FROM w GROUP BY GROUPING SETS ((node), (node, community))")
def lessons_by_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(B.scores(memory(spark, sf_dir), NOW, by_community=True))


@query(
    "lessons_buckets",
    f"""WITH {DOC_SQL}, g AS (SELECT node, {AGG} FROM w GROUP BY node)
 SELECT node, score, pos, neg, CASE WHEN pos > 0 AND neg > 0 THEN 'contested' WHEN pos >= 2 THEN 'preferred' ELSE 'tentative' END AS bucket,
 CASE WHEN pos > 0 AND neg > 0 THEN CASE WHEN score > 0 THEN 'useful' WHEN score < 0 THEN 'dead end' ELSE 'even' END END AS verdict FROM g WHERE pos > 0""",
)
def lessons_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.buckets(_round(B.scores(memory(spark, sf_dir), NOW))).drop("last")


@query("dedupe_by_question", f"WITH {DOC_SQL} SELECT question, max(date) AS date, arg_max(id, row(date, id)) AS id FROM d WHERE outcome = 'corrected' GROUP BY question")
def dedupe_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.latest_by_question(memory(spark, sf_dir).where("outcome = 'corrected'"))


@query("plurality_community", f"WITH {DOC_SQL}, n AS (SELECT question, community, count(*) AS n FROM d GROUP BY ALL) SELECT question, arg_min(community, row(-n, community)) AS community FROM n GROUP BY question")
def plurality_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.plurality(memory(spark, sf_dir), "question", "community")


@query("outcome_counts", f"WITH {DOC_SQL} SELECT coalesce(outcome, 'unmarked') AS outcome, count(*) AS n FROM d GROUP BY 1")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir).groupBy(F.coalesce("outcome", F.lit("unmarked")).alias("outcome")).agg(F.count("*").alias("n"))


PR_SQL = """pr AS (SELECT o_orderkey AS pr, CASE WHEN o_orderkey % 10 = 0 THEN 'dev' ELSE 'main' END AS base_branch, CASE o_orderstatus WHEN 'F' THEN 'FAILURE' WHEN 'P' THEN 'PENDING' ELSE 'SUCCESS' END AS ci_status,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CHANGES_REQUESTED' WHEN '2' THEN 'APPROVED' END AS review_decision, o_orderkey % 7 = 0 AS is_draft, date_diff('day', o_orderdate::DATE, DATE '2001-08-02') AS days_old, o_custkey FROM orders),
 st AS (SELECT *, CASE WHEN base_branch <> 'main' THEN 'WRONG-BASE' WHEN ci_status = 'FAILURE' THEN 'CI-FAIL' WHEN review_decision = 'CHANGES_REQUESTED' THEN 'CHANGES-REQ' WHEN is_draft THEN 'DRAFT' WHEN days_old >= 14 THEN 'STALE'
 WHEN review_decision = 'APPROVED' THEN 'APPROVED' WHEN ci_status = 'PENDING' THEN 'PENDING' ELSE 'READY' END AS status FROM pr)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pr"), F.when(F.col("o_orderkey") % 10 == 0, "dev").otherwise("main").alias("base_branch"),
        F.when(F.col("o_orderstatus") == "F", "FAILURE").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("SUCCESS").alias("ci_status"),
        F.when(first == "1", "CHANGES_REQUESTED").when(first == "2", "APPROVED").alias("review_decision"),
        (F.col("o_orderkey") % 7 == 0).alias("is_draft"), F.datediff(F.lit("2001-08-02").cast("date"), F.to_date("o_orderdate")).alias("days_old"), "o_custkey",
    )
    return o.withColumn("status", B.status("main"))


@query("pr_status", f"WITH {PR_SQL} SELECT pr, status FROM st")
def pr_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("pr", "status")


@query(
    "pr_ranked",
    f"""WITH {PR_SQL} SELECT pr, status FROM st ORDER BY list_position(['WRONG-BASE', 'CI-FAIL', 'CHANGES-REQ', 'DRAFT', 'STALE', 'PENDING', 'APPROVED', 'READY'], status) DESC, pr LIMIT 40""",
)
def pr_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, B.STATUS_ORDER)), F.col("status"))
    return requests(spark, sf_dir).select("pr", "status").orderBy(place.desc(), "pr").limit(40)


@query(
    "pr_conflicts",
    f"""WITH {PR_SQL} SELECT n_regionkey AS community, count(*) AS n, min(pr) AS first, max(pr) AS last FROM st JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
 WHERE status NOT IN ('WRONG-BASE', 'DRAFT', 'STALE') GROUP BY 1 HAVING count(*) > 1""",
)
def pr_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = requests(spark, sf_dir).where("status not in ('WRONG-BASE', 'DRAFT', 'STALE')")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    touched = open_.join(c, F.col("o_custkey") == F.col("c_custkey")).select("pr", F.col("n_regionkey").alias("community"))
    return B.conflicts(touched)
