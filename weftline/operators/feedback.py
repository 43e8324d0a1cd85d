"""Lessons from past answers, and the state of change requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS_ORDER = ("WRONG-BASE", "CI-FAIL", "CHANGES-REQ", "DRAFT", "STALE", "PENDING", "APPROVED", "READY")


def decay(date: Column, now: str, half_life_days: float = 30.0) -> Column:
    """0.5 to the age in half lives; undated ones and those to come count in full."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(date.cast("timestamp"))) / 86400e6
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / half_life_days), F.lit(1.0))


def sign(outcome: Column) -> Column:
    return F.when(outcome == "useful", 1).when(outcome.isin("dead_end", "corrected"), -1).otherwise(0)


def scores(docs: DataFrame, now: str, half_life_days: float = 30.0, by_community: bool = False) -> DataFrame:
    """node, score, pos, neg, last; with by_community also each community's own rows, told by
    community (null: over all). docs: node (exploded), outcome, date, community."""
    s = sign(F.col("outcome"))
    signed = docs.withColumns({"_s": s, "_w": s * decay(F.col("date"), now, half_life_days)}).where("_s <> 0")
    measures = [F.round(F.sum("_w"), 9).alias("score"), F.count_if(F.col("_s") > 0).alias("pos"), F.count_if(F.col("_s") < 0).alias("neg"), F.max("date").alias("last")]
    if not by_community:
        return signed.groupBy("node").agg(*measures)
    return signed.groupingSets([[F.col("node")], [F.col("node"), F.col("community")]], "node", "community").agg(*measures)


def buckets(scored: DataFrame, least: int = 2) -> DataFrame:
    """bucket and verdict: contested with votes of both signs; preferred or tentative with
    positive ones only; rows with negative ones only are left out."""
    pos, neg, score = F.col("pos"), F.col("neg"), F.col("score")
    bucket = F.when((pos > 0) & (neg > 0), "contested").when(pos >= least, "preferred").when(pos > 0, "tentative")
    verdict = F.when(bucket == "contested", F.when(score > 0, "useful").when(score < 0, "dead end").otherwise("even"))
    return scored.withColumns({"bucket": bucket, "verdict": verdict}).where("bucket is not null")


def latest_by_question(items: DataFrame) -> DataFrame:
    return items.groupBy("question").agg(F.max_by(F.struct("date", "id"), F.struct("date", "id")).alias("r")).select("question", "r.*")


def plurality(members: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the first by order of equals."""
    n = members.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def status(base: str, stale_days: int = 14) -> Column:
    """Of columns base_branch, ci_status, review_decision, is_draft, days_old."""
    return (
        F.when(F.col("base_branch") != base, "WRONG-BASE")
        .when(F.col("ci_status") == "FAILURE", "CI-FAIL")
        .when(F.col("review_decision") == "CHANGES_REQUESTED", "CHANGES-REQ")
        .when(F.col("is_draft"), "DRAFT")
        .when(F.col("days_old") >= stale_days, "STALE")
        .when(F.col("review_decision") == "APPROVED", "APPROVED")
        .when(F.col("ci_status") == "PENDING", "PENDING")
        .otherwise("READY")
    )


def conflicts(touched: DataFrame) -> DataFrame:
    """community, n, prs: communities that several requests touch. touched: pr, community."""
    g = touched.distinct().groupBy("community").agg(F.count("*").alias("n"), F.min("pr").alias("first"), F.max("pr").alias("last"))
    return g.where("n > 1")
