"""Queries on the event stream, run over the whole table as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import live
from ..streaming import sessions as S
from .kgview import table
from .registry import query

ISLANDS = """e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (ORDER BY ts, event_id)),
 s AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) AS k FROM e)"""


@query("debounce_sessions", f"""WITH {ISLANDS} SELECT min(ts) AS start, max(ts) + INTERVAL 5 MINUTE AS "end", count(*) AS n FROM s GROUP BY k""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.debounced(table(spark, sf_dir, "events"), "5 minutes").drop("kinds")


@query(
    "batch_triggers",
    f"""WITH {ISLANDS} SELECT min(ts) AS start, bool_or(event_type IN ('purchase', 'signup')) AS rebuild, bool_or(event_type NOT IN ('purchase', 'signup')) AS notify FROM s GROUP BY k""",
)
def batch_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.triggers(S.debounced(table(spark, sf_dir, "events"), "5 minutes"), ("purchase", "signup")).select("start", "rebuild", "notify")


@query(
    "user_sessions",
    """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.debounced(table(spark, sf_dir, "events"), "30 minutes", key="user_id").select("user_id", "start", "n")


@query("pending_drain", "SELECT 'u' || user_id AS path, max(ts) AS seen FROM events GROUP BY 1")
def pending_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("ts").alias("seen")))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


LIVE = {
    "path": "'f' || (event_id % 70)",
    "seen": "ts",
    "deleted": "event_type = 'error'",
}


@query(
    "live_links",
    """WITH e AS (SELECT 'f' || (event_id % 70) AS path, date_trunc('millisecond', ts) AS seen, event_type = 'error' AS deleted, list_sort(list_distinct(['f' || (event_id * 7 % 90), 'f' || user_id])) AS links FROM events),
 f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY seen DESC, deleted DESC, links DESC) = 1),
 l AS (SELECT path AS source, unnest(links) AS target FROM f WHERE NOT deleted)
 SELECT source, target, CASE WHEN target IN (SELECT path FROM f WHERE NOT deleted) THEN 'bound' ELSE 'dangling' END AS state FROM l""",
)
def live_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream of live.file_deltas and live.bound_log comes to, over the whole table at once."""
    links = F.expr("array(concat('f', event_id * 7 % 90), concat('f', user_id))")
    e = table(spark, sf_dir, "events").select(*(F.expr(v).alias(k) for k, v in LIVE.items()), links.alias("links"))
    return live.rebuilt(e)
