"""The live rebuild: after stops and restarts the stream has what the batch has."""

import datetime as dt
import random

import pytest

from weftline.streaming import live

EVENTS = "path string, seen timestamp, links array<string>, deleted boolean"
START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, old)


def run(spark, folder):
    """Both queries, over what is there; they go on where they stopped."""
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    steps = ((live.file_deltas(events), "deltas"), (None, "log"))
    for df, name in steps:
        df = live.bound_log(spark.readStream.schema(live.DELTAS).parquet(f"{folder}/deltas")) if df is None else df
        q = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state-{name}").trigger(availableNow=True).start(f"{folder}/{name}")
        q.awaitTermination(600)
        assert q.exception() is None


def put(spark, folder, rows, n):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events")


def found(df):
    return sorted(map(tuple, df.select("source", "target", "state").collect()))


def test_stream_after_restart_equals_the_batch(rocks, tmp_path):
    rnd, at = random.Random(3), 0.0
    names = [f"f{i}" for i in range(9)]
    (tmp_path / "deltas").mkdir()
    for n in range(3):
        rows = []
        for _ in range(25):
            at += rnd.choice([0.3, 1.0, 4.0])
            links = None if rnd.random() < 0.1 else [rnd.choice([*names, "gone", None]) for _ in range(rnd.randint(0, 4))]
            rows.append((rnd.choice(names), START + dt.timedelta(seconds=at), links, rnd.random() < 0.2))
        rows += [(None, START, ["f1"], False)]
        at += 100  # a later event lets the timers of earlier ones fire
        rows.append(("tick", START + dt.timedelta(seconds=at), [], False))
        put(rocks, tmp_path, rows, n)
        run(rocks, tmp_path)
    at += 100
    put(rocks, tmp_path, [("tock", START + dt.timedelta(seconds=at), [], True)], 3)
    run(rocks, tmp_path)
    events = rocks.read.schema(EVENTS).parquet(f"{tmp_path}/events")
    want = found(live.rebuilt(events))
    assert want and {s for *_, s in want} == {"bound", "dangling"}
    assert found(live.current(rocks.read.schema(live.LOG).parquet(f"{tmp_path}/log"))) == want


def test_a_change_touches_its_own_links_only(rocks, tmp_path):
    (tmp_path / "deltas").mkdir()
    t = lambda s: START + dt.timedelta(seconds=s)
    put(rocks, tmp_path, [("a", t(0), ["b", "c"], False), ("b", t(0), ["c"], False), ("c", t(0), ["a"], False), ("tick", t(100), [], False)], 0)
    run(rocks, tmp_path)
    before = rocks.read.schema(live.LOG).parquet(f"{tmp_path}/log").count()
    assert before == 4
    put(rocks, tmp_path, [("b", t(200), ["c"], True), ("a", t(200), ["c", "b"], False), ("tick", t(300), [], False)], 1)
    run(rocks, tmp_path)
    log = rocks.read.schema(live.LOG).parquet(f"{tmp_path}/log")
    assert log.count() == before + 2  # a to b dangles, b to c is gone
    assert found(live.current(log)) == [("a", "b", "dangling"), ("a", "c", "bound"), ("c", "a", "bound")]


def test_rebuilt_with_odd_events(spark):
    rows = [("a", START, None, None), ("a", START, ["b", None, "b"], False), ("b", None, ["a"], False), ("c", START, ["a"], False), ("c", START, ["a"], True), ("d", START, ["a", "d"], None)]
    assert found(live.rebuilt(spark.createDataFrame(rows, EVENTS))) == [("a", "b", "dangling"), ("d", "a", "bound"), ("d", "d", "bound")]
    assert live.rebuilt(spark.createDataFrame([], EVENTS)).count() == 0
