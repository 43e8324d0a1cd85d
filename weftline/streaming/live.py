"""Links kept up to date on a stream of file changes, by what changed alone.

Two stateful steps, each a query of its own with its own checkpoint, so that either can be stopped and
started again. file_deltas() holds, per file, the links that it had: a change becomes the links
it gained and lost, once the file has been quiet for a while (a timer). bound_log() holds, per
target, whether it exists and who links to it (an inverted index): a target that appears or goes
binds or frees the links to it, and no others are looked at. rebuilt() is the same for a
whole table at once.

The state store has to be RocksDB's: `spark.sql.streaming.stateStore.providerClass` =
`org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELTAS = "target string, source string, change int"
LOG = "source string, target string, state string, turn long"


class FileDeltas(StatefulProcessor):
    """Per path: the links it has (none if it isn't there), and its last change that still waits."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.here = handle.getValueState("here", "links array<string>")
        self.waiting = handle.getValueState("waiting", "at long, deleted boolean, links array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = self.waiting.get() if self.waiting.exists() else None
        was = last
        for r in rows:
            new = (int(r["seen"].timestamp() * 1000), bool(r["deleted"]), sorted({x for x in r["links"] or () if x is not None}))
            # of changes at one time a deletion counts, then the larger list
            if last is None or (new[0], new[1], new[2]) > (last[0], last[1], list(last[2])):
                last = new
        if last is not was:
            if was is not None:
                self.handle.deleteTimer(was[0] + self.quiet_ms)
            self.waiting.update(tuple(last))
            self.handle.registerTimer(last[0] + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.waiting.exists():
            return
        path, (at, deleted, links) = key[0], self.waiting.get()
        if at + self.quiet_ms > expiredTimerInfo.getExpiryTimeInMs():
            return  # it has changed again
        was = set(self.here.get()[0]) if self.here.exists() else None
        now = None if deleted else set(links)
        self.waiting.clear()
        if now is None:
            self.here.clear()
        else:
            self.here.update((sorted(now),))
        if (was is None) != (now is None):
            yield Row(target=path, source=None, change=1 if was is None else -1)
        for target in sorted((now or set()) - (was or set())):
            yield Row(target=target, source=path, change=1)
        for target in sorted((was or set()) - (now or set())):
            yield Row(target=target, source=path, change=-1)

    def close(self) -> None:
        pass


class BoundLinks(StatefulProcessor):
    """Per target: whether it is there, who links to it, and how many batches have changed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.about = handle.getValueState("about", "here int, turn long")
        self.sources = handle.getMapState("sources", "source string", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        here, turn = self.about.get() if self.about.exists() else (0, 0)
        target, was, turn, changes = key[0], here > 0, turn + 1, {}
        for r in rows:  # sums, so that the order within a batch doesn't matter
            if r["source"] is None:
                here += r["change"]
            else:
                changes[r["source"]] = changes.get(r["source"], 0) + r["change"]
        self.about.update((here, turn))
        said = {}
        for source, change in changes.items():
            at = (source,)
            n = change + (self.sources.getValue(at)[0] if self.sources.containsKey(at) else 0)
            if n:
                self.sources.updateValue(at, (n,))
            elif self.sources.containsKey(at):
                self.sources.removeKey(at)
            said[source] = "gone" if n <= 0 else "bound" if here > 0 else "dangling"
        if was != (here > 0):
            for (source,), (n,) in self.sources.iterator():
                if n > 0:
                    said[source] = "bound" if here > 0 else "dangling"
        for source, state in said.items():
            yield Row(source=source, target=target, state=state, turn=turn)

    def close(self) -> None:
        pass


def file_deltas(events: DataFrame, quiet: str = "2 seconds", late: str = "0 seconds") -> DataFrame:
    """A stream of target, source, change (1 or -1) of events (path, seen, links, deleted); a row without
    source says that the target itself came or went. A file counts once it has been quiet; events
    older than `late` behind the newest are dropped. Events without path or time are left out."""
    ms = int(float(quiet.split()[0]) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[quiet.split()[1].rstrip("s")])
    rows = events.where("path is not null and seen is not null").withWatermark("seen", late)
    return rows.groupBy("path").transformWithState(FileDeltas(ms), DELTAS, "Append", "EventTime")


def bound_log(deltas: DataFrame) -> DataFrame:
    """A stream of source, target, state (bound, dangling or gone), turn: what of the links changed. The
    state of the highest turn of a link holds."""
    return deltas.where("target is not null").groupBy("target").transformWithState(BoundLinks(), LOG, "Append", "None")


def current(log: DataFrame) -> DataFrame:
    """source, target, state of the links that are there."""
    return log.groupBy("source", "target").agg(F.max_by("state", "turn").alias("state")).where("state <> 'gone'")


def rebuilt(events: DataFrame) -> DataFrame:
    """source, target, state of the links after all events, at once."""
    links = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("links", F.array().cast("array<string>")))))
    rows = events.where("path is not null and seen is not null").select("path", F.struct(F.date_trunc("millisecond", "seen").alias("at"), F.coalesce("deleted", F.lit(False)).alias("deleted"), links.alias("links")).alias("e"))
    files = rows.groupBy("path").agg(F.max("e").alias("e")).where("not e.deleted").select("path", "e.links")
    each = files.select(F.col("path").alias("source"), F.explode("links").alias("target"))
    there = files.select(F.col("path").alias("target")).withColumn("there", F.lit(True))
    return each.join(there, "target", "left").select("source", "target", F.when(F.col("there"), "bound").otherwise("dangling").alias("state"))
